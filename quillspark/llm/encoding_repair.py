"""Garbled text from wrong character encoding: transformations learnt from clean near-twins.

Texts are joined on what is left without their non-ASCII characters: a garbled text and its clean twin have
the same rest. Of the texts with one rest, that with the fewest runs that look garbled (of several, the most
frequent) is the centre; every other is aligned with it, and their runs of non-ASCII characters give pairs
(garbled, clean), counted over the collection. A pair that a transformation of code pages explains (written in one, read in another, once
or repeatedly) supports that transformation, other pairs are kept as they are. Together with counts of the
runs' neighbourhoods over the whole collection they decide on the remaining texts:

* transformations that twins show are tried first, and only where none fits those that no twin shows;
* UTF-8 read as a single-byte page leaves sequences that can't be anything else, and are decoded back, into
  Latin letters and signs or into a run of letters of one other script;
* a single-byte page read as another leaves one wrong character for one right one. It is taken as garbled
  where the restored neighbourhood (character before, run, character after) is many times as frequent as the
  one found; the factor is lower for transformations and pairs that twins support. A word that is more
  frequent as found than as restored contests that: it is right unless most of its records hold other garbled
  runs too;
* replacement characters are always garbled, and restored by the most frequent run of that neighbourhood.

All counts stay in Spark, whole: each neighbourhood is joined with the counts of what it may be restored to
and decided on once; the texts are joined with the decisions on garbled ones.

Null, empty and plain ASCII fields have no row; rightly written and dropped accents are no case. Repeated
rows come out each, an empty table gives none. What can't be restored keeps its characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut, spread

RUN = re.compile(r"[^\x00-\x7f]+")
FLUSH = 1 << 17  # entries of a counter or memo in a Python worker
PAGES = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_15")


def _page(name: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = chr(b)  # places without a character keep their number
    return out


_READ = {p: _page(p) for p in PAGES}
_BYTE = {p: {c: b for b, c in m.items()} for p, m in _READ.items()}
_BYTE["cp1252"].update({chr(b): b for b in range(128, 160)})
_RIGHT = set(_READ["cp1252"].values()) | set("–—‘’“”„…•€™≥≤≠∞√") - {chr(b) for b in range(128, 160)}
_RIGHT -= {chr(b) for b in range(128, 160)} | set("ÐÞþðýÝ¦¬¤¸¯¨ƒˆ‰‹›Šš†‡Žž") | {"­"}
_ALL_RIGHT = r"\A[%s]+\z" % "".join(rf"\x{{{ord(c):x}}}" for c in sorted(_RIGHT))  # as Spark has it


#: Transformations that the collection's counts decide on; what others leave can't be right text.
_HARD = re.compile(r"utf8>(?!latin1, lost).*|lost|cp1252>latin1")
_AFTER = re.compile(r"[A-Za-z]*")


def neighbour(c: str) -> str:
    if not c:
        return " "
    if c.isdigit():
        return "0"
    return c if c.isascii() and c.isalpha() else " " if c.isspace() else "."


def runs(text: str):
    """(start, end, before, run, after) of each run of non-ASCII characters; before and after are the ASCII
    letters that touch it, or the kind of what does. The character next to the run is their last and first."""
    for m in RUN.finditer(text):
        a, b = m.span()
        k = a
        while k and text[k - 1].isascii() and text[k - 1].isalpha():
            k -= 1
        yield a, b, text[k:a] or neighbour(text[a - 1 : a]), m.group(), _AFTER.match(text, b).group() or neighbour(text[b : b + 1])


def _foreign(run: str, page: str) -> str | None:
    """The run as UTF-8 letters of one script other than Latin that were read as page."""
    byte = _BYTE[page]
    if any(c not in byte for c in run):
        return None
    try:
        out = bytes(byte[c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return None
    scripts = {unicodedata.name(c, "? ?").split()[0] for c in out if not unicodedata.combining(c)}
    plain = all(unicodedata.category(c)[0] in "LM" for c in out) and len(scripts) == 1 and not scripts & {"LATIN", "?", "MODIFIER", "COMBINING"}
    return out if plain and (len(out) > 1 or run[0] in "ÐÎÏ") else None


def _from_utf8(run: str, page: str) -> str | None:
    """Every UTF-8 sequence in the run that was read as page, decoded; None if there is none."""
    byte, out, i, hit = _BYTE[page], [], 0, False
    while i < len(run):
        lead = byte.get(run[i], 0)
        n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        seq = [byte.get(c, 0) for c in run[i : i + n]]
        if n and len(seq) == n and all(0x80 <= b <= 0xBF for b in seq[1:]):
            try:
                c = bytes(seq).decode("utf-8")
            except UnicodeDecodeError:
                c = ""
            if c and (c in _RIGHT or c in byte):
                out.append(c)
                i += n
                hit = True
                continue
        out.append(run[i])
        i += 1
    return "".join(out) if hit else None


def _from_page(run: str, page: str) -> str | None:
    """The run, written in cp1252 and read as page, as it was."""
    out = "".join(_READ["cp1252"].get(_BYTE[page].get(c, 0), "\0") for c in run)
    return out if out != run and all(c in _RIGHT for c in out) else None


def repairs(run: str):
    """(transformation, restored run) of each transformation that may have led to the run."""
    for page in PAGES:
        if (other := _foreign(run, page)) is not None:
            yield f"utf8>{page}", other
            return
        now, times = run, 0
        while times < 4 and (nxt := _from_utf8(now, page)) is not None:
            now, times = nxt, times + 1
            if all(c in _RIGHT for c in now):
                yield f"utf8>{page}", now
        if page not in ("cp1252", "iso8859_15") and (one := _from_page(run, page)) is not None:
            yield f"cp1252>{page}", one


def suspect(run: str) -> bool:
    """Whether a run looks garbled by itself, without the collection."""
    return any(c not in _RIGHT for c in run) or any(_from_utf8(run, page) is not None for page in PAGES)


class Repairer:
    """Decides on runs. contexts: {(before, run, after): n}, of one character each side; pairs: {(garbled,
    clean): twins}; unsupported: whether transformations that no twin shows are tried too."""

    def __init__(self, contexts: dict, pairs: dict, unsupported: bool = True):
        self.contexts, self.unsupported = contexts, unsupported
        self.total = Counter()
        self.left, self.right = Counter(), Counter()
        self.by_place: dict = {}
        for (p, r, n), k in contexts.items():
            self.total[r] += k
            self.left[p, r] += k
            self.right[r, n] += k
            if all(c in _RIGHT for c in r):
                self.by_place.setdefault((p, len(r), n), []).append((k, r))
        self.support, self.learnt = Counter(), {}
        for (a, b), k in pairs.items():
            for bad, good in ((a, b), (b, a)):
                named = [t for t, x in repairs(bad) if x == good]
                self.support.update({t: k for t in set(named)})
                if "�" not in bad + good and self.total[good] >= 4 * self.total[bad] and all(c in _RIGHT for c in good):
                    self.learnt.setdefault(bad, Counter())[good] += k
        self.known: dict = {}

    def _outweighs(self, p, good, bad, n, factor) -> bool:
        if any(c.isupper() for c in good) and (p.islower() or n.islower()) and not any(c.isupper() for c in bad):
            return False
        have, found = self.contexts.get((p, good, n), 0), self.contexts.get((p, bad, n), 0)
        if have >= 3 and have >= factor * found:
            return True
        if found > 2 or p == n == " ":
            return False
        return min(self.left[p, good], self.right[good, n]) >= 3 * factor * (1 + max(self.left[p, bad], self.right[bad, n]))

    def verdict(self, p: str, run: str, n: str) -> tuple[bool, str, str]:
        """(garbled, restored run, transformation) of a run in its neighbourhood."""
        key = (p, run, n)
        if key not in self.known:
            if len(self.known) > FLUSH:
                self.known.clear()
            self.known[key] = self._decide(p[-1:], run, n[:1])
        return self.known[key]

    def _decide(self, p, run, n):
        best = None
        ways = list(repairs(run))
        shown = [x for x in ways if self.support[x[0]]]
        for part in (shown, [x for x in ways if not self.support[x[0]]] if self.unsupported else []):
            for t, good in part:
                if t.startswith("utf8"):
                    weight = self.contexts.get((p, good, n), 0) + self.support[t] / 1e9
                    if best is None or weight >= best[0]:
                        best = (weight, good, t)
            if best:
                return True, best[1], best[2]
        if "�" in run:
            options = [x for x in self.by_place.get((p, len(run), n), ()) if all(a == b or a == "�" for a, b in zip(run, x[1]))]
            k, good = max(options, default=(0, run))
            return True, good if k >= 3 else run, "lost"
        if any("\x80" <= c <= "\x9f" for c in run):
            good = "".join(_READ["cp1252"].get(ord(c), c) for c in run)
            return True, good, "cp1252>latin1"
        options = []
        for t, good in ways:
            if (self.support[t] or self.unsupported) and self._outweighs(p, good, run, n, 8 if self.support[t] else 25):
                options.append((self.contexts.get((p, good, n), 0), good, t))
        for good, k in self.learnt.get(run, {}).items():
            if self._outweighs(p, good, run, n, 8):
                options.append((self.contexts.get((p, good, n), 0), good, "twin"))
        if set(run) == {"Ã"}:  # UTF-8 capitals read as Latin-1, their second, unprintable half lost
            for k, good in self.by_place.get((p, len(run), n), ()):
                if all("À" <= c <= "ß" for c in good) and good != run and self._outweighs(p, good, run, n, 8):
                    options.append((k, good, "utf8>latin1, lost"))
        if options:
            _, good, t = max(options)
            return True, good, t
        return False, run, ""

    def field(self, text: str):
        """None for a field that is right, else (restored text, transformations)."""
        out, at, named = [], 0, set()
        for a, b, p, run, n in runs(text):
            bad, good, t = self.verdict(p, run, n)
            if bad:
                out += [text[at:a], good]
                at = b
                named.add(t)
        return ("".join([*out, text[at:]]), sorted(named)) if named else None


def _texts(batch):
    for k in range(batch.num_columns):
        for text in batch.column(k).to_pylist():
            if text and not text.isascii():
                yield text


def _words(batches):
    count: Counter = Counter()

    def out():
        k = list(count)
        return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in k], pa.string()) for i in range(3)), pa.array(list(count.values()), pa.int64())], names=["head", "run", "tail", "n"])

    for batch in batches:
        for text in _texts(batch):
            count.update((p, r, n) for _, _, p, r, n in runs(text))
        if len(count) > FLUSH:
            yield out()
            count.clear()
    if count:
        yield out()


def words(src: DataFrame) -> DataFrame:
    """head, run, tail, n: each run of the collection with the letters that touch it."""
    return src.mapInArrow(_words, "head string, run string, tail string, n long").groupBy("head", "run", "tail").agg(F.sum("n").alias("n"))


def _beside(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"before": F.substring("head", -1, 1), "after": F.substring("tail", 1, 1)})


def _rests(batches):
    looks: dict[str, bool] = {}
    for batch in batches:
        keys, variants, suspects = [], [], []
        if len(looks) > FLUSH:
            looks.clear()
        for text in _texts(batch):
            rest, at, parts = [], 0, []
            size = bad = 0
            for m in RUN.finditer(text):
                rest.append(text[at : m.start()])
                size += m.start() - at
                at = m.end()
                r = m.group()
                if r not in looks:
                    looks[r] = suspect(r)
                bad += looks[r]
                parts.append(f"{size}\x01{r}")
            rest.append(text[at:])
            keys.append(xxhash.xxh3_64_intdigest("".join(rest)) - (1 << 63))
            variants.append("\x02".join(parts))
            suspects.append(bad)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(variants, pa.string()), pa.array(suspects, pa.int32())], names=["rest", "variant", "suspects"])


def _align(batches):
    count: Counter = Counter()
    for batch in batches:
        for variant, centre in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = (dict(z.split("\x01", 1) for z in v.split("\x02")) for v in (variant, centre))
            count.update((r, y[o]) for o, r in x.items() if o in y and y[o] != r)
    k = list(count)
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.string()), pa.array(list(count.values()), pa.int64())], names=["a", "b", "n"])


def twins(src: DataFrame) -> DataFrame:
    """variant, centre: each distinct text but the centre of its rest. Copies are counted before they are shuffled."""
    each = src.mapInArrow(_rests, "rest long, variant string, suspects int").groupBy("rest", "variant", "suspects").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct("suspects", (-F.col("n")).alias("n"), "variant")).over(Window.partitionBy("rest"))
    return each.withColumn("centre", best["variant"]).where("variant <> centre").select("variant", "centre")


def collection(src: DataFrame, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contexts(before, run, after, n), pairs(a, b, n), learnt(bad, good, k): all that the collection says of its
    runs. counted: its words, where they are counted already."""
    contexts = cut(_beside(words(src) if counted is None else counted).groupBy("before", "run", "after").agg(F.sum("n").alias("n")))
    pairs = cut(twins(src).mapInArrow(_align, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    total = contexts.groupBy("run").agg(F.sum("n").alias("total"))
    ways = pairs.select(F.col("a").alias("bad"), F.col("b").alias("good"), "n").unionAll(pairs.select(F.col("b").alias("bad"), F.col("a").alias("good"), "n"))
    ways = ways.where(~F.col("bad").contains("�") & F.col("good").rlike(_ALL_RIGHT)).groupBy("bad", "good").agg(F.sum("n").alias("k"))
    weighed = ways.join(total.select(F.col("run").alias("bad"), F.col("total").alias("bads")), "bad").join(total.select(F.col("run").alias("good"), F.col("total").alias("goods")), "good")
    return contexts, pairs, cut(weighed.where("goods >= 4 * bads").select("bad", "good", "k"))


def _named(batches):
    for batch in batches:
        count: Counter = Counter()
        for bad, good, k in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for x, y in ((bad, good), (good, bad)):
                count.update({t: k for t in {t for t, z in repairs(x) if z == y}})
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["t", "k"])


def _candidates(batches):
    for batch in batches:
        rows = [(p, r, n, good, "repair") for p, r, n in zip(*(batch.column(i).to_pylist() for i in range(3))) for good in {x for _, x in repairs(r)}]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in range(5)], names=["before", "run", "after", "good", "by"])


def _verdicts(support, unsupported):
    def run(batches):
        for batch in batches:
            r = Repairer({}, {}, unsupported)
            r.support.update(support)
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for (p, bad, n), found, left, right, options in zip(keys, *(batch.column(i).to_pylist() for i in range(3, 7))):
                r.contexts[p, bad, n], r.left[p, bad], r.right[bad, n] = found, left, right
                for x in options or ():
                    good = x["good"]
                    r.contexts[p, good, n], r.left[p, good], r.right[good, n] = x["have"], x["left"], x["right"]
                    if x["by"] == "twin":
                        r.learnt.setdefault(bad, Counter())[good] = 1
                    elif x["by"] == "place":
                        r.by_place.setdefault((p, len(good), n), []).append((x["have"], good))
            rows = [(*key, good, t) for key in keys for garbled, good, t in [r.verdict(*key)] if garbled]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in range(5)], names=["before", "run", "after", "good", "t"])

    return run


def verdicts(contexts: DataFrame, learnt: DataFrame, unsupported: bool = True) -> DataFrame:
    """before, run, after, good, t of every neighbourhood of the collection that is garbled."""
    named = learnt.mapInArrow(_named, "t string, k long").groupBy("t").agg(F.sum("k").alias("k")).collect()  # a row for each transformation at most
    here = contexts.select("before", "run", "after")
    placed = here.where(F.col("run").contains("�") | F.col("run").rlike("^Ã+$"))
    rights = contexts.where(F.col("run").rlike(_ALL_RIGHT)).select("before", F.col("run").alias("good"), "after")
    fits = F.when(F.col("x.run").contains("�"), F.expr("y.good rlike concat('^', translate(x.run, '�', '.'), '$')")).otherwise(F.col("y.good").rlike("^[À-ß]+$"))
    same = (F.col("x.before") == F.col("y.before")) & (F.col("x.after") == F.col("y.after")) & (F.length("x.run") == F.length("y.good"))
    options = (
        here.mapInArrow(_candidates, "before string, run string, after string, good string, by string")
        .unionAll(here.join(learnt.select(F.col("bad").alias("run"), "good"), "run").select("before", "run", "after", "good", F.lit("twin").alias("by")))
        .unionAll(placed.alias("x").join(rights.alias("y"), same & fits).select("x.before", "x.run", "x.after", "y.good", F.lit("place").alias("by")))
    )
    left = contexts.groupBy("before", "run").agg(F.sum("n").alias("left"))
    right = contexts.groupBy("run", "after").agg(F.sum("n").alias("right"))
    weighed = options.join(contexts.withColumnsRenamed({"run": "good", "n": "have"}), ["before", "good", "after"], "left").join(left.withColumnRenamed("run", "good"), ["before", "good"], "left").join(right.withColumnRenamed("run", "good"), ["good", "after"], "left")
    weighed = weighed.fillna(0, ["have", "left", "right"]).groupBy("before", "run", "after").agg(F.collect_list(F.struct("good", "by", "have", "left", "right")).alias("options"))
    own = contexts.join(left, ["before", "run"]).join(right, ["run", "after"]).join(weighed, ["before", "run", "after"], "left")
    return own.select("before", "run", "after", "n", "left", "right", "options").mapInArrow(_verdicts({r.t: r.k for r in named}, unsupported), "before string, run string, after string, good string, t string")


def contested(garbled: DataFrame, counted: DataFrame) -> DataFrame:
    """head, run, tail of the words that are more frequent as found than as restored, by counts alone."""
    soft = garbled.where(~F.col("t").rlike(f"^(?:{_HARD.pattern})$"))
    found = _beside(counted.where("n >= 3")).join(soft, ["before", "run", "after"]).select("head", "run", "tail", "good", "n")
    have = counted.select("head", F.col("run").alias("good"), "tail", F.col("n").alias("have"))
    return found.join(have, ["head", "good", "tail"], "left").where("n > 4 * coalesce(have, 0)").select("head", "run", "tail", F.lit(True).alias("doubt"))


def _places(batches):
    """Each row's words with a run, once."""
    for batch in batches:
        rows = []
        for rec, *texts in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            met = {(p, r, n) for text in texts if text and not text.isascii() for _, _, p, r, n in runs(text)}
            rows += [(rec, *x) for x in met]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 3))], names=["rec_id", "head", "run", "tail"])


def _apply(columns):
    def run(batches):
        for batch in batches:
            rows = []
            for rec, known, *texts in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                r = Repairer({}, {})
                r.known = {(x["head"], x["run"], x["tail"]): (True, x["good"], x["t"]) for x in known}
                for field, text in zip(columns, texts):
                    if text and not text.isascii():
                        for _, _, p, bad, n in runs(text):
                            r.known.setdefault((p, bad, n), (False, bad, ""))
                        if x := r.field(text):
                            rows.append((rec, field, *x))
            cols = list(zip(*rows)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["rec_id", "field", "restored", "transformations"])

    return run


def garbled_fields(records: DataFrame, id_column: str = "rec_id", columns: tuple[str, ...] = ("title", "abstract"), unsupported: bool = True) -> DataFrame:
    """rec_id, field, restored, transformations of every garbled field.

    Without unsupported only transformations that twins show are applied."""
    src = spread(records.select(F.col(id_column).cast("long").alias("rec_id"), *columns))
    counted = cut(words(src.select(*columns)))
    contexts, _, learnt = collection(src.select(*columns), counted)
    garbled = cut(verdicts(contexts, learnt, unsupported))
    doubts = contested(garbled, counted)
    met = _beside(src.mapInArrow(_places, "rec_id long, head string, run string, tail string")).join(garbled, ["before", "run", "after"]).join(doubts, ["head", "run", "tail"], "left")
    met = cut(met.select("rec_id", "head", "run", "tail", "good", "t", F.coalesce("doubt", F.lit(False)).alias("doubt")))
    sure = met.where("not doubt")
    company = sure.select("rec_id").distinct().withColumn("other", F.lit(1))
    doubted = met.where("doubt")
    kept = doubted.join(company, "rec_id", "left").groupBy("head", "run", "tail").agg((F.count("other") * 2 >= F.count(F.lit(1))).alias("kept")).where("kept").drop("kept")
    settled = sure.unionAll(doubted.join(kept, ["head", "run", "tail"], "left_semi").select(*sure.columns))
    known = settled.groupBy(F.col("rec_id").alias("rec")).agg(F.collect_set(F.struct("head", "run", "tail", "good", "t")).alias("known"))
    held = src.join(known, F.col("rec_id").eqNullSafe(F.col("rec"))).select("rec_id", "known", *columns)
    return held.mapInArrow(_apply(columns), "rec_id long, field string, restored string, transformations array<string>")
