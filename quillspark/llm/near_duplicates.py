"""Near-duplicate records: fast similarity sketching, banding, exact verification.

The words of a record are the distinct lower-cased runs of letters and digits of its title and abstract.
Records with the same words are one class, and classes are what is compared. A sketch has COORDINATES
places. In round i every word falls into a place chosen by a hash, with a hashed value; a place keeps the
least value of the first round that reached it. After COORDINATES such rounds, round COORDINATES + j sends
every word to place j, so every place is filled. Two places agree with the probability of the Jaccard
similarity, with concentration of their mean. BANDS bands of ROWS places make the buckets; SIGNATURE further
places give a bit each, which with the sizes screen pairs inside a bucket before they are written.

Buckets are read in order from a sorted partition. Those of up to BUCKET classes are compared block by block:
pairs that share a bucket by chance grow with the square of the collection, so they have to be cheap there and
few of them may leave it. A bucket of more is not expanded. Its classes go to an exact way instead: prefix
filtering, by which two classes can only reach the threshold if they share one of their rarest words. Every
candidate is verified on whole texts.

At similarity s a pair is met with probability 1 - (1 - s**ROWS)**BANDS times that of passing the screen,
which loses under one in a million from 0.75 on: 0.9996 at 0.75, over 0.9999 from 0.8. Null fields count as empty; records under `least` words have no
partner; repeated rows pair as other rows do; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut, spread

COORDINATES, ROWS, BANDS, SIGNATURE = 512, 6, 40, 256
BUCKET = 1 << 14
SCREEN = 60  # of SIGNATURE bits that may differ
_SIGS = [f"sig{k}" for k in range(SIGNATURE // 64)]
_BAND_ROWS = "key long, cls long, n int, " + ", ".join(f"{k} long" for k in _SIGS)
_SMALL, _BLOCK = 64, 1 << 20  # buckets up to this are compared together; pairs compared at once
_WORD = re.compile(r"[^\W_]+")
_CACHE = 1 << 18
_EMPTY = np.uint32(0xFFFFFFFF)
U, V = np.uint64, np.uint32


_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(title: str | None, abstract: str | None) -> set[str]:
    return set(_WORD.findall(f"{title or ''} {abstract or ''}".lower()))


class Words:
    """words() at the speed of bytes: ASCII separators are cut there, what holds other characters by the
    pattern; each distinct stretch is worked on once. value(word) is what stands for a word."""

    def __init__(self, value=lambda w: w):
        self.value, self.known = value, {}

    def __call__(self, title: str | None, abstract: str | None) -> set:
        stretches = set(f"{title or ''} {abstract or ''}".lower().encode("utf-8", "surrogatepass").translate(_APART).split())
        known = self.known
        new = stretches.difference(known)
        if new:
            if len(known) > _CACHE:
                known.clear()
                new = stretches
            for s in new:
                text = s.decode("utf-8", "surrogatepass")
                known[s] = (self.value(text),) if s.isascii() else tuple(map(self.value, _WORD.findall(text)))
        return set(chain.from_iterable(map(known.__getitem__, stretches)))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a public 64-bit mixing function (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hashes(batch, hashed: Words, least: int):
    """Of the rows with enough words: their places in the batch, sizes and flat word hashes."""
    rows, sizes, sets = [], [], []
    for i, (title, abstract) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
        hs = hashed(title, abstract)
        if len(hs) >= least:
            rows.append(i)
            sizes.append(len(hs))
            sets.append(hs)
    return rows, np.array(sizes, np.int64), np.fromiter(chain.from_iterable(sets), np.uint64, sum(sizes))


def _classes(sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set of words, whatever their order."""
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return np.add.reduceat(_mix(flat), at).view(np.int64), np.add.reduceat(_mix(flat ^ U(0x9E3779B97F4A7C15)), at).view(np.int64)


def sketch(sizes: np.ndarray, flat: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """sizes.size x t places of the fast similarity sketch of sets of word hashes.

    A place holds the round in its upper bits and 22 bits of the word's hash in that round below. Each
    64-bit hash serves two rounds."""
    n = len(sizes)
    out = np.full(n * t, _EMPTY, np.uint32)
    own, h = np.repeat(np.arange(n, dtype=np.int64) * t, sizes), flat
    for i in range(0, 2 * t, 2):
        x = _mix(h + U((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)).view(np.uint32).reshape(-1, 2)
        for k in (0, 1):
            half = x[:, k]
            place = own + (half & V(t - 1)) if i < t else own + (i + k - t)
            np.minimum.at(out, place, V((i + k) << 22) | (half >> V(10)))
        if i >= 6 and i % 4 == 2:
            left = (out.reshape(n, t) == _EMPTY).any(axis=1)
            if not left.any():
                break
            keep = left[own // t]
            own, h = own[keep], h[keep]
    return out.reshape(n, t)


def _bands(least):
    def run(batches):
        hashed = Words(xxhash.xxh3_64_intdigest)
        seen: set = set()
        for batch in batches:
            rows, sizes, flat = _hashes(batch, hashed, least)
            if rows:
                cls, _ = _classes(sizes, flat)
                # copies met in this partition are sketched once: the map-side combine of hot texts
                fresh = np.array([not (c in seen or seen.add(c)) for c in cls.tolist()])
                if len(seen) > _CACHE:
                    seen.clear()
                flat, sizes, cls = flat[np.repeat(fresh, sizes)], sizes[fresh], cls[fresh]
            if not rows or not len(sizes):
                continue
            s = sketch(sizes, flat)
            n = len(sizes)
            key = np.zeros((n, BANDS), np.uint64)
            for k in range(ROWS):
                key = _mix(key * U(31) + s[:, k : BANDS * ROWS : ROWS].astype(np.uint64))
            key = (key >> U(24)) | (np.arange(BANDS, dtype=np.uint64) << U(40))
            sig = np.packbits((s[:, COORDINATES - SIGNATURE :] & V(1)).astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(cls, BANDS)), pa.array(np.repeat(sizes, BANDS).astype(np.int32)), *(pa.array(np.repeat(sig[:, k], BANDS)) for k in range(len(_SIGS)))], names=["key", "cls", "n", *_SIGS]
            )

    return run


def _pairs(threshold):
    """Candidates of sorted rows (key, cls, n, signature in words of 64 bits); hot buckets give their classes as a = b."""

    def screened(cls, n, sig, x, y):
        near = np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y])
        x, y = x[near], y[near]
        near = sum(np.bitwise_count((k[x] ^ k[y]).view(np.uint64)).astype(np.uint16) for k in sig) <= SCREEN
        x, y = x[near], y[near]
        return np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])

    def small(cls, n, sig, starts, lengths):
        """Buckets of one size together."""
        for size in np.unique(lengths):
            if size < 2:
                continue
            base = starts[lengths == size]
            i, j = np.triu_indices(int(size), 1)
            step = max(1, _BLOCK // len(i))
            for part in range(0, len(base), step):
                b = base[part : part + step, None]
                yield screened(cls, n, sig, (b + i).ravel(), (b + j).ravel())

    def large(cls, n, sig, start, length):
        """One bucket, by size: each block of rows with those after it whose size still allows the threshold."""
        by = start + np.argsort(n[start : start + length], kind="stable")
        sizes = n[by]
        end = np.searchsorted(sizes, sizes / threshold * (1 + 1e-9), "right")
        at = 0
        while at < length:
            upto = min(length, at + max(1, _BLOCK // max(1, int(end[at]) - at)))
            i, j = np.nonzero(np.arange(at, end[upto - 1]) > np.arange(at, upto)[:, None])
            yield screened(cls, n, sig, by[at + i], by[at + j])
            at = upto

    def run(batches):
        held = None
        hot_key = None

        def out(parts):
            for a, b in parts:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def work(cols, last):
            """All buckets but the last, which may go on; (the rest, the candidates)."""
            key, cls = cols[:2]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, n, *sig = cols = [c[fresh] for c in cols]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lengths = np.diff(np.append(starts, len(key)))
            rest = None
            if not last:
                rest = [c[starts[-1] :] for c in cols]
                starts, lengths = starts[:-1], lengths[:-1]

            def found():
                few = lengths <= min(_SMALL, BUCKET)
                yield from small(cls, n, sig, starts[few], lengths[few])
                for s, m in zip(starts[~few].tolist(), lengths[~few].tolist()):
                    if m > BUCKET:
                        yield cls[s : s + m], cls[s : s + m]
                    else:
                        yield from large(cls, n, sig, s, m)

            return rest, found()

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(batch.num_columns)]
            if hot_key is not None:  # inside a bucket already known as hot
                same = cols[0] == hot_key
                if same.any():
                    yield from out([(np.unique(cols[1][same]),) * 2])
                    cols = [c[~same] for c in cols]
                if not len(cols[0]):
                    continue
                hot_key = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            held, parts = work(cols, False)
            yield from out(parts)
            if held is not None and len(held[0]) > BUCKET:
                hot_key = held[0][0]
                yield from out([(held[1], held[1])])
                held = None
        if held is not None:
            yield from out(work(held, True)[1])

    return run


def _members(least):
    def run(batches):
        hashed = Words(xxhash.xxh3_64_intdigest)
        for batch in batches:
            rows, sizes, flat = _hashes(batch, hashed, least)
            if rows:
                c1, c2 = _classes(sizes, flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(3).take(pa.array(rows)), pa.array(c1), pa.array(c2)], names=["rec_id", "id", "c1", "c2"])

    return run


def _prefix_words(threshold):
    def run(batches):
        for batch in batches:
            cls, word, size = [], [], []
            for c, t, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ws = words(t, a)
                cls += [c] * len(ws)
                word += ws
                size += [len(ws)] * len(ws)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(word, pa.string()), pa.array(size, pa.int32())], names=["cls", "word", "n"])

    return run


def _exact_candidates(hot: DataFrame, texts: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """a, b: all pairs of hot classes that share one of their rarest words."""
    rep = members.join(hot.withColumnRenamed("cls", "c1"), "c1", "left_semi").groupBy("c1").agg(F.min("rec_id").alias("rec_id"))
    held = cut(rep.join(texts, "rec_id").select("c1", "title", "abstract").mapInArrow(_prefix_words(threshold), "cls long, word string, n int"))
    common = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = held.join(common, "word").withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("df", "word")))
    first = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("cls", "word", "n")
    x, y = first.alias("x"), first.alias("y")
    near = (F.col("x.cls") < F.col("y.cls")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold)
    return x.join(y, (F.col("x.word") == F.col("y.word")) & near).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def _verify(threshold, least):
    def run(batches):
        last, right, told = None, None, Words()
        for batch in batches:
            keep, sims = [], []
            cols = [batch.column(k).to_pylist() for k in range(2, 6)]
            for i, (ta, aa, tb, ab) in enumerate(zip(*cols)):
                if last != (tb, ab):  # rows come sorted by the second record
                    last, right = (tb, ab), told(tb, ab)
                left = told(ta, aa)
                both = len(left & right)
                of = len(left) + len(right) - both
                if min(len(left), len(right)) >= least and both >= threshold * of and left != right:
                    keep.append(i)
                    sims.append(both / of)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sims, pa.float64())], names=["rep_a", "rep_b", "similarity"])

    return run


def _work(records: DataFrame, threshold: float, least: int):
    """members(rec_id, id, c1, c2) and verified links(rep_a, rep_b, similarity), rep: least rec_id of a class."""
    texts = records.select("rec_id", "title", "abstract")
    members = cut(spread(records.select("rec_id", "title", "abstract", "id")).mapInArrow(_members(least), "rec_id long, id string, c1 long, c2 long"))
    bands = spread(texts).mapInArrow(_bands(least), _BAND_ROWS)
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(bands.repartition(n, "key").sortWithinPartitions("key", "cls").mapInArrow(_pairs(threshold), "a long, b long").distinct())
    pairs = found.where("a <> b")
    hot = found.where("a = b").select(F.col("a").alias("cls"))
    if not hot.isEmpty():
        pairs = pairs.unionByName(_exact_candidates(hot, texts, members, threshold)).distinct()
    reps = members.groupBy("c1", "c2").agg(F.min("rec_id").alias("rep")).select("c1", "rep")
    by_rep = pairs.join(reps.select(F.col("c1").alias("a"), F.col("rep").alias("rep_a")), "a").join(reps.select(F.col("c1").alias("b"), F.col("rep").alias("rep_b")), "b").select("rep_a", "rep_b")
    need = cut(by_rep)
    wanted = need.select(F.col("rep_a").alias("rec_id")).unionAll(need.select(F.col("rep_b").alias("rec_id"))).distinct()
    own = texts.join(wanted, "rec_id", "left_semi")
    both = (
        need.join(own.select(F.col("rec_id").alias("rep_a"), F.col("title").alias("ta"), F.col("abstract").alias("aa")), "rep_a")
        .join(own.select(F.col("rec_id").alias("rep_b"), F.col("title").alias("tb"), F.col("abstract").alias("ab")), "rep_b")
        .select("rep_a", "rep_b", "ta", "aa", "tb", "ab")
    )
    links = cut(both.mapInArrow(_verify(threshold, least), "rep_a long, rep_b long, similarity double"))
    rows = members.join(members.groupBy("c1", "c2").agg(F.min("rec_id").alias("rep")), ["c1", "c2"]).select("rep", "rec_id", "id")
    return rows, links


def near_duplicate_pairs(records: DataFrame, threshold: float = 0.75, least: int = 20) -> DataFrame:
    """records(rec_id, id, title, abstract) -> rec_id_a < rec_id_b of all row pairs with different id."""
    rows, links = _work(records, threshold, least)
    x = rows.select(F.col("rep").alias("rep_a"), F.col("rec_id").alias("ra"), F.col("id").alias("ia"))
    y = rows.select(F.col("rep").alias("rep_b"), F.col("rec_id").alias("rb"), F.col("id").alias("ib"))
    other = ~F.col("ia").eqNullSafe(F.col("ib"))
    across = links.join(x, "rep_a").join(y, "rep_b").where(other)
    inside = x.join(y, (F.col("rep_a") == F.col("rep_b")) & (F.col("ra") < F.col("rb"))).where(other)
    pair = (F.least("ra", "rb").alias("rec_id_a"), F.greatest("ra", "rb").alias("rec_id_b"))
    return across.select(*pair).unionAll(inside.select(*pair))


def near_duplicate_classes(records: DataFrame, threshold: float = 0.75, least: int = 20) -> DataFrame:
    """rec_id, class_id (least rec_id with the same words), copies in the class, links to other classes."""
    rows, links = _work(records, threshold, least)
    ends = links.select(F.col("rep_a").alias("rep")).unionAll(links.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    size = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    known = rows.join(size, "rep").join(ends, "rep", "left").select("rec_id", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    alone = records.select("rec_id").join(known.select("rec_id"), "rec_id", "left_anti")
    return known.unionAll(alone.select("rec_id", F.col("rec_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links")))
