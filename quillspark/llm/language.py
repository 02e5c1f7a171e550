"""Document languages, also of the parts of mixed ones: string-kernel classification.

The kernel of two segments is the number of character n-grams of 1 to 5 characters (word ends included) that
are present in both: a blended spectrum of presence, normalised by the n-grams of each side. A bounded sample
of labelled rows is drawn by hash; MAX_LANDMARKS of its segments are Nyström landmarks, and one-versus-rest
kernel ridge regression is solved on their features: on each half of the segments, which tells the labels of
the other half that it contradicts (labels are wrong for some rows), and then on all others. As every landmark is a vector of n-grams, the solution folds into one weight
for each n-gram and language, and batches of segments are scored by one product of their 0/1 matrix of
n-grams with the weights.

A title is one segment, an abstract is cut into sentences. Each gets the best language and a confidence
(0 to 1, from the margin to the second). A segment of low margin is searched for the place where its language
changes: it is parted there if both sides have MIN_PART words and are clear by themselves. Parts have a
language of their own; the field has that of the whole sentence, and those of titles set side by side
(a = b, a / b, a [b]).

Titles under MIN_TITLE_WORDS words, abstract segments that are no sentence (without an end mark and under
MIN_WORDS words), placeholders, null and empty fields have no language. Repeated rows come out each; an
empty table gives none. Without any labelled row nothing can be learnt and no field has a language.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread

LANGUAGES = ("pt", "en", "es", "fr")
#: Bounds of the sample that is fitted: rows drawn, segments used, landmarks, n-gram places.
MAX_ROWS, MAX_SEGMENTS, MAX_LANDMARKS, PLACES = 5000, 24000, 1024, 1 << 15
RIDGE, MIN_WORDS, MIN_TITLE_WORDS, LONGEST = 1e-5, 5, 4, 5
#: Segments under MIXED are searched for a change of language; parts need MIN_PART words and CLEAR.
MIXED, MIN_PART, CLEAR = 1.0, 4, 0.5
FOLD, DOUBT = 8, 0.2  # consecutive segments on one side of the halves, and the margin by which a label is contradicted
CHUNK, SPARSE = 64, 16  # segments in a product: as a full matrix, and as its entries
DENSE = 2048  # n-grams that most landmarks have; the kernel multiplies these and counts the others
_END = re.compile(r"[.!?…][\"”»)\]]*\s*\Z")
_SIDE = re.compile(r"[=/|\[\]]")
#: What stands in place of a text.
_PLACEHOLDER = re.compile(r"(?i)\W*(?:(?:resumo|abstract|resumen|r[ée]sum[ée]|texto?|text|summary)\W+)?(?:not? available|n[ãa]o (?:dispon[íi]vel|informado|consta)|no disponible|non disponible|indispon[íi]vel|unavailable|n/?[ad]|(?:sem|no|sin|sans) (?:resumo|abstract|resumen|r[ée]sum[ée]))\W*\Z")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TAG = re.compile(r"<[^<>]{0,200}>|&#?\w{1,10};|\{\{[^{}]*\}\}|```.*?```|https?://\S+|\\(?:cite|label|begin|end)\{[^{}]*\}", re.S)
_ACCENT = re.compile(r"\\['`^~\"c]\s*\{?\\?([A-Za-z])\}?")
_BREAK = re.compile(r"(?<=[.!?])[)\]”\"]?(?:\s*\{\*\}\.|\s*\[[^\]]{1,8}\]\.)?\s+(?=[^\sa-z0-9(])|\n+|</(?i:p|li|h\d|td|\w+:p|\w+:title)>|<(?i:br)\s*/?>|\\item\b|\\(?:sub)*section\*?\{[^{}]*\}")

#: Names of the four languages in them and in some others, without accents, and their codes.
NAMES = {
    "pt": "pt por portuguese portugues portugais portugiesisch portoghese portugees portugalski brazilian brazilian portuguese portugues brasileiro brasileiro",
    "en": "en eng english ingles anglais englisch inglese engels angielski",
    "es": "es spa spanish espanol espanhol castellano castelhano castilian espagnol castillan spanisch spagnolo spaans hiszpanski",
    "fr": "fr fra fre french francais frances franzosisch francese frans francuski",
}
_ACCENTED, _BARE = "áàâãäåéèêëíìîïóòôõöúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"


def label_languages(label: Column) -> Column:
    """The languages that a label names, as array; empty for null, blank and other labels."""
    parts = F.split(F.translate(F.lower(F.coalesce(label, F.lit(""))), _ACCENTED, _BARE), "[;/]")
    bare = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""), r"^([a-z]{2,3})[-_][a-z0-9]{2,4}$", "$1"))
    named = F.transform(bare, lambda p: F.coalesce(*[F.when(p.isin([*names.split(), "brazilian portuguese", "portugues brasileiro"] if k == "pt" else names.split()), F.lit(k)) for k, names in NAMES.items()]))
    return F.array_distinct(F.filter(named, lambda p: p.isNotNull()))


def segments(text: str) -> list[str]:
    """Sentences of a text, markup left out."""
    if "<" in text or "&" in text or "{" in text or "`" in text or "\\" in text or "://" in text:
        text = _BREAK.sub("\n", text)
        text = _ACCENT.sub(r"\1", text)
        text = _TAG.sub(" ", text)
    return [s for s in _BREAK.split(text) if s]


def words(segment: str) -> set[str]:
    return set(_WORD.findall(segment.lower()))


def grams(word: str) -> list[int]:
    w = f" {word} "
    return list({xxhash.xxh32_intdigest(w[i : i + n]) & (PLACES - 1) for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1)})


SHIFT = PLACES.bit_length() - 1


def _once(at: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Of places with repeats the last mention of each, in their order; held: room for every place."""
    turn = np.arange(len(at), dtype=np.int32)
    held[at] = turn
    return at[held[at] == turn]


class Presence:
    """0/1 matrices of the n-grams of sets of words; each word's n-grams are made once."""

    def __init__(self):
        self.grams: dict[str, np.ndarray] = {}
        self.matrix = self.turn = None
        self.last = np.zeros(SPARSE * PLACES, np.int32)

    def learn(self, sets) -> None:
        if len(self.grams) > 1 << 18:
            self.grams = {}
        for w in set().union(*sets).difference(self.grams):
            self.grams[w] = np.array(grams(w), np.uint16)

    def _places(self, part):
        """Of the sets' n-grams, with repeats: how many each set has, and their places in a matrix of a row a set."""
        known = self.grams
        each = [[known[w] for w in ws] for ws in part]
        n = np.array([sum(map(len, x)) for x in each])
        return n, np.repeat(np.arange(len(part), dtype=np.int32) * PLACES, n) + np.concatenate([g for x in each for g in x] or [np.zeros(0, np.uint16)])

    def chunks(self, sets):
        """(first, matrix) of CHUNK sets at a time; the matrix is used again for the next."""
        return ((first, m) for first, m, _ in self.placed_chunks(sets))

    def placed_chunks(self, sets):
        """As chunks, with the places of the ones, row by row."""
        if self.matrix is None:
            self.matrix, self.turn = np.zeros((CHUNK, PLACES), np.float32), np.zeros(CHUNK * PLACES, np.int32)
        flat = self.matrix.ravel()
        for first in range(0, len(sets), CHUNK):
            part = sets[first : first + CHUNK]
            _, at = self._places(part)
            flat[at] = 1
            yield first, self.matrix[: len(part)], _once(at, self.turn)
            flat[at] = 0

    def products(self, sets, weights: np.ndarray):
        """(sums, present): the 0/1 matrix of the sets, kept sparse, times weights, and the n-grams of each set."""
        out, size = np.zeros((len(sets), weights.shape[1]), np.float32), np.ones(len(sets), np.float32)
        for first in range(0, len(sets), SPARSE):
            part = sets[first : first + SPARSE]
            n, at = self._places(part)
            if not len(at):
                continue
            at = _once(at, self.last)
            count = np.bincount(at >> SHIFT, minlength=len(part))
            begin = np.cumsum(count) - count
            some = np.flatnonzero(n)
            out[first + some] = np.add.reduceat(weights[at & (PLACES - 1)], begin[some], axis=0)
            size[first + some] = count[some]
        return out, size


class Landmarks:
    """The kernel of segments with a 0/1 matrix of landmarks."""

    def __init__(self, matrix: np.ndarray):
        held = matrix.sum(axis=0, dtype=np.int64)
        self.norm = np.sqrt(matrix.sum(axis=1, dtype=np.float64)).astype(np.float32)
        self.top = np.argsort(-held, kind="stable")[:DENSE]
        self.dense = np.ascontiguousarray(matrix[:, self.top].T, np.float32)
        self.many = held.copy()
        self.many[self.top] = 0
        gram, who = np.nonzero(matrix.T)
        self.who = who[self.many[gram] > 0].astype(np.int32)
        self.start = np.cumsum(self.many) - self.many

    def kernel(self, m: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """The kernel of the rows of a 0/1 matrix; places: of its ones, where they are known."""
        both = m[:, self.top] @ self.dense
        row, gram = np.divmod(np.flatnonzero(m) if places is None else places, PLACES)
        n = self.many[gram]
        at = np.arange(n.sum()) + np.repeat(self.start[gram] - (np.cumsum(n) - n), n)
        both += np.bincount(np.repeat(row * len(self.norm), n) + self.who[at], minlength=both.size).reshape(both.shape)
        size = np.bincount(row, minlength=len(m)).astype(np.float32)
        return both / self.norm / np.sqrt(size)[:, None]


def fit(sample: list[tuple[str, str]]) -> np.ndarray | None:
    """Weights PLACES x languages from (segment, language). Only features are held of all segments."""
    sets = [(words(s), LANGUAGES.index(k)) for s, k in sample]
    sets = [(w, k) for w, k in sets if len(w) >= MIN_TITLE_WORDS][:MAX_SEGMENTS]
    if not sets or len({k for _, k in sets}) < 2:
        return None
    y, own = np.array([k for _, k in sets]), [w for w, _ in sets]
    pick = np.sort(np.concatenate([np.flatnonzero(y == k)[: MAX_LANDMARKS // len(LANGUAGES)] for k in range(len(LANGUAGES))]))
    present = Presence()
    present.learn(own)
    chosen = np.concatenate([m.astype(np.uint8) for _, m in present.chunks([own[i] for i in pick])])
    landmarks = Landmarks(chosen)
    among = np.concatenate([landmarks.kernel(m) for _, m in present.chunks([own[i] for i in pick])]).astype(np.float64)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    half = vector / np.sqrt(np.maximum(value, 1e-6))
    small = half.astype(np.float32)
    z = np.zeros((len(own), len(pick)), np.float32)
    for first, m, places in present.placed_chunks(own):
        z[first : first + len(m)] = landmarks.kernel(m, places) @ small
    fold = (np.arange(len(y)) // FOLD) % 2

    def sums(rows):
        gram, right = np.zeros((z.shape[1],) * 2), np.zeros((z.shape[1], len(LANGUAGES)))
        for first in range(0, len(rows), 2048):
            x, told = z[rows[first : first + 2048]], y[rows[first : first + 2048]]
            gram += x.T @ x
            right += x.T @ np.where(told[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0).astype(np.float32)
        return gram, right, len(rows)

    def solved(gram, right, n):
        return np.linalg.solve(gram + RIDGE * max(n, 1) * np.eye(len(gram)), right)

    # each half is held against the solution of the other, which has not seen its labels
    halves = [np.flatnonzero(fold == k) for k in (0, 1)]
    told = [sums(rows) for rows in halves]
    wrong = []
    for k in (0, 1):
        score = z[halves[k]] @ solved(*told[1 - k]).astype(np.float32)
        own = score[np.arange(len(score)), y[halves[k]]]
        wrong.append(halves[k][score.max(axis=1) - own >= DOUBT])
    wrong = np.concatenate(wrong)
    less = sums(wrong)
    w = solved(*(a + b - c for a, b, c in zip(*told, less)))
    folded = (half @ w / landmarks.norm[:, None]).astype(np.float32)
    return np.concatenate([chosen[:, k : k + 2048].T.astype(np.float32) @ folded for k in range(0, PLACES, 2048)])


class Scorer:
    """Scores of segments in one product a chunk, and the place where a segment's language changes."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.present = np.ascontiguousarray(weights, np.float32), Presence()

    def scores(self, sets: list[set[str]]) -> np.ndarray:
        self.present.learn(sets)
        out, size = self.present.products(sets, self.weights)
        return out / np.sqrt(size)[:, None]

    def change(self, told: list[str]) -> int | None:
        """The word before which the language changes most by the sums of words, None if it doesn't."""
        if len(told) < 2 * MIN_PART:
            return None
        self.present.learn([told])
        each = np.array([self.weights[self.present.grams[w]].sum(axis=0) for w in told])
        head = np.cumsum(each, axis=0)[MIN_PART - 1 : len(told) - MIN_PART]
        tail = each.sum(axis=0) - head
        gain = np.where(head.argmax(axis=1) != tail.argmax(axis=1), head.max(axis=1) + tail.max(axis=1), -np.inf)
        return MIN_PART + int(gain.argmax()) if np.isfinite(gain.max()) else None

    def parts(self, text: str) -> list[tuple[int, int, int, float]]:
        """(start, end, language, margin) of the parts of a mixed segment; one if it isn't mixed."""
        at = [m.span() for m in _WORD.finditer(text)]
        told = [text[a:b].lower() for a, b in at]

        def best(a, b):
            s = np.sort(x := self.scores([set(told[a:b])])[0])
            return int(x.argmax()), float(s[-1] - s[-2])

        cuts, todo = [], [(0, len(told))]
        while todo:
            a, b = todo.pop()
            k = self.change(told[a:b])
            if k is not None:
                (x, mx), (y, my) = best(a, a + k), best(a + k, b)
                if x != y and min(mx, my) >= CLEAR:
                    todo += [(a + k, b), (a, a + k)]
                    continue
            cuts.append((a, b))
        starts = [0, *(at[a][0] for a, _ in cuts[1:]), len(text)]
        return [(p, q, *best(a, b)) for (a, b), p, q in zip(cuts, starts, starts[1:])]


def confidence(margin):
    return np.round(1 / (1 + np.exp(-4.0 * np.asarray(margin, np.float64))), 4)


def _candidates(field: str, text: str) -> list[tuple[str, set[str]]]:
    """The segments of a field that may have a language, with their words."""
    out = []
    for s in [" ".join(segments(text))] if field == "title" else segments(text):
        told = _WORD.findall(s.lower())
        if field == "title":
            ok = len(told) >= MIN_TITLE_WORDS
        else:
            ok = len(told) >= MIN_WORDS or (len(told) > 1 and _END.search(s))
        if ok and not (len(told) <= 6 and _PLACEHOLDER.match(s)):
            out.append((s, set(told)))
    return out


def _held(state, held: list[Scorer]) -> Scorer:
    """The worker's scorer, made once."""
    if not held:
        held.append(Scorer(state.value))
    return held[0]


def _gathered(batch):
    """(rec_id, field, place in the field, text) and the words of each segment of a batch."""
    ids = batch.column(0).to_pylist()
    rows, sets = [], []
    for field, k in (("title", 1), ("abstract", 2)):
        for rec, text in zip(ids, batch.column(k).to_pylist()):
            for i, (s, ws) in enumerate(_candidates(field, text) if text else ()):
                rows.append((rec, field, i, s))
                sets.append(ws)
    return rows, sets


def _scored(scorer: Scorer, sets):
    """Best language of each set of words, and its margin to the second."""
    score = scorer.scores(sets)
    order = np.sort(score, axis=1)
    return score.argmax(axis=1), order[:, -1] - order[:, -2]


def _side_by_side(s: str, found) -> bool:
    return len(found) > 1 and all(_SIDE.search(s[max(0, a - 3) : a]) for a, *_ in found[1:])


def _segments(state):
    held: list[Scorer] = []

    def run(batches):
        for batch in batches if state.value is not None else ():
            rows, sets = _gathered(batch)
            if not rows:
                continue
            scorer = _held(state, held)
            best, margin = _scored(scorer, sets)
            out = []
            for (rec, field, i, s), k, m, mixed in zip(rows, (LANGUAGES[x] for x in best), confidence(margin).tolist(), (margin < MIXED).tolist()):
                found = scorer.parts(s) if mixed else ()
                if len(found) < 2:
                    out.append((rec, field, i, 0, s, k, m, k))
                    continue
                side = field == "title" and _side_by_side(s, found)
                for j, (a, b, own, clear) in enumerate(found):
                    out.append((rec, field, i, j, s[a:b], LANGUAGES[own], float(confidence(clear)), LANGUAGES[own] if side else k if j == 0 else None))
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["rec_id", "field", "segment", "part", "text", "lang", "confidence", "counts_as"])

    return run


def _fields(state):
    """As _segments with counts_as, counted for each field: no text leaves the worker."""
    held: list[Scorer] = []

    def run(batches):
        for batch in batches if state.value is not None else ():
            rows, sets = _gathered(batch)
            if not rows:
                continue
            scorer = _held(state, held)
            best, margin = _scored(scorer, sets)
            known: dict = {}
            field = np.array([known.setdefault((r[0], r[1]), len(known)) for r in rows])
            sided = [(f, scorer.parts(r[3]), k) for k, (r, f, m) in enumerate(zip(rows, field, margin)) if m < MIXED and r[1] == "title" and _SIDE.search(r[3])]
            sided = [x for x in sided if _side_by_side(rows[x[2]][3], x[1])]
            plain = np.ones(len(rows), bool)
            plain[[k for *_, k in sided]] = False
            key = np.concatenate([field[plain] * len(LANGUAGES) + best[plain], np.array([f * len(LANGUAGES) + own for f, found, _ in sided for _, _, own, _ in found], np.int64)])
            clear = np.concatenate([margin[plain], [m for _, found, _ in sided for *_, m in found]])
            kinds, place, n = np.unique(key, return_inverse=True, return_counts=True)
            most = np.full(len(kinds), -np.inf)
            np.maximum.at(most, place, clear)
            rec, name = zip(*known)
            at = (kinds // len(LANGUAGES)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([rec[i] for i in at], pa.int64()), pa.array([name[i] for i in at], pa.string()), pa.array([LANGUAGES[i] for i in kinds % len(LANGUAGES)], pa.string()), pa.array(n, pa.int64()), pa.array(confidence(most))],
                names=["rec_id", "field", "lang", "segments", "confidence"],
            )

    return run


def _fit(batches):
    """One row of weights, or none, from all the rows of the sample."""
    sample = [(s, lang) for b in batches for title, abstract, lang in zip(*(b.column(k).to_pylist() for k in range(3))) for t in (title, abstract) if t for s in segments(t)[:8]]
    weights = fit(sample)
    if weights is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weights.ravel()], pa.list_(pa.float32()))], names=["weights"])


def learn(records: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray | None:
    """Weights from at most max_rows rows whose label names one language, drawn by the hash of rec_id.

    They are fitted by one task; only the weights, PLACES x languages, come to the driver."""
    one = label_languages(F.col("rotulo"))
    drawn = labels.select("rec_id", one.alias("k")).where(F.size("k") == 1).select("rec_id", F.col("k")[0].alias("lang"))
    each = [drawn.where(F.col("lang") == k).orderBy(F.xxhash64("rec_id"), "rec_id").limit(max_rows // len(LANGUAGES)) for k in LANGUAGES]
    drawn = reduce(DataFrame.unionAll, each)  # as many of each language, at most max_rows
    rows = records.select("rec_id", "title", "abstract").join(F.broadcast(drawn), "rec_id").orderBy(F.xxhash64("rec_id")).limit(2 * max_rows)
    got = rows.select("title", "abstract", "lang").coalesce(1).mapInArrow(_fit, "weights array<float>").collect()
    return np.array(got[0].weights, np.float32).reshape(PLACES, -1) if got else None


def _source(records: DataFrame) -> DataFrame:
    return spread(records.select(F.col("rec_id").cast("long").alias("rec_id"), "title", "abstract"))


def language_segments(records: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """rec_id, field, segment, part, text, lang, confidence, counts_as of every title and sentence.

    A mixed segment has a row for each part. counts_as is the language that the row gives its field: that of
    the whole segment, of titles side by side that of each."""
    state = records.sparkSession.sparkContext.broadcast(learn(records, labels, max_rows))
    return _source(records).mapInArrow(_segments(state), "rec_id long, field string, segment int, part int, text string, lang string, confidence double, counts_as string")


def field_languages(records: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """rec_id, field, lang, segments, confidence: each language of each field, once for repeated rec_ids."""
    state = records.sparkSession.sparkContext.broadcast(learn(records, labels, max_rows))
    own = _source(records).mapInArrow(_fields(state), "rec_id long, field string, lang string, segments long, confidence double")
    return own.groupBy("rec_id", "field", "lang").agg(F.sum("segments").alias("segments"), F.max("confidence").alias("confidence"))


def unlabelled_languages(records: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """rec_id, field, lang, confidence of the languages that the row's label doesn't name."""
    named = labels.select("rec_id", label_languages(F.col("rotulo")).alias("named"))
    found = field_languages(records, labels, max_rows).join(named, "rec_id", "left")
    return found.where(F.col("named").isNull() | ~F.array_contains("named", F.col("lang"))).select("rec_id", "field", "lang", "segments", "confidence")
