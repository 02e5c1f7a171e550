"""Cutting oversized texts at natural boundaries: a recursive separator hierarchy.

A text of more than `limit` tokens is split into its sections, a section that is too large into paragraphs, a
paragraph into sentences, a sentence into words, a word into characters. The parts that are left, the largest
that fit, are packed greedily in order: a piece takes parts until the next would burst it, or until a section
or paragraph ends that had to be split. The next begins at the widest natural boundary within the last
`overlap` tokens, nearer to the end where the next part needs the room.

Sizes are exact: a slice of an encoding at token boundaries is the encoding of that slice, but for white
space at its ends, which is encoded anew; where a piece is larger than counted it gives up its last part, then
its overlap, and a part that is too large by itself is split further.

Pieces cover the text: each begins where or before the last one ended. Texts within the limit, null and
empty ones give no rows. Repeated ids are cut each on their own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.tokenizing import BYTE_BPE_50K, VOCABULARIES, encode_text, encoding, token_counts, token_lengths
from quillspark.session import spread

CHARACTER, WORD, SENTENCE, PARAGRAPH, SECTION = range(5)
_SENTENCE = re.compile(r"(?<=[.!?;:…])(?:[\"'”’»)\]]*)\s+|\n|(?<=[。！？])")
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*|\n(?=(?:[-*+•] |\d{1,3}[.)] |\|))")
_SECTION = re.compile(r"\n+(?=#{1,6} |={2,6} ?\S|\\(?:sub)*section|[A-ZÀ-Ý][^\n.!?]{0,60}\n[ \t]*\n)|\n[-=*_]{3,}\n+")
_SCHEMA = "doc_id long, piece int, start_char int, end_char int, n_tokens int, level string, text string"
NAMES = ("character", "word", "sentence", "paragraph", "section", "end")


def _levels(text: str) -> np.ndarray:
    """For each character offset the strongest boundary before it."""
    level = np.zeros(len(text) + 1, np.int8)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13)) | (code == 0x85) | (code == 0xA0) | ((code >= 0x2000) & (code <= 0x200A)) | (code == 0x2028) | (code == 0x2029) | (code == 0x3000)
    # a word goes with the space before it, as its token does: both sides of a run of spaces are boundaries
    level[1:-1][space[1:] != space[:-1]] = WORD
    for kind, pattern in ((SENTENCE, _SENTENCE), (PARAGRAPH, _PARAGRAPH), (SECTION, _SECTION)):
        for m in pattern.finditer(text):
            at = m.end()
            level[at] = kind
            if kind == SENTENCE and at > m.start() and text[at - 1] == " ":
                level[at - 1] = kind
    return level


class _Sizes:
    """Token counts of slices of an encoded text at token boundaries.

    A slice has the tokens it had, but for a run of white space cut off at its end, which is one piece then,
    and for one that it begins inside of."""

    def __init__(self, enc, text: str, char: np.ndarray):
        self.enc, self.text, self.char = enc, text, char

    def __call__(self, s: int, e: int) -> int:
        a, b = int(self.char[s]), int(self.char[e])
        if a and self.text[a].isspace() and self.text[a - 1].isspace():
            return len(encode_text(self.enc, self.text[a:b]))
        if b == len(self.text):
            return e - s
        run = a + len(self.text[a:b].rstrip())
        if run == b:
            return e - s
        k = int(np.searchsorted(self.char, run))
        if run == a or self.char[k] != run or any("\x1c" <= c <= "\x1f" for c in self.text[run:b]):
            return len(encode_text(self.enc, self.text[a:b]))
        return k - s + len(encode_text(self.enc, self.text[run:b]))


def _parts(level: np.ndarray, s: int, e: int, room: int, kind: int = SECTION):
    """(end, closes) of the largest parts of at most `room` tokens that s..e is split into, level by level;
    closes: whether a section or paragraph ends there that had to be split."""
    if e - s <= room:
        yield e, False
        return
    cuts = s + 1 + np.flatnonzero(level[s + 1 : e] >= kind)
    if kind == CHARACTER:  # the lowest: as many characters as fit
        while e - s > room:
            k = int(np.searchsorted(cuts, s + room, "right")) - 1
            if k < 0 or cuts[k] <= s:
                break  # a character that has more tokens than there is room
            s = int(cuts[k])
            yield s, False
        yield e, False
        return
    for end in (*cuts.tolist(), e):
        for at, closes in _parts(level, s, end, room, kind - 1):
            yield at, closes or (at == end and end - s > room and kind >= PARAGRAPH)
        s = end


def split_text(enc, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, end, tokens, level of the end) of each piece, in characters."""
    ids = encode_text(enc, text)
    if len(ids) <= limit:
        return []
    width = token_lengths(enc)[np.array(ids)]
    ends = np.concatenate([[0], np.cumsum(width)])  # byte offset before each token
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    first = np.flatnonzero((raw & 0xC0) != 0x80)  # byte offset of each character
    char = np.searchsorted(first, ends)  # character offset, right where a token ends a character
    whole = np.append(first, len(raw))[np.minimum(char, len(first))] == ends
    level = np.where(whole, _levels(text)[np.minimum(char, len(text))], -1)
    n, sizes = len(ids), _Sizes(enc, text, char)
    parts, closes = map(list, zip(*_parts(level, 0, n, limit)))
    out, begin, i, room = [], 0, 0, limit
    while i < len(parts):
        start = parts[i - 1] if i else 0
        j = i
        while not closes[j] and j + 1 < len(parts) and parts[j + 1] - begin <= limit:
            j += 1
        size = sizes(begin, parts[j])
        while size > limit and j > i:
            j -= 1
            size = sizes(begin, parts[j])
        if size > limit:
            if begin < start:  # no room for an overlap
                begin = start
                continue
            room = max(1, min(room, parts[i] - start) * 3 // 4)
            finer = list(_parts(level, start, parts[i], room))
            if len(finer) < 2:
                raise ValueError(f"no boundary in {size} tokens")
            parts[i : i + 1], closes[i : i + 1] = [x for x, _ in finer], [c for _, c in finer[:-1]] + [closes[i]]
            continue
        end, room = parts[j], limit
        out.append((int(char[begin]), int(char[end]), size, NAMES[level[end]] if end < n else NAMES[-1]))
        i = j + 1
        if i < len(parts):
            low = max(begin + 1, end - overlap, parts[i] - limit)
            begin = end
            for kind in (PARAGRAPH, SENTENCE, WORD, CHARACTER) if overlap else ():
                hit = np.flatnonzero(level[low:end] >= kind)
                if len(hit):
                    begin = low + int(hit[0])
                    break
    return out


def _run(limit, overlap, folder, name):
    def run(batches):
        enc = encoding(folder, name)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and len(text.encode("utf-8", "replace")) > limit:  # a token is a byte or more
                    rows += [(doc, k, a, b, n, level, text[a:b]) for k, (a, b, n, level) in enumerate(split_text(enc, text, limit, overlap))]
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start_char", "end_char", "n_tokens", "level", "text"])

    return run


def split_oversized(documents: DataFrame, limit: int = 512, overlap: int = 64, id_column: str = "doc_id", text_column: str = "text", folder: str = VOCABULARIES, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id, piece, start_char, end_char, n_tokens, level, text of the pieces of each oversized text."""
    if not 0 <= overlap <= limit - 8:  # a character is at most 4 tokens, and each piece must go on
        raise ValueError("overlap must be at least 0 and at most limit - 8")
    src = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return spread(src).mapInArrow(_run(limit, overlap, folder, vocabulary), _SCHEMA)


def audit(pieces: DataFrame, documents: DataFrame, limit: int = 512) -> DataFrame:
    """One row of how many pieces or texts are wrong: pieces that are no slice of their text, gaps between pieces,
    texts not covered to their ends, pieces over the limit by a new encoding, oversized texts without pieces and
    pieces of texts that fit. doc_id must be unique."""
    n = F.length("whole")
    own = pieces.join(documents.select("doc_id", F.col("text").alias("whole")), "doc_id")
    last = F.lag("end_char").over(Window.partitionBy("doc_id").orderBy("piece"))
    rows = own.select("doc_id", "start_char", "end_char", F.substring("whole", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")).alias("slice"), F.col("text").alias("t"), n.alias("n"), last.alias("before"))
    told = rows.agg(F.count_if(F.col("slice") != F.col("t")).alias("no_slice"), F.count_if((F.col("start_char") > F.coalesce("before", F.lit(0))) | (F.col("end_char") <= F.coalesce("before", F.lit(0)))).alias("gaps"))
    ends = rows.groupBy("doc_id").agg((F.max("end_char") != F.max("n")).alias("cut"), (F.min("start_char") > 0).alias("late")).agg(F.count_if(F.col("cut") | F.col("late")).alias("uncovered"))
    fresh = token_counts(pieces.select(F.monotonically_increasing_id().alias("doc_id"), "text")).agg(F.count_if(F.col("n_tokens") > limit).alias("over"))
    large = token_counts(documents).where(F.col("n_tokens") > limit).select("doc_id")
    have = pieces.select("doc_id").distinct()
    count = lambda df: df.select(F.count(F.lit(1))).scalar()
    return told.select(
        "no_slice", "gaps", ends.select("uncovered").scalar().alias("uncovered"), fresh.select("over").scalar().alias("over_limit"),
        count(large.join(have, "doc_id", "left_anti")).alias("missing"), count(have.join(large, "doc_id", "left_anti")).alias("needless"),
    )
