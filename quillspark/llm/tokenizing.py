"""Encoding of a corpus with a public byte-level BPE.

A text is split by the tokenizer's pattern and each piece merged by rank. Pieces longer than LEAF bytes
(text without any break) are encoded by tree concatenation: halves are encoded on their own, and around
each join a window of tokens is encoded again, growing until its first and last tokens are those that
stood there before. Byte-pair encodings are decided pairwise: a row of tokens is the encoding of its
bytes if each two neighbours encode to themselves, so agreement at both ends makes the join exact.

Null and empty texts give an empty list; white space and line ends are encoded as stored.
"""

from __future__ import annotations

import base64
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.session import spread

#: Folder of the public tokenizers' files; a parameter of every operator.
VOCABULARIES = os.environ.get("QUILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LEAF = 1 << 11
_RUN = LEAF // 4  # characters: a run under it has at most LEAF bytes
_READY: dict = {}


def encoding(folder: str = VOCABULARIES, name: str = BYTE_BPE_50K):
    """The encoding, read once by each worker."""
    key = (folder, name)
    if key not in _READY:
        import tiktoken

        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _READY[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _READY[key]


def _join(enc, left: list[int], right: list[int]) -> list[int]:
    k = 4
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        was = left[len(left) - a :] + right[:b]
        now = enc._encode_single_piece(b"".join(map(enc.decode_single_token_bytes, was)))
        if (a == len(left) or now[0] == was[0]) and (b == len(right) or now[-1] == was[-1]):
            return left[: len(left) - a] + now + right[b:]
        k *= 2


def encode_piece(enc, piece: bytes) -> list[int]:
    """One unsplit piece; long ones by halves, level by level, the leaves in parallel."""
    if not piece:
        return []
    if len(piece) <= LEAF:
        return enc._encode_single_piece(piece)
    n = 1 << ((len(piece) - 1) // LEAF).bit_length()
    at = [len(piece) * i // n for i in range(n + 1)]
    with ThreadPoolExecutor(2) as pool:
        parts = list(pool.map(enc._encode_single_piece, [piece[a:b] for a, b in zip(at, at[1:])]))
        while len(parts) > 1:
            parts = list(pool.map(lambda i: _join(enc, parts[i], parts[i + 1]), range(0, len(parts), 2)))
    return parts[0]


def _has_long_run(text: str) -> bool:
    """Whether a run of white space or of other characters may be a long piece."""
    sizes = list(map(len, text.split()))
    return max(sizes, default=0) >= _RUN or len(text) - sum(sizes) - len(sizes) >= _RUN - 1


def token_lengths(enc) -> np.ndarray:
    """Bytes of each token, by id."""
    key = ("lengths", id(enc))
    if key not in _READY:
        out = np.zeros(enc.n_vocab + 1, np.int64)
        for raw, i in enc._mergeable_ranks.items():
            out[i] = len(raw)
        _READY[key] = out
    return _READY[key]


def encode_text(enc, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) < _RUN or not _has_long_run(text):
        return enc.encode_ordinary(text)
    import regex

    out: list[int] = []
    for m in regex.finditer(PATTERN, text):
        out += encode_piece(enc, m.group().encode("utf-8", "replace"))
    return out


def _ids(folder, name):
    def run(batches):
        enc = encoding(folder, name)
        for batch in batches:
            ids, at = [], [0]
            for text in batch.column(1).to_pylist():
                x = encode_text(enc, text)
                ids.append(np.array(x, np.int32))
                at.append(at[-1] + len(x))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    return run


def _counts(folder, name):
    def run(batches):
        enc = encoding(folder, name)
        for batch in batches:
            n = [len(encode_text(enc, t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["doc_id", "n_tokens"])

    return run


def _decoded(folder, name):
    def run(batches):
        enc = encoding(folder, name)
        for batch in batches:
            texts = [enc.decode_bytes(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_corpus(encoded: DataFrame, folder: str = VOCABULARIES, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id, text of doc_id, ids: the way back; empty and null lists give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(folder, vocabulary), "doc_id long, text string")


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = VOCABULARIES, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id, ids array<int>: one row for each row of documents; its other columns are not read."""
    src = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return spread(src).mapInArrow(_ids(folder, vocabulary), "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = VOCABULARIES, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id, n_tokens: one row for each row of documents."""
    src = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return spread(src).mapInArrow(_counts(folder, vocabulary), "doc_id long, n_tokens int")
