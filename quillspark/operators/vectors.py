"""Embeddings and similarities.

predictions(author, i, vector) and gold(author, j, vector, ...). The predictions of an author are few (top
k), so they are packed into one row of known size; gold rows then stream past them in a join on author that
Spark can split where one author is hot, and an Arrow-batched product gives the similarities. Nothing that
grows with an author is gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 20


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision, in the JVM: for single pairs; batches use similarities()."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalised(v: Column) -> Column:
    """Unit length, as float; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def vocabulary(*columns: DataFrame, ordered: bool = True) -> DataFrame:
    """text: distinct non-empty strings of one-column DataFrames, in code-point order."""
    rows = columns[0].toDF("text")
    for c in columns[1:]:
        rows = rows.unionAll(c.toDF("text"))
    rows = rows.where("text is not null and text <> ''").distinct()
    return rows.orderBy("text") if ordered else rows


class HashingEmbedder:
    """The offline default: signed buckets of words and character trigrams, unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                p = f" {w} "
                for g in {w, *(p[k : k + 3] for k in range(len(p) - 2))}:
                    h = int.from_bytes(hashlib.md5(g.encode("utf-8", "replace")).digest()[:4], "big")
                    out[i, h % self.size] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).astype(np.float32)


def embed(words: DataFrame, embedder=HashingEmbedder()) -> DataFrame:
    """text, emb of distinct strings. embedder: list of strings -> matrix, made ready once by each worker."""
    def run(batches):
        for b in batches:
            m = embedder(b.column(0).to_pylist())
            emb = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), emb], names=["text", "emb"])

    return words.select("text").mapInArrow(run, "text string, emb array<float>")


def lookup(rows: DataFrame, column: str, embeddings: DataFrame, size: int) -> DataFrame:
    """rows with vector: the string's embedding, zeros where there is none."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return rows.join(embeddings.select(F.col("text").alias(column), "emb"), column, "left").withColumn("vector", F.coalesce("emb", zero)).drop("emb")


def similarities(predictions: DataFrame, gold: DataFrame, keep: list[str], theta: float | None = None, top: int = TOP) -> DataFrame:
    """author, i, sim and the columns keep of gold, for each pair within an author; with theta only pairs of
    sim >= theta and sim > 0. The first `top` predictions of an author are taken, as by the metrics' greatest cut."""
    packed = predictions.where(F.col("i") < top).groupBy("author").agg(F.array_sort(F.collect_list(F.struct("i", "vector"))).alias("p"))
    rows = gold.select("author", "vector", *keep).join(packed, "author")
    rows = rows.select("author", "vector", F.transform("p", lambda x: x["i"]).alias("ii"), F.flatten(F.transform("p", lambda x: x["vector"])).alias("pv"), *keep)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            width = np.diff(b.column(1).offsets.to_numpy())
            g, ii, pv = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            n = np.diff(b.column(2).offsets.to_numpy())
            d = int(width[0])
            row = np.repeat(np.arange(b.num_rows), n)
            sim = np.einsum("ij,ij->i", pv.reshape(-1, d).astype(np.float64), g.reshape(-1, d).astype(np.float64)[row])
            at = np.flatnonzero((sim >= theta) & (sim > 0)) if theta is not None else np.arange(len(sim))
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(ii[at], pa.int32()), pa.array(sim[at]), *(b.column(4 + k).take(take) for k in range(len(keep)))], names=["author", "i", "sim", *keep])

    return rows.mapInArrow(run, "author string, i int, sim double, " + ", ".join(f"{k} {types[k]}" for k in keep))


def gold_order(gold: DataFrame) -> DataFrame:
    """j: the place of a gold tag by weight descending, then tag."""
    return gold.withColumn("j", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("weight"), "tag")) - 1)
