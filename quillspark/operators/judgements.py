"""Graded judgements: qrels(author, iter, tag, weight as text, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X

INTEGER = r"^\s*[+-]?\d+\s*$"


def parsed(qrels: DataFrame) -> DataFrame:
    """author, tag (normalised), tag_original, weight int, pos; rows whose weight is no integer are dropped."""
    w = F.when(F.col("weight").rlike(INTEGER), F.trim("weight").cast("int"))
    return qrels.select("author", X.normalize_tag(F.col("tag")).alias("tag"), X.strip(F.col("tag")).alias("tag_original"), w.alias("weight"), "pos").where("weight is not null and author is not null")


def gold(qrels: DataFrame, training: bool = False) -> DataFrame:
    """author, tag, weight, tag_original: of equal normalised tags the greatest weight and the first spelling.

    training: only weights 1, 2 and 3 and authors that are not blank; authors are stripped."""
    rows = parsed(qrels).where("tag <> ''").withColumn("author", X.author_id(F.col("author")))
    if training:
        rows = rows.where("weight in (1, 2, 3) and author <> ''")
    return rows.groupBy("author", "tag").agg(F.max("weight").alias("weight"), F.min_by("tag_original", "pos").alias("tag_original"))


def authors(qrels: DataFrame) -> DataFrame:
    """author: distinct, prefix and padding removed."""
    return qrels.where("author is not null").select(X.author_id(F.col("author")).alias("author")).where("author <> ''").distinct()


def author_keys(qrels: DataFrame) -> DataFrame:
    """author, key: the first spelling with which the author stands in the judgements."""
    a = qrels.where("author is not null").select(X.author_id(F.col("author"), True).alias("author"), X.strip(F.col("author")).alias("k"), "pos").where("author <> ''")
    return a.groupBy("author").agg(F.min_by("k", "pos").alias("key"))


def histogram(qrels: DataFrame) -> DataFrame:
    return parsed(qrels).groupBy("weight").agg(F.count(F.lit(1)).alias("n"))


def statistics(qrels: DataFrame) -> DataFrame:
    """One row: valid, invalid, distinct authors and tags."""
    ok = F.col("weight").rlike(INTEGER) & (X.normalize_tag(F.col("tag")) != "")
    return qrels.agg(
        F.count_if(ok).alias("valid"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"),
        F.countDistinct(F.when(ok, X.author_id(F.col("author")))).alias("authors"),
        F.countDistinct(F.when(ok, X.normalize_tag(F.col("tag")))).alias("tags"),
    )


def training_targets(gold_rows: DataFrame) -> DataFrame:
    """author, target_tags, target_tags_info, tags_relevancia_3/2/1, ordered by relevance, then tag."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("k"), F.col("tag"))))
    tags = lambda w=None: F.transform(F.filter("x", lambda y: y["k"] == -w) if w else F.col("x"), lambda y: y["tag"])
    info = F.transform("x", lambda y: F.struct(y["tag"].alias("tag"), (-y["k"]).alias("relevance")))
    x = gold_rows.groupBy("author").agg(items.alias("x"))
    return x.select("author", tags().alias("target_tags"), info.alias("target_tags_info"), *[tags(w).alias(f"tags_relevancia_{w}") for w in (3, 2, 1)])
