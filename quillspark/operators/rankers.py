"""Rankings of tags for each author."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.ordering import numbered


def bag(profiles: DataFrame, author: str = "autor_id", grams: str = "ngramas") -> DataFrame:
    """author, ngram, freq of array profiles; counted map-side, so repeats never cross the shuffle."""
    a = X.author_id(F.col(author))
    return profiles.where(F.col(author).isNotNull()).select(a.alias("author"), F.explode(grams).alias("ngram")).where("author <> '' and ngram is not null").groupBy("author", "ngram").agg(F.count(F.lit(1)).alias("freq"))


def ranked(scores: DataFrame, score: str, most: int | None = None) -> DataFrame:
    """rank by score descending, then tag.

    With most only the first ranks, which Spark limits before the shuffle. The whole ranking of an author may
    be a third of all rows: it is numbered in buckets of one score and the first letters of the tag."""
    if most is not None:
        return scores.withColumn("rank", F.row_number().over(Window.partitionBy("author").orderBy(F.desc(score), "tag"))).where(F.col("rank") <= most)
    return numbered(scores, "rank", ["author"], {score: (F.col(score), True), "_letters": (F.left("tag", F.lit(2)), False)}, ["tag"])


def pop(counts: DataFrame, most: int | None = None) -> DataFrame:
    """author, rank, tag, freq."""
    return ranked(counts.withColumnRenamed("ngram", "tag"), "freq", most).select("author", "rank", "tag", "freq")


def authors_of(profiles: DataFrame, author: str = "autor_id") -> DataFrame:
    """author: each author of the profiles, those with empty profiles too."""
    return profiles.where(F.col(author).isNotNull()).select(X.author_id(F.col(author)).alias("author")).where("author <> ''").distinct()


def authors_total(profiles: DataFrame, author: str = "autor_id"):
    """Number of authors, those with empty profiles too, as a scalar subquery."""
    return profiles.where(F.col(author).isNotNull()).select(X.author_id(F.col(author)).alias("a")).where("a <> ''").agg(F.countDistinct("a")).scalar()


def idf(counts: DataFrame, total) -> DataFrame:
    """ngram, df, idf = log10(N / df), unsmoothed."""
    return counts.groupBy("ngram").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log10(total / F.col("df")))


def tfidf(counts: DataFrame, total, most: int | None = None) -> DataFrame:
    """author, rank, tag, score = (freq / greatest freq of the author) * idf.

    The join is on ngram and hash-partitioned: the vocabulary grows with the collection and is not broadcast."""
    greatest = counts.groupBy("author").agg(F.max("freq").alias("most"))
    rows = counts.join(idf(counts, total), "ngram", "left").join(greatest, "author")
    score = F.col("freq") / F.col("most") * F.coalesce("idf", F.lit(0.0))
    return ranked(rows.select("author", F.col("ngram").alias("tag"), F.round(score, 9).alias("score")), "score", most).select("author", "rank", "tag", "score")


def positional(lists: DataFrame, author: str = "author", tags: str = "tags") -> DataFrame:
    """author, rank, tag, score = length - position of the first mention; length counts repeats and blanks."""
    rows = lists.select(F.col(author).alias("author"), F.size(tags).alias("n"), F.posexplode(tags).alias("pos", "t")).withColumn("tag", X.normalize_tag(F.col("t"))).where("tag <> ''")
    first = rows.groupBy("author", "tag").agg(F.min("pos").alias("pos"), F.max("n").alias("n"))
    return ranked(first.select("author", "tag", (F.col("n") - F.col("pos")).alias("score")), "score").select("author", "rank", "tag", "score")


def as_lists(ranking: DataFrame, score: str, most: int | None = None, authors: DataFrame | None = None) -> DataFrame:
    """author, ranking array<struct<tag, score>> in rank order: the shape of the ranking files.

    most bounds the list; without it an author's whole ranking is one row, as in those files. authors: all that
    must come out, with an empty ranking where there is none."""
    if most is not None:
        ranking = ranking.where(F.col("rank") <= most)
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag", score))), lambda x: F.struct(x["tag"].alias("tag"), x[score].alias(score)))
    lists = ranking.groupBy("author").agg(items.alias("ranking"))
    if authors is None:
        return lists
    none = F.array().cast(lists.schema["ranking"].dataType)
    return authors.select("author").distinct().join(lists, "author", "left").select("author", F.coalesce("ranking", none).alias("ranking"))
