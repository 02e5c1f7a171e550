"""Ranking, coverage and diversity metrics of each author.

matched(author, rank, weight) are the ranked predictions with the weight of their gold tag (0: none);
gold(author, weight) is all gold. Every metric is one conditional aggregate over those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (5, 10, 20)
RELEVANT, VALID = 2, 1


def _gain(weight: Column, rank: Column) -> Column:
    return F.when(weight > 0, (F.pow(F.lit(2.0), weight) - 1) / F.log2(rank + 1)).otherwise(0.0)


def _cut(value: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, value).otherwise(F.lit(0.0)))


def ideal(gold: DataFrame, cuts=CUTS) -> DataFrame:
    """author, idcg@k of each cut, relevant. Only the best of an author's gold enters the ideal."""
    most = max(cuts)
    total = gold.groupBy("author").agg(F.count_if(F.col("weight") >= RELEVANT).alias("relevant"))
    top = gold.withColumn("rank", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("weight")))).where(F.col("rank") <= most)
    return total.join(top.groupBy("author").agg(*[_cut(_gain(F.col("weight"), F.col("rank")), F.col("rank"), k).alias(f"idcg_{k}") for k in cuts]), "author")


def ranking_metrics(matched: DataFrame, gold: DataFrame, cuts=CUTS) -> DataFrame:
    """author, ndcg_k, p_k, r_k, map_k, mv_k. P divides by k; R and MAP are 0 without relevant gold."""
    w = Window.partitionBy("author").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("weight") >= RELEVANT).cast("int")
    rows = matched.where(F.col("rank") <= max(cuts)).withColumn("hit", hit).withColumn("hits", F.sum("hit").over(w))
    rank = F.col("rank")
    own = rows.groupBy("author").agg(
        *[_cut(_gain(F.col("weight"), rank), rank, k).alias(f"dcg_{k}") for k in cuts],
        *[_cut(F.col("hit").cast("double"), rank, k).alias(f"hit_{k}") for k in cuts],
        *[_cut(F.col("hit") * F.col("hits") / rank, rank, k).alias(f"ap_{k}") for k in cuts],
        *[F.sum(F.when((rank <= k) & (F.col("weight") >= VALID), 1).otherwise(0)).alias(f"mv_{k}") for k in cuts],
    )
    x = own.join(ideal(gold, cuts), "author")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    cols = ["author"]
    for k in cuts:
        cols += [
            share(F.col(f"dcg_{k}"), F.col(f"idcg_{k}")).alias(f"ndcg_{k}"),
            (F.col(f"hit_{k}") / k).alias(f"p_{k}"),
            share(F.col(f"hit_{k}"), F.col("relevant")).alias(f"r_{k}"),
            share(F.col(f"ap_{k}"), F.col("relevant")).alias(f"map_{k}"),
            F.col(f"mv_{k}").cast("long").alias(f"mv_{k}"),
        ]
    return x.select(*cols)


def covered_exactly(documents: DataFrame, predictions: DataFrame) -> DataFrame:
    """author, doc_id, first_rank: the best rank of a prediction that is an n-gram of the document; null if none.

    documents(author, doc_id, ngramas), predictions(author, rank, tag)."""
    rows = documents.select("author", "doc_id", F.explode(F.array_distinct("ngramas")).alias("tag"))
    hit = rows.join(predictions.select("author", "rank", "tag"), ["author", "tag"]).groupBy("author", "doc_id").agg(F.min("rank").alias("first_rank"))
    return documents.select("author", "doc_id").distinct().join(hit, ["author", "doc_id"], "left")


def document_scores(exact: DataFrame, field_pairs: DataFrame, cuts=(10, 20)) -> DataFrame:
    """author, doc_id, score_k: +inf where covered exactly within k, else the greatest similarity of a
    prediction within k with a field of the document, -inf without any. The theta sweep filters these.

    field_pairs(author, doc_id, i, sim), i from 0; documents covered exactly at the least cut don't need theirs."""
    left = exact.where(F.col("first_rank").isNull() | (F.col("first_rank") > min(cuts))).select("author", "doc_id")
    sims = field_pairs.join(left, ["author", "doc_id"], "left_semi").groupBy("author", "doc_id").agg(*[F.max(F.when(F.col("i") < k, F.col("sim"))).alias(f"sim_{k}") for k in cuts])
    x = exact.join(sims, ["author", "doc_id"], "left")
    inf, none = F.lit(float("inf")), F.lit(float("-inf"))
    return x.select("author", "doc_id", *[F.when(F.col("first_rank") <= k, inf).otherwise(F.coalesce(f"sim_{k}", none)).alias(f"score_{k}") for k in cuts])


def coverage(scores: DataFrame, theta: float | Column, cuts=(10, 20), by: list[str] | None = None) -> DataFrame:
    """author, c_k: share of the documents with score >= theta; documents without n-grams count below."""
    t = F.lit(theta) if not isinstance(theta, Column) else theta
    return scores.groupBy(*(by or []), "author").agg(*[F.avg((F.col(f"score_{k}") >= t).cast("int")).alias(f"c_{k}") for k in cuts])


def diversity(predictions: DataFrame, cuts=(10, 20)) -> DataFrame:
    """author, d_k = 1 - mean similarity of distinct pairs among the first k; 0 for fewer than two.

    With n vectors the sum over pairs is |sum v|^2 - sum |v|^2, so one pass of sums over each dimension is
    enough and no pair is made. predictions(author, i, vector)."""
    dims = predictions.select("author", "i", F.posexplode("vector").alias("d", "x")).where(F.col("i") < max(cuts)).withColumn("x", F.col("x").cast("double"))
    sums = dims.groupBy("author", "d").agg(*[F.sum(F.when(F.col("i") < k, F.col("x")).otherwise(0.0)).alias(f"s_{k}") for k in cuts], *[F.sum(F.when(F.col("i") < k, F.col("x") * F.col("x")).otherwise(0.0)).alias(f"q_{k}") for k in cuts])
    size = predictions.groupBy("author").agg(*[F.count_if(F.col("i") < k).alias(f"n_{k}") for k in cuts])
    x = sums.groupBy("author").agg(*[F.sum(F.col(f"s_{k}") * F.col(f"s_{k}") - F.col(f"q_{k}")).alias(f"o_{k}") for k in cuts]).join(size, "author")
    return x.select("author", *[F.when(F.col(f"n_{k}") < 2, 0.0).otherwise(1 - F.col(f"o_{k}") / (F.col(f"n_{k}") * (F.col(f"n_{k}") - 1))).alias(f"d_{k}") for k in cuts])


def author_metrics(*parts: DataFrame) -> DataFrame:
    """All metrics of an author side by side; parts are keyed by author."""
    return reduce(lambda a, b: a.join(b, "author", "left"), parts).na.fill(0.0)


#: The columns of the file of metrics by author and what they hold.
FILE_COLUMNS = {
    "nDCG@10": "ndcg_10", "nDCG@20": "ndcg_20", "Precision@5": "p_5", "Precision@10": "p_10", "Precision@20": "p_20", "Recall@5": "r_5", "Recall@10": "r_10", "Recall@20": "r_20",
    "MAP@10": "map_10", "Coverage@10": "c_10", "Diversity@10": "d_10", "MAP@20": "map_20", "Coverage@20": "c_20", "Diversity@20": "d_20", "Match_Valido@10": "mv_10", "Match_Valido@20": "mv_20",
}


def author_table(ranking: DataFrame, covered: DataFrame, diverse: DataFrame, system: str) -> DataFrame:
    """Autor, the sixteen metrics and Modelo, in the order of the file. Coverage and diversity are 0 where an
    author has no documents or no two predictions."""
    m = author_metrics(ranking, covered, diverse)
    return m.select(F.concat(F.lit("ID_"), "author").alias("Autor"), *[F.col(c).alias(name) for name, c in FILE_COLUMNS.items()], F.lit(system).alias("Modelo"))


def macro(metrics: DataFrame) -> DataFrame:
    """One row: authors and the unweighted mean of every metric."""
    cols = [c for c in metrics.columns if c != "author"]
    return metrics.agg(F.count(F.lit(1)).alias("authors"), *[F.avg(c).alias(c) for c in cols])
