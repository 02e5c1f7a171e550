"""Threshold sweeps and comparisons of systems by area."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import matching, metrics
from quillspark.operators.ordering import carried, numbered

THETAS = (0.60, 0.65, 0.70, 0.75, 0.80)
TIE = 0.01


def _each(df: DataFrame, thetas) -> DataFrame:
    """A copy of each row for each theta: an explode of a literal list, no join."""
    return df.withColumn("theta", F.explode(F.array(*[F.lit(float(t)) for t in thetas])))


def sweep_matching(pairs: DataFrame, predictions: DataFrame, gold: DataFrame, thetas=THETAS) -> DataFrame:
    """theta and the macro means of the ranking metrics; matching is done anew for each theta, as a group."""
    near = _each(pairs, thetas).where((F.col("sim") >= F.col("theta")) & (F.col("sim") > 0))
    found = matching.greedy(near, None, ["theta", "author"]).join(gold.select("author", "j", "weight"), ["author", "j"])
    rows = _each(predictions.select("author", "i"), thetas).join(found, ["theta", "author", "i"], "left")
    # theta goes into the group key, and the metrics are those of one system for each key
    key = F.concat_ws("|", F.col("theta").cast("string"), "author")
    matched = rows.select(key.alias("author"), (F.col("i") + 1).alias("rank"), F.coalesce("weight", F.lit(0)).alias("weight"))
    own = metrics.ranking_metrics(matched, _each(gold.select("author", "weight"), thetas).select(key.alias("author"), "weight"))
    cols = [c for c in own.columns if c != "author"]
    return own.groupBy(F.substring_index("author", "|", 1).cast("double").alias("theta")).agg(F.count(F.lit(1)).alias("authors"), *[F.avg(c).alias(c) for c in cols])


def sweep_coverage(scores: DataFrame, thetas=THETAS, cuts=(10, 20)) -> DataFrame:
    """theta, authors, c_k: means over authors of one cached score table."""
    own = metrics.coverage(_each(scores, thetas), F.col("theta"), cuts, ["theta"])
    return own.groupBy("theta").agg(F.count(F.lit(1)).alias("authors"), *[F.avg(f"c_{k}").alias(f"c_{k}") for k in cuts])


def compare(a: DataFrame, b: DataFrame, areas: DataFrame, metric: str) -> DataFrame:
    """author, area, metric_a, metric_b, delta, outcome: authors of both systems with an area."""
    x = a.select("author", F.col(metric).alias(f"{metric}_a")).join(b.select("author", F.col(metric).alias(f"{metric}_b")), "author").join(areas.where("area is not null"), "author")
    delta = F.col(f"{metric}_a") - F.col(f"{metric}_b")
    return x.withColumn("delta", delta).withColumn("outcome", F.when(F.abs("delta") < TIE, "tie").when(F.col("delta") > 0, "win").otherwise("loss"))


def delta_order(compared: DataFrame, by: str = "author") -> DataFrame:
    """compared with place: from the greatest gain of the first system to its greatest loss, by name on ties.

    The order is over all rows, in buckets of a thousandth, so no task sorts them all."""
    return numbered(compared, "place", [], {"_step": (F.floor(F.col("delta") * 1000), True)}, [F.desc("delta"), by])


def top_areas(areas: DataFrame, k: int = 10) -> DataFrame:
    """area, authors of the k areas with most authors, by name on ties."""
    return areas.where("area is not null").groupBy("area").agg(F.countDistinct("author").alias("authors")).orderBy(F.desc("authors"), "area").limit(k)


def areas_of_at_least(areas: DataFrame, n: int = 10) -> DataFrame:
    return areas.where("area is not null").groupBy("area").agg(F.countDistinct("author").alias("authors")).where(F.col("authors") >= n)


def by_area(compared: DataFrame, metric: str, names=("a", "b")) -> DataFrame:
    """area, authors, means of both systems, delta, winner; a tie goes to the second."""
    x = compared.groupBy("area").agg(F.countDistinct("author").alias("authors"), F.avg(f"{metric}_a").alias("mean_a"), F.avg(f"{metric}_b").alias("mean_b"))
    return x.withColumn("delta", F.col("mean_a") - F.col("mean_b")).withColumn("winner", F.when(F.col("delta") > 0, names[0]).otherwise(names[1]))


def outcomes(compared: DataFrame) -> DataFrame:
    """area, win, tie, loss, total and their percentages; outcomes that don't occur are 0."""
    x = compared.groupBy("area").pivot("outcome", ["win", "tie", "loss"]).count().na.fill(0)
    x = x.withColumn("total", F.col("win") + F.col("tie") + F.col("loss"))
    return x.select("area", "win", "tie", "loss", "total", *[(100 * F.col(c) / F.col("total")).alias(f"{c}_pct") for c in ("win", "tie", "loss")])


def distribution(counts: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, least, 25/50/75/90/95 %, greatest. Exact percentiles, linear
    between ranks; their buffer holds one entry for each distinct value."""
    q = F.percentile(column, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9, 0.95)]))
    x = counts.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).alias("least"), F.max(column).alias("greatest"), q.alias("q"))
    return x.select("n", "mean", "sd", "least", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75, 90, 95))], "greatest")


def period(rows: DataFrame, by: str, year: str) -> DataFrame:
    """by, first and last year, span, rows with and without a year."""
    x = rows.groupBy(by).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count(year).alias("with_year"), F.count_if(F.col(year).isNull()).alias("without_year"))
    return x.withColumn("span", F.col("last_year") - F.col("first_year") + 1)


def best_system(means: DataFrame, systems: list[str]) -> DataFrame:
    """area, best, value over one column for each system; the first of the list wins ties."""
    top = F.greatest(*systems)
    return means.select("area", reduce(lambda c, s: c.when(F.col(s) == top, s), systems, F).alias("best"), top.alias("value"))


def last_known(points: DataFrame, at: DataFrame, step: str = "step", value: str = "value", width: int = 1 << 16) -> DataFrame:
    """As-of lookup: for each row of at the value of the last point at or before its step, by run.

    Points and requests are one sorted stream; no range join. A run is worked off in ranges of `width` steps,
    the last value of each going on to the next, so a run of any length is split over tasks."""
    both = points.select("run", step, value, F.lit(0).alias("asks")).unionByName(at.select("run", step, F.lit(None).cast("double").alias(value), F.lit(1).alias("asks")))
    out = carried(both, "last", F.col(value), ["run"], F.floor(F.col(step) / width), [step, "asks"])
    return out.where("asks = 1").select("run", step, F.col("last").alias(value))
