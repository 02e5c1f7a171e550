"""Greedy one-to-one matching of predictions with gold tags, and its audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.vectors import TOP


def greedy(pairs: DataFrame, theta: float, by: list[str] | None = None, top: int = TOP) -> DataFrame:
    """pairs(author, i, j, sim) -> author, i, j, sim: pairs in the order (-sim, i, j), both sides free, sim >= theta and > 0.

    Of `top` predictions an author has, one can only lose gold tags to top - 1 others, so its best `top` pairs
    decide; that bounds the array that is folded, however much gold an author has."""
    by = by or ["author"]
    near = pairs.where((F.col("sim") >= theta) & (F.col("sim") > 0)) if theta is not None else pairs
    best = near.withColumn("r", F.row_number().over(Window.partitionBy(*by, "i").orderBy(F.desc("sim"), "j"))).where(F.col("r") <= top)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("k"), "i", "j")))
    empty = F.expr("named_struct('pi', cast(array() as array<int>), 'gj', cast(array() as array<int>), 'm', cast(array() as array<struct<i:int,j:int,sim:double>>))")
    fold = F.aggregate(
        "x",
        empty,
        lambda a, p: F.when(F.array_contains(a["pi"], p["i"]) | F.array_contains(a["gj"], p["j"]), a).otherwise(
            F.struct(F.array_append(a["pi"], p["i"]).alias("pi"), F.array_append(a["gj"], p["j"]).alias("gj"), F.array_append(a["m"], F.struct(p["i"].alias("i"), p["j"].alias("j"), (-p["k"]).alias("sim"))).alias("m"))
        ),
    )
    return best.groupBy(*by).agg(ordered.alias("x")).select(*by, F.explode(fold["m"]).alias("m")).select(*by, "m.i", "m.j", "m.sim")


def ranked_matches(predictions: DataFrame, matches: DataFrame, gold: DataFrame) -> DataFrame:
    """author, rank, j, sim, weight of every prediction; unmatched ones have j -1 and weight 0."""
    w = matches.join(gold.select("author", "j", "weight"), ["author", "j"])
    return predictions.select("author", "i").join(w, ["author", "i"], "left").select("author", (F.col("i") + 1).alias("rank"), F.coalesce("j", F.lit(-1)).alias("j"), "sim", F.coalesce("weight", F.lit(0)).alias("weight"))


def audit(predictions: DataFrame, best: DataFrame, matches: DataFrame, gold: DataFrame, system: str, top: int = TOP) -> DataFrame:
    """The audit table: always `top` rows an author, blank where there is no prediction.

    predictions(author, i, tag), best(author, i, j, sim): the nearest gold tag of each prediction."""
    names = gold.select("author", "j", F.col("tag").alias("gold"), "weight")
    hit = matches.join(names, ["author", "j"]).select("author", "i", F.col("gold").alias("mg"), F.col("sim").alias("ms"), "weight")
    near = best.join(names.drop("weight"), ["author", "j"]).select("author", "i", F.col("gold").alias("bg"), F.col("sim").alias("bs"))
    slots = predictions.select("author").distinct().select("author", F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("i"))
    rows = slots.join(predictions.select("author", "i", "tag"), ["author", "i"], "left").join(hit, ["author", "i"], "left").join(near, ["author", "i"], "left")
    there, matched = F.col("tag").isNotNull(), F.col("mg").isNotNull()
    return rows.select(
        F.concat(F.lit("ID_"), "author").alias("Autor"),
        (F.col("i") + 1).alias("Rank"),
        F.coalesce("tag", F.lit("")).alias("Tag_Predita"),
        F.when(matched, F.col("mg")).when(there & F.col("bg").isNotNull(), F.concat("bg", F.lit(" (rej)"))).otherwise("").alias("Melhor_Match_Gabarito"),
        F.round(F.coalesce("ms", "bs"), 3).alias("Similaridade"),
        F.when(there, F.coalesce("weight", F.lit(0))).alias("Peso"),
        F.when(matched, "match").when(there, "sem match válido").otherwise("").alias("Match_Status"),
        F.lit(system).alias("Modelo"),
    )


def nearest(pairs: DataFrame) -> DataFrame:
    """The gold tag of greatest similarity of each prediction, the least j on ties."""
    r = F.row_number().over(Window.partitionBy("author", "i").orderBy(F.desc("sim"), "j"))
    return pairs.withColumn("r", r).where("r = 1").drop("r")
