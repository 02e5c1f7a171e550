"""Splits that keep related records together: frontier breadth-first components.

Authors of one publication are tied. Adjacency lists are hash-partitioned by author; every author whose
hash is the least among its neighbours is a seed, and all seeds expand at the same time for a few hops.
Authors that no frontier reached are seeds of their own. Where two labels meet the smaller goes on, and an
edge between them goes into a smaller graph, which is worked off in the same way until no edge is left. All of it stays in
DataFrames; lineage is cut by reliable checkpoints.

Null arrays and entries that name no author tie nothing. Repeated rows change nothing. An author without
publications is its own group. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.frequency import author_key
from quillspark.session import cut

HOPS = 4
BUCKETS = 4096


def coauthor_edges(publications: DataFrame) -> DataFrame:
    """u, v: each author of a row tied to the row's first one, both ways, once (a star, not all pairs)."""
    keys = F.array_distinct(F.filter(F.transform("authors", author_key), lambda a: a.isNotNull()))
    star = publications.select(keys.alias("a")).where(F.size("a") > 1).select(F.col("a")[0].alias("u"), F.explode(F.slice(F.col("a"), F.lit(2), F.size("a"))).alias("v")).distinct()
    return star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _label(edges: DataFrame, level: int) -> DataFrame:
    """n, label: seeds and what their frontiers reach within HOPS; the rest label themselves.

    Where frontiers collide the smaller label goes on, so a seed may be overrun; nodes that got a new label
    are the next frontier. The order of labels is a hash that differs by level, or the seeds of one level
    would hardly be fewer at the next."""
    order = lambda c: F.struct(F.xxhash64(F.lit(level), c).alias("h"), F.col(c).alias("n"))
    nodes = edges.groupBy("u").agg(F.min(order("v")).alias("m"))
    seed = order("u") < F.col("m")
    state = nodes.select(F.col("u").alias("n"), F.when(seed, order("u")).alias("label"), seed.alias("front"))
    for _ in range(HOPS):
        reached = edges.join(state.where("front").select(F.col("n").alias("u"), "label"), "u").groupBy(F.col("v").alias("n")).agg(F.min("label").alias("new"))
        state = state.join(reached, "n", "left").select("n", F.least("label", "new").alias("label"), (F.col("new").isNotNull() & (F.col("label").isNull() | (F.col("new") < F.col("label")))).alias("front"))
    return state.select("n", F.coalesce("label.n", "n").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v), symmetric and distinct -> n, group_id: the least node, as string, of its component."""
    edges = cut(edges)
    levels = []
    while not edges.isEmpty():
        labels = cut(_label(edges, len(levels)))
        levels.append(labels)
        half = edges.join(labels.select(F.col("n").alias("u"), F.col("label").alias("lu")), "u").select("lu", "v").distinct()
        both = half.join(labels.select(F.col("n").alias("v"), F.col("label").alias("lv")), "v").where("lu <> lv")
        edges = cut(both.select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct())
    if not levels:
        return edges.select(F.col("u").alias("n"), F.col("u").alias("group_id"))
    nodes = levels[0]
    for nxt in levels[1:]:
        nodes = nodes.join(nxt.select(F.col("n").alias("label"), F.col("label").alias("up")), "label", "left").select("n", F.coalesce("up", "label").alias("label"))
    return nodes.join(nodes.groupBy("label").agg(F.min("n").alias("group_id")), "label").select("n", "group_id")


def author_groups(authors: DataFrame, publications: DataFrame, column: str = "author_id") -> DataFrame:
    """author_id, group_id of each distinct author that authors.column names."""
    wanted = authors.select(author_key(F.col(column)).alias("author_id")).where("author_id is not null").distinct()
    found = components(coauthor_edges(publications)).withColumnRenamed("n", "author_id")
    return wanted.join(found, "author_id", "left").select("author_id", F.coalesce("group_id", "author_id").alias("group_id"))


def split_groups(groups: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """author_id, group_id, split. Groups in the order of their hash fill train, then validation, then test.

    The order is kept as counts over BUCKETS ranges of the hash (the first 12 bits of a digest that other engines
    have too), a table of fixed size. A group larger than the smallest part would burst it, so such groups come
    first and go to train."""
    least = min(train, validation, 1 - train - validation)
    total = groups.select(F.count(F.lit(1))).scalar()
    sized = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    sized = sized.withColumn("b", F.when(F.col("n") > total * least, F.lit(-1)).otherwise(F.conv(F.left(F.md5("group_id"), F.lit(3)), 16, 10).cast("int")))
    counts = sized.groupBy("b").agg(F.sum("n").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("b")))  # at most BUCKETS + 1 rows
    middle = (F.col("upto") - F.col("n") / 2) / total
    named = upto.select("b", F.when((F.col("b") == -1) | (middle < train), "train").when(middle < train + validation, "validation").otherwise("test").alias("split"))
    return groups.join(sized.join(F.broadcast(named), "b").select("group_id", "split"), "group_id").select("author_id", "group_id", "split")


def audit(split: DataFrame, groups: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """One row: authors, groups that are parted, authors without a part, and whether each part has its share to
    within the largest group."""
    total = groups.select(F.count(F.lit(1))).scalar()
    parted = split.groupBy("group_id").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("parted"))
    largest = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    parts = split.agg(*[F.count_if(F.col("split") == k).alias(k) for k in ("train", "validation", "test")], F.count(F.lit(1)).alias("given"))
    room = F.coalesce(largest.select("n").scalar(), F.lit(0)) + total * 2.0 / BUCKETS + 1
    near = [F.abs(F.col(k) - total * share) <= room for k, share in (("train", train), ("validation", validation), ("test", 1 - train - validation))]
    return parts.select(total.alias("authors"), parted.select("parted").scalar().alias("parted"), (total - F.col("given")).alias("without"), (near[0] & near[1] & near[2]).alias("in_proportion"))
