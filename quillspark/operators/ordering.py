"""Numbers and carried values in an order, for keys that may hold a third of all rows.

A window over such a key sorts all its rows in one task. Here the order is cut into buckets: the window runs
inside a bucket, and what goes on from one bucket to the next (a count, a last value) is one row a bucket,
summed up over the key in a second, small window. Buckets must follow the order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def _renamed(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def _same(keys: list[str]) -> Column:
    """Equal keys, nulls too, of rows and of what was counted over _renamed keys."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])


def numbered(rows: DataFrame, name: str, by: list[str], buckets: dict[str, tuple[Column, bool]], order: list[Column | str]) -> DataFrame:
    """rows with the row number from 1 of each key: by the buckets (column, descending), inside them by order."""
    x = rows.withColumns({k: c for k, (c, _) in buckets.items()})
    key = [*by, *buckets]
    x = x.repartition(*[F.col(k) for k in key])
    down = [F.desc(k) if desc else F.asc(k) for k, (_, desc) in buckets.items()]
    first = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(*down).rowsBetween(*_BEFORE)), F.lit(0))
    sizes = x.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(*_renamed(key), first.alias("_first"))
    inside = x.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return inside.join(sizes, _same(key)).select(*[c for c in x.columns if c in rows.columns], (F.col("_first") + F.col("_place")).cast("int").alias(name))


def carried(rows: DataFrame, name: str, value: Column, by: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """rows with the last value that is not null at or before each row of its key."""
    x = rows.withColumns({"_b": bucket, "_v": value})
    key = [*by, "_b"]
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = x.groupBy(*key).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    earlier = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_b").rowsBetween(*_BEFORE))
    ends = ends.select(*_renamed(key), earlier.alias("_earlier"))
    return x.withColumn("_in", inside).join(ends, _same(key)).select(*rows.columns, F.coalesce("_in", "_earlier").alias(name))
