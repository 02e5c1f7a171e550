"""Incremental counterparts for arriving rows.

Generation results are kept once for each author: every micro-batch goes through an anti-join on the table
of results, so a batch that is run again adds nothing. Counts of n-grams are kept by update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import generate


def generate_stream(prompts: DataFrame, path: str, checkpoint: str, config: generate.GenerationConfig = generate.GenerationConfig(), generator: generate.Generator = generate.echo_generator):
    """Starts a query that appends results of new authors to path."""
    def batch(df: DataFrame, _: int) -> None:
        generate.resume(df.dropDuplicates(["author"]), path, config, generator, partial=True)

    return prompts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window start, key, n with a watermark; the same expression serves tables and streams."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
