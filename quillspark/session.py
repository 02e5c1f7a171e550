"""Session helpers: a local session for tests and benches, checkpoints, table reading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_ARROW_DEFAULT = "10000"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches for long texts, and this package on executors that lack it."""
    # texts run to tens of thousands of characters: Arrow batches stay small in memory, unless the session has its own size
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == _ARROW_DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set where it isn't yet.

    Where none is named a folder of this machine serves a local session (tests); a cluster's executors could
    not read it, so there it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="quillspark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint in the shared folder."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder, for files that a query writes and reads again."""
    return f"{_checkpoint_folder(spark)}/files-{uuid.uuid4()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a few small files would leave most of them idle.

    Call it on selected columns, before work that costs more than a shuffle of them. Tables that are read in
    at least half as many partitions as there are cores stay as they are, so at scale nothing moves. Rows that
    come out of a shuffle stay too: to ask for their partitions would run it."""
    if re.search(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() > cores else df.repartition(cores)
