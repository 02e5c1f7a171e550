"""Writers. Spark's committer makes a directory appear whole or not at all."""

from __future__ import annotations

import os
import stat
import tarfile
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _guard(path: str, inputs: tuple[str, ...]) -> None:
    if os.path.abspath(path) in {os.path.abspath(i) for i in inputs}:
        raise ValueError(f"{path} is an input")


def jsonl(df: DataFrame, path: str, inputs: tuple[str, ...] = ()) -> None:
    _guard(path, inputs)
    df.write.mode("overwrite").json(path)


def rankings(ranking: DataFrame, path: str, score: str, authors: DataFrame | None = None) -> None:
    """A line for each author: author and its list of {tag, score}; authors without a tag have an empty list."""
    from quillspark.operators.rankers import as_lists

    as_lists(ranking, score, authors=authors).write.mode("overwrite").json(path)


def keep(df: DataFrame, path: str, identity: str) -> None:
    """Rows under an identity, the hash of all that made them; readers.kept gives them to the same identity only.

    The identity is written last, so a run that breaks off keeps nothing."""
    spark = df.sparkSession
    spark.createDataFrame([("",)], "value string").write.mode("overwrite").text(f"{path}/identity")
    df.write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(identity,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/identity")


def pairs(df: DataFrame, path: str, by: str = "author") -> None:
    """Similarity pairs and matches as Parquet, clustered by author within files for pruning by statistics.

    A directory for each author would make as many files; the key is a sort order here."""
    df.sortWithinPartitions(by).write.mode("overwrite").parquet(path)


MARK = "\ufeff"  # byte order mark


def csv(df: DataFrame, path: str, sep: str = ";", formats: dict[str, str] | None = None, mark: bool = False) -> None:
    """CSV with header; formats: column -> printf format; mark: files begin with a byte order mark."""
    out = df.select(*[F.format_string(formats[c], F.col(f"`{c}`")).alias(c) if formats and c in formats else F.col(f"`{c}`") for c in df.columns])
    if mark:
        out = out.toDF(MARK + out.columns[0], *out.columns[1:])
    out.write.mode("overwrite").csv(path, sep=sep, header=True, emptyValue="")


def metrics_csv(metrics: DataFrame, path: str) -> None:
    """Four decimals for real metrics, integers as they are."""
    csv(metrics, path, formats={c: "%.4f" for c, t in metrics.dtypes if t == "double"})


def author_metrics(table: DataFrame, path: str) -> None:
    """The file of metrics by author: metrics.author_table, its 18 columns in their order, by author."""
    from quillspark.operators.metrics import FILE_COLUMNS

    out = table.select("Autor", *[F.col(f"`{c}`") for c in FILE_COLUMNS], "Modelo")
    metrics_csv(out.repartition(1).sortWithinPartitions("Autor"), path)  # a row an author: one file


# The columns of the sensitivity files and what they hold.
SENSITIVITY = {
    "theta_coverage": "θ_coverage", "theta_matching": "θ_matching", "relevant": "threshold_relevancia_P_R_MAP", "c_10": "C@10", "c_20": "C@20", "ndcg_10": "nDCG@10", "ndcg_20": "nDCG@20", "p_5": "P@5", "p_10": "P@10", "p_20": "P@20",
    "r_5": "R@5", "r_10": "R@10", "r_20": "R@20", "map_10": "MAP@10", "map_20": "MAP@20", "d_10": "D@10", "d_20": "D@20", "mv_10": "Match_Valido@10", "mv_20": "Match_Valido@20", "authors": "N",
}


def sensitivity(sweep: DataFrame, path: str) -> None:
    """A sweep over thresholds: the columns that it has, in the order of the file, one file with a byte order mark."""
    theta = next(c for c in ("theta_matching", "theta_coverage", "theta") if c in sweep.columns)
    out = sweep.orderBy(theta).withColumnRenamed("theta", "theta_matching")
    csv(out.select(*[F.col(c).alias(name) for c, name in SENSITIVITY.items() if c in out.columns]).coalesce(1), path, ",", mark=True)


def splits(records: DataFrame, split: DataFrame, path: str) -> None:
    """One directory of JSON lines for each part, by author, and the ids of the test part with a byte order mark."""
    both = records.join(split, "author")
    for part in ("train", "validation", "test"):
        both.where(F.col("split") == part).drop("split").orderBy("author").write.mode("overwrite").json(f"{path}/{part}")
    ids = split.where("split = 'test'").select(F.col("author").alias("author_id"))
    csv(ids.orderBy("author_id").coalesce(1), f"{path}/test_ids", ",", mark=True)


def safe_target(folder: str | Path, member: str) -> Path:
    """Where a member of an archive may be written; absolute, drive and upward paths are refused."""
    name = PurePosixPath(member.replace("\\", "/"))
    if name.is_absolute() or ".." in name.parts or (name.parts and name.parts[0][1:2] == ":"):
        raise ValueError(f"unsafe path in the archive: {member!r}")
    return Path(folder).joinpath(*name.parts)


def extract(archive: str | Path, folder: str | Path) -> list[Path]:
    """Unpacks a ZIP or TAR file after all members are seen to be safe; links and devices are refused."""
    out = []
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for m in z.infolist():
                if stat.S_ISLNK(m.external_attr >> 16):
                    raise ValueError(f"link in the archive: {m.filename!r}")
                out.append(safe_target(folder, m.filename))
            z.extractall(folder)
        return out
    if tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            for m in t.getmembers():
                if not (m.isfile() or m.isdir()):
                    raise ValueError(f"neither file nor folder: {m.name!r}")
                out.append(safe_target(folder, m.name))
            t.extractall(folder, filter="data")
        return out
    raise ValueError(f"neither ZIP nor TAR: {archive}")
