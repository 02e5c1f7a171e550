"""Readers. Every reader gives pos, an explicit input order, where order has a meaning.

pos is monotonically increasing in file and line order; it is unique, not consecutive, and costs no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X

PUBLICATION = "id string, title string, keywords array<string>, abstract string, authors array<string>, year int, ISSN string, DOI string, areas array<struct<area:string,general_area:string,subarea:string>>"


def jsonl(spark: SparkSession, path: str, schema: str = PUBLICATION, strict: bool = False) -> DataFrame:
    """JSON lines. Blank and malformed lines and rows that are no objects are skipped, or fatal if strict.

    An explicit schema: inference would read everything twice."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where("trim(value) <> ''")
    st = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    rows = lines.select("pos", F.from_json("value", st, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    if strict:
        ok = F.when(~bad, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("boolean"))
        return rows.where(ok).select("pos", "r.*").drop("_corrupt_record")
    return rows.where(~bad).select("pos", "r.*").drop("_corrupt_record")


def line_counts(spark: SparkSession, path: str, schema: str = PUBLICATION) -> DataFrame:
    """One row: lines that are not blank, and those of them that jsonl() skips as invalid."""
    st = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    r = F.from_json("value", st, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).where("trim(value) <> ''").select(r.alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("invalid"))


def _opens_with(spark: SparkSession, path: str, sign: str) -> None:
    """The first character that is not blank, of the first lines only."""
    first = spark.read.text(path).where("trim(value) <> ''").select(F.left(F.ltrim("value"), F.lit(1)).alias("c")).first()
    if first is None or first.c != sign:
        raise ValueError(f"{path} doesn't begin with {sign}")


def json_array(spark: SparkSession, path: str, schema: str = PUBLICATION) -> DataFrame:
    """A file that is one JSON array of objects; anything else is an error. Items are read one after the other,
    so the array is never held as one value."""
    _opens_with(spark, path, "[")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.monotonically_increasing_id().alias("pos"), "*")


def json_map_lines(source: str, target: str, chunk: int = 1 << 20) -> int:
    """A file {key: value, ...} as JSON lines {"author": key, "value": value}; returns the number of lines.

    The file is read in chunks and one entry is held at a time: a map of any size becomes a file that Spark splits."""
    decode, told, n = json.JSONDecoder().raw_decode, "", 0

    with open(source, encoding="utf-8-sig") as f, open(target, "w", encoding="utf-8") as out:

        def token():
            """The next JSON value or sign; more is read until it is whole."""
            nonlocal told
            while True:
                told = told.lstrip()
                if told[:1] in ("{", "}", ":", ",") and told[:1] and not want_value:
                    sign, told = told[0], told[1:]
                    return sign
                try:
                    value, end = decode(told)
                    if end < len(told):
                        told = told[end:]
                        return value
                except ValueError:
                    pass
                more = f.read(chunk)
                if not more:
                    raise ValueError(f"{source} is no JSON object")
                told += more

        want_value = False
        if token() != "{":
            raise ValueError(f"{source} is no JSON object")
        while (key := token()) != "}":
            if key == ",":
                continue
            if not isinstance(key, str) or token() != ":":
                raise ValueError(f"{source} is no JSON object")
            want_value = True
            value = token()
            want_value = False
            out.write(json.dumps({"author": key, "value": value}, ensure_ascii=False) + "\n")
            n += 1
    return n


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """author, iter, tag, weight (text), pos of tab-separated lines with four fields or more."""
    p = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where(F.size(p) >= 4)
    return lines.select(p[0].alias("author"), p[1].try_cast("int").alias("iter"), p[2].alias("tag"), p[3].alias("weight"), "pos")


def qrels_by_pattern(spark: SparkSession, path: str) -> DataFrame:
    """Lines split at white space: author, integer, tag (may hold spaces), integer; valid says if they fit."""
    line = F.regexp_replace("value", "\x00", "")
    at = lambda k: F.regexp_extract(line, r"(?U)^\s*(\S+)\s+(-?\d+)\s+(.+?)\s+(-?\d+)\s*$", k)
    rows = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where("trim(value) <> ''")
    return rows.select(at(1).alias("author"), at(3).alias("tag"), at(4).try_cast("int").alias("weight"), (at(1) != "").alias("valid"), "pos")


# The keys under which an object has an id, or a list of ids, in the order in which they are looked for.
_ID_KEYS, _LIST_KEYS = ("author_id", "autor_id", "id", "author", "autor"), ("authors", "author_ids", "autores", "ids")


def _id_of(item, keys=_ID_KEYS) -> Column:
    """An item of a JSON list as id: a string or number, or the first key that an object has; null for others."""
    kind = F.schema_of_variant(item)
    of = F.coalesce(*[F.try_variant_get(item, f"$.{k}", "string") for k in keys])
    return F.when(kind.startswith("OBJECT"), of).when(kind.isin("STRING", "BIGINT") | kind.startswith("DECIMAL"), F.try_variant_get(item, "$", "string"))


def listed_ids(spark: SparkSession, path: str) -> DataFrame:
    """author of each item of a JSON list, list of objects, object with a list, or object keyed by id; repeats stay.

    Truth values, other lists and blanks are no ids."""
    v = spark.read.text(path, wholetext=True).select("value")
    lists = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), "array<variant>") for k in _LIST_KEYS])
    of_obj, keys = F.col("value").rlike(r"^\s*\{"), F.transform(F.json_object_keys("value"), lambda k: F.to_variant_object(F.struct(k.alias("id"))))
    ids = v.select(F.explode(F.when(of_obj, F.coalesce(lists, keys)).otherwise(F.from_json("value", "array<variant>"))).alias("item"))
    return ids.select(X.strip(_id_of(F.col("item"))).alias("author")).where("author <> ''")


def author_ids(spark: SparkSession, path: str, needed: bool = False) -> DataFrame:
    """author: distinct ids, as listed_ids; needed: none at all is an error."""
    found = listed_ids(spark, path).distinct()
    if needed and found.isEmpty():
        raise ValueError(f"no author id in {path}")
    return found


def id_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: total, distinct and repeated ids."""
    return listed_ids(spark, path).agg(F.count("author").alias("total"), F.countDistinct("author").alias("distinct"), (F.count("author") - F.countDistinct("author")).alias("repeated"))


# Fixed value: the same for lists of curricula.
_CURRICULUM_KEYS = ("Autor", "autor", "ID", "id", "author", "author_id")


def author_ids_anywhere(spark: SparkSession, path: str) -> DataFrame:
    """author: of a .json file the keys of its object or the items of its list, of others the first run of eight or
    more digits of each line."""
    if not path.lower().endswith(".json"):
        return spark.read.text(path).select(X.first_digits(F.col("value")).alias("author")).where("author is not null").distinct()
    v = spark.read.text(path, wholetext=True).select("value")
    keys = F.transform(F.json_object_keys("value"), lambda k: F.to_variant_object(F.struct(k.alias("id"))))
    items = v.select(F.explode(F.when(F.col("value").rlike(r"^\s*\{"), keys).otherwise(F.from_json("value", "array<variant>"))).alias("item"))
    return items.select(X.author_id(_id_of(F.col("item"), _CURRICULUM_KEYS)).alias("author")).where("author <> ''").distinct()


def json_map(spark: SparkSession, path: str, value: str = "array<string>") -> DataFrame:
    """author, value rows of a JSON object keyed by author; another shape is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>", {"mode": "FAILFAST"}).alias("m"))
    return whole.select(F.explode("m").alias("author", "value"))


STRUCTURED = "array<struct<titulo:string,keywords:string,abstract:string>>"


def structured_profiles(spark: SparkSession, path: str) -> DataFrame:
    """author, publicacoes of a .json file {author: [{...}]}, or of a folder of JSON lines; a profile that is no list of
    objects is an error."""
    if path.lower().endswith(".json"):
        rows = json_map(spark, path, STRUCTURED).withColumnRenamed("value", "publicacoes")
    else:
        rows = spark.read.schema(f"author string, publicacoes {STRUCTURED}").option("mode", "FAILFAST").json(path)
    bad = F.col("publicacoes").isNull() | F.exists("publicacoes", lambda p: p.isNull())
    ok = F.when(~bad, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid profile of author "), F.coalesce("author", F.lit("?")))).cast("boolean"))
    return rows.where(ok)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """What sinks.pairs wrote: similarity pairs or matches by author."""
    return spark.read.parquet(path)


def kept(spark: SparkSession, path: str, identity: str) -> DataFrame | None:
    """What sinks.keep wrote under this identity; None where nothing is kept or it belongs to another."""
    try:
        said = spark.read.text(f"{path}/identity").first()
        return spark.read.parquet(f"{path}/rows") if said and said.value == identity else None
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def documents_map(spark: SparkSession, path: str) -> DataFrame:
    """author, doc_id, ngramas of {author: {doc: [...]}}; a missing file gives no rows."""
    schema = "author string, doc_id string, ngramas array<string>"
    try:
        rows = json_map(spark, path, "map<string,array<string>>")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return rows.select("author", F.explode("value").alias("doc_id", "ngramas"))


def csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV with header; the separator is told from the first line, a byte order mark is dropped."""
    if sep is None:
        head = spark.read.text(path).first()
        line = head.value if head else ""
        sep = max(";,\t|", key=line.count)
    df = spark.read.csv(path, sep=sep, header=True)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


#: Fixed value: the order of the metric columns as data, where a file's header names them in another order.
METRICS_ORDER = ("MV@10", "MV@20", "MAP@20", "C@20", "D@20")


def metrics_csv(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """A metrics file; after: the column whose followers stand in METRICS_ORDER whatever the header says."""
    df = csv(spark, path, ";")
    if after and after in df.columns:
        k = df.columns.index(after) + 1
        df = df.toDF(*df.columns[:k], *METRICS_ORDER[: len(df.columns) - k])
    return df.select(df.columns[0], *[F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns[1:]])


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    """author, content of each .xml file; the id stands in the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return files.select(X.file_id(F.element_at(F.split("path", "/"), -1)).alias("author"), F.decode("content", "utf-8").alias("content"))


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publication table in the shape that the profile operators take; pos is rec_id."""
    return spark.read.parquet(f"{sf_dir}/filtered_documents.parquet").withColumn("pos", F.col("rec_id"))


def judgement_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgement table. It has no order of its own; pos orders by its content, the same on every run."""
    return spark.read.parquet(f"{sf_dir}/qrels.parquet").withColumn("pos", F.struct("tag", "weight"))
