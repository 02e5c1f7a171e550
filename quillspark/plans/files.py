"""Queries over the file forms: tables are written as the files that readers, writers and jobs take, and read again.

Files go to the shared folder (session.scratch). What a file form holds as one value (an object keyed by
author) is made of the judged tags, which humans gave and no author has many of.
"""

from __future__ import annotations

import contextlib
import io
from argparse import Namespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import jobs
from quillspark.functions import text as X
from quillspark.functions.parsing import finetuned_tags
from quillspark.operators import dataset, generate, judgements, metrics, profiles, rankers
from quillspark.plans import registry as R
from quillspark.plans.registry import query
from quillspark.session import scratch, table
from quillspark.sources import readers, sinks


def _run(job, spark: SparkSession, **options):
    """A job with what it prints left out."""
    with contextlib.redirect_stdout(io.StringIO()):
        return job(spark, Namespace(**options))


def _object(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: a JSON object of all rows."""
    entry = F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), F.to_json(value))
    return df.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("value"))


def _publication_json(spark, d) -> DataFrame:
    p = table(spark, d, "filtered_documents")
    row = F.struct("id", "title", "keywords", "abstract", "authors", F.col("pub_year").alias("year"), F.col("issn").alias("ISSN"), F.col("doi").alias("DOI"), "areas")
    return p.select("rec_id", F.to_json(row).alias("value"))


def _lines(spark, d) -> str:
    """Publications as JSON lines, with a line after each that is malformed, blank or no object."""
    wrong = F.element_at(F.array(F.lit("not json"), F.lit("  "), F.lit('["list"]')), (F.col("rec_id") % 3 + 1).cast("int"))
    path = scratch(spark)
    _publication_json(spark, d).select(F.explode(F.array("value", wrong)).alias("value")).write.text(path)
    return path


def _arrays(spark, d) -> str:
    """Publications as files that are JSON arrays, some two thousand in each."""
    path = scratch(spark)
    rows = _publication_json(spark, d).groupBy(F.floor(F.col("rec_id") / 2048).alias("g")).agg(F.collect_list("value").alias("x"))
    rows.select("g", F.concat(F.lit("["), F.array_join("x", ",\n"), F.lit("]")).alias("value")).write.partitionBy("g").text(path)
    return path + "/g=*"


def _tsv(spark, d) -> str:
    """Judgements as tab-separated lines in the order of the table, with a short line after each."""
    path = scratch(spark)
    q = table(spark, d, "qrels")
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("author", "iter", "tag", "weight")])
    q.select(F.explode(F.array(line, F.lit("short\tline"))).alias("value")).coalesce(1).write.text(path)
    return path


def _judged_json(spark, d) -> str:
    path = scratch(spark) + "/ids.json"
    R._judged(spark, d).agg(F.to_json(F.array_sort(F.collect_list("author"))).alias("value")).coalesce(1).write.text(path)
    return path


_PUB = "SELECT id, title, array_to_string(keywords, ' | ') AS keywords, abstract, array_to_string(authors, ' | ') AS authors, pub_year AS year, issn AS \"ISSN\", doi AS \"DOI\", array_to_string(list_transform(areas, lambda z: z.area), ' | ') AS areas FROM filtered_documents"


def _read(p: DataFrame) -> DataFrame:
    return R._joined(p.select("id", "title", "keywords", "abstract", "authors", "year", "ISSN", "DOI", F.transform("areas", lambda z: z["area"]).alias("areas")))


@query(_PUB)
def jsonl_scan(spark, d):
    """What is invalid between the lines is skipped."""
    return _read(readers.jsonl(spark, _lines(spark, d)))


@query("SELECT count(*) + count(*) FILTER (rec_id % 3 <> 1) AS lines, count(*) FILTER (rec_id % 3 <> 1) AS invalid FROM filtered_documents")
def jsonl_line_counts(spark, d):
    return readers.line_counts(spark, _lines(spark, d))


@query(_PUB)
def jsonl_strict(spark, d):
    """Written by the writer, read strictly."""
    path = scratch(spark)
    p = table(spark, d, "filtered_documents")
    sinks.jsonl(p.select("id", "title", "keywords", "abstract", "authors", F.col("pub_year").alias("year"), F.col("issn").alias("ISSN"), F.col("doi").alias("DOI"), "areas"), path)
    return _read(readers.jsonl(spark, path, strict=True))


@query(_PUB)
def json_array_scan(spark, d):
    return _read(readers.json_array(spark, _arrays(spark, d)))


@query(f"WITH {R._SET} SELECT shape, author FROM target, (SELECT unnest(['anywhere', 'keys', 'list', 'nested', 'objects']) AS shape)")
def author_id_files(spark, d):
    """The judged authors in each shape of file."""
    a = R._judged(spark, d).agg(F.array_sort(F.collect_list("author")).alias("x"))
    shapes = {
        "list": F.to_json("x"),
        "objects": F.to_json(F.transform("x", lambda z: F.struct(z.alias("autor_id")))),
        "nested": F.to_json(F.struct(F.col("x").alias("autores"))),
        "keys": F.to_json(F.map_from_arrays("x", F.transform("x", lambda z: F.lit(1)))),
        "anywhere": F.to_json(F.transform("x", lambda z: F.struct(F.concat(F.lit("ID_"), z).alias("Autor")))),
    }
    out = None
    for shape, value in shapes.items():
        path = scratch(spark) + "/ids.json"
        a.select(value.alias("value")).coalesce(1).write.text(path)
        found = (readers.author_ids_anywhere if shape == "anywhere" else readers.author_ids)(spark, path).select(F.lit(shape).alias("shape"), "author")
        out = found if out is None else out.unionAll(found)
    return out


@query(f"WITH {R._SET}, n AS (SELECT count(*) AS n FROM target) SELECT 2 * n AS total, n AS \"distinct\", n AS repeated FROM n")
def id_counts(spark, d):
    path = scratch(spark) + "/ids.json"
    R._judged(spark, d).agg(F.to_json(F.concat(F.collect_list("author"), F.collect_list("author"))).alias("value")).coalesce(1).write.text(path)
    return readers.id_counts(spark, path)


@query(f"""WITH q AS (SELECT *, row_number() OVER () AS pos FROM qrels), p AS (SELECT {R._author("coalesce(author, '')")} AS author, {R._collapse('tag')} AS tag, {R._strip("coalesce(tag, '')")} AS spelling, CAST(trim(weight) AS INT) AS weight, pos FROM q WHERE regexp_full_match(coalesce(weight, ''), '\\s*[+-]?\\d+\\s*'))
SELECT author, tag, max(weight) AS weight, arg_min(spelling, pos) AS tag_original FROM p WHERE tag <> '' GROUP BY ALL""")
def qrels_file_order(spark, d):
    """Of equal tags the first spelling in the order of the file."""
    return judgements.gold(readers.qrels(spark, _tsv(spark, d)))


_LINE = "coalesce(author, '') || chr(9) || iter || chr(9) || coalesce(tag, '') || chr(9) || coalesce(weight, '')"
_PATTERN = f"^{R.WS}*([^{R.WS[1:-1]}]+){R.WS}+(-?\\d+){R.WS}+(.+?){R.WS}+(-?\\d+){R.WS}*$"


@query(f"""WITH l AS (SELECT {_LINE} AS l FROM qrels UNION ALL SELECT 'short' || chr(9) || 'line' FROM qrels), r AS (SELECT regexp_extract(l, '{_PATTERN}', ['a', 'i', 't', 'w']) AS m FROM l)
SELECT m.a AS author, m.t AS tag, TRY_CAST(m.w AS INT) AS weight, m.a <> '' AS valid, count(*) AS n FROM r GROUP BY ALL""")
def qrels_pattern_scan(spark, d):
    return readers.qrels_by_pattern(spark, _tsv(spark, d)).groupBy("author", "tag", "weight", "valid").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {R._GOLD} SELECT author, string_agg(tag, ' | ' ORDER BY tag) AS value FROM gold GROUP BY author")
def json_map_scan(spark, d):
    path = scratch(spark)
    g = R.qrels_gold(spark, d).groupBy("author").agg(F.array_sort(F.collect_list("tag")).alias("v"))
    _object(g, "author", "v").coalesce(1).write.text(path)
    return R._joined(readers.json_map(spark, path))


@query(f"WITH {R._GOLD} SELECT author, tag AS doc_id, tag || ' | ' || weight AS ngramas FROM gold")
def documents_map_scan(spark, d):
    path = scratch(spark)
    g = R.qrels_gold(spark, d).groupBy("author").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.array("tag", F.col("weight").cast("string"))))).alias("v"))
    _object(g, "author", "v").coalesce(1).write.text(path)
    return R._joined(readers.documents_map(spark, path))


@query(f"WITH {R._GOLD} SELECT author, tag, CAST(weight AS VARCHAR) AS weight FROM gold")
def csv_scan(spark, d):
    """Written with semicolons and a byte order mark; the reader finds both out."""
    path = scratch(spark)
    sinks.csv(R.qrels_gold(spark, d).select("author", "tag", F.col("weight").cast("string").alias("weight")), path, mark=True)
    return readers.csv(spark, path)


@query(R.ORACLE_SQL["similarity_pairs"])
def pair_files(spark, d):
    """Pairs as files, and kept under an identity that alone gives them back."""
    path = scratch(spark)
    sinks.pairs(R._pairs(spark, d), path)
    sinks.keep(readers.pairs(spark, path), path + "-kept", "a")
    if readers.kept(spark, path + "-kept", "b") is not None:
        raise ValueError("rows of another identity")
    return readers.kept(spark, path + "-kept", "a").withColumn("sim", F.round("sim", 6))


def _printed(c):
    return f'CAST(CAST(CAST("{c}" AS DECIMAL(18, 5)) AS DECIMAL(18, 4)) AS DOUBLE) AS "{c}"' if not c.startswith("Match") else f'CAST("{c}" AS DOUBLE) AS "{c}"'


@query("SELECT " + ", ".join(['"Autor"', '"Modelo"', *map(_printed, metrics.FILE_COLUMNS)]) + f" FROM ({R.ORACLE_SQL['author_metrics_file']})")
def metrics_file_scan(spark, d):
    """The file of metrics with its four decimals, read again."""
    path = scratch(spark)
    sinks.author_metrics(R.author_metrics_file(spark, d), path)
    m = readers.csv(spark, path)
    return m.select("Autor", "Modelo", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in metrics.FILE_COLUMNS])


_SWEPT = [c for c in sinks.SENSITIVITY if c.startswith(("ndcg", "p_", "r_", "map", "mv"))]


@query(f"SELECT theta, authors, {', '.join(_SWEPT)} FROM ({R.ORACLE_SQL['theta_sweep_matching']})")
def sensitivity_file(spark, d):
    """A sweep written in the order of the file and read again."""
    path = scratch(spark)
    sinks.sensitivity(R.theta_sweep_matching(spark, d), path)
    m = readers.csv(spark, path)
    return m.toDF("theta", *m.columns[1:]).select(F.col("theta").cast("double"), F.col("N").cast("long").alias("authors"), *[F.col(f"`{sinks.SENSITIVITY[c]}`").cast("double").alias(c) for c in _SWEPT])


# jobs ---------------------------------------------------------------------------------------------------


@query(f"SELECT id, count(*) AS n FROM ({R.ORACLE_SQL['author_semi_join']}) GROUP BY id")
def job_filter(spark, d):
    path = scratch(spark)
    _run(jobs.filter_documents, spark, documents=_lines(spark, d), authors=_judged_json(spark, d), output=path)
    return spark.read.schema(readers.PUBLICATION).json(path).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(R.ORACLE_SQL["filter_report"].replace("(SELECT count(*) FROM filtered_documents) AS lines, CAST(0 AS BIGINT) AS invalid", "(SELECT count(*) + count(*) FILTER (rec_id % 3 <> 1) FROM filtered_documents) AS lines, (SELECT count(*) FILTER (rec_id % 3 <> 1) FROM filtered_documents) AS invalid"))
def job_filter_report(spark, d):
    return R._joined(_run(jobs.filter_report, spark, documents=_lines(spark, d), authors=_judged_json(spark, d)))


@query(f"SELECT author, n_publicacoes FROM ({R.ORACLE_SQL['labelled_text_profile']})")
def job_profiles_ft(spark, d):
    path = scratch(spark)
    _run(jobs.profiles_ft, spark, documents=_arrays(spark, d), authors=_judged_json(spark, d), output=path)
    return spark.read.schema("author string, n_publicacoes int, publicacoes_textuais array<string>").json(path).select("author", "n_publicacoes")


@query(R.ORACLE_SQL["ngram_profile"])
def job_ngram_profiles(spark, d):
    path = scratch(spark)
    _run(jobs.profiles_baseline, spark, documents=_lines(spark, d), qrels=_tsv_judged(spark, d), output=path, mode="authors")
    return spark.read.schema("author string, ngram string, freq long").json(f"{path}/authors")


@query(f"""WITH {R._AUTHORED}, {R._SET}, n AS ({R.ORACLE_SQL['ngram_by_document']}) SELECT author, n.id AS doc_id, count(*) AS documents, CAST(sum(n_ngrams) AS BIGINT) AS n_ngrams FROM n JOIN (SELECT pos, author FROM ex JOIN target USING (author)) a USING (pos) GROUP BY ALL""")
def job_ngram_documents(spark, d):
    path = scratch(spark)
    _run(jobs.profiles_baseline, spark, documents=_lines(spark, d), qrels=_tsv_judged(spark, d), output=path, mode="documents")
    rows = spark.read.schema("author string, doc_id string, ngramas array<string>").json(f"{path}/documents")
    return rows.groupBy("author", "doc_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("ngramas")).alias("n_ngrams"))


def _tsv_judged(spark, d) -> str:
    """Judgements without the rows whose author is null: a file knows only blanks."""
    path = scratch(spark)
    q = table(spark, d, "qrels").where("author is not null")
    q.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("author", "iter", "tag", "weight")]).alias("value")).coalesce(1).write.text(path)
    return path


@query(f"SELECT author, count(*) AS n FROM ({R.ORACLE_SQL['structured_profile']}) GROUP BY author")
def job_profiles_structured(spark, d):
    path = scratch(spark)
    _run(jobs.profiles_structured, spark, documents=_lines(spark, d), qrels=_tsv_judged(spark, d), output=path)
    return readers.structured_profiles(spark, path).select("author", F.size("publicacoes").cast("long").alias("n"))


@query(f"SELECT author, count(*) AS n FROM ({R.ORACLE_SQL['field_evidence']}) GROUP BY author")
def job_document_evidence(spark, d):
    path = scratch(spark)
    _run(jobs.document_evidence, spark, documents=_lines(spark, d), qrels=_tsv_judged(spark, d), output=path)
    return spark.read.schema("author string, doc_id string, pieces array<string>").json(path).groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def _tag_map(spark, d) -> str:
    path = scratch(spark)
    g = R.qrels_gold(spark, d).groupBy("author").agg(F.array_sort(F.collect_list("tag")).alias("v"))
    _object(g, "author", "v").coalesce(1).write.text(path)
    return path


def _told(spark, path, kind):
    lists = spark.read.schema(f"author string, ranking array<struct<tag:string,{kind}>>").json(path)
    return lists.select("author", F.posexplode("ranking").alias("rank", "x")).select("author", (F.col("rank") + 1).alias("rank"), "x.*")


@query(f"WITH {R._GOLD} SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY tag) AS INT) AS rank, tag, CAST(1 AS BIGINT) AS freq FROM gold WHERE author <> ''")
def job_pop(spark, d):
    path = scratch(spark)
    _run(jobs.pop, spark, profiles=_tag_map(spark, d), output=path, keep_empty=True)
    return _told(spark, path, "freq:long")


@query(f"""WITH {R._GOLD}, g AS (SELECT author, tag FROM gold WHERE author <> ''), s AS (SELECT author, tag, round(log10((SELECT count(DISTINCT author) FROM g) / count(*) OVER (PARTITION BY tag)), 9) AS score FROM g)
SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY score DESC, tag) AS INT) AS rank, tag, score FROM s""")
def job_tfidf(spark, d):
    path = scratch(spark)
    _run(jobs.tfidf, spark, profiles=_tag_map(spark, d), output=path, keep_empty=True)
    return _told(spark, path, "score:double")


@query(R.ORACLE_SQL["supervised_records"])
def job_dataset(spark, d):
    """The three parts together; each author stands in one."""
    path = scratch(spark)
    _run(jobs.supervised, spark, documents=_lines(spark, d), qrels=_tsv_judged(spark, d), output=path, seed=42, max_publications=50, forced_test_author=None)
    _run(jobs.check_set, spark, records=path, split=f"{path}/split")
    parts = [spark.read.schema("author string, n_publicacoes_usadas int, target_tags array<string>").json(f"{path}/{p}") for p in ("train", "validation", "test")]
    return R._joined(parts[0].unionAll(parts[1]).unionAll(parts[2]))


@query(f"""WITH {R._SAID}, w AS (SELECT author, list_filter(string_split_regex(said, '{R.WS}+'), lambda z: z <> '')[-30:] AS ws FROM told),
e AS (SELECT author, unnest(ws) AS t, generate_subscripts(ws, 1) AS k FROM w), f AS (SELECT author, t, min(k) AS k FROM e GROUP BY ALL),
g AS (SELECT author, t AS tag, count(*) OVER (PARTITION BY author) - row_number() OVER (PARTITION BY author ORDER BY k) + 1 AS s FROM f)
SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY s DESC, tag) AS INT) AS rank, tag, CAST(s AS INT) AS score FROM g""")
def job_generate(spark, d):
    path = scratch(spark)
    p = profiles.structured_profile(R._pubs(spark, d), R._judged(spark, d), most=50)
    sinks.jsonl(p, path + "-in")
    config = {f: getattr(generate.GenerationConfig, f) for f in generate.GenerationConfig.__dataclass_fields__}
    for _ in range(2):  # the second run finds all of it done
        _run(jobs.run_generation, spark, profiles=path + "-in", output=path, retry_errors=False, fresh=False, finetuned=False, **config)
    return _told(spark, f"{path}/rankings", "score:int")


@query(R.ORACLE_SQL["qrels_statistics"].replace("FROM qrels", "FROM (SELECT m.a AS author, m.t AS tag, m.w AS weight FROM (SELECT regexp_extract(l, '" + _PATTERN + "', ['a', 'i', 't', 'w']) AS m FROM (SELECT " + _LINE + " AS l FROM qrels UNION ALL SELECT 'short' || chr(9) || 'line' FROM qrels)))"))
def job_inspect_qrels(spark, d):
    return _run(jobs.inspect, spark, type="qrels", input=_tsv(spark, d))


@query(R.ORACLE_SQL["field_frequency"].replace("pub_year", "year").replace("'issn'", "'ISSN'").replace("'doi'", "'DOI'").replace("FROM filtered_documents", "FROM (SELECT *, pub_year AS year FROM filtered_documents)"))
def job_inspect_jsonl(spark, d):
    path = scratch(spark)
    _publication_json(spark, d).select("value").write.text(path)
    return _run(jobs.inspect, spark, type="jsonl", input=path)


# names, ids, answers and examples ------------------------------------------------------------------------


@query(f"""SELECT author, CASE WHEN starts_with(author, 'ID_') THEN author ELSE 'ID_' || author END AS prefixed, {R._author('author')} AS plain, regexp_replace({R._strip('author')}, '(?i)^ID_', '') AS any_case,
 nullif(regexp_extract(author, '(?:ID_)?(\\d{{8,}})', 1), '') AS digits, nullif(regexp_extract(author || '.XML', '(\\d+)', 1), '') AS of_file, count(*) AS n FROM qrels WHERE author IS NOT NULL GROUP BY ALL""")
def id_forms(spark, d):
    c = F.col("author")
    q = table(spark, d, "qrels").where("author is not null")
    forms = (X.prefixed_id(c).alias("prefixed"), X.author_id(c).alias("plain"), X.author_id(c, True).alias("any_case"), X.first_digits(c).alias("digits"), X.file_id(F.concat(c, F.lit(".XML"))).alias("of_file"))
    return q.select("author", *forms).groupBy("author", "prefixed", "plain", "any_case", "digits", "of_file").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT title, trim(regexp_replace(upper(replace(title, 'ß', 'ss')), '[^A-Z0-9]+', '_', 'g'), '_') AS field, title AS local FROM filtered_documents WHERE title IS NOT NULL AND NOT contains(title, '}')")
def name_forms(spark, d):
    c = F.col("title")
    t = table(spark, d, "filtered_documents").where("title is not null and not contains(title, '}')")
    return t.select("title", X.field_name(c).alias("field"), X.local_name(F.concat(F.lit("{ns}"), c)).alias("local")).distinct()


_THOUGHT = "'<think>a' || chr(10) || 'b</think>' || coalesce(text, '') || '<THINK></THINK>'"


@query(f"SELECT doc_id, md5(regexp_replace({_THOUGHT}, '(?is)<think>.*?</think>', ' ', 'g')) AS digest FROM documents")
def thinking_removed(spark, d):
    c = F.concat(F.lit("<think>a\nb</think>"), F.coalesce("text", F.lit("")), F.lit("<THINK></THINK>"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.remove_thinking(c)).alias("digest"))


_TAG_LISTS = R.ORACLE_SQL["parse_tags"].replace("array_to_string(CASE", "(CASE").replace("END, ' | ') AS tags", "END) AS tags")


@query(f"""WITH t AS (SELECT doc_id, unnest(tags) AS t, generate_subscripts(tags, 1) AS k FROM ({_TAG_LISTS})), n AS (SELECT doc_id, {R._collapse('t')} AS t, k FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM n WHERE t <> '')
SELECT d.doc_id, coalesce(string_agg(t, ' | ' ORDER BY k), '') AS tags FROM documents d LEFT JOIN (SELECT * FROM r WHERE r <= 30) USING (doc_id) GROUP BY d.doc_id""")
def finetuned_answers(spark, d):
    return R._joined(table(spark, d, "documents").select("doc_id", finetuned_tags(F.col("text")).alias("tags")))


@query("SELECT author_id, CAST(to_json({'tags': target_tags}) AS VARCHAR) AS target, count(*) AS n FROM dataset_treino_1001_autores WHERE target_tags IS NOT NULL GROUP BY ALL")
def training_answers(spark, d):
    t = table(spark, d, "dataset_treino_1001_autores").where("target_tags is not null")
    return t.select("author_id", dataset.target_json(F.col("target_tags")).alias("target")).groupBy("author_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT doc_id, n_chars AS p, doc_id % 3000 AS q FROM documents), t AS (SELECT doc_id, p, least(q, 1023) + 1 AS t FROM n)
SELECT doc_id, CAST(least(p, greatest(0, 8192 - t)) + t AS INT) AS ids, CAST(least(p, greatest(0, 8192 - t)) AS INT) AS masked, CAST(t - 1 AS INT) AS kept FROM t""")
def masked_examples(spark, d):
    """Prompts as long as the texts, targets of up to 3,000 tokens: lengths, masked and kept labels."""
    some = lambda n, v: F.array_repeat(F.lit(v), n.cast("int"))
    ids, labels = dataset.masked_example(some(F.col("n_chars"), 7), some(F.col("doc_id") % 3000, 5), 2)
    t = table(spark, d, "documents").select("doc_id", ids.alias("i"), labels.alias("l"))
    return t.select("doc_id", F.size("i").alias("ids"), F.size(F.filter("l", lambda x: x == -100)).alias("masked"), F.size(F.filter("l", lambda x: x == 5)).alias("kept"))


@query(f"""WITH {R._TRAINED}, i AS (SELECT CAST(to_json(list(author ORDER BY author)) AS VARCHAR) AS ids FROM a) SELECT sha256(ids || '{{"part": "all", "seed": 42}}') AS identity FROM i""")
def set_identity(spark, d):
    a = table(spark, d, "dataset_treino_1001_autores").select(X.author_id(F.col("author_id")).alias("author")).where("author <> ''").distinct()
    ids = a.agg(F.array_sort(F.collect_list("author")).alias("ids"))  # of a judged set
    return ids.select(dataset.split_identity(F.col("ids"), seed=42, part="all").alias("identity"))


@query("SELECT sha256('" + '{"batch_size": 4, "do_sample": true, "max_new_tokens": 1024, "max_publications": 50, "min_p": 0.0, "mode": "few_shot", "n_tags": 30, "repetition_penalty": 1.0, "seed": 42, "temperature": 0.7, "thinking": false, "top_k": 20, "top_p": 0.8}' + "') AS config, count(DISTINCT " + R._author("author") + ") AS authors FROM qrels WHERE author IS NOT NULL AND " + R._author("author") + " <> ''")
def config_identity(spark, d):
    """The configuration that every result carries."""
    out = generate.generate(R._judged(spark, d).select("author", F.lit("a b").alias("prompt")))
    return out.groupBy("config").agg(F.count(F.lit(1)).alias("authors"))


@query("""WITH n AS (SELECT doc_id, n_chars AS p, doc_id % 3000 AS q FROM documents), t AS (SELECT doc_id, p, least(q, 1023) + 1 AS t FROM n), s AS (SELECT doc_id, CAST(least(p, greatest(0, 8192 - t)) + t AS INT) AS n, CAST(t AS INT) AS t FROM t)
SELECT doc_id, n AS input_ids, n AS attention_mask, n AS labels, t AS learnt FROM s""")
def trainer_rows(spark, d):
    some = lambda n, v: F.array_repeat(F.lit(v), n.cast("int"))
    t = table(spark, d, "documents").select("doc_id", some(F.col("n_chars"), 7).alias("p"), some(F.col("doc_id") % 3000, 5).alias("t"))
    x = dataset.trainer_rows(t, "p", "t", 2)
    return x.select("doc_id", F.size("input_ids").alias("input_ids"), F.size("attention_mask").alias("attention_mask"), F.size("labels").alias("labels"), F.size(F.filter("labels", lambda z: z != -100)).alias("learnt"))
