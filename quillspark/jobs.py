"""Job entries: python -m quillspark.jobs JOB --option value ...

Each job reads files, runs the operators and writes a directory. On a cluster start it by spark-submit; the
session is then the cluster's.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import curriculum, dataset, generate, guards, judgements, profiles, rankers
from quillspark.session import prepare
from quillspark.sources import readers, sinks

def _judged(spark: SparkSession, a) -> DataFrame:
    found = judgements.authors(readers.qrels(spark, a.qrels))
    if found.isEmpty():
        raise SystemExit(f"no author in {a.qrels}")
    return found


def _bag_file(spark: SparkSession, path: str) -> DataFrame:
    return readers.json_map(spark, path).select(F.col("author").alias("autor_id"), F.col("value").alias("ngramas"))


def filter_documents(spark, a):
    """Publications of the listed authors, as JSON lines; prints the counts."""
    docs, authors = readers.jsonl(spark, a.documents), readers.author_ids(spark, a.authors, needed=True)
    sinks.jsonl(profiles.of_authors(docs, authors).drop("pos"), a.output, (a.documents, a.authors))
    return profiles.filter_summary(docs, authors)


def filter_report(spark, a):
    """Prints lines, invalid ones, publications kept, authors wanted, found and missing, and the first missing."""
    docs, authors = readers.jsonl(spark, a.documents), readers.author_ids(spark, a.authors, needed=True)
    return profiles.filter_report(readers.line_counts(spark, a.documents), docs, authors)


def map_lines(spark, a):
    """A JSON object keyed by author as JSON lines, which Spark can split."""
    print(readers.json_map_lines(a.input, a.output))


def curricula(spark, a):
    """Units of XML curricula of the judged authors; prints the report beside them."""
    files, judged = readers.xml_files(spark, a.xml), _judged(spark, a)
    own = files.join(judged, "author", "left_semi")
    units = curriculum.units(curriculum.profile(own))
    sinks.jsonl(units, a.output, (a.xml, a.qrels))
    made = spark.read.schema("author string, doc_id string, section string, pieces array<string>").json(a.output)
    print(json.dumps(curriculum.audit_report(files, judged, made), ensure_ascii=False, indent=2))


def check_set(spark, a):
    """The three parts of supervised records against their split, a CSV of author and split."""
    split = readers.csv(spark, a.split)
    guards.require_frozen({p: spark.read.json(f"{a.records}/{p}").select("author") for p in ("train", "validation", "test")}, split)


def profiles_ft(spark, a):
    """Labelled text profiles of every listed author from a JSON array of publications."""
    chunk = getattr(a, "chunk", None)
    out = profiles.labelled_profile(readers.json_array(spark, a.documents), readers.author_ids(spark, a.authors), chunk)
    sinks.jsonl(out.orderBy("author", *(["part"] if chunk else [])), a.output, (a.documents, a.authors))


def profiles_baseline(spark, a):
    """N-gram profiles by author, by document, or both."""
    docs, authors = readers.jsonl(spark, a.documents), _judged(spark, a)
    if a.mode in ("authors", "both"):
        sinks.jsonl(profiles.ngram_profile(docs, authors), f"{a.output}/authors", (a.documents,))
    if a.mode in ("documents", "both"):
        by_doc = profiles.ngrams_by_document(profiles.of_authors(docs, authors))
        sinks.jsonl(profiles.coauthored(by_doc, authors).select("author", F.col("id").alias("doc_id"), "ngramas"), f"{a.output}/documents", (a.documents,))


def profiles_structured(spark, a):
    sinks.jsonl(profiles.structured_profile(readers.jsonl(spark, a.documents), _judged(spark, a), chunk=getattr(a, "chunk", None)), a.output, (a.documents, a.qrels))


def document_evidence(spark, a):
    """Cleaned fields of each document; prints documents an author and pieces a document."""
    out = profiles.field_evidence(readers.jsonl(spark, a.documents), _judged(spark, a))
    sinks.jsonl(out, a.output, (a.documents, a.qrels))
    n = spark.read.schema("author string, doc_id string, pieces array<string>").json(a.output)
    return n.agg((F.count(F.lit(1)) / F.greatest(F.lit(1), F.countDistinct("author"))).alias("documents_an_author"), (F.sum(F.size("pieces")) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("pieces_a_document"))


def pop(spark, a):
    p = _bag_file(spark, a.profiles)
    sinks.rankings(rankers.pop(rankers.bag(p)), a.output, "freq", rankers.authors_of(p) if a.keep_empty else None)


def tfidf(spark, a):
    p = _bag_file(spark, a.profiles)
    sinks.rankings(rankers.tfidf(rankers.bag(p), rankers.authors_total(p)), a.output, "score", rankers.authors_of(p) if a.keep_empty else None)


def supervised(spark, a):
    """Supervised records in three parts by a seeded split of their authors."""
    gold = judgements.gold(readers.qrels(spark, a.qrels), training=True)
    p = profiles.structured_profile(readers.jsonl(spark, a.documents), judgements.authors(readers.qrels(spark, a.qrels)), "extended", True, most=a.max_publications)
    records = dataset.supervised(p, gold, a.max_publications)
    split = dataset.random_split(records.select("author"), dataset.SplitConfig(a.seed, forced_test_author=a.forced_test_author))
    if not dataset.check_split(split, records.select("author")).isEmpty():
        raise SystemExit("the split doesn't fit the records")
    sinks.splits(records, split, a.output)
    sinks.csv(split.orderBy("split", "author").coalesce(1), f"{a.output}/split")
    ids = records.select("author").orderBy("author").agg(F.array_sort(F.collect_list("author")).alias("ids"))  # of a judged set
    print(json.dumps({"identity": ids.select(dataset.split_identity(F.col("ids"), seed=a.seed, forced=a.forced_test_author, most=a.max_publications).alias("i")).first().i}))


def run_generation(spark, a):
    """Tags from structured profiles; results are kept at the output and only what is missing is made."""
    known = {f.name for f in fields(generate.GenerationConfig)}
    config = generate.GenerationConfig(**{k: v for k, v in vars(a).items() if k in known}).validate()
    p = readers.structured_profiles(spark, a.profiles)
    prompts = p.select("author", generate.chat_prompt(generate.chat_messages(F.col("publicacoes"), config)).alias("prompt"))
    out = generate.resume(prompts, f"{a.output}/results", config, retry_errors=a.retry_errors, fresh=a.fresh)
    if a.finetuned:
        out = generate.finetuned(out, config)
    sinks.rankings(rankers.positional(out), f"{a.output}/rankings", "score")


def inspect(spark, a):
    if a.type == "ids":
        return readers.author_ids(spark, a.input).agg(F.count(F.lit(1)).alias("distinct"))
    if a.type == "id-counts":
        return readers.id_counts(spark, a.input)
    if a.type == "qrels":
        return judgements.statistics(readers.qrels_by_pattern(spark, a.input).withColumn("weight", F.col("weight").cast("string")))
    docs = readers.jsonl(spark, a.input, strict=True)
    return profiles.field_frequency(docs, [c for c in docs.columns if c != "pos"])


def extract(spark, a):
    print(len(sinks.extract(a.archive, a.output)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark.jobs", description=__doc__)
    jobs = p.add_subparsers(required=True, metavar="JOB")

    def job(name, run, *options):
        j = jobs.add_parser(name, help=(run.__doc__ or "").strip().split("\n")[0])
        for o in options:
            j.add_argument(f"--{o}", required=True)
        j.set_defaults(run=run)
        return j

    job("filter", filter_documents, "documents", "authors", "output")
    job("filter-report", filter_report, "documents", "authors")
    job("map-lines", map_lines, "input", "output")
    job("curricula", curricula, "xml", "qrels", "output")
    job("check-set", check_set, "records", "split")
    parts = {"type": int, "help": "profiles in parts of the publications of so many positions, for authors with more text than a row holds"}
    job("profiles-ft", profiles_ft, "documents", "authors", "output").add_argument("--chunk", **parts)
    job("profiles-baseline", profiles_baseline, "documents", "qrels", "output").add_argument("--mode", choices=("authors", "documents", "both"), default="both")
    job("profiles-structured", profiles_structured, "documents", "qrels", "output").add_argument("--chunk", **parts)
    job("document-evidence", document_evidence, "documents", "qrels", "output")
    for name, run in (("pop", pop), ("tfidf", tfidf)):
        job(name, run, "profiles", "output").add_argument("--keep-empty", action="store_true", help="authors with empty profiles have an empty ranking")
    job("inspect", inspect, "input").add_argument("--type", choices=("ids", "id-counts", "jsonl", "qrels"), required=True)
    job("extract", extract, "archive", "output")
    d = job("dataset", supervised, "documents", "qrels", "output")
    d.add_argument("--seed", type=int, default=42)
    d.add_argument("--max-publications", type=int, default=50)
    d.add_argument("--forced-test-author")
    g = job("generate", run_generation, "profiles", "output")
    for f in fields(generate.GenerationConfig):
        kind = type(f.default)
        g.add_argument("--" + f.name.replace("_", "-"), **({"action": argparse.BooleanOptionalAction} if kind is bool else {"type": kind}), default=f.default)
    g.add_argument("--retry-errors", action="store_true")
    g.add_argument("--fresh", action="store_true")
    g.add_argument("--finetuned", action="store_true", help="read answers as those of a fine-tuned model")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    out = a.run(prepare(spark or SparkSession.builder.appName("quillspark").getOrCreate()), a)
    if isinstance(out, DataFrame):
        for r in out.collect():  # a few rows of counts
            print(json.dumps(r.asDict(), ensure_ascii=False))


if __name__ == "__main__":
    main()
