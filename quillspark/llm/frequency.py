"""Frequency of every distinct term: last-seen counters.

Every record lies whole in one partition, so a partition walks its records in order and keeps for each
term [occurrences, records, last record]; a record is counted when the term's last record is another
one. No set of records is ever held. The partial counters are then hash-partitioned by term and summed,
so that a hot term reaches the shuffle as one row for each partition.

Null terms are skipped, null or empty term arrays count nothing, an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TERMS = 1 << 18  # terms held by a partition before its counters are handed on; any value gives the same result


def _counters(batches):
    state: dict = {}
    record = 0

    def out():
        keys, cells = list(state), list(state.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.int64())],
            names=["field", "term", "occurrences", "records"],
        )

    for batch in batches:
        for field, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            record += 1
            for t in terms or ():
                if t is None:
                    continue
                cell = state.get((field, t))
                if cell is None:
                    state[(field, t)] = [1, 1, record]
                    continue
                cell[0] += 1
                if cell[2] != record:
                    cell[1] += 1
                    cell[2] = record
            if len(state) >= MAX_TERMS:  # between records, so no record is counted twice
                yield out()
                state = {}
    if state:
        yield out()


def term_frequencies(records: DataFrame) -> DataFrame:
    """records(field, terms array<string>), one row a record -> field, term, occurrences, records."""
    partial = records.select("field", "terms").mapInArrow(_counters, "field string, term string, occurrences long, records long")
    return partial.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark(freq: DataFrame, total: Column, share: Column, rare_at_most: int = 2) -> DataFrame:
    """verdict: rare, common or null; common needs at least share of total records."""
    r = F.col("records")
    return freq.withColumn("verdict", F.when(r <= rare_at_most, "rare").when(r >= total * share, "common"))


def keyword_terms(keywords: Column) -> Column:
    """Lower-cased keywords, runs of spaces made one, spaces and periods cut at both ends, empty ones dropped."""
    one = F.transform(keywords, lambda k: F.regexp_replace(F.regexp_replace(F.lower(k), r"(?U)\s+", " "), r"^[ .]+|[ .]+$", ""))
    return F.filter(one, lambda k: k.isNotNull() & (k != ""))


def author_key(entry: Column) -> Column:
    """An author entry without surrounding spaces and the prefix ID_; null where it names no author."""
    bare = F.regexp_replace(F.regexp_replace(entry, r"(?U)^\s+|\s+$", ""), r"^ID_\s*", "")
    return F.when(bare.rlike(r"^[0-9]+$") & ~bare.rlike(r"^0+$"), bare)


def keyword_and_author_frequencies(publications: DataFrame, profiles: DataFrame, keyword_share: float = 0.01, author_share: float = 0.05) -> DataFrame:
    """field, term, occurrences, records, verdict of publications.keywords and profiles.autor_id."""
    key = author_key(F.col("autor_id"))
    records = publications.select(F.lit("keywords").alias("field"), keyword_terms(F.col("keywords")).alias("terms")).unionAll(
        profiles.select(F.lit("autor_id").alias("field"), F.when(key.isNotNull(), F.array(key)).alias("terms"))
    )
    n_pub = publications.select(F.count(F.lit(1))).scalar()
    n_prof = profiles.select(F.count(F.lit(1))).scalar()
    is_kw = F.col("field") == "keywords"
    return mark(term_frequencies(records), F.when(is_kw, n_pub).otherwise(n_prof), F.when(is_kw, F.lit(keyword_share)).otherwise(F.lit(author_share)))
