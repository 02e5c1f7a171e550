"""How distinctive a term is of a record: log-entropy weighting by two SQL aggregations.

The first aggregation counts each term inside its record. The second gathers, per term, the records df, the
occurrences gf and sum(tf ln tf), from which the entropy of its spread over the records follows:
H = ln gf - sum(tf ln tf) / gf. The weight is ln(1 + tf) * (1 - H / ln N) with N records; N = 1 gives
ln(1 + tf). Both counts are combined before they are shuffled. The first is keyed by record and term, so no
key is hot; of the second, a term of all records reaches the shuffle as one row for each partition.

Terms are the maximal runs of four letters or more of the lower-cased title, abstract and keywords. Null
fields count as empty, records without a term give no rows, repeated records count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread


def terms(title: Column, abstract: Column, keywords: Column) -> Column:
    """array<string> of all mentions."""
    text = F.lower(F.concat_ws(" ", title, abstract, keywords))
    return F.regexp_extract_all(text, F.lit(r"\p{L}{4,}"), F.lit(0))


def local_frequencies(records: DataFrame) -> DataFrame:
    """row, rec_id, term, tf: the first aggregation. row tells repeated records apart."""
    src = records.select(F.monotonically_increasing_id().alias("row"), "rec_id", "title", "abstract", "keywords")
    each = spread(src).select("row", "rec_id", F.explode(terms(F.col("title"), F.col("abstract"), F.col("keywords"))).alias("term"))
    return each.groupBy("row", "rec_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_statistics(local: DataFrame, total: Column) -> DataFrame:
    """term, df, gf, entropy, share (entropy over ln N): the second aggregation. One record's term has entropy 0."""
    x = local.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.log("tf")).alias("tlogt"))
    x = x.withColumn("entropy", F.when(F.col("df") == 1, 0.0).otherwise(F.log("gf") - F.col("tlogt") / F.col("gf")))
    return x.select("term", "df", "gf", "entropy", F.when(total > 1, F.col("entropy") / F.log(total)).otherwise(F.lit(0.0)).alias("share"))


def log_entropy_weights(records: DataFrame, least_tf: int = 1) -> DataFrame:
    """records(rec_id, title, abstract, keywords) -> rec_id, term, tf, df, gf, entropy, weight.

    least_tf keeps the rows whose own count is at least that; the statistics always cover all rows."""
    local = local_frequencies(records)
    stats = term_statistics(local, records.select(F.count(F.lit(1))).scalar())
    own = local.where(F.col("tf") >= least_tf) if least_tf > 1 else local
    return own.join(stats, "term").select("rec_id", "term", "tf", "df", "gf", "entropy", (F.log1p("tf") * (1 - F.col("share"))).alias("weight"))


def shared_terms(records: DataFrame, least_tf: int = 3, most_records: int = 5) -> DataFrame:
    """rec_id, term, tf, df, weight: what a record mentions least_tf times or more and a few others share.

    Selected from the weighted table: a term that no other record has weighs ln(1 + tf), its entropy being 0, and
    one that others share weighs less; most_records bounds how many share it."""
    w = log_entropy_weights(records, least_tf)
    shared = (F.col("weight") < F.log1p("tf")) & (F.col("df") <= most_records)
    return w.where(shared).select("rec_id", "term", "tf", "df", "weight")
