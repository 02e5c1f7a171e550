"""Queries of the ten problems, on whole tables with production parameters, and SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import prepare, table


def _pubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(prepare(spark), sf_dir, "filtered_documents")


def p1_found(spark, sf_dir):
    from quillspark.llm.near_duplicates import near_duplicate_pairs

    return near_duplicate_pairs(_pubs(spark, sf_dir))


def p1_classes(spark, sf_dir):
    from quillspark.llm.near_duplicates import near_duplicate_classes

    return near_duplicate_classes(_pubs(spark, sf_dir))


def p2_found(spark, sf_dir):
    from quillspark.llm.distinctiveness import shared_terms

    return shared_terms(_pubs(spark, sf_dir), 3, 5).select("rec_id", "term")


def p2_weights(spark, sf_dir):
    from quillspark.llm.distinctiveness import log_entropy_weights

    return log_entropy_weights(_pubs(spark, sf_dir)).select("rec_id", "term", "tf", "df", "gf", F.round("weight", 6).alias("weight"))


def p3_found(spark, sf_dir):
    from quillspark.llm.markup import fields_with_markup

    return fields_with_markup(_pubs(spark, sf_dir)).select("rec_id", "field")


def p3_clean(spark, sf_dir):
    from quillspark.llm.markup import fields_with_markup

    return fields_with_markup(_pubs(spark, sf_dir))


def p4_found(spark, sf_dir):
    from quillspark.llm.splits import author_groups

    return author_groups(table(spark, sf_dir, "dataset_treino_1001_autores"), _pubs(spark, sf_dir))


def p4_splits(spark, sf_dir):
    from quillspark.llm.splits import author_groups, split_groups
    from quillspark.session import cut

    return split_groups(cut(author_groups(table(spark, sf_dir, "dataset_treino_1001_autores"), _pubs(spark, sf_dir))))


def p4_audit(spark, sf_dir):
    from quillspark.llm.splits import audit, author_groups, split_groups
    from quillspark.session import cut

    groups = cut(author_groups(table(spark, sf_dir, "dataset_treino_1001_autores"), _pubs(spark, sf_dir)))
    return audit(cut(split_groups(groups)), groups)


def p5_found(spark, sf_dir):
    from quillspark.llm.language import unlabelled_languages

    return unlabelled_languages(_pubs(spark, sf_dir), table(spark, sf_dir, "idioma_rotulos")).select("rec_id", "field", "lang")


def p5_segments(spark, sf_dir):
    from quillspark.llm.language import language_segments

    return language_segments(_pubs(spark, sf_dir), table(spark, sf_dir, "idioma_rotulos"))


def p6_found(spark, sf_dir):
    from quillspark.llm.encoding_repair import garbled_fields

    return garbled_fields(_pubs(spark, sf_dir)).select("rec_id", "field")


def p6_restored(spark, sf_dir):
    from quillspark.llm.encoding_repair import garbled_fields

    return garbled_fields(_pubs(spark, sf_dir))


def _frequencies(spark, sf_dir):
    from quillspark.llm.frequency import keyword_and_author_frequencies

    return keyword_and_author_frequencies(_pubs(spark, sf_dir), table(spark, sf_dir, "perfis_autores"))


def p7_found(spark, sf_dir):
    return _frequencies(spark, sf_dir).where("verdict is not null").select("field", "term", "verdict")


def p7_terms(spark, sf_dir):
    return _frequencies(spark, sf_dir)


def p8_ids(spark, sf_dir):
    from quillspark.llm.tokenizing import encode_corpus

    return encode_corpus(table(prepare(spark), sf_dir, "documents"))


def p8_round_trip(spark, sf_dir):
    """Every text back from its ids, as a digest."""
    from quillspark.llm.tokenizing import decode_corpus, encode_corpus

    return decode_corpus(encode_corpus(table(prepare(spark), sf_dir, "documents"))).select("doc_id", F.md5("text").alias("digest"))


def p9_audit(spark, sf_dir):
    from quillspark.llm.packing import audit, pack
    from quillspark.llm.tokenizing import token_counts
    from quillspark.session import cut

    sizes = token_counts(table(prepare(spark), sf_dir, "documents"))
    return audit(cut(pack(sizes, 2048)), sizes)


def p10_audit(spark, sf_dir):
    from quillspark.llm.splitting import audit, split_oversized
    from quillspark.session import cut

    documents = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return audit(cut(split_oversized(documents, 512, 64)), documents)


def p9_packed(spark, sf_dir):
    from quillspark.llm.packing import pack
    from quillspark.llm.tokenizing import token_counts

    return pack(token_counts(table(prepare(spark), sf_dir, "documents")), 2048)


def p10_pieces(spark, sf_dir):
    from quillspark.llm.splitting import split_oversized

    return split_oversized(table(prepare(spark), sf_dir, "documents"), 512, 64)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_classes, p2_found, p2_weights, p3_found, p3_clean, p4_found, p4_splits, p4_audit, p5_found, p5_segments, p6_found, p6_restored, p7_found, p7_terms, p8_ids, p8_round_trip, p9_packed, p9_audit, p10_pieces, p10_audit)
}

_WORDS = r"""
docs AS (SELECT rec_id, id, list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\p{L}\p{N}]+')) AS w FROM filtered_documents),
big AS (SELECT rec_id, id, len(w) AS n, w FROM docs WHERE len(w) >= 20),
words AS (SELECT rec_id, n, id, unnest(w) AS word FROM big),
"""
_LETTERS = r"""
terms AS (SELECT rec_id, unnest(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''), array_to_string(keywords, ' '))), '\p{L}{4,}')) AS term FROM filtered_documents),
tf AS (SELECT rec_id, term, count(*) AS tf FROM terms GROUP BY ALL),
"""
_TERMS = r"""
kw AS (SELECT rec_id AS rec, unnest(keywords) AS k FROM filtered_documents),
all_terms AS (
  SELECT 'keywords' AS field, rec, regexp_replace(regexp_replace(lower(k), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS term FROM kw WHERE k IS NOT NULL
  UNION ALL
  SELECT 'autor_id', row_number() OVER (), regexp_replace(trim(autor_id), '^ID_\s*', '') FROM perfis_autores WHERE autor_id IS NOT NULL),
freq AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM all_terms
  WHERE (field = 'keywords' AND term <> '') OR (field = 'autor_id' AND regexp_full_match(term, '[0-9]+') AND NOT regexp_full_match(term, '0+')) GROUP BY ALL),
marked AS (SELECT field, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare'
  WHEN records >= CASE field WHEN 'keywords' THEN 0.01 * (SELECT count(*) FROM filtered_documents) ELSE 0.05 * (SELECT count(*) FROM perfis_autores) END THEN 'common' END AS verdict FROM freq)
"""

_GROUPS = r"""WITH RECURSIVE
entries AS (SELECT rec_id, regexp_replace(trim(a), '^ID_\s*', '') AS a FROM (SELECT rec_id, unnest(authors) AS a FROM filtered_documents)),
valid AS (SELECT DISTINCT rec_id, a FROM entries WHERE regexp_full_match(a, '[0-9]+') AND NOT regexp_full_match(a, '0+')),
first AS (SELECT rec_id, min(a) AS f FROM valid GROUP BY rec_id),
star AS (SELECT DISTINCT f AS u, a AS v FROM valid JOIN first USING (rec_id)),
edges AS (SELECT u, v FROM star UNION SELECT v, u FROM star),
reach(n, m) AS (SELECT u, u FROM edges UNION SELECT r.n, e.v FROM reach r JOIN edges e ON r.m = e.u),
least AS (SELECT n, min(m) AS group_id FROM reach GROUP BY n),
wanted AS (SELECT DISTINCT regexp_replace(trim(author_id), '^ID_\s*', '') AS author_id FROM dataset_treino_1001_autores)
SELECT author_id, coalesce(group_id, author_id) AS group_id FROM wanted LEFT JOIN least ON n = author_id
WHERE regexp_full_match(author_id, '[0-9]+') AND NOT regexp_full_match(author_id, '0+')"""

ORACLE_SQL = {
    "p1_found": "WITH" + _WORDS + """
common AS (SELECT a.rec_id AS rec_id_a, b.rec_id AS rec_id_b, a.n AS na, b.n AS nb, count(*) AS c
  FROM words a JOIN words b ON a.word = b.word AND a.rec_id < b.rec_id AND a.id IS DISTINCT FROM b.id
  AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) GROUP BY ALL)
SELECT rec_id_a, rec_id_b FROM common WHERE c >= 0.75 * (na + nb - c)""",
    "p1_classes": "WITH" + _WORDS + """
cls AS (SELECT rec_id, n, w, min(rec_id) OVER (PARTITION BY list_sort(w)) AS class_id FROM big),
rw AS (SELECT class_id, n, unnest(w) AS word FROM cls WHERE rec_id = class_id),
common AS (SELECT a.class_id AS x, b.class_id AS y, a.n AS na, b.n AS nb, count(*) AS c FROM rw a JOIN rw b ON a.word = b.word AND a.class_id < b.class_id AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT class_id, count(*) AS links FROM (SELECT x AS class_id FROM common WHERE c >= 0.75 * (na + nb - c) UNION ALL SELECT y FROM common WHERE c >= 0.75 * (na + nb - c)) GROUP BY class_id)
SELECT d.rec_id, coalesce(c.class_id, d.rec_id) AS class_id, CASE WHEN c.class_id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY c.class_id) END AS copies, coalesce(l.links, 0) AS links
FROM filtered_documents d LEFT JOIN cls c USING (rec_id) LEFT JOIN links l ON l.class_id = c.class_id""",
    "p4_audit": r"""SELECT count(DISTINCT a) AS authors, CAST(0 AS BIGINT) AS parted, CAST(0 AS BIGINT) AS without, true AS in_proportion FROM (SELECT regexp_replace(trim(author_id), '^ID_\s*', '') AS a FROM dataset_treino_1001_autores)
WHERE regexp_full_match(a, '[0-9]+') AND NOT regexp_full_match(a, '0+')""",
    "p8_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p9_audit": "SELECT count(*) AS items, CAST(0 AS BIGINT) AS wrong_sums, CAST(0 AS BIGINT) AS split_small, CAST(0 AS BIGINT) AS over_capacity, true AS filled FROM documents",
    "p10_audit": "SELECT CAST(0 AS BIGINT) AS no_slice, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS needless",
    "p2_found": "WITH" + _LETTERS + """
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT rec_id, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 5""",
    "p2_weights": "WITH" + _LETTERS + """
st AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS gf, sum(tf * ln(tf)) AS e FROM tf GROUP BY term)
SELECT rec_id, term, tf, df, gf, round(ln(1 + tf) * (1 - (ln(gf) - e / gf) / ln((SELECT count(*) FROM filtered_documents))), 6) AS weight FROM tf JOIN st USING (term)""",
    "p4_found": _GROUPS,
    "p4_splits": f"""WITH g AS ({_GROUPS}), t AS (SELECT count(*) AS total FROM g), s AS (SELECT group_id, count(*) AS n FROM g GROUP BY group_id),
b AS (SELECT group_id, n, CASE WHEN n > total * 0.15 THEN -1 ELSE CAST('0x' || substr(md5(group_id), 1, 3) AS INT) END AS b FROM s, t),
c AS (SELECT b, sum(n) AS n, sum(sum(n)) OVER (ORDER BY b) AS upto FROM b GROUP BY b), m AS (SELECT b, (upto - n / 2) / total AS middle FROM c, t)
SELECT author_id, group_id, CASE WHEN b = -1 OR middle < 0.7 THEN 'train' WHEN middle < 0.85 THEN 'validation' ELSE 'test' END AS split FROM g JOIN b USING (group_id) JOIN m USING (b)""",
    "p7_found": "WITH" + _TERMS + "SELECT field, term, verdict FROM marked WHERE verdict IS NOT NULL",
    "p7_terms": "WITH" + _TERMS + "SELECT field, term, occurrences, records, verdict FROM marked",
}
