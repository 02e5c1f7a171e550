"""All queries over the reference's own operators, on whole tables, and their SQL.

Publications, judgements and n-gram profiles are the tables of that name. Vectors come from `embeddings`:
the label is the author, even ids are predictions in order of id, odd ids are gold tags of weight
1 + id % 3.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.language import detect
from quillspark.functions.parsing import parse_responses
from quillspark.operators import analysis, curriculum, dataset, generate, guards, judgements, matching, metrics, ordering, profiles, rankers, vectors
from quillspark.session import prepare, table
from quillspark.sources import readers
from quillspark.streaming import incremental

THETA = 0.20
THETAS = (0.10, 0.15, 0.20, 0.25, 0.30)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pubs(spark: SparkSession, d: str) -> DataFrame:
    return readers.publications(spark, d)


def _joined(df: DataFrame) -> DataFrame:
    """Arrays of strings as one string, so that results compare the same everywhere."""
    return df.select(*[F.array_join(c, " | ").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return judgements.authors(readers.judgement_table(spark, d))


def _bag(spark: SparkSession, d: str) -> DataFrame:
    return rankers.bag(table(spark, d, "perfis_autores"))


def _total(spark: SparkSession, d: str):
    return rankers.authors_total(table(spark, d, "perfis_autores"))


# SQL pieces. RE2 knows white space and letters as ASCII only, so classes are written out.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
W = r"\p{L}\p{N}_"


def _strip(c):
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _collapse(c):
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


def _author(c):
    return f"regexp_replace({_strip(c)}, '^ID_', '')"


_ENTITIES = {"basic": r"&[a-z]+;|&#\d+;", "extended": r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);"}
_KEEP = {
    "basic": rf"""[^\p{{L}}\p{{N}}_{WS[1:-1]}.,;:!?()\-'"áéíóúâêîôûãõàèìòùçÁÉÍÓÚÂÊÎÔÛÃÕÀÈÌÒÙÇñÑüÜ]""",
    "extended": rf"""[^\p{{L}}\p{{N}}_{WS[1:-1]}À-ÖØ-öø-ÿ.,;:!?()\-/'"&+%#@=]""",
}


def _clean(c, variant="basic"):
    entity = _ENTITIES[variant]
    keep = _KEEP[variant].replace("'", "''")
    return _collapse(f"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '{entity}', ' ', 'g'), '{keep}', ' ', 'g')")


def _items(c):
    return f"list_filter(list_transform(coalesce({c}, []), lambda z: {_strip("coalesce(z, '')")}), lambda z: z <> '')"


def _field(c):
    return _strip(f"coalesce({c}, '')")


_PUBSTR = f"array_to_string(list_filter([{_field('title')}, array_to_string({_items('keywords')}, ', '), {_field('abstract')}], lambda z: z <> ''), ', ')"
_SENTENCES = f"list_filter(list_transform(string_split_regex({_PUBSTR}, '[.!?;\\n]+|,{WS}+'), lambda z: {_strip('z')}), lambda z: z <> '')"


def _normal(c):
    base = f"lower(coalesce({c}, ''))"
    base = f"translate({base}, '{_FROM}', '{_TO}')"
    base = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({base}, '\\p{{Mn}}', '', 'g'), '[-_]+', ' ', 'g'), '[^{W}{WS[1:-1]}]+', ' ', 'g'), '\\p{{Nd}}+', ' ', 'g')"
    words = f"string_split({_collapse(base)}, ' ')"
    return f"array_to_string(list_filter({words}, lambda q: q <> '' AND NOT regexp_full_match(q, '(?i)m{{0,4}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})')), ' ')"


_COMPOSED = [(chr(i), d) for i in range(0xC0, 0x10000) if not (0xAC00 <= i <= 0xD7A3 or 0xD800 <= i <= 0xDFFF) and len(d := unicodedata.normalize("NFD", chr(i))) > 1 and {unicodedata.category(x) for x in d[1:]} == {"Mn"}]
_FROM, _TO = ("".join(x).replace("'", "''") for x in zip(*((c, d[0]) for c, d in _COMPOSED)))

_AUTHORED = f"ex AS (SELECT rec_id AS pos, id, title, keywords, abstract, unnest(list_distinct(list_filter(list_transform(authors, lambda z: {_author('z')}), lambda z: z <> ''))) AS author FROM filtered_documents)"
_SET = f"target AS (SELECT DISTINCT {_author('author')} AS author FROM qrels WHERE author IS NOT NULL AND {_author('author')} <> '')"
_BAG = f"bag AS (SELECT author, ngram, count(*) AS freq FROM (SELECT {_author('autor_id')} AS author, unnest(ngramas) AS ngram FROM perfis_autores WHERE autor_id IS NOT NULL) WHERE author <> '' AND ngram IS NOT NULL GROUP BY ALL)"
_N = f"(SELECT count(DISTINCT {_author('autor_id')}) FILTER ({_author('autor_id')} <> '') FROM perfis_autores)"
_IDF = f"df AS (SELECT ngram, count(*) AS df, log10({_N} / count(*)) AS idf FROM bag GROUP BY ngram)"
_TFIDF = f"""{_BAG}, {_IDF}, most AS (SELECT author, max(freq) AS most FROM bag GROUP BY author),
scored AS (SELECT author, ngram AS tag, round(freq / most * idf, 9) AS score FROM bag JOIN df USING (ngram) JOIN most USING (author))"""
_TFIDF_RANK = _TFIDF + ", tfidf AS (SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY score DESC, tag) AS INT) AS rank, tag, score FROM scored)"
_GOLD = f"""parsed AS (SELECT {_author('author')} AS author, {_collapse('tag')} AS tag, {_strip('tag')} AS spelling, CAST(trim(weight) AS INT) AS weight, tag AS raw, weight AS raww
  FROM qrels WHERE author IS NOT NULL AND regexp_full_match(weight, '\\s*[+-]?\\d+\\s*')),
gold AS (SELECT author, tag, max(weight) AS weight, arg_min(spelling, ROW(raw, raww)) AS tag_original FROM parsed WHERE tag <> '' GROUP BY ALL)"""


@query(f"WITH {_BAG} SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY freq DESC, ngram) AS INT) AS rank, ngram AS tag, freq FROM bag")
def pop_rank(spark, d):
    return rankers.pop(_bag(spark, d))


@query(f"WITH {_TFIDF_RANK} SELECT * FROM tfidf")
def tfidf_rank(spark, d):
    return rankers.tfidf(_bag(spark, d), _total(spark, d))


_EVERY = f"every AS (SELECT DISTINCT {_author('autor_id')} AS author FROM perfis_autores WHERE autor_id IS NOT NULL AND {_author('autor_id')} <> '')"


@query(f"WITH {_BAG}, {_EVERY}, r AS (SELECT author, row_number() OVER (PARTITION BY author ORDER BY freq DESC, ngram) AS rank, ngram AS tag FROM bag) SELECT author, count(tag) AS n, coalesce(string_agg(tag, ' | ' ORDER BY rank), '') AS tags FROM every LEFT JOIN (SELECT * FROM r WHERE rank <= 50) USING (author) GROUP BY author")
def pop_lists(spark, d):
    """The first fifty of each author, an empty list of an author whose profiles are empty."""
    x = rankers.as_lists(rankers.pop(_bag(spark, d), 50), "freq", authors=rankers.authors_of(table(spark, d, "perfis_autores")))
    return x.select("author", F.size("ranking").cast("long").alias("n"), F.array_join(F.transform("ranking", lambda r: r["tag"]), " | ").alias("tags"))


@query(f"WITH {_TFIDF_RANK}, {_EVERY} SELECT author, count(tag) AS n, coalesce(string_agg(tag, ' | ' ORDER BY rank), '') AS tags FROM every LEFT JOIN (SELECT * FROM tfidf WHERE rank <= 50) USING (author) GROUP BY author")
def tfidf_lists(spark, d):
    x = rankers.as_lists(rankers.tfidf(_bag(spark, d), _total(spark, d), 50), "score", authors=rankers.authors_of(table(spark, d, "perfis_autores")))
    return x.select("author", F.size("ranking").cast("long").alias("n"), F.array_join(F.transform("ranking", lambda r: r["tag"]), " | ").alias("tags"))


@query(f"WITH {_BAG}, {_IDF} SELECT ngram, df, round(idf, 9) AS idf FROM df")
def df_idf(spark, d):
    x = rankers.idf(_bag(spark, d), _total(spark, d))
    return x.withColumn("idf", F.round("idf", 9))


@query(f"""WITH l AS (SELECT {_author('author_id')} AS author, target_tags AS tags, row_number() OVER () AS r FROM dataset_treino_1001_autores),
x AS (SELECT r, author, unnest(tags) AS t, generate_subscripts(tags, 1) - 1 AS pos, len(tags) AS n FROM l),
y AS (SELECT author || '/' || r AS k, author, {_collapse('t')} AS tag, n - pos AS s FROM x),
z AS (SELECT author, tag, max(s) AS score FROM y WHERE tag <> '' GROUP BY ALL)
SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY score DESC, tag) AS INT) AS rank, tag, CAST(score AS INT) AS score FROM z""")
def positional_ranking(spark, d):
    t = table(spark, d, "dataset_treino_1001_autores").select(X.author_id(F.col("author_id")).alias("author"), F.col("target_tags").alias("tags"))
    rows = t.select("author", F.size("tags").alias("n"), F.posexplode("tags").alias("pos", "t")).withColumn("tag", X.normalize_tag(F.col("t"))).where("tag <> ''")
    best = rows.groupBy("author", "tag").agg(F.max(F.col("n") - F.col("pos")).alias("score"))
    return rankers.ranked(best, "score").select("author", "rank", "tag", "score")


@query(f"SELECT rec_id, {_clean('title')} AS title, {_clean('abstract')} AS abstract FROM filtered_documents")
def clean_html_basic(spark, d):
    return _pubs(spark, d).select("rec_id", X.clean_text(F.col("title")).alias("title"), X.clean_text(F.col("abstract")).alias("abstract"))


@query(f"SELECT rec_id, {_clean('title', 'extended')} AS title, {_clean('abstract', 'extended')} AS abstract FROM filtered_documents")
def clean_html_extended(spark, d):
    return _pubs(spark, d).select("rec_id", X.clean_text(F.col("title"), "extended").alias("title"), X.clean_text(F.col("abstract"), "extended").alias("abstract"))


@query(f"SELECT rec_id, {_normal('title')} AS normal FROM filtered_documents")
def normalize_lexical(spark, d):
    return _pubs(spark, d).select("rec_id", X.normalize_lexical(F.col("title")).alias("normal"))


@query(f"SELECT rec_id, md5({_normal('abstract')}) AS abstract, md5({_normal("array_to_string(keywords, ' ; ')")}) AS keywords FROM filtered_documents")
def normalize_lexical_texts(spark, d):
    """The normal forms of abstracts and keywords, as digests."""
    return _pubs(spark, d).select("rec_id", F.md5(X.normalize_lexical(F.col("abstract"))).alias("abstract"), F.md5(X.normalize_lexical(F.array_join("keywords", " ; "))).alias("keywords"))


@query(f"WITH s AS (SELECT rec_id, {_SENTENCES} AS x FROM filtered_documents) SELECT rec_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS sent, unnest(x) AS raw FROM s")
def segment_sentences(spark, d):
    text = X.publication_string(F.col("title"), F.col("keywords"), F.col("abstract"))
    return _pubs(spark, d).select("rec_id", F.posexplode(X.sentences(text)).alias("sent", "raw"))


_CARRY = f"""WITH s AS (SELECT rec_id AS pos, id, {_SENTENCES} AS x FROM filtered_documents WHERE coalesce(id, '') <> ''),
t AS (SELECT pos, generate_subscripts(x, 1) - 1 AS sent, unnest(x) AS raw FROM s),
u AS (SELECT t.*, CASE WHEN length(raw) >= 20 AND rotulo IN ('pt', 'en') THEN rotulo END AS l FROM t LEFT JOIN idioma_rotulos ON pos = rec_id)
SELECT pos, CAST(sent AS INT) AS sent, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY pos ORDER BY pos, sent ROWS UNBOUNDED PRECEDING), 'pt') AS lang FROM u"""


@query(_CARRY)
def language_carry(spark, d):
    s = profiles.document_sentences(_pubs(spark, d)).join(table(spark, d, "idioma_rotulos").select(F.col("rec_id").alias("pos"), "rotulo"), "pos", "left")
    got = F.when(F.col("rotulo").isin("pt", "en"), F.col("rotulo"))
    return profiles.carried_language(s, got, ["pos"], ["pos", "sent"]).select("pos", "sent", "lang")


_FUNCTION_WORDS = {
    "pt": "a ao aos as até com como da das de do dos e em entre foi foram já mais mas na nas no nos não o os ou para pela pelo por que se sem ser seu sua são também um uma à às é",
    "en": "a an and are as at be been but by for from had has have in into is it its not of on or our than that the their these this to was we were which with without",
    "es": "a al como con de del el ella en entre es esta este fue fueron ha la las lo los más no o para pero por que se sin son su sus también un una y ya",
    "fr": "a au aux avec ce ces cette comme dans de des du elle en entre est et été la le les leur mais ne nous ont ou par pas plus pour que qui sans se ses son sont sur un une à",
}
_DETECTED = f"""s AS (SELECT rec_id AS pos, id, authors, {_SENTENCES} AS x FROM filtered_documents WHERE coalesce(id, '') <> ''),
t AS (SELECT pos, CAST(generate_subscripts(x, 1) - 1 AS INT) AS sent, unnest(x) AS raw FROM s),
told AS (SELECT pos, sent, raw, string_split_regex(lower(raw), '[^\\p{{L}}]+') AS ws FROM t),
cnt AS (SELECT pos, sent, raw, {", ".join(f"len(list_filter(ws, lambda q: q IN ({', '.join(repr(w) for w in ws.split())}))) AS {k}" for k, ws in _FUNCTION_WORDS.items())} FROM told),
det AS (SELECT pos, sent, raw, CASE WHEN pt > greatest(en, es, fr) THEN 'pt' WHEN en > greatest(pt, es, fr) THEN 'en' END AS l FROM cnt)"""


@query(f"WITH {_DETECTED} SELECT pos, sent, l AS lang FROM det")
def language_detect(spark, d):
    return profiles.document_sentences(_pubs(spark, d)).select("pos", "sent", detect(F.col("raw")).alias("lang"))


@query(f"WITH {_DETECTED} SELECT pos, sent, coalesce(last_value(CASE WHEN length(raw) >= 20 THEN l END IGNORE NULLS) OVER (PARTITION BY pos ORDER BY sent ROWS UNBOUNDED PRECEDING), 'pt') AS lang FROM det")
def language_by_document(spark, d):
    s = profiles.document_sentences(_pubs(spark, d))
    return profiles.carried_language(s, detect(F.col("raw")), ["pos"], ["pos", "sent"]).select("pos", "sent", "lang")


@query(f"""WITH {_DETECTED}, {_AUTHORED}, {_SET}, own AS (SELECT author, det.* FROM det JOIN (SELECT pos, author FROM ex JOIN target USING (author)) a USING (pos))
SELECT author, pos, sent, coalesce(last_value(CASE WHEN length(raw) >= 20 THEN l END IGNORE NULLS) OVER (PARTITION BY author ORDER BY pos, sent ROWS UNBOUNDED PRECEDING), 'pt') AS lang FROM own""")
def language_by_author(spark, d):
    """The language goes on through all sentences of an author."""
    s = profiles.coauthored(profiles.document_sentences(_pubs(spark, d)).select("pos", "sent", "raw", "authors", detect(F.col("raw")).alias("found")), _judged(spark, d))
    return profiles.carried_language(s, F.col("found"), ["author"], ["pos", "sent"]).select("author", "pos", "sent", "lang")


_TOKENS = f"""s AS (SELECT rec_id AS pos, id, authors, {_SENTENCES} AS x FROM filtered_documents WHERE coalesce(id, '') <> ''),
t AS (SELECT pos, generate_subscripts(x, 1) - 1 AS sent, unnest(x) AS raw FROM s),
k AS (SELECT pos, sent, list_filter(string_split({_normal('raw')}, ' '), lambda q: length(q) >= 2) AS toks FROM t),
w AS (SELECT pos, sent, n, start, toks[start:start + n - 1] AS words FROM k, (SELECT unnest([1, 2, 3]) AS n), LATERAL (SELECT unnest(range(1, len(toks) - n + 2)) AS start) WHERE len(toks) >= n)"""


@query(f"WITH {_TOKENS} SELECT array_to_string(words, ' ') AS ngram, CAST(n AS INT) AS n, count(*) AS occurrences FROM w GROUP BY ALL")
def ngram_windows(spark, d):
    x = profiles.document_windows(_pubs(spark, d))
    return x.groupBy("ngram", "n").agg(F.count(F.lit(1)).alias("occurrences"))


_FUNCTIONAL = (
    "de da do das dos em no na nos nas por para com sem sob sobre entre ate of in on at by for with from to between about across um uma uns umas os as este esta esse essa the an this that these those "
    "e ou mas and or but nor que se ele ela eles elas it we they he she you which who foi foram ser sao esta estao is are was were be been has have"
)
_FUN = "[" + ", ".join(f"'{w}'" for w in _FUNCTIONAL.split()) + "]"
_GRAMS = _TOKENS + f""", ok AS (SELECT * FROM w WHERE NOT list_contains({_FUN}, words[1]) AND NOT list_contains({_FUN}, words[-1]))"""


@query(f"""WITH {_GRAMS}, {_AUTHORED}, {_SET}
SELECT author, array_to_string(words, ' ') AS ngram, count(*) AS freq FROM ok JOIN (SELECT pos, author FROM ex JOIN target USING (author)) a USING (pos) GROUP BY ALL""")
def ngram_profile(spark, d):
    return profiles.ngram_profile(_pubs(spark, d), _judged(spark, d))


@query(f"WITH {_GRAMS} SELECT s.pos, s.id, count(ok.pos) AS n_ngrams, count(DISTINCT array_to_string(words, ' ')) AS n_distinct FROM s LEFT JOIN ok USING (pos) WHERE len(x) > 0 GROUP BY ALL")
def ngram_by_document(spark, d):
    x = profiles.ngrams_by_document(_pubs(spark, d))
    return x.select("pos", "id", F.size("ngramas").cast("long").alias("n_ngrams"), F.size(F.array_distinct("ngramas")).cast("long").alias("n_distinct"))


@query(f"WITH {_GRAMS} SELECT pos, md5(string_agg(array_to_string(words, ' '), '|' ORDER BY sent, n, start)) AS digest FROM ok GROUP BY pos")
def ngram_order(spark, d):
    """The n-grams of a document in their order: by sentence, length and start."""
    x = profiles.ngrams_by_document(_pubs(spark, d)).where(F.size("ngramas") > 0)
    return x.select("pos", F.md5(F.array_join("ngramas", "|")).alias("digest"))


@query(f"WITH {_TOKENS} SELECT n, count(*) AS windows, count(*) FILTER (NOT list_contains({_FUN}, words[1]) AND NOT list_contains({_FUN}, words[-1])) AS well_formed FROM w GROUP BY n")
def pos_filter(spark, d):
    return profiles.document_windows(_pubs(spark, d)).groupBy("n").agg(F.count(F.lit(1)).alias("windows"), F.count_if("ok").alias("well_formed"))


@query(f"""WITH {_AUTHORED}, {_SET}, t AS (SELECT author, pos, {_PUBSTR} AS t FROM ex JOIN target USING (author))
SELECT author, string_agg(t, ', ' ORDER BY pos) AS profile FROM t WHERE t <> '' GROUP BY author""")
def text_profile(spark, d):
    return profiles.text_profile(_pubs(spark, d), _judged(spark, d))


@query(f"""WITH {_AUTHORED}, {_SET}, t AS (SELECT author, pos, {_PUBSTR} AS t FROM ex JOIN target USING (author))
SELECT author, CAST(floor(pos / 4096) AS BIGINT) AS part, string_agg(t, ', ' ORDER BY pos) AS profile FROM t WHERE t <> '' GROUP BY ALL""")
def text_profile_parts(spark, d):
    return profiles.text_profile(_pubs(spark, d), _judged(spark, d), chunk=4096)


_LABELLED = "array_to_string(list_filter([{}], lambda z: z IS NOT NULL), chr(10))".format(
    ", ".join(f"CASE WHEN {v} <> '' THEN '{k}: ' || {v} END" for k, v in (("Título", _field("title")), ("Palavras-chave", f"array_to_string({_items('keywords')}, '; ')"), ("Resumo", _field("abstract"))))
)


@query(f"""WITH {_AUTHORED}, {_SET}, t AS (SELECT author, pos, {_LABELLED} AS t FROM ex)
SELECT author, CAST(count(t) AS INT) AS n_publicacoes, coalesce(string_agg(t, ' | ' ORDER BY pos), '') AS publicacoes_textuais FROM target LEFT JOIN (SELECT * FROM t WHERE t <> '') USING (author) GROUP BY author""")
def labelled_text_profile(spark, d):
    return _joined(profiles.labelled_profile(_pubs(spark, d), _judged(spark, d)))


def _structured(variant):
    kws = f"array_to_string(list_transform({_items('keywords')}, lambda z: {_clean('z', variant)}), ', ')"
    return f"{{'titulo': {_clean('title', variant)}, 'keywords': {kws}, 'abstract': {_clean('abstract', variant)}}}"


_REPEATED = f"er AS (SELECT rec_id AS pos, title, keywords, abstract, unnest(list_filter(list_transform(authors, lambda z: {_author('z')}), lambda z: z <> '')) AS author FROM filtered_documents)"


@query(f"""WITH {_REPEATED}, {_SET}, s AS (SELECT author, pos, {_structured('basic')} AS s FROM er JOIN target USING (author))
SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY pos) - 1 AS INT) AS place, s.titulo, s.keywords, s.abstract FROM s WHERE s.titulo <> '' OR s.abstract <> ''""")
def structured_profile(spark, d):
    return profiles.structured_rows(_pubs(spark, d), _judged(spark, d))


@query(f"""WITH {_REPEATED}, {_SET}, s AS (SELECT author, pos, {_structured('basic')} AS s FROM er JOIN target USING (author))
SELECT author, CAST(floor(pos / 4096) AS BIGINT) AS part, CAST(count(*) AS INT) AS n, string_agg(s.titulo, ' | ' ORDER BY pos) AS titulos FROM s WHERE s.titulo <> '' OR s.abstract <> '' GROUP BY ALL""")
def structured_profile_parts(spark, d):
    p = profiles.structured_profile(_pubs(spark, d), _judged(spark, d), chunk=4096)
    return p.select("author", "part", F.size("publicacoes").alias("n"), F.array_join(F.transform("publicacoes", lambda x: x["titulo"]), " | ").alias("titulos"))


@query(f"""WITH {_AUTHORED}, {_SET}, t AS (SELECT author, pos, {_LABELLED} AS t FROM ex)
SELECT author, part, CAST(count(t) AS INT) AS n_publicacoes, coalesce(string_agg(t, ' | ' ORDER BY pos), '') AS publicacoes_textuais FROM target LEFT JOIN (SELECT *, CAST(floor(pos / 4096) AS BIGINT) AS part FROM t WHERE t <> '') USING (author) GROUP BY ALL""")
def labelled_text_profile_parts(spark, d):
    return _joined(profiles.labelled_profile(_pubs(spark, d), _judged(spark, d), chunk=4096))


@query(f"""WITH {_AUTHORED}, {_SET}, p AS (SELECT author, id AS doc_id, pos, list_filter([{_clean('title')}] || list_transform(coalesce(keywords, []), lambda z: {_clean('z')}) || [{_clean('abstract')}], lambda z: z <> '') AS pieces
  FROM ex JOIN target USING (author) WHERE coalesce(id, '') <> '')
SELECT author, doc_id, array_to_string(arg_max(pieces, pos), ' | ') AS pieces FROM p WHERE len(pieces) > 0 GROUP BY ALL""")
def field_evidence(spark, d):
    return _joined(profiles.field_evidence(_pubs(spark, d), _judged(spark, d)))


@query(f"WITH {_AUTHORED} SELECT author, count(*) AS publications, count(DISTINCT id) AS works FROM ex GROUP BY author")
def coauthor_explode(spark, d):
    return profiles.exploded(_pubs(spark, d).select("id", "authors")).groupBy("author").agg(F.count(F.lit(1)).alias("publications"), F.countDistinct("id").alias("works"))


@query(f"WITH {_AUTHORED}, {_SET} SELECT DISTINCT pos AS rec_id, id FROM ex JOIN target USING (author)")
def author_semi_join(spark, d):
    return profiles.of_authors(_pubs(spark, d), _judged(spark, d)).select("rec_id", "id")


@query(f"WITH {_AUTHORED}, {_SET} SELECT author FROM target WHERE author NOT IN (SELECT author FROM ex)")
def missing_authors_anti(spark, d):
    return profiles.missing(_judged(spark, d), _pubs(spark, d))


@query(f"""WITH {_AUTHORED}, {_SET}, l AS (SELECT DISTINCT pos, author FROM ex JOIN target USING (author))
SELECT (SELECT count(*) FROM filtered_documents) AS read, count(DISTINCT pos) AS kept, (SELECT count(*) FROM target) AS wanted, count(DISTINCT author) AS found, (SELECT count(*) FROM target) - count(DISTINCT author) AS missing, count(*) AS links FROM l""")
def filter_summary(spark, d):
    return profiles.filter_summary(_pubs(spark, d), _judged(spark, d))


@query(f"""WITH {_AUTHORED}, {_SET}, l AS (SELECT DISTINCT pos, author FROM ex JOIN target USING (author)), m AS (SELECT author FROM target WHERE author NOT IN (SELECT author FROM l) ORDER BY author LIMIT 10)
SELECT (SELECT count(*) FROM filtered_documents) AS lines, CAST(0 AS BIGINT) AS invalid, count(DISTINCT pos) AS kept, (SELECT count(*) FROM target) AS wanted, count(DISTINCT author) AS found, (SELECT count(*) FROM target) - count(DISTINCT author) AS missing,
 coalesce((SELECT string_agg(author, ' | ' ORDER BY author) FROM m), '') AS examples FROM l""")
def filter_report(spark, d):
    lines = table(spark, d, "filtered_documents").agg(F.count(F.lit(1)).alias("lines"), F.lit(0).cast("long").alias("invalid"))
    return _joined(profiles.filter_report(lines, _pubs(spark, d), _judged(spark, d)))


@query(f"""WITH {_AUTHORED}, {_SET}, l AS (SELECT DISTINCT pos, author FROM ex JOIN target USING (author) WHERE {_clean('title')} <> '' OR {_clean('abstract')} <> '')
SELECT count(DISTINCT pos) AS selected, count(DISTINCT author) AS authors, count(*) AS links FROM l""")
def profile_build_counts(spark, d):
    return profiles.build_counts(_pubs(spark, d), _judged(spark, d), (X.clean_text(F.col("title")) != "") | (X.clean_text(F.col("abstract")) != ""))


@query(f"""WITH {_SET}, b AS (SELECT DISTINCT {_author('autor_id')} AS author FROM perfis_autores WHERE autor_id IS NOT NULL AND {_author('autor_id')} <> '')
SELECT author, 'left' AS side FROM target WHERE author NOT IN (SELECT author FROM b) UNION ALL SELECT author, 'right' FROM b WHERE author NOT IN (SELECT author FROM target)""")
def author_differences(spark, d):
    return guards.differences(_judged(spark, d), rankers.authors_of(table(spark, d, "perfis_autores")))


@query(f"WITH {_GOLD} SELECT * FROM gold")
def qrels_gold(spark, d):
    return judgements.gold(readers.judgement_table(spark, d))


@query(f"WITH {_GOLD}, t AS (SELECT author, tag, max(weight) AS weight, arg_min(spelling, ROW(raw, raww)) AS tag_original FROM parsed WHERE tag <> '' AND weight IN (1, 2, 3) AND author <> '' GROUP BY ALL) SELECT * FROM t")
def qrels_gold_training(spark, d):
    return judgements.gold(readers.judgement_table(spark, d), training=True)


@query(f"WITH {_GOLD} SELECT weight, count(*) AS n FROM parsed GROUP BY weight")
def qrels_histogram(spark, d):
    return judgements.histogram(readers.judgement_table(spark, d))


_OKQ = f"coalesce(regexp_full_match(weight, '\\s*[+-]?\\d+\\s*') AND {_collapse('tag')} <> '', false)"


@query(f"SELECT count(*) FILTER ({_OKQ}) AS valid, count(*) FILTER (NOT {_OKQ}) AS invalid, count(DISTINCT CASE WHEN {_OKQ} THEN {_author('author')} END) AS authors, count(DISTINCT CASE WHEN {_OKQ} THEN {_collapse('tag')} END) AS tags FROM qrels")
def qrels_statistics(spark, d):
    return judgements.statistics(readers.judgement_table(spark, d))


@query(f"SELECT regexp_replace({_strip('author')}, '(?i)^ID_', '') AS author, min({_strip('author')}) AS key FROM qrels WHERE author IS NOT NULL AND {_author('author')} <> '' GROUP BY 1")
def author_key_map(spark, d):
    t = readers.judgement_table(spark, d).withColumn("pos", X.strip(F.col("author")))
    return judgements.author_keys(t)


@query(f"""WITH {_GOLD} SELECT author, string_agg(tag, ' | ' ORDER BY weight DESC, tag) AS target_tags, coalesce(string_agg(tag, ' | ' ORDER BY tag) FILTER (weight = 3), '') AS tags_relevancia_3,
 coalesce(string_agg(tag, ' | ' ORDER BY tag) FILTER (weight = 2), '') AS tags_relevancia_2, coalesce(string_agg(tag, ' | ' ORDER BY tag) FILTER (weight = 1), '') AS tags_relevancia_1
FROM (SELECT author, tag, max(weight) AS weight FROM parsed WHERE tag <> '' AND author <> '' AND weight IN (1, 2, 3) GROUP BY ALL) GROUP BY author""")
def training_targets(spark, d):
    return _joined(judgements.training_targets(judgements.gold(readers.judgement_table(spark, d), True)).drop("target_tags_info"))


@query(f"""WITH {_TFIDF_RANK}, {_GOLD}
SELECT DISTINCT text FROM (SELECT tag AS text FROM gold UNION ALL SELECT tag FROM tfidf WHERE rank <= 20 UNION ALL SELECT {_clean('title')} FROM filtered_documents) WHERE text <> ''""")
def vocabulary(spark, d):
    top = _rank_of(spark, d, "tfidf").select("tag")
    return vectors.vocabulary(qrels_gold(spark, d).select("tag"), top, _pubs(spark, d).select(X.clean_text(F.col("title"))))


@query(f"""WITH {_TFIDF_RANK}, {_GOLD}
SELECT DISTINCT text FROM (SELECT tag AS text FROM gold UNION ALL SELECT tag FROM tfidf WHERE rank <= 20 UNION ALL SELECT unnest(string_split(pieces, ' | ')) FROM ({ORACLE_SQL['field_evidence']})) WHERE text <> ''""")
def vocabulary_evidence(spark, d):
    """With all cleaned fields of the judged authors' documents as evidence."""
    pieces = profiles.field_evidence(_pubs(spark, d), _judged(spark, d)).select(F.explode("pieces"))
    return vectors.vocabulary(qrels_gold(spark, d).select("tag"), _rank_of(spark, d, "tfidf").select("tag"), pieces)


@query(f"""WITH {_BAG}, {_GOLD}, tx AS (SELECT tag AS text FROM gold WHERE tag <> '' UNION SELECT ngram FROM bag WHERE ngram <> ''),
wd AS (SELECT text, generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM (SELECT text, list_filter(string_split_regex(lower(text), '{WS}+'), lambda q: q <> '') AS ws FROM tx)),
gr AS (SELECT text, k, unnest(list_distinct(list_append(list_transform(range(1, length(w) + 1), lambda z: substr(' ' || w || ' ', z, 3)), w))) AS gram FROM wd),
dm AS (SELECT text, CAST(h % 64 AS INT) AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM (SELECT text, CAST('0x' || substr(md5(gram), 1, 8) AS UBIGINT) AS h FROM gr) GROUP BY ALL)
SELECT text, d, round(x / n, 5) AS x FROM dm JOIN (SELECT text, sqrt(sum(x * x)) AS n FROM dm GROUP BY text) USING (text) WHERE x <> 0""")
def embed_vocabulary(spark, d):
    """A row for each place of a vector that is not 0."""
    e = vectors.embed(vectors.vocabulary(qrels_gold(spark, d).select("tag"), _bag(spark, d).select("ngram"), ordered=False))
    return e.select("text", F.posexplode("emb").alias("d", "x")).where("x <> 0").select("text", "d", F.round(F.col("x").cast("double"), 5).alias("x"))


# vectors, matching and metrics -------------------------------------------------------------------------


def _pred(spark, d):
    e = table(spark, d, "embeddings").where("vec_id % 2 = 0")
    i = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("string").alias("author"), i.alias("i"), F.concat(F.lit("p"), "vec_id").alias("tag"), F.col("embedding").alias("vector")).where(F.col("i") < vectors.TOP)


def _vgold(spark, d):
    e = table(spark, d, "embeddings").where("vec_id % 2 = 1")
    return vectors.gold_order(e.select(F.col("label").cast("string").alias("author"), F.concat(F.lit("g"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("tag"), (1 + F.col("vec_id") % 3).cast("int").alias("weight"), F.col("embedding").alias("vector")))


def _pairs(spark, d, theta=None):
    return vectors.similarities(_pred(spark, d), _vgold(spark, d), ["j", "tag", "weight"], theta)


_VEC = """p AS (SELECT CAST(label AS VARCHAR) AS author, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS i, 'p' || vec_id AS tag, embedding AS v FROM embeddings WHERE vec_id % 2 = 0 QUALIFY i < 20),
g AS (SELECT CAST(label AS VARCHAR) AS author, 'g' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS tag, CAST(1 + vec_id % 3 AS INT) AS weight, embedding AS v,
  CAST(row_number() OVER (PARTITION BY label ORDER BY 1 + vec_id % 3 DESC, 'g' || lpad(CAST(vec_id AS VARCHAR), 6, '0')) - 1 AS INT) AS j FROM embeddings WHERE vec_id % 2 = 1),
pr AS (SELECT p.author, i, j, g.tag, weight, list_dot_product(CAST(p.v AS DOUBLE[]), CAST(g.v AS DOUBLE[])) AS sim FROM p JOIN g USING (author))"""


def _greedy_sql(theta):
    return f"""c AS (SELECT author, i, j, sim, weight, row_number() OVER (PARTITION BY author ORDER BY sim DESC, i, j) AS r FROM pr WHERE sim >= {theta} AND sim > 0),
walk(author, r, pi, gj, hit) AS (
  SELECT DISTINCT author, CAST(0 AS BIGINT), CAST([] AS INT[]), CAST([] AS INT[]), false FROM c
  UNION ALL
  SELECT w.author, c.r, CASE WHEN ok THEN list_append(w.pi, c.i) ELSE w.pi END, CASE WHEN ok THEN list_append(w.gj, c.j) ELSE w.gj END, ok
  FROM walk w JOIN c ON c.author = w.author AND c.r = w.r + 1, LATERAL (SELECT NOT list_contains(w.pi, c.i) AND NOT list_contains(w.gj, c.j) AS ok)),
m AS (SELECT c.author, c.i, c.j, c.sim, c.weight FROM walk w JOIN c USING (author, r) WHERE w.hit),
mw AS (SELECT p.author, p.i + 1 AS rank, coalesce(m.weight, 0) AS weight FROM p LEFT JOIN m USING (author, i))"""


_MATCHED = f"WITH RECURSIVE {_VEC}, {_greedy_sql(THETA)}"


@query(f"WITH {_VEC} SELECT author, i, j, tag, weight, round(sim, 6) AS sim FROM pr")
def similarity_pairs(spark, d):
    return _pairs(spark, d).withColumn("sim", F.round("sim", 6))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot_product(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(vectors.dot(F.col("x"), F.col("y")), 6).alias("sim"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, 1.0::DOUBLE AS after FROM embeddings")
def l2_normalize(spark, d):
    e = table(spark, d, "embeddings").withColumn("u", vectors.normalised(F.transform("embedding", lambda x: x * 3)))
    n = lambda c: F.sqrt(vectors.dot(F.col(c), F.col(c)))
    return e.select("vec_id", F.round(n("embedding"), 5).alias("norm"), F.round(n("u"), 5).alias("after"))


def _matches(spark, d, theta=THETA):
    return matching.greedy(_pairs(spark, d, theta), theta)


def _matched(spark, d):
    return matching.ranked_matches(_pred(spark, d), _matches(spark, d), _vgold(spark, d))


@query(_MATCHED + " SELECT author, i, j, round(sim, 6) AS sim FROM m")
def greedy_match(spark, d):
    return _matches(spark, d).withColumn("sim", F.round("sim", 6))


@query(f"WITH RECURSIVE {_VEC}, {_greedy_sql(0.75)} SELECT author, i, j, round(sim, 6) AS sim FROM m")
def greedy_match_strict(spark, d):
    return _matches(spark, d, 0.75).withColumn("sim", F.round("sim", 6))


@query(_MATCHED + """, best AS (SELECT author, i, tag AS bg, sim AS bs FROM pr QUALIFY row_number() OVER (PARTITION BY author, i ORDER BY sim DESC, j) = 1),
slots AS (SELECT author, CAST(unnest(range(20)) AS INT) AS i FROM (SELECT DISTINCT author FROM p))
SELECT 'ID_' || s.author AS Autor, s.i + 1 AS Rank, coalesce(p.tag, '') AS Tag_Predita, CASE WHEN m.j IS NOT NULL THEN g.tag WHEN p.tag IS NOT NULL AND bg IS NOT NULL THEN bg || ' (rej)' ELSE '' END AS Melhor_Match_Gabarito,
 round(coalesce(m.sim, bs), 3) AS Similaridade, CASE WHEN p.tag IS NOT NULL THEN coalesce(m.weight, 0) END AS Peso, CASE WHEN m.j IS NOT NULL THEN 'match' WHEN p.tag IS NOT NULL THEN 'sem match válido' ELSE '' END AS Match_Status, 'vectors' AS Modelo
FROM slots s LEFT JOIN p USING (author, i) LEFT JOIN m USING (author, i) LEFT JOIN g ON g.author = m.author AND g.j = m.j LEFT JOIN best b ON b.author = s.author AND b.i = s.i""")
def match_audit(spark, d):
    return matching.audit(_pred(spark, d), matching.nearest(_pairs(spark, d)), _matches(spark, d), _vgold(spark, d), "vectors")


def _metric_sql(cols):
    parts, ks = [], (5, 10, 20)
    for k in ks:
        parts.append(f"""sum(CASE WHEN rank <= {k} AND weight > 0 THEN (pow(2, weight) - 1) / log2(rank + 1) ELSE 0 END) AS dcg_{k}, sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS hit_{k},
 sum(CASE WHEN rank <= {k} THEN hit * hits / rank ELSE 0 END) AS ap_{k}, CAST(sum(CASE WHEN rank <= {k} AND weight >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS mv_{k}""")
    own = "own AS (SELECT author, " + ", ".join(parts) + " FROM (SELECT *, sum(hit) OVER (PARTITION BY author ORDER BY rank) AS hits FROM (SELECT *, CAST(weight >= 2 AS INT) AS hit FROM mw)) GROUP BY author)"
    ideal = "ideal AS (SELECT author, " + ", ".join(f"sum(CASE WHEN r <= {k} AND weight > 0 THEN (pow(2, weight) - 1) / log2(r + 1) ELSE 0 END) AS idcg_{k}" for k in ks) + ", count(*) FILTER (weight >= 2) AS relevant FROM (SELECT author, weight, row_number() OVER (PARTITION BY author ORDER BY weight DESC) AS r FROM g) GROUP BY author)"
    out = {}
    for k in ks:
        out |= {f"ndcg_{k}": f"CASE WHEN idcg_{k} > 0 THEN dcg_{k} / idcg_{k} ELSE 0 END", f"p_{k}": f"hit_{k} / {k}", f"r_{k}": f"CASE WHEN relevant > 0 THEN hit_{k} / relevant ELSE 0 END", f"map_{k}": f"CASE WHEN relevant > 0 THEN ap_{k} / relevant ELSE 0 END", f"mv_{k}": f"mv_{k}"}
    return f", {own}, {ideal}", [(c, e) for c, e in out.items() if any(c.startswith(x) for x in cols)]


def _metric_query(*cols):
    ctes, sel = _metric_sql(cols)
    return _MATCHED + ctes + " SELECT author, " + ", ".join(f"round({e}, 6) AS {c}" if not c.startswith("mv") else f"{e} AS {c}" for c, e in sel) + " FROM own JOIN ideal USING (author)"


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _ranking_metrics(spark, d, *cols):
    m = metrics.ranking_metrics(_matched(spark, d), _vgold(spark, d))
    return _rounded(m.select("author", *[c for c in m.columns if any(c.startswith(x) for x in cols)]))


@query(_metric_query("ndcg"))
def ndcg(spark, d):
    return _ranking_metrics(spark, d, "ndcg")


@query(_metric_query("p_", "r_", "mv"))
def precision_recall(spark, d):
    return _ranking_metrics(spark, d, "p_", "r_", "mv")


@query(_metric_query("map"))
def map_at_k(spark, d):
    return _ranking_metrics(spark, d, "map")


_DIV = "dv AS (SELECT author, " + ", ".join(f"coalesce(1 - sum(s) FILTER (a < {k} AND b < {k}) / nullif(count(*) FILTER (a < {k} AND b < {k}), 0), 0) AS d_{k}" for k in (10, 20)) + " FROM (SELECT x.author, x.i AS a, y.i AS b, list_dot_product(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])) AS s FROM p x JOIN p y ON x.author = y.author AND x.i <> y.i) GROUP BY author)"


@query(f"WITH {_VEC}, {_DIV} SELECT author, round(d_10, 5) AS d_10, round(d_20, 5) AS d_20 FROM dv")
def diversity(spark, d):
    return _rounded(metrics.diversity(_pred(spark, d)), 5)


_m_ctes, _m_sel = _metric_sql(("ndcg", "p_", "r_", "map", "mv"))


@query(_MATCHED + _m_ctes + f", {_DIV} SELECT count(*) AS authors, " + ", ".join(f"round(avg({e}), 6) AS {c}" for c, e in _m_sel) + ", round(avg(d_10), 5) AS d_10, round(avg(d_20), 5) AS d_20 FROM own JOIN ideal USING (author) LEFT JOIN dv USING (author)")
def macro_metrics(spark, d):
    m = metrics.author_metrics(metrics.ranking_metrics(_matched(spark, d), _vgold(spark, d)), metrics.diversity(_pred(spark, d)))
    x = metrics.macro(m)
    return x.select(*[F.round(c, 5 if c.startswith("d_") else 6).alias(c) if c != "authors" else F.col(c) for c in x.columns])


def _docs(spark, d):
    a = X.author_id(F.col("autor_id"))
    return table(spark, d, "perfis_autores").where("autor_id is not null and pub_id is not null").select(a.alias("author"), F.col("pub_id").alias("doc_id"), "ngramas").where("author <> ''")


_DOCS = f"docs AS (SELECT {_author('autor_id')} AS author, pub_id AS doc_id, ngramas FROM perfis_autores WHERE autor_id IS NOT NULL AND pub_id IS NOT NULL AND {_author('autor_id')} <> '')"
_EXACT = f"""{_TFIDF_RANK}, {_DOCS}, dd AS (SELECT DISTINCT author, doc_id FROM docs), hit AS (SELECT author, doc_id, min(rank) AS fr FROM (SELECT author, doc_id, unnest(ngramas) AS tag FROM docs) JOIN tfidf USING (author, tag) WHERE rank <= 20 GROUP BY ALL)"""


def _exact(spark, d):
    return metrics.covered_exactly(_docs(spark, d), _rank_of(spark, d, "tfidf"))


@query(f"WITH {_EXACT} SELECT author, round(avg(CASE WHEN fr <= 10 THEN 1.0 ELSE 0.0 END), 6) AS c_10, round(avg(CASE WHEN fr <= 20 THEN 1.0 ELSE 0.0 END), 6) AS c_20 FROM dd LEFT JOIN hit USING (author, doc_id) GROUP BY author")
def coverage_exact(spark, d):
    x = _exact(spark, d).groupBy("author")
    return x.agg(*[F.round(F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0))), 6).alias(f"c_{k}") for k in (10, 20)])


def _field_vectors(spark, d):
    """Fields of documents as vectors: documents are gold vectors' ids modulo 7, two fields or more each."""
    return _vgold(spark, d).withColumn("doc_id", F.concat(F.lit("d"), (F.regexp_extract("tag", r"(\d+)", 1).cast("int") % 7).cast("string"))).select("author", "doc_id", "vector")


_CSQL = f"""{_VEC}, f AS (SELECT pr.author, 'd' || (CAST(regexp_extract(tag, '(\\d+)', 1) AS INT) % 7) AS doc_id, i, sim FROM pr),
sc AS (SELECT author, doc_id, max(sim) FILTER (i < 10) AS s10, max(sim) FILTER (i < 20) AS s20 FROM f GROUP BY ALL)"""


def _scores(spark, d):
    fields = _field_vectors(spark, d)
    exact = fields.select("author", "doc_id").distinct().withColumn("first_rank", F.when(F.col("doc_id") == "d3", 15))
    return metrics.document_scores(exact, vectors.similarities(_pred(spark, d), fields, ["doc_id"]))


_SCORE = "CASE WHEN doc_id = 'd3' AND {k} >= 15 THEN 'Infinity'::DOUBLE ELSE s{k} END"


@query(f"WITH {_CSQL} SELECT author, round(avg(CAST({_SCORE.format(k=10)} >= {THETA} AS INT)), 6) AS c_10, round(avg(CAST({_SCORE.format(k=20)} >= {THETA} AS INT)), 6) AS c_20 FROM sc GROUP BY author")
def coverage_semantic(spark, d):
    return _rounded(metrics.coverage(_scores(spark, d), THETA))


@query(f"""WITH {_CSQL}, o AS (SELECT theta, author, avg(CAST({_SCORE.format(k=10)} >= theta AS INT)) AS c_10, avg(CAST({_SCORE.format(k=20)} >= theta AS INT)) AS c_20 FROM sc, (SELECT CAST(unnest({list(THETAS)}) AS DOUBLE) AS theta) GROUP BY ALL)
SELECT theta, count(*) AS authors, round(avg(c_10), 6) AS c_10, round(avg(c_20), 6) AS c_20 FROM o GROUP BY theta""")
def theta_sweep_coverage(spark, d):
    return _rounded(analysis.sweep_coverage(_scores(spark, d), THETAS))


def _sweep_sql():
    ctes, sel = _metric_sql(("ndcg", "p_", "r_", "map", "mv"))
    one = []
    for t in THETAS:
        one.append(f"SELECT {t}::DOUBLE AS theta, * FROM (WITH RECURSIVE {_VEC}, {_greedy_sql(t)}{ctes} SELECT count(*) AS authors, " + ", ".join(f"round(avg({e}), 6) AS {c}" for c, e in sel) + " FROM own JOIN ideal USING (author))")
    return " UNION ALL ".join(one)


@query(_sweep_sql())
def theta_sweep_matching(spark, d):
    return _rounded(analysis.sweep_matching(_pairs(spark, d, min(THETAS)), _pred(spark, d), _vgold(spark, d), THETAS))


def _hashed_sql(texts):
    """un: the vector of each text of `texts`, by the hashing rule."""
    return f"""wd AS (SELECT text, generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM (SELECT text, list_filter(string_split_regex(lower(text), '{WS}+'), lambda q: q <> '') AS ws FROM ({texts}))),
gr AS (SELECT text, k, unnest(list_distinct(list_append(list_transform(range(1, length(w) + 1), lambda z: substr(' ' || w || ' ', z, 3)), w))) AS gram FROM wd),
dm AS (SELECT text, h % 64 AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM (SELECT text, CAST('0x' || substr(md5(gram), 1, 8) AS UBIGINT) AS h FROM gr) GROUP BY ALL),
un AS (SELECT text, d, CAST(CAST(x / n AS FLOAT) AS DOUBLE) AS x FROM dm JOIN (SELECT text, sqrt(sum(x * x)) AS n FROM dm GROUP BY text HAVING sum(x * x) > 0) USING (text))"""


_FIELD_SQL = f"""WITH {_EXACT}, {_SET}, ft AS (SELECT DISTINCT author, doc_id, unnest(string_split(pieces, ' | ')) AS text FROM ({ORACLE_SQL['field_evidence']})), pt AS (SELECT author, rank - 1 AS i, tag FROM tfidf WHERE rank <= 20),
{_hashed_sql('SELECT text FROM ft UNION SELECT tag FROM pt')},
sm AS (SELECT author, doc_id, max(sim) FILTER (i < 10) AS s10, max(sim) AS s20 FROM (SELECT p.author, f.doc_id, p.i, f.text, coalesce(sum(a.x * b.x), 0) AS sim FROM pt p JOIN ft f USING (author) LEFT JOIN un a ON a.text = p.tag LEFT JOIN un b ON b.text = f.text AND b.d = a.d GROUP BY ALL) GROUP BY ALL),
fs AS (SELECT author, doc_id, CASE WHEN fr <= 10 THEN 'Infinity'::DOUBLE ELSE s10 END AS s10, CASE WHEN fr <= 20 THEN 'Infinity'::DOUBLE ELSE s20 END AS s20 FROM dd JOIN target USING (author) LEFT JOIN hit USING (author, doc_id) LEFT JOIN sm USING (author, doc_id))"""


def _field_scores(spark, d):
    """Documents by their n-grams, with the fields of those that no prediction names: a document without fields stays."""
    docs = _docs(spark, d).join(_judged(spark, d), "author", "left_semi")
    top = _rank_of(spark, d, "tfidf")
    fields = profiles.field_evidence(_pubs(spark, d), _judged(spark, d)).select("author", "doc_id", F.explode("pieces").alias("text"))
    words = vectors.embed(vectors.vocabulary(fields.select("text"), top.select("tag"), ordered=False))
    pred = vectors.lookup(top.select("author", (F.col("rank") - 1).alias("i"), "tag"), "tag", words, 64)
    return metrics.document_scores(metrics.covered_exactly(docs, top), vectors.similarities(pred, vectors.lookup(fields, "text", words, 64), ["doc_id"]))


@query(_FIELD_SQL + " SELECT author, round(avg(CASE WHEN s10 >= 0.35 THEN 1.0 ELSE 0.0 END), 6) AS c_10, round(avg(CASE WHEN s20 >= 0.35 THEN 1.0 ELSE 0.0 END), 6) AS c_20 FROM fs GROUP BY author")
def coverage_fields(spark, d):
    """Coverage of real documents. The threshold suits the hashing embedder, whose long texts are alike to little."""
    return _rounded(metrics.coverage(_field_scores(spark, d), 0.35))


@query(_FIELD_SQL + f""", o AS (SELECT theta, author, avg(CASE WHEN s10 >= theta THEN 1.0 ELSE 0.0 END) AS c_10, avg(CASE WHEN s20 >= theta THEN 1.0 ELSE 0.0 END) AS c_20 FROM fs, (SELECT CAST(unnest({list(THETAS)}) AS DOUBLE) AS theta) GROUP BY ALL)
SELECT theta, count(*) AS authors, round(avg(c_10), 6) AS c_10, round(avg(c_20), 6) AS c_20 FROM o GROUP BY theta""")
def theta_sweep_fields(spark, d):
    return _rounded(analysis.sweep_coverage(_field_scores(spark, d), THETAS))


# systems by area: POP against TF-IDF, the share of gold tags among the first ten ---------------------------


def _areas(spark, d):
    """author, area: the area that most of an author's publications name, by name on ties."""
    x = profiles.exploded(_pubs(spark, d).select("areas", "authors")).select("author", F.explode("areas").alias("a")).select("author", F.col("a.area").alias("area")).where("area is not null")
    n = x.groupBy("author", "area").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("author").agg(F.min(F.struct((-F.col("n")).alias("k"), "area")).alias("m")).select("author", "m.area")


_AREA = f"ar AS (SELECT author, area FROM (SELECT author, area, count(*) AS n FROM (SELECT author, unnest(areas).area AS area FROM (SELECT areas, unnest(list_distinct(list_filter(list_transform(authors, lambda z: {_author('z')}), lambda z: z <> ''))) AS author FROM filtered_documents)) WHERE area IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, area) = 1)"


def _hits(ranking, k=10):
    """author, score: the share of an author's first k tags of two words or more."""
    return ranking.where(F.col("rank") <= k).groupBy("author").agg((F.count_if(F.col("tag").contains(" ")) / k).alias("score"))


def _compared(spark, d):
    return analysis.compare(_hits(_rank_of(spark, d, "pop")), _hits(_rank_of(spark, d, "tfidf")), _areas(spark, d), "score")


_CMP = f"""{_TFIDF_RANK}, popr AS (SELECT author, row_number() OVER (PARTITION BY author ORDER BY freq DESC, ngram) AS rank, ngram AS tag FROM bag), {_AREA},
ha AS (SELECT author, count(*) FILTER (contains(tag, ' ')) / 10 AS score_a FROM popr WHERE rank <= 10 GROUP BY author), hb AS (SELECT author, count(*) FILTER (contains(tag, ' ')) / 10 AS score_b FROM tfidf WHERE rank <= 10 GROUP BY author),
cmp AS (SELECT author, area, score_a, score_b, score_a - score_b AS delta, CASE WHEN abs(score_a - score_b) < 0.01 THEN 'tie' WHEN score_a > score_b THEN 'win' ELSE 'loss' END AS outcome FROM ha JOIN hb USING (author) JOIN ar USING (author))"""


@query(f"WITH {_CMP} SELECT area, count(*) AS authors, round(avg(score_a), 6) AS mean_a, round(avg(score_b), 6) AS mean_b, round(avg(score_a) - avg(score_b), 6) AS delta, CASE WHEN avg(score_a) - avg(score_b) > 0 THEN 'pop' ELSE 'tfidf' END AS winner FROM cmp GROUP BY area")
def delta_by_area(spark, d):
    return _rounded(analysis.by_area(_compared(spark, d), "score", ("pop", "tfidf")))


@query(f"""WITH {_CMP}, c AS (SELECT area, count(*) FILTER (outcome = 'win') AS win, count(*) FILTER (outcome = 'tie') AS tie, count(*) FILTER (outcome = 'loss') AS loss, count(*) AS total FROM cmp GROUP BY area)
SELECT *, round(100 * win / total, 6) AS win_pct, round(100 * tie / total, 6) AS tie_pct, round(100 * loss / total, 6) AS loss_pct FROM c""")
def win_tie_loss_pivot(spark, d):
    return _rounded(analysis.outcomes(_compared(spark, d)))


@query(f"WITH {_CMP} SELECT author, area, round(score_a - score_b, 6) AS delta, CAST(row_number() OVER (ORDER BY score_a - score_b DESC, author) AS INT) AS place FROM cmp")
def delta_order(spark, d):
    return _rounded(analysis.delta_order(_compared(spark, d)).select("author", "area", "delta", "place"))


@query(f"WITH {_AREA} SELECT area, count(DISTINCT author) AS authors FROM ar GROUP BY area ORDER BY authors DESC, area LIMIT 10")
def top_areas(spark, d):
    return analysis.top_areas(_areas(spark, d), 10)


@query(f"WITH {_CMP} SELECT area, count(DISTINCT author) AS authors FROM cmp GROUP BY area ORDER BY authors DESC, area LIMIT 10")
def top_areas_joined(spark, d):
    return analysis.top_areas(_compared(spark, d).select("author", "area"), 10)


@query(f"WITH {_AREA} SELECT area, count(DISTINCT author) AS authors FROM ar GROUP BY area HAVING count(DISTINCT author) >= 10")
def areas_min10(spark, d):
    return analysis.areas_of_at_least(_areas(spark, d), 10)


@query(f"""WITH {_AUTHORED}, c AS (SELECT author, count(*) AS n FROM ex GROUP BY author)
SELECT count(n) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, min(n) AS least, {", ".join(f"round(quantile_cont(n, 0.{p}), 6) AS p{p}" for p in (25, 50, 75, 90, 95))}, max(n) AS greatest FROM c""")
def publication_distribution(spark, d):
    n = profiles.exploded(_pubs(spark, d).select("authors")).groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(analysis.distribution(n, "n"))


# the same comparison by matched tags: systems are evaluated at the production threshold -------------------

_SYSTEMS = {"pop": "SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY freq DESC, ngram) AS INT) AS rank, ngram AS tag FROM bag", "tfidf": "SELECT author, rank, tag FROM tfidf", "given": f"""SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY score DESC, tag) AS INT) AS rank, tag FROM (SELECT author, tag, max(n - pos) AS score FROM
 (SELECT author, {_collapse('t')} AS tag, pos, n FROM (SELECT author, unnest(tags) AS t, generate_subscripts(tags, 1) - 1 AS pos, len(tags) AS n FROM (SELECT {_author('author_id')} AS author, target_tags AS tags FROM dataset_treino_1001_autores))) WHERE tag <> '' GROUP BY ALL)"""}


def _tag_vec(system):
    """p, g and pr of one system, vectors made by the hashing rule."""
    return f"""{_TFIDF_RANK}, {_GOLD}, pt AS (SELECT author, rank - 1 AS i, tag FROM ({_SYSTEMS[system]}) WHERE rank <= 20),
gt AS (SELECT author, tag, weight, CAST(row_number() OVER (PARTITION BY author ORDER BY weight DESC, tag) - 1 AS INT) AS j FROM gold),
wd AS (SELECT text, generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM (SELECT text, list_filter(string_split_regex(lower(text), '{WS}+'), lambda q: q <> '') AS ws FROM (SELECT tag AS text FROM pt UNION SELECT tag FROM gt))),
gr AS (SELECT text, k, unnest(list_distinct(list_append(list_transform(range(1, length(w) + 1), lambda z: substr(' ' || w || ' ', z, 3)), w))) AS gram FROM wd),
dm AS (SELECT text, h % 64 AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM (SELECT text, CAST('0x' || substr(md5(gram), 1, 8) AS UBIGINT) AS h FROM gr) GROUP BY ALL),
un AS (SELECT text, d, CAST(CAST(CAST(x / n AS FLOAT) AS DOUBLE) AS DOUBLE) AS x FROM dm JOIN (SELECT text, sqrt(sum(x * x)) AS n FROM dm GROUP BY text HAVING sum(x * x) > 0) USING (text)),
pr AS (SELECT p.author, i, j, g.tag, weight, coalesce(sum(a.x * b.x), 0) AS sim FROM pt p JOIN gt g USING (author) LEFT JOIN un a ON a.text = p.tag LEFT JOIN un b ON b.text = g.tag AND b.d = a.d GROUP BY ALL),
p AS (SELECT * FROM pt), g AS (SELECT * FROM gt)"""


def _tag_metrics_sql(system, cols, theta=0.75):
    ctes, sel = _metric_sql(cols)
    return f"WITH RECURSIVE {_tag_vec(system)}, {_greedy_sql(theta)}{ctes} SELECT author, " + ", ".join(f"{e} AS {c}" for c, e in sel) + " FROM own JOIN ideal USING (author)"


def _rank_of(spark, d, system):
    if system == "given":
        return positional_ranking(spark, d)
    return rankers.pop(_bag(spark, d), 20) if system == "pop" else rankers.tfidf(_bag(spark, d), _total(spark, d), 20)


def _tag_sides(spark, d, system):
    pred = _rank_of(spark, d, system).where("rank <= 20").select("author", (F.col("rank") - 1).alias("i"), "tag")
    gold = qrels_gold(spark, d).select("author", "tag", "weight")
    words = vectors.embed(vectors.vocabulary(pred.select("tag"), gold.select("tag"), ordered=False))
    return vectors.lookup(pred, "tag", words, 64), vectors.gold_order(vectors.lookup(gold, "tag", words, 64))


def _tag_matches(spark, d, system, theta=0.75):
    pred, gold = _tag_sides(spark, d, system)
    return pred, gold, matching.greedy(vectors.similarities(pred, gold, ["j"], theta), theta)


def _tag_metrics(spark, d, system):
    pred, gold, m = _tag_matches(spark, d, system)
    return metrics.ranking_metrics(matching.ranked_matches(pred, m, gold), gold)


@query(f"WITH RECURSIVE {_tag_vec('tfidf')}, {_greedy_sql(0.75)} SELECT author, i, j, round(sim, 5) AS sim FROM m")
def tag_match_tfidf(spark, d):
    return _tag_matches(spark, d, "tfidf")[2].withColumn("sim", F.round("sim", 5))


@query(f"WITH RECURSIVE {_tag_vec('given')}, {_greedy_sql(0.75)} SELECT author, i, j, round(sim, 5) AS sim FROM m")
def tag_match_given(spark, d):
    return _tag_matches(spark, d, "given")[2].withColumn("sim", F.round("sim", 5))


_ALL = ("ndcg", "p_", "r_", "map", "mv")


@query("SELECT author, " + ", ".join(f"round({c}, 6) AS {c}" if not c.startswith("mv") else c for c, _ in _metric_sql(_ALL)[1]) + f" FROM ({_tag_metrics_sql('given', _ALL)})")
def tag_metrics_given(spark, d):
    return _rounded(_tag_metrics(spark, d, "given"))


@query("SELECT author, " + ", ".join(f"round({c}, 6) AS {c}" if not c.startswith("mv") else c for c, _ in _metric_sql(_ALL)[1]) + f" FROM ({_tag_metrics_sql('tfidf', _ALL)})")
def tag_metrics_tfidf(spark, d):
    return _rounded(_tag_metrics(spark, d, "tfidf"))


_NDCG = f"""WITH sa AS (SELECT author, ndcg_10 AS score_a FROM ({_tag_metrics_sql('pop', ('ndcg',))})), sb AS (SELECT author, ndcg_10 AS score_b FROM ({_tag_metrics_sql('tfidf', ('ndcg',))})), {_AREA},
cmp AS (SELECT author, area, score_a, score_b, CASE WHEN abs(score_a - score_b) < 0.01 THEN 'tie' WHEN score_a > score_b THEN 'win' ELSE 'loss' END AS outcome FROM sa JOIN sb USING (author) JOIN ar USING (author))"""


def _ndcg_compared(spark, d):
    a, b = (_tag_metrics(spark, d, k).select("author", F.col("ndcg_10").alias("score")) for k in ("pop", "tfidf"))
    return analysis.compare(a, b, _areas(spark, d), "score")


@query(_NDCG + " SELECT area, count(*) AS authors, round(avg(score_a), 6) AS mean_a, round(avg(score_b), 6) AS mean_b, round(avg(score_a) - avg(score_b), 6) AS delta, CASE WHEN avg(score_a) - avg(score_b) > 0 THEN 'pop' ELSE 'tfidf' END AS winner FROM cmp GROUP BY area")
def ndcg_delta_by_area(spark, d):
    return _rounded(analysis.by_area(_ndcg_compared(spark, d), "score", ("pop", "tfidf")))


@query(_NDCG + """, c AS (SELECT area, count(*) FILTER (outcome = 'win') AS win, count(*) FILTER (outcome = 'tie') AS tie, count(*) FILTER (outcome = 'loss') AS loss, count(*) AS total FROM cmp GROUP BY area)
SELECT *, round(100 * win / total, 6) AS win_pct, round(100 * tie / total, 6) AS tie_pct, round(100 * loss / total, 6) AS loss_pct FROM c""")
def ndcg_win_tie_loss(spark, d):
    return _rounded(analysis.outcomes(_ndcg_compared(spark, d)))


@query(f"""WITH {_AREA}, a AS ({" UNION ALL ".join(f"SELECT '{k}' AS system, author, ndcg_10 AS score FROM ({_tag_metrics_sql(k, ('ndcg',))})" for k in _SYSTEMS)}),
m AS (SELECT area, {", ".join(f"round(avg(score) FILTER (system = '{k}'), 6) AS {k}" for k in _SYSTEMS)} FROM a JOIN ar USING (author) GROUP BY area)
SELECT area, CASE WHEN pop = greatest(pop, tfidf, given) THEN 'pop' WHEN tfidf = greatest(pop, tfidf, given) THEN 'tfidf' ELSE 'given' END AS best, greatest(pop, tfidf, given) AS value FROM m""")
def ndcg_best_system(spark, d):
    """Three systems that are all real rankings: counts, TF-IDF and the given tags in their order."""
    one = [_tag_metrics(spark, d, k).select("author", F.lit(k).alias("system"), F.col("ndcg_10").alias("score")) for k in _SYSTEMS]
    rows = one[0].unionAll(one[1]).unionAll(one[2]).join(_areas(spark, d), "author")
    return analysis.best_system(rows.groupBy("area").agg(*[F.round(F.avg(F.when(F.col("system") == k, F.col("score"))), 6).alias(k) for k in _SYSTEMS]), list(_SYSTEMS))


@query(_MATCHED + _m_ctes + f", {_DIV}, {_CSQL[len(_VEC) + 2 :]}, cv AS (SELECT author, avg(CAST({_SCORE.format(k=10)} >= {THETA} AS INT)) AS c_10, avg(CAST({_SCORE.format(k=20)} >= {THETA} AS INT)) AS c_20 FROM sc GROUP BY author), mt AS (SELECT author, " + ", ".join(f"{e} AS {c}" for c, e in _m_sel)
 + """ FROM own JOIN ideal USING (author))
SELECT 'ID_' || author AS "Autor", round(ndcg_10, 5) AS "nDCG@10", round(ndcg_20, 5) AS "nDCG@20", round(p_5, 5) AS "Precision@5", round(p_10, 5) AS "Precision@10", round(p_20, 5) AS "Precision@20", round(r_5, 5) AS "Recall@5", round(r_10, 5) AS "Recall@10", round(r_20, 5) AS "Recall@20",
 round(map_10, 5) AS "MAP@10", round(coalesce(c_10, 0), 5) AS "Coverage@10", round(coalesce(d_10, 0), 5) AS "Diversity@10", round(map_20, 5) AS "MAP@20", round(coalesce(c_20, 0), 5) AS "Coverage@20", round(coalesce(d_20, 0), 5) AS "Diversity@20", mv_10 AS "Match_Valido@10", mv_20 AS "Match_Valido@20", 'vectors' AS "Modelo"
FROM mt LEFT JOIN cv USING (author) LEFT JOIN dv USING (author)""")
def author_metrics_file(spark, d):
    ranking = metrics.ranking_metrics(_matched(spark, d), _vgold(spark, d))
    m = metrics.author_table(ranking, metrics.coverage(_scores(spark, d), THETA), metrics.diversity(_pred(spark, d)), "vectors")
    return m.select(*[F.round(F.col(f"`{c}`"), 5).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in m.dtypes])


@query("""WITH a AS (SELECT pub_year, unnest(areas).general_area AS area FROM filtered_documents)
SELECT area, min(pub_year) AS first_year, max(pub_year) AS last_year, count(pub_year) AS with_year, count(*) FILTER (pub_year IS NULL) AS without_year, max(pub_year) - min(pub_year) + 1 AS span FROM a WHERE area IS NOT NULL GROUP BY area""")
def period_by_area(spark, d):
    rows = _pubs(spark, d).select("pub_year", F.explode("areas").alias("a")).select("pub_year", F.col("a.general_area").alias("area")).where("area is not null")
    return analysis.period(rows, "area", "pub_year")


@query(f"""WITH {_CMP}, m AS (SELECT area, round(avg(score_a), 6) AS pop, round(avg(score_b), 6) AS tfidf, round(avg(greatest(score_a, score_b)), 6) * 0.9 AS mixed FROM cmp GROUP BY area)
SELECT area, CASE WHEN pop = greatest(pop, tfidf, mixed) THEN 'pop' WHEN tfidf = greatest(pop, tfidf, mixed) THEN 'tfidf' ELSE 'mixed' END AS best, round(greatest(pop, tfidf, mixed), 6) AS value FROM m""")
def best_system(spark, d):
    m = _compared(spark, d).groupBy("area").agg(F.round(F.avg("score_a"), 6).alias("pop"), F.round(F.avg("score_b"), 6).alias("tfidf"), (F.round(F.avg(F.greatest("score_a", "score_b")), 6) * 0.9).alias("mixed"))
    return _rounded(analysis.best_system(m, ["pop", "tfidf", "mixed"]))


@query(f"""WITH {_AUTHORED}, e AS (SELECT author, pos, f.pub_year FROM ex JOIN filtered_documents f ON f.rec_id = pos)
SELECT author, pos, CAST(row_number() OVER (PARTITION BY author ORDER BY pub_year DESC NULLS LAST, pos) AS INT) AS recency FROM e QUALIFY recency <= 30""")
def recency_topn(spark, d):
    x = profiles.exploded(_pubs(spark, d).select("pos", "pub_year", "authors"))
    r = F.row_number().over(Window.partitionBy("author").orderBy(F.desc_nulls_last("pub_year"), "pos"))
    return x.select("author", "pos", r.alias("recency")).where("recency <= 30")


@query(f"""WITH t AS (SELECT doc_kind, author_id, doc_id FROM documents WHERE length({_strip("coalesce(text, '')")}) > 0 AND author_id IS NOT NULL)
SELECT author_id, doc_kind || '_' || lpad(CAST(row_number() OVER (PARTITION BY author_id, doc_kind ORDER BY doc_id) - 1 AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (PARTITION BY author_id, doc_kind ORDER BY doc_id) - 1 AS VARCHAR))) AS INT), '0') AS unit, doc_id FROM t""")
def unit_numbering(spark, d):
    t = table(spark, d, "documents").where("author_id is not null").where(F.length(X.clean_field(F.col("text"))) > 0)
    t = ordering.numbered(t.select("author_id", "doc_kind", "doc_id"), "n", ["author_id", "doc_kind"], {"_range": (F.floor(F.col("doc_id") / 65536), False)}, ["doc_id"])
    n = (F.col("n") - 1).cast("string")
    return t.select("author_id", F.concat("doc_kind", F.lit("_"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)).alias("unit"), "doc_id")


@query(f"""WITH p AS (SELECT rec, author, i, {_clean('x.titulo', 'extended')} AS t, {_clean("array_to_string(x.keywords, ', ')", 'extended')} AS k, {_clean('x.abstract', 'extended')} AS a FROM (SELECT row_number() OVER () AS rec, author_id AS author, unnest(publicacoes) AS x, generate_subscripts(publicacoes, 1) AS i FROM dataset_treino_1001_autores) WHERE i <= 50)
SELECT author, string_agg('PUBLICAÇÃO ' || i || CASE WHEN t <> '' THEN chr(10) || 'Título: ' || t ELSE '' END || CASE WHEN k <> '' THEN chr(10) || 'Palavras-chave: ' || k ELSE '' END || CASE WHEN a <> '' THEN chr(10) || 'Resumo: ' || a ELSE '' END, chr(10) || chr(10) ORDER BY i) AS profile FROM p GROUP BY rec, author""")
def profile_text_blocks(spark, d):
    t = table(spark, d, "dataset_treino_1001_autores").where(F.size("publicacoes") > 0)
    pubs = F.transform("publicacoes", lambda x: F.struct(X.clean_text(x["titulo"], "extended").alias("titulo"), X.clean_text(F.array_join(x["keywords"], ", "), "extended").alias("keywords"), X.clean_text(x["abstract"], "extended").alias("abstract")))
    return t.select(F.col("author_id").alias("author"), X.profile_text(pubs).alias("profile"))


@query(f"""WITH {_REPEATED}, {_SET}, s AS (SELECT author, pos, {_structured('basic')} AS s FROM er JOIN target USING (author)),
n AS (SELECT author, s, row_number() OVER (PARTITION BY author ORDER BY pos) AS r FROM s WHERE s.titulo <> '' OR s.abstract <> '')
SELECT author, 4 AS messages, CAST(least(count(*), 50) AS INT) AS used FROM n GROUP BY author""")
def chat_messages(spark, d):
    p = profiles.structured_profile(_pubs(spark, d), _judged(spark, d), most=50)
    return p.select("author", F.size(generate.chat_messages(F.col("publicacoes"))).alias("messages"), F.least(F.size("publicacoes"), F.lit(50)).alias("used"))


_PROMPT_END = 'Read the publications below and answer with the 30 tags that describe the author best, most certain first, as {"tags": ["...", "..."]}.'
_SAID = f"""{_REPEATED}, {_SET}, s AS (SELECT author, pos, {_structured('basic')} AS s FROM er JOIN target USING (author)),
n AS (SELECT author, s, row_number() OVER (PARTITION BY author ORDER BY pos) AS r FROM s WHERE s.titulo <> '' OR s.abstract <> ''),
told AS (SELECT author, '{_PROMPT_END}' || chr(10) || chr(10) || 'Publications:' || chr(10) || string_agg(array_to_string(list_filter([CASE WHEN s.titulo <> '' THEN 'Título: ' || s.titulo END, CASE WHEN s.keywords <> '' THEN 'Palavras-chave: ' || s.keywords END, CASE WHEN s.abstract <> '' THEN 'Resumo: ' || s.abstract END], lambda z: z IS NOT NULL), chr(10)), chr(10) || chr(10) ORDER BY r) AS said FROM n WHERE r <= 50 GROUP BY author)"""


@query(f"""WITH {_SAID}, w AS (SELECT author, list_filter(string_split_regex(said, '{WS}+'), lambda z: z <> '')[-30:] AS ws FROM told),
e AS (SELECT author, unnest(ws) AS t, generate_subscripts(ws, 1) AS k FROM w), f AS (SELECT author, t, min(k) AS k FROM e GROUP BY ALL)
SELECT author, string_agg(t, ' | ' ORDER BY k) AS tags, CAST(NULL AS VARCHAR) AS error FROM f GROUP BY author""")
def generate_tags(spark, d):
    p = profiles.structured_profile(_pubs(spark, d), _judged(spark, d), most=50)
    prompts = p.select("author", generate.chat_prompt(generate.chat_messages(F.col("publicacoes"))).alias("prompt"))
    return _joined(generate.generate(prompts).select("author", "tags", "error"))


@query(f"""WITH {_SAID} SELECT author, md5(said) AS last_message FROM told""")
def chat_text(spark, d):
    """The text of the last message of each prompt, as a digest."""
    p = profiles.structured_profile(_pubs(spark, d), _judged(spark, d), most=50)
    return p.select("author", F.md5(F.element_at(generate.chat_messages(F.col("publicacoes")), -1)["content"]).alias("last_message"))


_LOOSE = chr(32) + chr(34) + "''" + chr(9) + "-•"


@query(f"""WITH b AS (SELECT doc_id, {_strip("regexp_replace(regexp_replace(coalesce(text, ''), '(?is)<think>.*?</think>', '', 'g'), '(?i)</?think>', '', 'g')")} AS b FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(b, '^```(json)?{WS}*', ''), '{WS}*```$', '') AS b FROM b),
r AS (SELECT doc_id, b, CASE WHEN NOT json_valid(b) THEN NULL WHEN json_type(b) = 'ARRAY' THEN json_extract_string(b, '$[*]') WHEN json_type(b) = 'OBJECT' AND json_type(b, '$.tags') = 'ARRAY' THEN json_extract_string(b, '$.tags[*]') END AS whole,
 regexp_extract_all(regexp_extract(b, '(?s)"tags"\\s*:\\s*\\[(.*)', 1), '"([^"]+)"', 1) AS cut_off, string_split_regex(b, '[,;\n]+') AS items FROM c)
SELECT doc_id, array_to_string(CASE WHEN whole IS NOT NULL OR len(cut_off) > 0 THEN list_filter(list_transform(coalesce(whole, cut_off), lambda z: {_strip('z')}), lambda z: z <> '')
 ELSE list_filter(list_transform(items, lambda z: {_strip(f"trim(z, '{_LOOSE}')")}), lambda z: length(z) BETWEEN 1 AND 79)[:30] END, ' | ') AS tags FROM r""")
def parse_tags(spark, d):
    return _joined(table(spark, d, "documents").select("doc_id", parse_responses(F.col("text")).alias("tags")))


def _filled(c, array=False):
    return f"count(*) FILTER ({c} IS NOT NULL AND {'len(' + c + ') > 0' if array else 'CAST(' + c + " AS VARCHAR) <> ''"})"


_FIELDS = {"id": False, "title": False, "abstract": False, "keywords": True, "authors": True, "pub_year": False, "issn": False, "doi": False, "areas": True}


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, {_filled(c, a)} AS n, round(100 * {_filled(c, a)} / count(*), 6) AS percent FROM filtered_documents" for c, a in _FIELDS.items()))
def field_frequency(spark, d):
    return profiles.field_frequency(_pubs(spark, d), list(_FIELDS))


@query()
def split_70_15_15(spark, d):
    a = table(spark, d, "dataset_treino_1001_autores").select(X.author_id(F.col("author_id")).alias("author")).where("author <> ''").distinct()
    return dataset.random_split(a)


_TRAINED = f"a AS (SELECT DISTINCT {_author('author_id')} AS author FROM dataset_treino_1001_autores WHERE {_author('author_id')} <> '')"


@query(f"WITH {_TRAINED}, u AS (SELECT author, CAST('0x' || substr(md5('42:' || author), 1, 8) AS UBIGINT) / 4294967296.0 AS u FROM a) SELECT author, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM u")
def split_by_hash(spark, d):
    a = table(spark, d, "dataset_treino_1001_autores").select(X.author_id(F.col("author_id")).alias("author")).where("author <> ''").distinct()
    return dataset.hash_split(a)


@query(f"""WITH {_TRAINED}, n AS (SELECT count(*) AS n, CAST(ceil(round(count(*) * 0.3, 9)) AS BIGINT) AS held FROM a), k AS (SELECT n, held, CAST(ceil(round(held * 0.5, 9)) AS BIGINT) AS test FROM n)
SELECT unnest(['train', 'validation', 'test']) AS split, unnest([n - held, held - test, test]) AS authors, CAST(0 AS BIGINT) AS failures FROM k""")
def split_sizes(spark, d):
    """How many authors each part of the seeded split has, and what its check finds wrong."""
    a = table(spark, d, "dataset_treino_1001_autores").select(X.author_id(F.col("author_id")).alias("author")).where("author <> ''").distinct()
    s = dataset.random_split(a)
    wrong = dataset.check_split(s, a).agg(F.coalesce(F.sum("failures"), F.lit(0)).alias("n"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("authors")).withColumn("failures", wrong.select("n").scalar())


@query(f"""WITH {_REPEATED}, {_GOLD}, t AS (SELECT author, tag, max(weight) AS weight FROM parsed WHERE tag <> '' AND author <> '' AND weight IN (1, 2, 3) GROUP BY ALL),
s AS (SELECT author, pos, {_structured('extended')} AS s FROM er), n AS (SELECT author, least(count(*), 50) AS n_publicacoes_usadas FROM s WHERE s.titulo <> '' OR s.abstract <> '' OR s.keywords <> '' GROUP BY author)
SELECT author, CAST(n_publicacoes_usadas AS INT) AS n_publicacoes_usadas, string_agg(tag, ' | ' ORDER BY weight DESC, tag) AS target_tags FROM n JOIN t USING (author) GROUP BY ALL""")
def supervised_records(spark, d):
    p = profiles.structured_profile(_pubs(spark, d), _judged(spark, d), "extended", keep_keyword_only=True, most=50)
    return _joined(dataset.supervised(p, judgements.gold(readers.judgement_table(spark, d), True)).select("author", "n_publicacoes_usadas", "target_tags"))


@query("""WITH e AS (SELECT event_type AS run, event_id AS step, value FROM events), p AS (SELECT * FROM e WHERE value IS NOT NULL)
SELECT e.run, e.step, p.value FROM e ASOF LEFT JOIN p ON e.run = p.run AND e.step >= p.step""")
def loss_asof_all(spark, d):
    """The last value at or before each step; every event is a point and a request."""
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")
    return analysis.last_known(e, e.select("run", "step"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    return incremental.windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query()
def generate_curriculum_tags(spark, d):
    told = generate.curriculum_json(curriculum.profile(_curricula(spark, d)))
    prompts = told.select("author", generate.chat_prompt(generate.curriculum_messages(F.col("curriculum"))).alias("prompt"))
    return generate.generate(prompts).select("author", "tags", "error")


def _curricula(spark, d):
    """Curricula made of the publications of each author of the supervised set: the tables have no XML."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(X.clean_text(c), "&", "&amp;"), "<", "&lt;"), '"', "&quot;"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    one = F.transform("publicacoes", lambda p, i: F.concat(F.lit('<ARTIGO-PUBLICADO SEQUENCIA-PRODUCAO="1"><DADOS-BASICOS-DO-ARTIGO NATUREZA="COMPLETO" TITULO-DO-ARTIGO="'), esc(p["titulo"]), F.lit('" ANO-DO-ARTIGO="'), (F.lit(1990) + i % 30).cast("string"), F.lit('"/></ARTIGO-PUBLICADO>')))
    xml = F.concat(F.lit("<CURRICULO-VITAE><PRODUCAO-BIBLIOGRAFICA><ARTIGOS-PUBLICADOS>"), F.array_join(one, ""), F.lit("</ARTIGOS-PUBLICADOS></PRODUCAO-BIBLIOGRAFICA></CURRICULO-VITAE>"))
    return table(spark, d, "dataset_treino_1001_autores").select(X.author_id(F.col("author_id")).alias("author"), xml.alias("content"))


# curricula with all nine sections, made of each author's judged tags ---------------------------------------


def _full_curricula(spark, d):
    """XML of each judged author: tag i of the author in the order of weight and name is the i-th record."""
    gold = judgements.gold(readers.judgement_table(spark, d), True).select("author", "tag", "weight", X.clean_text(F.col("tag")).alias("t")).where("t <> ''")
    tags = gold.groupBy("author").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("k"), "tag", F.col("weight").alias("w"), F.regexp_replace("t", '"', "&quot;").alias("t")))).alias("x"))
    t, own = (lambda z: z["t"]), F.col("x")
    of = lambda w: F.filter("x", lambda z: z["w"] == w)
    say = lambda items, f: F.array_join(F.transform(items, f), "")
    tell = lambda form, *values: F.format_string(form, *values)
    first, last = F.element_at(own, 1)["t"], F.element_at(own, -1)["t"]
    xml = F.concat(
        tell('<CURRICULO-VITAE><DADOS-GERAIS NOME-COMPLETO="N"><FORMACAO-ACADEMICA-TITULACAO><DOUTORADO NOME-CURSO="%s" ANO-DE-CONCLUSAO="2001" TITULO-DA-DISSERTACAO-TESE="%s"/></FORMACAO-ACADEMICA-TITULACAO>', first, last),
        F.lit("<AREAS-DE-ATUACAO>"), say(of(3), lambda z: tell('<AREA-DE-ATUACAO NOME-DA-AREA-DO-CONHECIMENTO="%s"/>', t(z))), F.lit("</AREAS-DE-ATUACAO>"),
        tell('<ATUACOES-PROFISSIONAIS><ATUACAO-PROFISSIONAL NOME-INSTITUICAO="I"><VINCULOS OUTRO-VINCULO-INFORMADO="%s"/>', first),
        say(of(2), lambda z: tell('<LINHA-DE-PESQUISA TITULO-DA-LINHA-DE-PESQUISA="%s" OBJETIVOS-LINHA-DE-PESQUISA="o %s"/>', t(z), t(z))),
        tell('<ATIVIDADES-DE-ENSINO><ENSINO NOME-CURSO="%s">', first), say(of(1), lambda z: tell('<DISCIPLINA NOME-DA-DISCIPLINA="%s"/>', t(z))),
        F.lit("</ENSINO></ATIVIDADES-DE-ENSINO></ATUACAO-PROFISSIONAL></ATUACOES-PROFISSIONAIS></DADOS-GERAIS><PRODUCAO-BIBLIOGRAFICA><ARTIGOS-PUBLICADOS>"),
        say(own, lambda z, i: tell('<ARTIGO-PUBLICADO><DADOS-BASICOS-DO-ARTIGO TITULO-DO-ARTIGO="%s" ANO-DO-ARTIGO="%d" NATUREZA="COMPLETO" DOI="x"/><PALAVRAS-CHAVE PALAVRA-CHAVE-1="k %d"/></ARTIGO-PUBLICADO>', t(z), 1990 + i % 25, z["w"])),
        F.lit("</ARTIGOS-PUBLICADOS></PRODUCAO-BIBLIOGRAFICA><PRODUCAO-TECNICA><SOFTWARE>"),
        say(own, lambda z, i: tell('<DADOS-BASICOS-DO-SOFTWARE TITULO-DO-SOFTWARE="%s" ANO="%d"/>', t(z), 2000 + i % 10)),
        F.lit("</SOFTWARE></PRODUCAO-TECNICA><OUTRA-PRODUCAO><ORIENTACOES-CONCLUIDAS>"),
        say(own, lambda z, i: tell('<ORIENTACAO TITULO-DO-TRABALHO="%s" ANO="%d"/>', t(z), 1995 + i % 7)),
        F.lit("</ORIENTACOES-CONCLUIDAS><DEMAIS-TRABALHOS>"), say(own, lambda z: tell('<TRABALHO TITULO="%s"/>', t(z))), F.lit("</DEMAIS-TRABALHOS></OUTRA-PRODUCAO></CURRICULO-VITAE>"),
    )
    return tags.select("author", xml.alias("content"))


_CV = f"""{_GOLD}, tr AS (SELECT author, tag, max(weight) AS w FROM parsed WHERE tag <> '' AND weight IN (1, 2, 3) AND author <> '' GROUP BY ALL),
tc AS (SELECT author, tag, w, {_clean('tag')} AS t FROM tr), tg AS (SELECT author, t, w, row_number() OVER (PARTITION BY author ORDER BY w DESC, tag) - 1 AS i FROM tc WHERE t <> ''),
en AS (SELECT author, arg_min(t, i) AS f, arg_max(t, i) AS l FROM tg GROUP BY author),
works AS (SELECT author, 'producao_bibliografica' AS section, 1990 + i % 25 AS y, i, t, [t, 'COMPLETO', 'k ' || w] AS pieces, 30 AS most FROM tg
 UNION ALL SELECT author, 'producao_tecnica', 2000 + i % 10, i, t, [t], 20 FROM tg UNION ALL SELECT author, 'orientacoes_concluidas', 1995 + i % 7, i, t, [t, 'ORIENTACAO'], 20 FROM tg
 UNION ALL SELECT author, 'demais_trabalhos', -1, 0, f, [f], 20 FROM en),
recent AS (SELECT *, CAST(row_number() OVER (PARTITION BY author, section ORDER BY y DESC, i) AS INT) AS recency FROM works QUALIFY recency <= most),
un AS (SELECT author, section, recency AS o, pieces FROM recent UNION ALL SELECT author, 'formacao_academica', 0, [f, l] FROM en UNION ALL SELECT author, 'atuacao_profissional', 0, [f] FROM en
 UNION ALL SELECT author, 'areas_de_atuacao', min(i), [t] FROM tg WHERE w = 3 GROUP BY author, t UNION ALL SELECT author, 'linhas_de_pesquisa', i, [t, 'o ' || t] FROM tg WHERE w = 2
 UNION ALL SELECT author, 'ensino', 0, [f] || coalesce(ts, []) FROM en LEFT JOIN (SELECT author, list(t ORDER BY i) AS ts FROM tg WHERE w = 1 GROUP BY author) USING (author)),
nu AS (SELECT author, section, section || '_' || lpad(CAST(row_number() OVER (PARTITION BY author, section ORDER BY o) - 1 AS VARCHAR), 3, '0') AS doc_id, pieces FROM un)"""


@query(f"WITH {_CV} SELECT author, section, recency, CASE WHEN y > 0 THEN CAST(y AS VARCHAR) END AS ano, t AS titulo FROM recent")
def curriculum_profile(spark, d):
    p = curriculum.profile(_full_curricula(spark, d))
    return p.where(F.col("recency").isNotNull()).select("author", "section", "recency", "ano", "titulo")


@query(f"""WITH {_CV}, e AS (SELECT author, section, doc_id, unnest(pieces) AS x, generate_subscripts(pieces, 1) AS k FROM nu), f AS (SELECT author, section, doc_id, x, min(k) AS k FROM e GROUP BY ALL)
SELECT author, section, doc_id, string_agg(x, ' | ' ORDER BY k) AS pieces FROM f GROUP BY ALL""")
def curriculum_units(spark, d):
    return _joined(curriculum.units(curriculum.profile(_full_curricula(spark, d))))


@query(f"""WITH {_CV}, n AS (SELECT author, section, count(*) AS n FROM nu GROUP BY ALL), a AS (SELECT author, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY author)
SELECT section, CAST(sum(n) AS BIGINT) AS units, count(*) AS authors, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM n GROUP BY section UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), count(*), round(avg(n), 6), min(n), max(n) FROM a""")
def curriculum_unit_summary(spark, d):
    return _rounded(curriculum.unit_summary(curriculum.units(curriculum.profile(_full_curricula(spark, d)))))


@query(f"""WITH {_CV}, {_TRAINED}, cv AS (SELECT DISTINCT author FROM en) SELECT (SELECT count(*) FROM cv) AS curricula, (SELECT count(*) FROM cv JOIN a USING (author)) AS judged, (SELECT count(*) FROM cv WHERE author NOT IN (SELECT author FROM a)) AS not_judged,
 CAST(0 AS BIGINT) AS missing, (SELECT count(*) FROM cv WHERE author NOT IN (SELECT author FROM a)) AS extra""")
def curriculum_alignment(spark, d):
    """Against the supervised authors; units are those of all curricula, so who is not in the set is extra."""
    files = _full_curricula(spark, d)
    wanted = table(spark, d, "dataset_treino_1001_autores").select(X.author_id(F.col("author_id")).alias("author")).where("author <> ''")
    return curriculum.alignment(files, wanted, curriculum.units(curriculum.profile(files)))


@query(f"""WITH {_CV}, n AS (SELECT author, section, count(*) AS records FROM recent GROUP BY ALL UNION ALL SELECT author, section, 1 FROM en, (SELECT unnest(['formacao_academica', 'atuacao_profissional', 'ensino']) AS section)
 UNION ALL SELECT author, 'areas_de_atuacao', count(*) FROM tg WHERE w = 3 GROUP BY author UNION ALL SELECT author, 'linhas_de_pesquisa', count(*) FROM tg WHERE w = 2 GROUP BY author)
SELECT author, section, records, CAST(0 AS BIGINT) AS empty FROM n""")
def curriculum_json(spark, d):
    """Records of each section of the JSON that prompts are made of; nothing empty stands in it."""
    told = generate.curriculum_json(curriculum.profile(_full_curricula(spark, d)))
    parts = F.array(*[F.struct(F.lit(s).alias("section"), F.get_json_object("curriculum", f"$.{s}").alias("x")) for s in curriculum.SECTIONS])
    rows = told.select("author", F.explode(parts).alias("p")).where("p.x is not null").select("author", "p.section", "p.x")
    return rows.select("author", "section", F.json_array_length("x").cast("long").alias("records"), F.size(F.filter(F.split("x", r'(?<=:)(?=null|\[\]|"")'), lambda z: z.rlike(r'^(null|\[\]|"")'))).cast("long").alias("empty"))
