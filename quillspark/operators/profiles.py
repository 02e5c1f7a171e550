"""Profiles of authors from publications(id, title, keywords, abstract, authors, pos).

pos is the explicit input order: Spark has none of its own. Authors are a one-column DataFrame (author).
Semi-joins are left to Catalyst, which broadcasts the author set only under its size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.ngrams import lexicon_tagger, ngram_arrays, tokens, well_formed, windows
from quillspark.operators.ordering import carried, numbered
from quillspark.session import spread


def _authors(c: str | Column = "authors") -> Column:
    return F.transform(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")), lambda a: X.author_id(a))


def exploded(publications: DataFrame, distinct: bool = True) -> DataFrame:
    """A row for each author of a publication; distinct drops an author's repeats within it."""
    a = F.array_distinct(_authors()) if distinct else _authors()
    return publications.withColumn("author", F.explode(a)).where("author <> ''")


def of_authors(publications: DataFrame, authors: DataFrame) -> DataFrame:
    """Publications with any author in the set, whole and once; a row is told by pos."""
    wanted = exploded(publications.select("pos", "authors")).join(authors.select("author"), "author", "left_semi").select("pos").distinct()
    return publications.join(wanted, "pos", "left_semi")


def coauthored(publications: DataFrame, authors: DataFrame, distinct: bool = True) -> DataFrame:
    """A row for each publication and author of the set. Columns are kept, author is added."""
    return exploded(publications, distinct).join(authors.select("author"), "author", "left_semi")


def _own(publications: DataFrame, authors: DataFrame, distinct: bool = True) -> DataFrame:
    """The fields of the publications of each author of the set, before anything is made of them."""
    return coauthored(spread(publications.select("pos", "id", "title", "keywords", "abstract", "authors")), authors, distinct).drop("authors")


def missing(authors: DataFrame, publications: DataFrame) -> DataFrame:
    """Authors of the set without any publication."""
    return authors.select("author").distinct().join(exploded(publications.select("authors")).select("author"), "author", "left_anti")


def filter_summary(publications: DataFrame, authors: DataFrame) -> DataFrame:
    """One row: publications read, kept, authors wanted, found and missing, links between them."""
    links = coauthored(publications.select("pos", "authors"), authors)
    left = links.agg(F.countDistinct("pos").alias("kept"), F.countDistinct("author").alias("found"), F.count(F.lit(1)).alias("links"))
    total = publications.select(F.count(F.lit(1))).scalar()
    wanted = authors.select(F.countDistinct("author")).scalar()
    return left.select(total.alias("read"), "kept", wanted.alias("wanted"), "found", (wanted - F.col("found")).alias("missing"), "links")


def filter_report(lines: DataFrame, publications: DataFrame, authors: DataFrame, examples: int = 10) -> DataFrame:
    """One row of seven counters: lines, invalid, kept, wanted, found, missing, examples (the first missing authors).

    lines: readers.line_counts, one row (lines, invalid)."""
    links = coauthored(publications.select("pos", "authors"), authors)
    left = links.agg(F.countDistinct("pos").alias("kept"), F.countDistinct("author").alias("found"))
    none = missing(authors, publications).orderBy("author").limit(examples).agg(F.array_sort(F.collect_list("author")).alias("examples"))
    wanted = authors.select(F.countDistinct("author")).scalar()
    row = left.select(lines.select("lines").scalar().alias("lines"), lines.select("invalid").scalar().alias("invalid"), "kept", wanted.alias("wanted"), "found", (wanted - F.col("found")).alias("missing"))
    return row.withColumn("examples", none.select("examples").scalar())


def build_counts(publications: DataFrame, authors: DataFrame, kept: Column | None = None) -> DataFrame:
    """One row: selected publications, authors with publications, links; kept: what a profile keeps of a publication."""
    links = coauthored(publications.where(kept) if kept is not None else publications, authors).select("pos", "author")
    return links.agg(F.countDistinct("pos").alias("selected"), F.countDistinct("author").alias("authors"), F.count(F.lit(1)).alias("links"))


def _in_order(value: Column) -> Column:
    """Values in input order, from an aggregation."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"])


def first_of_author(rows: DataFrame, most: int | None) -> DataFrame:
    """The first `most` rows of each author by pos. Spark limits the window's groups before the shuffle too,
    so of an author with a third of all rows only few travel."""
    if most is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("author").orderBy("pos"))).where(F.col("_n") <= most).drop("_n")


def _key(chunk: int | None) -> list:
    """Authors, or authors in parts of the publications of `chunk` consecutive values of pos."""
    return ["author"] if chunk is None else ["author", F.floor(F.col("pos") / chunk).alias("part")]


def text_profile(publications: DataFrame, authors: DataFrame, chunk: int | None = None) -> DataFrame:
    """author, profile: the author's publications joined by comma and space, empty ones left out.

    One row an author holds all the author's text, as the profile files do. With chunk every profile comes in
    parts (author, part, profile): parts in order are the profile, and no author is gathered in one place. Use it
    where an author may have more text than a row can hold."""
    text = X.publication_string(F.col("title"), F.col("keywords"), F.col("abstract"))
    rows = _own(publications, authors).select("author", "pos", text.alias("t")).where("t <> ''")
    return rows.groupBy(*_key(chunk)).agg(F.array_join(_in_order(F.col("t")), ", ").alias("profile"))


def labelled_profile(publications: DataFrame, authors: DataFrame, chunk: int | None = None) -> DataFrame:
    """author, n_publicacoes, publicacoes_textuais of every author of the set, empty profiles too; chunk: as for
    text_profile, an author without a publication has one part, null."""
    text = X.labelled_text(F.col("title"), F.col("keywords"), F.col("abstract"))
    rows = _own(publications, authors).select("author", "pos", text.alias("t")).where("t <> ''")
    held = rows.groupBy(*_key(chunk)).agg(_in_order(F.col("t")).alias("texts"))
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    own = authors.select("author").distinct().join(held, "author", "left")
    return own.select("author", *(["part"] if chunk else []), F.size(texts).alias("n_publicacoes"), texts.alias("publicacoes_textuais"))


def _structured(publications: DataFrame, authors: DataFrame, variant: str, keep_keyword_only: bool, distinct: bool) -> DataFrame:
    p = _own(publications, authors, distinct).select("author", "pos", X.structured(F.col("title"), F.col("keywords"), F.col("abstract"), variant).alias("s"))
    filled = (F.col("s.titulo") != "") | (F.col("s.abstract") != "")
    return p.where(filled | (F.col("s.keywords") != "") if keep_keyword_only else filled)


def structured_rows(publications: DataFrame, authors: DataFrame, variant: str = "basic", keep_keyword_only: bool = False, distinct: bool = False) -> DataFrame:
    """author, place, titulo, keywords, abstract: the structured profile a row a publication, nothing gathered."""
    rows = _structured(publications, authors, variant, keep_keyword_only, distinct)
    rows = numbered(rows, "place", ["author"], {"_range": (F.floor(F.col("pos") / 4096), False)}, ["pos"])
    return rows.select("author", (F.col("place") - 1).alias("place"), "s.titulo", "s.keywords", "s.abstract")


def structured_profile(publications: DataFrame, authors: DataFrame, variant: str = "basic", keep_keyword_only: bool = False, distinct: bool = False, most: int | None = None, chunk: int | None = None) -> DataFrame:
    """author, publicacoes array<struct<titulo, keywords, abstract>> in input order.

    keep_keyword_only: a publication without title and abstract stays if it has keywords. An author named
    twice in a record gets it twice, unless distinct. most: only the author's first publications, as prompts
    and supervised records use them; chunk: as for text_profile; structured_rows gathers nothing at all."""
    rows = first_of_author(_structured(publications, authors, variant, keep_keyword_only, distinct), most)
    return rows.groupBy(*_key(chunk)).agg(_in_order(F.col("s")).alias("publicacoes"))


def field_evidence(publications: DataFrame, authors: DataFrame) -> DataFrame:
    """author, doc_id, pieces: cleaned title, keywords and abstract; of a repeated document the last counts."""
    kws = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: X.clean_text(k))
    pieces = F.filter(F.concat(F.array(X.clean_text(F.col("title"))), kws, F.array(X.clean_text(F.col("abstract")))), lambda x: x != "")
    own = _own(publications.where("coalesce(id, '') <> ''"), authors)
    rows = own.select("author", "pos", F.col("id").cast("string").alias("doc_id"), pieces.alias("pieces")).where(F.size("pieces") > 0)
    return rows.groupBy("author", "doc_id").agg(F.max_by("pieces", "pos").alias("pieces"))


def document_sentences(publications: DataFrame) -> DataFrame:
    """pos, id, authors, sent, raw, normal: the sentences of each publication with their normal form."""
    text = X.publication_string(F.col("title"), F.col("keywords"), F.col("abstract"))
    p = spread(publications.where("coalesce(id, '') <> ''").select("pos", "id", "authors", text.alias("t"))).where("t <> ''")
    s = p.select("pos", "id", "authors", F.posexplode(X.sentences(F.col("t"))).alias("sent", "raw"))
    return s.withColumn("normal", X.normalize_lexical(F.col("raw")))


def document_windows(publications: DataFrame, tagger=lexicon_tagger, longest: int = 3) -> DataFrame:
    """pos, id, authors, sent, n, start, ngram, ok: every window of every sentence; ok by the rule on tags.

    Rows are made by generators in the task that reads the publication: no shuffle, generated code."""
    t = document_sentences(publications).select("pos", "id", "authors", "sent", tokens(F.col("normal")).alias("toks"))
    w = windows(t.withColumn("tags", tagger(F.col("toks"))), "toks", longest)
    return w.select("pos", "id", "authors", "sent", "n", "start", "ngram", well_formed(F.col("tags"), F.col("start"), F.col("n")).alias("ok"))


def ngrams_by_document(publications: DataFrame, tagger=lexicon_tagger, longest: int = 3) -> DataFrame:
    """pos, id, authors, ngramas in order of sentence, n and start. Nothing is shuffled: all in the row.

    Documents without a well-formed n-gram keep an empty array, which the coverage denominator counts."""
    text = X.publication_string(F.col("title"), F.col("keywords"), F.col("abstract"))
    p = publications.where("coalesce(id, '') <> ''").select("pos", "id", "authors", text.alias("t")).where("t <> ''")
    p = spread(p).select("pos", "id", "authors", F.transform(X.sentences(F.col("t")), lambda s: tokens(X.normalize_lexical(s))).alias("sents"))
    tagged = F.transform("sents", lambda t: F.struct(t.alias("toks"), tagger(t).alias("tags")))
    return p.select("pos", "id", "authors", ngram_arrays(tagged, longest).alias("ngramas"))


def ngram_profile(publications: DataFrame, authors: DataFrame, tagger=lexicon_tagger, longest: int = 3) -> DataFrame:
    """author, ngram, freq: the bag of each author. Publications of other authors go before windows are made, and
    nothing is shuffled until the windows of an author are counted."""
    rows = document_windows(_own(publications, authors).withColumn("authors", F.array("author")), tagger, longest).where("ok")
    return rows.select(F.col("authors")[0].alias("author"), "ngram").groupBy("author", "ngram").agg(F.count(F.lit(1)).alias("freq"))


def carried_language(sentences: DataFrame, detected: Column, by: list[str], order: list[str], start: str = "pt", least: int = 20) -> DataFrame:
    """lang: what was detected on sentences of at least `least` characters, else the last before, else start.

    by an author the language goes on through all documents, by a document it begins anew. An author's
    sentences are worked off in ranges of pos, so that one with a third of all rows is split."""
    one = F.when(F.length(X.strip(F.col("raw"))) >= least, detected)
    bucket = F.lit(0) if by == ["pos"] else F.floor(F.col("pos") / 4096)
    return carried(sentences, "_lang", one, by, bucket, order).withColumn("lang", F.coalesce("_lang", F.lit(start))).drop("_lang")


def field_frequency(publications: DataFrame, fields: list[str]) -> DataFrame:
    """field, n, percent: on how many records each field is filled."""
    def filled(c):
        kind = publications.schema[c].dataType.typeName()
        return F.col(c).isNotNull() & (F.size(c) > 0 if kind == "array" else F.col(c).cast("string") != "")

    counts = publications.agg(F.count(F.lit(1)).alias("total"), *[F.sum(filled(c).cast("long")).alias(c) for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in fields])
    return counts.select("total", F.explode(pairs).alias("x")).select("x.field", F.coalesce("x.n", F.lit(0)).alias("n"), F.round(100 * F.col("x.n") / F.col("total"), 6).alias("percent"))
