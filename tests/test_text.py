import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import ngrams as N
from quillspark.functions import text as X
from quillspark.functions.parsing import parse_response


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_cleaning(spark):
    got = apply(spark, X.clean_text, ["<b>Olá</b>&nbsp;mundo", "a&#233;b", "x\u00a0 y\t\n z", "10³ % ± 4", None, "", "A&AMP;B"])
    assert got == ["Olá mundo", "a b", "x y z", "10³ 4", "", "", "A AMP;B"]
    assert apply(spark, lambda c: X.clean_text(c, "extended"), ["a&#xE9;b & 5% @x", "A&AMP;B"]) == ["a b & 5% @x", "A B"]


def test_strip_accents_is_nfd_without_marks(spark):
    values = ["Ação ÇÜñ", "e\u0301", "Ωμέγα йод", "Việt Nam", "plain"]
    want = ["".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn") for v in values]
    assert apply(spark, X.strip_accents, values) == want


ROMAN = re.compile(r"\b(?=[mcdlxvi])m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})\b", re.I)


def reference_normal(t):
    t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
    for p in (r"[-_]+", r"[^\w\s]+", r"\d+"):
        t = re.sub(p, " ", t)
    return " ".join(ROMAN.sub(" ", t).split())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcdilmvxçãéñ ÁÇ-_.,;12 ", max_size=40), min_size=20, max_size=40))
def test_lexical_normal_form(spark, values):
    assert apply(spark, X.normalize_lexical, values) == [reference_normal(v) for v in values]


def test_words_that_are_roman_numerals_go(spark):
    assert apply(spark, X.normalize_lexical, ["vi di mix cd mil livro", "Século XIX"]) == ["mil livro", "seculo"]


def test_sentences(spark):
    assert apply(spark, X.sentences, ["A b. C!  D; e, f,g\n h", None, " . "]) == [["A b", "C", "D", "e", "f,g", "h"], [], []]


def test_publication_strings(spark):
    df = spark.createDataFrame([(" T ", [" a", "", None, "b "], ""), (None, None, "x"), ("", [], None)], "t string, k array<string>, a string")
    c = [F.col(x) for x in "tka"]
    got = [tuple(r) for r in df.select(X.publication_string(*c), X.labelled_text(*c)).collect()]
    assert got == [("T, a, b", "Título: T\nPalavras-chave: a; b"), ("x", "Resumo: x"), ("", "")]


def test_structured_keeps_the_separator_of_a_keyword_that_cleans_to_nothing(spark):
    df = spark.createDataFrame([("T", ["a", "<b>", "c", " "], None)], "t string, k array<string>, a string")
    assert df.select(X.structured(F.col("t"), F.col("k"), F.col("a")).alias("s")).first().s.keywords == "a, , c"


def test_profile_text(spark):
    df = spark.createDataFrame([([("A", "", "x"), ("B", "k", "")],)], "p array<struct<titulo:string,keywords:string,abstract:string>>")
    assert df.select(X.profile_text(F.col("p")).alias("x")).first().x == "PUBLICAÇÃO 1\nTítulo: A\nResumo: x\n\nPUBLICAÇÃO 2\nTítulo: B\nPalavras-chave: k"


def test_ids(spark):
    assert apply(spark, X.author_id, [" ID_1 ", "id_2", "3"]) == ["1", "id_2", "3"]
    assert apply(spark, X.first_digits, ["x ID_12345678 y", "1234567", "a 123456789"]) == ["12345678", None, "123456789"]
    assert apply(spark, X.file_id, ["ID_42.xml", "abc.XML"]) == ["42", None]
    assert apply(spark, X.field_name, ["Ano-do Trabalho_"]) == ["ANO_DO_TRABALHO"]
    assert apply(spark, X.local_name, ["{ns}TAG", "TAG"]) == ["TAG", "TAG"]


def test_ngrams_bridge_short_tokens_and_obey_the_rule(spark):
    df = spark.createDataFrame([("analise de a agua doce",), ("",)], "t string").select(N.tokens(F.col("t")).alias("toks"))
    rows = N.windows(df.withColumn("tags", N.lexicon_tagger(F.col("toks"))), "toks").withColumn("ok", N.well_formed(F.col("tags"), F.col("start"), F.col("n")))
    got = [(r.ngram, r.ok) for r in rows.orderBy("n", "start").collect()]
    assert [g for g, _ in got][:5] == ["analise", "de", "agua", "doce", "analise de"]
    assert [g for g, ok in got if ok] == ["analise", "agua", "doce", "agua doce", "analise de agua"]
    arrays = df.select(N.ngram_arrays(F.array(F.struct("toks", N.lexicon_tagger(F.col("toks")).alias("tags")))).alias("x")).collect()
    assert [r.x for r in arrays] == [["analise", "agua", "doce", "agua doce", "analise de agua"], []]


@pytest.mark.parametrize("tags,ok", [(["NOUN"], True), (["DET", "NOUN"], False), (["NOUN", "ADP", "VERB"], False), (["NOUN", "ADP", "NOUN"], True), (["VERB"], False), (["X", "X"], False), (["NUM", "NOUN"], False), (["ADJ", "NOUN", "VERB"], True)])
def test_part_of_speech_rule(spark, tags, ok):
    assert spark.createDataFrame([(tags,)], "t array<string>").select(N.well_formed(F.col("t")).alias("x")).first().x == ok


RESPONSES = {
    '{"tags": ["a", "b"]}': ["a", "b"],
    '["a", 2]': ["a", "2"],
    '```json\n{"tags": ["x "]}\n```': ["x"],
    "<think>no</think>{\"tags\": [\"y\"]}": ["y"],
    '{"tags": ["a", "b': ["a"],
    "- one\n• two; three": ["one", "two", "three"],
    "x" * 90 + ", ok": ["ok"],
    "": [],
}


@pytest.mark.parametrize("text,want", RESPONSES.items())
def test_response_parser(text, want):
    assert parse_response(text) == want


def test_only_free_text_is_cut():
    assert len(parse_response(str([str(i) for i in range(40)]).replace("'", '"'), 30)) == 40
    assert len(parse_response(", ".join(f"t{i}" for i in range(40)), 30)) == 30 and parse_response(None) == []
