import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import language as L
from quillspark.session import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("label,want", [("pt", ["pt"]), ("PT-BR", ["pt"]), ("en_GB; francês", ["en", "fr"]), ("Español/eng", ["es", "en"]), ("n/d", []), ("", []), (None, []), ("xx", []), ("und", []), ("pt /fr", ["pt", "fr"])])
def test_labels(spark, label, want):
    df = spark.createDataFrame([(label,)], "l string").select(L.label_languages(F.col("l")).alias("k"))
    assert df.first().k == want


@pytest.fixture(scope="module")
def labelled(spark):
    rows = table(spark, SF, "filtered_documents").join(table(spark, SF, "idioma_rotulos"), "rec_id").select("rec_id", "title", "abstract", L.label_languages(F.col("rotulo")).alias("k")).where(F.size("k") == 1).collect()
    random.Random(1).shuffle(rows)
    return [(s, r.k[0]) for r in rows for t in (r.title, r.abstract) if t for s in L.segments(t) if len(L.words(s)) >= 8]


def test_held_out_accuracy(labelled):
    """Labels are wrong for some rows by design, so agreement is measured against them with that in mind."""
    cut = len(labelled) // 2
    scorer = L.Scorer(L.fit(labelled[:cut]))
    got = scorer.scores([L.words(s) for s, _ in labelled[cut:]]).argmax(axis=1)
    right = sum(L.LANGUAGES[g] == k for g, (_, k) in zip(got, labelled[cut:]))
    assert right / len(got) > 0.9


def test_fixed_sentences(labelled):
    scorer = L.Scorer(L.fit(labelled))
    for k, s in {"pt": "Os resultados mostram que não houve diferença entre os grupos.", "en": "The results show that there was no difference between the groups.", "es": "Los resultados muestran que no hubo diferencia entre los grupos.", "fr": "Les résultats montrent qu'il n'y avait pas de différence entre les groupes."}.items():
        assert L.LANGUAGES[scorer.scores([L.words(s)])[0].argmax()] == k


def test_mixed_placeholder_and_empty(spark, pubs):
    labels = table(spark, SF, "idioma_rotulos")
    base = table(spark, SF, "filtered_documents").select("rec_id", "title", "abstract")
    rows = pubs(
        {"rec_id": -1, "title": None, "abstract": "Os resultados mostram que não houve diferença entre os grupos. The results show that there was no difference between the groups."},
        {"rec_id": -2, "title": "Foreword", "abstract": "Abstract not available"},
        {"rec_id": -3, "title": "", "abstract": "-"},
    ).select("rec_id", "title", "abstract")
    got = {(r.rec_id, r.field, r.lang) for r in L.field_languages(base.unionAll(rows), labels).where("rec_id < 0").collect()}
    assert got == {(-1, "abstract", "pt"), (-1, "abstract", "en")}
    assert L.language_segments(pubs(), labels).collect() == []
    assert L.field_languages(base.limit(5), labels.limit(0)).collect() == []


def test_kernel_is_of_presence(labelled):
    """A chunk's product equals the sets of n-grams; a word said twice or an n-gram of two words counts once."""
    some = [L.words(s) for s, _ in labelled[:150]]
    sets = [set().union(*map(L.grams, ws)) for ws in some]
    p = L.Presence()
    p.learn(some)
    matrix = L.np.concatenate([m.copy() for _, m in p.chunks(some)])
    assert [set(L.np.flatnonzero(r)) for r in matrix] == sets
    marks = L.Landmarks(matrix[:40])
    got = L.np.concatenate([marks.kernel(m) for _, m in p.chunks(some)])
    assert all(abs(got[i, j] - len(sets[i] & sets[j]) / (len(sets[i]) * len(sets[j])) ** 0.5) < 1e-5 for i in range(150) for j in range(40))
    weights = L.np.random.default_rng(1).random((L.PLACES, 4), L.np.float32)
    want = [weights[sorted(x)].sum(axis=0) / len(x) ** 0.5 for x in sets]
    assert L.np.allclose(L.Scorer(weights).scores(some), want, atol=1e-3)


def test_parts_of_mixed_segments(spark, pubs):
    labels = table(spark, SF, "idioma_rotulos")
    base = table(spark, SF, "filtered_documents").select("rec_id", "title", "abstract")
    rows = pubs(
        {"rec_id": -1, "title": "A avaliação da produção científica nas escolas públicas = The evaluation of scientific production in public schools", "abstract": None},
        {"rec_id": -2, "title": "The effect of light on growth", "abstract": "Os resultados mostram que não houve diferença entre os grupos estudados as reported in the study of the authors with all of the data."},
        {"rec_id": -3, "title": "Resumo não disponível", "abstract": "Resumo não disponível. Abstract not available. No aplica. Os dados são claros."},
        {"rec_id": -4, "title": None, "abstract": "word " * 60_000},
    ).select("rec_id", "title", "abstract")
    seg = L.language_segments(base.unionAll(rows), labels).where("rec_id < 0").collect()
    told = {(r.rec_id, r.field, r.part): r.lang for r in seg if r.rec_id in (-1, -2)}
    assert told == {(-1, "title", 0): "pt", (-1, "title", 1): "en", (-2, "title", 0): "en", (-2, "abstract", 0): "pt", (-2, "abstract", 1): "en"}
    assert {r.text for r in seg if r.rec_id == -3} >= {"Os dados são claros."} and not any("dispon" in r.text or "available" in r.text for r in seg if r.rec_id == -3)
    fields = {(r.rec_id, r.field, r.lang) for r in L.field_languages(base.unionAll(rows), labels).where("rec_id in (-1, -2)").collect()}
    assert {(-1, "title", "pt"), (-1, "title", "en"), (-2, "title", "en")} <= fields and len([f for f in fields if f[:2] == (-2, "abstract")]) == 1


def test_fields_count_their_segments(spark):
    labels, base = table(spark, SF, "idioma_rotulos"), table(spark, SF, "filtered_documents").select("rec_id", "title", "abstract")
    seg = L.language_segments(base, labels).where("counts_as is not null").groupBy("rec_id", "field", F.col("counts_as").alias("lang")).agg(F.count(F.lit(1)).alias("segments"))
    got = L.field_languages(base, labels).select("rec_id", "field", "lang", "segments")
    assert seg.exceptAll(got).isEmpty() and got.exceptAll(seg).isEmpty()
