import random

import pytest

from quillspark.llm import encoding_repair as E

SENTENCES = [
    "A avaliação da produção científica é discutida à luz da memória e do patrimônio português.",
    "Também são necessárias novas investigações sobre a região, após três décadas de observação.",
    "El método propuesto alcanzó una precisión mayor según las mediciones del año anterior.",
    "La résonance magnétique a été comparée à l'étalon précédent par les chercheurs français.",
    "A temperatura foi mantida em 12,3 ± 0,4 °C durante as medições “ordinárias”.",
]
WAYS = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp850")]


def garble(text, right, wrong):
    return text.encode(right, "replace").decode(wrong, "replace")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [{"rec_id": k, "abstract": " ".join(rng.sample(SENTENCES, 3))} for k in range(150)]
    for k, (right, wrong) in enumerate(WAYS * 4):
        text = " ".join(rng.sample(SENTENCES, 2))
        out += [{"rec_id": 1000 + 2 * k, "abstract": garble(text, right, wrong)}, {"rec_id": 1001 + 2 * k, "abstract": text}]
    return out


def test_garbled_fields_are_found_and_restored(pubs, rows):
    clean = {r["rec_id"]: r["abstract"] for r in rows}
    extra = [{"rec_id": 5000, "abstract": "uma avalia��o da regi�o"}, {"rec_id": 5001, "title": "ÁGUA E CORROSÃO: AVALIAÇÃO"}, {"rec_id": 5002}, {"rec_id": 5003, "title": "", "abstract": "plain ASCII"}, {"rec_id": 5004, "abstract": "avaliacao sem acentos"}]
    got = {r.rec_id: r for r in E.garbled_fields(pubs(*rows, *extra)).collect()}
    want = {r["rec_id"] for r in rows if r["rec_id"] >= 1000 and r["rec_id"] % 2 == 0} | {5000}
    assert set(got) == want
    right = sum(got[k].restored == clean[k + 1] for k in want if k < 5000)
    assert right >= 0.8 * (len(want) - 1)
    assert got[5000].restored == "uma avaliação da região"


def test_repeated_decoding():
    text = "informação é"
    for _ in range(2):
        text = garble(text, "utf-8", "cp1252")
    r = E.Repairer({}, {})
    assert r.field(text) == ("informação é", ["utf8>cp1252"])
    assert r.field("informação é às ÇÃO µm ±") is None


def test_empty(pubs):
    assert E.garbled_fields(pubs()).collect() == []


def test_every_variant_is_aligned_with_the_clean_one(pubs):
    clean = "à região: avaliação é também técnica"
    variants = [garble(clean, *way) for way in WAYS]
    rows = [{"rec_id": k, "abstract": t} for k, t in enumerate([*variants, variants[0], variants[0], clean])]
    got = E.twins(pubs(*rows).select("title", "abstract")).collect()
    assert len(got) == len(set(variants)) and {r.centre for r in got} == {next(r.centre for r in got)}
    assert "é" in got[0].centre and "ã" in got[0].centre and all("é" not in r.variant.split("\x01") for r in got)
    pairs = {(a, b) for x in got for a, b in zip(*([z.split("\x01")[1] for z in v.split("\x02")] for v in (x.variant, x.centre)))}
    assert {(garble("é", *way), "é") for way in WAYS} <= pairs


def test_pairs_of_middle_variants_are_learnt(pubs):
    clean = "técnica de observação"
    rows = [{"rec_id": k, "abstract": t} for k, t in enumerate([clean] * 9 + [garble(clean, *way) for way in WAYS])]
    learnt = {(r.bad, r.good) for r in E.collection(pubs(*rows).select("title", "abstract"))[2].collect()}
    assert all((garble("é", *way), "é") in learnt for way in WAYS)


def test_decisions_are_those_of_all_counts(pubs, rows):
    """Joined in Spark as by one Repairer that holds every count; runs are whole."""
    long = garble("éàéàéàéàé", "utf-8", "cp1252")
    extra = [{"rec_id": 5000 + k, "abstract": t} for k, t in enumerate(["uma avalia��o da regi�o", "\x93nota\x94", "SITUAÃO E AVALIAÃÃO", "ÁGUA E CORROSÃO: AVALIAÇÃO", f"a {long} b", "a éàéàéàéàé b"])]
    src = pubs(*rows, *extra)
    contexts, pairs, learnt = E.collection(src.select("title", "abstract"))
    full = E.Repairer({(r.before, r.run, r.after): r.n for r in contexts.collect()}, {(r.a, r.b): r.n for r in pairs.collect()})
    got = {(r.bad, r.good): r.k for r in learnt.collect()}
    assert got == {(bad, good): k for bad, goods in full.learnt.items() for good, k in goods.items()}
    full.support = E.Repairer(full.contexts, got).support
    want = {key: x[1:] for key in full.contexts if (x := full.verdict(*key))[0]}
    found = {(r.before, r.run, r.after): (r.good, r.t) for r in E.verdicts(contexts, learnt).collect()}
    assert found == want and len(want) > 20
    assert (" ", long, " ") in full.contexts and len(long) > 12 and want[" ", long, " "][0] == "éàéàéàéàé"


def test_a_word_that_is_right_contests_its_neighbourhood(pubs):
    """así stands where authors’ stands far more often; authorsí is garbled all the same."""
    rows = [{"rec_id": k, "abstract": f"The authors’ material was obtained, no. {k}"} for k in range(300)]
    rows += [{"rec_id": 1000 + k, "abstract": f"Describimos el caso, así como la respuesta {k}"} for k in range(6)]
    rows += [{"rec_id": 2000 + k, "abstract": garble(f"The authors’ material was obtained, no. {k}", "cp1252", "mac_roman")} for k in range(5)]
    got = {r.rec_id: r.restored for r in E.garbled_fields(pubs(*rows)).collect()}
    assert set(got) == set(range(2000, 2005)) and got[2001] == "The authors’ material was obtained, no. 1"


@pytest.mark.parametrize("text", ["привет мир и слова", "καλημέρα κόσμε", "数据处理", "שלום עולם", "é informação e ação"])
@pytest.mark.parametrize("page", ["cp1252", "latin-1"])
def test_other_scripts_come_back(text, page):
    wrong = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in text.encode("utf-8"))
    assert E.Repairer({}, {}).field(wrong)[0] == text
    assert E.Repairer({}, {}).field("«ESPAÑA» DOÑA É” à» Ó…") is None


def test_what_twins_show_is_enough(pubs, rows):
    """Found with the transformations of twins alone; none without twins but what can't be right."""
    alone = {r.rec_id for r in E.garbled_fields(pubs(*rows), unsupported=False).collect()}
    assert alone == {r["rec_id"] for r in rows if r["rec_id"] >= 1000 and r["rec_id"] % 2 == 0}
    single = [{"rec_id": k, "abstract": garble(SENTENCES[k], "utf-8", "cp1252")} for k in range(3)]
    assert E.garbled_fields(pubs(*single), unsupported=False).collect() == [] and len(E.garbled_fields(pubs(*single)).collect()) == 3
