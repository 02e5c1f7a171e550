import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import curriculum, generate, profiles
from quillspark.sources import readers, sinks
from quillspark.streaming import incremental


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


LINES = ['{"id": "A-1", "title": "T", "authors": ["1", "1", "2"], "keywords": ["k", "<b>"]}', "", "not json", '["list"]', '{"id": "A-2", "authors": "x"}', '{"id": "A-3", "title": "", "abstract": "", "keywords": ["only"], "authors": ["1"]}', '{"title": "no id", "authors": ["2"]}']


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "d.jsonl", "\n".join(LINES))
    rows = readers.jsonl(spark, p).orderBy("pos").collect()
    assert [r.id for r in rows if r.authors is not None] == ["A-1", "A-3", None]
    with pytest.raises(Exception, match="malformed"):
        readers.jsonl(spark, p, strict=True).collect()


def test_json_array_and_maps(spark, tmp_path):
    p = write(tmp_path / "a.json", '[{"id": "x"},\n {"id": "y"}]')
    assert [r.id for r in readers.json_array(spark, p).orderBy("pos").collect()] == ["x", "y"]
    with pytest.raises(Exception):
        readers.json_array(spark, write(tmp_path / "b.json", '{"id": 1}')).collect()
    m = write(tmp_path / "m.json", json.dumps({"1": {"d1": ["a"], "d2": []}}))
    assert {(r.author, r.doc_id, tuple(r.ngramas)) for r in readers.documents_map(spark, m).collect()} == {("1", "d1", ("a",)), ("1", "d2", ())}
    assert readers.documents_map(spark, str(tmp_path / "nowhere.json")).collect() == []


@pytest.mark.parametrize("text", ['["1", " 2 ", "1"]', '[{"author_id": 1}, {"id": "2"}]', '{"authors": ["1", "2"]}', '{"1": {}, "2": []}'])
def test_author_ids(spark, tmp_path, text):
    assert sorted(r.author for r in readers.author_ids(spark, write(tmp_path / "i.json", text)).collect()) == ["1", "2"]


def test_qrels(spark, tmp_path):
    p = write(tmp_path / "q.tsv", "1\t0\ta b\t2\n1\t0\tbad\n2\t0\tc\tx\n3 0 d e -1\n")
    assert [(r.author, r.tag, r.weight) for r in readers.qrels(spark, p).collect()] == [("1", "a b", "2"), ("2", "c", "x")]
    assert [(r.author, r.tag, r.weight) for r in readers.qrels_by_pattern(spark, p).where("valid").collect()] == [("1", "a b", 2), ("3", "d e", -1)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 0.12345, 3)], "Autor string, m double, n int")
    sinks.metrics_csv(df, str(tmp_path / "m"))
    back = readers.csv(spark, str(tmp_path / "m"))
    assert back.columns == ["Autor", "m", "n"] and tuple(back.first()) == ("1", "0.1235", "3") or back.first().m == "0.1234"
    fixed = readers.metrics_csv(spark, write(tmp_path / "z.csv", "Autor;D@10;MAP@20;C@20;D@20;MV@10;MV@20\n1;0.5;4;6;0.1;0.2;0.3\n"), after="D@10")
    assert fixed.columns[2:] == list(readers.METRICS_ORDER) and fixed.first()["MV@10"] == 4.0
    with pytest.raises(ValueError):
        sinks.jsonl(df, str(tmp_path / "x"), (str(tmp_path / "x"),))


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("a/b.txt", "x")
    assert sinks.extract(tmp_path / "ok.zip", tmp_path / "out") == [tmp_path / "out/a/b.txt"]
    for bad in ("../x", "/x", "C:\\x", "a/../../x"):
        with pytest.raises(ValueError):
            sinks.safe_target(tmp_path, bad)


def test_profiles_from_lines(spark, tmp_path):
    p = readers.jsonl(spark, write(tmp_path / "d.jsonl", "\n".join(LINES)))
    a = spark.createDataFrame([("1",), ("2",), ("9",)], "author string")
    twice = {r.author: len(r.publicacoes) for r in profiles.structured_profile(p, a).collect()}
    once = {r.author: len(r.publicacoes) for r in profiles.structured_profile(p, a, distinct=True, keep_keyword_only=True).collect()}
    assert twice == {"1": 2, "2": 2} and once == {"1": 2, "2": 2}
    assert {r.author: r.n_publicacoes for r in profiles.labelled_profile(p, a).collect()} == {"1": 2, "2": 2, "9": 0}
    assert {(r.author, r.doc_id) for r in profiles.field_evidence(p, a).collect()} == {("1", "A-1"), ("2", "A-1"), ("1", "A-3")}
    assert [r.author for r in profiles.missing(a, p).collect()] == ["9"]


XML = """<CV xmlns="u"><DADOS-GERAIS NOME-COMPLETO="Someone"><FORMACAO-ACADEMICA-TITULACAO><GRADUACAO NOME-DO-CURSO="Química" ANO-DE-CONCLUSAO="1990" NOME-INSTITUICAO="U"/></FORMACAO-ACADEMICA-TITULACAO>
<AREAS-DE-ATUACAO><AREA-DE-ATUACAO NOME-DA-AREA-DO-CONHECIMENTO="Química"/><AREA-DE-ATUACAO NOME-DA-AREA-DO-CONHECIMENTO="Física"/></AREAS-DE-ATUACAO></DADOS-GERAIS>
<PRODUCAO-BIBLIOGRAFICA><ARTIGOS>{}</ARTIGOS></PRODUCAO-BIBLIOGRAFICA>
<PRODUCAO-TECNICA><SOFTWARE><A TITULO="s1" ANO="2001"/><A TITULO="s2" ANO="2003"/></SOFTWARE><PATENTE TITULO="p" ANO="2002"/></PRODUCAO-TECNICA></CV>"""


def test_curricula(spark):
    arts = "".join(f'<ARTIGO><DADOS-BASICOS-DO-ARTIGO TITULO-DO-ARTIGO="a{i}" ANO-DO-ARTIGO="{1980 + i % 20}" DOI="x"/><PALAVRAS-CHAVE PALAVRA-CHAVE-1="k{i}"/><AUTORES NOME="n"/></ARTIGO>' for i in range(40))
    files = spark.createDataFrame([("7", XML.format(arts)), ("8", "<broken")], "author string, content string")
    rec = curriculum.curriculum_records(files)
    assert rec.where("author = '8'").first().section is None
    out = curriculum.profile(files).collect()
    bib = sorted((r for r in out if r.section == "producao_bibliografica"), key=lambda r: r.recency)
    assert len(bib) == 30 and [r.titulo for r in bib[:3]] == ["a19", "a39", "a18"] and bib[0].palavras_chave == ["k19"] and bib[0].ano == "1999"
    tech = sorted((r for r in out if r.section == "producao_tecnica"), key=lambda r: r.recency)
    assert [r.titulo for r in tech] == ["s2", "p", "s1"]
    assert not any("NOME" in f.name and "COMPLETO" in f.name or f.name == "DOI" for r in rec.collect() for f in r.fields)
    u = {r.doc_id: r.pieces for r in curriculum.units(curriculum.profile(files)).collect()}
    assert u["formacao_academica_000"] == ["Química"] and u["areas_de_atuacao_001"] == ["Física"] and u["producao_bibliografica_000"] == ["a19", "k19"]


def test_generation_resumes(spark, tmp_path):
    cfg = generate.GenerationConfig(batch_size=2, n_tags=3)

    def failing(prompts, config, seed):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return generate.echo_generator(prompts, config, seed)

    prompts = spark.createDataFrame([("1", "good one"), ("2", "bad two")], "author string, prompt string").repartition(2, "author")
    path = str(tmp_path / "out")
    first = {r.author: (r.tags, r.error) for r in generate.resume(prompts, path, generate.GenerationConfig(batch_size=1, n_tags=3), failing).collect()}
    assert first["1"] == (["good", "one"], None) and first["2"][0] == [] and "no" in first["2"][1]
    again = {r.author: r.error for r in generate.resume(prompts, path, generate.GenerationConfig(batch_size=1, n_tags=3), retry_errors=True).collect()}
    assert again == {"1": None, "2": None}
    with pytest.raises(ValueError, match="another configuration"):
        generate.resume(prompts, path, cfg)
    with pytest.raises(ValueError):
        generate.GenerationConfig(mode="x").validate()
    greedy = generate.GenerationConfig(do_sample=False)
    assert greedy.identity() == generate.GenerationConfig(do_sample=False, temperature=0.1).identity() != cfg.identity()


def test_stream_adds_each_author_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("1", "a b"), ("2", "c")], "author string, prompt string").write.parquet(src)
    stream = spark.readStream.schema("author string, prompt string").parquet(src)
    for _ in range(2):
        q = incremental.generate_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        spark.createDataFrame([("2", "c"), ("3", "d")], "author string, prompt string").write.mode("append").parquet(src)
    assert sorted(r.author for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_curriculum_prompts(spark):
    import json

    empty = {"recency": None, "tipo": None, "ano": None, "titulo": None, "natureza": None, "palavras_chave": [], "areas": [], "vinculo_cargo": [], "curso": None, "linha": None}
    rows = [
        {"author": "1", "section": "producao_bibliografica", "pos": 5, "recency": 2, "titulo": "older", "ano": "2001"},
        {"author": "1", "section": "producao_bibliografica", "pos": 6, "recency": 1, "titulo": 'a "newer" one', "ano": "2020", "palavras_chave": ["k1", "k2"]},
        *({"author": "1", "section": s, "pos": k, "areas": [s]} for k, s in enumerate(curriculum.SECTIONS) if s != "producao_bibliografica"),
        {"author": "2", "section": "linhas_de_pesquisa", "pos": 0, "linha": "l"},
    ]
    schema = "author string, section string, pos int, recency int, tipo string, ano string, titulo string, natureza string, palavras_chave array<string>, areas array<string>, vinculo_cargo array<string>, curso string, linha string"
    names = [x.split()[0] for x in schema.split(", ")]
    df = spark.createDataFrame([tuple((empty | r)[n] for n in names) for r in rows], schema)
    told = generate.curriculum_json(df)
    got = {r.author: json.loads(r.curriculum) for r in told.collect()}
    assert list(got["1"]) == curriculum.SECTIONS and len(got["1"]) == 9 and got["2"] == {"linhas_de_pesquisa": [{"linha": "l"}]}
    assert got["1"]["producao_bibliografica"] == [{"ano": "2020", "titulo": 'a "newer" one', "palavras_chave": ["k1", "k2"]}, {"ano": "2001", "titulo": "older"}]
    m = {r.author: r.m for r in told.select("author", generate.curriculum_messages(F.col("curriculum"), generate.GenerationConfig(n_tags=7)).alias("m")).collect()}
    assert [x.role for x in m["2"]] == ["system", "user", "assistant", "user", "assistant", "user"] and "7 tags" in m["2"][-1].content and m["2"][-1].content.endswith('{"linhas_de_pesquisa":[{"linha":"l"}]}')
