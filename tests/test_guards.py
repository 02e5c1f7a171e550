import json

import pytest
from pyspark.sql import functions as F

from quillspark import jobs
from quillspark.operators import curriculum, generate, guards, metrics, ordering, rankers
from quillspark.sources import readers, sinks


def authors(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "author string")


def test_author_sets(spark):
    a, b = authors(spark, "1", "2", "2"), authors(spark, "2", "3")
    assert {(r.author, r.side) for r in guards.differences(a, b).collect()} == {("1", "left"), ("3", "right")}
    guards.require_within(authors(spark, "2"), a, "x", "y")
    guards.require_same(a, authors(spark, "2", "1"), "x", "y")
    guards.require_apart(a, authors(spark, "9"), "x", "y")
    for check in (guards.require_within, guards.require_same, guards.require_apart):
        with pytest.raises(ValueError, match="3|1|2"):
            check(b, a, "x", "y")


def test_test_part_and_frozen_records(spark):
    split = spark.createDataFrame([("1", "train"), ("2", "validation"), ("3", "test"), ("4", "test")], "author string, split string")
    profiles = authors(spark, "1", "2", "3", "4").withColumn("p", F.lit(1))
    assert {r.author for r in guards.tested(authors(spark, "3", "4"), profiles, split).collect()} == {"3", "4"}
    with pytest.raises(ValueError, match="profiles lack: 4"):
        guards.tested(authors(spark, "3", "4"), profiles.where("author <> '4'"), split)
    with pytest.raises(ValueError, match="ranking and the test part differ: 4"):
        guards.tested(authors(spark, "3"), profiles, split)
    parts = {"train": authors(spark, "1"), "validation": authors(spark, "2"), "test": authors(spark, "3", "4")}
    guards.require_frozen(parts, split, {"test": 2})
    with pytest.raises(ValueError, match="expected 3"):
        guards.require_frozen(parts, split, {"test": 3})
    with pytest.raises(ValueError, match="differ: 1, 2"):
        guards.require_frozen(parts | {"train": authors(spark, "2")}, split)


def test_results_of_another_run_are_refused(spark, tmp_path):
    prompts = spark.createDataFrame([("1", "a"), ("2", "b")], "author string, prompt string")
    generate.resume(prompts, str(tmp_path / "r")).collect()
    with pytest.raises(ValueError, match="prompts lack: 2"):
        generate.resume(prompts.where("author = '1'"), str(tmp_path / "r"))
    assert generate.resume(prompts.where("author = '1'"), str(tmp_path / "r"), partial=True).count() == 2


def test_batches_have_seeds_of_their_own(spark):
    seen = spark.createDataFrame([(str(i), "x") for i in range(24)], "author string, prompt string").repartition(4, "author")
    out = generate.generate(seen, generate.GenerationConfig(batch_size=3), lambda ps, c, seed: [json.dumps([str(seed)])] * len(ps))
    seeds = {}
    for r in out.collect():
        seeds.setdefault(r.tags[0], []).append(r.author)
    assert max(map(len, seeds.values())) <= 3 and len(seeds) >= 8
    assert generate.batch_seed(42, ["1", "2"]) == generate.batch_seed(42, ["1", "2"]) != generate.batch_seed(42, ["2", "1"])


def test_finetuned_answers(spark):
    rows = spark.createDataFrame([("1", '<think>x</think>{"tags": ["a  b", " ", "c", "d"]}', None), ("2", None, "E"), ("3", "a, b; c", None)], "author string, response string, error string")
    assert {r.author: r.tags for r in generate.finetuned(rows, generate.GenerationConfig(n_tags=2)).collect()} == {"1": ["a b", "c"], "2": [], "3": ["a", "b"]}


@pytest.mark.parametrize("text,want,total", [('["1", "1", 2, true, null, ["x"], {"author_id": 3}, {"id": "4"}, {"x": 1}, " "]', ["1", "2", "3", "4"], 5), ('{"autores": ["a", "true"]}', ["a", "true"], 2), ('{"7": [], "8": {}}', ["7", "8"], 2)])
def test_ids_and_their_counts(spark, tmp_path, text, want, total):
    p = tmp_path / "i.json"
    p.write_text(text)
    assert sorted(r.author for r in readers.author_ids(spark, str(p), needed=True).collect()) == want
    assert tuple(readers.id_counts(spark, str(p)).first()) == (total, len(want), total - len(want))


def test_no_id_is_an_error(spark, tmp_path):
    (tmp_path / "i.json").write_text("[true, null]")
    assert readers.author_ids(spark, str(tmp_path / "i.json")).collect() == []
    with pytest.raises(ValueError, match="no author id"):
        readers.author_ids(spark, str(tmp_path / "i.json"), needed=True)


@pytest.mark.parametrize("name,text,want", [("a.json", '{"ID_12": {}, "3": 1}', ["12", "3"]), ("b.json", '["ID_1", {"Autor": "ID_2"}, {"id": 3}, {"z": 1}]', ["1", "2", "3"]), ("c.txt", "x ID_12345678 y\n1234567\n", ["12345678"])])
def test_ids_of_any_file(spark, tmp_path, name, text, want):
    (tmp_path / name).write_text(text)
    assert sorted(r.author for r in readers.author_ids_anywhere(spark, str(tmp_path / name)).collect()) == want


def test_line_counts_and_maps(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id": "1"}\n\nnot json\n["x"]\n{"id": "2"}\n')
    assert tuple(readers.line_counts(spark, str(tmp_path / "d.jsonl")).first()) == (4, 2)
    big = {f"a{i}": [{"titulo": "t" * (i % 50), "keywords": 'k"}{', "abstract": None}] for i in range(300)}
    (tmp_path / "m.json").write_text(json.dumps(big, indent=1, ensure_ascii=False))
    for chunk in (7, 1 << 20):
        assert readers.json_map_lines(str(tmp_path / "m.json"), str(tmp_path / "m.jsonl"), chunk) == 300
        assert {r["author"]: r["value"] for r in map(json.loads, (tmp_path / "m.jsonl").read_text().splitlines())} == big
    (tmp_path / "e.json").write_text("{}")
    assert readers.json_map_lines(str(tmp_path / "e.json"), str(tmp_path / "e.jsonl")) == 0
    for bad in ("[1]", '{"a": 1', '{"a" 1}'):
        (tmp_path / "x.json").write_text(bad)
        with pytest.raises(ValueError):
            readers.json_map_lines(str(tmp_path / "x.json"), str(tmp_path / "x.jsonl"))


def test_structured_profiles_are_validated(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"1": [{"titulo": "a", "keywords": "", "abstract": ""}], "2": []}))
    assert {r.author: len(r.publicacoes) for r in readers.structured_profiles(spark, str(tmp_path / "p.json")).collect()} == {"1": 1, "2": 0}
    for bad in ('{"1": "x"}', '{"1": [1]}', '{"1": [null]}', '{"1": null}', "[]"):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(Exception):
            readers.structured_profiles(spark, str(tmp_path / "b.json")).collect()


def test_kept_rows_need_their_identity(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert readers.kept(spark, path, "x") is None
    sinks.keep(authors(spark, "1", "2"), path, "x")
    assert readers.kept(spark, path, "x").count() == 2 and readers.kept(spark, path, "y") is None
    sinks.pairs(authors(spark, "2", "1"), str(tmp_path / "pairs"))
    assert readers.pairs(spark, str(tmp_path / "pairs")).count() == 2


def head(path):
    return next(p for p in sorted(path.glob("part-*"))).read_bytes()


def test_file_forms(spark, tmp_path):
    one = {f"{m}_{k}": 0.12345 for m in ("ndcg", "p", "r", "map") for k in (5, 10, 20)}
    ranking = spark.createDataFrame([("7", *one.values(), 3, 4)], "author string, " + ", ".join(f"{c} double" for c in one) + ", mv_10 long, mv_20 long")
    cov = spark.createDataFrame([("8", 1.0, 1.0)], "author string, c_10 double, c_20 double")
    div = spark.createDataFrame([("7", 0.5, 0.25)], "author string, d_10 double, d_20 double")
    sinks.author_metrics(metrics.author_table(ranking, cov, div, "pop"), str(tmp_path / "m"))
    lines = head(tmp_path / "m").decode().splitlines()
    assert lines[0].split(";") == ["Autor", "nDCG@10", "nDCG@20", "Precision@5", "Precision@10", "Precision@20", "Recall@5", "Recall@10", "Recall@20", "MAP@10", "Coverage@10", "Diversity@10", "MAP@20", "Coverage@20", "Diversity@20", "Match_Valido@10", "Match_Valido@20", "Modelo"]
    assert lines[1].startswith("ID_7;0.123") and lines[1].endswith(";0.0000;0.5000;" + lines[1].split(";")[12] + ";0.0000;0.2500;3;4;pop")
    sweep = spark.createDataFrame([(0.7, 2, 0.5, 0.4), (0.6, 2, 0.6, 0.5)], "theta double, authors long, p_5 double, ndcg_10 double")
    sinks.sensitivity(sweep, str(tmp_path / "s"))
    assert head(tmp_path / "s").decode("utf-8").splitlines() == ["﻿θ_matching,nDCG@10,P@5,N", "0.6,0.5,0.6,2", "0.7,0.4,0.5,2"]
    records = authors(spark, "1", "2", "3")
    sinks.splits(records, spark.createDataFrame([("1", "train"), ("3", "test"), ("2", "test")], "author string, split string"), str(tmp_path / "set"))
    assert head(tmp_path / "set/test_ids").decode("utf-8").splitlines() == ["﻿author_id", "2", "3"]
    assert [r.author_id for r in readers.csv(spark, str(tmp_path / "set/test_ids")).collect()] == [2, 3] or [r.author_id for r in readers.csv(spark, str(tmp_path / "set/test_ids")).collect()] == ["2", "3"]


def test_numbers_and_carried_values_of_hot_keys(spark):
    """Against one window over the key; nulls in key and value, ties and an empty table."""
    from pyspark.sql import Window

    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"), ((F.col("id") * 7919) % 4001).alias("s"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    w = Window.partitionBy("k").orderBy("s")
    got = ordering.numbered(rows, "n", ["k"], {"_b": (F.floor(F.col("s") / 100), False)}, ["s"])
    assert got.exceptAll(rows.withColumn("n", F.row_number().over(w))).isEmpty() and got.count() == 4000
    got = ordering.carried(rows, "last", F.col("v"), ["k"], F.floor(F.col("s") / 100), ["s"])
    assert got.exceptAll(rows.withColumn("last", F.last("v", True).over(w))).isEmpty() and got.count() == 4000
    assert ordering.numbered(rows.limit(0), "n", ["k"], {"_b": (F.col("s"), True)}, ["s"]).collect() == []
    bag = spark.createDataFrame([("h", f"t{i:04d}", i % 4) for i in range(2000)], "author string, ngram string, freq long")
    assert [r.tag for r in rankers.pop(bag).orderBy("rank").limit(3).collect()] == ["t0003", "t0007", "t0011"] and rankers.pop(bag, 2).count() == 2


XML = '<CV><LINHA-DE-PESQUISA TITULO-DA-LINHA-DE-PESQUISA="{}"/><LINHA-DE-PESQUISA TITULO-DA-LINHA-DE-PESQUISA="b"/></CV>'


def test_curriculum_job_and_report(spark, tmp_path, capsys):
    (tmp_path / "x").mkdir()
    for i in (11111111, 22222222, 33333333):
        (tmp_path / f"x/ID_{i}.xml").write_text(XML.format("a") if i < 30000000 else "<CV/>")
    (tmp_path / "q.tsv").write_text("ID_11111111\t0\trios\t3\n33333333\t0\tx\t2\n")
    jobs.main(["curricula", "--xml", str(tmp_path / "x"), "--qrels", str(tmp_path / "q.tsv"), "--output", str(tmp_path / "u")], spark)
    told = json.loads(capsys.readouterr().out)
    assert {k: told[k] for k in ("curricula", "judged", "not_judged", "missing", "extra")} == {"curricula": 3, "judged": 2, "not_judged": 1, "missing": 1, "extra": 0}
    assert told["units_by_section"]["linhas_de_pesquisa"] == 2 and told["mean_units"] == 2 and told["least_units"] == told["most_units"] == 2
    units = spark.createDataFrame([("9", "ensino_000", "ensino", ["a"])], "author string, doc_id string, section string, pieces array<string>")
    with pytest.raises(ValueError, match="1 authors have units"):
        curriculum.audit_report(authors(spark, "1"), authors(spark, "1"), units)


def test_new_jobs(spark, tmp_path, capsys):
    (tmp_path / "d.jsonl").write_text('{"id": "A", "title": "T", "authors": ["1"]}\nbad\n')
    (tmp_path / "a.json").write_text('["1", "5", "5"]')
    (tmp_path / "p.json").write_text(json.dumps({"1": ["a", "a"], "3": []}))
    jobs.main(["filter-report", "--documents", str(tmp_path / "d.jsonl"), "--authors", str(tmp_path / "a.json")], spark)
    assert json.loads(capsys.readouterr().out) == {"lines": 2, "invalid": 1, "kept": 1, "wanted": 2, "found": 1, "missing": 1, "examples": ["5"]}
    jobs.main(["inspect", "--type", "id-counts", "--input", str(tmp_path / "a.json")], spark)
    assert json.loads(capsys.readouterr().out) == {"total": 3, "distinct": 2, "repeated": 1}
    jobs.main(["map-lines", "--input", str(tmp_path / "p.json"), "--output", str(tmp_path / "p.jsonl")], spark)
    for name in ("pop", "tfidf"):
        jobs.main([name, "--profiles", str(tmp_path / "p.json"), "--output", str(tmp_path / name), "--keep-empty"], spark)
        rows = [json.loads(x) for f in (tmp_path / name).glob("part-*") for x in f.read_text().splitlines()]
        assert {r["author"]: len(r["ranking"]) for r in rows} == {"1": 1, "3": 0}
