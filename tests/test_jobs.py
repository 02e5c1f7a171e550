import json

import pytest

from quillspark import jobs

DOCS = [
    {"id": "A-1", "title": "Qualidade da água", "authors": ["1", "2"], "keywords": ["rios"], "abstract": "Estudo de rios e lagos."},
    {"id": "A-2", "title": "Solos", "authors": ["2"], "abstract": "Erosão de solos tropicais."},
    {"id": "A-3", "title": "Outro", "authors": ["9"]},
]


@pytest.fixture
def files(tmp_path):
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, DOCS)))
    (tmp_path / "d.json").write_text(json.dumps(DOCS))
    (tmp_path / "a.json").write_text('["1", "2", "7"]')
    (tmp_path / "q.tsv").write_text("1\t0\trios\t3\n2\t0\tsolos\t2\n2\t0\tsolos \t1\n")
    (tmp_path / "p.json").write_text(json.dumps({"1": ["a", "a", "b"], "2": ["b"], "3": []}))
    return tmp_path


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def run(spark, *argv):
    jobs.main(list(map(str, argv)), spark)


def test_profiles_and_rankings(spark, files, capsys):
    f = files
    run(spark, "filter", "--documents", f / "d.jsonl", "--authors", f / "a.json", "--output", f / "kept")
    assert {r["id"] for r in lines(f / "kept")} == {"A-1", "A-2"}
    assert json.loads(capsys.readouterr().out) == {"read": 3, "kept": 2, "wanted": 3, "found": 2, "missing": 1, "links": 3}
    run(spark, "profiles-ft", "--documents", f / "d.json", "--authors", f / "a.json", "--output", f / "ft")
    assert [(r["author"], r["n_publicacoes"]) for r in lines(f / "ft")] == [("1", 1), ("2", 2), ("7", 0)]
    run(spark, "profiles-baseline", "--documents", f / "d.jsonl", "--qrels", f / "q.tsv", "--output", f / "base")
    assert any(r == {"author": "2", "ngram": "erosao", "freq": 1} for r in lines(f / "base/authors")) and len(lines(f / "base/documents")) == 3
    run(spark, "document-evidence", "--documents", f / "d.jsonl", "--qrels", f / "q.tsv", "--output", f / "ev")
    assert json.loads(capsys.readouterr().out) == {"documents_an_author": 1.5, "pieces_a_document": 8 / 3}
    run(spark, "pop", "--profiles", f / "p.json", "--output", f / "pop")
    assert {r["author"]: r["ranking"] for r in lines(f / "pop")}["1"] == [{"tag": "a", "freq": 2}, {"tag": "b", "freq": 1}]
    run(spark, "tfidf", "--profiles", f / "p.json", "--output", f / "tfidf")
    assert len(lines(f / "tfidf")) == 2


def test_dataset_and_generation(spark, files):
    f = files
    run(spark, "dataset", "--documents", f / "d.jsonl", "--qrels", f / "q.tsv", "--output", f / "set", "--forced-test-author", "1")
    parts = {p: [r["author"] for r in lines(f / "set" / p)] for p in ("train", "validation", "test")}
    assert sorted(sum(parts.values(), [])) == ["1", "2"] and parts["test"] == ["1"]
    run(spark, "profiles-structured", "--documents", f / "d.jsonl", "--qrels", f / "q.tsv", "--output", f / "st")
    for _ in range(2):
        run(spark, "generate", "--profiles", f / "st", "--output", f / "gen", "--n-tags", 3, "--no-do-sample")
    assert {r["author"] for r in lines(f / "gen/rankings")} == {"1", "2"}
    with pytest.raises(ValueError, match="another configuration"):
        run(spark, "generate", "--profiles", f / "st", "--output", f / "gen", "--n-tags", 4)


def test_inspection(spark, files, capsys):
    run(spark, "inspect", "--type", "qrels", "--input", files / "q.tsv")
    assert json.loads(capsys.readouterr().out)["valid"] == 3
    run(spark, "inspect", "--type", "jsonl", "--input", files / "d.jsonl")
    assert {"field": "abstract", "n": 2, "percent": 66.666667} in [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    run(spark, "inspect", "--type", "ids", "--input", files / "a.json")
    assert json.loads(capsys.readouterr().out) == {"distinct": 3}
    with pytest.raises(SystemExit):
        jobs.parser().parse_args(["pop"])
