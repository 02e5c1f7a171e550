import numpy as np
import pytest

from quillspark.operators import analysis, dataset, judgements, matching, metrics, rankers, vectors


def numpy_greedy(sim, theta):
    order = np.argsort(-sim.ravel(), kind="stable")
    out, pi, gj = [], set(), set()
    for k in order:
        i, j = divmod(int(k), sim.shape[1])
        if sim[i, j] < theta or sim[i, j] <= 0:
            break
        if i not in pi and j not in gj:
            pi.add(i)
            gj.add(j)
            out.append((i, j))
    return sorted(out)


def test_greedy_equals_numpy_with_ties(spark):
    rng = np.random.default_rng(4)
    want, rows = {}, []
    for a in range(25):
        sim = np.round(rng.random((int(rng.integers(1, 20)), int(rng.integers(1, 60)))) * 8) / 8 - 0.2
        want[str(a)] = numpy_greedy(sim, 0.4)
        rows += [(str(a), i, j, float(sim[i, j])) for i in range(sim.shape[0]) for j in range(sim.shape[1])]
    got = {}
    for r in matching.greedy(spark.createDataFrame(rows, "author string, i int, j int, sim double"), 0.4).collect():
        got.setdefault(r.author, []).append((r.i, r.j))
    assert {a: sorted(x) for a, x in got.items()} == {a: x for a, x in want.items() if x}


def reference_metrics(w, gold, k):
    dcg = sum((2**x - 1) / np.log2(i + 2) for i, x in enumerate(w[:k]) if x > 0)
    idcg = sum((2**x - 1) / np.log2(i + 2) for i, x in enumerate(sorted(gold, reverse=True)[:k]) if x > 0)
    hit = [x >= 2 for x in w[:k]]
    rel = sum(x >= 2 for x in gold)
    ap = sum(sum(hit[: i + 1]) / (i + 1) for i in range(len(hit)) if hit[i])
    return dcg / idcg if idcg else 0.0, sum(hit) / k, sum(hit) / rel if rel else 0.0, ap / rel if rel else 0.0, sum(x >= 1 for x in w[:k])


def test_metrics_on_small_cases(spark):
    rng = np.random.default_rng(1)
    cases = {"none": ([0, 0], [1, 1]), "short": ([3], [3, 2, 1])}
    for n in range(12):
        cases[str(n)] = (rng.integers(0, 4, int(rng.integers(1, 25))).tolist(), rng.integers(1, 4, int(rng.integers(1, 40))).tolist())
    m = spark.createDataFrame([(a, i + 1, int(x)) for a, (w, _) in cases.items() for i, x in enumerate(w)], "author string, rank int, weight int")
    g = spark.createDataFrame([(a, int(x)) for a, (_, gs) in cases.items() for x in gs], "author string, weight int")
    for r in metrics.ranking_metrics(m, g).collect():
        for k in (5, 10, 20):
            want = reference_metrics(*cases[r.author], k)
            assert np.allclose([r[f"ndcg_{k}"], r[f"p_{k}"], r[f"r_{k}"], r[f"map_{k}"], r[f"mv_{k}"]], want), (r.author, k)


def test_diversity(spark):
    v = np.eye(4)[[0, 0, 1, 2]].tolist()
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("b", 0, v[0])], "author string, i int, vector array<double>")
    got = {r.author: (r.d_10, r.d_20) for r in metrics.diversity(df).collect()}
    assert np.allclose(got["a"], 1 - 2 / 12) and got["b"] == (0.0, 0.0)


def test_coverage_counts_documents_without_ngrams(spark):
    docs = spark.createDataFrame([("a", "1", ["x", "x"]), ("a", "2", []), ("a", "3", ["y"]), ("a", "4", ["z"])], "author string, doc_id string, ngramas array<string>")
    pred = spark.createDataFrame([("a", 1, "x"), ("a", 15, "y")], "author string, rank int, tag string")
    pairs = spark.createDataFrame([("a", "2", 0, 0.8), ("a", "4", 0, 0.5), ("a", "1", 0, 0.1)], "author string, doc_id string, i int, sim double")
    s = metrics.document_scores(metrics.covered_exactly(docs, pred), pairs)
    r = metrics.coverage(s, 0.75).first()
    assert (r.c_10, r.c_20) == (0.5, 0.75)
    sweep = {x.theta: x.c_20 for x in analysis.sweep_coverage(s, (0.4, 0.75)).collect()}
    assert sweep == {0.4: 1.0, 0.75: 0.75}


def test_rankers(spark):
    p = spark.createDataFrame([("1", ["a", "a", "b"]), ("ID_1", ["c"]), ("2", ["a"]), ("3", []), (None, ["z"])], "autor_id string, ngramas array<string>")
    bag = rankers.bag(p)
    assert [(r.author, r["rank"], r.tag, r.freq) for r in rankers.pop(bag).orderBy("author", "rank").collect()] == [("1", 1, "a", 2), ("1", 2, "b", 1), ("1", 3, "c", 1), ("2", 1, "a", 1)]
    got = {(r.author, r.tag): r.score for r in rankers.tfidf(bag, rankers.authors_total(p)).collect()}
    assert np.isclose(got["1", "a"], np.log10(3 / 2)) and np.isclose(got["1", "b"], 0.5 * np.log10(3))
    t = spark.createDataFrame([("a", ["A", "A", " ", "B"])], "author string, tags array<string>")
    assert [(r.tag, r.score) for r in rankers.positional(t).orderBy("rank").collect()] == [("A", 4), ("B", 1)]


def test_gold(spark):
    q = spark.createDataFrame([("ID_1", 0, "a  b", "2", 0), ("1", 0, "a b ", "3", 1), ("1", 0, "c", "x", 2), ("1", 0, "", "2", 3), ("2", 0, "d", "-1", 4), ("2", 0, "e", "7", 5)], "author string, iter int, tag string, weight string, pos int")
    assert {(r.author, r.tag, r.weight, r.tag_original) for r in judgements.gold(q).collect()} == {("1", "a b", 3, "a  b"), ("2", "d", -1, "d"), ("2", "e", 7, "e")}
    assert [(r.author, r.tag) for r in judgements.gold(q, True).collect()] == [("1", "a b")]


def test_similarities_and_lookup(spark):
    words = vectors.vocabulary(spark.createDataFrame([("a b",), ("a b",), ("",), (None,)], "x string"), spark.createDataFrame([("zz",)], "y string"))
    emb = vectors.embed(words)
    assert {r.text for r in emb.collect()} == {"a b", "zz"}
    rows = vectors.lookup(spark.createDataFrame([("u", 0, "a b"), ("u", 1, "nowhere")], "author string, i int, tag string"), "tag", emb, 64)
    gold = rows.select("author", rows["i"].alias("j"), "vector")
    sims = {(r.i, r.j): r.sim for r in vectors.similarities(rows, gold, ["j"]).collect()}
    assert np.isclose(sims[0, 0], 1, atol=1e-5) and sims[1, 0] == sims[1, 1] == 0


def test_splits(spark):
    a = spark.createDataFrame([(f"{i:04d}",) for i in range(1431)], "author string")
    assert dataset.SplitConfig().sizes(1431) == (1001, 215, 215)
    s = dataset.random_split(a, dataset.SplitConfig(forced_test_author="0007"))
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"train": 1001, "validation": 215, "test": 215}
    assert s.where("author = '0007'").first().split == "test" and dataset.check_split(s, a).collect() == []
    h = dataset.hash_split(a)
    assert abs(h.where("split = 'train'").count() / 1431 - 0.7) < 0.05


def test_comparison_of_systems(spark):
    one = lambda rows: spark.createDataFrame(rows, "author string, m double")
    areas = spark.createDataFrame([("1", "X"), ("2", "X"), ("3", "Y"), ("4", None)], "author string, area string")
    c = analysis.compare(one([("1", 0.5), ("2", 0.5), ("3", 0.1), ("4", 1.0)]), one([("1", 0.491), ("2", 0.3), ("3", 0.2), ("4", 0.0)]), areas, "m")
    assert {r.author: r.outcome for r in c.collect()} == {"1": "tie", "2": "win", "3": "loss"}
    o = {r.area: (r.win, r.tie, r.loss) for r in analysis.outcomes(c).collect()}
    assert o == {"X": (1, 1, 0), "Y": (0, 0, 1)}
    assert {r.area: r.winner for r in analysis.by_area(c, "m").collect()} == {"X": "a", "Y": "b"}


@pytest.mark.parametrize("points,ask,want", [([(1, 1.0), (5, 2.0)], 4, 1.0), ([(1, 1.0), (5, 2.0)], 5, 2.0), ([(3, 1.0)], 2, None)])
def test_last_known(spark, points, ask, want):
    p = spark.createDataFrame([("r", s, v) for s, v in points], "run string, step int, value double")
    assert analysis.last_known(p, spark.createDataFrame([("r", ask)], "run string, step int")).first().value == want


def test_training_examples(spark):
    from pyspark.sql import functions as F

    ids, labels = dataset.masked_example(F.col("p"), F.col("t"), 9)
    r = spark.createDataFrame([([1, 2], [3])], "p array<int>, t array<int>").select(ids.alias("i"), labels.alias("l")).first()
    assert r.i == [1, 2, 3, 9] and r.l == [-100, -100, 3, 9]
