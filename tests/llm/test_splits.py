import random

from quillspark.llm import splits


def test_components_against_union_find(spark):
    rng = random.Random(3)
    rows = [([str(rng.randint(1, 150)) for _ in range(rng.randint(0, 3))],) for _ in range(120)]
    rows += [([str(k), str(k + 1)],) for k in range(1000, 1040)]  # a long chain
    rows += [(["9999", str(k)],) for k in range(5000, 5060)]  # a hub
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for (xs,) in rows:
        for x in xs:
            a, b = sorted((root(xs[0]), root(x)))
            parent[b] = a
    groups = {}
    for x in parent:
        groups.setdefault(root(x), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g if len(g) > 1}
    got = {r.n: r.group_id for r in splits.components(splits.coauthor_edges(spark.createDataFrame(rows, "authors array<string>"))).collect()}
    assert got == want


def test_groups_and_dirty_entries(spark):
    p = spark.createDataFrame([([" 5 ", "ID_7", None, "0", "N/I", "7"],), (None,), ([],), (["7", "30"],), (["0", "11"],)], "authors array<string>")
    a = spark.createDataFrame([("ID_7",), (" 30",), ("30",), ("11",), ("000",), (None,), ("99",)], "author_id string")
    assert {r.author_id: r.group_id for r in splits.author_groups(a, p).collect()} == {"7": "30", "30": "30", "11": "11", "99": "99"}
    assert splits.author_groups(a.limit(0), p).collect() == []
    assert {r.group_id for r in splits.author_groups(a, p.limit(0)).collect()} == {"7", "30", "11", "99"}


def test_split_keeps_groups_and_proportions(spark):
    rows = [(f"a{i}", f"g{i // 3}") for i in range(3000)] + [(f"big{i}", "giant") for i in range(900)]
    got = splits.split_groups(spark.createDataFrame(rows, "author_id string, group_id string")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.group_id, set()).add(r.split)
    assert len(got) == 3900 and all(len(p) == 1 for p in parts.values()) and parts["giant"] == {"train"}
    share = {s: sum(r.split == s for r in got) / len(got) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["validation"] - 0.15) < 0.02
    assert splits.split_groups(spark.createDataFrame([], "author_id string, group_id string")).collect() == []
