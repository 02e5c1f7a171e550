import random

import numpy as np
import pytest
import xxhash

from quillspark.llm import near_duplicates as D


def brute(rows, threshold=0.75, least=20):
    sets = [(r["rec_id"], r.get("id"), D.words(r.get("title"), r.get("abstract"))) for r in rows]
    out = set()
    for i, (a, ia, x) in enumerate(sets):
        for b, ib, y in sets[:i]:
            if ia != ib and len(x) >= least and len(y) >= least and len(x & y) >= threshold * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def corpus(n=160, seed=7):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            base = rng.choice(rows)["abstract"].split()
            for _ in range(rng.randint(0, max(1, len(base) // 7))):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            rng.shuffle(base)
        else:
            base = rng.sample(vocab, rng.randint(15, 90))
        rows.append({"rec_id": k, "id": f"P-{rng.randint(0, n // 2)}", "title": None, "abstract": " ".join(base)})
    return rows


def found(df):
    return {(r.rec_id_a, r.rec_id_b) for r in df.collect()}


def test_against_brute_force(pubs):
    rows = corpus()
    want = brute(rows)
    got = found(D.near_duplicate_pairs(pubs(*rows)))
    assert len(want) > 50 and got <= want and len(want - got) <= 0.01 * len(want)


def test_streamed_buckets_are_those_of_one_batch(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 40, 900))
    cls, n, sig = rng.integers(0, 500, 900), np.full(900, 50, np.int32), np.zeros(900, np.int64)
    at = np.lexsort((cls, key))
    monkeypatch.setattr(D, "BUCKET", 22)

    def run(size):
        cols = (key[at], cls[at], n, sig, sig)
        parts = [pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in cols], names=list("abcde")) for k in range(0, 900, size)]
        out = set()
        for b in D._pairs(0.75)(iter(parts)):
            out |= set(zip(*(c.to_pylist() for c in b.columns)))
        return out

    whole = run(900)
    assert any(a == b for a, b in whole) and any(a != b for a, b in whole)
    for size in (1, 7, 64, 333):
        got = run(size)
        assert {p for p in got if p[0] != p[1]} == {p for p in whole if p[0] != p[1]} and {p[0] for p in got if p[0] == p[1]} == {p[0] for p in whole if p[0] == p[1]}


@pytest.mark.parametrize("similarity", [0.75, 0.8])
def test_screen_loses_less_than_one_in_a_million(similarity):
    from math import comb

    p, n = (1 - similarity) / 2, D.SIGNATURE
    assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(D.SCREEN + 1, n + 1)) < 1e-6


def test_pairs_of_a_bucket_pass_the_screen():
    import pyarrow as pa

    far = (1 << 34) - 1  # 34 bits differ
    cols = ([1, 1, 1], [10, 20, 30], np.full(3, 50, np.int32), [0, far, -1], [0, 0, -1])
    batch = pa.RecordBatch.from_arrays([pa.array(np.asarray(c)) for c in cols], names=list("abcde"))
    assert [tuple(c.to_pylist()) for b in D._pairs(0.75)(iter([batch])) for c in b.columns] == [(10,), (20,)]


def test_large_buckets_are_compared_whole():
    """Buckets of a thousand classes, as larger collections have, give near pairs only and no class as hot."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n = rng.integers(20, 90, 1000).astype(np.int32)
    sig = rng.integers(-(1 << 63), 1 << 63, (1000, D.SIGNATURE // 64), np.int64)
    for k in range(0, 1000, 4):
        sig[k + 1] = sig[k] ^ 5  # near, if of near size
    want = set()
    for i in range(1000):
        far = np.bitwise_count((sig ^ sig[i]).view(np.uint64)).astype(int).sum(axis=1)
        want |= {(min(i, j), max(i, j)) for j in np.flatnonzero(far <= D.SCREEN) if i != j and min(n[i], n[j]) >= 0.75 * max(n[i], n[j])}
    for size in (1000, 90):
        cols = (np.full(1000, 7), np.arange(1000), n, *sig.T.copy())
        parts = [pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in cols], names=list("abcdefgh"[: len(cols)])) for k in range(0, 1000, size)]
        got = [p for b in D._pairs(0.75)(iter(parts)) for p in zip(*(c.to_pylist() for c in b.columns))]
        assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_pairs_far_apart_seldom_leave_a_bucket():
    """A pair at similarity 0.4 shares a bucket by chance; their number grows with the square of the collection."""
    from math import comb

    p, n = 0.3, D.SIGNATURE
    assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(D.SCREEN + 1)) < 0.02


def test_hot_buckets_take_the_exact_way(pubs, monkeypatch):
    text = " ".join(f"c{i}" for i in range(60))
    rows = [{"rec_id": k, "id": f"P{k}", "title": f"x{k} y{k}", "abstract": text} for k in range(40)]
    monkeypatch.setattr(D, "BUCKET", 8)
    assert found(D.near_duplicate_pairs(pubs(*rows))) == brute(rows)


def test_copies_nulls_and_short_rows(pubs):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [
        {"rec_id": 1, "id": "a", "abstract": text},
        {"rec_id": 2, "id": "a", "abstract": text},  # same id: no case
        {"rec_id": 3, "id": "b", "title": text.upper()},
        {"rec_id": 4, "id": None, "abstract": text},
        {"rec_id": 5, "id": "c"},
        {"rec_id": 6, "id": "d", "abstract": ""},
        {"rec_id": 7, "id": "e", "abstract": "one two three"},
        {"rec_id": 8, "id": "f", "abstract": "one two three"},
        {"rec_id": 9, "id": "g", "abstract": text + " " + "x" * 100_000},
    ]
    assert found(D.near_duplicate_pairs(pubs(*rows))) == brute(rows)
    classes = {r.rec_id: (r.class_id, r.copies, r.links) for r in D.near_duplicate_classes(pubs(*rows)).collect()}
    assert len(classes) == 9 and classes[3] == (1, 4, 1) and classes[9] == (9, 1, 1) and classes[7] == (7, 1, 0)


def test_empty(pubs):
    assert D.near_duplicate_pairs(pubs()).collect() == [] and D.near_duplicate_classes(pubs()).collect() == []


@pytest.mark.parametrize("n,common", [(40, 30), (200, 150), (3, 2)])
def test_sketch_estimates(n, common):
    h = lambda p, k: [xxhash.xxh3_64_intdigest(f"{p}{i}") for i in range(k)]
    est = []
    for seed in range(30):
        both = h(f"{seed}c", common)
        a, b = both + h(f"{seed}a", n - common), both + h(f"{seed}b", n - common)
        s = D.sketch(np.array([n, n]), np.array(a + b, np.uint64))
        assert not (s == D._EMPTY).any()
        est.append((s[0] == s[1]).mean())
    assert abs(np.mean(est) - common / (2 * n - common)) < 0.08
