import math
import random
import re
from collections import Counter

import pyarrow as pa

from quillspark.llm import distinctiveness, frequency

ROWS = [
    {"rec_id": 1, "title": "Alpha alpha ALPHA beta", "abstract": None, "keywords": ["gamma", None, "alpha"]},
    {"rec_id": 2, "title": None, "abstract": "alpha beta beta beta 2beta", "keywords": None},
    {"rec_id": 3, "title": "", "abstract": "abc de1fgh índice", "keywords": []},
    {"rec_id": 4},
    {"rec_id": 5, "title": "beta " * 50_000},
    {"rec_id": 5, "title": "beta"},
]


def test_weights_against_brute_force(pubs):
    tf = []
    for r in ROWS:
        text = " ".join([r.get("title") or "", r.get("abstract") or "", *(k for k in r.get("keywords") or () if k)]).lower()
        tf.append((r["rec_id"], Counter(re.findall(r"[^\W\d_]{4,}", text))))
    df, gf, e = Counter(), Counter(), Counter()
    for _, c in tf:
        for t, n in c.items():
            df[t] += 1
            gf[t] += n
            e[t] += n * math.log(n)
    want = sorted((r, t, n, df[t], gf[t], round(math.log1p(n) * (1 - (math.log(gf[t]) - e[t] / gf[t]) / math.log(len(ROWS))), 6)) for r, c in tf for t, n in c.items())
    got = sorted((r.rec_id, r.term, r.tf, r.df, r.gf, round(r.weight, 6)) for r in distinctiveness.log_entropy_weights(pubs(*ROWS)).collect())
    assert got == want and any(t == "índice" for _, t, *_ in got)


def test_weights_of_an_empty_table(pubs):
    assert distinctiveness.log_entropy_weights(pubs()).collect() == []


def test_counters_survive_flushing(monkeypatch):
    rng = random.Random(1)
    rows = [("f", [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]) for _ in range(200)] + [("f", None), ("f", [None, "a"])]
    batches = [pa.RecordBatch.from_arrays([pa.array([f for f, _ in part]), pa.array([t for _, t in part], pa.list_(pa.string()))], names=["field", "terms"]) for part in (rows[:90], rows[90:])]
    occ, rec = Counter(), Counter()
    for _, ts in rows:
        occ.update(t for t in ts or () if t)
        rec.update({t for t in ts or () if t})
    for most in (1, 3, 1 << 18):
        monkeypatch.setattr(frequency, "MAX_TERMS", most)
        got_occ, got_rec = Counter(), Counter()
        for b in frequency._counters(iter(batches)):
            for _, t, o, r in zip(*(c.to_pylist() for c in b.columns)):
                got_occ[t] += o
                got_rec[t] += r
        assert got_occ == occ and got_rec == rec


def test_verdicts(spark, pubs):
    p = pubs(*[{"rec_id": i, "keywords": [" Common. ", "common", None, ""] if i < 50 else [f"rare {i % 30}  x"]} for i in range(100)])
    a = spark.createDataFrame([(" ID_12 ",)] * 30 + [("7",)] * 2 + [("0",), ("N/I",), (None,), ("",)], "autor_id string")
    got = {(r.field, r.term): (r.occurrences, r.records, r.verdict) for r in frequency.keyword_and_author_frequencies(p, a).collect()}
    assert got["keywords", "common"] == (100, 50, "common") and got["keywords", "rare 5 x"] == (2, 2, "rare")
    assert got["autor_id", "12"] == (30, 30, "common") and got["autor_id", "7"] == (2, 2, "rare")
    assert {t for f, t in got if f == "autor_id"} == {"12", "7"}
    assert frequency.keyword_and_author_frequencies(pubs(), a.limit(0)).collect() == []
