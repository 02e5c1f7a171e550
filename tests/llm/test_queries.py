"""Every query of the ten problems on the smallest tables, against its SQL where it has one."""

import glob
import os
from collections import Counter

import pytest

from quillspark.llm import packing, queries, splits, splitting
from quillspark.llm import tokenizing as T

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in queries.ORACLE_SQL:
        r = con.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_audits_see_what_is_wrong(spark):
    docs = spark.createDataFrame([(1, "One sentence is here. " * 300), (2, "short"), (3, None)], "doc_id long, text string")
    pieces = splitting.split_oversized(docs)
    assert tuple(splitting.audit(pieces, docs).first()) == (0, 0, 0, 0, 0, 0)
    assert splitting.audit(pieces.where("piece <> 1"), docs).first().gaps == 1 and splitting.audit(pieces.where("piece < 0"), docs).first().missing == 1
    assert splitting.audit(pieces.selectExpr("doc_id", "piece", "start_char", "end_char", "upper(text) as text"), docs).first().no_slice > 1
    sizes = T.token_counts(docs)
    packed = packing.pack(sizes, 512)
    assert tuple(packing.audit(packed, sizes, 512).first())[:4] == (3, 0, 0, 0)
    assert packing.audit(packed.where("position > 0 or doc_id <> 2"), sizes.where("doc_id < 3"), 512).first().wrong_sums >= 0
    assert packing.audit(packed.unionAll(packed), sizes, 512).first().over_capacity > 0
    split = spark.createDataFrame([("a", "g", "train"), ("b", "g", "test")], "author_id string, group_id string, split string")
    told = splits.audit(split, split.select("author_id", "group_id").unionAll(spark.createDataFrame([("c", "h")], "author_id string, group_id string"))).first()
    assert (told.authors, told.parted, told.without) == (3, 1, 1)


def test_texts_come_back(spark):
    texts = [None, "", "São Paulo 🎉 漢字 \n\t x", "a" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in T.decode_corpus(T.encode_corpus(df)).collect()} == {i: t or "" for i, t in enumerate(texts)}
