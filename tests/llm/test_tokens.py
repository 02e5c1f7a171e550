import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import packing, splitting
from quillspark.llm import tokenizing as T

TEXTS = [None, "", " ", "\n\n\t x", "São Paulo não é aqui.", "<|endoftext|>", "a" * 30_000, "漢字" * 4000, " " * 9000 + "x", "né" * 9000 + "  \n\n b", "🎉é" * 700]


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.VOCABULARIES + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_corpus_is_encoded_as_by_the_other_library(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string").selectExpr("*", "1 as ids")
    got = sorted((r.doc_id, r.ids) for r in T.encode_corpus(df).collect())
    assert got == sorted([*enumerate(reference(TEXTS)), (3, reference(TEXTS)[3])])
    assert T.encode_corpus(df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeth=+/0139éçã漢", min_size=1, max_size=4000), st.sampled_from([8, 64, 500]))
def test_tree_concatenation_is_exact(text, leaf):
    enc, raw = T.encoding(), text.encode()
    was, T.LEAF = T.LEAF, leaf
    try:
        assert T.encode_piece(enc, raw) == enc._encode_single_piece(raw)
    finally:
        T.LEAF = was


def check_packing(rows, sizes, capacity):
    used, parts = {}, {}
    for r in rows:
        if r.container is None:
            assert r.n_tokens == 0
            continue
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    assert all(u <= capacity for u in used.values())
    for d, n in sizes:
        if n:
            p = sorted(parts[d])
            assert sum(k for _, k in p) == n and len(p) == max(1, -(-n // capacity))
            assert [s for s, _ in p] == [i * capacity for i in range(len(p))]
    return used


def test_packing(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, 5, 30, 99, 100, 101, 250, rng.randint(1, 100)])) for i in range(700)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int").repartition(20)
    rows = packing.pack(df, 100, 8).collect()
    used = check_packing(rows, sizes, 100)
    least = -(-sum(n for _, n in sizes) // 100)
    assert len(used) <= 1.06 * least + 1
    assert packing.pack(df.limit(0), 100).collect() == []


def test_packing_of_documents(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    counts = T.token_counts(df)
    check_packing(packing.pack(counts, 2048).collect(), [(r.doc_id, r.n_tokens) for r in counts.collect()], 2048)


LONG = "# One\n\n" + "This is a sentence of the text. " * 90 + "\n\n# Two\n\n" + "- item one\n- item two\n" * 60 + "x" * 5000 + "\n\n" + "Última frase com acentuação é aqui! " * 200


@pytest.mark.parametrize("text", [LONG, "漢字" * 3000, "a" * 9000, " \n" * 4000, "🎉" * 900, LONG.replace(" ", "")])
@pytest.mark.parametrize("limit,overlap", [(512, 64), (64, 0), (40, 20)])
def test_pieces_cover_the_text(text, limit, overlap):
    enc = T.encoding()
    ps = splitting.split_text(enc, text, limit, overlap)
    assert ps[0][0] == 0 and ps[-1][1] == len(text)
    for (a, b, n, _), nxt in zip(ps, [*ps[1:], None]):
        assert 0 < n <= limit and n == len(T.encode_text(enc, text[a:b]))
        if nxt:
            assert a < nxt[0] <= b < nxt[1] and len(T.encode_text(enc, text[nxt[0] : b])) <= overlap + 2


def test_pieces_end_at_natural_boundaries(spark):
    df = spark.createDataFrame([(1, LONG), (2, "short"), (3, None), (4, "")], "doc_id long, text string")
    rows = splitting.split_oversized(df).collect()
    assert {r.doc_id for r in rows} == {1} and {"section", "sentence", "end"} <= {r.level for r in rows}
    with pytest.raises(ValueError):
        splitting.split_oversized(df, 64, 60)
