"""Fixed tables, made by reading every field of the smallest publications that has a sign of markup or a letter
that isn't ASCII."""

from quillspark.llm import queries

SF = "/root/testdata/sf0.001"

MARKUP = {
    "abstract": [11, 22, 41, 48, 59, 61, 63, 76, 112, 115, 134],
    "title": [37, 58, 66, 69, 79, 93, 97, 105, 131],
}
#: Fields with signs of prose: C++, (3 < pH < 7), R$ 8,00 = US$ 2, [306 ± 44], (x = y_2), (<18; >60), [s. n.], a hyphen alone.
PROSE = [6, 8, 35, 44, 47, 92, 99, 103, 110, 127, 128, 133]
GARBLED = {"abstract": [12, 25, 126, 134], "title": [105, 125]}


def found(spark, query):
    got = {"abstract": [], "title": []}
    for r in queries.QUERIES[query](spark, SF).orderBy("rec_id").collect():
        got[r.field].append(r.rec_id)
    return got


def test_markup(spark):
    got = found(spark, "p3_found")
    assert got == MARKUP and not set(PROSE) & set(got["abstract"])


def test_wrong_decoding(spark):
    assert found(spark, "p6_found") == GARBLED
