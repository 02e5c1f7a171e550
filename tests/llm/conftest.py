import pytest

SCHEMA = "rec_id long, id string, title string, authors array<string>, issn string, abstract string, keywords array<string>, term string, n int, key long, df int, field string, text string, container long"


@pytest.fixture
def pubs(spark):
    """Publications from dicts, with extra columns whose names the operators use inside."""

    def make(*rows):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], SCHEMA)

    return make
