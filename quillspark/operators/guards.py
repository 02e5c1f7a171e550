"""Checks that stop a run whose author sets don't fit. Sets are compared by anti-joins; only a few names of what
is wrong come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = 10


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """author, side: left or right, where the author stands alone."""
    a, b = left.select("author").distinct(), right.select("author").distinct()
    return a.join(b, "author", "left_anti").select("author", F.lit("left").alias("side")).unionAll(b.join(a, "author", "left_anti").select("author", F.lit("right").alias("side")))


def _refuse(wrong: DataFrame, said: str) -> None:
    some = [r.author for r in wrong.select("author").orderBy("author").limit(EXAMPLES).collect()]
    if some:
        raise ValueError(f"{said}: {', '.join(some)}{', ...' if len(some) == EXAMPLES else ''}")


def require_within(part: DataFrame, whole: DataFrame, name: str, of: str) -> None:
    """Every author of part is in whole."""
    _refuse(part.select("author").distinct().join(whole.select("author"), "author", "left_anti"), f"{name} have authors that {of} lack")


def require_same(left: DataFrame, right: DataFrame, name: str, of: str) -> None:
    """Both have the same authors."""
    _refuse(differences(left, right).select("author"), f"authors of {name} and {of} differ")


def require_apart(left: DataFrame, right: DataFrame, name: str, of: str) -> None:
    """No author is in both."""
    _refuse(left.select("author").distinct().join(right.select("author"), "author", "left_semi"), f"{name} and {of} share authors")


def tested(ranking: DataFrame, profiles: DataFrame, split: DataFrame) -> DataFrame:
    """The profiles of the test part. All its authors must have a profile, and the ranking exactly those authors."""
    test = split.where("split = 'test'").select("author")
    require_within(test, profiles, "the test part", "the profiles")
    require_same(ranking, test, "the ranking", "the test part")
    return profiles.join(test.distinct(), "author", "left_semi")


def require_frozen(parts: dict[str, DataFrame], split: DataFrame, expected: dict[str, int] | None = None) -> None:
    """Records of train, validation and test are those of the split, apart from each other and of the expected number."""
    names = list(parts)
    for k, name in enumerate(names):
        require_same(parts[name], split.where(F.col("split") == name), f"the {name} records", f"the {name} part")
        for other in names[k + 1 :]:
            require_apart(parts[name], parts[other], name, other)
        if expected and name in expected and (n := parts[name].count()) != expected[name]:
            raise ValueError(f"{n} {name} records, expected {expected[name]}")
