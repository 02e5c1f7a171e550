"""The supervised set: records, random split by author, training targets."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import judgements


@dataclass(frozen=True)
class SplitConfig:
    seed: int = 42
    train: float = 0.70
    validation: float = 0.15
    test: float = 0.15
    forced_test_author: str | None = None

    def sizes(self, n: int) -> tuple[int, int, int]:
        """Held out: the ceiling of the held-out share, its test part again rounded up."""
        held = int(np.ceil(round(n * (1 - self.train), 9)))
        test = int(np.ceil(round(held * self.test / (self.test + self.validation), 9)))
        return n - held, held - test, test


def random_split(authors: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """author, split. A seeded permutation of the sorted authors; the list of authors of a supervised set is
    small by nature (humans judged each), and its size is checked before it is brought to the driver."""
    n = authors.select("author").distinct().count()
    if n > 1_000_000:
        raise ValueError(f"{n} authors: a permutation on the driver is for judged sets; use hash_split")
    names = [r.author for r in authors.select("author").distinct().orderBy("author").collect()]
    _, n_val, n_test = config.sizes(n)
    rng = np.random.RandomState(config.seed)
    order = rng.permutation(n)
    held, train = order[: n_val + n_test], order[n_val + n_test :]
    again = np.random.RandomState(config.seed).permutation(len(held))
    test, val = [names[held[i]] for i in again[:n_test]], [names[held[i]] for i in again[n_test:]]
    forced = config.forced_test_author
    if forced and forced not in test and test:
        give = min(test)
        for part in (train_names := [names[i] for i in train], val):
            if forced in part:
                part[part.index(forced)] = give
                test[test.index(give)] = forced
    else:
        train_names = [names[i] for i in train]
    rows = [(a, "train") for a in train_names] + [(a, "validation") for a in val] + [(a, "test") for a in test]
    return authors.sparkSession.createDataFrame(rows, "author string, split string")


def hash_split(authors: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """author, split by a hash of seed and author: any number of authors, no shuffle, stable when authors come.

    The first 32 bits of a digest that every engine has, so the same split can be made elsewhere."""
    u = F.conv(F.left(F.md5(F.concat(F.lit(f"{config.seed}:"), "author")), F.lit(8)), 16, 10).cast("long") / float(1 << 32)
    return authors.select("author", F.when(u < config.train, "train").when(u < config.train + config.validation, "validation").otherwise("test").alias("split"))


def check_split(split: DataFrame, authors: DataFrame) -> DataFrame:
    """check, failures: authors in two parts, authors without a part, parts of unknown authors."""
    twice = split.groupBy("author").agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit("in two parts").alias("check"))
    none = authors.select("author").distinct().join(split, "author", "left_anti").select(F.lit("without a part").alias("check"))
    extra = split.join(authors, "author", "left_anti").select(F.lit("unknown").alias("check"))
    return twice.unionAll(none).unionAll(extra).groupBy("check").agg(F.count(F.lit(1)).alias("failures"))


def supervised(profiles: DataFrame, gold: DataFrame, most: int = 50) -> DataFrame:
    """author, profile_text, n_publicacoes_usadas, publicacoes and the targets; authors without text go.

    profiles(author, publicacoes) as made by structured_profile with the extended cleaning."""
    p = profiles.select("author", F.slice("publicacoes", 1, most).alias("publicacoes"))
    p = p.select("author", X.profile_text(F.col("publicacoes"), most).alias("profile_text"), F.size("publicacoes").alias("n_publicacoes_usadas"), "publicacoes")
    return p.where("n_publicacoes_usadas > 0 and profile_text <> ''").join(judgements.training_targets(gold), "author")


def target_json(tags: Column) -> Column:
    return F.to_json(F.struct(tags.alias("tags")))


def masked_example(prompt: Column, target: Column, end: int, most: int = 8192, most_target: int = 1024) -> tuple[Column, Column]:
    """(input_ids, labels): prompt labels are -100; the target keeps its end mark and is cut to most_target."""
    t = F.concat(F.slice(target, 1, most_target - 1), F.array(F.lit(end)))
    p = F.slice(prompt, F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.size(t)))
    return F.concat(p, t), F.concat(F.array_repeat(F.lit(-100), F.size(p)), t)


def trainer_rows(rows: DataFrame, prompt: str, target: str, end: int, most: int = 8192, most_target: int = 1024) -> DataFrame:
    """rows with input_ids, attention_mask and labels in place of the token columns prompt and target."""
    ids, labels = masked_example(F.col(prompt), F.col(target), end, most, most_target)
    out = rows.withColumns({"input_ids": ids, "labels": labels}).drop(prompt, target)
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def split_identity(ids: Column, **options) -> Column:
    """A hash of the ordered ids and the options: the key under which results of a run are kept."""
    return F.sha2(F.concat(F.to_json(ids), F.lit(json.dumps(options, sort_keys=True))), 256)
