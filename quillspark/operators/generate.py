"""Prompts and batched, resumable generation with a pluggable generator."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.parsing import finetuned_tags, parse_response
from quillspark.operators.curriculum import SECTIONS
from quillspark.operators.guards import require_within

SYSTEM = "You name the areas of expertise of a researcher. Answer with one JSON object and nothing else."
TASK = 'Read the publications below and answer with the {n} tags that describe the author best, most certain first, as {{"tags": ["...", "..."]}}.'
EXAMPLE = ("Publications:\nTítulo: Example title", '{"tags": ["example tag", "another tag"]}')

CURRICULUM_TASK = 'Read the curriculum below and answer with the {n} tags that describe the author best, most certain first, as {{"tags": ["...", "..."]}}. Weigh all sections together, keep the language of the evidence and name no persons, institutions or posts.'
CURRICULUM_EXAMPLES = [
    ('Curriculum:\n{"formacao_academica":[{"curso":"Example course"}],"linhas_de_pesquisa":[{"linha":"Example line"}]}', '{"tags": ["example tag", "another tag"]}'),
    ('Curriculum:\n{"ensino":[{"disciplinas":["Disciplina de exemplo"]}]}', '{"tags": ["tag de exemplo", "outra tag"]}'),
]


@dataclass(frozen=True)
class GenerationConfig:
    n_tags: int = 30
    max_publications: int = 50
    mode: str = "few_shot"
    batch_size: int = 4
    max_new_tokens: int = 1024
    do_sample: bool = True
    temperature: float = 0.7
    top_p: float = 0.8
    top_k: int = 20
    min_p: float = 0.0
    repetition_penalty: float = 1.0
    seed: int = 42
    thinking: bool = False

    def validate(self) -> "GenerationConfig":
        if self.mode not in ("few_shot", "zero_shot"):
            raise ValueError(f"mode {self.mode!r}")
        for name in ("n_tags", "max_publications", "batch_size", "max_new_tokens"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.do_sample and not (self.temperature > 0 and 0 < self.top_p <= 1 and self.top_k >= 0 and 0 <= self.min_p <= 1):
            raise ValueError("sampling options out of range")
        if self.repetition_penalty <= 0:
            raise ValueError("repetition_penalty must be positive")
        return self

    def identity(self) -> str:
        """Sampling options don't tell runs apart that don't sample."""
        d = asdict(self)
        if not self.do_sample:
            d |= dict.fromkeys(("temperature", "top_p", "top_k", "min_p"))
        return hashlib.sha256(json.dumps(d, sort_keys=True).encode()).hexdigest()


def publication_lines(publications: Column, most: int) -> Column:
    def one(p):
        lines = [F.when(p[k] != "", F.concat(F.lit(f"{label}: "), p[k])) for label, k in (("Título", "titulo"), ("Palavras-chave", "keywords"), ("Resumo", "abstract"))]
        return F.concat_ws("\n", *lines)

    return F.array_join(F.transform(F.slice(publications, 1, most), one), "\n\n")


def chat_messages(publications: Column, config: GenerationConfig = GenerationConfig()) -> Column:
    """array<struct<role, content>>: system, an example pair in few-shot mode, the task with the publications."""
    config.validate()
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    task = F.concat(F.lit(TASK.format(n=config.n_tags) + "\n\nPublications:\n"), publication_lines(publications, config.max_publications))
    few = [say("user", F.lit(EXAMPLE[0])), say("assistant", F.lit(EXAMPLE[1]))] if config.mode == "few_shot" else []
    return F.array(say("system", F.lit(SYSTEM)), *few, say("user", task))


def curriculum_json(compacted: DataFrame) -> DataFrame:
    """curriculum.profile(...) -> author, curriculum: the sections in their order as one JSON object, each a list of its
    records by recency, then place; fields a record lacks are left out."""
    kinds = dict(compacted.drop("author", "section", "pos", "recency").dtypes)
    told = [F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("array") else F.when(F.col(c) != "", F.col(c)).alias(c) for c, t in kinds.items()]
    rows = compacted.where(F.col("section").isin(*SECTIONS)).select("author", "section", F.struct(F.coalesce("recency", "pos").alias("o"), "pos", F.to_json(F.struct(*told)).alias("record")).alias("x"))
    per = rows.groupBy("author").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.col("x")))), lambda x: x["record"]), ",").alias(s) for s in SECTIONS])
    return per.select("author", F.concat(F.lit("{"), F.concat_ws(",", *[F.when(F.col(s) != "", F.concat(F.lit(f'"{s}":['), F.col(s), F.lit("]"))) for s in SECTIONS]), F.lit("}")).alias("curriculum"))


def curriculum_messages(curriculum: Column, config: GenerationConfig = GenerationConfig()) -> Column:
    """As chat_messages, over a curriculum in JSON, with the prompt and two examples of its own."""
    config.validate()
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    few = [say(role, F.lit(x)) for pair in CURRICULUM_EXAMPLES for role, x in zip(("user", "assistant"), pair)] if config.mode == "few_shot" else []
    return F.array(say("system", F.lit(SYSTEM)), *few, say("user", F.concat(F.lit(CURRICULUM_TASK.format(n=config.n_tags) + "\n\nCurriculum:\n"), curriculum)))


def chat_prompt(messages: Column) -> Column:
    """One string, for generators that take no message list."""
    return F.concat(F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n"), F.lit("\n<|assistant|>\n"))


def echo_generator(prompts: list[str], config: GenerationConfig, seed: int) -> list[str]:
    """The offline default: the first words of the prompt's last block, as tags."""
    return [json.dumps({"tags": list(dict.fromkeys(p.replace("<|assistant|>", "").split()[-config.n_tags :]))}, ensure_ascii=False) for p in prompts]


Generator = Callable[[list[str], GenerationConfig, int], list[str]]


def batch_seed(seed: int, authors: list[str]) -> int:
    """31 bits of the seed and the authors of a batch."""
    return int.from_bytes(hashlib.sha256("\x1f".join([str(seed), *map(str, authors)]).encode()).digest()[:4], "big") >> 1


def finetuned(results: DataFrame, config: GenerationConfig = GenerationConfig()) -> DataFrame:
    """results with the tags of a fine-tuned model: thinking removed, normalised, every reading cut to n_tags."""
    return results.withColumn("tags", F.when(F.col("error").isNull(), finetuned_tags(F.col("response"), config.n_tags)).otherwise(F.array().cast("array<string>")))


def generate(prompts: DataFrame, config: GenerationConfig = GenerationConfig(), generator: Generator = echo_generator) -> DataFrame:
    """prompts(author, prompt) -> author, response, tags, error, config.

    A failing batch gives its authors no tags and the error; others go on. A batch of config.batch_size prompts
    is seeded by the configured seed and its authors, so no two batches of a run share a seed by their place, and
    a batch of the same authors has the same seed wherever it runs."""
    config.validate()
    name = config.identity()

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            answers, errors = [], []
            for at in range(0, len(ids), config.batch_size):
                part = texts[at : at + config.batch_size]
                try:
                    got = generator(part, config, batch_seed(config.seed, ids[at : at + config.batch_size]))
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} answers to {len(part)} prompts")
                    answers += got
                    errors += [None] * len(part)
                except Exception as e:  # noqa: BLE001
                    answers += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"] * len(part)
            tags = [parse_response(a, config.n_tags) for a in answers]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), pa.array(tags, pa.list_(pa.string())), pa.array(errors, pa.string()), pa.array([name] * len(ids))], names=["author", "response", "tags", "error", "config"])

    return prompts.select("author", "prompt").mapInArrow(run, "author string, response string, tags array<string>, error string, config string")


def pending(prompts: DataFrame, done: DataFrame | None, config: GenerationConfig, retry_errors: bool = False) -> DataFrame:
    """Prompts without a result of this configuration. A checkpoint of another configuration, or with authors that
    have no prompt, is refused: it belongs to another run."""
    if done is None:
        return prompts
    require_within(done, prompts, "the results kept there", "the prompts")
    other = done.where(F.col("config") != config.identity()).limit(1)
    if not other.isEmpty():
        raise ValueError("the results kept there belong to another configuration")
    kept = done.where("error is null") if retry_errors else done
    return prompts.join(kept.select("author"), "author", "left_anti")


def resume(prompts: DataFrame, path: str, config: GenerationConfig = GenerationConfig(), generator: Generator = echo_generator, retry_errors: bool = False, fresh: bool = False, partial: bool = False) -> DataFrame:
    """Appends what is missing to the Parquet table at path and returns the table: last result of each author.

    partial: prompts are some of a run's, as of a stream, so results of other authors are no error."""
    spark = prompts.sparkSession
    done = None
    if not fresh:
        try:
            done = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if partial and done is not None:
        done = done.join(prompts.select("author"), "author", "left_semi")
    out = generate(pending(prompts, done, config, retry_errors), config, generator).withColumn("made_at", F.current_timestamp())
    out.write.mode("overwrite" if fresh else "append").parquet(path)
    kept = spark.read.parquet(path)
    cols = [c for c in kept.columns if c not in ("author", "made_at")]
    return kept.groupBy("author").agg(F.max_by(F.struct(*cols), "made_at").alias("x")).select("author", *[f"x.{c}" for c in cols])
