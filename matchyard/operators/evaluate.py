"""How well a comparison finds what was planted, and what a known list expects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_ids(records: DataFrame) -> DataFrame:
    """Adds `unique_id`: an id that repeats gets its file in front, and what still repeats a counter, in order of page."""
    times = F.count(F.lit(1)).over(Window.partitionBy("id"))
    first = F.when(times > 1, F.concat_ws("__", F.regexp_replace(F.regexp_replace(F.col("file").cast("string"), r"\.[^./]*$", ""), "/", "_"), "id")).otherwise(F.col("id"))
    named = records.withColumn("_id", first)
    nth = F.row_number().over(Window.partitionBy("_id").orderBy("page", "source", "level", "overall"))
    return named.withColumn("unique_id", F.when(nth == 1, F.col("_id")).otherwise(F.concat_ws("_", "_id", nth.cast("string")))).drop("_id")


def plant(records: DataFrame, share: float, seed: int, column: str = "count") -> DataFrame:
    """Changes one number in a seeded share of the shop records: adds `planted` (the new value, else null)."""
    dice = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)) / 10_000.0
    hit = (F.col("source") == "shop") & F.col(column).isNotNull() & (dice < share)
    out = records.withColumn("planted", F.when(hit, F.col(column) + 1))
    return out.withColumn(column, F.coalesce("planted", column))


def judge(planted: DataFrame, findings: DataFrame, field: str = "count") -> DataFrame:
    """A verdict for every planted change: found, flagged something else, matched and not flagged, or never matched."""
    f = findings.where("shop_id is not null").select(F.col("shop_id").alias("id"), "kind", "status", F.coalesce("fields", F.lit("")).alias("fields"))
    verdict = F.when(F.col("kind").isNull() | (F.col("kind") != "field_diff"), "never matched").when(F.array_contains(F.split("fields", ","), field), "found").when(F.col("fields") != "", "flagged something else").otherwise("matched, not flagged")
    return planted.where("planted is not null").select("id").join(f, "id", "left").select("id", verdict.alias("verdict"))


def recall(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def known_items(known: DataFrame, findings: DataFrame) -> DataFrame:
    """Whether each listed place (level, grid) has a finding that says something is wrong."""
    wrong = findings.where(F.col("status").isin("non_compliant", "missing", "added")).select("level", "grid").distinct().withColumn("hit", F.lit(True))
    return known.join(wrong, ["level", "grid"], "left").withColumn("found", F.coalesce("hit", F.lit(False))).drop("hit")


def shares(records: DataFrame, keys: list[str], tests: dict[str, Column]) -> DataFrame:
    """Share of records of each key that pass each test."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), *(F.round(F.avg(F.when(t, 1.0).otherwise(0.0)), 4).alias(k) for k, t in tests.items()))


def asked_once(questions: DataFrame, cache: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers (key, option, certainty) of questions (key, prompt): each prompt once, known answers from the cache, the
    rest from `score`, which takes and returns a table. A question without an answer keeps nulls."""
    distinct = questions.select("prompt").distinct()
    known = distinct.join(cache.select("prompt", "option", "certainty"), "prompt")
    fresh = score(distinct.join(cache.select("prompt"), "prompt", "left_anti")).select("prompt", "option", "certainty")
    return questions.join(known.unionByName(fresh), "prompt", "left").select("key", "option", "certainty")


def no_answer(prompts: DataFrame) -> DataFrame:
    """The default scorer: it knows nothing and says so."""
    return prompts.select("prompt", F.lit(None).cast("string").alias("option"), F.lit(None).cast("double").alias("certainty"))
