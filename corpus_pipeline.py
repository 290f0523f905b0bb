"""A corpus pipeline out of the operators of matchyard.llm: classify, join near duplicates, remove repeats, mix, pack.

Each stage works on all rows that its predecessor kept and returns the columns of documents; the last returns pieces."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchyard.llm import jaccard, mixing, packing, quality, suffixes
from matchyard.llm.base import collect_garbage, documents, release, scratch_root, shared, small, stash, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL states a trained classifier's decisions, so none states the rows of run().
ORACLE_SQL = None

#: Tables and broadcast values that the stage before made, by session.
_finished: dict[str, tuple[list[str], list]] = {}


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """Deletes the intermediate tables and broadcasts that the stage before made, whose result must have been written when
    the next stage is called, and gives memory back. What others made in the session stays, and so does what packing, the
    last stage, made: nothing tells when its result has been read."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session = spark.sparkContext.applicationId
        release(spark, *_finished.pop(session, ([], [])))
        collect_garbage(spark)
        tables, values = set(written(spark)), {id(v) for v in shared(spark)}
        out = function(spark, docs, sf_dir)
        if function.__name__ != "packing_stage":
            _finished[session] = [p for p in written(spark) if p not in tables], [v for v in shared(spark) if id(v) not in values]
        return out

    return run_stage


def _aliased(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """doc_id and text, and all columns under names that an operator's own can't clash with; these names and the columns'."""
    names = {f"_column_{i}": c for i, c in enumerate(docs.columns)}
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(k) for k, c in names.items())), names


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored as empty ones, long texts whole,
    rows that repeat each; other columns pass through; an empty table gives none."""
    rows, names = _aliased(docs)
    kept = quality.classify(spark, rows, sf_dir, keep=tuple(names)).where("predicted = 1")
    return kept.select(*(F.col(k).alias(c) for k, c in names.items()))


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id.

    Rows are told apart by id and text: of rows that repeat with both one stays, and an id's other texts stay when one of
    its texts goes. Rows without an id stay, and so do null and empty texts, which are no one's copies. Other columns pass
    through; an empty table gives none."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = stash(jaccard.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct(), "found")
    groups = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("component_id")
    members = stash(found.join(groups, "component_id", "left_semi"), "members")
    named = stash(keyed.where("doc_id is not null").select("doc_id", "_key").join(small(members), "_key"), "named")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("_first"))
    gone = stash(named.join(first, "component_id").where("_key <> _first._key").select("_key").distinct(), "gone")
    left = keyed.join(small(gone), "_key", "left_anti")
    twice = keyed.where("doc_id is not null").groupBy("_key").count().where("count > 1").limit(1).count()
    return (left.dropDuplicates(["doc_id", "text"]) if twice else left).select(*docs.columns)


@_stage
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text loses the bytes that stand elsewhere too; n_chars follows. A text that loses all stays,
    empty; null stays null. Other columns pass through; an empty table gives none."""
    rows, names = _aliased(docs)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept")}
    out = suffixes.remove_repeats(rows, keep=tuple(k for k, c in names.items() if c not in new))
    return out.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(k).alias(c) for k, c in names.items()))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, 0 to 3 times; the one that a source's target cuts comes whole if at
    least half of it is taken. Texts without words are never taken, a null source is a source, rows that repeat are taken
    together; other columns pass through; an empty table gives none."""
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    taken = mixing.mix(keyed, keep=("_text",)).where("size > 0").select("doc_id", "_text", F.round(F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    grouped = stash(taken.groupBy("doc_id", "_text").agg(F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"), "taken")
    if grouped.where("_rows > 1").limit(1).count():  # rows that repeat are taken together
        keyed = keyed.dropDuplicates(["doc_id", "_text"])
    b = small(grouped.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "_copies"))
    out = keyed.join(b, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, with their token ids, in as few sequences as can be found. Null and empty texts
    are the end id alone, long texts are cut into pieces, rows that repeat are packed each; an empty table gives none."""
    return packing.pack(docs, payload=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage returns is written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    root = f"{scratch_root(spark).rstrip('/')}/matchyard-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
