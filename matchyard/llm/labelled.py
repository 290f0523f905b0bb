"""Bounded samples of labelled documents, and the folds that may be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchyard.llm.base import crc_mod


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(crc_mod(doc_id, 3) == 1, F.lit(False))


def share(rows: DataFrame, most: int, column: str = "doc_id") -> DataFrame:
    """About `most` rows at most, chosen by a hash of `column`, so reruns and retries choose the same."""
    n = rows.count()
    if n <= most:
        return rows
    spread = F.xxhash64(F.col(column), F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1))
    return rows.where(spread < int((1 << 52) * most / n))


def labels_of(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(doc_id, y) of labelled documents that aren't held out. Of several labels of a document the highest counts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).cast("int").alias("y"))
    return labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(spark: SparkSession, docs: DataFrame, sf_dir: str, label: str, most: int, by_label: bool = False) -> DataFrame:
    """(text, y) of about `most` labelled documents that aren't held out; with `by_label` half of them of each label, as
    far as there are. The ids, at most about `most`, are broadcast, so the documents aren't shuffled."""
    labels = labels_of(spark, sf_dir, label)
    if by_label:
        rarer = min((labels.where(F.col("y") == y).count() for y in (0, 1)), default=0)
        each = max(most // 2, most - rarer)
        few = share(labels.where("y = 1"), each).unionByName(share(labels.where("y = 0"), each))
    else:
        few = share(labels, most)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "y")
