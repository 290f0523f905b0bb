"""Files that arrive page by page: completeness, cache state, progress, and a stream that refreshes a result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(events: DataFrame) -> DataFrame:
    """Each user's step opens with its first event and closes with its last."""
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("opened"), F.max("event_id").alias("closed"), F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))


def complete(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Which files have all their pages; a page that came twice counts once."""
    arrived = pages.groupBy("file").agg(F.count_distinct("page").alias("arrived"))
    return expected.join(arrived, "file", "left").select("file", "expected", F.coalesce("arrived", F.lit(0)).alias("arrived"), (F.coalesce("arrived", F.lit(0)) >= F.col("expected")).alias("complete"))


def cache_state(files: DataFrame, cache: DataFrame) -> DataFrame:
    """new, cached (same content, read by the same version) or changed."""
    old = cache.select("path", F.col("digest").alias("_d"), F.col("version").alias("_v"))
    same = (F.col("_d") == F.col("digest")) & (F.col("_v") == F.col("version"))
    return files.join(old, "path", "left").select("path", F.when(F.col("_d").isNull(), "new").when(same, "cached").otherwise("changed").alias("state"))


def refresh(stream: DataFrame, store: str, compute: Callable[[DataFrame], DataFrame], result: str, checkpoint: str):
    """Appends each batch of records to `store` and writes compute(all records so far) over `result`.

    A partial result is a full recompute; the last batch leaves the result of all. Runs until the source is read."""

    def batch(rows: DataFrame, number: int) -> None:
        # overwriting the batch's own folder makes a repeated batch harmless
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        everything = rows.sparkSession.read.parquet(store).drop("batch")
        compute(everything).write.mode("overwrite").parquet(result)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
