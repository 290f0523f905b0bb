"""A project's files as they arrive page by page: which are complete, and results that are refreshed meanwhile."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COMPLETE, STATE = "file string, source string, pages int", "pages array<int>, done boolean"


def completed(pages: DataFrame) -> DataFrame:
    """A stream of pages (file, source, page, expected: how many its file has) to one of files that have all their pages, each
    given once. A page that comes again counts once. The state is a file's page numbers until it is complete, then
    nothing but that it is; files are dealt over tasks, and a restart goes on from the checkpoint."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done = state.get if state.exists else ([], False)
        if done:
            for _ in frames:
                pass
            return
        seen, source, expected = set(seen or []), None, None
        for frame in frames:
            seen.update(int(p) for p in frame["page"])
            source, expected = frame["source"].iloc[0], int(frame["expected"].max())
        done = expected is not None and len(seen) >= expected
        state.update(([] if done else sorted(seen), done))
        if done:
            yield pd.DataFrame({"file": [key[0]], "source": [source], "pages": [expected]})

    return pages.groupBy("file").applyInPandasWithState(run, COMPLETE, STATE, "append", GroupStateTimeout.NoTimeout)


class Refresh:
    """What a micro-batch of complete files does: they are recorded, and the result of all files so far is written when it is due.

    A partial result is due if there is something new, all plan files are in and one shop file is, not all files are, and
    `every` seconds have passed since the last. The result of all files replaces it, once. compute(files) is a full
    recompute over the files that are in; its result is written under `root`/partial or `root`/final with the number of
    files that it covers. What is known is in the folder, so a batch that is repeated, or a new process, goes on from it."""

    def __init__(self, expected: DataFrame, compute: Callable[[DataFrame], DataFrame], root: str, every: float, clock: Callable[[], float] = time.time):
        """expected: file, source of all files of the project."""
        self.expected, self.compute, self.root, self.every, self.clock = expected, compute, root.rstrip("/"), every, clock

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return spark.read.parquet(f"{self.root}/{name}") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None

    def last(self, spark: SparkSession) -> dict:
        """kind, files, at, rows (the folder of the result) of what was written last."""
        log = self._read(spark, "log")
        row = log.orderBy(F.col("at").desc(), F.col("files").desc()).first() if log is not None else None
        return row.asDict() if row else {"kind": None, "files": 0, "at": None, "rows": None}

    def __call__(self, files: DataFrame, number: int) -> None:
        spark = files.sparkSession
        files.write.mode("overwrite").parquet(f"{self.root}/files/batch={number}")  # a repeated batch writes the same again
        known = self._read(spark, "files").drop("batch").dropDuplicates(["file"])
        state = self.expected.join(known.select("file").withColumn("in", F.lit(True)), "file", "left")
        plan, shop = F.col("source") == "plan", F.col("source") == "shop"
        n = state.agg(F.count(F.lit(1)).alias("all"), F.count("in").alias("got"), F.count(F.when(plan & F.col("in").isNull(), 1)).alias("plans_out"), F.count(F.when(shop & F.col("in"), 1)).alias("shops_in")).first()
        last, now = self.last(spark), self.clock()
        whole = n["got"] == n["all"]
        partly = not n["plans_out"] and n["shops_in"] > 0 and (last["at"] is None or now - last["at"] >= self.every)
        if n["got"] > last["files"] and (whole or partly):
            kind = "final" if whole else "partial"
            rows = f"{self.root}/{kind}/{uuid.uuid4().hex}"
            self.compute(known).write.parquet(rows)
            entry = spark.createDataFrame([(kind, n["got"], float(now), rows)], "kind string, files long, at double, rows string")
            entry.coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def start(self, pages: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Starts the stream; `trigger` as DataStreamWriter.trigger() takes it, all that is there by default."""
        return completed(pages).writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

