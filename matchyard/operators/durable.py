"""Results that must not be computed anew with another outcome."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where master is local."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if (set_at := context._jsc.sc().getCheckpointDir()).isDefined():
        return set_at.get().rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="matchyard-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: a lost executor can't deal them otherwise, and
    what is computed from them twice is read twice."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
