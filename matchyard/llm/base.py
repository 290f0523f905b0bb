"""What the operators share: written intermediate tables, size-checked broadcasts, document blocks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (id, hash) that a broadcast may hold: 16 bytes each, 16 MB. Above it the operators use a shuffle join.
BROADCAST_KEYS = 1_000_000

_written: list[tuple[SparkSession, str]] = []
_shared: list[tuple[SparkSession, Broadcast]] = []
_own_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir`, or a temporary one where master is local."""
    global _own_root
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if (at := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return at.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="matchyard-")
        atexit.register(shutil.rmtree, _own_root, True)
    return f"file://{_own_root}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/matchyard-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The intermediate tables of this session that still exist."""
    return [path for owner, path in _written if owner is spark]


def shared(spark: SparkSession) -> list[Broadcast]:
    """The values of this session that were broadcast and not released."""
    return [value for owner, value in _shared if owner is spark]


def put(spark: SparkSession, value) -> Broadcast:
    """Broadcasts a value; release() frees it on all executors."""
    _shared.append((spark, spark.sparkContext.broadcast(value)))
    return _shared[-1][1]


def release(spark: SparkSession, paths: list[str], values: list[Broadcast]) -> None:
    """Deletes intermediate tables and broadcast values, which written() and shared() name; call it once what was computed
    from them is written elsewhere. Others of the session stay."""
    gone = {id(v) for v in values}
    for value in values:
        value.destroy()
    _shared[:] = [e for e in _shared if id(e[1]) not in gone]
    conf = spark._jsc.hadoopConfiguration()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    _written[:] = [e for e in _written if e[0] is not spark or e[1] not in paths]


def collect_garbage(spark: SparkSession) -> None:
    """Collects garbage of both driver processes and gives the memory back. Spark frees shuffles, broadcasts and tables that
    nothing refers to any more only after its driver has done so."""
    gc.collect()
    spark._jvm.System.gc()
    _trim()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


_shipped: set[str] = set()
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _gives_back(function):
    """The same function, after which a worker returns the memory that it has freed: workers outlive tasks, and the
    allocators would keep the largest task's pages for as long."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _trim()

    return run


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def maps_large() -> None:
    """From now on arrays of a megabyte and more are mapped by themselves in this process, so their memory is given back when they
    are freed and not at the task's end."""
    if sys.platform == "linux":
        ctypes.CDLL(None).mallopt(-3, 1 << 20)


def trimmed(function):
    """The same function for applyInArrow on a group or two, after which memory is returned if the groups were large."""

    def run(*args):
        out = function(*args)
        if sum(t.nbytes for t in args[1:] if isinstance(t, pa.Table)) > 4 << 20:
            _trim()
        return out

    if function.__code__.co_argcount == 3:
        return lambda key, left, right: run(key, left, right)
    return lambda key, table: run(key, table)


def arrow_stage(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow whose workers can import this package, however the driver found it."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).parents[1]
        archive = Path(tempfile.mkdtemp(prefix="matchyard-")) / f"{top.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:  # rows vary from a word to megabytes: bytes bound a batch, not rows
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(_gives_back(function), schema)


def pull(df: DataFrame):
    """A result of bounded size as a pandas frame, by Arrow."""
    frame = df.toArrow().to_pandas()
    _trim()
    return frame


def ints(values) -> np.ndarray:
    """uint64 hashes as the signed longs that Spark stores."""
    return np.asarray(values, np.uint64).view(np.int64)


def text_blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a string column with about `limit` bytes: (first row, row after, bytes, offsets). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        after = min(after, n)
        yield first, after, data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        first = after


def small(df: DataFrame, rows: int = BROADCAST_KEYS) -> DataFrame:
    """Marks a written table for broadcast if a count shows that it has few rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_before(df: DataFrame, keys: list[str], at: str, order: list[str], value: str) -> DataFrame:
    """Adds `before`: the sum of `value` over the rows of the same keys that come earlier by (at, order).

    keys: columns without nulls; at: a double in [0, 1), spread evenly. Each key is dealt into ranges of `at`, about the
    square root of its rows each; the ranges' sums are added up first, so no task ever holds all rows of a key. Give a
    written table: it is read three times."""
    from pyspark.sql import Window

    stats = stash(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.ceil(F.col("_n") / F.greatest(F.lit(256.0), F.sqrt("_n"))).alias("_ranges")), "ranges")
    rows = df.join(small(stats), keys).withColumn("_range", F.floor(F.col(at) * F.col("_ranges"))).drop("_ranges")
    sums = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stash(sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")), "offsets")
    within = Window.partitionBy(*keys, "_range").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(small(offsets), [*keys, "_range"])
        .withColumn("before", F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_range", "_offset")
    )
