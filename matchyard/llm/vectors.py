"""What the vector operators share: valid vectors as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def valid(column: str) -> Column:
    """Whether a vector isn't null and holds finite numbers only."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrix(column: pa.Array, dtype=np.float64, width: int = 0) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    width = max(width, int(lengths.max(initial=0)))
    if n and (lengths == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def block(vectors: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, width = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(vectors).ravel()))
