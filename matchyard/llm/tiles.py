"""Near-duplicate vectors: int8 tile products with error bounds, full precision where these leave it open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, small, stash, trimmed
from matchyard.llm.components import components
from matchyard.llm.vectors import block, matrix, valid

THRESHOLD = 0.98
#: Vectors of a tile; two tiles are multiplied in one task.
TILE = 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, each vector's step, and the Euclidean norm of what its code misses (rounded up)."""
    step = np.abs(unit).max(axis=1, initial=0) / 127
    step[step == 0] = 1
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * step[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-15
    return codes, step, error


def linked(x: np.ndarray, y: np.ndarray, threshold: float, codes_x, codes_y) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows with cosine >= threshold in double precision.

    With u = c + e for code and error, |uv - cd| <= |c||f| + |d||e| + |e||f|, and |c| <= 1 + |e|. Codes are multiplied
    as float32, which is exact for these integers up to 1040 dimensions, as float64 beyond. Only products that the
    bound leaves at or above the threshold are computed from the vectors themselves."""
    (cx, sx, ex), (cy, sy, ey) = codes_x, codes_y
    kind = np.float32 if cx.shape[1] <= 1040 else np.float64
    rough = cx.astype(kind) @ cy.astype(kind).T
    bound = (1 + ex)[:, None] * ey + (1 + ey) * ex[:, None] + ex[:, None] * ey
    i, j = np.nonzero(rough * (sx[:, None] * sy) + bound + 1e-12 >= threshold)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        a, b = x[i[k : k + (1 << 16)]], y[j[k : k + (1 << 16)]]
        keep[k : k + (1 << 16)] = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)) >= threshold
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Edges (smaller, larger) that keep what is connected: at most one for each of n nodes."""
    parent = np.arange(n)
    while True:
        a, b = parent[i], parent[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _multiply(threshold: float):
    """One pair of tiles: links of each vector, and a spanning forest of the links as (vector, root)."""

    def run(key, table):
        side = table.column("side").to_numpy()
        ids = table.column("row").to_numpy()
        v = matrix(table.column("unit").combine_chunks())
        codes = quantise(v)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = not len(right)
        right = left if own else right
        n_links = np.zeros(len(ids), np.int64)
        one, two = [], []
        for s in range(0, len(left), 512):
            a = left[s : s + 512]
            i, j = linked(v[a], v[right], threshold, tuple(c[a] for c in codes), tuple(c[right] for c in codes))
            i, j = a[i], right[j]
            if own:
                i, j = i[i != j], j[i != j]
            n_links += np.bincount(i, minlength=len(ids))
            if not own:
                n_links += np.bincount(j, minlength=len(ids))
            up = _forest(i, j, len(ids))
            at = np.flatnonzero(up != np.arange(len(ids)))
            one.append(at)
            two.append(up[at])
        i, j = np.concatenate(one), np.concatenate(two)
        root = _forest(i, j, len(ids))
        some = np.flatnonzero(n_links)
        return pa.Table.from_arrays([pa.array(ids[some]), pa.array(n_links[some]), pa.array(ids[root[some]])], names=["row", "n_links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vectors: vec_id (integer), embedding, label. One row per row: vec_id, n_links, component_id, kept.

    Rows of a label are dealt evenly into tiles by a hash; every pair of tiles of a label is a task of its own, however
    large the label, and returns one row per linked vector (its links there and a root), never the pairs. Comparing all
    pairs of a label is what the result asks for; it is the work, not the data, that grows with the label's square.

    A null label, and a vector that is null, zero or holds null or non-finite components, links with nothing: n_links
    0, its own component, kept. Shorter vectors count as filled up with zeros. Equal rows link like others, each row
    counting; a null vec_id links but can't name a component. An empty table gives none."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("row", F.monotonically_increasing_id())
    rows = stash(rows, "vectors")
    live = rows.where(F.col("label").isNotNull() & valid("embedding") & F.exists("embedding", lambda x: x != 0)).select("row", F.col("label").cast("string").alias("label"), "embedding")

    def units(batches):
        for batch in batches:
            v = matrix(batch.column(2))
            v = v / np.abs(v).max(axis=1, initial=0)[:, None]  # first by the largest, so squares don't overflow
            v = v / np.sqrt((v * v).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), block(v)], names=["row", "label", "unit"])

    sizes = stash(live.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "tiles")
    unit = arrow_stage(live, units, "row long, label string, unit array<double>").join(small(sizes), "label")
    mine = F.pmod(F.xxhash64("row", F.lit(6)), F.col("tiles")).cast("int")
    dealt = unit.withColumn("tile", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "row", "unit")
    found = stash(dealt.groupBy("label", "a", "b").applyInArrow(trimmed(_multiply(threshold)), "row long, n_links long, root long"), "links")
    parts = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")), what="parts")
    counts = found.groupBy("row").agg(F.sum("n_links").alias("n_links"))
    joined = stash(rows.select("row", "vec_id").join(counts, "row", "left").join(parts.withColumnRenamed("node", "row"), "row", "left"), "joined")
    names = joined.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = joined.join(small(stash(names, "names")), "component", "left")
    component = F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
