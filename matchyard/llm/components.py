"""Connected components of a graph whose edges are a table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, stash

#: Edges up to which one task joins them all (16 bytes each): rounds of shuffles would take longer than the work.
AT_ONCE = 1_000_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of a graph in memory: labels sink along edges, pointers are halved."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            return nodes, nodes[parent]
        np.minimum.at(parent, high, low)
        while (up := parent[parent])[:].tobytes() != parent.tobytes():
            parent = up


def _join_all(batches):
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, component = roots(*(np.concatenate(x) for x in zip(*held)))
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(component[i : i + (1 << 16)])], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", what: str = "component") -> DataFrame:
    """edges: two long columns. Returns (node, component), component being the smallest node reachable; nodes with an edge only.

    A null end or a loop counts for nothing; repeated edges count once. Up to AT_ONCE edges, counted first, are joined in
    one task. Beyond that large-star and small-star steps alternate. Both steps are a grouped minimum, which is
    aggregated before the shuffle, and an equi-join that adaptive execution may split, so a node with very many
    neighbours doesn't land in one task. Every round is written to the shared folder."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = stash(now, what), None
    if now.limit(AT_ONCE + 1).count() <= AT_ONCE:
        return arrow_stage(now.coalesce(1), _join_all, "node long, component long")
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.withColumnRenamed("m", "v"))
        now = stash(small.distinct(), what)
    own = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
