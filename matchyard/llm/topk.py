"""Exact search for the largest integer inner products over a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, pull, put, stash, trimmed
from matchyard.llm.vectors import matrix, valid

#: Best scores of a query; a query's id is divisible by EVERY; a component x becomes floor(SCALE * x).
BEST, EVERY, SCALE = 5, 50, 256
#: Pivots, taken from a hash sample of the vectors; vectors of an annulus, the unit that is read or skipped whole.
PIVOTS, ANNULUS = 48, 1024
#: Annuli that a query reads in one round before its bound is taken anew.
FIRST = 2


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: in floating point while every sum fits, else in Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _integers(column) -> np.ndarray:
    return matrix(column, np.int64).astype(np.float64)


def _assign(shared):
    """Nearest pivot and distance of each vector, in the space where all vectors have the same norm (see `search`)."""

    def run(batches):
        pivots, top = shared.value
        for batch in batches:
            v = _integers(batch.column(1))
            v = np.pad(v, ((0, 0), (0, pivots.shape[1] - 1 - v.shape[1]))) if v.shape[1] < pivots.shape[1] - 1 else v
            squares = (v * v).sum(axis=1)
            lifted = np.column_stack([v, np.sqrt(np.maximum(top - squares, 0))])
            d = np.sqrt(np.maximum(squares[:, None] + np.maximum(top - squares, 0)[:, None] + (pivots * pivots).sum(axis=1) - 2 * lifted @ pivots.T, 0))
            near = d.argmin(axis=1) if len(pivots) else np.zeros(len(v), int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), pa.array(squares)], names=["vec_id", "v", "pivot", "distance", "squares"])

    return run


def _scan(k: int):
    """Rows of one cell (pivot, annulus): its vectors and the queries that read it. Best k of the cell per query."""

    def run(key, queries, vectors):
        names = ["query_id", "vec_id", "score"]
        types = [pa.int64(), pa.int64(), pa.int64()]
        if not len(queries) or not len(vectors):
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        v, ids = _integers(vectors.column("v")), vectors.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v, ids = v[order], ids[order]
        q, who, rows = _integers(queries.column("v")), queries.column("query_id").to_numpy(), queries.column("query_row").to_numpy()
        width = max(q.shape[1], v.shape[1])
        q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
        out: list[list] = [[], [], []]
        for i in range(0, len(q), 512):
            s = products(q[i : i + 512], v)
            for j in range(len(s)):
                row, m = s[j], len(ids)
                own = np.flatnonzero(ids == who[i + j])
                ok = np.ones(m, bool)
                ok[own] = False
                some = np.flatnonzero(ok)
                if len(some) > k:
                    bar = np.partition(row[some], len(some) - k)[len(some) - k]
                    some = some[row[some] >= bar]
                    some = some[np.lexsort((ids[some], -row[some]))[:k]]
                out[0].append(np.full(len(some), rows[i + j]))
                out[1].append(ids[some])
                out[2].append(row[some])
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, types)], names=names)

    return run


def search(vectors: DataFrame, best: int = BEST, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS, annulus: int = ANNULUS) -> DataFrame:
    """vectors: vec_id (integer), embedding. For each row whose id is divisible by `every`, the `best` other rows by
    inner product of floor(scale * x): query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    One more component, sqrt(M - |v|^2) with M the largest |v|^2, gives all vectors the same norm; then a larger
    product is a smaller distance: |q - v|^2 = |q|^2 + M - 2 qv, the query's own extra component being 0. Vectors are
    keyed by their nearest pivot and their distance from it, sorted, and cut into annuli of about `annulus` vectors.
    A query reads the annuli nearest its own distance first; its k-th best score gives a radius, and by the triangle
    inequality an annulus [lo, hi] of pivot p with d(q, p) - hi or lo - d(q, p) beyond it can't hold a better one. What
    is left is read, so the result is exact. Pivots only steer the search; every vector is indexed.

    Null vectors and vectors with null or non-finite components take no part; a shorter vector counts as filled up with
    zeros; rows with a null id take no part; a row that repeats is a candidate each time, but never for its own id; two
    query rows of one id are answered once, by the larger vector; an empty table gives none."""
    spark = vectors.sparkSession
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & valid("embedding")).select("vec_id", ints.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = stash(rows.withColumn("squares", square), "integers")
    top, width, n = rows.agg(F.max("squares"), F.max(F.size("v")), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(min(pivots, max(1, int(n**0.5)))).collect()
    centre = np.zeros((len(chosen), width + 1))
    for i, r in enumerate(chosen):
        centre[i, : len(r["v"])] = r["v"]
        centre[i, width] = np.sqrt(max(0.0, top - r["squares"]))
    shared = put(spark, (centre, top))
    keyed = stash(arrow_stage(rows.select("vec_id", "v"), _assign(shared), "vec_id long, v array<bigint>, pivot int, distance double, squares double"), "keyed")

    # Annuli of equal counts: distances at every `annulus`-th rank, by approximate quantiles; copies may share a bound,
    # so each annulus is also cut by a hash of the id where it holds too many.
    sizes = keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("distance", F.array(*[F.lit((i + 1) / 64) for i in range(63)]), 10_000).alias("cuts"))
    cuts = {r["pivot"]: (r["n"], r["cuts"]) for r in sizes.collect()}
    bounds = {p: np.unique(np.array(c)[:: max(1, 64 // max(1, -(-m // annulus)))]) if m > annulus else np.zeros(0) for p, (m, c) in cuts.items()}
    table = F.create_map(*[x for p, b in bounds.items() for x in (F.lit(p), F.array(*map(F.lit, b.tolist())).cast("array<double>"))])
    ring = F.size(F.filter(table[F.col("pivot")], lambda c: c < F.col("distance")))
    keyed = keyed.withColumn("ring", ring)
    counts = {(r["pivot"], r["ring"]): r["n"] for r in keyed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.create_map(*[x for (p, r), m in counts.items() for x in (F.lit(p * 100 + r), F.lit(-(-m // (2 * annulus))))])
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(9)), parts[F.col("pivot") * 100 + F.col("ring")]).cast("int"))
    keyed = stash(keyed, "rings")
    cells = pull(keyed.groupBy("pivot", "ring", "part").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count(F.lit(1)).alias("n"))).sort_values(["pivot", "ring", "part"], ignore_index=True)
    # The directory of cells is n / annulus rows of bounds; it is broadcast to the queries' tasks.
    directory = put(spark, (centre, top, cells[["pivot", "ring", "part"]].to_numpy(np.int64), cells.lo.to_numpy(), cells.hi.to_numpy(), cells.n.to_numpy()))
    queries = keyed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v")).withColumnRenamed("vec_id", "query_id")
    queries = stash(queries.withColumn("query_row", F.col("query_id")), "queries")

    def gaps(q: np.ndarray) -> np.ndarray:
        """Least possible distance between each query and each cell."""
        centre, top, keys, lo, hi, _ = directory.value
        q = np.pad(q, ((0, 0), (0, centre.shape[1] - 1 - q.shape[1])))
        norm = (q * q).sum(axis=1)
        d = np.sqrt(np.maximum(norm[:, None] + (centre * centre).sum(axis=1) - 2 * q @ centre[:, :-1].T, 0))[:, keys[:, 0]]
        return np.maximum(0, np.maximum(d - hi, lo - d))

    def route(first: bool):
        """(query, cell): the nearest cells that together hold enough; later those within the radius, without the first."""

        def run(batches):
            _, top, keys, _, _, n = directory.value
            for batch in batches:
                if not len(batch):
                    continue
                q = _integers(batch.column(2))
                for i in range(0, len(q), 256):
                    part = q[i : i + 256]
                    gap = gaps(part)
                    order = np.argsort(gap, axis=1, kind="stable")
                    held = np.cumsum(n[order], axis=1)
                    early = np.zeros(gap.shape, bool)
                    want = (held - n[order] < best + 1) | (np.arange(gap.shape[1]) < FIRST)
                    np.put_along_axis(early, order, want, axis=1)
                    if first:
                        take = early
                    else:
                        bar = batch.column(3).slice(i, 256).to_numpy(zero_copy_only=False).astype(float)
                        norm = (part * part).sum(axis=1)
                        radius = np.sqrt(np.maximum(norm + top - 2 * bar, 0))
                        radius = np.where(np.isnan(radius), np.inf, radius) * (1 + 1e-9) + 1e-6
                        take = (gap <= radius[:, None]) & ~early
                    a, c = np.nonzero(take)
                    index = pa.array(a + i)
                    yield pa.RecordBatch.from_arrays([batch.column(k).take(index) for k in range(3)] + [pa.array(keys[c, j].astype(np.int32)) for j in range(3)], names=["query_id", "query_row", "v", "pivot", "ring", "part"])

        return run

    cell = ["pivot", "ring", "part"]
    routed = "query_id long, query_row long, v array<bigint>, pivot int, ring int, part int"
    base = keyed.select("vec_id", "v", *cell)

    def read(asked: DataFrame) -> DataFrame:
        return asked.groupBy(*cell).cogroup(base.groupBy(*cell)).applyInArrow(trimmed(_scan(best)), "query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        lists = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, best).alias("best"))
        return lists

    plain = queries.select("query_id", "query_row", "v")
    near = stash(read(arrow_stage(plain, route(True), routed)), "near")
    bars = ranked(near).select("query_id", F.when(F.size("best") >= best, -F.element_at("best", best)["s"]).alias("bar"))
    again = plain.join(bars, "query_id", "left")
    more = read(arrow_stage(again, route(False), routed))
    final = ranked(near.unionByName(more))
    out = final.select("query_id", F.posexplode("best").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
