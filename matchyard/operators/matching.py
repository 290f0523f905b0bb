"""Pairing of plan and shop records: by exact key, by the nearest column, and by a cost model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchyard import schema as S
from matchyard.operators.assignment import on_a_line, sparse_with_opting_out, with_opting_out
from matchyard.operators.checks import key_of
from matchyard.operators.durable import settled

KEY = ("type", "level", "row", "col")


def bound() -> Column:
    return F.col("row").isNotNull() & F.col("col").isNotNull()


def primaries(records: DataFrame) -> DataFrame:
    """One record per source and key, the best by quality, file, page and id, with the number of others.

    A grouped minimum over the ranking, so it is aggregated before the shuffle and no key is sorted whole."""
    rank = F.struct((-F.col("overall")).alias("q"), "file", "page", "id")
    rest = [c for c in records.columns if c not in ("source",)]
    keyed = records.where(bound()).withColumn("key", key_of(*KEY))
    best = keyed.groupBy("source", "key").agg(F.min_by(F.struct(*rest), rank).alias("best"), (F.count(F.lit(1)) - 1).alias("extras"))
    return best.select("source", "key", "best.*", "extras")


def sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = primaries(records)
    named = lambda side, p: first.where(F.col("source") == side).drop("source").withColumnsRenamed({c: f"{p}_{c}" for c in first.columns if c not in ("source", "key")})
    return named("plan", "plan"), named("shop", "shop")


def paired(records: DataFrame, *columns: str) -> DataFrame:
    """One row for each key: the best record of either side (of its columns, or all), null where it has none.

    Both sides come from one grouping, so the records are shuffled once and no join follows."""
    ranked = ("file", "page", "id")
    rest = columns or [c for c in records.columns if c != "source"]
    # the ranking comes first and is sent once; what follows it is the same wherever it is equal
    first = F.struct((-F.col("overall")).alias("_q"), *ranked, *(c for c in rest if c not in (*ranked, "overall")))
    keyed = records.where(bound()).withColumn("key", key_of(*KEY))
    on = lambda side, x: F.when(F.col("source") == side, x)
    both = keyed.groupBy("key").agg(*(x for side in ("plan", "shop") for x in (F.min(on(side, first)).alias(side), F.count(on(side, F.lit(1))).alias(f"_{side}"))))
    both = both.where("plan is not null or shop is not null")
    of = lambda side: [*((-F.col(f"{side}._q") if c == "overall" else F.col(f"{side}.{c}")).alias(f"{side}_{c}") for c in rest), F.when(F.col(f"_{side}") > 0, F.col(f"_{side}") - 1).alias(f"{side}_extras")]
    return both.select("key", *of("plan"), *of("shop"))


def lone(records: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Best records (plan_*, shop_*) of the keys that one side has alone."""
    p = settled(paired(records, "id", *columns).where("plan_id is null or shop_id is null"))
    one = lambda side, other: p.where(F.col(f"{other}_id").isNull()).select("key", *(c for c in p.columns if c.startswith(f"{side}_")))
    return one("plan", "shop"), one("shop", "plan")


def key_match(records: DataFrame) -> DataFrame:
    """Keys with a record on both sides."""
    return paired(records).where("plan_id is not null and shop_id is not null")


def near_columns(records: DataFrame) -> DataFrame:
    """Keys without an equal on the other side, paired within type, level and row by least total column distance.

    The assignment comes before the limit, so a pair beyond it takes its partner from nobody else and is then dropped.
    Returns plan_id, shop_id, cost and margin (how far the runner-up of the plan record is)."""
    free_plan, free_shop = lone(records, *KEY)
    group = ["type", "level", "row"]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        in_order = lambda t, side: t.take(pc.sort_indices(t, [(f"{side}_col", "ascending"), (f"{side}_id", "ascending")]))
        left, right = in_order(left, "plan"), in_order(right, "shop")
        a, b = left["plan_col"].to_numpy(), right["shop_col"].to_numpy()
        i, j = np.array(on_a_line(a, b), np.int64).reshape(-1, 2).T
        near = np.abs(a[i] - b[j]) <= S.NEAR_COLUMN_LIMIT
        i, j = i[near], j[near]
        cost, at, runner = np.abs(a[i] - b[j]), np.searchsorted(b, a[i]), np.full(len(i), np.inf)
        for k in (at + by for by in range(-2, 3)):
            other = (k >= 0) & (k < len(b)) & (k != j)
            runner[other] = np.minimum(runner[other], np.abs(a[i[other]] - b[k[other]]))
        margin = [1.0 if r == np.inf else max(0.0, (r - c) / r if r else 0.0) for r, c in zip(runner.tolist(), cost.tolist())]
        pick = lambda t, name, rows: t[name].take(pa.array(rows)).cast(pa.string())
        return pa.table({"plan_id": pick(left, "plan_id", i), "shop_id": pick(right, "shop_id", j), "cost": pa.array([round(c, 3) for c in cost.tolist()], pa.float64()), "margin": pa.array([round(m, 3) for m in margin], pa.float64())})

    left = free_plan.select(*(F.col(f"plan_{g}").alias(g) for g in group), "plan_id", "plan_col")
    right = free_shop.select(*(F.col(f"shop_{g}").alias(g) for g in group), "shop_id", "shop_col")
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(solve, "plan_id string, shop_id string, cost double, margin double")


def full_outer(records: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Every primary of either side once: pairs by key, pairs by near column, what is left alone, and unbound records.

    Columns: method (key, near_col, none, unbound), plan_*, shop_*, cost, margin."""
    cost, margin = F.lit(None).cast("double").alias("cost"), F.lit(None).cast("double").alias("margin")
    whole = paired(records)
    if near is not None:
        whole = settled(whole)
    out = whole.withColumn("method", F.when(F.col("plan_id").isNotNull() & F.col("shop_id").isNotNull(), "key").otherwise("none")).select("*", cost, margin)
    if near is not None:
        made = settled(near.withColumnsRenamed({"plan_id": "_plan", "shop_id": "_shop", "cost": "_cost", "margin": "_margin"}))
        of = lambda side: [c for c in whole.columns if c.startswith(f"{side}_")]
        plan, shop = whole.where("shop_id is null").select(*of("plan")), whole.where("plan_id is null").select("key", *of("shop"))
        pairs = plan.join(made, F.col("plan_id") == F.col("_plan")).join(shop, F.col("shop_id") == F.col("_shop"))
        pairs = pairs.select(*plan.columns, *shop.columns, F.lit("near_col").alias("method"), F.col("_cost").alias("cost"), F.col("_margin").alias("margin"))
        out = out.join(made.select(F.col("_plan").alias("plan_id")), "plan_id", "left_anti").join(made.select(F.col("_shop").alias("shop_id")), "shop_id", "left_anti").unionByName(pairs)
    loose = records.where(~bound())
    for side, other in (("plan", "shop"), ("shop", "plan")):
        one = loose.where(F.col("source") == side).drop("source")
        one = one.withColumnsRenamed({c: f"{side}_{c}" for c in one.columns}).withColumns({"method": F.lit("unbound"), f"{side}_extras": F.lit(0)})
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def letter_rank(letters: Column) -> Column:
    """A=1 to Z=26, then AA=27, BB=28 and so on; a decimal adds tenths, a prime 0.05."""
    base = F.regexp_extract(letters, r"^([A-Z]+)", 1)
    high = 26 * (F.length(base) - 1)
    tenth = F.coalesce(F.nullif(F.regexp_extract(letters, r"\.(\d)", 1), F.lit("")).cast("double") / 10, F.lit(0.0))
    return high + F.ascii(F.substring(base, -1, 1)) - 64 + tenth + F.when(letters.contains("'"), 0.05).otherwise(0.0)


# The prices of the cost model, and kinds that may name the same thing.
NOT_A_CANDIDATE, MOST_COST, ALONE, NOTHING_SHARED = 1000.0, 1.8, 0.8, 1.7
SYNONYMS = (("column", "pier"), ("wall", "shear_wall"), ("footing", "raft", "pier"))
FOUNDATIONS = ("footing", "raft", "pile", "pile_cap")
CANDIDATES = 3
SAME_ROW, OTHER_CELL, CONTENT_NONE, CONTENT_SHARE, DISTANCE, COLUMN_STEP, FARTHEST = 1.2, 2.0, 0.15, 0.5, 0.15, 0.5, 2.0
LENGTH_SHARE = 0.04
# Columns of a row that components are looked for in at once.
STRETCH = 256
# Cells of a table of all pairs; a component with more is solved over its edges.
TABLE = 4096


def same_length(a: Column, b: Column, floor: float = 5.0) -> Column:
    """One length written in two unit systems or rounded."""
    return F.abs(a - b) <= F.greatest(F.lit(floor), LENGTH_SHARE * F.greatest(F.abs(a), F.abs(b)))


def cell_cost(a: Column, b: Column) -> Column:
    """Cells (row, col) as structs: 0 the same, 1.2 neighbours in a row, else 2."""
    same = (a["row"] == b["row"]) & (a["col"] == b["col"])
    near = (a["row"] == b["row"]) & (F.abs(a["col"] - b["col"]) <= 1.0)
    return F.when(same, 0.0).when(near, SAME_ROW).otherwise(OTHER_CELL)


def reach() -> float:
    """Columns between two cells of a row beyond which no pair costs less than MOST_COST, whatever else agrees."""
    left = MOST_COST - OTHER_CELL - (CONTENT_NONE - CONTENT_SHARE)
    if left > DISTANCE * FARTHEST:
        return float("inf")
    return max(1.0, round(left / (DISTANCE * COLUMN_STEP), 9))


def level_cost(a: Column, b: Column, b_to: Column, kind_a: Column, kind_b: Column) -> Column:
    foundation = F.coalesce(kind_a.isin(*FOUNDATIONS), F.lit(False)) | F.coalesce(kind_b.isin(*FOUNDATIONS), F.lit(False))
    return F.when(a.isNull() | b.isNull(), 0.3).when(a == b, 0.0).when(a == b_to, 0.4).when(foundation, 0.3).otherwise(NOT_A_CANDIDATE)


def kind_cost(a: Column, b: Column) -> Column:
    alike = F.lit(False)
    for group in SYNONYMS:
        alike = alike | (a.isin(*group) & b.isin(*group))
    return F.when(a.isNull() | b.isNull(), 0.2).when(a == b, 0.0).when(alike, 0.3).otherwise(2.0)


def content_cost(a: Column, b: Column) -> Column:
    """Bars of two notes (arrays of size, count, spacing_mm): how alike the most alike pair of them is."""

    def share(x: Column, y: Column) -> Column:
        tests = [(x["size"], y["size"], x["size"] == y["size"]), (x["count"], y["count"], x["count"] == y["count"]), (x["spacing_mm"], y["spacing_mm"], same_length(x["spacing_mm"], y["spacing_mm"]))]
        both = sum((F.when(p.isNotNull() & q.isNotNull(), 1).otherwise(0) for p, q, _ in tests), F.lit(0))
        equal = sum((F.when(t, 1).otherwise(0) for _, _, t in tests), F.lit(0))
        return F.when(both > 0, equal / both)

    best = F.array_max(F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: share(x, y)))))
    one_sided = (F.coalesce(F.size(a), F.lit(0)) > 0) != (F.coalesce(F.size(b), F.lit(0)) > 0)
    return F.when(one_sided, NOTHING_SHARED).when(best.isNull(), 0.0).when(best == 0, NOTHING_SHARED).otherwise(F.round(CONTENT_NONE - CONTENT_SHARE * best, 3))


def entities(notes: DataFrame) -> DataFrame:
    """Plan notes of one cell, level and kind are one entity: P00001 and so on in order of (cell, level, kind), its
    members and the least note id. notes: id, cell (text), level, kind, bars."""
    grouped = notes.groupBy("cell", "level", "kind").agg(F.count(F.lit(1)).alias("members"), F.min_by(F.struct("id", "bars"), "id").alias("p"))
    return grouped.select("cell", "level", "kind", "members", F.col("p.id").alias("note"), F.col("p.bars").alias("bars"))


def numbered(rows: DataFrame, name: str, pattern: str, *order: str, ranges: int = 64) -> DataFrame:
    """Consecutive ids by a total order, without one task that sorts all: rows are range-partitioned, sorted and numbered
    within as they are written, and counted by partition."""
    # kept, as sampling anew would deal rows otherwise than they were counted
    # a row's place is its range and the rows before it there, which its task counts as it writes them in order
    placed = settled(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    p, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(p.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return placed.withColumn("_p", p).join(F.broadcast(before), "_p").withColumn(name, F.format_string(pattern, F.col("_b") + within + 1)).drop("_p", "_b", "_at")


def cell(row: str, col: str) -> Column:
    return F.struct(F.col(row).alias("row"), F.col(col).alias("col"))


def candidates(left: DataFrame, right: DataFrame, best: int | None = CANDIDATES, more: bool = False) -> DataFrame:
    """Entities and slots of one cell (or, where a cell has none, of one row), priced; below the limit, the best three
    of each entity. left: note (of one cell), row, col, level, kind, bars; right: slot, row, col, level, level_to, kind, bars.

    With `more` also same_cell, next (what the entity's following candidate costs) and where the slot is: row, stretch (of
    columns). Candidates of one cell are ranked where they met, without a further shuffle. With best=None all candidates
    below the limit, which aren't ranked then: no place and no next."""
    priced_by = F.transform("bars", lambda x: F.struct(*(x[c].alias(c) for c in ("size", "count", "spacing_mm"))))  # nothing else of them is shuffled
    l, r = (d.withColumn("bars", priced_by).withColumnsRenamed({c: f"{p}_{c}" for c in d.columns}) for d, p in ((left, "l"), (right, "r")))
    same = l.join(r, (F.col("l_row") == F.col("r_row")) & (F.col("l_col") == F.col("r_col")))
    alone = l.join(r.select("r_row", "r_col").distinct(), (F.col("l_row") == F.col("r_row")) & (F.col("l_col") == F.col("r_col")), "left_anti")
    # a row may be long; the join is by row and a band of columns, four times as wide as a pair that is cheap enough can be, so
    # that half of the entities are in two bands and none in more
    on, far = F.col("l_row") == F.col("r_row"), reach()
    if far < float("inf"):
        band = lambda c: F.floor(c / (4 * far))
        alone = alone.withColumn("_band", F.explode(F.sequence(band(F.col("l_col") - far), band(F.col("l_col") + far))))
        near = alone.join(r, on & (F.col("_band") == band(F.col("r_col"))) & (F.abs(F.col("l_col") - F.col("r_col")) <= far)).drop("_band")
    else:
        near = alone.join(r, on)
    distance = F.abs(letter_rank(F.col("l_row")) - letter_rank(F.col("r_row"))) + COLUMN_STEP * F.abs(F.col("l_col") - F.col("r_col"))
    cost = cell_cost(cell("l_row", "l_col"), cell("r_row", "r_col")) + level_cost(F.col("l_level"), F.col("r_level"), F.col("r_level_to"), F.col("l_kind"), F.col("r_kind"))
    cost = cost + kind_cost(F.col("l_kind"), F.col("r_kind")) + content_cost(F.col("l_bars"), F.col("r_bars")) + DISTANCE * F.least(distance, F.lit(FARTHEST))
    extra = {"same_cell": F.col("same_cell"), "next": F.col("next"), "row": F.col("r_row"), "stretch": F.floor(F.col("r_col") / STRETCH)} if more else {}

    def ranked(pairs: DataFrame, same_cell: bool, *by: str) -> DataFrame:
        priced = pairs.withColumn("cost", F.round(cost, 3)).where(F.col("cost") < MOST_COST).select("l_note", "r_slot", "cost", "l_row", "l_col", "r_row", "r_col", F.lit(same_cell).alias("same_cell"))
        if best is None:
            return priced.select(F.col("l_note").alias("note"), F.col("r_slot").alias("slot"), "cost", *(c.alias(k) for k, c in extra.items() if k != "next"))
        top = Window.partitionBy(*by).orderBy("cost", "r_slot")
        placed = priced.withColumns({"place": F.row_number().over(top)} | ({"next": F.lead("cost").over(top)} if more else {})).where(F.col("place") <= best)
        return placed.select(F.col("l_note").alias("note"), F.col("r_slot").alias("slot"), "cost", "place", *(c.alias(k) for k, c in extra.items()))

    return ranked(same, True, "l_row", "l_col", "l_note").unionByName(ranked(near, False, "l_note"))


def assign(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Least-cost pairs in each component. edges: note, slot, cost; parts: note, component."""
    return solved(edges.join(parts, "note").select("component", "note", "slot", "cost")).select("note", "slot", "cost")


def solved(edges: DataFrame) -> DataFrame:
    """The edges that least-cost pairs in each component take, with all their columns: note, slot, cost, component and others.

    A task reads its components one after the other, so many small ones need few calls; equal costs are solved once."""
    ordered = edges.repartition("component").sortWithinPartitions("component", "note", "slot")
    return ordered.mapInArrow(_solver(*(edges.columns.index(c) for c in ("component", "note", "slot", "cost"))), edges.schema)


def _solver(component: int, note: int, slot: int, cost: int):
    known: dict[tuple, list[tuple[int, int]]] = {}

    def best(costs: np.ndarray) -> list[tuple[int, int]]:
        if costs.size > 64:
            return with_opting_out(costs, ALONE, NOT_A_CANDIDATE)
        key = (costs.shape, costs.tobytes())
        if key not in known:
            if len(known) > 100_000:
                known.clear()
            known[key] = with_opting_out(costs, ALONE, NOT_A_CANDIDATE)
        return known[key]

    def taken(rows: pa.Table, begins: np.ndarray) -> list[int]:
        price = rows.column(cost).to_numpy()
        lone = begins[:-1][np.diff(begins) == 1]
        values, at = np.unique(price[lone], return_inverse=True)
        good = np.array([c <= MOST_COST and bool(best(np.full((1, 1), c))) for c in values.tolist()], bool)
        out = lone[good[at]].tolist() if len(lone) else []
        some = np.flatnonzero(np.diff(begins) > 1)
        for i, j in zip(begins[some].tolist(), begins[some + 1].tolist()):
            part = rows.slice(i, j - i)
            notes, slots = part.column(note).to_pylist(), part.column(slot).to_pylist()
            left, right = ({x: k for k, x in enumerate(sorted(set(side)))} for side in (notes, slots))
            if len(left) * len(right) > TABLE:
                ends = (np.array([at[x] for x in side]) for at, side in ((left, notes), (right, slots)))
                out += [i + k for k in sparse_with_opting_out(*ends, price[i:j], ALONE)]
                continue
            costs, where = np.full((len(left), len(right)), NOT_A_CANDIDATE), {}
            for k, (n, s, c) in enumerate(zip(notes, slots, price[i:j].tolist())):
                costs[left[n], right[s]] = c
                where[left[n], right[s]] = i + k
            out += [where[p] for p in best(costs) if costs[p] <= MOST_COST]
        return out

    def run(batches):
        held = None  # edges of the component that the batch before ended with
        for batch in batches:
            if not len(batch):
                continue
            if held and batch.column(component)[-1] == held[0].column(component)[0]:  # rows are sorted: all of one component
                held.append(batch)
                continue
            rows = pa.Table.from_batches([*(held or []), batch]).combine_chunks()
            of = rows.column(component).combine_chunks()
            begins = np.append(0, np.flatnonzero(pc.not_equal(of[1:], of[:-1]).to_numpy(zero_copy_only=False)) + 1)
            yield from rows.take(pa.array(taken(rows, begins), pa.int64())).to_batches()
            held = rows.slice(int(begins[-1])).to_batches()
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from rows.take(pa.array(taken(rows, np.array([0, len(rows)])), pa.int64())).to_batches()

    return run
