"""Findings of the cost model's path: matched pairs compared, what is left on either side, differences that repeat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchyard.operators import bars as B
from matchyard.operators.durable import settled
from matchyard.operators.matching import content_cost, numbered

# How often a difference repeats to be systematic, what agreement is enough, and what findings say.
REPEATS, ENOUGH, TYPE_WORTH = 3, 2, 2
NEAR = "paired through a neighbouring grid cell"
NO_LEVEL = "the plan does not state this element's level and the shop drawings cover several levels at this location, so no pairing was guessed"
NO_DATA = "no shop drawing data for this level"
NOT_COVERED = "shop drawings do not cover this element, or no counterpart was found"
NO_PLAN = "shop element with no plan counterpart found"
HALF, TWICE = "the shop states about half the plan's count", "the shop states about twice the plan's count"
#: Hashes of keys that are broadcast; beyond, rows are shuffled to them.
HASHES = 2_000_000
RECORD = "struct<property:string,plan:string,shop:string,result:string>"


def combined(notes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """All that the notes of one member say: keys, bars, said_by, and columns `keep` of its first note. notes: keys, id, bars (of
    one note), keep.

    A line counts as often as in the note that has it most often: the n-th time that a note says it is the same as the
    n-th time that another does, and belongs to the first. said_by has, for each distinct set of bars, the first note with
    it, so a member with very many copies stays small; its lines are told from these sets, without a further shuffle."""
    names = notes.schema["bars"].dataType.elementType.names
    sets = notes.groupBy(*keys, "bars").agg(F.min(F.struct("id", *keep)).alias("first"))
    whole = sets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "bars"))).alias("_sets"))
    nth = lambda bars, at: F.size(F.filter(F.slice(bars, F.lit(1), at + 1), lambda x: x.eqNullSafe(bars[at])))
    of_note = lambda s: F.transform(F.coalesce(s["bars"], F.array().cast(notes.schema["bars"].dataType)), lambda bar, at: F.struct(bar.alias("bar"), nth(s["bars"], at).alias("nth"), s["first"]["id"].alias("id"), at.alias("at")))
    each = F.sort_array(F.flatten(F.transform("_sets", of_note)))
    new = lambda all_, x, k: (k == 0) | ~F.struct(x["bar"], x["nth"]).eqNullSafe(F.struct(F.get(all_, k - 1)["bar"], F.get(all_, k - 1)["nth"]))
    # by way of an array of one, so that the sorted lines are made once and not for each that is looked at
    first = F.flatten(F.transform(F.array(each), lambda all_: F.filter(all_, lambda x, k: new(all_, x, k))))
    lines = F.sort_array(F.transform(first, lambda x: F.struct(x["id"].alias("id"), x["at"].alias("at"), x["nth"].alias("nth"), x["bar"].alias("bar"))))
    told = F.transform(lines, lambda x: F.struct(x["id"].alias("note"), *(x["bar"][c].alias(c) for c in names)))
    one = F.get("_sets", F.lit(0))["first"]
    return whole.select(*keys, told.alias("bars"), F.transform("_sets", lambda x: F.struct(x["first"]["id"].alias("id"), x["bars"].alias("bars"))).alias("said_by"), *(one[c].alias(c) for c in keep))


def best_notes(plan: Column, shop: Column) -> Column:
    """struct<cost, plan, shop>: the two notes of a pair whose content fits best, the first of several. Arguments: arrays of
    (id, bars), one for each distinct set of bars."""
    return F.array_min(F.flatten(F.transform(plan, lambda p: F.transform(shop, lambda s: F.struct(content_cost(p["bars"], s["bars"]).alias("cost"), p["id"].alias("plan"), s["id"].alias("shop"))))))


def identity(plan: str, shop: str) -> Column:
    """How sure a pair is one member by where and what it is, 0 to 5: cell (2), listed cells, kind and level (1 each)."""
    same = lambda c: F.coalesce(F.col(f"{plan}{c}") == F.col(f"{shop}{c}"), F.lit(False)).cast("int")
    return 2 * same("cell") + F.coalesce(F.col(f"{shop}listed") > 0, F.lit(False)).cast("int") + same("kind") + same("level")


def difference_class(r: Column) -> Column:
    """What kind of change a difference is: its property, and how the values relate."""
    p, s = r["plan"].try_cast("double"), r["shop"].try_cast("double")
    counted = r["property"].endswith("count") & (p != 0) & (s != 0)
    relation = F.when(counted & (F.abs(2 * s - p) <= 1), HALF).when(counted & (F.abs(2 * p - s) <= 1), TWICE).otherwise(F.concat(F.lit("plan "), r["plan"], F.lit(", shop "), r["shop"]))
    return F.struct(r["property"].alias("property"), relation.alias("relation"))


def _status(records: str) -> Column:
    has = lambda result: F.exists(records, lambda r: r["result"] == result)
    return F.when(has("different"), "differs").when(has("possible_difference") | ~has("equal"), "uncertain").otherwise("conforms")


def compared_pairs(pairs: DataFrame, plan: DataFrame, shop: DataFrame) -> DataFrame:
    """pairs: note, slot, cost. plan: note, cell, level, kind, type_key, bars, said_by; shop: slot and the same, quantity and
    listed (what its line says it covers, and how many cells it lists). One row for each pair, with its records and status.

    Beside the bars the quantity counts, where all listed cells were matched, and the type's code."""
    p, s = (d.withColumnsRenamed({c: f"{x}_{c}" for c in d.columns}) for d, x in ((plan, "p"), (shop, "s")))
    m = pairs.join(p, F.col("note") == F.col("p_note")).join(s, F.col("slot") == F.col("s_slot"))
    matched = pairs.groupBy("slot").agg(F.count(F.lit(1)).alias("matched"))
    m = settled(m.join(matched, "slot"))
    rec = lambda name, a, b, same: F.struct(F.lit(name).alias("property"), a.cast("string").alias("plan"), b.cast("string").alias("shop"), F.when(same, "equal").otherwise("different").alias("result"))
    quantity = F.when(F.col("s_quantity").isNotNull() & (F.col("matched") == F.col("s_listed")), rec("quantity required", F.col("matched"), F.col("s_quantity"), F.col("matched") == F.col("s_quantity")))
    kind = F.when(F.col("p_type_key").isNotNull() & F.col("s_type_key").isNotNull(), rec("type", F.col("p_type_key"), F.col("s_type_key"), F.col("p_type_key") == F.col("s_type_key")))
    asked = m.select(F.col("note").alias("id"), F.col("p_bars").alias("plan_bars"), F.col("s_bars").alias("shop_bars"), F.when(F.col("p_type_key") == F.col("s_type_key"), TYPE_WORTH).otherwise(0).alias("agreed"))
    said = B.compare_notes(asked, "agreed").select(F.col("id").alias("note"), F.col("records").cast(f"array<{RECORD}>").alias("said"))
    out = m.join(said, "note").withColumn("more", F.array_compact(F.array(quantity, kind)).cast(f"array<{RECORD}>"))
    equal = F.array_distinct(F.filter(F.concat("said", "more"), lambda r: r["result"] == "equal"))
    weight = F.aggregate(equal, F.lit(0), lambda n, r: n + F.when(r["property"].rlike("(spacing_mm|secondary_count|type)$"), 2).when(r["property"] == "quantity required", 0).otherwise(1))
    sure = F.transform("more", lambda r: F.struct(r["property"].alias("property"), r["plan"].alias("plan"), r["shop"].alias("shop"), F.when((r["result"] == "different") & (weight < ENOUGH), "possible_difference").otherwise(r["result"]).alias("result")))
    out = out.withColumn("records", F.concat("said", sure)).withColumn("best", best_notes(F.col("p_said_by"), F.col("s_said_by")))
    return out.select("note", "slot", "cost", F.coalesce("p_kind", "s_kind").alias("kind"), F.col("p_level").alias("level"), F.col("p_cell").alias("cell"), F.col("s_cell").alias("shop_cell"), F.col("best.plan").alias("plan_note"), F.col("best.shop").alias("shop_note"), identity("p_", "s_").alias("identity"), "records", F.when(F.col("p_cell") != F.col("s_cell"), NEAR).otherwise("").alias("notes"))


def repeated(compared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, compared). A difference that is found in REPEATS records or more is systematic: group (G1 and so on by the first
    record that has it), property, relation, count; in its records it is a possible difference and the group is named. No
    record is dropped. compared: order (a number), records, notes."""
    flags = compared.select("order", F.explode(F.filter("records", lambda r: r["result"] == "different")).alias("r")).select("order", difference_class(F.col("r")).alias("class"))
    found = flags.groupBy("class").agg(F.count_distinct("order").alias("count"), F.min("order").alias("first")).where(f"count >= {REPEATS}")
    groups = settled(numbered(found.select("class", "count", "first", F.col("class.property").alias("property"), F.col("class.relation").alias("relation")), "group", "G%d", "first", "property", "relation", ranges=8))
    mine = flags.distinct().join(groups.select("class", "group", F.col("count").alias("n")), "class").groupBy("order").agg(F.sort_array(F.collect_list(F.struct("group", "class", "n"))).alias("groups"))
    out = compared.join(mine, "order", "left").withColumn("groups", F.coalesce("groups", F.array().cast(mine.schema["groups"].dataType)))
    moved = lambda r: (r["result"] == "different") & F.exists("groups", lambda g: g["class"] == difference_class(r))
    records = F.transform("records", lambda r: F.struct(r["property"].alias("property"), r["plan"].alias("plan"), r["shop"].alias("shop"), F.when(moved(r), "possible_difference").otherwise(r["result"]).alias("result")))
    told = F.transform("groups", lambda g: F.format_string("the same difference is found at %d places (systematic difference %s)", g["n"], g["group"]))
    notes = F.array_join(F.concat(F.filter(F.array("notes"), lambda n: n != ""), told), "; ")
    return groups.select("group", "property", "relation", "count"), out.withColumns({"records": records, "notes": notes, "groups": F.transform("groups", lambda g: g["group"])})


def split(rows: DataFrame, key: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is among that of the pairs, rows whose key isn't). Keys are wide and most rows have no pair, so hashes of
    the pairs' keys tell first what must be shuffled to them: up to HASHES of these are sent to all tasks."""
    hashes = settled(pairs.select(F.xxhash64(key).alias("_hash")).distinct())
    if hashes.limit(HASHES + 1).count() > HASHES:
        may, own = rows, None
    else:
        on = F.xxhash64(key) == F.col("_hash")
        # equal hashes only bring more rows than needed
        may, own = settled(rows.join(F.broadcast(hashes), on, "left_semi")), rows.join(F.broadcast(hashes), on, "left_anti")
    alone = may.join(pairs.select(key).distinct(), key, "left_anti").select(*rows.columns)
    return may, alone if own is None else own.unionByName(alone)


def build_findings(pairs: DataFrame, plan: DataFrame, shop: DataFrame, vetoed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, systematic groups): pairs in order of cost and note, then plan members, then shop members that no pair has,
    numbered F-00001 and so on. Arguments as in compared_pairs(); vetoed: note, members whose level can't be told.

    A pair differs, is uncertain or conforms; the others are not_in_shop (because the level is unknown, because the shop has
    nothing of the level, or without a known reason) or not_in_plan."""
    (paired_plan, lone_plan), (paired_shop, lone_shop) = split(plan, "note", pairs), split(shop, "slot", pairs)
    compared = numbered(compared_pairs(pairs, paired_plan, paired_shop), "order", "%012d", "cost", "note").withColumn("order", F.col("order").cast("long"))
    groups, judged = repeated(settled(compared))
    n = lambda *results: F.size(F.filter("records", lambda r: r["result"].isin(*results)))
    judged = judged.select(F.lit(0).alias("section"), "order", _status("records").alias("status"), "kind", "level", "cell", "shop_cell", "plan_note", "shop_note", "cost", "identity", n("equal").alias("checks"), n("different").alias("flags"), (F.size("records") - n("equal", "different")).alias("info"), "groups", "notes", F.col("note").alias("key"))
    levels = shop.select(F.explode(F.array("level", "level_to")).alias("level")).where("level is not null").distinct().withColumn("covered", F.lit(True))
    # only members without a level can be vetoed, and levels are few
    unknown = lone_plan.where("level is null").join(vetoed.select("note").withColumn("vetoed", F.lit(True)), "note", "left")
    alone = lone_plan.where("level is not null").withColumn("vetoed", F.lit(None).cast("boolean")).unionByName(unknown).join(F.broadcast(levels), "level", "left")
    why = F.when(F.col("level").isNull() & F.col("vetoed"), NO_LEVEL).when(F.col("level").isNotNull() & F.col("covered").isNull(), NO_DATA).otherwise(NOT_COVERED)
    empty = {"order": F.lit(0).cast("long"), "checks": F.lit(0), "flags": F.lit(0), "info": F.lit(1), "groups": F.array().cast("array<string>")}
    alone = alone.select(F.lit(1).alias("section"), F.lit("not_in_shop").alias("status"), "kind", "level", "cell", F.col("note").alias("plan_note"), why.alias("notes"), F.col("note").alias("key")).withColumns(empty)
    extra = lone_shop.select(F.lit(2).alias("section"), F.lit("not_in_plan").alias("status"), "kind", "level", F.col("cell").alias("shop_cell"), F.col("slot").alias("shop_note"), F.lit(NO_PLAN).alias("notes"), F.col("slot").alias("key")).withColumns(empty)
    whole = judged.unionByName(alone, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True)
    return numbered(whole, "finding", "F-%05d", "section", "order", "key").drop("section", "order", "key"), groups
