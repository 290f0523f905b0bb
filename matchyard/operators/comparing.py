"""Comparison of paired records, and the findings of all checks in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchyard import schema as S
from matchyard.operators import checks


def match_factor(method: Column, margin: Column) -> Column:
    return F.when(method == "near_col", F.round(0.7 * (0.6 + 0.4 * F.coalesce(margin, F.lit(1.0))), 3)).otherwise(1.0)


def decide(fired: Column, trust: Column, anomaly: Column | None = None, probability: Column | None = None) -> Column:
    """Status of a pair: a fired rule decides when trust suffices; a model may only ask for a review."""
    low = trust < S.TRUST_FOR_VERDICT
    asks = F.coalesce((anomaly if anomaly is not None else F.lit(None)) >= S.ANOMALY_ESCALATES, F.lit(False)) | F.coalesce((probability if probability is not None else F.lit(None)) >= S.PROBABILITY_ESCALATES, F.lit(False))
    return F.when(fired, F.when(low, "needs_review").otherwise("non_compliant")).when(asks | low, "needs_review").otherwise("compliant")


def finding_id(check: Column, *parts: Column) -> Column:
    return F.concat(F.lit("F-"), F.substring(F.sha1(F.concat_ws("|", check, *(F.coalesce(p, F.lit("")) for p in parts))), 1, 12))


def cross(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Findings of plan against shop, one per pair of `full_outer`, with status, trust, confidence and differing fields."""
    seen = records.groupBy("source").agg(F.collect_set("level").alias("s"))
    covered = seen.agg(F.coalesce(F.max(F.when(F.col("source") == "plan", F.col("s"))), F.array().cast("array<string>")).alias("plan_levels"), F.coalesce(F.max(F.when(F.col("source") == "shop", F.col("s"))), F.array().cast("array<string>")).alias("shop_levels"))
    p = pairs.join(F.broadcast(covered))  # levels are few, and this is one row
    has_plan, has_shop = F.col("plan_id").isNotNull(), F.col("shop_id").isNotNull()
    p = p.withColumn("diffs", F.when(has_plan & has_shop, checks.profile_diffs("plan_", "shop_")))
    lone = F.when(has_plan, F.array_contains("shop_levels", F.col("plan_level"))).otherwise(F.array_contains("plan_levels", F.col("shop_level")))
    kind = F.when(has_plan & has_shop, "field_diff").when(F.col("method") == "unbound", F.when(has_plan, "unbound_plan_block").otherwise("unbound_shop_block")).when(~lone, "level_not_covered").otherwise(F.when(has_plan, "missing").otherwise("added"))
    trust = F.round(F.least("plan_overall", "shop_overall") * match_factor(F.col("method"), F.col("margin")), 3)
    p = p.withColumns({"kind": kind, "trust": trust, "fired": F.coalesce(F.size("diffs") > 0, F.lit(True))})
    status = F.when(F.col("kind") == "field_diff", decide(F.col("fired"), F.col("trust"))).when(F.col("kind").isin("missing", "added") & (F.col("trust") >= S.TRUST_FOR_VERDICT), F.col("kind")).otherwise("needs_review")
    check = F.lit("cross.plan_vs_shop")
    side = lambda c: F.coalesce(f"plan_{c}", f"shop_{c}")
    return p.select(
        finding_id(check, F.col("plan_id"), F.col("shop_id"), F.col("kind")).alias("id"), check.alias("check_type"), status.alias("status"),
        side("type").alias("type"), side("level").alias("level"), F.concat_ws("-", side("row"), F.regexp_replace(side("col").cast("string"), r"\.0$", "")).alias("grid"),
        "plan_id", "shop_id", "kind", F.array_join(F.col("diffs.field"), ",").alias("fields"), "trust",
        F.when(F.col("fired"), 1.0).otherwise(0.0).alias("probability"),
        F.col("trust").alias("confidence"), F.col("plan_file").alias("plan_file"), F.col("shop_file").alias("shop_file"),
    )


def self_findings(records: DataFrame, levels: DataFrame, sizes: Sequence[str] = S.BAR_SIZES, keep: Sequence[str] = ()) -> DataFrame:
    """Findings of the four self checks: id, check_type, status, record, trust, probability, and columns `keep` of the record.

    What a finding says of its record comes along with the check, so no finding is joined to the records."""

    def shape(rows: DataFrame, check: Column, record: str, parts: Sequence[Column], trust: str, probability: Column) -> DataFrame:
        return rows.select(finding_id(check, *parts).alias("id"), check.alias("check_type"), F.lit("needs_review").alias("status"), F.col(record).alias("record"), F.col(trust).alias("trust"), probability.alias("probability"), *keep)

    peers = checks.peer_outliers(records, keep=tuple(dict.fromkeys(("overall", *keep))))
    ties = checks.internal_consistency(records, levels, keep)
    odd = checks.plausibility(records, sizes, keep)
    twice = checks.duplicate_conflicts(records, keep=keep)
    out = shape(peers, F.lit("self.peer_outlier"), "id", [F.col("id"), F.col("field")], "overall", F.col("score"))
    out = out.unionByName(shape(ties, F.lit("self.internal_consistency"), "id", [F.col("id")], "trust", F.lit(1.0)))
    out = out.unionByName(shape(odd, F.lit("self.plausibility"), "id", [F.col("id")], "trust", F.lit(1.0)))
    return out.unionByName(shape(twice, F.col("check_type"), "first_id", [F.col("first_id"), F.col("other_id")], "trust", F.lit(1.0)))


def bar_groups(bars: DataFrame) -> DataFrame:
    """Bars of an element and source by size (none is a size of its own), sorted by count and spacing, missing first."""
    one = F.struct(F.coalesce("count", F.lit(-1)).alias("c"), F.coalesce("spacing_mm", F.lit(-1.0)).alias("s"))
    return bars.groupBy("element", "source", F.coalesce("size", F.lit("no size")).alias("size")).agg(F.sort_array(F.collect_list(one)).alias("bars"))


def generic_diffs(bars: DataFrame) -> DataFrame:
    """Differences of two sides' bar groups: element, field, plan, shop, delta.

    Groups meet by size in a full outer join; within a size the sorted bars are compared place by place. A size whose
    plan counts all occur among the shop's has no count difference."""
    groups = bar_groups(bars)
    both = groups.groupBy("element").agg(F.count_distinct("source").alias("n")).where("n = 2").select("element")
    one = lambda side: groups.where(F.col("source") == side).select("element", "size", F.col("bars").alias(side))
    joined = one("plan").join(one("shop"), ["element", "size"], "full_outer").join(both, "element", "left_semi")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.when(x["c"] < 0, F.lit("?")).otherwise(x["c"].cast("string")), F.lit(" bars"), F.when(x["s"] >= 0, F.concat(F.lit(" @"), x["s"].cast("string"), F.lit("mm"))).otherwise(F.lit("")))), ", ")
    counts = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: x["c"]), lambda x: x >= 0))
    known = (F.size(counts(F.col("plan"))) > 0) & (F.size(F.array_except(counts(F.col("plan")), counts(F.col("shop")))) == 0)
    joined = joined.withColumn("known", known)
    field = lambda name: F.concat(F.col("size"), F.lit(f" {name}"))
    row = lambda f, p, s, d: F.struct(f.alias("field"), p.cast("string").alias("plan"), s.cast("string").alias("shop"), d.cast("double").alias("delta"))
    none = F.lit(None)
    lone = F.when(F.col("shop").isNull(), F.array(row(F.concat(F.lit("bar group "), F.col("size")), text(F.col("plan")), none, none))).when(F.col("plan").isNull(), F.array(row(F.concat(F.lit("bar group "), F.col("size")), none, text(F.col("shop")), none)))
    n = F.least(F.size("plan"), F.size("shop"))
    zipped = F.arrays_zip(F.slice("plan", 1, n).alias("p"), F.slice("shop", 1, n).alias("q"))

    def place(x: Column) -> Column:
        p, q = x["p"], x["q"]
        count = F.when(~F.col("known") & (p["c"] >= 0) & (q["c"] >= 0) & (p["c"] != q["c"]), row(field("count"), p["c"], q["c"], q["c"] - p["c"]))
        space = F.when((p["s"] >= 0) & (q["s"] >= 0) & (F.abs(q["s"] - p["s"]) > S.SPACING_TOLERANCE_MM), row(field("spacing_mm"), p["s"], q["s"], F.round(q["s"] - p["s"], 3)))
        return F.array_compact(F.array(count, space))

    sizes = F.when((F.size("plan") != F.size("shop")) & ~F.col("known"), F.array(row(field("group count"), F.size("plan"), F.size("shop"), F.size("shop") - F.size("plan")))).otherwise(F.array())
    pairs = F.concat(F.flatten(F.transform(zipped, place)), sizes)
    out = joined.withColumn("d", F.coalesce(lone, pairs))
    return out.select("element", F.explode("d").alias("d")).select("element", "d.*")


def combined_statements(statements: DataFrame) -> DataFrame:
    """Multiset union of statements over an element's notes: a statement counts as often as in the note with most of it.
    statements: element, note, key."""
    counts = statements.groupBy("element", "note", "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("element", "key").agg(F.max("n").alias("n"))


def evidence_weight(checks_of: DataFrame) -> DataFrame:
    """Distinct agreeing (property, plan, shop) of an element: two for spacing, secondary and type, one for the rest."""
    w = F.when(F.col("property").isin("spacing", "secondary", "type"), 2).when(F.col("property").isin("count", "size", "section"), 1).otherwise(0)
    return checks_of.select("element", "property", "plan", "shop").distinct().groupBy("element").agg(F.sum(w).cast("long").alias("weight"))


def systematic_groups(flags: DataFrame, least: int = 3) -> DataFrame:
    """Classes of difference found in at least `least` records: kind, property, class, n, name (G1, G2 and so on by size).

    A count that is half or double, give or take one, is one class whatever the numbers. flags: record, kind, property,
    plan, shop (numbers)."""
    half = (F.col("property") == "count") & ((F.abs(2 * F.col("plan") - F.col("shop")) <= 1) | (F.abs(2 * F.col("shop") - F.col("plan")) <= 1))
    name = F.when(half, "half or double").otherwise(F.concat_ws(">", F.col("plan").cast("string"), F.col("shop").cast("string")))
    groups = flags.select("record", "kind", "property", name.alias("class")).groupBy("kind", "property", "class").agg(F.count_distinct("record").alias("n")).where(F.col("n") >= least)
    # classes that repeat are few; their numbering is over the aggregate
    return groups.withColumn("name", F.concat(F.lit("G"), F.row_number().over(Window.orderBy(F.desc("n"), "kind", "property", "class")).cast("string")))
