"""Counts, coverage and listings over findings and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchyard import schema as S


def status_counts(findings: DataFrame, statuses: Sequence[str] = S.STATUSES) -> DataFrame:
    """One row per status, zero where there is none."""
    known = findings.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = findings.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return known.join(F.broadcast(counts), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def by_status(findings: DataFrame, keys: Sequence[str], statuses: Sequence[str] = S.STATUSES) -> DataFrame:
    """Counts of each status side by side for every key."""
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in statuses))


def manifest(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("source") == "plan").alias("plan"), F.count_if(F.col("source") == "shop").alias("shop"))


def coverage(records: DataFrame, types: Sequence[str]) -> DataFrame:
    """For every known type: records, plan pages and shop pages, or NOT COVERED."""
    known = records.sparkSession.createDataFrame([(t,) for t in types], "type string")
    page = lambda side: F.count_distinct(F.when(F.col("source") == side, F.struct("file", "page")))
    seen = records.groupBy("type").agg(F.count(F.lit(1)).alias("records"), page("plan").alias("plan_pages"), page("shop").alias("shop_pages"))
    out = known.join(seen, "type", "left").na.fill(0, ["records", "plan_pages", "shop_pages"])
    return out.withColumn("state", F.when(F.col("records") > 0, "covered").otherwise("NOT COVERED"))


def shop_file_of(findings: DataFrame, records: DataFrame) -> DataFrame:
    """The shop file each finding is listed under: its own, else the first shop file that covers its level, else none."""
    first = records.where("source = 'shop'").groupBy("level").agg(F.min("file").alias("level_file"))
    return findings.join(first, "level", "left").select("id", "level", F.coalesce("shop_file", "level_file").alias("file"))


def natural_key(text: Column) -> Column:
    """Sorts like people do: digits by value. Numbers are padded to 12 digits."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1), lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(t, 12, "0")).otherwise(t)), "")


def safe_name(name: Column) -> Column:
    """A file name: the stem with anything unusual replaced, and six digits of its hash."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.concat(F.regexp_replace(stem, r"[^A-Za-z0-9_-]+", "_"), F.lit("_"), F.substring(F.sha1(name), 1, 6))


def collapse_duplicates(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records that say the same: the first by id stays, with occurrences and the pages they stood on."""
    out = records.groupBy(*keys).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("occurrences"), F.array_join(F.sort_array(F.collect_set("page")), ",").alias("pages"))
    return out.select("id", *keys, "occurrences", "pages")


def cell_merge(records: DataFrame) -> DataFrame:
    """All statements of a cell as one: least confidence, outer box and most repeats of one statement."""
    said = records.groupBy("source", "file", "type", "level", "row", "col", "count", "size").agg(F.count(F.lit(1)).alias("n"), F.min("overall").alias("o"), F.min("page").alias("p0"), F.max("page").alias("p1"))
    return said.groupBy("source", "file", "type", "level", "row", "col").agg(F.count(F.lit(1)).alias("statements"), F.min("o").alias("overall"), F.max("n").alias("occurrences"), F.min("p0").alias("first_page"), F.max("p1").alias("last_page"))


def witness_rates(records: DataFrame) -> DataFrame:
    """How often the other side agrees on (count, size) of a cell: for the level's usual value, for others, and for a
    control cell one column further. One row."""
    plan = records.where("source = 'plan'").select("level", "row", "col", "count", "size").distinct()
    shop = records.where("source = 'shop'").select("level", "row", "col", "count", "size").distinct()
    usual = plan.groupBy("level", "count", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("level").agg(F.min_by(F.struct("count", "size"), F.struct((-F.col("n")).alias("n"), "count", "size")).alias("mode"))
    cells = shop.select("level", "row", "col").distinct().withColumn("known", F.lit(True))
    place = ["level", "row", "col"]
    said = [*place, "count", "size"]
    control = shop.select("level", "row", (F.col("col") - 1).alias("col"), "count", "size").distinct()
    p = plan.join(cells, place).join(usual, "level")
    p = p.join(shop.withColumn("agrees", F.lit(1)), said, "left").join(control.withColumn("chance", F.lit(1)), said, "left")
    typical = (F.col("count") == F.col("mode.count")) & (F.col("size") == F.col("mode.size"))
    rate = lambda c, hit: F.round(F.sum(F.when(c & F.col(hit).isNotNull(), 1).otherwise(0)) / F.nullif(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)), 4)
    return p.agg(F.count(F.lit(1)).alias("matched"), rate(typical, "agrees").alias("typical"), rate(~typical, "agrees").alias("atypical"), rate(F.lit(True), "chance").alias("chance"))


def level_gaps(records: DataFrame) -> DataFrame:
    """Levels that only one side has."""
    levels = records.groupBy("level").agg(F.max(F.when(F.col("source") == "plan", 1).otherwise(0)).alias("p"), F.max(F.when(F.col("source") == "shop", 1).otherwise(0)).alias("s"))
    return levels.where("p <> s").select("level", F.when(F.col("p") == 1, "plan").otherwise("shop").alias("only"))
