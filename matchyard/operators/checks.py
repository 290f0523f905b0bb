"""Checks of one source against itself: peers, storey heights, tie bands, plausibility, repeated keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchyard import schema as S
from matchyard.operators.durable import settled

KEY = ("type", "level", "row", "col")
#: Hashes (8 bytes each) that are broadcast rather than met by a shuffle of all records.
SENT_TO_ALL = 2_000_000


def key_of(*columns: str) -> Column:
    """The match key as text; a null part leaves its place empty."""
    return F.concat_ws("|", *(F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""), F.lit("")) for c in columns))


def peer_outliers(records: DataFrame, group: Sequence[str] = ("source", "file", "page", "level"), fields: Sequence[str] = S.PEER_FIELDS, keep: Sequence[str] = ()) -> DataFrame:
    """Values that are rare in a group whose members otherwise agree: id, field, value, mode, score, and the columns `keep`.

    Counts come first: one row per group, field and value leaves each task, so a very large group is one partial sum
    per task, and the test runs on those counts. Values that stand out are written, so that Spark knows how few they are
    when it joins them back to their records, and shuffles no records for a handful."""
    group, own = list(group), [c for c in keep if c not in group]
    long = records.select("id", *own, *group, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("_v")).select("id", *own, *group, "_v.*")
    counts = long.groupBy(*group, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    keys = Window.partitionBy(*group, "field")
    ranked = counts.withColumns({
        "members": F.sum("n").over(keys),
        "known": F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).over(keys),
        "place": F.row_number().over(keys.orderBy(F.when(F.col("value").isNull(), 1).otherwise(0), F.desc("n"), "value")),
    })
    ranked = ranked.withColumns({"mode": F.max(F.when(F.col("place") == 1, F.col("value"))).over(keys), "mode_n": F.max(F.when(F.col("place") == 1, F.col("n"))).over(keys)})
    share, mode_share = F.col("n") / F.col("known"), F.col("mode_n") / F.col("known")
    enough = (F.col("members") >= S.PEER_GROUP) & (F.col("known") >= S.PEER_GROUP) & F.col("value").isNotNull()
    rare = ranked.where(enough & (F.col("value") != F.col("mode")) & (mode_share >= S.PEER_MODE_SHARE) & (share <= S.PEER_RARE_SHARE))
    rare = rare.select(*group, "field", "value", "mode", F.round(mode_share * (1 - share), 3).alias("score"))
    # null group keys are groups too
    rare = settled(rare.withColumnsRenamed({c: f"_{c}" for c in (*group, "field", "value")}))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group] + [F.col(c) == F.col(f"_{c}") for c in ("field", "value")]
    return long.join(rare, on).select("id", "field", "value", "mode", "score", *keep)


def storey_heights(levels: DataFrame) -> DataFrame:
    """level and the distance to the next higher elevation; the top level has none. Levels are few: one sorted window."""
    return levels.where("elevation_mm is not null").select("level", (F.lead("elevation_mm").over(Window.orderBy("elevation_mm", "level")) - F.col("elevation_mm")).alias("height_mm")).where("height_mm is not null")


def tie_ratios(records: DataFrame, levels: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Tie count times spacing over storey height for shop records that state both: id, level, overall, ratio, and `keep`."""
    stated = records.where("source = 'shop' and tie_count is not null and spacing_mm is not null")
    ratio = F.round(F.col("tie_count") * F.col("spacing_mm") / F.col("height_mm"), 3)
    heights = F.broadcast(storey_heights(levels).where("height_mm <> 0"))  # levels are few, and records stay where they are
    return stated.join(heights, "level").select("id", "level", "overall", ratio.alias("ratio"), *(c for c in keep if c not in ("level", "overall")))


def learned_band(ratios: DataFrame) -> DataFrame:
    """One row (lo, hi, how): median plus or minus six robust deviations, or fixed limits below 20 samples."""
    median = ratios.agg(F.median("ratio").alias("med"), F.count("ratio").alias("n"))
    spread = ratios.join(F.broadcast(median)).agg(F.first("med").alias("med"), F.first("n").alias("n"), F.median(F.abs(F.col("ratio") - F.col("med"))).alias("mad"))
    sigma = F.greatest(1.4826 * F.col("mad"), S.BAND_FLOOR * F.col("med"))
    few = F.coalesce(F.col("n"), F.lit(0)) < S.BAND_SAMPLES
    return spread.select(
        F.when(few, S.BAND_FIXED[0]).otherwise(F.col("med") - S.BAND_K * sigma).alias("lo"),
        F.when(few, S.BAND_FIXED[1]).otherwise(F.col("med") + S.BAND_K * sigma).alias("hi"),
        F.when(few, "fallback").otherwise("learned").alias("how"),
    )


def internal_consistency(records: DataFrame, levels: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Shop records whose tie ratio is outside the band; the band is one row and broadcast."""
    ratios = tie_ratios(records, levels, keep)
    band = F.broadcast(learned_band(ratios))
    return ratios.join(band).where(~F.col("ratio").between(F.col("lo"), F.col("hi"))).select("id", "level", "ratio", "how", F.col("overall").alias("trust"), *(c for c in keep if c != "level"))


def sanity(count: str = "count", size: str = "size", spacing: str = "spacing_mm", sizes: Sequence[str] = S.BAR_SIZES) -> dict[str, Column]:
    """Names of the sanity checks that a record passed and failed, as sorted arrays; what isn't stated isn't checked."""
    tests = {"count_plausible": F.col(count).between(1, 60), "size_in_vocabulary": F.col(size).isin(*sizes), "spacing_plausible": F.col(spacing).between(25.0, 600.0)}
    return {"passed": F.array_compact(F.array(*(F.when(t, k) for k, t in tests.items()))), "failed": F.array_compact(F.array(*(F.when(~t, k) for k, t in tests.items())))}


def plausibility(records: DataFrame, sizes: Sequence[str] = S.BAR_SIZES, keep: Sequence[str] = ()) -> DataFrame:
    """Records with a failed sanity check."""
    out = records.withColumn("failed", sanity(sizes=sizes)["failed"]).where(F.size("failed") > 0)
    return out.select("id", F.array_join("failed", ",").alias("failed"), F.col("overall").alias("trust"), *keep)


def profile_diffs(a: str, b: str) -> Column:
    """Fields that both sides state and that differ, in fixed order, as an array of (field, plan, shop, delta)."""

    def one(field: str, differs: Column, delta: Column) -> Column:
        x, y = F.col(f"{a}{field}"), F.col(f"{b}{field}")
        return F.when(differs, F.struct(F.lit(field).alias("field"), x.cast("string").alias("plan"), y.cast("string").alias("shop"), delta.cast("double").alias("delta")))

    both = lambda f: (F.col(f"{a}{f}"), F.col(f"{b}{f}"))
    none = F.lit(None)
    (n, m), (s, t), (u, v), (d, e) = map(both, S.PEER_FIELDS)
    gap = F.round(e - d, 3)
    return F.array_compact(F.array(one("count", n != m, m - n), one("size", s != t, none), one("tie_size", u != v, none), one("spacing_mm", F.abs(gap) > S.SPACING_TOLERANCE_MM, gap)))


def duplicate_conflicts(records: DataFrame, key: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Records of one source and key that disagree with the key's first record (by file, page, id), with its columns `keep`.

    Hashes of keys are counted first, and only records whose hash repeats go further; equal hashes of two keys bring more
    records than needed. Up to SENT_TO_ALL such hashes are broadcast, beyond that records go to them. The first is a grouped minimum, aggregated before the shuffle, and joined; a key with very many
    records is split by adaptive execution. The check is `cross.shop_vs_shop` between shop files, else `self.duplicate`."""
    parts = () if key is not None else KEY
    stated = ("file", "page", "id", *S.PEER_FIELDS, "overall")
    own = [c for c in keep if c not in stated]
    sent = dict.fromkeys(("source", *stated, *own, *parts, *(() if parts else ("key",))))
    bound = records.where(F.col("row").isNotNull() & F.col("col").isNotNull())
    bound = bound.withColumn("key", key) if key is not None else bound
    # a key of parts is made again where it is needed, so that a record is sent with its parts only
    bound = bound.select(*sent, F.xxhash64("source", key_of(*parts) if parts else F.col("key")).alias("_at"))
    several = settled(bound.groupBy("_at").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_at"))
    if several.count() <= SENT_TO_ALL:
        several = F.broadcast(several)
    bound = settled(bound.join(several, "_at", "left_semi").drop("_at"))
    bound = bound.withColumn("key", key_of(*parts)) if parts else bound
    order = F.struct(*stated, *own)
    first = bound.groupBy("source", "key").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("source", "key", *(F.col(f"f.{c}").alias(f"a_{c}") for c in (*stated, *own)))
    pairs = bound.join(first, ["source", "key"]).where("id <> a_id").withColumnsRenamed({c: f"b_{c}" for c in S.PEER_FIELDS})
    pairs = pairs.withColumn("diffs", profile_diffs("a_", "b_")).where(F.size("diffs") > 0)
    check = F.when((F.col("source") == "shop") & (F.col("file") != F.col("a_file")), "cross.shop_vs_shop").otherwise("self.duplicate")
    return pairs.select(check.alias("check_type"), "source", "key", F.col("a_id").alias("first_id"), F.col("id").alias("other_id"), F.array_join(F.col("diffs.field"), ",").alias("fields"), F.round(F.least("a_overall", "overall"), 3).alias("trust"), *(F.col(f"a_{c}").alias(c) for c in keep))
