"""From pairs to findings: one list of all checks, slots of the shop side, quantities, vetoes, and orders of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchyard.operators.matching import kind_cost, numbered, same_length

# Kinds of members and the types that lists show them as; the order of statuses in a list.
KIND_TYPES = (
    ("footing", "fondation"), ("raft", "fondation"), ("pile", "fondation"), ("pile_cap", "fondation"), ("beam", "poutre"), ("wall", "mur_refend"),
    ("shear_wall", "mur_refend"), ("column", "colonne"), ("pier", "colonne"), ("slab", "dalle"),
)
LISTED_FIRST = ("non_compliant", "needs_review")
SECTION_SAME, SECTION_OTHER, SECTION_FLOOR = -0.3, 0.4, 1.0
DETAIL_TEXTS = 40


def all_findings(cross: DataFrame, own: DataFrame) -> DataFrame:
    """Findings between the sides and within one, in one numbered list by level, cell, check and id. own: also level, row and
    col of its record."""
    cell = F.concat_ws("-", "row", F.regexp_replace(F.col("col").cast("string"), r"\.0$", ""))
    own = own.withColumn("grid", F.when(F.col("row").isNotNull() & F.col("col").isNotNull(), cell))
    columns = ("id", "check_type", "status", "level", "grid", "trust", "probability")
    whole = cross.select(*columns).unionByName(own.select(*columns)).withColumn("_grid", F.coalesce("grid", F.lit("")))
    return numbered(whole, "number", "F-%07d", "level", "_grid", "check_type", "id").drop("_grid")


def list_order(findings: DataFrame) -> DataFrame:
    """Numbers findings as they are shown: what isn't compliant, what needs review, all else, each by id.

    Ids are 48 bits of a digest, so two findings may share one; their statuses then decide, and reruns agree."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, LISTED_FIRST)), F.col("status")), F.lit(0))
    return numbered(findings.withColumn("_place", F.when(place == 0, len(LISTED_FIRST) + 1).otherwise(place)), "number", "%07d", "_place", "id", "status").drop("_place")


def shown_type(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in KIND_TYPES for x in pair))[kind]


def slots(elements: DataFrame) -> DataFrame:
    """Places that a shop element may fill: one for each of its cells, without any a single one of no cell.

    elements: id, cells (array), cell, level, level_to, kind, role. Schedule tags are reference data and fill none. Slots of one
    cell, levels and kind are known by the first of them: slot, and the others as its group."""
    cells = F.when(F.size("cells") > 0, F.col("cells")).otherwise(F.array("cell"))
    each = elements.where("role is null or role <> 'schedule_tag'").select("id", F.explode_outer(cells).alias("cell"), "level", "level_to", "kind")
    return each.groupBy("cell", "level", "level_to", "kind").agg(F.min("id").alias("slot"), F.count(F.lit(1)).alias("members"))


def level_vetoes(entities: DataFrame, pool: DataFrame) -> DataFrame:
    """Entities without a level in whose cell slots of a fitting kind stand on several levels, no level being one too: they
    can't be told apart. entities: note, cell, level, kind; pool: cell, level, kind."""
    p = pool.select("cell", F.col("level").alias("_level"), F.col("kind").alias("_kind")).distinct()  # not every slot: a cell has few levels and kinds
    near = entities.where("level is null").join(p, "cell").where(kind_cost(F.col("kind"), F.col("_kind")) < 1.0)
    return near.groupBy("note").agg(F.count_distinct(F.coalesce("_level", F.lit(""))).alias("levels")).where("levels > 1")


def section_cost(a: Column, b: Column) -> Column:
    """Two drawn sections (arrays of two lengths): the same either way round speaks for one member, others against it."""
    same = lambda p, q: same_length(a[0], b[p], SECTION_FLOOR) & same_length(a[1], b[q], SECTION_FLOOR)
    return F.when(a.isNull() | b.isNull() | (F.size(a) < 2) | (F.size(b) < 2), 0.0).when(same(0, 1) | same(1, 0), SECTION_SAME).otherwise(SECTION_OTHER)


def numbers_differ(a: Column, b: Column) -> Column:
    """Whether two statements (count, size, spacing_mm) really differ in a number: in count or size, else in spacing."""
    differ = lambda n: F.coalesce(a[n] != b[n], F.lit(False))
    return differ("count") | differ("size") | F.coalesce(~same_length(a["spacing_mm"], b["spacing_mm"]), F.lit(False))


def quantity_checks(pairs: DataFrame, printed: DataFrame) -> DataFrame:
    """How many plan entities a shop element was paired with against the quantity that it prints, where all its listed cells
    were. pairs: shop, plan; printed: shop, quantity, cells (how many it lists)."""
    matched = pairs.groupBy("shop").agg(F.count(F.lit(1)).alias("matched"))
    out = matched.join(printed.where("quantity is not null"), "shop").where("matched = cells")
    return out.select("shop", "matched", "quantity", F.when(F.col("matched") == F.col("quantity"), "equal").otherwise("different").alias("result"))


def new_flags(before: DataFrame, after: DataFrame) -> DataFrame:
    """Flags (record, flag) that stand after and not before."""
    return after.select("record", "flag").distinct().join(before.select("record", "flag").distinct(), ["record", "flag"], "left_anti")


def flag_union(a: Column, b: Column) -> Column:
    """Flags of both sides, each once, sorted."""
    return F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def without_match(keyed: DataFrame, other: DataFrame) -> DataFrame:
    return keyed.join(other.select("key").distinct(), "key", "left_anti")


def repeated_on_page(records: DataFrame, *key: str) -> DataFrame:
    """Adds the number of a record among those of its page with the same key, and a flag from the second on."""
    order = Window.partitionBy("file", "page", *key).orderBy("id")
    out = records.withColumn("nth", F.row_number().over(order))
    return out.withColumn("flag", F.when(F.col("nth") > 1, "duplicate_cell_level_on_page"))


def page_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy("file", "page").agg(F.round(F.avg("conf"), 4).alias("mean_conf"), F.min("conf").alias("min_conf"))


def detail_texts(blocks: DataFrame, most: int = DETAIL_TEXTS) -> DataFrame:
    """The first texts of each drawing (page, title) that aren't noise: lone grid labels, numbers and marks, or three
    characters and less. A limit of the list that is shown. blocks: page, title, k (reading order), text."""
    noise = F.trim("text").rlike(r"^([A-Z]{1,2}(\.\d)?'?|\d{1,3}(\.\d)?|[-–—•.])$")
    order = Window.partitionBy("page", "title").orderBy("k")
    kept = blocks.where(F.col("title").isNotNull() & ~noise & (F.length("text") > 3)).withColumn("place", F.row_number().over(order))
    return kept.where(F.col("place") <= most)


def axis_value(low: Column, high: Column, fraction: Column, nearest: Column) -> Column:
    """Where a note lies along an axis, in label units: between two lines, else at the nearest."""
    return F.coalesce(F.round(low + fraction * (high - low), 3), nearest)


def spacing_feedback(pairs: DataFrame) -> DataFrame:
    """Median of shop over plan spacing by level, and whether it speaks for inches read as millimetres or the other way round.
    pairs: level, plan_mm, shop_mm."""
    ratio = F.median(F.when((F.col("plan_mm") > 0) & (F.col("shop_mm") > 0), F.col("shop_mm") / F.col("plan_mm")))
    out = pairs.groupBy("level").agg(ratio.alias("ratio"), F.count("plan_mm").alias("n"))
    wrong = (F.abs(F.col("ratio") * 25.4 - 1) <= 0.1) | (F.abs(F.col("ratio") / 25.4 - 1) <= 0.1)
    return out.select("level", F.round("ratio", 6).alias("ratio"), "n", F.coalesce(wrong, F.lit(False)).alias("unit_error"))
