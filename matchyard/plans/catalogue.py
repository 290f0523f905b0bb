"""Registered queries over the driver tables and the SQL that states what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchyard import schema as S
from matchyard.functions import quality, text
from matchyard.operators import checks, comparing, layout, matching, reporting
from matchyard.sources.adapters import BARS_SQL, ELEMENTS_SQL, LEVELS_SQL, NOTES_SQL, WORDS_SQL, bars, elements, levels, notes, table, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register

def with_tables(*parts: str) -> str:
    return "WITH " + ",".join(parts)

KEY_SQL = """concat_ws('|', type, level, "row", regexp_replace(CAST(col AS VARCHAR), '\\.0$', ''))"""

# ---- checks of one source

PEER_SQL = f"""
long AS (
  SELECT id, source, file, page, level, overall, 'count' AS field, CAST("count" AS VARCHAR) AS value FROM elements
  UNION ALL SELECT id, source, file, page, level, overall, 'size', size FROM elements
  UNION ALL SELECT id, source, file, page, level, overall, 'tie_size', tie_size FROM elements
  UNION ALL SELECT id, source, file, page, level, overall, 'spacing_mm', CAST(spacing_mm AS VARCHAR) FROM elements),
members AS (SELECT source, file, page, level, count(*) AS members FROM elements GROUP BY ALL HAVING count(*) >= {S.PEER_GROUP}),
counts AS (SELECT source, file, page, level, field, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, SUM(n) OVER g AS known, first_value(value) OVER (PARTITION BY source, file, page, level, field ORDER BY n DESC, value) AS mode, max(n) OVER g AS mode_n
  FROM counts WINDOW g AS (PARTITION BY source, file, page, level, field)),
rare AS (SELECT r.*, round(mode_n / known * (1 - n / known), 3) AS score FROM ranked r JOIN members USING (source, file, page, level)
  WHERE known >= {S.PEER_GROUP} AND value <> mode AND mode_n / known >= {S.PEER_MODE_SHARE} AND n / known <= {S.PEER_RARE_SHARE}),
peers AS (SELECT l.id, l.field, l.value, r.mode, r.score, l.overall FROM long l JOIN rare r USING (source, file, page, level, field, value))"""

@query(with_tables(ELEMENTS_SQL, PEER_SQL) + " SELECT id, field, value, mode, score FROM peers")
def peer_outliers(spark, sf_dir):
    return checks.peer_outliers(elements(spark, sf_dir))

HEIGHTS_SQL = """
heights AS (SELECT level, height_mm FROM (SELECT level, lead(elevation_mm) OVER (ORDER BY elevation_mm, level) - elevation_mm AS height_mm FROM levels) WHERE height_mm IS NOT NULL)"""
TIES_SQL = """
ties AS (SELECT id, e.level, overall, round(tie_count * spacing_mm / height_mm, 3) AS ratio FROM elements e JOIN heights h ON e.level = h.level
  WHERE source = 'shop' AND tie_count IS NOT NULL AND spacing_mm IS NOT NULL AND height_mm <> 0),
med AS (SELECT median(ratio) AS med, count(*) AS n FROM ties),
band AS (SELECT CASE WHEN n < 20 THEN 0.8 ELSE med - 6.0 * greatest(1.4826 * mad, 0.05 * med) END AS lo,
  CASE WHEN n < 20 THEN 1.3 ELSE med + 6.0 * greatest(1.4826 * mad, 0.05 * med) END AS hi, CASE WHEN n < 20 THEN 'fallback' ELSE 'learned' END AS how
  FROM (SELECT any_value(med) AS med, any_value(n) AS n, median(abs(ratio - med)) AS mad FROM ties, med)),
odd AS (SELECT id, level, ratio, how, overall AS trust FROM ties, band WHERE NOT (ratio BETWEEN lo AND hi))"""

@query(with_tables(LEVELS_SQL, HEIGHTS_SQL) + " SELECT * FROM heights")
def storey_heights(spark, sf_dir):
    return checks.storey_heights(levels(spark, sf_dir))

@query(with_tables(ELEMENTS_SQL, LEVELS_SQL, HEIGHTS_SQL, TIES_SQL) + " SELECT * FROM ties")
def tie_ratios(spark, sf_dir):
    return checks.tie_ratios(elements(spark, sf_dir), levels(spark, sf_dir))

@query(with_tables(ELEMENTS_SQL, LEVELS_SQL, HEIGHTS_SQL, TIES_SQL) + " SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, how FROM band")
def learned_band(spark, sf_dir):
    out = checks.learned_band(checks.tie_ratios(elements(spark, sf_dir), levels(spark, sf_dir)))
    return out.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "how")

@query(with_tables(ELEMENTS_SQL, LEVELS_SQL, HEIGHTS_SQL, TIES_SQL) + " SELECT * FROM odd")
def internal_consistency(spark, sf_dir):
    return checks.internal_consistency(elements(spark, sf_dir), levels(spark, sf_dir))

#: The adapter's sizes are all known; a vocabulary without the rarer one makes the check fire.
COMMON_SIZES = ("10M", "15M", "20M", "25M", "30M")
PLAUSIBLE_SQL = """
implausible AS (SELECT id, failed, overall AS trust FROM (SELECT id, overall, concat_ws(',',
  CASE WHEN NOT ("count" BETWEEN 1 AND 60) THEN 'count_plausible' END, CASE WHEN size NOT IN ('10M','15M','20M','25M','30M') THEN 'size_in_vocabulary' END,
  CASE WHEN NOT (spacing_mm BETWEEN 25.0 AND 600.0) THEN 'spacing_plausible' END) AS failed FROM elements) WHERE failed <> '')"""

@query(with_tables(ELEMENTS_SQL, PLAUSIBLE_SQL) + " SELECT * FROM implausible")
def plausibility(spark, sf_dir):
    return checks.plausibility(elements(spark, sf_dir), COMMON_SIZES)

def diffs_sql(a: str, b: str) -> str:
    return f"""concat_ws(',', CASE WHEN {a}."count" <> {b}."count" THEN 'count' END, CASE WHEN {a}.size <> {b}.size THEN 'size' END,
  CASE WHEN {a}.tie_size <> {b}.tie_size THEN 'tie_size' END, CASE WHEN abs(round({b}.spacing_mm - {a}.spacing_mm, 3)) > 1.0 THEN 'spacing_mm' END)"""

TWICE_SQL = f"""
keyed AS (SELECT *, {KEY_SQL} AS key FROM elements),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY file, page, id) AS k FROM keyed) WHERE k = 1),
twice AS (SELECT * FROM (SELECT CASE WHEN e.source = 'shop' AND e.file <> f.file THEN 'cross.shop_vs_shop' ELSE 'self.duplicate' END AS check_type, e.source, e.key,
  f.id AS first_id, e.id AS other_id, {diffs_sql("f", "e")} AS fields, round(least(f.overall, e.overall), 3) AS trust
  FROM keyed e JOIN firsts f ON e.source = f.source AND e.key = f.key AND e.id <> f.id) WHERE fields <> '')"""

@query(with_tables(ELEMENTS_SQL, TWICE_SQL) + " SELECT * FROM twice")
def duplicate_conflicts(spark, sf_dir):
    return checks.duplicate_conflicts(elements(spark, sf_dir))

@query(with_tables(ELEMENTS_SQL, LEVELS_SQL, PEER_SQL, HEIGHTS_SQL, TIES_SQL, PLAUSIBLE_SQL, TWICE_SQL) + """,
f AS (SELECT 'self.peer_outlier' AS c, id || '|' || field AS parts, id AS record, overall AS trust, score AS probability FROM peers
  UNION ALL SELECT 'self.internal_consistency', id, id, trust, 1.0 FROM odd UNION ALL SELECT 'self.plausibility', id, id, trust, 1.0 FROM implausible
  UNION ALL SELECT check_type, first_id || '|' || other_id, first_id, trust, 1.0 FROM twice)
SELECT 'F-' || substr(sha1(c || '|' || parts), 1, 12) AS id, c AS check_type, 'needs_review' AS status, record, trust, CAST(probability AS DOUBLE) AS probability FROM f""")
def self_findings(spark, sf_dir):
    return comparing.self_findings(elements(spark, sf_dir), levels(spark, sf_dir), COMMON_SIZES)

# ---- matching

PRIMARY_SQL = f"""
primaries AS (SELECT * FROM (SELECT *, {KEY_SQL} AS key, row_number() OVER (PARTITION BY source, {KEY_SQL} ORDER BY overall DESC, file, page, id) AS k,
  count(*) OVER (PARTITION BY source, {KEY_SQL}) - 1 AS extras FROM elements) WHERE k = 1),
p AS (SELECT * FROM primaries WHERE source = 'plan'), s AS (SELECT * FROM primaries WHERE source = 'shop')"""

@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL) + " SELECT key, p.id AS plan_id, s.id AS shop_id, p.extras AS plan_extras, s.extras AS shop_extras FROM p JOIN s USING (key)")
def key_match_primary(spark, sf_dir):
    return matching.key_match(elements(spark, sf_dir)).select("key", "plan_id", "shop_id", "plan_extras", "shop_extras")

@query()
def near_column_match(spark, sf_dir):
    return matching.near_columns(elements(spark, sf_dir))

CROSS_SQL = f"""
lv AS (SELECT DISTINCT source, level FROM elements),
o AS (SELECT key, p.id AS plan_id, s.id AS shop_id, COALESCE(p.type, s.type) AS type, COALESCE(p.level, s.level) AS level,
  concat_ws('-', COALESCE(p."row", s."row"), regexp_replace(CAST(COALESCE(p.col, s.col) AS VARCHAR), '\\.0$', '')) AS grid,
  CASE WHEN p.id IS NOT NULL AND s.id IS NOT NULL THEN {diffs_sql("p", "s")} END AS fields,
  p.file AS plan_file, s.file AS shop_file, round(least(p.overall, s.overall), 3) AS trust FROM p FULL JOIN s USING (key)),
k AS (SELECT *, CASE WHEN plan_id IS NOT NULL AND shop_id IS NOT NULL THEN 'field_diff' WHEN plan_id IS NOT NULL AND level NOT IN (SELECT level FROM lv WHERE source = 'shop') THEN 'level_not_covered'
  WHEN shop_id IS NOT NULL AND level NOT IN (SELECT level FROM lv WHERE source = 'plan') THEN 'level_not_covered' WHEN plan_id IS NOT NULL THEN 'missing' ELSE 'added' END AS kind FROM o),
findings AS (SELECT 'F-' || substr(sha1('cross.plan_vs_shop|' || COALESCE(plan_id, '') || '|' || COALESCE(shop_id, '') || '|' || kind), 1, 12) AS id, 'cross.plan_vs_shop' AS check_type,
  CASE WHEN kind = 'field_diff' AND fields <> '' THEN CASE WHEN trust >= 0.7 THEN 'non_compliant' ELSE 'needs_review' END
       WHEN kind = 'field_diff' THEN CASE WHEN trust >= 0.7 THEN 'compliant' ELSE 'needs_review' END
       WHEN kind IN ('missing', 'added') AND trust >= 0.7 THEN kind ELSE 'needs_review' END AS status,
  type, level, grid, plan_id, shop_id, kind, fields, trust, CASE WHEN fields = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS probability, trust AS confidence, plan_file, shop_file FROM k)"""

def _cross(spark, sf_dir):
    e = elements(spark, sf_dir)
    return comparing.cross(matching.full_outer(e.drop("tie_count")), e)

@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL, CROSS_SQL) + " SELECT * FROM findings")
def cross_findings(spark, sf_dir):
    return _cross(spark, sf_dir)

@query()
def cross_findings_near(spark, sf_dir):
    e = elements(spark, sf_dir)
    return comparing.cross(matching.full_outer(e, matching.near_columns(e)), e)

@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL) + f""" SELECT * FROM (SELECT key, p.id AS plan_id, s.id AS shop_id, {diffs_sql("p", "s")} AS fields FROM p JOIN s USING (key)) WHERE fields <> ''""")
def profile_diffs(spark, sf_dir):
    out = matching.key_match(elements(spark, sf_dir)).withColumn("diffs", checks.profile_diffs("plan_", "shop_")).where(F.size("diffs") > 0)
    return out.select("key", "plan_id", "shop_id", F.array_join(F.col("diffs.field"), ",").alias("fields"))

BAR_TEXT = "array_to_string(list_transform({0}, lambda x: CASE WHEN x.c < 0 THEN '?' ELSE CAST(x.c AS VARCHAR) END || ' bars' || CASE WHEN x.s >= 0 THEN ' @' || CAST(x.s AS VARCHAR) || 'mm' ELSE '' END), ', ')"

@query(with_tables(BARS_SQL) + f""",
g AS (SELECT element, source, COALESCE(size, 'no size') AS size, list({{'c': COALESCE("count", -1), 's': CAST(COALESCE(spacing_mm, -1.0) AS DOUBLE)}} ORDER BY COALESCE("count", -1), COALESCE(spacing_mm, -1.0)) AS b FROM bars GROUP BY ALL),
e2 AS (SELECT element FROM g GROUP BY element HAVING count(DISTINCT source) = 2),
j AS (SELECT element, size, a.b AS plan, c.b AS shop FROM (SELECT * FROM g WHERE source = 'plan') a FULL JOIN (SELECT * FROM g WHERE source = 'shop') c USING (element, size) WHERE element IN (SELECT element FROM e2)),
k AS (SELECT *, len(list_filter(plan, lambda x: x.c >= 0)) > 0 AND len(list_filter(plan, lambda x: x.c >= 0 AND NOT list_contains(list_transform(shop, lambda y: y.c), x.c))) = 0 AS known FROM j),
z AS (SELECT element, size, known, unnest(list_zip(plan[1:least(len(plan), len(shop))], shop[1:least(len(plan), len(shop))])) AS t FROM k WHERE plan IS NOT NULL AND shop IS NOT NULL),
y AS (SELECT element, size, known, t[1] AS p, t[2] AS q FROM z)
SELECT element, 'bar group ' || size AS field, {BAR_TEXT.format("plan")} AS plan, NULL::VARCHAR AS shop, NULL::DOUBLE AS delta FROM k WHERE shop IS NULL
UNION ALL SELECT element, 'bar group ' || size, NULL, {BAR_TEXT.format("shop")}, NULL FROM k WHERE plan IS NULL
UNION ALL SELECT element, size || ' count', CAST(p.c AS VARCHAR), CAST(q.c AS VARCHAR), CAST(q.c - p.c AS DOUBLE) FROM y WHERE NOT known AND p.c >= 0 AND q.c >= 0 AND p.c <> q.c
UNION ALL SELECT element, size || ' spacing_mm', CAST(p.s AS VARCHAR), CAST(q.s AS VARCHAR), round(q.s - p.s, 3) FROM y WHERE p.s >= 0 AND q.s >= 0 AND abs(q.s - p.s) > 1.0
UNION ALL SELECT element, size || ' group count', CAST(len(plan) AS VARCHAR), CAST(len(shop) AS VARCHAR), CAST(len(shop) - len(plan) AS DOUBLE) FROM k WHERE plan IS NOT NULL AND shop IS NOT NULL AND len(plan) <> len(shop) AND NOT known""")
def generic_diffs(spark, sf_dir):
    return comparing.generic_diffs(bars(spark, sf_dir))

# ---- reports

@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL, CROSS_SQL) + " SELECT s AS status, (SELECT count(*) FROM findings WHERE status = s) AS n FROM unnest(['compliant', 'non_compliant', 'missing', 'added', 'needs_review']) t(s)")
def status_counts(spark, sf_dir):
    return reporting.status_counts(_cross(spark, sf_dir))

@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL, CROSS_SQL) + """ SELECT level, type, count(*) AS total, count(*) FILTER (WHERE status = 'compliant') AS compliant, count(*) FILTER (WHERE status = 'non_compliant') AS non_compliant,
 count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'needs_review') AS needs_review FROM findings GROUP BY level, type""")
def sheet_counts(spark, sf_dir):
    return reporting.by_status(_cross(spark, sf_dir), ["level", "type"])

@query(with_tables(ELEMENTS_SQL) + " SELECT count(*) AS total, count(*) FILTER (WHERE source = 'plan') AS plan, count(*) FILTER (WHERE source = 'shop') AS shop FROM elements")
def manifest_counts(spark, sf_dir):
    return reporting.manifest(elements(spark, sf_dir))

@query(with_tables(ELEMENTS_SQL) + """ SELECT t AS type, count(e.id) AS records, count(DISTINCT CASE WHEN source = 'plan' THEN file * 100 + page END) AS plan_pages,
 count(DISTINCT CASE WHEN source = 'shop' THEN file * 100 + page END) AS shop_pages, CASE WHEN count(e.id) > 0 THEN 'covered' ELSE 'NOT COVERED' END AS state
 FROM unnest(['A', 'N', 'R', 'X']) k(t) LEFT JOIN elements e ON e.type = t GROUP BY t""")
def coverage(spark, sf_dir):
    return reporting.coverage(elements(spark, sf_dir), ("A", "N", "R", "X"))

@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL, CROSS_SQL) + ", f AS (SELECT level, min(file) AS lf FROM elements WHERE source = 'shop' GROUP BY level) SELECT id, level, COALESCE(shop_file, lf) AS file FROM findings LEFT JOIN f USING (level)")
def shop_file_assignment(spark, sf_dir):
    return reporting.shop_file_of(_cross(spark, sf_dir), elements(spark, sf_dir))

@query("SELECT c_custkey, regexp_replace(regexp_replace(c_name, '\\.[^.]*$', ''), '[^A-Za-z0-9_-]+', '_', 'g') || '_' || substr(sha1(c_name), 1, 6) AS name FROM customer")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", reporting.safe_name(F.col("c_name")).alias("name"))

@query("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all('S-' || p_partkey || '.' || p_size || p_brand, '([0-9]+|[^0-9]+)'), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN lpad(t, 12, '0') ELSE t END), '') AS sort_key FROM part")
def natural_sort_keys(spark, sf_dir):
    sheet = F.concat(F.lit("S-"), F.col("p_partkey"), F.lit("."), F.col("p_size"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", reporting.natural_key(sheet).alias("sort_key"))

@query(with_tables(ELEMENTS_SQL) + """ SELECT min(id) AS id, source, file, type, level, "row", col, "count", size, count(*) AS occurrences,
 array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM elements GROUP BY source, file, type, level, "row", col, "count", size""")
def collapse_duplicates(spark, sf_dir):
    return reporting.collapse_duplicates(elements(spark, sf_dir), ["source", "file", "type", "level", "row", "col", "count", "size"])

@query(with_tables(ELEMENTS_SQL) + """, g AS (SELECT source, file, type, level, "row", col, "count", size, count(*) AS n, min(overall) AS o, min(page) AS p0, max(page) AS p1 FROM elements GROUP BY ALL)
 SELECT source, file, type, level, "row", col, count(*) AS statements, min(o) AS overall, max(n) AS occurrences, min(p0) AS first_page, max(p1) AS last_page FROM g GROUP BY ALL""")
def cell_merge(spark, sf_dir):
    return reporting.cell_merge(elements(spark, sf_dir))

@query(with_tables(ELEMENTS_SQL) + """,
a AS (SELECT DISTINCT level, "row", col, "count", size FROM elements WHERE source = 'plan'), b AS (SELECT DISTINCT level, "row", col, "count", size FROM elements WHERE source = 'shop'),
m AS (SELECT level, "count" AS mc, size AS ms FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, "count", size) AS k FROM (SELECT level, "count", size, count(*) AS n FROM a GROUP BY ALL)) WHERE k = 1),
x AS (SELECT a.*, a."count" = mc AND a.size = ms AS typical, EXISTS (SELECT 1 FROM b WHERE b.level = a.level AND b."row" = a."row" AND b.col = a.col AND b."count" = a."count" AND b.size = a.size) AS agrees,
  EXISTS (SELECT 1 FROM b WHERE b.level = a.level AND b."row" = a."row" AND b.col - 1 = a.col AND b."count" = a."count" AND b.size = a.size) AS chance
  FROM a JOIN m USING (level) WHERE EXISTS (SELECT 1 FROM b WHERE b.level = a.level AND b."row" = a."row" AND b.col = a.col))
SELECT count(*) AS matched, round(count(*) FILTER (WHERE typical AND agrees) / nullif(count(*) FILTER (WHERE typical), 0), 4) AS typical, round(count(*) FILTER (WHERE NOT typical AND agrees) / nullif(count(*) FILTER (WHERE NOT typical), 0), 4) AS atypical, round(count(*) FILTER (WHERE chance) / nullif(count(*), 0), 4) AS chance FROM x""")
def witness_rates(spark, sf_dir):
    return reporting.witness_rates(elements(spark, sf_dir))

@query(with_tables(ELEMENTS_SQL) + """, l AS (SELECT 'L' || (l_quantity::BIGINT % 60) AS level, CASE WHEN l_quantity::BIGINT % 60 < 45 THEN 'plan' ELSE 'shop' END AS source FROM lineitem UNION ALL SELECT 'L' || (l_partkey % 40), 'shop' FROM lineitem)
 SELECT level, CASE WHEN bool_or(source = 'plan') THEN 'plan' ELSE 'shop' END AS only FROM l GROUP BY level HAVING bool_or(source = 'plan') <> bool_or(source = 'shop')""")
def level_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long") % 60
    a = rows.select(F.concat(F.lit("L"), q.cast("string")).alias("level"), F.when(q < 45, "plan").otherwise("shop").alias("source"))
    b = rows.select(F.concat(F.lit("L"), (F.col("l_partkey") % 40).cast("string")).alias("level"), F.lit("shop").alias("source"))
    return reporting.level_gaps(a.unionByName(b))

# ---- notation

_DASH = " - "

@query(with_tables(NOTES_SQL) + ", t AS (SELECT note, 'ARM ' || q || CASE WHEN note % 2 = 0 THEN '-' ELSE ' - ' END || s || ' C/C' AS x FROM notes) SELECT note, TRY_CAST(nullif(regexp_extract(x, '(?:^|[^0-9])([0-9]{1,2})\\s*-\\s*((?:10|15|20|25|30|35)M)\\b', 1), '') AS INTEGER) AS n, nullif(upper(regexp_extract(x, '(?:^|[^0-9])([0-9]{1,2})\\s*-\\s*((?:10|15|20|25|30|35)M)\\b', 2)), '') AS size FROM t")
def parse_count_size(spark, sf_dir):
    n = notes(spark, sf_dir)
    t = F.concat(F.lit("ARM "), F.col("q"), F.when(F.col("note") % 2 == 0, "-").otherwise(_DASH), F.col("s"), F.lit(" C/C"))
    count, size = text.count_size(F.col("t"))
    return n.withColumn("t", t).select("note", count.alias("n"), size.alias("size"))

# The SQL of the next four says what was printed, not how it is read: texts that vary by row, and the numbers in them.

_S_SQL = "CASE WHEN s <> '45M' THEN upper(s) END"

@query(with_tables(NOTES_SQL) + f""" SELECT note, {_S_SQL} AS size, CASE WHEN s = '45M' THEN NULL WHEN note % 4 = 0 THEN q::DOUBLE WHEN note % 4 = 1 THEN round(q * 10.0::DOUBLE, 3) WHEN note % 4 = 3 AND q >= 30 THEN q::DOUBLE ELSE round(q * 25.4::DOUBLE, 3) END AS spacing_mm FROM notes""")
def parse_size_spacing(spark, sf_dir):
    n = notes(spark, sf_dir)
    unit = F.when(F.col("note") % 4 == 0, "mm").when(F.col("note") % 4 == 1, "cm").when(F.col("note") % 4 == 2, '"').otherwise("")
    before = F.element_at(F.array(*map(F.lit, ("", "TYP @ EDGE ", "VOIR @ 3 NIVEAUX, ", "12M@4 / ", "@@ "))), (F.col("l_partkey") % 5 + 1).cast("int"))
    t = F.concat(before, "s", F.lit(" @ "), "q", unit, F.lit(" c/c"))
    return n.withColumn("t", t).select("note", text.size_spacing_of(F.col("t")).alias("s")).select("note", "s.size", "s.spacing_mm")

@query(with_tables(NOTES_SQL) + """, f AS (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE 25.4::DOUBLE END AS f FROM notes)
 SELECT note, CASE WHEN note % 6 <> 2 THEN round(q * f, 3) END AS a, CASE WHEN note % 6 <> 2 THEN round((l_partkey % 90) * f, 3) END AS b FROM f""")
def parse_section(spark, sf_dir):
    n = notes(spark, sf_dir)
    word = F.element_at(F.array(*map(F.lit, ("COL. ", "column ", "BEAM ", "SEE COLUMN SCHEDULE, COL. ", "COLUMN TYPE / col ", "PROTOCOL 9, COLUMN. A / Col."))), (F.col("note") % 6 + 1).cast("int"))
    t = F.concat(word, "q", F.when(F.col("l_orderkey") % 2 == 0, '"').otherwise(""), F.lit("x"), F.col("l_partkey") % 90, F.when(F.col("l_suppkey") % 2 == 0, "mm").otherwise('"'))
    return n.withColumn("t", t).select("note", text.section_of(F.col("t")).alias("s")).select("note", "s.a", "s.b")

@query(with_tables(NOTES_SQL) + """ SELECT note, CASE note % 6 WHEN 0 THEN round((q + 0.5) * 1000.0::DOUBLE, 3) WHEN 1 THEN q * 100.0::DOUBLE WHEN 5 THEN round(q * 304.8::DOUBLE, 3) ELSE round(q * 304.8::DOUBLE + (l_partkey % 12) * 25.4::DOUBLE, 3) END AS elevation_mm FROM notes""")
def parse_elevation(spark, sf_dir):
    n = notes(spark, sf_dir)
    inches = F.concat("q", F.lit("' - "), F.col("l_partkey") % 12, F.lit('"'))
    shapes = (F.concat(F.lit("EL. "), "q", F.lit(".5 m")), F.concat(F.lit("2 murs, "), "q", F.lit("00 mm")), inches, F.concat(F.lit("L'AXE, EL "), inches), F.concat(F.lit("HAUT D'UN MUR DE 3 m: "), inches), F.concat(F.lit("EL "), "q", F.lit("'")))
    t = F.element_at(F.array(*shapes), (F.col("note") % 6 + 1).cast("int"))
    return n.withColumn("t", t).select("note", text.elevation(F.col("t")).alias("elevation_mm"))

@query(with_tables(NOTES_SQL) + f""" SELECT note, CASE WHEN ok THEN q::INTEGER END AS n, CASE WHEN ok THEN upper(s) END AS size, CASE WHEN ok THEN 'T' || (l_partkey % 9) END AS mark,
  CASE WHEN NOT ok OR note % 2 = 1 THEN NULL WHEN l_suppkey % 40 >= 30 THEN (l_suppkey % 40)::DOUBLE ELSE round((l_suppkey % 40) * 25.4::DOUBLE, 3) END AS spacing_mm FROM (SELECT *, note % 5 > 0 AND s <> '45M' AS ok FROM notes)""")
def parse_shop_ties(spark, sf_dir):
    n = notes(spark, sf_dir)
    before = F.element_at(F.array(*map(F.lit, ("NOTE ", "TIES: ", "TIES AS SHOWN; TIES: ", "étri. ", "STIRRUP BARS 3 / ETRI:"))), (F.col("note") % 5 + 1).cast("int"))
    t = F.concat(before, "q", F.when(F.col("l_partkey") % 4 == 0, "").otherwise(" "), "s", F.lit(" T"), F.col("l_partkey") % 9, F.when(F.col("note") % 2 == 0, F.concat(F.lit(" @"), F.col("l_suppkey") % 40)).otherwise(""))
    b = n.withColumn("t", t).select("note", text.shop_bars_of(F.col("t"), text.TIE_WORDS).alias("b"))
    return b.select("note", F.col("b.count").alias("n"), "b.size", "b.mark", "b.spacing_mm")

_GRID = r"^([A-Z]{1,2}(?:\.[0-9]|'')?)-([1-9][0-9]?(?:\.[0-9])?)$"

@query(with_tables(NOTES_SQL) + f""", t AS (SELECT note, CASE WHEN note % 7 = 0 THEN 'A' ELSE '' END || chr(CAST(65 + l_suppkey % 26 AS INTEGER)) || CASE note % 4 WHEN 0 THEN '.5' WHEN 1 THEN '''' ELSE '' END || '-' || CASE WHEN note % 6 = 0 THEN '0' ELSE '' END || (l_partkey % 99) AS x FROM notes),
 p AS (SELECT note, nullif(regexp_extract(x, '{_GRID}', 1), '') AS r, TRY_CAST(nullif(regexp_extract(x, '{_GRID}', 2), '') AS DOUBLE) AS c FROM t)
 SELECT note, r AS "row", c AS col, regexp_replace(regexp_replace(r, '\\..*$', ''), '''+$', '') AS base,
  round(26 * (length(regexp_extract(r, '^([A-Z]+)', 1)) - 1) + ascii(right(regexp_extract(r, '^([A-Z]+)', 1), 1)) - 64 + COALESCE(TRY_CAST(nullif(regexp_extract(r, '\\.([0-9])', 1), '') AS DOUBLE) / 10, 0) + CASE WHEN contains(r, '''') THEN 0.05 ELSE 0 END, 3)::DOUBLE AS rank FROM p WHERE r IS NOT NULL""")
def parse_grid_label(spark, sf_dir):
    n = notes(spark, sf_dir)
    t = F.concat(F.when(F.col("note") % 7 == 0, "A").otherwise(""), F.char((65 + F.col("l_suppkey") % 26).cast("int")), F.when(F.col("note") % 4 == 0, ".5").when(F.col("note") % 4 == 1, "'").otherwise(""), F.lit("-"), F.when(F.col("note") % 6 == 0, "0").otherwise(""), F.col("l_partkey") % 99)
    r, c = text.grid_label(F.col("t"))
    out = n.withColumn("t", t).select("note", r.alias("row"), c.alias("col")).where("row is not null")
    return out.select("note", "row", "col", text.base_row(F.col("row")).alias("base"), F.round(matching.letter_rank(F.col("row")), 3).alias("rank"))

_NAMES = ("Niveau ", "LEVEL", "Rez-de-chaussée ", "SOUS-SOL", "SS-", "Toit appentis", "ROOF ", "Ground floor", "TRÉFOND", "CLOISON")

@query(with_tables(NOTES_SQL) + """, t AS (SELECT note, (['Niveau ', 'LEVEL', 'Rez-de-chaussée ', 'SOUS-SOL', 'SS-', 'Toit appentis', 'ROOF ', 'Ground floor', 'TRÉFOND', 'CLOISON'])[CAST(note % 10 + 1 AS INTEGER)] || CASE WHEN note % 10 < 5 THEN CAST(q % 12 AS VARCHAR) ELSE '' END AS x FROM notes),
 p AS (SELECT note, translate(upper(x), 'ÉÈ', 'EE') AS x FROM t)
 SELECT note, CASE WHEN regexp_matches(x, '^(?:NIVEAU|LEVEL|FLOOR|NIV)\\s*[0-9]{1,2}\\b') THEN 'N' || CAST(CAST(regexp_extract(x, '([0-9]+)', 1) AS INTEGER) AS VARCHAR)
  WHEN x LIKE 'REZ-DE-CHAUSSEE%' THEN 'RDC' WHEN x LIKE 'TOIT APPENTIS%' THEN 'TOIT_APP' WHEN x LIKE 'GROUND%' THEN 'RDC'
  WHEN x LIKE 'SOUS-SOL%' OR x LIKE 'SS%' THEN CASE WHEN TRY_CAST(nullif(regexp_extract(x, '([0-9]+)$', 1), '') AS INTEGER) > 1 THEN 'SS' || CAST(CAST(regexp_extract(x, '([0-9]+)$', 1) AS INTEGER) AS VARCHAR) ELSE 'SS' END
  WHEN x LIKE 'TREFOND%' THEN 'FDN' WHEN x LIKE 'ROOF%' THEN 'TOIT' END AS level FROM p""")
def canonical_levels(spark, sf_dir):
    n = notes(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("note") % 10 + 1).cast("int"))
    t = F.concat(name, F.when(F.col("note") % 10 < 5, (F.col("q") % 12).cast("string")).otherwise(""))
    return n.withColumn("t", t).select("note", text.canonical_level(F.col("t")).alias("level"))

@query(with_tables(NOTES_SQL) + """, t AS (SELECT note, (['1OM', 'I5M', '2OM', '2SM', '3SM', '25M', 'Z5M', 'B0M', 'X1M', '45M'])[CAST(note % 10 + 1 AS INTEGER)] AS x FROM notes), p AS (SELECT *, upper(translate(x, 'OIlSBZ', '011582')) AS f FROM t)
 SELECT note, CASE WHEN x IN ('10M','15M','20M','25M','30M','35M') THEN x WHEN f IN ('10M','15M','20M','25M','30M','35M') THEN f ELSE x END AS size FROM p""")
def snapped_sizes(spark, sf_dir):
    n = notes(spark, sf_dir)
    t = F.element_at(F.array(*map(F.lit, ("1OM", "I5M", "2OM", "2SM", "3SM", "25M", "Z5M", "B0M", "X1M", "45M"))), (F.col("note") % 10 + 1).cast("int"))
    return n.withColumn("t", t).select("note", text.snap_size(F.col("t")).alias("size"))

@query(with_tables(NOTES_SQL) + """, t AS (SELECT note, CAST(q AS DOUBLE) AS v, (['mm', 'cm', 'm', 'ft', 'in', 'xx'])[CAST(note % 6 + 1 AS INTEGER)] AS u FROM notes)
 SELECT note, round(v * CASE u WHEN 'mm' THEN 1.0::DOUBLE WHEN 'cm' THEN 10.0::DOUBLE WHEN 'm' THEN 1000.0::DOUBLE WHEN 'ft' THEN 304.8::DOUBLE WHEN 'in' THEN 25.4::DOUBLE END, 3) AS mm FROM t""")
def unit_lengths(spark, sf_dir):
    n = notes(spark, sf_dir)
    u = F.element_at(F.array(*map(F.lit, ("mm", "cm", "m", "ft", "in", "xx"))), (F.col("note") % 6 + 1).cast("int"))
    return n.select("note", text.millimetres(F.col("q").cast("double"), u).alias("mm"))

@query(with_tables(NOTES_SQL) + """ SELECT note, abs(a - b) <= greatest(5.0, 0.04::DOUBLE * greatest(abs(a), abs(b))) AS same FROM (SELECT note, CAST(q * 25 AS DOUBLE) AS a, q * 25.4::DOUBLE + l_suppkey % 7 AS b FROM notes)""")
def same_lengths(spark, sf_dir):
    n = notes(spark, sf_dir)
    return n.select("note", matching.same_length((F.col("q") * 25).cast("double"), F.col("q") * 25.4 + F.col("l_suppkey") % 7).alias("same"))

@query(with_tables(NOTES_SQL) + """, t AS (SELECT note, 1 - (l_partkey % 5) / 10.0::DOUBLE AS c, CASE WHEN note % 2 = 0 THEN 'ocr' ELSE 'native' END AS src, 0.5::DOUBLE + (q % 5) / 10.0::DOUBLE AS o, note % 3 = 0 AS sn, (['parsed', 'derived', 'missing'])[CAST(note % 3 + 1 AS INTEGER)] AS st,
   (['outline', 'label', 'mark_axis', 'text_only'])[CAST(note % 4 + 1 AS INTEGER)] AS an, CASE WHEN note % 5 = 0 THEN NULL ELSE (q % 11) / 10.0::DOUBLE END AS mg, note % 7 AS fl FROM notes),
 u AS (SELECT *, CASE WHEN st = 'missing' THEN 0.3 ELSE round(greatest(0.0, least(1.0, c * CASE WHEN src = 'ocr' THEN o ELSE 1.0::DOUBLE END * CASE WHEN sn THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN st = 'derived' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)), 3) END AS attr,
   round(1.0::DOUBLE * c * CASE an WHEN 'outline' THEN 1.0::DOUBLE WHEN 'label' THEN 0.95::DOUBLE WHEN 'mark_axis' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END * COALESCE(CASE WHEN sn THEN 0.75::DOUBLE + (1 - 0.75::DOUBLE) * mg ELSE 0.6::DOUBLE + (1 - 0.6::DOUBLE) * mg END, 1.0), 3) AS loc FROM t)
 SELECT note, attr::DOUBLE AS attribute, loc AS location, CASE WHEN fl > 0 THEN least(s, 0.69) ELSE s END::DOUBLE AS overall FROM (SELECT *, round(least(attr, loc) * greatest(0.3::DOUBLE, pow(0.85::DOUBLE, fl)), 3) AS s FROM u)""")
def quality_scores(spark, sf_dir):
    n = notes(spark, sf_dir)
    pick = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (F.col("note") % m + 1).cast("int"))
    snapped = F.col("note") % 3 == 0
    c = 1 - (F.col("l_partkey") % 5) / 10.0
    a = quality.attribute(c, F.when(F.col("note") % 2 == 0, "ocr").otherwise("native"), 0.5 + (F.col("q") % 5) / 10.0, snapped, pick(("parsed", "derived", "missing"), 3))
    margin = F.when(F.col("note") % 5 != 0, (F.col("q") % 11) / 10.0)
    loc = quality.location(F.lit(1.0), c, pick(("outline", "label", "mark_axis", "text_only"), 4), margin, snapped)
    out = n.select("note", a.alias("attribute"), loc.alias("location"))
    return out.withColumn("overall", quality.overall(F.array("attribute", "location"), F.col("note") % 7))

@query(with_tables(NOTES_SQL) + " SELECT note, round(exp(-(l_partkey % 7) / 2.0::DOUBLE) / (exp(-(l_partkey % 7) / 2.0::DOUBLE) + exp(-(l_suppkey % 5) / 2.0::DOUBLE)), 6) AS certainty FROM notes")
def rank_certainty(spark, sf_dir):
    o = F.array(F.struct(F.lit("yes").alias("option"), (-(F.col("l_partkey") % 7) / 2.0).alias("logprob")), F.struct(F.lit("no").alias("option"), (-(F.col("l_suppkey") % 5) / 2.0).alias("logprob")))
    return notes(spark, sf_dir).select("note", quality.rank_certainty(o, F.lit("yes")).alias("certainty"))

# ---- layout

@query(with_tables(WORDS_SQL) + """, m AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, line_no ORDER BY x0, k) > 12.0 THEN 1 ELSE 0 END AS nw FROM words),
 r AS (SELECT *, SUM(nw) OVER (PARTITION BY page, line_no ORDER BY x0, k ROWS UNBOUNDED PRECEDING) AS run FROM m)
 SELECT page, CAST(line_no AS INTEGER) AS line_no, CAST(run AS BIGINT) AS run, count(*) AS words, min(x0)::DOUBLE AS x0, max(x1)::DOUBLE AS x1, min(y0)::DOUBLE AS y0, max(y1)::DOUBLE AS y1, string_agg(text, ' ' ORDER BY x0, k) AS text FROM r GROUP BY ALL""")
def text_runs(spark, sf_dir):
    return layout.runs(words(spark, sf_dir), 12.0)

@query(with_tables(WORDS_SQL) + " SELECT page, COALESCE(median(CASE WHEN length(text) >= 2 THEN y1 - y0 END), 8.0)::DOUBLE AS height FROM words GROUP BY page")
def word_heights(spark, sf_dir):
    return layout.word_height(words(spark, sf_dir))

CALIBRATION_SQL = """
h AS (SELECT page, COALESCE(median(CASE WHEN length(text) >= 2 THEN y1 - y0 END), 8.0)::DOUBLE AS height FROM words GROUP BY page),
l AS (SELECT DISTINCT page, y0 FROM words), d AS (SELECT page, y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0) AS gap FROM l), g AS (SELECT page, median(gap)::DOUBLE AS gap FROM d WHERE gap > 0 GROUP BY page)"""

@query(with_tables(WORDS_SQL, CALIBRATION_SQL) + """ SELECT page, greatest(4.0, least(40.0, 1.6::DOUBLE * height))::DOUBLE AS run_gap, greatest(2.0, least(20.0, 0.5::DOUBLE * height))::DOUBLE AS align, greatest(5.0, least(100.0, 0.25::DOUBLE * COALESCE(gap, 10 * height)))::DOUBLE AS snap FROM h LEFT JOIN g USING (page)""")
def page_calibration(spark, sf_dir):
    w = words(spark, sf_dir)
    return layout.calibration(layout.word_height(w), layout.neighbour_gap(w.select("page", "y0").distinct(), ["page"], "y0"))

@query(with_tables(WORDS_SQL) + " SELECT page, round(COALESCE(avg(CASE WHEN length(text) >= 3 THEN CASE WHEN y1 - y0 > 1.5 * (x1 - x0) THEN 1.0 ELSE 0.0 END END), 0), 4)::DOUBLE AS vertical FROM words GROUP BY page")
def vertical_words(spark, sf_dir):
    return layout.vertical_share(words(spark, sf_dir))

@query("SELECT page_id, CASE WHEN w >= 150 THEN 'text' WHEN i > 0 AND p < 3000 THEN 'image' WHEN p >= 300 THEN 'vector' ELSE 'empty' END AS layer FROM (SELECT page_id, length(html) // 50 AS w, page_id % 3 AS i, (page_id * 37) % 5000 AS p FROM pages)")
def page_layers(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", layout.page_layer(F.floor(F.length("html") / 50), (F.col("page_id") * 37) % 5000, F.col("page_id") % 3).alias("layer"))

@query("""WITH pt AS (SELECT c_custkey AS point, (c_custkey * 7919) % 100000 / 10.0 AS v FROM customer), ln AS (SELECT s_suppkey AS label, (s_suppkey * 104729) % 100000 / 10.0 AS pos FROM supplier),
 d AS (SELECT point, label, abs(v - pos) AS d FROM pt JOIN ln ON abs(v - pos) <= 120.0), r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d, label) AS k FROM d)
 SELECT a.point, a.label, round(a.d, 3)::DOUBLE AS distance, CASE WHEN b.d IS NULL THEN 1.0 WHEN b.d = 0 THEN 0.0 ELSE round((b.d - a.d) / b.d, 3) END::DOUBLE AS margin FROM (SELECT * FROM r WHERE k = 1) a LEFT JOIN (SELECT * FROM r WHERE k = 2) b USING (point)""")
def nearest_gridline(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point"), ((F.col("c_custkey") * 7919) % 100000 / 10.0).alias("v"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("label"), ((F.col("s_suppkey") * 104729) % 100000 / 10.0).alias("pos"))
    return layout.nearest_line(p, s, 120.0)

@query(with_tables(LEVELS_SQL) + ", pt AS (SELECT c_custkey AS point, ((c_custkey * 7919) % 16000 - 1500)::DOUBLE AS v FROM customer) SELECT point, COALESCE((SELECT max_by(level, (elevation_mm, level)) FROM levels WHERE elevation_mm <= v), 'FDN') AS level FROM pt")
def level_bands(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point"), ((F.col("c_custkey") * 7919) % 16000 - 1500).cast("double").alias("v"))
    return layout.level_band(p, levels(spark, sf_dir))

@query("""WITH pt AS (SELECT c_custkey AS point, c_nationkey AS page, ((c_custkey * 31) % 1000)::DOUBLE AS x, ((c_custkey * 77) % 700)::DOUBLE AS y FROM customer), tt AS (SELECT s_nationkey AS page, s_name AS title, ((s_suppkey * 53) % 1000)::DOUBLE AS tx, ((s_suppkey * 91) % 700)::DOUBLE AS ty FROM supplier)
 SELECT point, title FROM (SELECT point, title, row_number() OVER (PARTITION BY point ORDER BY ty < y, pow(tx - x, 2) + pow(ty - y, 2), title) AS k FROM pt JOIN tt USING (page)) WHERE k = 1""")
def nearest_titles(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point"), F.col("c_nationkey").alias("page"), ((F.col("c_custkey") * 31) % 1000).cast("double").alias("x"), ((F.col("c_custkey") * 77) % 700).cast("double").alias("y"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_name").alias("title"), ((F.col("s_suppkey") * 53) % 1000).cast("double").alias("x"), ((F.col("s_suppkey") * 91) % 700).cast("double").alias("y"))
    return layout.nearest_title(p, s)

# ---- cost model

ENTITY_SQL = """
bar AS (SELECT *, {'size': size, 'count': "count", 'spacing_mm': spacing_mm} AS b FROM elements),
l AS (SELECT id AS note, "row", col, level, type AS kind, [b] AS bars FROM bar WHERE source = 'plan'),
r AS (SELECT id AS slot, "row", col, level, NULL AS level_to, type AS kind, [b] AS bars FROM bar WHERE source = 'shop'),
pr AS (SELECT l.note, r.slot, l.level AS ll, r.level AS rl, l.kind AS lk, r.kind AS rk, l."row" AS lr, r."row" AS rr, l.col AS lc, r.col AS rc, l.bars[1] AS x, r.bars[1] AS y FROM l JOIN r ON l."row" = r."row" AND l.col = r.col
  UNION ALL SELECT l.note, r.slot, l.level, r.level, l.kind, r.kind, l."row", r."row", l.col, r.col, l.bars[1], r.bars[1] FROM l JOIN r ON l."row" = r."row" AND abs(l.col - r.col) < 4.0  -- 4 columns apart cost 1.95 at least
   WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q."row" = l."row" AND q.col = l.col)),
sh AS (SELECT *, (CASE WHEN x.size = y.size THEN 1 ELSE 0 END + CASE WHEN x."count" = y."count" THEN 1 ELSE 0 END + CASE WHEN abs(x.spacing_mm - y.spacing_mm) <= greatest(5.0, 0.04::DOUBLE * greatest(x.spacing_mm, y.spacing_mm)) THEN 1 ELSE 0 END)
  / (CASE WHEN x.size IS NOT NULL AND y.size IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN x."count" IS NOT NULL AND y."count" IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN x.spacing_mm IS NOT NULL AND y.spacing_mm IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE AS share FROM pr),
cs AS (SELECT note, slot, round(CASE WHEN lc = rc THEN 0.0::DOUBLE WHEN abs(lc - rc) <= 1.0 THEN 1.2::DOUBLE ELSE 2.0::DOUBLE END + CASE WHEN ll = rl THEN 0.0::DOUBLE ELSE 1000.0::DOUBLE END + CASE WHEN lk = rk THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END
  + CASE WHEN share = 0 THEN 1.7::DOUBLE ELSE round(0.15::DOUBLE - 0.5::DOUBLE * share, 3) END + 0.15::DOUBLE * least(0.5::DOUBLE * abs(lc - rc), 2.0::DOUBLE), 3) AS cost FROM sh),
candidates AS (SELECT * FROM (SELECT note, slot, cost, row_number() OVER (PARTITION BY note ORDER BY cost, slot) AS place FROM cs WHERE cost < 1.8) WHERE place <= 3)"""

def _candidates(spark, sf_dir, more=False):
    e = elements(spark, sf_dir).withColumn("bars", F.array(F.struct("size", "count", "spacing_mm")))
    left = e.where("source = 'plan'").select(F.col("id").alias("note"), "row", "col", "level", F.col("type").alias("kind"), "bars")
    right = e.where("source = 'shop'").select(F.col("id").alias("slot"), "row", "col", "level", F.lit(None).cast("string").alias("level_to"), F.col("type").alias("kind"), "bars")
    return matching.candidates(left, right, more=more)

@query(with_tables(ELEMENTS_SQL, ENTITY_SQL) + " SELECT note, slot, cost, CAST(place AS INTEGER) AS place FROM candidates")
def candidate_pairs(spark, sf_dir):
    return _candidates(spark, sf_dir)

@query(with_tables(ELEMENTS_SQL) + """, g AS (SELECT "row" || '-' || regexp_replace(CAST(col AS VARCHAR), '\\.0$', '') AS cell, level, type AS kind, count(*) AS members, min(id) AS note FROM elements WHERE source = 'plan' GROUP BY ALL)
 SELECT format('P{:07d}', row_number() OVER (ORDER BY cell, level, kind)) AS id, cell, level, kind, members, note FROM g""")
def entities(spark, sf_dir):
    e = elements(spark, sf_dir).where("source = 'plan'")
    n = e.select("id", F.concat_ws("-", "row", F.regexp_replace(F.col("col").cast("string"), r"\.0$", "")).alias("cell"), "level", F.col("type").alias("kind"), F.array(F.struct("size", "count")).alias("bars"))
    return matching.numbered(matching.entities(n), "id", "P%07d", "cell", "level", "kind").select("id", "cell", "level", "kind", "members", "note")

@query(with_tables(ELEMENTS_SQL) + """, k AS (SELECT l_orderkey AS element, l_linenumber % 3 AS note, l_returnflag || '-' || (l_quantity::BIGINT % 4) AS key FROM lineitem), c AS (SELECT element, note, key, count(*) AS n FROM k GROUP BY ALL)
 SELECT element, key, max(n) AS n FROM c GROUP BY element, key""")
def combined_statements(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element"), (F.col("l_linenumber") % 3).alias("note"), F.concat_ws("-", "l_returnflag", (F.col("l_quantity").cast("long") % 4).cast("string")).alias("key"))
    return comparing.combined_statements(k)

@query("""WITH c AS (SELECT DISTINCT l_orderkey AS element, (['spacing', 'count', 'size', 'type', 'other'])[CAST(l_partkey % 5 + 1 AS INTEGER)] AS property, l_suppkey % 3 AS plan, l_linenumber % 2 AS shop FROM lineitem)
 SELECT element, CAST(SUM(CASE WHEN property IN ('spacing', 'secondary', 'type') THEN 2 WHEN property IN ('count', 'size', 'section') THEN 1 ELSE 0 END) AS BIGINT) AS weight FROM c GROUP BY element""")
def evidence_weight(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem")
    p = F.element_at(F.array(*map(F.lit, ("spacing", "count", "size", "type", "other"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return comparing.evidence_weight(r.select(F.col("l_orderkey").alias("element"), p.alias("property"), (F.col("l_suppkey") % 3).alias("plan"), (F.col("l_linenumber") % 2).alias("shop")))

@query("""WITH f AS (SELECT l_orderkey AS record, l_returnflag AS kind, CASE WHEN l_partkey % 2 = 0 THEN 'count' ELSE 'size' END AS property, l_quantity::BIGINT % 20 AS plan, l_suppkey % 25 AS shop FROM lineitem),
 c AS (SELECT record, kind, property, CASE WHEN property = 'count' AND (abs(2 * plan - shop) <= 1 OR abs(2 * shop - plan) <= 1) THEN 'half or double' ELSE plan || '>' || shop END AS class FROM f),
 g AS (SELECT kind, property, class, count(DISTINCT record) AS n FROM c GROUP BY ALL HAVING count(DISTINCT record) >= 3) SELECT *, 'G' || row_number() OVER (ORDER BY n DESC, kind, property, class) AS name FROM g""")
def systematic_groups(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem")
    f = r.select(F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_partkey") % 2 == 0, "count").otherwise("size").alias("property"), (F.col("l_quantity").cast("long") % 20).alias("plan"), (F.col("l_suppkey") % 25).alias("shop"))
    return comparing.systematic_groups(f)

# ---- arrival and progress

@query("""SELECT user_id, event_type, count(*) AS events, min(event_id) AS opened, max(event_id) AS closed, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY ALL""")
def progress_fold(spark, sf_dir):
    from matchyard.streaming.arrival import fold

    return fold(table(spark, sf_dir, "events"))

@query("""WITH p AS (SELECT DISTINCT l_orderkey AS file, l_linenumber AS page FROM lineitem), e AS (SELECT o_orderkey AS file, 1 + o_orderkey % 5 AS expected FROM orders)
 SELECT file, expected, count(page) AS arrived, count(page) >= expected AS complete FROM e LEFT JOIN p USING (file) GROUP BY file, expected""")
def arrival_complete(spark, sf_dir):
    from matchyard.streaming.arrival import complete

    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("page"))
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), (1 + F.col("o_orderkey") % 5).alias("expected"))
    return complete(pages, expected)

@query("""WITH n AS (SELECT c_custkey AS path, sha1(c_name || (c_custkey % 3)) AS digest, 'v2' AS version FROM customer), o AS (SELECT c_custkey AS path, sha1(c_name || (c_custkey % 2)) AS digest, CASE WHEN c_custkey % 10 = 0 THEN 'v1' ELSE 'v2' END AS version FROM customer WHERE c_custkey % 4 <> 0)
 SELECT n.path, CASE WHEN o.path IS NULL THEN 'new' WHEN o.digest = n.digest AND o.version = n.version THEN 'cached' ELSE 'changed' END AS state FROM n LEFT JOIN o USING (path)""")
def cache_status(spark, sf_dir):
    from matchyard.streaming.arrival import cache_state

    c = table(spark, sf_dir, "customer")
    digest = lambda m: F.sha1(F.concat("c_name", (F.col("c_custkey") % m).cast("string")))
    new = c.select(F.col("c_custkey").alias("path"), digest(3).alias("digest"), F.lit("v2").alias("version"))
    old = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("path"), digest(2).alias("digest"), F.when(F.col("c_custkey") % 10 == 0, "v1").otherwise("v2").alias("version"))
    return cache_state(new, old)

# ---- notes


def _lines(spark, sf_dir):
    n = notes(spark, sf_dir)
    label = F.when(F.col("note") % 3 == 0, "ARM: ").when(F.col("note") % 3 == 1, "TIES. ").otherwise("")
    body = F.when(F.col("note") % 4 == 0, F.concat("q", F.lit("-"), "s")).when(F.col("note") % 4 == 1, F.concat("s", F.lit(" @ "), "q", F.lit("mm c/c"))).when(F.col("note") % 4 == 2, F.concat("q", F.lit(" "), "s", F.lit(" B7-01"))).otherwise(F.concat("q", F.lit("("), F.col("l_partkey") % 9, F.lit(")-"), "s", F.lit(" 400x600mm 35 MPa")))
    return n.select("note", F.concat(label, body).alias("text"))


@query(with_tables(NOTES_SQL) + """ SELECT note, CASE note % 3 WHEN 0 THEN 'ARM' WHEN 1 THEN 'TIES' END AS label, CASE note % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'ties' END AS role, upper(s) AS size,
 CASE WHEN note % 4 = 1 THEN NULL ELSE q END::INTEGER AS n, CASE WHEN note % 4 = 3 THEN l_partkey % 9 END::INTEGER AS secondary, CASE WHEN note % 4 = 1 THEN q END::DOUBLE AS spacing_mm, CASE WHEN note % 4 = 2 THEN 'B7-01' END AS mark,
 CASE WHEN note % 4 = 3 THEN 400.0 END::DOUBLE AS section_a, CASE WHEN note % 4 = 3 THEN 35 END AS strength, '' AS rest FROM notes""")
def parsed_lines(spark, sf_dir):
    from matchyard.functions.freeform import read_lines

    b = F.get("bars", F.lit(0))
    return read_lines(_lines(spark, sf_dir)).select("note", "label", b["role_hint"].alias("role"), b["size"].alias("size"), b["count"].alias("n"), b["secondary_count"].alias("secondary"), b["spacing_mm"].alias("spacing_mm"), b["mark"].alias("mark"), F.get("section", F.lit(0)).alias("section_a"), "strength", "rest")


@query()
def compared_notes(spark, sf_dir):
    from matchyard.operators.bars import compare_notes

    b = bars(spark, sf_dir).select("element", "source", F.struct(F.lit(None).cast("string").alias("role_hint"), "count", F.lit(None).cast("int").alias("secondary_count"), F.lit(None).cast("int").alias("groups"), "size", "spacing_mm").alias("bar"))
    one = lambda side: F.sort_array(F.collect_list(F.when(F.col("source") == side, F.col("bar")))).alias(f"{side}_bars")
    pairs = b.groupBy(F.col("element").alias("id")).agg(one("plan"), one("shop"))
    return compare_notes(pairs).select("id", "status", F.size("records").alias("records"), F.array_join(F.array_sort(F.array_distinct("records.result")), ",").alias("results"))


@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL) + """, a AS (SELECT p.id, level, type, ascii("row") - 64 AS r, col AS c FROM p WHERE key NOT IN (SELECT key FROM s)), b AS (SELECT s.id, level, type, ascii("row") - 64 AS r, col AS c FROM s WHERE key NOT IN (SELECT key FROM p)),
 n AS (SELECT a.id AS plan_id, b.id AS shop_id, round(0.4::DOUBLE * (abs(a.r - b.r) + 0.5::DOUBLE * abs(a.c - b.c)), 3) AS cost FROM a JOIN b ON a.level = b.level AND a.type = b.type AND abs(a.r - b.r) <= 1.3 AND abs(a.c - b.c) <= 2.2)
 SELECT plan_id, shop_id, cost FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY cost, shop_id) AS k FROM n WHERE cost < 1.7) WHERE k = 1""")
def second_pass(spark, sf_dir):
    from matchyard.operators.bars import second_pass as relaxed

    plan, shop = matching.lone(elements(spark, sf_dir), *matching.KEY)
    shape = lambda d, x: d.select(F.col(f"{x}_id").alias("id"), F.col(f"{x}_level").alias("level"), F.col(f"{x}_type").alias("kind"), matching.letter_rank(F.col(f"{x}_row")).alias("r"), F.col(f"{x}_col").alias("c"))
    return relaxed(shape(plan, "plan"), shape(shop, "shop"))


@query(with_tables(ELEMENTS_SQL, ENTITY_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT DISTINCT a.note AS x, b.note AS y FROM candidates a JOIN candidates b USING (slot)),
 reach AS (SELECT DISTINCT note AS x, note AS y FROM candidates UNION SELECT r.x, w.y FROM reach r JOIN w ON r.y = w.x) SELECT x AS note, min(y) AS component FROM reach GROUP BY x""")
def candidate_components(spark, sf_dir):
    from matchyard.operators.graph import components

    return components(_candidates(spark, sf_dir, more=True), "note", "slot", near=("row", "stretch"))


@query()
def cost_assignment(spark, sf_dir):
    from matchyard.operators.graph import labelled

    edges = _candidates(spark, sf_dir, more=True).select("note", "slot", "cost", "row", "stretch")
    return matching.solved(labelled(edges, "note", "slot", near=("row", "stretch"))).select("note", "slot", "cost")


@query("""WITH k AS (SELECT o_orderkey, o_orderstatus || '|' || o_custkey AS key FROM orders), d AS (SELECT o_orderkey, sha1(unhex('6f1d2c3e00004000800000000000a2c1') || encode(key)) AS h FROM k),
 u AS (SELECT o_orderkey, substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1)) AS BIGINT) % 4, 1) || substr(h, 18, 15) AS u FROM d)
 SELECT o_orderkey, u AS guid FROM u""")
def global_guids(spark, sf_dir):
    from matchyard.functions.ids import uuid5

    return table(spark, sf_dir, "orders").select("o_orderkey", uuid5(F.concat("o_orderstatus", F.lit("|"), F.col("o_custkey").cast("string"))).alias("guid"))


# ---- sheets, boxes and evaluation

BOXES_SQL = """
boxes AS (SELECT c_custkey AS id, c_nationkey AS page, ((c_custkey * 37) % 900)::DOUBLE AS x0, ((c_custkey * 53) % 600)::DOUBLE AS y0, ((c_custkey * 37) % 900 + 20 + c_custkey % 40)::DOUBLE AS x1, ((c_custkey * 53) % 600 + 10 + c_custkey % 30)::DOUBLE AS y1 FROM customer)"""


def _boxes(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("page"), ((k * 37) % 900).cast("double").alias("x0"), ((k * 53) % 600).cast("double").alias("y0"), ((k * 37) % 900 + 20 + k % 40).cast("double").alias("x1"), ((k * 53) % 600 + 10 + k % 30).cast("double").alias("y1"))


@query(with_tables(BOXES_SQL) + """, p AS (SELECT a.id AS a, b.id AS b, greatest(0.0, b.x0 - a.x1, a.x0 - b.x1) AS dx, greatest(0.0, b.y0 - a.y1, a.y0 - b.y1) AS dy, greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s,
 (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM boxes a JOIN boxes b ON a.page = b.page AND a.id < b.id)
 SELECT a, b, round(sqrt(dx * dx + dy * dy), 3)::DOUBLE AS gap, round(s / (sa + sb - s), 4)::DOUBLE AS overlap, round(s / sa, 4)::DOUBLE AS inside FROM p WHERE sqrt(dx * dx + dy * dy) <= 50.0""")
def box_relations(spark, sf_dir):
    from matchyard.operators import geometry as g

    p = g.near_boxes(_boxes(spark, sf_dir), 50.0)
    return p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(g.gap("a_", "b_"), 3).alias("gap"), F.round(g.overlap("a_", "b_"), 4).alias("overlap"), F.round(g.inside_share("a_", "b_"), 4).alias("inside"))


@query(with_tables(BOXES_SQL) + ", pt AS (SELECT o_orderkey AS point, o_custkey % 25 AS page, ((o_orderkey * 29) % 950)::DOUBLE AS x, ((o_orderkey * 61) % 650)::DOUBLE AS y FROM orders) SELECT point, page, x, y FROM pt WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.page = pt.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)")
def points_in_regions(spark, sf_dir):
    from matchyard.operators import geometry as g

    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(k.alias("point"), (F.col("o_custkey") % 25).alias("page"), ((k * 29) % 950).cast("double").alias("x"), ((k * 61) % 650).cast("double").alias("y"))
    return g.in_regions(p, _boxes(spark, sf_dir))


@query("""WITH t AS (SELECT s_suppkey AS tab, s_nationkey AS page, list_transform(range(0, 5), lambda i: ((s_suppkey * 13) % 200 + i * (40 + s_suppkey % 60))::DOUBLE) AS xs, list_transform(range(0, 4), lambda i: ((s_suppkey * 17) % 200 + i * (30 + s_suppkey % 50))::DOUBLE) AS ys FROM supplier),
 pt AS (SELECT c_custkey AS point, c_nationkey AS page, ((c_custkey * 31) % 400)::DOUBLE AS x, ((c_custkey * 77) % 400)::DOUBLE AS y FROM customer),
 h AS (SELECT point, tab, (xs[5] - xs[1]) * (ys[4] - ys[1]) AS size, greatest(0, least(2, len(list_filter(ys, lambda v: v <= y)) - 1)) AS r, greatest(0, least(3, len(list_filter(xs, lambda v: v <= x)) - 1)) AS c FROM pt JOIN t USING (page) WHERE x BETWEEN xs[1] AND xs[5] AND y BETWEEN ys[1] AND ys[4])
 SELECT point, tab AS "table", CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY size, tab) AS k FROM h) WHERE k = 1""")
def words_in_tables(spark, sf_dir):
    from matchyard.operators import geometry as g

    k = F.col("s_suppkey")
    edges = lambda n, m, a, b: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: ((k * m) % 200 + i * (a + k % b)).cast("double"))
    t = table(spark, sf_dir, "supplier").select(k.alias("table"), F.col("s_nationkey").alias("page"), edges(4, 13, 40, 60).alias("xs"), edges(3, 17, 30, 50).alias("ys"))
    c = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(c.alias("point"), F.col("c_nationkey").alias("page"), ((c * 31) % 400).cast("double").alias("x"), ((c * 77) % 400).cast("double").alias("y"))
    return g.table_cells(p, t)


@query("""WITH h AS (SELECT c_custkey AS h, c_nationkey AS page, ((c_custkey * 31) % 400)::DOUBLE AS x0, ((c_custkey * 31) % 400 + 60 + c_custkey % 200)::DOUBLE AS x1, ((c_custkey * 77) % 400)::DOUBLE AS y FROM customer), v AS (SELECT s_suppkey AS v, s_nationkey AS page, ((s_suppkey * 19) % 400)::DOUBLE AS y0, ((s_suppkey * 19) % 400 + 150)::DOUBLE AS y1, ((s_suppkey * 43) % 500)::DOUBLE AS x FROM supplier)
 SELECT page, h, v FROM h JOIN v USING (page) WHERE x BETWEEN x0 - 2.0 AND x1 + 2.0 AND y BETWEEN y0 - 2.0 AND y1 + 2.0""")
def line_crossings(spark, sf_dir):
    from matchyard.operators import geometry as g

    c, k = F.col("c_custkey"), F.col("s_suppkey")
    h = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), c.alias("h"), ((c * 31) % 400).cast("double").alias("x0"), ((c * 31) % 400 + 60 + c % 200).cast("double").alias("x1"), ((c * 77) % 400).cast("double").alias("y"))
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), k.alias("v"), ((k * 19) % 400).cast("double").alias("y0"), ((k * 19) % 400 + 150).cast("double").alias("y1"), ((k * 43) % 500).cast("double").alias("x"))
    return g.crossings(h, v, 2.0)


@query(with_tables(BOXES_SQL) + """, w AS (SELECT page, 'S-' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') AS text, x0, y0, id FROM boxes)
 SELECT page, text AS sheet FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round(y0) DESC, x0 DESC, text DESC) AS k FROM w WHERE x0 > 540.0 AND y0 > 420.0) WHERE k = 1""")
def sheet_numbers(spark, sf_dir):
    from matchyard.functions import sheets

    b = _boxes(spark, sf_dir).select("page", F.concat(F.lit("S-"), F.lpad((F.col("id") % 1000).cast("string"), 3, "0")).alias("text"), "x0", "y0", F.lit(900.0).alias("width"), F.lit(600.0).alias("height"))
    return sheets.sheet_number(b)


_TITLES = ("Plan des colonnes", "Détails des semelles", "Murs de refend et dalle", "Beam schedule", "Coupe A-A", "Dalle - poutre", "Élévation")


@query("""WITH t AS (SELECT p_partkey, 'PROJET X DRAWING TITLE ' || (['Plan des colonnes', 'Détails des semelles', 'Murs de refend et dalle', 'Beam schedule', 'Coupe A-A', 'Dalle - poutre', 'Élévation'])[CAST(p_partkey % 7 + 1 AS INTEGER)] AS x, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'S-' || (p_size % 9) || '01' END AS sh FROM part),
 q AS (SELECT p_partkey, substr(translate(upper(x), 'ÀÂÄÇÉÈÊËÎÏÔÖÙÛÜ', 'AAACEEEEIIOOUUU'), 23) AS t, TRY_CAST(nullif(regexp_extract(COALESCE(sh, ''), '([0-9])[0-9][0-9]', 1), '') AS INTEGER) AS d FROM t),
 w AS (SELECT p_partkey, d, (SELECT k FROM (VALUES ('RADIER','fondation'),('FONDATION','fondation'),('SEMELLE','fondation'),('FOUNDATION','fondation'),('FOOTING','fondation'),('POUTRE','poutre'),('BEAM','poutre'),('REFEND','mur_refend'),('CONTREVENTEMENT','mur_refend'),('MURS','mur_refend'),('WALL','mur_refend'),('DALLE','dalle'),('SLAB','dalle'),('ARMATURE DU NIVEAU','dalle'),('COLONNE','colonne'),('COLUMN','colonne')) v(w, k) WHERE instr(t, w) > 0 ORDER BY instr(t, w), k LIMIT 1) AS bw FROM q),
 s AS (SELECT *, CASE d WHEN 1 THEN 'fondation' WHEN 3 THEN 'poutre' WHEN 4 THEN 'mur_refend' WHEN 5 THEN 'colonne' WHEN 6 THEN 'dalle' END AS bs FROM w)
 SELECT p_partkey, COALESCE(bw, bs) AS type, CASE WHEN bw IS NOT NULL THEN 1.0 WHEN bs IS NOT NULL THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM s""")
def sheet_types(spark, sf_dir):
    from matchyard.functions import sheets

    t = F.concat(F.lit("PROJET X DRAWING TITLE "), F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % 7 + 1).cast("int")))
    sheet = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("S-"), (F.col("p_size") % 9).cast("string"), F.lit("01")))
    found = sheets.sheet_type_of(sheets.title(F.col("t")), F.col("sheet"))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"), sheet.alias("sheet")).select("p_partkey", found.alias("f")).select("p_partkey", "f.type", "f.confidence")


@query("""SELECT page_id, CASE WHEN w < 10 AND l IN ('vector', 'image') THEN 'needs_ocr' WHEN w < 10 THEN 'empty_page' WHEN v > 0.5 THEN 'rotated_text_unsupported' WHEN lv IS NULL THEN 'not_a_column_plan' WHEN NOT g THEN 'plan_blocks_without_grid' ELSE 'plan_outline' END AS reading
 FROM (SELECT page_id, page_id * 7 % 60 AS w, (['text', 'vector', 'image', 'empty'])[CAST(page_id % 4 + 1 AS INTEGER)] AS l, (page_id * 11 % 100) / 100.0 AS v, CASE WHEN page_id % 5 > 0 THEN 'N2' END AS lv, page_id % 3 > 0 AS g FROM pages)""")
def plan_readings(spark, sf_dir):
    from matchyard.functions import sheets

    k = F.col("page_id")
    layer = F.element_at(F.array(*map(F.lit, ("text", "vector", "image", "empty"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", sheets.plan_reading(k * 7 % 60, layer, (k * 11 % 100) / 100.0, F.when(k % 5 > 0, "N2"), k % 3 > 0).alias("reading"))


@query("""SELECT p_partkey, (['N4', 'RDC', 'FDN', 'SS2', NULL, 'TOIT'])[CAST(p_partkey % 6 + 1 AS INTEGER)] AS level FROM part""")
def levels_in_text(spark, sf_dir):
    from matchyard.functions import sheets

    said = ("Colonnes du niveau 4, axe B", "Vue du rez-de-chaussée", "Radier au tréfond", "Voir sous-sol S2 et toit", "Coupe type", "Plan du toit")
    t = F.element_at(F.array(*map(F.lit, said)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sheets.level_anywhere(t).alias("level"))


@query()
def planted_recall(spark, sf_dir):
    from matchyard.operators import evaluate

    e = elements(spark, sf_dir)
    changed = evaluate.plant(e, 0.05, 7)
    pairs = matching.full_outer(changed.drop("planted"))
    best = pairs.where("shop_id is not null").select(F.col("shop_id").alias("id"))
    verdicts = evaluate.judge(changed.join(best, "id", "left_semi"), comparing.cross(pairs, e))
    return evaluate.recall(verdicts)


@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL, CROSS_SQL) + """, places AS (SELECT DISTINCT level, "row" || '-' || regexp_replace(CAST(col AS VARCHAR), '\\.0$', '') AS grid FROM elements)
 SELECT k.level, k.grid, EXISTS (SELECT 1 FROM findings f WHERE f.level = k.level AND f.grid = k.grid AND f.status IN ('non_compliant', 'missing', 'added')) AS found FROM places k""")
def known_items(spark, sf_dir):
    from matchyard.operators import evaluate

    k = elements(spark, sf_dir).select("level", F.concat_ws("-", "row", F.regexp_replace(F.col("col").cast("string"), r"\.0$", "")).alias("grid")).distinct()
    return evaluate.known_items(k, _cross(spark, sf_dir))


@query(with_tables(ELEMENTS_SQL) + """ SELECT source, type, count(*) AS records, round(avg(CASE WHEN spacing_mm IS NOT NULL THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS parsed, round(avg(CASE WHEN overall >= 0.7 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS trusted FROM elements GROUP BY source, type""")
def extraction_shares(spark, sf_dir):
    from matchyard.operators import evaluate

    return evaluate.shares(elements(spark, sf_dir), ["source", "type"], {"parsed": F.col("spacing_mm").isNotNull(), "trusted": F.col("overall") >= 0.7})


@query("""WITH e AS (SELECT o_custkey AS id, 'd/f' || (o_orderkey % 3) || '.pdf' AS file, o_orderkey AS page FROM orders), f AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN replace(regexp_replace(file, '\\.[^./]*$', ''), '/', '_') || '__' || id ELSE CAST(id AS VARCHAR) END AS i FROM e),
 g AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY page) AS k FROM f) SELECT page, CASE WHEN k = 1 THEN i ELSE i || '_' || k END AS unique_id FROM g""")
def unique_ids(spark, sf_dir):
    from matchyard.operators import evaluate

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.concat(F.lit("d/f"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".pdf")).alias("file"), F.col("o_orderkey").alias("page"), F.lit("plan").alias("source"), F.lit("N1").alias("level"), F.lit(1.0).alias("overall"))
    return evaluate.unique_ids(o).select("page", "unique_id")


# ---- grid

AXIS_SQL = """
axis AS (SELECT n_regionkey AS page, n_nationkey AS label, ((n_nationkey * 41) % 97 * 10)::DOUBLE AS pos FROM nation),
pts AS (SELECT c_custkey AS point, c_nationkey % 5 AS page, ((c_custkey * 7919) % 9700 / 10.0)::DOUBLE AS v FROM customer)"""


@query(with_tables(AXIS_SQL) + """, lo AS (SELECT point, max_by(label, (pos, label)) AS l, max(pos) AS lp FROM pts JOIN axis USING (page) WHERE pos <= v GROUP BY point), hi AS (SELECT point, min_by(label, (pos, label)) AS h, min(pos) AS hp FROM pts JOIN axis USING (page) WHERE pos > v GROUP BY point),
 f AS (SELECT point, v, l, h, lp, hp, round((v - lp) / (hp - lp), 3) AS fr FROM pts LEFT JOIN lo USING (point) LEFT JOIN hi USING (point) WHERE l IS NOT NULL OR h IS NOT NULL),
 g AS (SELECT *, CASE WHEN l IS NULL THEN h WHEN h IS NULL THEN l WHEN v - lp < hp - v OR (v - lp = hp - v AND l < h) THEN l ELSE h END AS nearest FROM f)
 SELECT point, nearest, fr::DOUBLE AS fraction, CASE WHEN fr BETWEEN 0.2 AND 0.8 THEN CASE WHEN nearest = h THEN l ELSE h END END AS other FROM g""")
def axis_positions(spark, sf_dir):
    from matchyard.operators import grid

    k = F.col("n_nationkey")
    axis = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), k.alias("label"), ((k * 41) % 97 * 10).cast("double").alias("pos"))
    c = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(c.alias("point"), (F.col("c_nationkey") % 5).alias("page"), ((c * 7919) % 9700 / 10.0).alias("v"))
    return grid.around(points, axis).select("point", "nearest", "fraction", "other")


@query()
def grids_of_pages(spark, sf_dir):
    from matchyard.operators import grid

    k = F.col("s_suppkey")
    letters = table(spark, sf_dir, "supplier").select((k % 2).alias("page"), F.char((65 + F.floor(k / 2) % 12).cast("int")).alias("text"), F.lit(20.0).alias("cx"), (F.floor(k / 2) % 12 * 40.0).alias("cy"))
    numbers = letters.select("page", (F.floor(F.col("cy") / 40) + 1).cast("int").cast("string").alias("text"), (F.col("cy") + 60.0).alias("cx"), F.lit(5.0).alias("cy"))
    return grid.fit(letters.unionByName(numbers), 8.0)


@query()
def elevation_views(spark, sf_dir):
    from matchyard.operators import grid

    lines = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("page"), F.col("o_orderkey").cast("double").alias("y"), F.concat(F.lit("N"), (F.col("o_orderkey") % 9).cast("string")).alias("level"), F.when(F.col("o_orderkey") % 4 > 0, (10_000 - F.col("o_orderkey") % 900).cast("double")).alias("elevation_mm"))
    return grid.views(lines)
