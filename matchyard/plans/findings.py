"""Registered queries of what comes after matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchyard.functions import text
from matchyard.operators import answers, comparing, findings, graph, matching, verdicts
from matchyard.operators.durable import settled
from matchyard.plans.catalogue import COMMON_SIZES, CROSS_SQL, ENTITY_SQL, HEIGHTS_SQL, PEER_SQL, PLAUSIBLE_SQL, PRIMARY_SQL, TIES_SQL, TWICE_SQL, _candidates, _cross, query, with_tables
from matchyard.sources.adapters import ELEMENTS_SQL, LEVELS_SQL, NOTES_SQL, elements, levels, notes, table

GRID_SQL = """"row" || '-' || regexp_replace(CAST(col AS VARCHAR), '\\.0$', '')"""


@query(with_tables(ELEMENTS_SQL, LEVELS_SQL, PEER_SQL, HEIGHTS_SQL, TIES_SQL, PLAUSIBLE_SQL, TWICE_SQL, PRIMARY_SQL, CROSS_SQL) + f""",
own AS (SELECT 'self.peer_outlier' AS c, id || '|' || field AS parts, id AS record, overall AS trust, score AS probability FROM peers
  UNION ALL SELECT 'self.internal_consistency', id, id, trust, 1.0 FROM odd UNION ALL SELECT 'self.plausibility', id, id, trust, 1.0 FROM implausible
  UNION ALL SELECT check_type, first_id || '|' || other_id, first_id, trust, 1.0 FROM twice),
whole AS (SELECT id, check_type, status, level, grid, trust, probability FROM findings UNION ALL
  SELECT 'F-' || substr(sha1(c || '|' || parts), 1, 12), c, 'needs_review', e.level, {GRID_SQL}, own.trust, CAST(probability AS DOUBLE) FROM own JOIN elements e ON e.id = own.record)
SELECT *, format('F-{{:07d}}', row_number() OVER (ORDER BY level, COALESCE(grid, ''), check_type, id)) AS number FROM whole""")
def run_comparison(spark, sf_dir):
    e = elements(spark, sf_dir)
    return findings.all_findings(_cross(spark, sf_dir), comparing.self_findings(e, levels(spark, sf_dir), COMMON_SIZES, ("level", "row", "col")))


@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL, CROSS_SQL) + """ SELECT id, status, format('{:07d}', row_number() OVER (ORDER BY CASE status WHEN 'non_compliant' THEN 1 WHEN 'needs_review' THEN 2 ELSE 3 END, id)) AS number FROM findings""")
def listed_findings(spark, sf_dir):
    return findings.list_order(_cross(spark, sf_dir).select("id", "status"))


@query(with_tables(ELEMENTS_SQL, ENTITY_SQL) + " SELECT note, slot, cost, format('{:07d}', row_number() OVER (ORDER BY cost, note, slot)) AS number FROM candidates")
def ordered_pairs(spark, sf_dir):
    return matching.numbered(_candidates(spark, sf_dir).select("note", "slot", "cost"), "number", "%07d", "cost", "note", "slot")


@query("SELECT s_suppkey AS path, s_nationkey % 3 = 0 AS plan, s_suppkey % 7 AS ocr_pages, format('{:07d}', row_number() OVER (ORDER BY s_nationkey % 3 <> 0, s_suppkey % 7, s_suppkey)) AS number FROM supplier")
def scheduling_order(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), (F.col("s_nationkey") % 3 == 0).alias("plan"), (F.col("s_suppkey") % 7).alias("ocr_pages"))
    return matching.numbered(files.withColumn("_later", ~F.col("plan")), "number", "%07d", "_later", "ocr_pages", "path").drop("_later")


@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL) + " SELECT key, id FROM s WHERE key NOT IN (SELECT key FROM p)")
def unmatched_shops(spark, sf_dir):
    plan, shop = matching.sides(elements(spark, sf_dir))
    return findings.without_match(shop, plan).select("key", F.col("shop_id").alias("id"))


_FLAG = "CASE WHEN {0} % 2 = 0 THEN 'low_conf' WHEN {0} % 3 = 0 THEN 'snapped' ELSE 'far' END"


@query(f"WITH a AS (SELECT DISTINCT l_orderkey AS record, {_FLAG.format('l_partkey')} AS flag FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS record, {_FLAG.format('l_suppkey')} AS flag FROM lineitem WHERE l_linenumber > 2) SELECT record, flag FROM a EXCEPT SELECT record, flag FROM b")
def new_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    flag = lambda c: F.expr(_FLAG.format(c)).alias("flag")
    return findings.new_flags(rows.where("l_linenumber > 2").select(F.col("l_orderkey").alias("record"), flag("l_suppkey")), rows.select(F.col("l_orderkey").alias("record"), flag("l_partkey")))


@query(f"""WITH f AS (SELECT l_orderkey AS record, l_linenumber % 2 AS side, {_FLAG.format('l_partkey')} AS flag FROM lineitem)
 SELECT record, array_to_string(list_sort(list(DISTINCT flag)), ',') AS flags FROM f GROUP BY record""")
def flag_unions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), (F.col("l_linenumber") % 2).alias("side"), F.expr(_FLAG.format("l_partkey")).alias("flag"))
    of = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("flag"))).alias(f"f{side}")
    both = rows.groupBy("record").agg(of(0), of(1))
    return both.select("record", F.array_join(findings.flag_union(F.col("f0"), F.col("f1")), ",").alias("flags"))


_CELLS = "CASE WHEN l_partkey % 4 = 0 THEN {0} ELSE {1} END"


@query("""WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS id, 'C' || (l_suppkey % 9) AS cell, l_partkey % 4 = 0 AS many, l_returnflag AS kind, 'N' || (l_linenumber % 3) AS level, CASE WHEN l_suppkey % 5 = 0 THEN 'N9' END AS level_to FROM lineitem WHERE l_partkey % 6 <> 0),
 c AS (SELECT id, unnest(CASE WHEN many THEN [cell, 'D' || id % 5] ELSE [cell] END) AS cell, level, level_to, kind FROM e)
 SELECT cell, level, level_to, kind, min(id) AS slot, count(*) AS members FROM c GROUP BY ALL""")
def shop_slots(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    ident, cell = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.concat(F.lit("C"), (F.col("l_suppkey") % 9).cast("string"))
    several = F.when(F.col("l_partkey") % 4 == 0, F.array(cell, F.concat(F.lit("D"), (ident % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    role = F.when(F.col("l_partkey") % 6 == 0, "schedule_tag")
    return findings.slots(rows.select(ident.alias("id"), several.alias("cells"), cell.alias("cell"), F.concat(F.lit("N"), (F.col("l_linenumber") % 3).cast("string")).alias("level"), F.when(F.col("l_suppkey") % 5 == 0, "N9").alias("level_to"), F.col("l_returnflag").alias("kind"), role.alias("role")))


@query("""WITH n AS (SELECT DISTINCT o_orderkey AS note, 'C' || (o_custkey % 90) AS cell, CASE WHEN o_orderkey % 3 > 0 THEN 'N1' END AS level, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'column' ELSE 'beam' END AS kind FROM orders),
 p AS (SELECT 'C' || (s_suppkey % 90) AS cell, CASE WHEN s_suppkey % 5 > 0 THEN 'N' || (s_suppkey % 4) END AS level, CASE WHEN s_suppkey % 2 = 0 THEN 'pier' ELSE 'beam' END AS kind FROM supplier UNION ALL SELECT 'C' || (c_custkey % 90), 'N2', 'beam' FROM customer)
 SELECT note, count(DISTINCT COALESCE(p.level, '')) AS levels FROM n JOIN p USING (cell) WHERE n.level IS NULL AND (n.kind IS NULL OR n.kind = p.kind OR (n.kind = 'column' AND p.kind = 'pier')) GROUP BY note HAVING count(DISTINCT COALESCE(p.level, '')) > 1""")
def level_vetoes(spark, sf_dir):
    o, s, c = (table(spark, sf_dir, t) for t in ("orders", "supplier", "customer"))
    at = lambda k: F.concat(F.lit("C"), (F.col(k) % 90).cast("string")).alias("cell")
    k = F.col("o_orderkey")
    notes_ = o.select(k.alias("note"), at("o_custkey"), F.when(k % 3 > 0, "N1").alias("level"), F.when(k % 4 == 0, F.lit(None)).when(k % 2 == 0, "column").otherwise("beam").alias("kind")).distinct()
    pool = s.select(at("s_suppkey"), F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("N"), (F.col("s_suppkey") % 4).cast("string"))).alias("level"), F.when(F.col("s_suppkey") % 2 == 0, "pier").otherwise("beam").alias("kind"))
    return findings.level_vetoes(notes_, pool.unionByName(c.select(at("c_custkey"), F.lit("N2").alias("level"), F.lit("beam").alias("kind"))))


@query("""WITH s AS (SELECT p_partkey, (p_size * 10)::DOUBLE AS a, (p_partkey % 50 * 10)::DOUBLE AS b, (p_partkey % 50 * 10 + p_partkey % 3)::DOUBLE AS c, (p_size * 10 + p_partkey % 7)::DOUBLE AS d, p_partkey % 11 = 0 AS none FROM part)
 SELECT p_partkey, CASE WHEN none THEN 0.0::DOUBLE WHEN (abs(a - c) <= greatest(1.0, 0.04::DOUBLE * greatest(a, c)) AND abs(b - d) <= greatest(1.0, 0.04::DOUBLE * greatest(b, d))) OR (abs(a - d) <= greatest(1.0, 0.04::DOUBLE * greatest(a, d)) AND abs(b - c) <= greatest(1.0, 0.04::DOUBLE * greatest(b, c))) THEN -0.3::DOUBLE ELSE 0.4::DOUBLE END AS cost FROM s""")
def section_costs(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    pair = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    rows = table(spark, sf_dir, "part").select(k, pair(size * 10, k % 50 * 10).alias("a"), F.when(k % 11 > 0, pair(k % 50 * 10 + k % 3, size * 10 + k % 7)).alias("b"))
    return rows.select("p_partkey", findings.section_cost(F.col("a"), F.col("b")).alias("cost"))


@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL) + """ SELECT key, COALESCE(p."count" <> s."count", false) OR COALESCE(p.size <> s.size, false) OR COALESCE(abs(p.spacing_mm - s.spacing_mm) > greatest(5.0, 0.04::DOUBLE * greatest(p.spacing_mm, s.spacing_mm)), false) AS differ FROM p JOIN s USING (key)""")
def numbers_differ(spark, sf_dir):
    side = lambda p: F.struct(*(F.col(f"{p}_{c}").alias(c) for c in ("count", "size", "spacing_mm")))
    return matching.key_match(elements(spark, sf_dir)).select("key", findings.numbers_differ(side("plan"), side("shop")).alias("differ"))


@query("""WITH m AS (SELECT l_suppkey AS shop, count(*) AS matched FROM lineitem GROUP BY l_suppkey), p AS (SELECT s_suppkey AS shop, CASE WHEN s_suppkey % 4 > 0 THEN m.matched + s_suppkey % 2 END AS quantity, m.matched + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS cells FROM supplier JOIN m ON m.shop = s_suppkey)
 SELECT shop, matched, quantity, CASE WHEN matched = quantity THEN 'equal' ELSE 'different' END AS result FROM m JOIN p USING (shop) WHERE quantity IS NOT NULL AND matched = cells""")
def quantity_checks(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("shop"), F.col("l_orderkey").alias("plan"))
    counts, k = pairs.groupBy("shop").count(), F.col("s_suppkey")
    printed = table(spark, sf_dir, "supplier").join(counts, k == F.col("shop")).select("shop", F.when(k % 4 > 0, F.col("count") + k % 2).alias("quantity"), (F.col("count") + F.when(k % 5 == 0, 1).otherwise(0)).alias("cells"))
    return findings.quantity_checks(pairs, printed)


@query(with_tables(ELEMENTS_SQL) + """, n AS (SELECT *, row_number() OVER (PARTITION BY file, page, level, "row", col ORDER BY id) AS nth FROM elements) SELECT id, nth, CASE WHEN nth > 1 THEN 'duplicate_cell_level_on_page' END AS flag FROM n""")
def repeated_on_page(spark, sf_dir):
    return findings.repeated_on_page(elements(spark, sf_dir), "level", "row", "col").select("id", "nth", "flag")


@query(with_tables(ELEMENTS_SQL) + " SELECT file, page, round(avg(overall), 4) AS mean_conf, min(overall) AS min_conf FROM elements GROUP BY file, page")
def page_confidence(spark, sf_dir):
    return findings.page_confidence(elements(spark, sf_dir).withColumnRenamed("overall", "conf"))


@query("""WITH b AS (SELECT l_suppkey AS page, CASE WHEN l_partkey % 5 > 0 THEN 'T' || (l_partkey % 5) END AS title, l_orderkey * 8 + l_linenumber AS k, CASE l_partkey % 4 WHEN 0 THEN 'AB.5' WHEN 1 THEN 'TYP' WHEN 2 THEN '120' ELSE 'SEE DETAIL ' || l_linenumber END AS text FROM lineitem)
 SELECT page, title, k, text, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page, title ORDER BY k) AS place FROM b WHERE title IS NOT NULL AND NOT regexp_full_match(text, '[A-Z]{1,2}(\\.[0-9])?''?|[0-9]{1,3}(\\.[0-9])?|[-–—•.]') AND length(text) > 3) WHERE place <= 40""")
def detail_texts(spark, sf_dir):
    p = F.col("l_partkey") % 4
    words = F.when(p == 0, "AB.5").when(p == 1, "TYP").when(p == 2, "120").otherwise(F.concat(F.lit("SEE DETAIL "), F.col("l_linenumber").cast("string")))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("T"), (F.col("l_partkey") % 5).cast("string"))).alias("title"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), words.alias("text"))
    return findings.detail_texts(b)


@query(with_tables(NOTES_SQL) + """, t AS (SELECT note, q, CASE note % 4 WHEN 0 THEN q || ' REQ. BARS' WHEN 1 THEN ' ' || q || 'pcs' WHEN 2 THEN 'QTY ' || q ELSE q || ' REQUEST' END AS x FROM notes)
 SELECT note, CASE WHEN note % 4 < 2 THEN CAST(q AS INTEGER) END AS quantity FROM t""")
def quantity_lines(spark, sf_dir):
    n, k = notes(spark, sf_dir), F.col("note") % 4
    t = F.when(k == 0, F.concat("q", F.lit(" REQ. BARS"))).when(k == 1, F.concat(F.lit(" "), "q", F.lit("pcs"))).when(k == 2, F.concat(F.lit("QTY "), "q")).otherwise(F.concat("q", F.lit(" REQUEST")))
    return n.withColumn("t", t).select("note", text.quantity_line(F.col("t")).alias("quantity"))


@query(with_tables(NOTES_SQL) + """ SELECT note, CASE note % 4 WHEN 0 THEN '1:' || q WHEN 1 THEN '1 : ' || q WHEN 2 THEN '1/' || q END AS scale FROM notes""")
def scale_texts(spark, sf_dir):
    n, k = notes(spark, sf_dir), F.col("note") % 4
    t = F.when(k == 0, F.concat(F.lit("Plan échelle: 1:"), "q")).when(k == 1, F.concat(F.lit("SCALE 1 : "), "q")).when(k == 2, F.concat(F.lit("ech. 1/"), "q", F.lit(" A1"))).otherwise(F.concat(F.lit("scale as shown "), "q"))
    return n.withColumn("t", t).select("note", text.scale_of(F.col("t")).alias("scale"))


@query(with_tables(NOTES_SQL) + """, t AS (SELECT note, q::DOUBLE AS lo, (q + 1 + l_suppkey % 3)::DOUBLE AS hi, CASE WHEN note % 3 > 0 THEN (l_partkey % 10) / 10.0::DOUBLE END AS f FROM notes) SELECT note, COALESCE(round(lo + f * (hi - lo), 3), lo) AS value FROM t""")
def axis_values(spark, sf_dir):
    n = notes(spark, sf_dir)
    low = F.col("q").cast("double")
    return n.select("note", findings.axis_value(low, (F.col("q") + 1 + F.col("l_suppkey") % 3).cast("double"), F.when(F.col("note") % 3 > 0, (F.col("l_partkey") % 10) / F.lit(10.0)), low).alias("value"))


@query(with_tables(ELEMENTS_SQL, PRIMARY_SQL) + """, r AS (SELECT p.level, median(CASE WHEN p.spacing_mm > 0 AND s.spacing_mm > 0 THEN s.spacing_mm / p.spacing_mm END) AS ratio, count(p.spacing_mm) AS n FROM p JOIN s USING (key) GROUP BY p.level)
 SELECT level, round(ratio, 6) AS ratio, n, COALESCE(abs(ratio * 25.4::DOUBLE - 1) <= 0.1 OR abs(ratio / 25.4::DOUBLE - 1) <= 0.1, false) AS unit_error FROM r""")
def spacing_feedback(spark, sf_dir):
    pairs = matching.key_match(elements(spark, sf_dir))
    return findings.spacing_feedback(pairs.select(F.col("plan_level").alias("level"), F.col("plan_spacing_mm").alias("plan_mm"), F.col("shop_spacing_mm").alias("shop_mm")))


@query("""SELECT c_custkey, (['column', 'pier', 'beam', 'wall', 'raft', 'stair'])[CAST(c_custkey % 6 + 1 AS INTEGER)] AS kind, CASE c_custkey % 6 WHEN 0 THEN 'colonne' WHEN 1 THEN 'colonne' WHEN 2 THEN 'poutre' WHEN 3 THEN 'mur_refend' WHEN 4 THEN 'fondation' END AS type FROM customer""")
def shown_types(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("column", "pier", "beam", "wall", "raft", "stair"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), findings.shown_type(kind).alias("type"))


# ---- the cost model's path from notes to findings

def _members(spark, sf_dir, source):
    """Notes of one side (id, row, col, level, kind, bars) and the members that they make up."""
    e = elements(spark, sf_dir).where(F.col("source") == source)
    bar = lambda role, count, size, spacing, said: F.struct(F.lit(role).alias("role_hint"), count.cast("int").alias("count"), F.lit(None).cast("int").alias("secondary_count"), F.lit(None).cast("int").alias("groups"), size.alias("size"), spacing.cast("double").alias("spacing_mm"), said.alias("said"))
    none = F.lit(None)
    main = bar("main", F.col("count"), F.col("size"), none, F.concat_ws(" ", F.lit("VERT"), "count", "size"))
    ties = F.when(F.col("spacing_mm").isNotNull(), bar("ties", none, F.col("tie_size"), F.col("spacing_mm"), F.concat_ws(" ", F.lit("LIG"), "tie_size", F.lit("@"), "spacing_mm")))
    level = F.when((F.col("file") == 4) & (F.col("page") == 6), None).otherwise(F.col("level")) if source == "plan" else F.col("level")
    notes_ = e.select("id", "row", "col", level.alias("level"), F.col("type").alias("kind"), F.array_compact(F.array(main, ties)).alias("bars"), F.concat(F.lit("T"), (F.col("file") % 2).cast("string")).alias("type_key"), (F.col("tie_count") - 20).alias("quantity"))
    keys = ["row", "col", "level", "kind"]
    whole = verdicts.combined(notes_, keys, ("type_key", "quantity")).withColumn("first", F.get("said_by", F.lit(0))["id"])
    whole = whole.withColumn("type_key", F.when(F.hash("first") % 3 == 0, F.col("type_key")))
    return whole.withColumn("cell", F.concat_ws("-", "row", F.regexp_replace(F.col("col").cast("string"), r"\.0$", "")))


def _found(spark, sf_dir):
    plan = settled(_members(spark, sf_dir, "plan").withColumnRenamed("first", "note"))
    shop = settled(_members(spark, sf_dir, "shop").withColumnRenamed("first", "slot").withColumns({"level_to": F.lit(None).cast("string"), "listed": F.lit(1)}))
    vetoed = settled(findings.level_vetoes(plan, shop))
    # the others can't be told apart, so none is guessed; only members without a level are among them
    known = plan.where("level is not null").unionByName(plan.where("level is null").join(vetoed.select("note"), "note", "left_anti").select(*plan.columns))
    edges = matching.candidates(known.select("note", "row", "col", "level", "kind", "bars"), shop.select("slot", "row", "col", "level", "level_to", "kind", "bars"), best=None, more=True).select("note", "slot", "cost", "row", "stretch")
    pairs = settled(matching.solved(graph.labelled(edges, "note", "slot", near=("row", "stretch"))).select("note", "slot", "cost"))
    return verdicts.build_findings(pairs, plan, shop, vetoed)


@query()
def build_findings(spark, sf_dir):
    return _found(spark, sf_dir)[0]


@query()
def systematic_differences(spark, sf_dir):
    return _found(spark, sf_dir)[1]


ASKED_SQL = """
near AS (SELECT c.note, c.slot, c.cost, c.place, l."row" = r."row" AND l.col = r.col AS same, lead(c.cost) OVER (PARTITION BY c.note ORDER BY c.place) AS next FROM candidates c JOIN l USING (note) JOIN r USING (slot)),
asked AS (SELECT note, slot, cost FROM near WHERE place = 1 AND (NOT same OR COALESCE(next - cost < 0.2, false)))"""


def _asked(spark, sf_dir):
    edges = settled(_candidates(spark, sf_dir, more=True))
    asked = answers.close_calls(edges)
    # what a model would say, by the ids alone: yes, no, nothing
    said = F.pmod(F.crc32(F.col("note").cast("binary")), F.lit(4))
    told = asked.withColumns({"option": F.when(said == 0, "yes").when(said == 1, "no").when(said == 2, "yes"), "certainty": F.when(said == 0, 0.9)})
    return edges, told


@query(with_tables(ELEMENTS_SQL, ENTITY_SQL, ASKED_SQL) + " SELECT note, slot, cost FROM asked")
def close_calls(spark, sf_dir):
    return answers.close_calls(_candidates(spark, sf_dir, more=True))


@query()
def assigned_after_answers(spark, sf_dir):
    edges, told = _asked(spark, sf_dir)
    return answers.assigned_after(edges, told)
