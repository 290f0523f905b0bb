import itertools

import numpy as np
from pyspark.sql import functions as F

from matchyard.functions import text
from matchyard.operators import checks, comparing, layout, matching
from matchyard.operators.assignment import least_cost, on_a_line, with_opting_out
from matchyard.streaming import arrival

SCHEMA = "id string, source string, type string, level string, row string, col double, file string, page int, count int, size string, tie_size string, spacing_mm double, tie_count int, overall double"


def record(id, source="plan", level="N2", row="K", col=4.0, file="a", page=1, count=4, size="25M", tie_size="10M", spacing=152.4, tie_count=None, overall=0.9):
    return (id, source, "colonne", level, row, col, file, page, count, size, tie_size, spacing, tie_count, overall)


def statuses(spark, rows):
    e = spark.createDataFrame(rows, SCHEMA)
    pairs = matching.full_outer(e, matching.near_columns(e))
    return {(r["kind"], r["status"], r["level"], r["grid"]): r for r in comparing.cross(pairs, e).collect()}


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = (int(x) for x in rng.integers(0, 6, 2))
        a, b, c = rng.integers(0, 20, n) / 2, rng.integers(0, 20, m) / 2, rng.random((n, m))
        for cost, pairs in ((np.abs(a[:, None] - b), on_a_line(a, b)), (c, least_cost(c))):
            small = cost.T if n > m else cost
            best = min((sum(small[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(max(n, m)), min(n, m))), default=0)
            assert len(pairs) == min(n, m) and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9


def test_opting_out_beats_a_dear_pair():
    assert with_opting_out(np.array([[0.1, 1.7], [1.7, 1.65]]), 0.8, 1000.0) == [(0, 0)]


def test_planted_cases(spark):
    rows = [record("p1"), record("s1", "shop", count=6), record("p2", col=5.0), record("s2", "shop", col=5.0), record("p3", col=6.0, overall=0.5), record("s3", "shop", col=6.0, spacing=304.8),
            record("p4", col=8.0), record("s4", "shop", col=9.0), record("s5", "shop", level="FDN", col=3.0), record("p6", row=None), record("p7", col=12.0), record("s7", "shop", col=12.3)]
    found = statuses(spark, rows)
    assert found[("field_diff", "non_compliant", "N2", "K-4")]["fields"] == "count"
    assert ("field_diff", "compliant", "N2", "K-5") in found
    assert ("field_diff", "needs_review", "N2", "K-6") in found
    assert ("missing", "missing", "N2", "K-8") in found and ("added", "added", "N2", "K-9") in found
    assert ("level_not_covered", "needs_review", "FDN", "K-3") in found
    assert ("unbound_plan_block", "needs_review", "N2", "4") in found
    near = found[("field_diff", "needs_review", "N2", "K-12")]
    assert near["shop_id"] == "s7" and near["trust"] == 0.605


def test_the_assignment_comes_before_the_limit(spark):
    rows = [record("p1", col=1.0), record("p2", col=1.4), record("s1", "shop", col=1.2)]
    pairs = matching.near_columns(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(pairs) == 1 and pairs[0]["shop_id"] == "s1"


def test_duplicates(spark):
    e = spark.createDataFrame([record("a", "shop", file="x"), record("b", "shop", file="y", count=5), record("c", "shop", file="x", page=2, size="35M"), record("d", "shop", file="z")], SCHEMA)
    found = {r["other_id"]: (r["check_type"], r["fields"]) for r in checks.duplicate_conflicts(e).collect()}
    assert found == {"b": ("cross.shop_vs_shop", "count"), "c": ("self.duplicate", "size")}


def test_few_samples_use_fixed_limits(spark):
    band = checks.learned_band(spark.createDataFrame([(1.0,)] * 3, "ratio double")).first()
    assert tuple(band) == (0.8, 1.3, "fallback")
    assert tuple(checks.learned_band(spark.createDataFrame([], "ratio double")).first()) == (0.8, 1.3, "fallback")


def test_notation(spark):
    t = spark.createDataFrame([("4-25M",), ("14 - 35M C/C",), ('10M@6"',), ("10M @ 200mm",), ("10M@45",), ('COL. 18"x20"',), ("COL 400x600mm",), ("143' - 3\"",), ("12.50 m",), ("ÉTRI: 6 10M T4X21 @6",), ("C-01",), ("J.5-12",), ("Niveau 04",), ("SS-2",), ("",), (None,)], "t string")
    c = F.col("t")
    n, s = text.count_size(c)
    _, spacing = text.size_spacing(c)
    a, b = text.section(c)
    ties = text.shop_bars(c, text.TIE_WORDS)
    row, col = text.grid_label(c)
    got = {r["t"]: r for r in t.select("t", n.alias("n"), s.alias("s"), spacing.alias("sp"), a.alias("a"), b.alias("b"), text.elevation(c).alias("el"), ties["mark"].alias("mark"), ties["spacing_mm"].alias("ts"), row.alias("row"), col.alias("col"), text.canonical_level(c).alias("lv")).collect()}
    assert (got["4-25M"]["n"], got["4-25M"]["s"], got["14 - 35M C/C"]["n"]) == (4, "25M", 14)
    assert [got[k]["sp"] for k in ('10M@6"', "10M @ 200mm", "10M@45")] == [152.4, 200.0, 45.0]
    assert (got['COL. 18"x20"']["a"], got['COL. 18"x20"']["b"], got["COL 400x600mm"]["a"]) == (457.2, 508.0, 400.0)
    assert (got["143' - 3\""]["el"], got["12.50 m"]["el"]) == (43662.6, 12500.0)
    assert (got["ÉTRI: 6 10M T4X21 @6"]["mark"], got["ÉTRI: 6 10M T4X21 @6"]["ts"]) == ("T4X21", 152.4)
    assert got["C-01"]["row"] is None and (got["J.5-12"]["row"], got["J.5-12"]["col"]) == ("J.5", 12.0)
    assert (got["Niveau 04"]["lv"], got["SS-2"]["lv"], got[""]["lv"], got[None]["lv"]) == ("N4", "SS2", None, None)


def test_components_of_cost_model(spark):
    edges = spark.createDataFrame([("p1", "s1", 0.1), ("p1", "s2", 0.5), ("p2", "s1", 0.2), ("p3", "s3", 1.7)], "note string, slot string, cost double")
    parts = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 2)], "note string, component int")
    made = {r["note"]: r["slot"] for r in matching.assign(edges, parts).collect()}
    assert made["p1"] == "s2" and made["p2"] == "s1"


def test_numbering_is_total_and_gapless(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    got = [r["name"] for r in matching.numbered(rows, "name", "P%05d", "v").orderBy("v").collect()]
    assert got == [f"P{i:05d}" for i in range(1, 501)]


def test_clusters(spark):
    rows = spark.createDataFrame([(1, v) for v in (0.0, 1.0, 1.0, 5.0, 5.5, 20.0)], "k int, v double")
    assert [r["cluster"] for r in layout.clusters(rows, ["k"], "v", 2.0).orderBy("v").collect()] == [0, 0, 0, 1, 1, 2]


def test_covered_words_go(spark):
    schema = "page int, text string, x0 double, x1 double, y0 double, y1 double"
    native = spark.createDataFrame([(1, "a", 0.0, 10.0, 0.0, 8.0)], schema)
    read = spark.createDataFrame([(1, "a", 1.0, 9.0, 1.0, 7.0), (1, "b", 30.0, 40.0, 0.0, 8.0), (2, "c", 1.0, 9.0, 1.0, 7.0)], schema)
    assert sorted(r["text"] for r in layout.without_covered(native, read).collect()) == ["a", "b", "c"]


def test_stream_ends_with_the_result_of_all(spark, tmp_path):
    source = str(tmp_path / "in")
    e = spark.createDataFrame([record(f"e{i}", "plan" if i % 2 else "shop", col=float(i // 2)) for i in range(20)], SCHEMA)
    e.repartition(4).write.json(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).json(source)
    query = arrival.refresh(stream, str(tmp_path / "store"), lambda d: matching.key_match(d).select("key"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == matching.key_match(e).count() == 10


def test_double_readings_go(spark):
    from matchyard.operators.geometry import read_once

    schema = "page int, text string, x0 double, y0 double, x1 double, y1 double, conf double"
    rows = [(1, "25M", 0.0, 0.0, 30.0, 10.0, 0.9), (1, "25M", 1.0, 0.0, 31.0, 10.0, 0.8), (1, "2", 2.0, 1.0, 8.0, 9.0, 0.9), (1, "A", 100.0, 0.0, 110.0, 10.0, 0.9), (1, "B", 112.0, 0.0, 122.0, 10.0, 0.9), (1, "ABCDEFG", 99.0, 0.0, 123.0, 10.0, 0.4), (2, "25M", 0.0, 0.0, 30.0, 10.0, None)]
    kept = {(r["page"], r["text"], r["conf"]) for r in read_once(spark.createDataFrame(rows, schema)).collect()}
    assert (1, "25M", 0.9) in kept and (1, "25M", 0.8) not in kept and (1, "2", 0.9) not in kept and (2, "25M", None) in kept


def test_questions_are_asked_once(spark):
    from matchyard.operators.evaluate import asked_once, no_answer

    questions = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "key int, prompt string")
    cache = spark.createDataFrame([("p", "yes", 0.9)], "prompt string, option string, certainty double")
    assert {tuple(r) for r in asked_once(questions, cache, no_answer).collect()} == {(1, "yes", 0.9), (2, "yes", 0.9), (3, None, None)}


def test_planted_changes_are_found(spark):
    from matchyard.operators import evaluate

    rows = [record(f"p{i}", col=float(i)) for i in range(40)] + [record(f"s{i}", "shop", col=float(i)) for i in range(40)]
    changed = evaluate.plant(spark.createDataFrame(rows, SCHEMA), 0.3, 1)
    pairs = matching.full_outer(changed.drop("planted"))
    got = {r["verdict"]: r["n"] for r in evaluate.recall(evaluate.judge(changed, comparing.cross(pairs, changed))).collect()}
    assert set(got) == {"found"} and got["found"] >= 5


def test_grid_is_found_whichever_way_it_is_drawn(spark):
    from matchyard.operators.grid import fit

    rows = [(1, c, 10.0, 50.0 * i) for i, c in enumerate("ABCDE")] + [(1, str(i + 1), 100.0 + 60 * i, 5.0) for i in range(6)] + [(1, "3", 400.0, 300.0), (1, "Z", 200.0, 300.0)]
    turned = [(2, t, y, x) for _, t, x, y in rows]
    few = [(3, "A", 1.0, 1.0), (3, "1", 5.0, 9.0)]
    got = fit(spark.createDataFrame(rows + turned + few, "page int, text string, cx double, cy double"), 4.0).collect()
    for page, on in ((1, "y"), (2, "x")):
        mine = [r for r in got if r["page"] == page]
        assert {r["letters_on"] for r in mine} == {on}
        assert {(r["label"], r["pos"]) for r in mine if r["axis"] == "row"} == {(c, 50.0 * i) for i, c in enumerate("ABCDE")}
        assert [r["label"] for r in sorted((r for r in mine if r["axis"] == "column"), key=lambda r: r["pos"])] == list("123456")
    assert not [r for r in got if r["page"] == 3]


def test_views_and_levels(spark):
    from matchyard.operators.grid import level_in_view, longest_run, views


    lines = [(1, 0.0, "N3", 9000.0), (1, 10.0, "N2", 6000.0), (1, 20.0, "N1", None), (1, 30.0, "N3", 9000.0), (1, 40.0, "N2", 6000.0)]
    got = sorted((r["y"], r["level"], r["view"]) for r in views(spark.createDataFrame(lines, "page int, y double, level string, elevation_mm double")).collect())
    assert [v for _, _, v in got] == [0, 0, 0, 1, 1]
    assert [level_in_view(got, y) for y in (-1.0, 5.0, 25.0, 35.0, 50.0)] == ["UNKNOWN", "N2", "FDN", "N2", "FDN"]
    runs = spark.createDataFrame([([3.0, 1.0, 2.0, 5.0, 4.0, 9.0],), ([],), ([5.0, 4.0, 4.0, 1.0],)], "v array<double>").select(longest_run(F.col("v")).alias("n"))
    assert [r["n"] for r in runs.collect()] == [4, 0, 3]
