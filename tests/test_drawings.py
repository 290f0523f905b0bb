"""Drawn pages, statements, schedules, plan columns and findings, where the registered queries' tables don't go."""

import random
import re

import pytest
from pyspark.sql import functions as F

from matchyard.functions import statements, text
from matchyard.operators import callouts, outlines, schedules, verdicts
from matchyard.operators.bars import compare_notes
from matchyard.operators.graph import connected

WORDS = "page long, word long, text string, x0 double, y0 double, x1 double, y1 double"


def words_of(rows, page=1):
    """(x, y, text) to words five wide a character and eight high."""
    return [(page, i, t, float(x), float(y), float(x + 5 * len(t)), float(y + 8)) for i, (x, y, t) in enumerate(rows)]


def heights(spark, h=8.0):
    return spark.createDataFrame([(1, h)], "page long, h double")


def test_notation_is_read_wherever_it_stands(spark):
    said = ["SEE COLUMN SCHEDULE, COL. 18x20", "COLUMN TYPE / COL. 400x600mm", 'TYP @ EDGE 10M@6"', "L'AXE, EL 143' - 3\"", "VERT BARS; VERT: 4 25M B7-01", "VERT: 425M B7-01", "nothing"]
    t = F.col("t")
    bars = text.shop_bars(t, text.VERTICAL_WORDS)
    rows = spark.createDataFrame([(s,) for s in said], "t string").select("t", F.array(*text.section(t)).alias("section"), F.struct(*text.size_spacing(t)).alias("spacing"), text.elevation(t).alias("elevation"), bars["count"].alias("n"), bars["size"].alias("size"), bars["mark"].alias("mark"))
    got = {r["t"]: r for r in rows.collect()}
    assert got[said[0]]["section"] == [457.2, 508.0] and got[said[1]]["section"] == [400.0, 600.0]
    assert tuple(got[said[2]]["spacing"]) == ("10M", 152.4)
    assert got[said[3]]["elevation"] == pytest.approx(143 * 304.8 + 3 * 25.4)
    assert [(got[s]["n"], got[s]["size"], got[s]["mark"]) for s in said[4:6]] == [(4, "25M", "B7-01")] * 2
    assert got["nothing"]["section"] == [None, None] and got["nothing"]["n"] is None and got["nothing"]["elevation"] is None


def test_statements_come_in_order_with_what_stands_before(spark):
    rng = random.Random(3)
    parts = ["4 25M B7.", '18 10M T4X21 @6"', "16(8)-25M", "12(4)", "11-25M", "10M@200mm", "10m @ 12", "LIG. ", "H: ", " + ", "words ", "99M@3 ", "- "]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(300)] + ["", None]
    # the same grammar as Python reads it, with its own scanner
    shape = re.compile("|".join(f"(?:{p})" for p in (statements.LISTED, statements.COMPOSITE, statements.COUNTED, statements.SPACED)), re.I)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", statements.statements(F.col("t")).alias("s")).collect()
    for r in rows:
        t = texts[r["i"]]
        if t is None:
            assert r["s"] is None
            continue
        last, expected = 0, []
        for m in shape.finditer(t):
            label = t[last : m.start()].strip(" :+-")
            expected.append((m.start(), label if 0 < len(label) <= 24 else None))
            last = m.end()
        assert [s["start"] for s in r["s"]] == [start for start, _ in expected]
        assert [s["label"] for s in r["s"] if s["count"] is None or s["secondary"] is not None] == [lb for s, (_, lb) in zip(r["s"], expected) if s["count"] is None or s["secondary"] is not None]
    one = spark.createDataFrame([("RANG 2: 16(8)-25m; 18 10M T4X21 @6\" LIG 10M@40",)], "t string").select(F.inline(statements.statements(F.col("t")))).collect()
    assert [tuple(r) for r in one] == [("RANG 2", 16, "25M", None, 8, 8), ("T4X21", 18, "10M", 152.4, None, 19), ("LIG", None, "10M", 40.0, None, 40)]


def test_spans_and_specifications(spark):
    df = spark.createDataFrame([("COLONNE NIV3@NIV4 / SS1@RDC, NIV3@NIV4 x@y T5@100",), ("2x4 25M B12. 18.10MT7 @150 3 x 6 20m A-1; 5 35M Z",)], "t string")
    spans, specs = ([r[0] for r in df.select(f(F.col("t"))).collect()] for f in (statements.level_spans, statements.specifications))
    assert [(s["lower"], s["upper"]) for s in spans[0]] == [("N3", "N4"), ("SS", "RDC")] and spans[1] == []
    assert [(s["columns"], s["count"], s["size"], s["mark"], s["spacing_mm"], s["start"]) for s in specs[1]] == [(2, 4, "25M", "B12", None, 0), (None, 18, "10M", "T7", 150.0, 13), (3, 6, "20M", "A-1", None, 27), (None, 5, "35M", "Z", None, 42)]


def test_components_of_any_shape(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7), (None, 3)]
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            of[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in of}


def test_lines_hang_on_their_first_word(spark):
    rows = words_of([(i * 30, y, f"w{i}") for i, y in enumerate([0, 2, 4, 5, 7, 9.5, 30, 32.9, 33.1, 36])])
    got = callouts.text_lines(spark.createDataFrame(rows, WORDS), heights(spark)).collect()
    assert {r["y0"]: r["line"] for r in got} == {0: 0, 2: 0, 4: 4, 5: 4, 7: 4, 9.5: 9.5, 30: 30, 32.9: 30, 33.1: 33.1, 36: 33.1}


def test_leaders_bend_four_times_at_most(spark):
    frame = spark.createDataFrame([(1, 8.0, 0.0, 0.0, 50.0, 20.0, "red", "text")], "page long, h double, x0 double, y0 double, x1 double, y1 double, colour string, text string")
    for bends, binding in ((0, "leader"), (4, "leader"), (5, "none")):
        at = [(50.0, 10.0)] + [(50.0 + 40 * (i + 1), 10.0 + 50 * ((i + 1) % 2)) for i in range(bends + 1)]
        segments = [(1, i, *(at[i] + at[i + 1] if i % 2 else at[i + 1] + at[i]), "red") for i in range(bends + 1)] + [(1, 90, 50.0, 5.0, 90.0, -80.0, "blue")]
        end = at[-1]
        solids = [(1, end[0] + 2, end[1] + 2, end[0] + 10, end[1] + 10), (1, 91.0, -85.0, 99.0, -79.0)] if bends else [(1, end[0] - 5, end[1] - 5, end[0] + 5, end[1] + 5), (1, end[0] - 50, end[1] - 50, end[0] + 50, end[1] + 50)]
        far = [(1, a + 9000, b, c + 9000, d) for _, a, b, c, d in solids]
        got = callouts.pointed_at(frame, spark.createDataFrame(segments, "page long, seg long, x0 double, y0 double, x1 double, y1 double, colour string"), spark.createDataFrame(solids[:1] + far if bends else solids, "page long, x0 double, y0 double, x1 double, y1 double")).collect()[0]
        assert got["binding"] == binding and (got["parts"] == bends + 1 or binding == "none")
        assert binding == "none" or got["sx0"] == solids[0][1]  # the smallest symbol there


def test_ties_are_taken_in_turn(spark):
    pairs = [(1, 1, 0.0, 10, 5.0), (1, 1, 0.0, 11, 9.0), (1, 2, 8.0, 10, 1.0), (1, 2, 8.0, 11, 4.0), (1, 3, 12.0, 10, 2.0), (1, 4, 500.0, 12, 0.0), (2, 5, 0.0, 20, 1.0)]
    got = schedules.taken_in_turn(spark.createDataFrame([(*p, 10.0) for p in pairs], "page long, bar long, bar_x double, tie long, d double, reach double"), "reach").collect()
    assert sorted(map(tuple, got)) == [(1, 10), (2, 11), (4, 12), (5, 20)]  # the third finds none left


def sheet(f, turned):
    """A small plan, scaled, with letters along y or, turned, along x."""
    place = lambda a, b: (b, a) if turned else (a, b)
    words, shapes, at = [], [], random.Random(9)
    for r in range(4):
        for c in range(5):
            x, y = c * 200 + 100, r * 160 + 100
            cx, cy = place(x + (60 if (r, c) == (2, 2) else 0), y)
            if (r, c) != (3, 3):
                shapes.append((1, f * (cx - 10), f * (cy - 10), f * (cx + 10), f * (cy + 10)))
            bx, by = place(x + (30 if c % 2 else -95), y + 18)
            if (r, c) not in ((0, 4), (1, 1)):
                for dx, dy, t in ((0, -10, "COL."), (25, -10, "20x30"), (0, 0, "ARM."), (25, 0, f"{4 + c}-25M"), (0, 10, "LIG."), (25, 10, "10M@150"), (0, 20, "BETON")):
                    words.append((1, len(words), t, f * (bx + dx), f * (by + dy), f * (bx + dx + 5 * len(t)), f * (by + dy + 8)))
    shapes += [(1, f * 300, f * 100, f * 480, f * 105), (1, f * 2000, f * 2000, f * 2020, f * 2020)]
    rows, cols = [("ABCD"[r], f * (r * 160 + 100.0)) for r in range(4)], [(str(c + 1), f * (c * 200 + 100.0)) for c in range(5)]
    at.shuffle(words)
    return words, shapes, [(1, "x" if turned else "y", rows, cols)]


def test_plan_columns_under_scale_and_turn(spark):
    results = []
    for f, turned in ((1.0, False), (3.0, False), (1.0, True)):
        words, shapes, grids = sheet(f, turned)
        made = (spark.createDataFrame(words, WORDS), spark.createDataFrame(shapes, "page long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(grids, "page long, letters_on string, rows array<struct<label:string,pos:double>>, cols array<struct<label:string,pos:double>>"))
        got = outlines.plan_columns(*made, heights(spark, 8.0 * f)).collect()
        results.append(sorted((r["cell"] or "", r["count"], r["size"], r["spacing_mm"], r["section_a"], round(r["conf"], 3) if r["conf"] is not None else None) for r in got))
    cells = [r[0] for r in results[0] if r[0]]
    assert len(results[0]) == 18 and len(set(cells)) == len(cells) and {"A-1", "C-2", "D-5"} <= set(cells) and "D-4" not in cells
    # each block its own column, but for the one without an outline and the one whose outline that takes: their sum is less so
    assert all(int(c[0][2:]) + 3 == c[1] for c in results[0] if c[0] not in ("B-2", "C-3"))
    assert results[0] == results[1] == results[2]


def test_a_line_printed_again_is_compared_too(spark):
    bar = "struct<note:string,role_hint:string,count:int,secondary_count:int,groups:int,size:string,spacing_mm:double,said:string>"
    b = lambda note, n, size, s, said, role=None: (note, role, n, None, None, size, s, said)
    plan = [b("p", 4, "25M", None, "ARM. 4-25M"), b("p", None, "10M", 150.0, "LIG. 10M @ 150")]
    shop = [b("s1", 4, "25M", None, "VERT: 4 25M"), b("s2", 6, "25M", None, "VERT: 6 25M"), b("s3", None, "10M", 150.0, "LIG. 10M @ 150"), b("s3", 9, "15M", None, "alone 9 15M")]
    df = spark.createDataFrame([("x", plan, shop)], f"id string, plan_bars array<{bar}>, shop_bars array<{bar}>")
    (got,) = compare_notes(df).collect()
    results = [(r["property"], r["plan"], r["shop"], r["result"]) for r in got["records"]]
    assert ("counted bars count", "4", "6", "different") in results and ("bars", None, "9 15M", "shop_only") in results
    assert got["status"] == "differs"
    (plain,) = compare_notes(df.select("id", *(F.transform(c, lambda x: x.dropFields("note", "said")).alias(c) for c in ("plan_bars", "shop_bars")))).collect()
    assert ("bars", None, "6 25M", "shop_only") in [(r["property"], r["plan"], r["shop"], r["result"]) for r in plain["records"]]


def member(key, cell, level, kind, count, spacing, type_key=None):
    bars = [("n" + key, "main", count, None, None, "25M", None, f"VERT {count} 25M"), ("n" + key, "ties", None, None, None, "10M", spacing, f"LIG 10M @ {spacing}")]
    return (key, cell, level, kind, type_key, bars, [(key, [x[1:] for x in bars])])


def test_findings_of_pairs_and_of_what_is_left(spark):
    bar = "role_hint:string,count:int,secondary_count:int,groups:int,size:string,spacing_mm:double,said:string"
    shape = f"cell string, level string, kind string, type_key string, bars array<struct<note:string,{bar}>>, said_by array<struct<id:string,bars:array<struct<{bar}>>>>"
    plan = [member(f"p{i}", f"A-{i}", "N1", "column", 4, 150.0, "C1") for i in range(7)] + [member("p7", "B-1", "N9", "column", 4, 150.0), member("p8", "B-2", None, "column", 4, 150.0), member("p9", "B-3", "N1", "column", 4, 150.0)]
    shop = [(*member(f"s{i}", f"A-{i}", "N1", "column", 8 if i < 4 else 4, 150.0 if i != 5 else 300.0, "C1" if i != 6 else "C2"), None, 3 if i == 4 else None, 1) for i in range(7)] + [(*member("s9", "Z-1", "N1", "wall", 4, 150.0), None, None, 1)]
    p, s = spark.createDataFrame(plan, f"note string, {shape}"), spark.createDataFrame(shop, f"slot string, {shape}, level_to string, quantity int, listed int")
    pairs = spark.createDataFrame([(f"p{i}", f"s{i}", 0.1 * i) for i in range(7)], "note string, slot string, cost double")
    found, groups = verdicts.build_findings(pairs, p, s, spark.createDataFrame([("p8",)], "note string"))
    got = {r["plan_note"] or r["shop_note"]: r for r in found.collect()}
    assert [r["finding"] for r in sorted(got.values(), key=lambda r: r["finding"])] == [f"F-{i:05d}" for i in range(1, 12)]
    assert [got[f"p{i}"]["finding"] for i in range(7)] == [f"F-{i + 1:05d}" for i in range(7)]
    assert [tuple(g) for g in groups.collect()] == [("G1", "counted bars count", verdicts.TWICE, 4)]
    assert [got[f"p{i}"]["status"] for i in range(7)] == ["uncertain"] * 4 + ["differs"] * 3  # a quantity, a spacing, a type
    assert got["p0"]["groups"] == ["G1"] and "at 4 places" in got["p0"]["notes"] and got["p0"]["identity"] == 5
    assert [got[k]["notes"] for k in ("p7", "p8", "p9", "s9")] == [verdicts.NO_DATA, verdicts.NO_LEVEL, verdicts.NOT_COVERED, verdicts.NO_PLAN]
    assert [got[k]["status"] for k in ("p7", "p8", "p9", "s9")] == ["not_in_shop"] * 3 + ["not_in_plan"]


def test_lines_count_as_often_as_the_note_that_says_most(spark):
    one = lambda n: ("main", n, None, None, "25M", None, f"{n} 25M")
    rows = [("a", "n1", [one(4), one(4), one(6)]), ("a", "n2", [one(4), one(8)]), ("a", "n3", [one(4), one(4), one(6)]), (None, "n4", [])]
    df = spark.createDataFrame(rows, "k string, id string, bars array<struct<role_hint:string,count:int,secondary_count:int,groups:int,size:string,spacing_mm:double,said:string>>")
    got = {r["k"]: r for r in verdicts.combined(df, ["k"]).collect()}
    assert [(b["note"], b["count"]) for b in got["a"]["bars"]] == [("n1", 4), ("n1", 4), ("n1", 6), ("n2", 8)] and [s["id"] for s in got["a"]["said_by"]] == ["n1", "n2"]
    assert got[None]["bars"] == []
