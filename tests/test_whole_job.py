"""Engine operators over all of their input: what a bound once left out."""

import math
from collections import defaultdict

import pytest

from matchyard.operators import matching
from matchyard.plans import catalogue

DATA = "/root/testdata/sf0.001"

NOTE = "row string, col double, level string, kind string, bars array<struct<size:string,count:int,spacing_mm:double>>"


def test_every_pair_below_the_limit_is_a_candidate(spark):
    bars = [("25M", 4, 152.4)]
    columns = [5.4, 5.9, 30.0, 41.5]
    left = spark.createDataFrame([(f"n{c}", "K", c, "N1", "A", bars) for c in columns], "note string, " + NOTE)
    places = [3.45, 3.9, 7.0, 7.3, 7.8, 31.9, 32.1, 40.0, 43.4]
    right = spark.createDataFrame([(f"s{c}", "K", c, "N1", None, "A", bars) for c in places], "slot string, row string, col double, level string, level_to string, kind string, bars array<struct<size:string,count:int,spacing_mm:double>>")
    price = lambda d: (1.2 if d <= 1 else 2.0) - 0.35 + 0.075 * d
    want = {(f"n{a}", f"s{b}"): price(abs(a - b)) for a in columns for b in places if price(abs(a - b)) < 1.7995}
    got = {(r["note"], r["slot"]): r["cost"] for r in matching.candidates(left, right, best=99).collect()}
    assert set(got) == set(want) and ("n5.4", "s7.0") in got
    assert all(abs(got[k] - want[k]) < 0.0006 for k in want)


@pytest.fixture(scope="module")
def boxes(spark):
    pages = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey", "c_nationkey").collect():
        k = r[0]
        x, y = k * 37 % 900, k * 53 % 600
        pages[r[1]].append((k, x, y, x + 20 + k % 40, y + 10 + k % 30))
    return pages


def test_all_near_boxes_of_a_page_are_related(spark, boxes):
    def relation(p, q):
        dx, dy = max(0, q[1] - p[3], p[1] - q[3]), max(0, q[2] - p[4], p[2] - q[4])
        shared = max(0, min(p[3], q[3]) - max(p[1], q[1])) * max(0, min(p[4], q[4]) - max(p[2], q[2]))
        a, b = ((r[3] - r[1]) * (r[4] - r[2]) for r in (p, q))
        return math.hypot(dx, dy), shared / (a + b - shared), shared / a

    want = {(p[0], q[0]): relation(p, q) for page in boxes.values() for p in page for q in page if p[0] < q[0] and relation(p, q)[0] <= 50}
    got = {(r["a"], r["b"]): (r["gap"], r["overlap"], r["inside"]) for r in catalogue.QUERIES["box_relations"](spark, DATA).collect()}
    assert set(got) == set(want)
    assert all(abs(x - y) < 0.001 for k in want for x, y in zip(got[k], want[k]))


def test_points_in_any_region(spark, boxes):
    want = set()
    for k, c in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        x, y = k * 29 % 950, k * 61 % 650
        if any(b[1] <= x <= b[3] and b[2] <= y <= b[4] for b in boxes[c % 25]):
            want.add(k)
    got = [r["point"] for r in catalogue.QUERIES["points_in_regions"](spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sheet_number_of_all_words(spark, boxes):
    corner = {page: [(b[2], b[1], f"S-{b[0] % 1000:03d}") for b in rows if b[1] > 540 and b[2] > 420] for page, rows in boxes.items()}
    got = {r["page"]: r["sheet"] for r in catalogue.QUERIES["sheet_numbers"](spark, DATA).collect()}
    assert got == {page: max(rows)[2] for page, rows in corner.items() if rows}


def test_known_items_of_all_pages(spark):
    from matchyard.sources.adapters import elements

    rows = elements(spark, DATA).select("level", "row", "col").distinct().collect()
    wrong = {(r["level"], r["grid"]) for r in catalogue.QUERIES["cross_findings"](spark, DATA).collect() if r["status"] in ("non_compliant", "missing", "added")}
    places = {(r["level"], f"{r['row']}-{str(r['col']).removesuffix('.0')}") for r in rows}
    got = {(r["level"], r["grid"]): r["found"] for r in catalogue.QUERIES["known_items"](spark, DATA).collect()}
    assert got == {p: p in wrong for p in places}
