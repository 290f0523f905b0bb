"""Assignments over all candidates below the limit, however many an entity has."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchyard.operators import matching
from matchyard.plans import catalogue, findings  # noqa: F401  they register their queries

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date, l_returnflag string"


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """Four plan notes without a level beside one cell, whose four slots stand on four levels: each may take any of them."""
    row = lambda order, n, part, year: (order, n, part, 4, 1.0, 10.0, 0.0, 0.0, datetime.date(year, 1, 2), "A")
    plan = [row(6 + 7 * k, n, part, 1995) for k, (n, part) in enumerate([(1, 99), (5, 99), (5, 100), (1, 101)])]
    shop = [row(100 + k, 2, 100, 1992 + k) for k in range(4)]
    at = str(tmp_path_factory.mktemp("crowd"))
    spark.createDataFrame(plan + shop, LINE).write.parquet(f"{at}/lineitem.parquet")
    return at


def test_an_entity_may_take_its_fourth_candidate(spark, crowd):
    found = catalogue.QUERIES["build_findings"](spark, crowd)
    assert found.where("cost is not null").count() == 4
    assert found.where("status in ('not_in_shop', 'not_in_plan')").count() == 0


def test_candidates_without_a_cap(spark, crowd):
    bars = F.array(F.struct(F.lit("25M").alias("size"), F.lit(4).alias("count"), F.lit(152.4).alias("spacing_mm")))
    left = spark.range(1).select(F.lit("n").alias("note"), F.lit("K").alias("row"), F.lit(5.0).alias("col"), F.lit("N1").alias("level"), F.lit("A").alias("kind"), bars.alias("bars"))
    right = spark.range(9).select(F.format_string("s%d", "id").alias("slot"), F.lit("K").alias("row"), F.lit(5.0).alias("col"), F.lit("N1").alias("level"), F.lit(None).cast("string").alias("level_to"), F.lit("A").alias("kind"), bars.alias("bars"))
    assert matching.candidates(left, right).count() == matching.CANDIDATES
    assert matching.candidates(left, right, best=None, more=True).select("slot").distinct().count() == 9


def test_a_large_component_is_solved_over_its_edges(spark, monkeypatch):
    monkeypatch.setattr(matching, "with_opting_out", None)  # a table of all pairs isn't made
    n = 3_000
    rng = np.random.default_rng(8)
    edges = [(f"n{i:05d}", f"s{j:05d}", round(0.1 + 0.3 * abs(i - j) + rng.random() / 100, 3), "x") for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    taken = matching._solver(3, 0, 1, 2)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*edges)], names=["note", "slot", "cost", "component"])
    got = [r for b in taken([batch]) for r in b.to_pylist()]
    assert len(got) == n and all(r["note"][1:] == r["slot"][1:] for r in got)
