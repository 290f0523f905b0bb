"""Findings of the cost model's path: what needn't be shuffled isn't."""

import pytest
from pyspark.sql import functions as F

from matchyard.operators import verdicts

NOTE = "cell string, id string, bars array<struct<size:string,count:int>>, kind string"


@pytest.fixture(scope="module")
def notes(spark):
    a, b = {"size": "25M", "count": 4}, {"size": "10M", "count": None}
    rows = [("K", "n2", [a, a, b], "late"), ("K", "n1", [b, a], "first"), ("K", "n3", [b, a], "copy"), ("K", "n4", None, "none"), ("L", "m1", None, "lone")]
    return spark.createDataFrame(rows, NOTE)


def test_lines_of_a_member_are_told_from_two_shuffles(spark, notes):
    whole = verdicts.combined(notes, ["cell"], ("kind",))
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    got = {r["cell"]: r for r in whole.collect()}
    assert [(x["note"], x["size"], x["count"]) for x in got["K"]["bars"]] == [("n1", "10M", None), ("n1", "25M", 4), ("n2", "25M", 4)]
    assert [x["id"] for x in got["K"]["said_by"]] == ["n1", "n2", "n4"] and got["K"]["kind"] == "first"
    assert got["L"]["bars"] == [] and got["L"]["kind"] == "lone"


def test_a_member_with_many_notes_is_quick(spark):
    import time

    bar = F.struct(F.lit("25M").alias("size"), F.col("id").cast("int").alias("count"))
    many = spark.range(40_000).select(F.lit("K").alias("cell"), F.format_string("n%06d", "id").alias("id"), F.array(bar).alias("bars"))
    began = time.time()
    got = verdicts.combined(many, ["cell"]).select(F.size("bars").alias("n"), F.get("bars", F.lit(39_999))["note"].alias("last")).collect()
    assert [tuple(r) for r in got] == [(40_000, "n039999")]
    assert time.time() - began < 40


def test_rows_with_and_without_a_pair(spark, monkeypatch):
    rows = spark.range(100).select(F.format_string("n%02d", "id").alias("note"), "id")
    pairs = rows.where("id % 7 = 0").select("note")
    for most in (verdicts.HASHES, 3):
        monkeypatch.setattr(verdicts, "HASHES", most)
        may, alone = verdicts.split(rows, "note", pairs)
        assert {r["id"] for r in alone.collect()} == {i for i in range(100) if i % 7} and alone.columns == rows.columns
        assert {r["id"] for r in may.join(pairs, "note").collect()} == {i for i in range(100) if i % 7 == 0}
    assert may.count() == 100  # too many hashes: all are shuffled


def test_a_text_meets_a_drawing_once_however_many_cells_they_share(spark):
    from matchyard.operators import near

    box = "x0 double, y0 double, x1 double, y1 double"
    texts = spark.createDataFrame([(1, 1, 100.0, 100.0, 3000.0, 3000.0, None)], f"text long, page long, {box}, leader long")
    drawings = spark.createDataFrame([(10, 1, "solid", 50.0, 0.0, 2500.0, 2900.0), (11, 1, "solid", -2000.0, 150.0, 90.0, 160.0), (12, 1, "linework", 3065.0, 10.0, 3080.0, 3000.0)], f"drawing long, page long, shape string, {box}")
    found = near.drawing_candidates(texts, drawings, spark.createDataFrame([(1, 8.0)], "page long, h double"), most=9)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()  # nothing is shuffled to be told apart
    assert [(r["drawing"], r["distance"]) for r in found.orderBy("place").collect()] == [(10, 0.0), (11, 10.0)]


def test_written_tables_are_compressed_well(spark):
    from matchyard.operators import durable

    kept = durable.settled(spark.range(10))
    assert kept.count() == 10 and all(f.endswith(".zstd.parquet") for f in kept.inputFiles())
