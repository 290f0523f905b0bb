"""Texts are read once: what a query takes of a text isn't read anew for each of its columns."""

import pytest
from pyspark.sql import functions as F

from matchyard.functions import freeform, sheets, statements, text


@pytest.fixture
def read(spark):
    """How often a pattern or plain text stands in a query's plan."""
    return lambda column, name: spark.createDataFrame([("x", "y")], "t string, u string").select(column.alias("x")).select("x.*")._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_patterns_stand_once_for_each_group(read):
    assert read(text.shop_bars_of(F.col("t"), text.TIE_WORDS), "regexp_extract(") <= 10  # a group stands twice, as an empty one is null
    assert read(text.section_of(F.col("t")), "regexp_extract(") <= 8
    assert read(text.size_spacing_of(F.col("t")), "regexp_extract(") <= 6
    assert read(sheets.sheet_type_of(sheets.title(F.col("t")), F.col("u")), "translate(") <= 2


def test_matches_of_a_text_are_looked_for_once(read):
    assert read(F.struct(statements.statements(F.col("t"))), "regexp_extract_all(") == 1


def test_equal_lines_are_read_once_in_a_batch(spark):
    rows = [(i, None if i % 5 == 4 else f"ARM: {4 + i % 2}-25M") for i in range(2_000)]
    lines = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r["id"]: (r["label"], [(b["count"], b["size"]) for b in r["bars"]], r["section"], r["strength"], r["rest"]) for r in freeform.read_lines(lines).collect()}
    assert got == {i: (None, [], None, None, "") if t is None else ("ARM", [(4 + i % 2, "25M")], None, None, "") for i, t in rows}


def test_lines_say_the_same_among_others_of_their_kind(spark):
    said = ["TIES. 10M @ 200mm c/c", "4(3)-20M 400x600mm 35 MPa", "", None, "3 15M B7-01", "3 15M B7-01", "nothing at all"]
    got = [r.asDict(recursive=True) for r in freeform.read_lines(spark.createDataFrame(list(enumerate(said)), "id int, text string")).orderBy("id").collect()]
    for t, r in zip(said, got):
        want = freeform.read_line(t)
        assert {k: r[k] for k in ("label", "section", "strength", "length_mm", "rest")} == {k: want[k] for k in ("label", "section", "strength", "length_mm", "rest")}
        assert [{k: v for k, v in b.items() if v is not None} for b in r["bars"]] == [{k: v for k, v in b.items() if v is not None} for b in want["bars"]]


def test_equal_texts_of_a_schedule_are_read_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from matchyard.functions import statements
    from matchyard.operators import schedules

    read = []
    keep = statements.specifications
    monkeypatch.setattr(statements, "specifications", lambda t: read.append(1) or keep(t))
    word = lambda x0, y0, text: F.struct(F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(0).alias("word"), F.lit(x0 + 90.0).alias("x1"), F.lit(y0 + 8.0).alias("y1"), F.lit(text).alias("text"))
    runs = spark.range(500).select(F.col("id").alias("page"), F.lit(8.0).alias("h"), F.array(word(5.0, 70.0, "2x4 25M B7.")).alias("words"), F.when(F.col("id") < 400, "2x4 25M B7.").when(F.col("id") < 450, "nothing").alias("text"), F.lit(5.0).alias("x0"), F.lit(70.0).alias("y0"))
    asked = []
    monkeypatch.setattr(schedules, "read_once", lambda rows, column, f, own=schedules.read_once: own(rows, column, lambda t: asked.append(t.count()) or f(t)))
    for most in (schedules.ONCE, 0):
        monkeypatch.setattr(schedules, "ONCE", most)
        found = schedules.located(runs)
        assert found.count() == 400 and {(r["count"], r["size"], r["line"]) for r in found.collect()} == {(4, "25M", 0)}
    assert asked == [2, 2]
