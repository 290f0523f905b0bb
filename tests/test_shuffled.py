"""What queries shuffle: right results that also leave records where they are."""

import pytest

from matchyard.operators import checks
from matchyard.plans import catalogue, findings  # noqa: F401  they register their queries

LARGER = "/root/testdata/sf0.1"


@pytest.fixture
def shuffled(spark):
    """Megabytes that are shuffled while a function runs."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite() / 1e6

    def run(f):
        before = written()
        f()
        return written() - before

    return run


def test_self_findings_leave_records_where_they_are(spark, shuffled):
    assert shuffled(lambda: catalogue.QUERIES["self_findings"](spark, LARGER).write.format("noop").mode("overwrite").save()) < 100


def test_a_comparison_shuffles_records_once_a_side(spark, shuffled):
    assert shuffled(lambda: catalogue.QUERIES["run_comparison"](spark, LARGER).write.format("noop").mode("overwrite").save()) < 150


def test_columns_of_the_record_come_with_its_checks(spark):
    said = "source string, id string, type string, level string, row string, col double, file int, page int, count int, size string, tie_size string, spacing_mm double, tie_count int, overall double"
    rows = [("shop", f"s{i}", "A", None if i == 2 else "", "K", 4.0, 1, i, 4 + i % 2, "25M", "10M", 150.0, None, 0.9) for i in range(4)] + [("shop", "z", "A", "N1", None, 4.0, 1, 9, 99, "25M", "10M", 150.0, None, 0.5)]
    e = spark.createDataFrame(rows, said)
    twice = {(r["first_id"], r["other_id"], r["level"], r["page"]) for r in checks.duplicate_conflicts(e, keep=("level", "page")).collect()}
    assert twice == {("s0", "s1", "", 0), ("s0", "s3", "", 0)}
    assert [(r["id"], r["failed"], r["level"]) for r in checks.plausibility(e, keep=("level",)).collect()] == [("z", "count_plausible", "N1")]
    alike = [("plan", f"p{i}", "A", "N1", "K", float(i), 1, 1, 6 if i == 3 else 4, "25M", "10M", 150.0, None, 0.9) for i in range(20)]
    assert [tuple(r) for r in checks.peer_outliers(spark.createDataFrame(alike, said), keep=("level", "col")).collect()] == [("p3", "count", "6", "4", 0.903, "N1", 3.0)]


def test_repeated_keys_met_by_a_shuffle_give_the_same(spark, monkeypatch):
    small = "/root/testdata/sf0.01"
    found = sorted(catalogue.QUERIES["duplicate_conflicts"](spark, small).collect())
    monkeypatch.setattr(checks, "SENT_TO_ALL", 0)
    assert found and sorted(catalogue.QUERIES["duplicate_conflicts"](spark, small).collect()) == found
