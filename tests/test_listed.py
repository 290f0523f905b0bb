"""Orders of lists when ids repeat."""

from matchyard.operators import findings


def test_findings_of_one_id_are_numbered_alike_whatever_their_order(spark):
    rows = [("F-1", "missing"), ("F-1", "compliant"), ("F-0", "added"), ("F-2", "non_compliant")]
    numbers = lambda r: {(x.id, x.status): x.number for x in findings.list_order(spark.createDataFrame(r, "id string, status string").coalesce(1)).collect()}
    found = numbers(rows)
    assert found == numbers(rows[::-1])
    assert found == {("F-2", "non_compliant"): "0000001", ("F-0", "added"): "0000002", ("F-1", "compliant"): "0000003", ("F-1", "missing"): "0000004"}
