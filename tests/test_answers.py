"""Answers about close calls change costs, and only the components that were asked about are paired anew."""

from matchyard.operators import answers, learned, near

EDGES = "note string, slot string, cost double"


def test_what_is_asked(spark):
    rows = [("a", "x", 0.1, 1, True), ("a", "y", 0.5, 2, False), ("b", "x", 0.1, 1, True), ("b", "y", 0.25, 2, True), ("c", "z", 1.0, 1, False), ("d", "w", 0.0, 1, True)]
    got = answers.close_calls(spark.createDataFrame(rows, f"{EDGES}, place int, same_cell boolean")).collect()
    assert sorted(r["note"] for r in got) == ["b", "c"]  # a is clear, d alone and in its cell


def test_answers_change_pairs_where_they_were_given(spark):
    edges = spark.createDataFrame([("a", "x", 0.3), ("a", "y", 0.5), ("b", "x", 0.6), ("b", "y", 0.9), ("c", "z", 0.2), ("d", "z", 0.4), ("e", "w", 0.7)], EDGES)
    none = spark.createDataFrame([], "note string, slot string, option string, certainty double")
    plain = answers.assigned_after(edges, none)
    assert {(r["note"], r["slot"]) for r in plain.collect()} == {("a", "y"), ("b", "x"), ("c", "z"), ("e", "w")}
    told = spark.createDataFrame([("a", "x", "yes", 1.0), ("b", "x", "no", None), ("e", "w", "unsure", 0.2)], none.schema)
    costs = {(r["note"], r["slot"]): r["cost"] for r in answers.answered(edges, told).collect()}
    assert costs["a", "x"] == 0.0 and costs["b", "x"] == 1.4 and costs["e", "w"] == 0.7 and costs["a", "y"] == 0.5
    assert [r["cost"] for r in answers.answered(edges, spark.createDataFrame([("a", "x", "yes", None)], none.schema)).where("slot = 'x' and note = 'a'").collect()] == [0.15]
    before = spark.createDataFrame([("d", "z", 9.0)], EDGES)  # not what would be solved, so it shows that it was kept
    got = {(r["note"], r["slot"]): r for r in answers.assigned_after(edges, told, before).collect()}
    assert set(got) == {("a", "x"), ("b", "y"), ("d", "z")}
    assert got["a", "x"]["method"] == "assignment and answer" and got["d", "z"]["method"] == "assignment"


def test_a_label_belongs_to_the_first_form(spark):
    lines = [(1, t) for t in ["CADRE: 10M@150"] * 3 + ["Cadre 4 25M B7"] * 4 + ["ÉPINE. 4-25M"] * 3 + ["ARM. 4-25M"] * 2 + ["RARE 4-25M"] * 2 + [None, "", "4-25M"]]
    got = learned.learned_labels(spark.createDataFrame(lines, "page long, text string")).collect()
    assert {(r["form"], r["label"], r["n"]) for r in got} == {("ties_line", "CADRE", 3), ("block_start", "ÉPINE", 3)}


def test_a_leader_outranks_distance(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    texts = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 8.0, 13), (2, 1, 500.0, 500.0, 520.0, 508.0, None), (3, 2, 0.0, 0.0, 5.0, 5.0, None)], f"text long, page long, {box}, leader long")
    drawings = spark.createDataFrame([(10, 1, "solid", 30.0, 0.0, 40.0, 8.0), (11, 1, "linework", 90.0, 0.0, 99.0, 8.0), (12, 1, "outline", -5.0, -5.0, 60.0, 60.0), (13, 1, "solid", 900.0, 0.0, 910.0, 9.0), (14, 1, "solid", 0.0, 40.0, 5.0, 45.0), (15, 1, "region", 590.0, 500.0, 999.0, 999.0)], f"drawing long, page long, shape string, {box}")
    got = near.drawing_candidates(texts, drawings, spark.createDataFrame([(1, 8.0), (2, 8.0)], "page long, h double")).orderBy("text", "place").collect()
    assert [(r["text"], r["drawing"], r["led"], r["inside"]) for r in got] == [(1, 13, True, False), (1, 12, False, True), (1, 10, False, False)]
