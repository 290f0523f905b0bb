"""Gridlines of a page: finding them among its labels, where a point lies between them, and elevation views."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchyard.operators.layout import clusters
from matchyard.operators.matching import letter_rank

# What a gridline's label looks like, and where between two lines a note may belong to either.
ROW_LABEL, COLUMN_LABEL = r"[A-Z]{1,2}(?:\.\d|')?", r"\d{1,2}(?:\.\d)?"
EITHER = (0.2, 0.8)
LEAST_LABELS = 4
TIGHT = 0.43


def around(points: DataFrame, axis: DataFrame) -> DataFrame:
    """Adds to points (point, page, v) the nearest line, the fraction of the way from the line below to the one above,
    and `other`, the second candidate of a point that lies well between two. axis: page, label, pos.

    Lines of a page are few: they come as one sorted array per page."""
    lines = axis.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("_lines"))
    p = points.join(lines, "page")
    low = F.try_element_at(F.filter("_lines", lambda a: a["pos"] <= F.col("v")), F.lit(-1))
    high = F.get(F.filter("_lines", lambda a: a["pos"] > F.col("v")), F.lit(0))
    p = p.withColumns({"_lo": low, "_hi": high})
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("v")
    nearer = F.when(lo.isNull(), hi["label"]).when(hi.isNull(), lo["label"]).when((v - lo["pos"] < hi["pos"] - v) | ((v - lo["pos"] == hi["pos"] - v) & (lo["label"] < hi["label"])), lo["label"]).otherwise(hi["label"])
    fraction = F.round((v - lo["pos"]) / (hi["pos"] - lo["pos"]), 3)
    out = p.withColumns({"nearest": nearer, "fraction": fraction})
    other = F.when(F.col("fraction").between(*EITHER), F.when(F.col("nearest") == hi["label"], lo["label"]).otherwise(hi["label"]))
    return out.withColumn("other", other).drop("_lines", "_lo", "_hi")


def alternative_cells(row: Column, other_row: Column, col: Column, other_col: Column) -> Column:
    """Cells that a note between gridlines may belong to beside the nearest one."""
    return F.array_compact(F.array(F.when(other_col.isNotNull(), F.concat_ws("-", row, other_col)), F.when(other_row.isNotNull(), F.concat_ws("-", other_row, col)), F.when(other_row.isNotNull() & other_col.isNotNull(), F.concat_ws("-", other_row, other_col))))


def snap_confidence(d: Column, runner_up: Column, tolerance: float) -> Column:
    """1 close to a line, else how much farther the runner-up is; null out of reach."""
    margin = F.when(runner_up.isNull(), 1.0).when(runner_up > 0, (runner_up - d) / runner_up).otherwise(0.0)
    return F.when(d > tolerance, F.lit(None)).when(d < TIGHT * tolerance, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), margin), 3))


def longest_run(values: Column) -> Column:
    """Length of the longest subsequence of an array that only rises or only falls; 0 for an empty one.

    For each value in turn the best run that ends in it: one longer than the best among lower values before it."""
    state = "array<struct<v:double,n:int>>"

    def rising(array: Column) -> Column:
        step = lambda seen, v: F.concat(seen, F.array(F.struct(v.alias("v"), (F.coalesce(F.array_max(F.transform(F.filter(seen, lambda x: x["v"] < v), lambda x: x["n"])), F.lit(0)) + 1).alias("n"))))
        return F.aggregate(array, F.array().cast(state), step, lambda seen: F.coalesce(F.array_max(F.transform(seen, lambda x: x["n"])), F.lit(0)))

    return F.greatest(rising(values.cast("array<double>")), rising(F.transform(values, lambda v: -v).cast("array<double>")))


def fit(words: DataFrame, tolerance: float, apart: float = 200.0) -> DataFrame:
    """Gridlines of each page: page, letters_on (the axis along which letters run), axis (row, column), label, pos.

    words: page, text, cx, cy. Rows are letters and columns small numbers. Both ways of drawing are tried: labels that
    stand in one line are clustered, a line is scored by its longest ordered run, by its labels that come again at the
    opposite edge, and by its size, and the way whose best lines score more wins. Pages with fewer than four labels of a
    kind have no grid. Labels of a page are few; everything else is grouped and windowed."""
    text = F.col("text")
    kind = F.when(text.rlike(f"^(?:{ROW_LABEL})$"), "row").when(text.rlike(f"^(?:{COLUMN_LABEL})$"), "column")
    labels = words.select("page", "text", "cx", "cy", kind.alias("axis")).where("axis is not null")
    labels = labels.groupBy("page", "text", "cx", "cy", "axis").agg(F.count(F.lit(1)).alias("times"))  # a label drawn twice at one place is one
    labels = labels.withColumn("value", F.when(F.col("axis") == "row", letter_rank(text)).otherwise(text.cast("double")))
    labels = labels.withColumn("letters_on", F.explode(F.array(F.lit("x"), F.lit("y"))))
    upright = (F.col("axis") == "row") == (F.col("letters_on") == "y")  # a vertical line of labels
    labels = labels.withColumns({"across": F.when(upright, F.col("cx")).otherwise(F.col("cy")), "along": F.when(upright, F.col("cy")).otherwise(F.col("cx"))})
    way = ["page", "letters_on", "axis"]
    lined = clusters(labels, way, "across", tolerance)
    other = labels.select(*way, "value", F.col("across").alias("_a"), F.col("along").alias("_p"))
    twins = lined.join(other, [*way, "value"]).where((F.abs(F.col("_a") - F.col("across")) >= apart) & (F.abs(F.col("_p") - F.col("along")) <= tolerance))
    twins = twins.groupBy(*way, "cluster").agg(F.count_distinct("value").alias("twins"))
    lines = lined.groupBy(*way, "cluster").agg(F.sort_array(F.collect_list(F.struct("along", "across", "value", "text"))).alias("labels"), F.sum("times").alias("times")).join(twins, [*way, "cluster"], "left")
    score = F.struct(longest_run(F.col("labels.value")).alias("run"), F.coalesce("twins", F.lit(0)).alias("twins"), F.col("times").alias("n"), (-F.col("cluster")).alias("first"))
    best = lines.groupBy(*way).agg(F.max(F.struct(score.alias("score"), "labels")).alias("b")).select(*way, "b.score", "b.labels")
    enough = F.size(F.array_distinct("labels.text")) >= LEAST_LABELS
    pages = best.groupBy("page", "letters_on").agg(*(F.sum(f"score.{c}").alias(c) for c in ("run", "twins", "n")), F.count_if(enough).alias("kinds")).where("kinds = 2")
    chosen = pages.groupBy("page").agg(F.max(F.struct("run", "twins", "n", "letters_on")).alias("w")).select("page", "w.letters_on")
    each = best.join(chosen, ["page", "letters_on"]).select("page", "letters_on", "axis", F.posexplode("labels").alias("k", "label"))
    first = each.groupBy("page", "letters_on", "axis", F.col("label.text").alias("text")).agg(F.min_by(F.col("label.along"), "k").alias("pos"), F.first("label.value").alias("value"))
    name = F.when(F.col("axis") == "row", F.col("text")).otherwise(F.regexp_replace(F.col("value").cast("string"), r"\.0$", ""))
    return first.select("page", "letters_on", "axis", name.alias("label"), F.round("pos", 2).alias("pos"))


def views(lines: DataFrame) -> DataFrame:
    """Elevation views of a page: its level lines from top to bottom, a new view where the elevation rises or a level
    comes again. lines: page, y, level, elevation_mm. Adds `view`, from 0. What was seen in a view decides where the next
    begins, so a page is read in order."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "level"])
        numbers, seen, last = [], set(), None
        for level, height in zip(frame.level, frame.elevation_mm):
            rises = last is not None and last == last and height is not None and height == height and height > last
            if numbers and (rises or level in seen):
                seen = set()
                numbers.append(numbers[-1] + 1)
            else:
                numbers.append(numbers[-1] if numbers else 0)
            seen.add(level)
            last = height
        return frame.assign(view=numbers)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    return lines.groupBy("page").applyInPandas(one, f"{schema}, view int")


def level_in_view(lines: list[tuple[float, str, int]], y: float) -> str:
    """Level at height y among (y, level, view): between two lines the lower one's, below the last FDN, above all UNKNOWN."""
    owner = None
    for _, group in groupby(lines, key=lambda x: x[2]):
        group = list(group)
        if group[0][0] <= y:
            owner = group
    if owner is None:
        return "UNKNOWN"
    return next((b[1] for a, b in zip(owner, owner[1:]) if a[0] <= y < b[0]), "FDN")
