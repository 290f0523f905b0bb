"""Which drawings a text may describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchyard.operators.geometry import gap

# How far each shape may be, in text heights, and how many are asked about.
REACH, OTHER_REACH, MOST = {"solid": 14.0, "outline": 14.0, "linework": 8.0, "region": 8.0}, 8.0, 3
#: Longest reaches that the side of a cell measures.
PER_CELL = 4


def drawing_candidates(texts: DataFrame, drawings: DataFrame, heights: DataFrame, most: int = MOST) -> DataFrame:
    """text, drawing, distance, led, inside, place: the drawing that a text's leader reaches, then the nearest ones within their
    shape's reach, `most` in all.

    A text in an outline is at no distance from it. texts: text, page, x0, y0, x1, y1, leader (a drawing or null); drawings:
    drawing, page, shape, x0, y0, x1, y1. Both are dealt into cells of a few of the longest reach, so that most are in one or two:
    a drawing into all that it covers, a text into those that its reach touches. A pair that shares several meets in the first."""
    far = max(REACH.values()) * F.col("h")
    size = heights.withColumn("cell", PER_CELL * far)
    at = lambda c, pad=0.0: F.floor((F.col(c) + pad) / F.col("cell"))
    span = lambda low, high, pad: F.explode(F.sequence(at(low, -pad), at(high, pad)))
    box = lambda df, p: df.withColumnsRenamed({c: f"{p}{c}" for c in ("x0", "y0", "x1", "y1")})
    t, d = box(texts, "t_"), box(drawings, "d_")
    reach = F.lit(OTHER_REACH)
    for shape, most_away in REACH.items():
        reach = F.when(F.col("shape") == shape, most_away).otherwise(reach)
    asked = t.join(size, "page").withColumn("i", span("t_x0", "t_x1", far)).withColumn("j", span("t_y0", "t_y1", far))
    placed = d.join(size.select("page", "cell"), "page").withColumn("i", span("d_x0", "d_x1", F.lit(0.0))).withColumn("j", span("d_y0", "d_y1", F.lit(0.0))).drop("cell")
    cx, cy = (F.col("t_x0") + F.col("t_x1")) / 2, (F.col("t_y0") + F.col("t_y1")) / 2
    inside = (F.col("shape") == "outline") & cx.between(F.col("d_x0"), F.col("d_x1")) & cy.between(F.col("d_y0"), F.col("d_y1"))
    first = (F.col("i") == F.greatest(at("t_x0", -far), at("d_x0"))) & (F.col("j") == F.greatest(at("t_y0", -far), at("d_y0")))
    near = asked.join(placed, ["page", "i", "j"]).where(first).withColumns({"away": gap("t_", "d_"), "inside": inside}).where((F.col("away") <= reach * F.col("h")) & ~F.col("leader").eqNullSafe(F.col("drawing")))
    near = near.select("text", "drawing", F.when(F.col("inside"), 0.0).otherwise(F.col("away")).alias("distance"), F.lit(False).alias("led"), "inside")
    led = t.where("leader is not null").join(d.drop("page"), F.col("leader") == F.col("drawing")).select("text", "drawing", gap("t_", "d_").alias("distance"), F.lit(True).alias("led"), F.lit(False).alias("inside"))
    order = Window.partitionBy("text").orderBy(~F.col("led"), "distance", "drawing")
    return led.unionByName(near).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
