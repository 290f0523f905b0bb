"""Questions about close calls of the cost model, and what their answers do to costs and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchyard.operators.durable import settled
from matchyard.operators.graph import labelled
from matchyard.operators.matching import solved

# How clear a best candidate must be, and what an answer is worth.
CLEAR, YES, NO, UNSURE = 0.2, -0.3, 0.8, 0.5


def close_calls(edges: DataFrame) -> DataFrame:
    """note, slot, cost of the candidates to ask about: the best of each note whose best one is in another cell, or hardly
    cheaper than the next. edges: note, slot, cost, place (1 the best), same_cell, and next
    where it is known."""
    if "next" not in edges.columns:
        edges = edges.withColumn("next", F.lead("cost").over(Window.partitionBy("note").orderBy("place")))
    best = edges.where("place = 1")
    return best.where(~F.col("same_cell") | F.coalesce(F.col("next") - F.col("cost") < CLEAR, F.lit(False))).select("note", "slot", "cost")


def answered(edges: DataFrame, answers: DataFrame) -> DataFrame:
    """edges with costs after answers (note, slot, option, certainty): a yes takes off a share of its certainty (half where it
    isn't known), a no adds; any other option, and no answer, leave the cost."""
    a = answers.where("option in ('yes', 'no')").select("note", "slot", "option", "certainty")
    change = F.when(F.col("option") == "yes", YES * F.coalesce("certainty", F.lit(UNSURE))).when(F.col("option") == "no", NO).otherwise(0.0)
    out = edges.join(a, ["note", "slot"], "left")
    return out.withColumn("cost", F.round(F.col("cost") + change, 3)).withColumn("asked", F.col("option").isNotNull()).drop("option")


def assigned_after(edges: DataFrame, answers: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """note, slot, cost, certainty, method: the pairs after answers. Only components with an answered edge are solved again;
    the pairs of the others are those of `before` (solved here if not given). edges: note, slot, cost, and row and stretch where
    known (see matching.candidates), by which components are looked for."""
    near = tuple(c for c in ("row", "stretch") if c in edges.columns)
    e = labelled(answered(edges.select("note", "slot", "cost", *near), answers), "note", "slot", near).drop(*near)
    if before is None:
        pairs = solved(e)
    else:
        e = settled(e)
        touched = e.where("asked").select("component").distinct()
        rest = e.join(touched, "component", "left_anti").select("note").distinct()
        kept = before.select("note", "slot", "cost").join(rest, "note", "left_semi").withColumns({"certainty": F.lit(None).cast(e.schema["certainty"].dataType), "asked": F.lit(False)})
        pairs = solved(e.join(touched, "component", "left_semi")).select(*kept.columns).unionByName(kept)
    asked = F.col("asked")
    return pairs.select("note", "slot", "cost", F.when(asked, F.col("certainty")).alias("certainty"), F.when(asked, "assignment and answer").otherwise("assignment").alias("method"))
