"""Scores of how far a record can be trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchyard import schema as S


def attribute(confidence: Column, text_source: Column, ocr: Column, snapped: Column, status: Column) -> Column:
    """Confidence of one attribute; a missing one has 0.3."""
    score = confidence * F.when(text_source == "ocr", F.coalesce(ocr, F.lit(1.0))).otherwise(1.0)
    score = score * F.when(snapped, S.SNAPPED_FACTOR).otherwise(1.0) * F.when(status == "derived", S.DERIVED_FACTOR).otherwise(1.0)
    return F.when(status == "missing", 0.3).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3))


def location(page: Column, grid: Column, anchor: Column, margin: Column, first_pass: Column) -> Column:
    floor = F.when(first_pass, 0.75).otherwise(0.6)
    factor = F.element_at(F.create_map(*(F.lit(x) for kv in S.ANCHOR_FACTORS.items() for x in kv)), anchor)
    return F.round(page * grid * factor * F.coalesce(floor + (1 - floor) * margin, F.lit(1.0)), 3)


def overall(parts: Column, failed: Column) -> Column:
    """The weakest part, less for each failed check; with a failed check never enough for a verdict."""
    factor = F.greatest(F.lit(S.FAILED_FLOOR), F.pow(F.lit(S.FAILED_FACTOR), failed))
    score = F.round(F.array_min(parts) * factor, 3)
    return F.when(failed > 0, F.least(score, F.lit(round(S.TRUST_FOR_VERDICT - 0.01, 3)))).otherwise(score)


def rank_certainty(options: Column, chosen: Column) -> Column:
    """Share of the chosen option among options with log-probabilities (array of option, logprob), renormalised."""
    p = lambda keep: F.aggregate(F.filter(options, keep), F.lit(0.0), lambda a, x: a + F.exp(x["logprob"]))
    return F.round(p(lambda x: x["option"] == chosen) / F.nullif(p(lambda x: F.lit(True)), F.lit(0.0)), 6)
