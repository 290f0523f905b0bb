"""What a sheet is: its number, title, type and the way it can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchyard.functions import text

# Words of titles and the type they stand for, and the types of sheet number series.
TITLE_WORDS = (
    ("RADIER", "fondation"), ("FONDATION", "fondation"), ("SEMELLE", "fondation"), ("FOUNDATION", "fondation"), ("FOOTING", "fondation"), ("POUTRE", "poutre"), ("BEAM", "poutre"),
    ("REFEND", "mur_refend"), ("CONTREVENTEMENT", "mur_refend"), ("MURS", "mur_refend"), ("WALL", "mur_refend"), ("DALLE", "dalle"), ("SLAB", "dalle"), ("ARMATURE DU NIVEAU", "dalle"),
    ("COLONNE", "colonne"), ("COLUMN", "colonne"),
)
SERIES = ((1, "fondation"), (3, "poutre"), (4, "mur_refend"), (5, "colonne"), (6, "dalle"))
MARKERS = ("TITRE DU DESSIN", "DRAWING TITLE", "TITLE")
TITLE_LENGTH = 160
LOST_TEXT = 0.5


def title(page_text: Column) -> Column:
    """The text after the first known marker of a title block, else empty."""

    def behind(t: Column) -> Column:
        out = F.when(F.lit(False), "")
        for m in MARKERS:
            out = out.when(F.instr(t, m) > 0, F.substring(t, F.instr(t, m) + len(m), F.lit(TITLE_LENGTH)))
        return out.otherwise("")

    return text.once(text.plain(page_text), behind)


def sheet_type(title: Column, sheet: Column) -> tuple[Column, Column]:
    """Type and confidence: of the word that comes first in the title, else of the sheet number's series."""
    found = sheet_type_of(title, sheet)
    return found["type"], found["confidence"]


def sheet_type_of(title: Column, sheet: Column) -> Column:
    """sheet_type() as one struct. A query that takes both from a column of it reads the title once."""
    first = lambda t: F.array_min(F.array_compact(F.array(*(F.when(F.instr(t, w) > 0, F.struct(F.instr(t, w).alias("at"), F.lit(k).alias("type"))) for w, k in TITLE_WORDS))))["type"]
    digit = text.part(F.coalesce(sheet, F.lit("")), r"(\d)\d\d", 1).cast("int")
    by_series = F.element_at(F.create_map(*(F.lit(x) for kv in SERIES for x in kv)), digit)
    said = lambda x: F.struct(F.coalesce(x["word"], x["series"]).alias("type"), F.when(x["word"].isNotNull(), 1.0).when(x["series"].isNotNull(), 0.7).otherwise(0.0).alias("confidence"))
    return text.once(F.struct(text.once(text.plain(title), first).alias("word"), by_series.alias("series")), said)


def sheet_number(words: DataFrame, pattern: str = r"^S-\d{3}$", right: float = 0.6, low: float = 0.7) -> DataFrame:
    """The sheet number of each page: of matching words in its lower right corner the lowest, then the rightmost,
    then the greatest.
    words: page, text, x0, y0, width, height."""
    corner = words.where(F.col("text").rlike(pattern) & (F.col("x0") > right * F.col("width")) & (F.col("y0") > low * F.col("height")))
    return corner.groupBy("page").agg(F.max_by("text", F.struct(F.round("y0").alias("y"), "x0", "text")).alias("sheet"))


def plan_reading(words: Column, layer: Column, vertical: Column, level: Column, has_grid: Column, enough: int = 10) -> Column:
    """How a plan page can be read, or why it can't."""
    return (
        F.when((words < enough) & layer.isin("vector", "image"), "needs_ocr").when(words < enough, "empty_page").when(vertical > LOST_TEXT, "rotated_text_unsupported")
        .when(level.isNull(), "not_a_column_plan").when(~has_grid, "plan_blocks_without_grid").otherwise("plan_outline")
    )


def level_anywhere(t: Column) -> Column:
    """The first level named in a text."""
    names = "|".join(n.replace(" ", r"\s+").replace("-", r"\-") for n, _ in sorted(text.LEVELS, key=lambda x: -len(x[0])))
    pattern = rf"\b(?:(?:{'|'.join(text.NUMBERED)})\s*\d{{1,2}}\b|(?:{names})(?:\s*-?\s*S?\d{{1,2}}\b)?)"
    return text.canonical_level(text.part(text.plain(t), f"({pattern})", 1))
