"""Labels that a document uses of its own, learnt from the standard notation behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchyard.functions.text import QUOTES, SIZE

# Forms of notation, the first that claims a label first, the words known already, and how often a label repeats.
LABEL, BETWEEN = r"([^\W\d_][\w.]*)", r"[\s:.\-]*"
FORMS = (
    ("ties_line", rf"{SIZE}\s*@"), ("shop_ties", rf"\d{{1,3}}\s*{SIZE}\s*[^\s@]+\s*@"), ("block_start", rf"\d{{1,2}}\s*-\s*{SIZE}\b"),
    ("section_line", rf"\d+(?:\.\d+)?\s*[{QUOTES}]?\s*[xX×]\s*\d"), ("elevation_line", r"\d+\s*'\s*-?\s*\d*"), ("shop_vert", rf"\d{{1,3}}\s*{SIZE}\s*[^\s@]+$"),
)
KNOWN = ("ARM", "REINF", "COL", "COLUMN", "LIG", "TIES", "STIRRUPS", "VERT", "ÉTRI", "ETRI", "STIRRUP", "EL")
LEAST, SHARE = 3, 0.3


def learned_labels(lines: DataFrame, known: tuple[str, ...] = KNOWN, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """page, form, label, n: words before a form of notation that repeat on a page, `least` times and in a share of the lines of
    that form, and that don't begin with a known word. A label belongs to the first form that it is learnt for: what stands
    before ties isn't learnt for bars as well. lines: page, text."""
    said = F.trim("text")
    each = F.array(*(F.struct(F.lit(name).alias("form"), F.lit(i).alias("nth"), F.regexp_extract(said, rf"(?U)^{LABEL}{BETWEEN}{shape}", 1).alias("label")) for i, (name, shape) in enumerate(FORMS)))
    found = lines.select("page", F.inline(each)).where("label <> ''")
    label = F.upper(F.regexp_replace("label", r"^[.:\- ]+|[.:\- ]+$", ""))
    counts = found.groupBy("page", "form", "nth", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("page", "form"))
    new = ~F.col("label").rlike(rf"^(?:{'|'.join(known)})") if known else F.lit(True)
    kept = counts.withColumn("total", total).where((F.col("n") >= least) & (F.col("n") >= share * F.col("total")) & (F.col("label") != "") & new)
    first = kept.groupBy("page", "label").agg(F.min_by(F.struct("form", "n"), "nth").alias("f"))
    return first.select("page", "f.form", "label", "f.n")
