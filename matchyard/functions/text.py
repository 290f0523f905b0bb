"""Notation read from text by column expressions. Null where the text doesn't hold it.

Patterns begin with (?U) where letters or digits of other scripts must count as in the notation's own rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchyard import schema as S

# What the notation consists of.
SIZE = r"(?:10|15|20|25|30|35)M"
QUOTES = "\"'”″’′"
LEVELS = (
    ("SOUS-SOL", "SS"), ("BASEMENT", "SS"), ("REZ-DE-CHAUSSEE", "RDC"), ("RDC", "RDC"), ("FDN", "FDN"), ("SS", "SS"),
    ("GROUND FLOOR", "RDC"), ("GROUND", "RDC"), ("TREFOND", "FDN"), ("TOIT APPENTIS", "TOIT_APP"), ("TOIT", "TOIT"), ("ROOF", "TOIT"),
)
NUMBERED = ("NIVEAU", "LEVEL", "FLOOR", "NIV")
SECTION_WORDS = ("COLUMN", "COL")
VERTICAL_WORDS, TIE_WORDS = ("VERT",), ("ÉTRI", "ETRI", "TIES", "STIRRUP")
BARE_MM_FROM = 30.0
CONFUSED = (("O", "0"), ("I", "1"), ("l", "1"), ("S", "5"), ("B", "8"), ("Z", "2"))


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null if there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def once(value: Column, read) -> Column:
    """read(value), where the value is computed once, however often read() names it."""
    return F.get(F.transform(F.array(value), read), F.lit(0))


def millimetres(value: Column, unit: Column, default: str | None = None) -> Column:
    u = F.lower(F.coalesce(unit, F.lit(default)) if default else unit)
    factor = F.when(u == "mm", 1.0).when(u == "cm", 10.0).when(u == "m", 1000.0).when(u.isin("ft", "'", "′", "’"), S.FOOT_MM).when(u.isin("in", '"', "″", "”"), S.INCH_MM)
    return F.round(value * factor, 3)


def bare_spacing(value: Column, unit: Column) -> Column:
    """Millimetres of a bar spacing: a quote means inches, and so does a bare number below 30."""
    u = F.lower(unit)
    inches = F.round(value * S.INCH_MM, 3)
    return F.when(u == "mm", value).when(u == "cm", F.round(value * 10.0, 3)).when(u.isNotNull(), inches).when(value >= BARE_MM_FROM, value).otherwise(inches)


def count_size(text: Column) -> tuple[Column, Column]:
    """`4-25M`: count and size."""
    pattern = rf"(?U)(?<!\d)(\d{{1,2}})\s*-\s*({SIZE})\b"
    return part(text, pattern, 1).cast("int"), F.upper(part(text, pattern, 2))


def first_of(text: Column, sign: str, read) -> Column:
    """What read(before, behind) makes of the first place of `sign` where it makes something: a text is cut at every place of
    the sign, and read() gets the pieces on both sides of each."""

    def of(pieces: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: read(F.get(pieces, i - 1), F.get(pieces, i)))
        return F.when(F.size(pieces) > 1, F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0)))

    return once(F.split(text, sign, -1), of)


def first_word(words: tuple[str, ...]) -> str:
    return rf"(?iu)(?:{'|'.join(sorted(words, key=len, reverse=True))})"


# How numbers and the units behind them are written.
NUMBER, SPACING_UNIT = r"\d+(?:\.\d+)?", rf"mm|cm|[{QUOTES}]{{1,2}}"


def fields(text: Column, pattern: str, *kinds: str) -> list[Column]:
    """The groups of an anchored pattern, cast; null where the pattern doesn't fit."""
    return [part(text, pattern, i + 1).try_cast(kind) for i, kind in enumerate(kinds)]


def size_spacing(text: Column) -> tuple[Column, Column]:
    """`10M@6"`: a size before a sign and a length behind it, in mm."""
    found = size_spacing_of(text)
    return found["size"], found["spacing_mm"]


def size_spacing_of(text: Column) -> Column:
    """size_spacing() as one struct. A query that takes both from a column of it reads the text once."""

    def read(before: Column, behind: Column) -> Column:
        size = part(F.upper(F.rtrim(before)), f"({SIZE})$", 1)
        value, unit = fields(behind, rf"(?i)^\s*({NUMBER})\s*({SPACING_UNIT})?", "double", "string")
        said = lambda x: F.when(x["size"].isNotNull() & x["v"].isNotNull(), F.struct(x["size"].alias("size"), bare_spacing(x["v"], x["u"]).alias("spacing_mm")))
        return once(F.struct(size.alias("size"), value.alias("v"), unit.alias("u")), said)

    return first_of(text, "@", read)


def section(text: Column) -> tuple[Column, Column]:
    """`COL. 18"x20"`: both sides in mm; inches unless mm is written behind the second."""
    found = section_of(text)
    return found["a"], found["b"]


def section_of(text: Column) -> Column:
    """section() as one struct: a, b. A query that takes both from a column of it reads the text once."""
    pattern = rf"(?i)^\.?\s*({NUMBER})\s*[{QUOTES}]?\s*[x×]\s*({NUMBER})\s*(mm)?"

    def read(_: Column, behind: Column) -> Column:
        def sides(b: Column) -> Column:
            a, _, unit = fields(behind, pattern, "double", "double", "string")
            factor = F.when(unit.isNotNull(), 1.0).otherwise(S.INCH_MM)
            return F.when(b.isNotNull(), once(factor, lambda f: F.struct(F.round(a * f, 3).alias("a"), F.round(b * f, 3).alias("b"))))

        return once(fields(behind, pattern, "string", "double")[1], sides)

    return first_of(text, first_word(SECTION_WORDS), read)


def elevation(text: Column) -> Column:
    """`12.50 m`, `3500 mm` or `143' - 3"` in mm: a foot mark anywhere decides which way it is written."""

    def feet(before: Column, behind: Column) -> Column:
        whole = part(F.rtrim(before), r"(\d+)$", 1).cast("double")
        (inches,) = fields(behind, rf"^\s*-?\s*({NUMBER})", "double")
        return F.round(whole * S.FOOT_MM + F.coalesce(inches, F.lit(0.0)) * S.INCH_MM, 3)

    value, unit = fields(text, rf"(-?{NUMBER})\s*(mm|m)\b", "double", "string")
    metric = F.round(F.when(unit == "mm", value).otherwise(value * 1000.0), 3)
    return F.when(F.contains(text, F.lit("'")), first_of(text, "'", feet)).otherwise(metric)


def shop_bars(text: Column, words: tuple[str, ...]) -> dict[str, Column]:
    """`VERT: 4 25M B7-01`: count, size, mark, and spacing if it is printed behind a sign. Count and size may touch."""
    found = shop_bars_of(text, words)
    return {k: found[k] for k in ("count", "size", "mark", "spacing_mm")}


def shop_bars_of(text: Column, words: tuple[str, ...]) -> Column:
    """shop_bars() as one struct. A query that takes its fields from a column of it reads the text once."""
    bars = rf"(?i)^\.?:?\s*(\d{{1,3}})\s*({SIZE})\s*([^\s@]+)(?:\s*@\s*({NUMBER})\s*({SPACING_UNIT})?)?"

    def read(_: Column, behind: Column) -> Column:
        def said(count: Column) -> Column:
            _, size, mark, value, unit = fields(behind, bars, "int", "string", "string", "double", "string")
            spacing = once(F.struct(value.alias("v"), unit.alias("u")), lambda x: F.when(x["v"].isNotNull(), bare_spacing(x["v"], x["u"])))
            return F.when(count.isNotNull(), F.struct(count.alias("count"), F.upper(size).alias("size"), mark.alias("mark"), spacing.alias("spacing_mm")))

        return once(fields(behind, bars, "int")[0], said)

    return first_of(text, first_word(words), read)


def grid_label(text: Column) -> tuple[Column, Column]:
    """`J.5-12`: row and column. A leading zero makes it a mark, not a cell."""
    pattern = r"^([A-Z]{1,2}(?:\.\d|')?)-([1-9]\d?(?:\.\d)?)$"
    return part(F.trim(text), pattern, 1), part(F.trim(text), pattern, 2).cast("double")


def parse_cell(cell: Column) -> tuple[Column, Column]:
    pattern = r"^(.+)-(\d+(?:\.\d+)?)$"
    return part(cell, pattern, 1), part(cell, pattern, 2).cast("double")


def base_row(row: Column) -> Column:
    """The row letter without decimal and prime."""
    return F.regexp_replace(F.regexp_replace(row, r"\..*$", ""), r"'+$", "")


def plain(text: Column) -> Column:
    """Upper case without French accents, trimmed."""
    return F.trim(F.translate(F.upper(text), "ÀÂÄÇÉÈÊËÎÏÔÖÙÛÜ", "AAACEEEEIIOOUUU"))


def canonical_level(text: Column) -> Column:
    """SS, RDC, N2 and so on, TOIT; null if the text doesn't begin with a level's name. Longer names come first."""
    t = plain(text)
    out = F.when(t.rlike(rf"^(?:{'|'.join(NUMBERED)})\s*\d{{1,2}}\b"), F.concat(F.lit("N"), part(t, rf"^(?:{'|'.join(NUMBERED)})\s*(\d{{1,2}})\b", 1).cast("int").cast("string")))
    for name, level in sorted(LEVELS, key=lambda x: -len(x[0])):
        value = F.lit(level)
        if level == "SS":  # the first basement is plain, deeper ones keep a number
            deep = part(t, rf"^{name}\s*-?\s*S?(\d{{1,2}})\b", 1).cast("int")
            value = F.when(deep > 1, F.concat(F.lit("SS"), deep.cast("string"))).otherwise("SS")
        out = out.when(t.startswith(name), value)
    return out


def snap_size(token: Column) -> Column:
    """A bar size misread by character recognition, repaired only if the repair is a known size."""
    fixed = F.upper(F.translate(token, "".join(a for a, _ in CONFUSED), "".join(b for _, b in CONFUSED)))
    return F.when(F.upper(token).isin(*S.BAR_SIZES), F.upper(token)).when(fixed.isin(*S.BAR_SIZES), fixed).otherwise(token)


def clip(text: Column, n: int) -> Column:
    """At most n characters, white space collapsed, an ellipsis for the rest."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def quantity_line(text: Column) -> Column:
    """How many pieces a line asks for: a number and then a word for it."""
    return part(F.upper(F.trim(text)), r"^(\d+)\s*(?:REQUIS|REQ|QTY|PCS)\b", 1).try_cast("int")


def scale_of(text: Column) -> Column:
    """`ECHELLE: 1:50`: the ratio behind a word for scale."""
    word = part(plain(text), r"(?:ECHELLE|ECH|SCALE)[\s.:]*(1\s*[:/]\s*\d+)", 1)
    return F.trim(word)
