"""Free-form notes: what a printed line says about bars, sections, strengths and lengths.

A line is scanned once into typed tokens. Their types, a letter each, make a short word, in which the grammar finds phrases
from left to right; a phrase becomes a statement, and tokens in no phrase are the rest of the line. Lines are read in
Arrow batches: the grammar needs what was read before, which a column expression can't keep."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from matchyard import schema as S

# The notation that lines are written in.
ROLES = (("dowel", ("gouj", "dowel", "tige", "attente")), ("main", ("arm", "vert", "long", "main", "reinf", "bars")), ("ties", ("lig", "etri", "étri", "tie", "stirrup", "cadre", "trans")))
QUALIFIERS = ("each way", "both ways", "chaque sens", "dans les deux sens", "e.w.", "typ.", "typ", "c/c", "o.c.")
LENGTHS = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "ft": S.FOOT_MM, "'": S.FOOT_MM}
LABEL_LENGTH, LABEL_WORDS, PLAUSIBLE_COUNT, BARE_MM_FROM = 24, 3, 60, 30
BARS = "array<struct<role_hint:string,count:int,secondary_count:int,groups:int,size:string,spacing_mm:double,mark:string,suspect:int>>"
LINES = f"label string, bars {BARS}, section array<double>, strength int, length_mm double, rest string"

#: Types of tokens, tried in this order: Qualifier, Size, Mark, Number, stress (G), Unit, times (X), then names and signs.
TOKENS = {
    "Q": "|".join(rf"(?<!\w){re.escape(q)}(?!\w)" for q in QUALIFIERS),
    "S": r"\d{1,2}M(?!\w)|\#\d{1,2}(?!\w)|[ØøΦ⌀]\s?\d{1,3}(?:\.\d+)?(?:\s?mm)?",
    "M": r"\d{2}[A-Z]{1,2}[\dX]{1,6}(?:-\d{1,2})?(?!\w)",
    "N": r"\d+(?:\.\d+)?(?=$|[^\w.]|\.(?!\d)|[xX×]\s*\d|(?:mm|cm|m|in|ft|mpa)(?!\w))",
    "G": r"mpa(?!\w)",
    "U": r"(?:mm|cm|m|in|ft)(?!\w)|''|[\"”″“']",
    "X": r"[xX×](?=\s*[\d\#ØøΦ⌀])",
    "W": r"[A-Za-z]\w*(?:[-.]\w+)*",
    "A": "@", "P": r"\+", "D": "[-–]", "L": r"\(", "R": r"\)",
    "O": r"\w+|\S",
}
SCANNER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in TOKENS.items()), re.I)
#: Phrases over the types, the first that fits at a place is taken. Their order among statements is that of SAID_FIRST.
GRAMMAR = [
    (name, re.compile(shape))
    for name, shape in (
        ("summed", "NPNS"), ("grouped", "NXNSW?"), ("counted", "N(?:LNR)?[DX]S"), ("section", "NU?XNU?"), ("pair", "NLNR(?!D)"), ("listed", "NSW?"),
        ("spaced", "SANU?"), ("spacing", "ANU?"), ("marked", "NM"), ("mark", "M"), ("strength", "NG"), ("length", "NU"), ("qualifier", "Q"),
    )
]
SAID_FIRST = {name: i for i, name in enumerate(("spaced", "counted", "grouped", "summed", "listed", "marked", "mark", "pair"))}


def millimetres(value: float, unit: str) -> float:
    return round(value * LENGTHS.get(unit.lower(), S.INCH_MM), 3)


def spacing(value: str, unit: str | None) -> float:
    return millimetres(float(value), unit or ("in" if float(value) < BARE_MM_FROM else "mm"))


def role_of(label: str | None) -> str | None:
    low = (label or "").lower().strip(" .:")
    return next((role for role, words in ROLES if low.startswith(words)), None) if low else None


def split_label(text: str) -> tuple[str | None, str]:
    """What stands before a colon, or before a dot and a space, is a label if it is one to three words, the first of which
    begins with a letter. So is a lone word right before a product of numbers."""
    text = text.strip()
    for i, sign in enumerate(text[: LABEL_LENGTH + 3]):
        if sign == ":" or (sign == "." and text[i + 1 : i + 2].isspace()):
            head = text[:i].strip(" .")
            words = re.split(r"[ ./-]", head)
            if 0 < len(head) <= LABEL_LENGTH and len(words) <= LABEL_WORDS and all(w.isalnum() for w in words) and head[0].isalpha():
                return head, text[i + 1 :].lstrip(" :")
    word, _, after = text.partition(" ")
    bare = word.removesuffix(".")
    if bare.isalnum() and 2 <= len(bare) <= 12 and bare[0].isalpha() and [k for k, *_ in scan(after)[:2]] == ["N", "X"]:
        return bare, after.strip()
    return None, text


def scan(text: str) -> list[tuple[str, str, int, int]]:
    """(type, text, begin, end) of the tokens."""
    return [(m.lastgroup, m[0], m.start(), m.end()) for m in SCANNER.finditer(text)]


class Reader:
    """Statements of one line. A phrase's method gets its numbers, size, unit and name, and returns False to refuse it."""

    def __init__(self, role: str | None):
        self.role, self.found, self.order = role, [], count()
        self.section = self.strength = self.length_mm = None

    def bar(self, phrase: str, **said) -> None:
        self.found.append((SAID_FIRST[phrase], next(self.order), {"role_hint": self.role, **{k: v for k, v in said.items() if v is not None}}))

    def bars(self) -> list[dict]:
        return [b for *_, b in sorted(self.found, key=lambda f: f[:2])]

    def summed(self, n, size, units, name):
        self.bar("summed", count=int(n[0]) + int(n[1]), size=size)

    def grouped(self, n, size, units, name):
        self.bar("grouped", groups=int(n[0]), count=int(n[1]), size=size, mark=name)

    def counted(self, n, size, units, name):
        self.bar("counted", count=int(n[0]), secondary_count=int(n[1]) if len(n) > 1 else None, size=size)

    def listed(self, n, size, units, name):
        # a count far too high is one that stuck to its neighbour
        self.bar("listed", size=size, mark=name, **{"count" if int(n[0]) <= PLAUSIBLE_COUNT else "suspect": int(n[0])})

    def spaced(self, n, size, units, name):
        self.bar("spaced", size=size, spacing_mm=spacing(n[0], units[0] if units else None))

    def spacing(self, n, size, units, name):
        last = self.found[-1][2] if self.found else None
        if last is None or "spacing_mm" in last:
            return False
        last["spacing_mm"] = spacing(n[0], units[0] if units else None)

    def pair(self, n, size, units, name):
        self.bar("pair", count=int(n[0]), secondary_count=int(n[1]))

    def marked(self, n, mark, units, name):
        if self.found:
            return False
        self.bar("marked", count=int(n[0]), size=f"{mark[:2]}M", mark=mark)

    def mark(self, n, mark, units, name):
        own = [b for *_, b in self.found if (b.get("size") or "").startswith(mark[:2]) and "mark" not in b]
        if own:
            own[0]["mark"] = mark
        elif not self.found:
            self.bar("mark", size=f"{mark[:2]}M", mark=mark)

    def section_of(self, a, b, units):
        small = a < 100 and b < 100
        if not units and min(a, b) < (6 if small else 100):
            return False  # `3x4` multiplies, it measures nothing
        self.section = self.section or [millimetres(x, units[0] if units else "in" if small else "mm") for x in (a, b)]


def read_line(text: str | None, label: str | None = None) -> dict:
    """label, bars, section, strength, length_mm and rest of one line; nothing said is None or an empty list."""
    text = text or ""
    if label is None:
        label, text = split_label(text)
    tokens = scan(text)
    types, reader, left = "".join(t[0] for t in tokens), Reader(role_of(label)), []
    explicit = any(re.search(shape, types) for shape in ("SAN", "N(?:LNR)?[DX]S", "NXNS", "NPNS"))
    at = 0
    while at < len(tokens):
        for name, shape in GRAMMAR:
            if not (m := shape.match(types, at)) or (name == "listed" and explicit) or (name == "marked" and at):
                continue
            part = tokens[at : m.end()]
            of = lambda kinds: [t[1] for t in part if t[0] in kinds]  # noqa: E731, B023
            n, size, units, names = of("N"), next(iter(of("SM")), "").upper() or None, of("U"), of("W")
            whole = all(x.isdigit() and len(x) <= 3 for x in n)
            if name == "section":
                taken = reader.section_of(float(n[0]), float(n[1]), units) is not False
            elif name == "strength":
                taken = n[0].isdigit() and 2 <= len(n[0]) <= 3
                reader.strength = reader.strength or (int(n[0]) if taken else None)
            elif name == "length":
                taken = units[0].lower() == "mm" and n[0].isdigit() and 3 <= len(n[0]) <= 6
                reader.length_mm = reader.length_mm or (float(n[0]) if taken else None)
            elif name == "qualifier":
                taken = True
            else:
                taken = (whole or name in ("spaced", "spacing")) and getattr(reader, name)(n, size, units, next(iter(names), None)) is not False
            if taken:
                at = m.end()
                break
        else:
            left.append(tokens[at])
            at += 1
    rest = "".join(t[1] if i and left[i - 1][3] == t[2] else f" {t[1]}" for i, t in enumerate(left)).strip(" ,;:/|-")
    return {"label": label, "bars": reader.bars(), "section": reader.section, "strength": reader.strength, "length_mm": reader.length_mm, "rest": rest}


_BAR_FIELDS = ("role_hint", "count", "secondary_count", "groups", "size", "spacing_mm", "mark", "suspect")


def read_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds what each line says to a table of lines; other columns pass through. Null text says nothing.

    Notes repeat: lines that are equal are read once in each batch, and what they say is told by their number."""
    kept = [c for c in lines.columns if c != text]
    at = lines.columns.index(text)
    said = to_arrow_schema(StructType.fromDDL(LINES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column(at).dictionary_encode(null_encoding="encode")
            read = [read_line(t) for t in each.dictionary.to_pylist()]
            for r in read:
                r["bars"] = [{k: b.get(k) for k in _BAR_FIELDS} for b in r["bars"]]
            columns = [pa.array([r[f.name] for r in read], f.type).take(each.indices) for f in said]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *columns], [*kept, *said.names])

    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name != text)
    return lines.mapInArrow(run, f"{passed}, {LINES}")
