"""Settings of the engine; a JSON file may override them, and a name it doesn't know is an error."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path

from matchyard import schema as S


@dataclass(frozen=True)
class Config:
    bar_sizes: tuple[str, ...] = S.BAR_SIZES
    spacing_unit: str = "in"
    spacing_tolerance_mm: float = S.SPACING_TOLERANCE_MM
    near_column_limit: float = S.NEAR_COLUMN_LIMIT
    trust_for_verdict: float = S.TRUST_FOR_VERDICT
    partial_every_s: float = 20.0
    #: Part of a folder's or file's name and the type it stands for; the first that fits counts.
    folder_types: tuple[tuple[str, str], ...] = (
        ("colonne", "colonne"), ("column", "colonne"), ("poutre", "poutre"), ("beam", "poutre"), ("dalle", "dalle"), ("slab", "dalle"), ("fondation", "fondation"),
        ("foundation", "fondation"), ("semelle", "fondation"), ("radier", "fondation"), ("refend", "mur_refend"), ("mur", "mur_refend"), ("wall", "mur_refend"),
    )


def load(path: str | Path | None = None) -> Config:
    if path is None:
        return Config()
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if unknown := sorted(set(found) - {f.name for f in fields(Config)}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    frozen = lambda v: tuple(frozen(x) for x in v) if isinstance(v, list) else v
    return replace(Config(), **{k: frozen(v) for k, v in found.items()})
