"""Bands, cells and memberships as Column expressions. NaN and null fail every band."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


@dataclass(frozen=True)
class Band:
    """[at_least, below); either side can be open, not both."""

    column: str
    at_least: float | None = None
    below: float | None = None

    def __post_init__(self):
        if self.at_least is None and self.below is None:
            raise ValueError("a band needs a bound")
        if None not in (self.at_least, self.below) and self.below <= self.at_least:
            raise ValueError("nothing lies in the band")

    def mask(self) -> Column:
        x, parts = number(f"`{self.column}`"), []  # catalogs name columns group.member
        if self.at_least is not None:
            parts.append(x >= F.lit(float(self.at_least)))
        if self.below is not None:
            parts.append(x < F.lit(float(self.below)))
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


@dataclass(frozen=True)
class Cell:
    """All bands of ``predicate`` and, if there are any, one of the alternatives."""

    name: str
    predicate: Sequence[Band] = ()
    any_of: Sequence[Sequence[Band]] = field(default_factory=list)

    @property
    def bands(self) -> list[Band]:
        return [*self.predicate, *[b for bands in self.any_of for b in bands]]

    def mask(self, alternative: int | None = None) -> Column:
        parts = [b.mask() for b in self.predicate]
        choices = [reduce(lambda a, b: a & b, [b.mask() for b in bands]) for bands in self.any_of]
        if choices:
            parts.append(reduce(lambda a, b: a | b, choices) if alternative is None else choices[alternative])
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def _band(entry: Mapping | Sequence) -> Band:
    return Band(**entry) if isinstance(entry, Mapping) else Band(*entry)


def _alternative(entry: Mapping | Sequence) -> list[Band]:
    return [_band(entry)] if isinstance(entry, Mapping) else [_band(b) for b in entry]


def load_cells(rows: Iterable[Mapping]) -> list[Cell]:
    """Cells from plain dictionaries {name, predicate: [band], any_of: [alternative]}, in order; other keys are ignored.

    A band is a list [column, at_least, below] or a dictionary of those names; an alternative is a list of bands or one dictionary.
    Names must differ and every cell needs a band, as it would claim every row without one.
    """
    cells = [Cell(r["name"], [_band(b) for b in r.get("predicate") or ()], [_alternative(a) for a in r.get("any_of") or ()]) for r in rows]
    doubled = sorted(name for name, n in Counter(c.name for c in cells).items() if n > 1)
    if doubled:
        raise ValueError(f"cell names must differ: {doubled}")
    empty = [c.name for c in cells if not c.bands]
    if empty:
        raise ValueError(f"cells without a band: {empty}")
    return cells


def read_cells(*paths: str | Path) -> list[Cell]:
    """All cells of catalog files as one vocabulary, in file order. A file is a dictionary whose ``cells`` are what ``load_cells`` takes:
    JSON if its name ends in ``.json``, else YAML, which needs PyYAML."""
    rows = []
    for path in map(Path, paths):
        text = path.read_text(encoding="utf-8")
        if path.suffix == ".json":
            rows += json.loads(text)["cells"]
        else:
            import yaml  # optional; only for catalogs in YAML

            rows += yaml.safe_load(text)["cells"]
    return load_cells(rows)


def available(cells: Sequence[Cell], columns: Sequence[str]) -> list[Cell]:
    """Those cells whose columns all exist."""
    there = set(columns)
    return [c for c in cells if all(b.column in there for b in c.bands)]


def memberships(cells: Sequence[Cell]) -> Column:
    """The sorted names of all cells that claim a row."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c.mask(), F.lit(c.name)) for c in cells])))


def prefix_total(columns: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(number(f"`{c}`"), F.lit(0.0)) for c in columns if c.startswith(prefix)], F.lit(0.0))


def cut_right_closed(x: Column, edges: Sequence[float], names: Sequence[str], missing: str = "unknown") -> Column:
    """(.., e1] first name, (e1, e2] second and so on; missing values have a name of their own."""
    out = F.when(x.isNull() | F.isnan(x), missing)
    for edge, name in zip(edges, names, strict=False):
        out = out.when(x <= F.lit(float(edge)), name)
    return out.otherwise(names[-1])


def cut_left_closed(x: Column, edges: Sequence[float], names: Sequence[str], missing: str = "unknown") -> Column:
    """[.., e1) first name, [e1, e2) second and so on."""
    out = F.when(x.isNull() | F.isnan(x), missing)
    for edge, name in zip(edges, names, strict=False):
        out = out.when(x < F.lit(float(edge)), name)
    return out.otherwise(names[-1])
