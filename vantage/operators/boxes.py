"""Boxes: one restriction for each feature, kept on the driver and compiled to a column predicate."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTINUOUS, INTEGER, CATEGORICAL = "continuous", "integer", "categorical"


@dataclass(frozen=True)
class Range:
    """Inclusive bounds of a continuous or integer feature."""

    kind: str
    lower: float | int
    upper: float | int

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`").between(F.lit(self.lower), F.lit(self.upper))

    def mask(self, values: np.ndarray) -> np.ndarray:
        return (values >= self.lower) & (values <= self.upper)


@dataclass(frozen=True)
class Categories:
    """Categories that are left of a categorical feature."""

    values: frozenset[str]
    kind: str = CATEGORICAL

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`").isin(*sorted(self.values)) if self.values else F.lit(False)

    def mask(self, values: np.ndarray) -> np.ndarray:
        return np.isin(values, sorted(self.values))


Restriction = Range | Categories


@dataclass(frozen=True)
class BoxLimits:
    """Restrictions by feature, in the order of the features."""

    items: tuple[tuple[str, Restriction], ...]

    def __iter__(self) -> Iterator[tuple[str, Restriction]]:
        return iter(self.items)

    def get(self, name: str) -> Restriction | None:
        return dict(self.items).get(name)

    def __getitem__(self, name: str) -> Restriction:
        return dict(self.items)[name]

    def with_restriction(self, name: str, restriction: Restriction) -> BoxLimits:
        return BoxLimits(tuple((n, restriction if n == name else r) for n, r in self.items))

    def restricted(self, initial: BoxLimits) -> list[str]:
        """Features whose restriction differs from the initial one."""
        return [n for (n, r), (_, s) in zip(self.items, initial.items, strict=True) if r != s]

    def column(self) -> Column:
        """Membership as a predicate over all features; scans can push it down."""
        return reduce(lambda a, b: a & b, (r.column(n) for n, r in self.items), F.lit(True))

    def changed_column(self, initial: BoxLimits) -> Column:
        """Membership for rows that the initial limits hold, naming restricted features only."""
        return reduce(lambda a, b: a & b, (self[n].column(n) for n in self.restricted(initial)), F.lit(True))

    def mask(self, columns: Mapping[str, np.ndarray], rows: int) -> np.ndarray:
        out = np.ones(rows, bool)
        for name, restriction in self.items:
            out &= restriction.mask(columns[name])
        return out

    def as_rows(self) -> list[tuple]:
        """(name, kind, lower, upper, categories) for each feature; a zero has no sign."""
        return [(n, r.kind, None, None, sorted(r.values)) if isinstance(r, Categories) else (n, r.kind, float(r.lower) + 0.0, float(r.upper) + 0.0, None) for n, r in self.items]
