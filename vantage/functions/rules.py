"""Case rules and conditions: which rows are cases of interest."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage.errors import CaseConditionError
from vantage.functions.paths import OutputPath
from vantage.schema import SessionSchema, Wire, type_spelling

BELOW, AT_MOST, AT_LEAST, ABOVE = "below", "at_most", "at_least", "above"
_OPERATORS = {BELOW: operator.lt, AT_MOST: operator.le, AT_LEAST: operator.ge, ABOVE: operator.gt}


@dataclass(frozen=True)
class CaseRule:
    """A test of one value: is_true, is_false, key_in, or a comparison of a quantity, datetime or int with a threshold."""

    kind: str
    comparison: str | None = None
    threshold: float | int | None = None
    keys: tuple[str, ...] = ()

    @classmethod
    def is_true(cls) -> CaseRule:
        return cls("is_true")

    @classmethod
    def is_false(cls) -> CaseRule:
        return cls("is_false")

    @classmethod
    def quantity(cls, comparison: str, threshold: float) -> CaseRule:
        return cls("quantity", comparison, float(threshold))

    @classmethod
    def datetime(cls, comparison: str, threshold: float) -> CaseRule:
        return cls("datetime", comparison, float(threshold))

    @classmethod
    def integer(cls, comparison: str, threshold: int) -> CaseRule:
        return cls("int", comparison, int(threshold))

    @classmethod
    def key_in(cls, *keys: str) -> CaseRule:
        return cls("key_in", keys=keys)

    def applies_to(self, wire: Wire) -> bool:
        if self.kind in ("is_true", "is_false"):
            return wire.kind == "bool"
        if self.kind == "key_in":
            return wire.kind == "key" and set(self.keys) <= set(wire.axis.labels())
        return wire.kind == self.kind

    def column(self, value: Column) -> Column:
        """Whether the rule holds; null for a null value. An empty key list matches nothing."""
        if self.kind == "is_true":
            return value
        if self.kind == "is_false":
            return ~value
        if self.kind == "key_in":
            return value.isin(*self.keys) if self.keys else F.when(value.isNotNull(), F.lit(False))
        return _OPERATORS[self.comparison](value, F.lit(self.threshold))


NOT_A_CASE, REJECT = "not_a_case", "reject"


@dataclass(frozen=True)
class CaseCondition:
    """A rule at a path, or conditions joined by all, any and ~."""

    kind: str
    path: OutputPath | None = None
    rule: CaseRule | None = None
    absent: str = NOT_A_CASE
    parts: tuple[CaseCondition, ...] = ()

    @classmethod
    def at(cls, path: OutputPath, rule: CaseRule, absent: str) -> CaseCondition:
        if not rule.applies_to(path.target):
            raise CaseConditionError("InapplicableRule", f"rule {rule.kind} does not apply to '{path}' of type {type_spelling(path.target)}", path=str(path))
        return cls("at", path, rule, absent)

    @classmethod
    def all(cls, *parts: CaseCondition) -> CaseCondition:
        return cls._joined("all", parts)

    @classmethod
    def any(cls, *parts: CaseCondition) -> CaseCondition:
        return cls._joined("any", parts)

    @classmethod
    def _joined(cls, kind: str, parts: tuple[CaseCondition, ...]) -> CaseCondition:
        if not parts:
            raise CaseConditionError("NoConditions", "conditions are joined of one at least")
        return cls(kind, parts=parts)

    def __invert__(self) -> CaseCondition:
        return CaseCondition("not", parts=(self,))

    def leaves(self) -> list[CaseCondition]:
        return [self] if self.kind == "at" else [x for p in self.parts for x in p.leaves()]

    def first_foreign_path(self, session: SessionSchema) -> OutputPath | None:
        return next((x.path for x in self.leaves() if not x.path.belongs_to(session)), None)

    def belongs_to(self, session: SessionSchema) -> bool:
        return self.first_foreign_path(session) is None

    def column(self, outputs: Column) -> Column:
        """Whether the row is a case. Null is settled at each leaf, so that negation is two-valued."""
        if self.kind == "at":
            return F.coalesce(self.rule.column(self.path.column(outputs)), F.lit(False))
        parts = [p.column(outputs) for p in self.parts]
        if self.kind == "not":
            return ~parts[0]
        return reduce(operator.and_ if self.kind == "all" else operator.or_, parts)

    def rejected(self, outputs: Column) -> Column:
        """The first path, in the order written, that has no value but must have one; null if there is none. It does not
        depend on what other conditions decide."""
        flags = [F.when(x.path.column(outputs).isNull(), F.lit(str(x.path))) for x in self.leaves() if x.absent == REJECT]
        return F.coalesce(*flags) if flags else F.lit(None).cast("string")
