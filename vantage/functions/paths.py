"""Output paths: a place inside the outputs of a session, checked against its types and compiled to a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage.errors import OutputPathError
from vantage.schema import BOOL, SessionSchema, Wire, coordinate_label


@dataclass(frozen=True)
class OutputPath:
    """An output and steps into it. A variant at the end asks whether the value is of that variant."""

    output: str
    wire: Wire
    steps: tuple[tuple[str, str], ...] = ()

    @classmethod
    def new(cls, session: SessionSchema, output: str) -> OutputPath:
        port = session.output(output)
        if port is None:
            raise OutputPathError("UnknownOutput", f"the session has no output '{output}'", name=output)
        return cls(output, port.wire)

    @classmethod
    def parse(cls, session: SessionSchema, text: str) -> OutputPath:
        """Dotted form. What a segment means depends on the type reached; coordinates have dots and cannot be written."""
        output, *rest = text.split(".")
        path = cls.new(session, output)
        for segment in rest:
            kind, variant = path._reached()
            if kind.kind == "indexed":
                path = path.entry(segment)
            elif kind.is_union and variant is None:
                path = path.variant(segment) if any(v == segment for v, _ in kind.variants) or segment not in _all_fields(kind) else path.field(segment)
            else:
                path = path.field(segment)
        return path

    def _reached(self) -> tuple[Wire, str | None]:
        """The type at the end, and the variant just named there."""
        wire, variant = self.wire, None
        for step, name in self.steps:
            if step == "variant":
                variant = name
            elif step == "field":
                wire, variant = wire.fields(variant)[name], None
            else:
                wire, variant = wire.element, None
        return wire, variant

    def _with(self, step: str, name: str) -> OutputPath:
        return OutputPath(self.output, self.wire, (*self.steps, (step, name)))

    def field(self, name: str) -> OutputPath:
        wire, variant = self._reached()
        if wire.kind != "algebraic":
            raise OutputPathError("NotSelectable", f"{self}: a {wire.kind} value has no field '{name}'", path=str(self), step=name)
        if wire.is_union and variant is None:
            raise OutputPathError("FieldOfUnion", f"{self}: {wire.name} has several variants, and one is to be named before field '{name}'", path=str(self), field=name)
        if name not in wire.fields(variant):
            raise OutputPathError("UnknownField", f"{self}: {variant or wire.name} has no field '{name}'", path=str(self), field=name)
        return self._with("field", name)

    def variant(self, name: str) -> OutputPath:
        wire, variant = self._reached()
        if not wire.is_union or variant is not None:
            raise OutputPathError("NotSelectable", f"{self}: no variant '{name}' can be named here", path=str(self), step=name)
        if all(v != name for v, _ in wire.variants):
            raise OutputPathError("UnknownVariant", f"{self}: {wire.name} has no variant '{name}'", path=str(self), named=name)
        return self._with("variant", name)

    def entry(self, name: str | float) -> OutputPath:
        wire, _ = self._reached()
        label = name if isinstance(name, str) else coordinate_label(name)
        if wire.kind != "indexed":
            raise OutputPathError("NotSelectable", f"{self}: a {wire.kind} value has no entries", path=str(self), step=label)
        if label not in wire.axis.labels():
            raise OutputPathError("UnknownKey", f"{self}: {wire.axis.name} has no entry '{label}'", path=str(self), key=label)
        return self._with("entry", label)

    @property
    def target(self) -> Wire:
        """Type of what the path selects."""
        wire, variant = self._reached()
        return BOOL if variant is not None else wire

    def belongs_to(self, session: SessionSchema) -> bool:
        port = session.output(self.output)
        return port is not None and port.wire == self.wire

    def column(self, outputs: Column) -> Column:
        """The selected value; null where another variant stands in the way."""
        value, wire, variant = outputs.getField(self.output), self.wire, None
        for k, (step, name) in enumerate(self.steps):
            if step == "variant":
                held = value.getField("_tag") == name
                if k == len(self.steps) - 1:
                    return held
                value, variant = F.when(held, value.getField(name)), name
            elif step == "field":
                value, wire, variant = value.getField(name), wire.fields(variant)[name], None
            else:
                value, wire = F.get(value, F.lit(wire.axis.labels().index(name))), wire.element
        return value

    def __str__(self) -> str:
        return ".".join([self.output, *(n for _, n in self.steps)])


def _all_fields(wire: Wire) -> set[str]:
    return {n for _, f in wire.variants for n, _ in f}
