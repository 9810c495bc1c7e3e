"""Session schemas: typed inputs and outputs of a model, and their Spark types.

A wire type is a frozen dataclass. A session compares by value, converts to JSON, and is kept in column metadata so that
stored tables describe themselves.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from vantage.errors import EvaluationDecodeError, ModelSchemaError

#: Version of the stored layout, and the metadata keys of ours that hold it and the session.
LAYOUT_VERSION = 1
LAYOUT_KEY, SESSION_KEY = "vantage.layout", "vantage.session"


@dataclass(frozen=True)
class Axis:
    """Entries of a key or an index: named variants, positions 0..size-1, or coordinates."""

    name: str
    variants: tuple[str, ...] = ()
    size: int | None = None
    coordinates: tuple[float, ...] = ()
    dimension: str | None = None

    def labels(self) -> list[str]:
        if self.size is not None:
            return [str(k) for k in range(self.size)]
        return list(self.variants) or [coordinate_label(c) for c in self.coordinates]

    def __len__(self) -> int:
        return self.size if self.size is not None else len(self.variants) or len(self.coordinates)


def coordinate_label(x: float) -> str:
    """The shortest decimal that reads back as x, without a fraction of zero or an exponent."""
    text = repr(float(x))
    if "e" in text or "E" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text.removesuffix(".0")


@dataclass(frozen=True)
class Wire:
    """One of: quantity, int, bool, key, complex, datetime, indexed, algebraic."""

    kind: str
    dimension: str | None = None
    unit: str | None = None
    scale: str | None = None
    axis: Axis | None = None
    element: Wire | None = None
    name: str | None = None
    #: algebraic: constructors in order, each with its named fields
    variants: tuple[tuple[str, tuple[tuple[str, Wire], ...]], ...] = ()

    @property
    def is_union(self) -> bool:
        return self.kind == "algebraic" and len(self.variants) > 1

    def fields(self, variant: str | None = None) -> dict[str, Wire]:
        return dict(next(f for v, f in self.variants if variant in (None, v)))


def quantity(dimension: str = "Dimensionless", unit: str | None = None) -> Wire:
    return Wire("quantity", dimension=dimension, unit=unit)


INT, BOOL, COMPLEX = Wire("int"), Wire("bool"), Wire("complex", dimension="Dimensionless")


def datetime(scale: str = "UTC") -> Wire:
    return Wire("datetime", scale=scale)


def key(axis: Axis) -> Wire:
    return Wire("key", axis=axis)


def indexed(element: Wire, axis: Axis) -> Wire:
    return Wire("indexed", element=element, axis=axis)


def record(name: str, **fields: Wire) -> Wire:
    return Wire("algebraic", name=name, variants=((name, tuple(fields.items())),))


def union(name: str, **variants: dict[str, Wire]) -> Wire:
    return Wire("algebraic", name=name, variants=tuple((v, tuple(f.items())) for v, f in variants.items()))


def type_spelling(wire: Wire) -> str:
    """How a type reads in messages."""
    match wire.kind:
        case "quantity":
            return f"{wire.dimension} in {wire.unit}" if wire.unit else str(wire.dimension)
        case "int":
            return "Int"
        case "bool":
            return "Bool"
        case "complex":
            return f"Complex<{wire.dimension}>"
        case "datetime":
            return f"Datetime<{wire.scale}>"
        case "key":
            return f"Key<{wire.axis.name}>"
        case "indexed":
            return f"{type_spelling(wire.element)}[{wire.axis.name}]"
    said = [v + ("(" + ", ".join(f"{n}: {type_spelling(w)}" for n, w in f) + ")" if f else "") for v, f in wire.variants]
    return f"{wire.name} = " + " | ".join(said) if wire.is_union else said[0]


@dataclass(frozen=True)
class Bounds:
    """Closed bounds; a missing one is open."""

    min: float | int | None = None
    max: float | int | None = None

    def holds(self, x) -> bool:
        return (self.min is None or x >= self.min) and (self.max is None or x <= self.max)


@dataclass(frozen=True)
class Port:
    name: str
    wire: Wire
    domain: Bounds | None = None


def spark_type(wire: Wire) -> T.DataType:
    """Records become structs; unions a struct with a _tag and one nullable struct for each variant that has fields."""
    match wire.kind:
        case "quantity" | "datetime":
            return T.DoubleType()
        case "int":
            return T.LongType()
        case "bool":
            return T.BooleanType()
        case "key":
            return T.StringType()
        case "complex":
            return T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
        case "indexed":
            return T.ArrayType(spark_type(wire.element))
    if not wire.is_union:
        return T.StructType([T.StructField(n, spark_type(w)) for n, w in wire.variants[0][1]])
    children = [T.StructField(v, T.StructType([T.StructField(n, spark_type(w)) for n, w in f])) for v, f in wire.variants if f]
    return T.StructType([T.StructField("_tag", T.StringType()), *children])


OUTCOME = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("subject", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("expected_count", T.LongType()),
        T.StructField("actual_count", T.LongType()),
    ]
)


@dataclass(frozen=True)
class SessionSchema:
    inputs: tuple[Port, ...]
    outputs: tuple[Port, ...]

    def input(self, name: str) -> Port | None:
        return next((p for p in self.inputs if p.name == name), None)

    def output(self, name: str) -> Port | None:
        return next((p for p in self.outputs if p.name == name), None)

    def input_type(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, spark_type(p.wire), True, {"wire": p.wire.kind}) for p in self.inputs])

    def output_type(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, spark_type(p.wire), True, {"wire": p.wire.kind}) for p in self.outputs])

    def request_type(self) -> T.StructType:
        return T.StructType(self.storage_type().fields[:4])

    def result_type(self) -> T.StructType:
        own = {f.name: f for f in self.storage_type().fields}
        return T.StructType([own["evaluation_id"], own["row"], own["outputs"], own["outcome"]])

    def storage_type(self) -> T.StructType:
        """The six stored columns; the first one's metadata holds the layout version and the session."""
        about = {LAYOUT_KEY: LAYOUT_VERSION, SESSION_KEY: self.to_json()}
        return T.StructType(
            [
                T.StructField("evaluation_id", T.BinaryType(), True, about),
                T.StructField("row", T.LongType()),
                T.StructField("seed", T.DecimalType(20, 0)),
                T.StructField("inputs", self.input_type()),
                T.StructField("outputs", self.output_type()),
                T.StructField("outcome", OUTCOME),
            ]
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> SessionSchema:
        def axis(d):
            return d and Axis(d["name"], tuple(d["variants"]), d["size"], tuple(d["coordinates"]), d["dimension"])

        def wire(d):
            return d and Wire(d["kind"], d["dimension"], d["unit"], d["scale"], axis(d["axis"]), wire(d["element"]), d["name"], tuple((v, tuple((n, wire(w)) for n, w in f)) for v, f in d["variants"]))

        def port(d):
            return Port(d["name"], wire(d["wire"]), d["domain"] and Bounds(**d["domain"]))

        whole = json.loads(text)
        return cls(tuple(map(port, whole["inputs"])), tuple(map(port, whole["outputs"])))

    @classmethod
    def from_storage_type(cls, stored: T.StructType) -> SessionSchema:
        """Restores the session of a stored table: metadata there, version known, session readable, columns as it says."""
        about = next((f.metadata for f in stored.fields if f.name == "evaluation_id"), {})
        return cls.from_metadata(about.get(LAYOUT_KEY), about.get(SESSION_KEY), stored)

    @classmethod
    def from_metadata(cls, version, session: str | None, stored: T.StructType | None = None) -> SessionSchema:
        if version is None or session is None:
            raise EvaluationDecodeError("LayoutMetadata", "the table does not describe its session")
        if int(version) != LAYOUT_VERSION:
            raise EvaluationDecodeError("FormatVersion", f"the table has layout version {version}, not {LAYOUT_VERSION}", version=version)
        try:
            own = cls.from_json(session)
        except (ValueError, KeyError, TypeError) as e:
            raise EvaluationDecodeError("Record", f"the table's session cannot be read: {e}") from e
        if stored is not None and [(f.name, f.dataType.simpleString()) for f in stored.fields] != [(f.name, f.dataType.simpleString()) for f in own.storage_type().fields]:
            raise EvaluationDecodeError("Schema", "the table's columns are not those of its session")
        return own


@dataclass
class SchemaBuilder:
    """Declares ports one by one, each checked at once; build() needs an input, an output and distinct names."""

    inputs: list[Port] = field(default_factory=list)
    outputs: list[Port] = field(default_factory=list)

    def _bounds(self, name: str, low, high, half_open: bool) -> Bounds | None:
        for x in (low, high):
            if x is not None and not math.isfinite(x):
                raise ModelSchemaError("NonFiniteBound", f"input '{name}' has the bound {x}, which is not finite", name=name)
        if (low is None) != (high is None) and not half_open or low is not None and high is not None and low > high:
            raise ModelSchemaError("InvalidBounds", f"input '{name}' has the bounds {low} and {high}", name=name)
        return None if low is None and high is None else Bounds(low, high)

    def _label(self, name: str) -> str:
        if not name or not (name[0].isalpha() or name[0] == "_") or not all(c.isalnum() or c == "_" for c in name):
            raise ModelSchemaError("Label", f"'{name}' is no label", name=name)
        return name

    def _input(self, name: str, wire: Wire, domain: Bounds | None = None) -> SchemaBuilder:
        self.inputs.append(Port(self._label(name), wire, domain))
        return self

    def _output(self, name: str, wire: Wire) -> SchemaBuilder:
        self.outputs.append(Port(self._label(name), wire))
        return self

    def _axis(self, name: str, values: list[str] | Axis) -> Axis:
        if isinstance(values, Axis):
            return values
        if not values or len(set(values)) != len(values) or any(not v.strip() for v in values):
            raise ModelSchemaError("InvalidKey", f"port '{name}' needs distinct entries that are not blank", name=name)
        return Axis(name, tuple(values))

    def continuous(self, name: str, low: float, high: float) -> SchemaBuilder:
        return self._input(name, quantity(), self._bounds(name, float(low), float(high), False))

    def quantity(self, name: str, dimension: str, low: float | None = None, high: float | None = None, unit: str | None = None) -> SchemaBuilder:
        return self._input(name, quantity(dimension, unit), self._bounds(name, low, high, True))

    def datetime(self, name: str, scale: str, low: float | None = None, high: float | None = None) -> SchemaBuilder:
        return self._input(name, datetime(scale), self._bounds(name, low, high, True))

    def integer(self, name: str, low: int, high: int) -> SchemaBuilder:
        return self._input(name, INT, self._bounds(name, low, high, False))

    def categorical(self, name: str, values: list[str] | Axis) -> SchemaBuilder:
        return self._input(name, key(self._axis(name, values)))

    def boolean(self, name: str) -> SchemaBuilder:
        return self._input(name, BOOL)

    def input(self, name: str, wire: Wire, domain: Bounds | None = None) -> SchemaBuilder:
        return self._input(name, wire, domain)

    def boolean_output(self, name: str) -> SchemaBuilder:
        return self._output(name, BOOL)

    def quantity_output(self, name: str, dimension: str = "Dimensionless", unit: str | None = None) -> SchemaBuilder:
        return self._output(name, quantity(dimension, unit))

    def integer_output(self, name: str) -> SchemaBuilder:
        return self._output(name, INT)

    def key_output(self, name: str, values: list[str] | Axis) -> SchemaBuilder:
        return self._output(name, key(self._axis(name, values)))

    def output(self, name: str, wire: Wire) -> SchemaBuilder:
        return self._output(name, wire)

    def build(self) -> SessionSchema:
        if not self.inputs or not self.outputs:
            raise ModelSchemaError("Interface", "a session needs an input and an output")
        for ports in (self.inputs, self.outputs):
            names = [p.name for p in ports]
            if len(set(names)) != len(names):
                raise ModelSchemaError("Session", "two ports of a session have one name")
        return SessionSchema(tuple(self.inputs), tuple(self.outputs))


def describe(session: SessionSchema) -> str:
    lines = [f"in  {p.name}: {type_spelling(p.wire)}" + (f" [{p.domain.min}, {p.domain.max}]" if p.domain else "") for p in session.inputs]
    return "\n".join([*lines, *(f"out {p.name}: {type_spelling(p.wire)}" for p in session.outputs)])
