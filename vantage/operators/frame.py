"""Scenario frames: typed features and a Boolean case column over a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from vantage.errors import DataError
from vantage.operators.boxes import CATEGORICAL, CONTINUOUS, INTEGER, BoxLimits, Categories, Range

CASE = "case"
#: Columns of `equal_rows`.
ROWS, CASES = "_rows", "_cases"


@dataclass(frozen=True)
class Feature:
    """A named, typed column. The three constructors give its kind; values are checked when a frame is built."""

    name: str
    kind: str

    def __post_init__(self):
        if not self.name.strip():
            raise DataError("EmptyFeatureName", "a feature needs a name that is not blank")

    @classmethod
    def continuous(cls, name: str) -> Feature:
        return cls(name, CONTINUOUS)

    @classmethod
    def integer(cls, name: str) -> Feature:
        return cls(name, INTEGER)

    @classmethod
    def categorical(cls, name: str) -> Feature:
        return cls(name, CATEGORICAL)

    def column(self) -> Column:
        kind = {CONTINUOUS: "double", INTEGER: "bigint", CATEGORICAL: "string"}[self.kind]
        return F.col(f"`{self.name}`").cast(kind).alias(self.name, metadata={"feature_kind": self.kind})


def refused(x: Column, kind: str) -> Column:
    """Whether a feature of this kind refuses a value."""
    if kind == CONTINUOUS:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return x.isNull() | (F.trim(x) == "") if kind == CATEGORICAL else x.isNull()


def category_dictionary(values: DataFrame, column: str) -> DataFrame:
    """category and code: the distinct values in lexical order, numbered from 0. Values that do not occur have no code.

    No task sorts them all: see `numbered`.
    """
    distinct = values.select(F.col(column).alias("category")).where("category is not null").distinct()
    return numbered(distinct, "category", "code").withColumn("code", F.col("code").cast("int"))


def numbered(rows: DataFrame, by: str, name: str, first: int = 0, beginning: int = 2) -> DataFrame:
    """Adds the number of each row in the order of a string or binary column of distinct values, from `first` on.

    Rows with equal beginnings (of so many characters or bytes) are sorted together and count from what earlier beginnings hold. One
    task meets the beginnings only, one row for each.
    """
    begun = rows.withColumn("_begin", F.substring(by, 1, beginning))
    sizes = begun.groupBy("_begin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.Window.orderBy("_begin").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_begin", before.alias("_before"))
    within = F.row_number().over(W.Window.partitionBy("_begin").orderBy(by))
    return begun.join(starts, "_begin").select(*rows.columns, (F.col("_before") + within - 1 + first).cast("long").alias(name))


def decoded(codes: DataFrame, code_column: str, dictionary: DataFrame) -> DataFrame:
    """Adds category by looking a code up; a code that the dictionary lacks gives null."""
    found = dictionary.select(F.col("code").alias("_code"), "category")
    return codes.join(found, codes[code_column] == found["_code"], "left").drop("_code")


def encoded_as(values: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Adds code by looking a category up; an unknown category gives null."""
    found = dictionary.select(F.col("category").alias("_category"), "code")
    return values.join(found, values[column] == found["_category"], "left").drop("_category")


def categorical_from_dictionary(codes: DataFrame, code_column: str, entries: list[str], name: str, row_column: str = "row_id") -> DataFrame:
    """Replaces codes into any dictionary by their categories; the first code out of range, by row, is an error. Entries that
    no row uses are not checked and drop out, since a column of strings holds only what occurs."""
    spark = codes.sparkSession
    bad = codes.where((F.col(code_column) < 0) | (F.col(code_column) >= len(entries)) | F.col(code_column).isNull()).agg(F.min_by(F.struct(row_column, code_column), row_column).alias("b")).first()["b"]
    if bad is not None:
        raise DataError("InvalidCategoryCode", f"feature '{name}' has code {bad[code_column]} at row {bad[row_column]}, outside its dictionary", name=name, row=bad[row_column], code=bad[code_column])
    table = spark.createDataFrame([(k, e) for k, e in enumerate(entries)], "_code int, category string")
    out = codes.join(table, codes[code_column] == table["_code"]).drop("_code", code_column)
    return out.withColumnRenamed("category", name)


@dataclass
class ScenarioFrame:
    """A DataFrame with row_id, one column per feature and a Boolean case column, checked on construction.

    Checks come in a fixed order: features there are, rows there are, names differ, then the values of each feature. One
    aggregation finds the first bad row of every feature.
    """

    df: DataFrame
    features: list[Feature]
    case: str = CASE
    row_id: str | None = None
    check: bool = True
    _summary: dict | None = field(default=None, repr=False)
    _distinct: tuple[int, dict[str, int]] | None = field(default=None, repr=False)

    def __post_init__(self):
        if not self.features:
            raise DataError("NoFeatures", "a frame needs a feature")
        if self.check and self.df.isEmpty():
            raise DataError("NoOutcomes", "a frame needs a row")
        seen: set[str] = set()
        for f in self.features:
            if f.name in seen:
                raise DataError("DuplicateFeatureName", f"two features are named '{f.name}'", name=f.name)
            seen.add(f.name)
        rows = [F.col(f"`{self.row_id}`").alias("row_id")] if self.row_id else []
        self.df = self.df.select(*rows, *(f.column() for f in self.features), F.col(f"`{self.case}`").cast("boolean").alias(CASE))
        self.case = CASE
        if self.check:
            self.validate()

    def faults(self) -> DataFrame:
        """position, feature, n, row, value: for each feature, and the case, how many values it refuses, and the first of them.

        A continuous value must be finite, a category not blank, any value and case not null. Where a frame has no row_id, rows
        are numbered by partition: in the order of the input, with gaps.
        """
        rows = self.df if self.row_id else self.df.withColumn("row_id", F.monotonically_increasing_id())
        names = [*(f.name for f in self.features), CASE]
        wrong = [*(refused(F.col(f"`{f.name}`"), f.kind) for f in self.features), F.col(CASE).isNull()]
        columns = []
        for k, (name, bad) in enumerate(zip(names, wrong, strict=True)):
            at = F.struct(F.col("row_id").alias("row"), F.col(f"`{name}`").cast("string").alias("value"))
            columns += [F.count_if(bad).alias(f"n{k}"), F.min_by(at, F.when(bad, F.col("row_id"))).alias(f"at{k}")]
        each = [F.struct(F.lit(k).alias("position"), F.lit(name).alias("feature"), F.col(f"n{k}").alias("n"), F.col(f"at{k}.row").alias("row"), F.col(f"at{k}.value").alias("value")) for k, name in enumerate(names)]
        return rows.agg(*columns).select(F.explode(F.array(*each)).alias("f")).select("f.*")

    def validate(self) -> None:
        """Raises the first fault by the order of the features; the case comes last."""
        found = self.faults().where("n > 0").orderBy("position").first()
        if found is None:
            return
        name, row, value = found["feature"], found["row"], found["value"]
        if found["position"] == len(self.features):
            raise DataError("NullCase", f"the case at row {row} is null", row=row)
        if self.kind(name) == CATEGORICAL:
            raise DataError("EmptyCategoryValue", f"feature '{name}' has a blank category at row {row}", name=name, row=row)
        raise DataError("NonFiniteValue", f"feature '{name}' has the value {value}, which is not finite, at row {row}", name=name, row=row, value=value)

    def kind(self, name: str) -> str:
        return next(f.kind for f in self.features if f.name == name)

    def view(self, name: str, kind: str | None = None) -> DataFrame | None:
        """One feature's column; None if a kind is asked for that it is not of."""
        found = next((f for f in self.features if f.name == name), None)
        return self.df.select(f"`{name}`") if found and kind in (None, found.kind) else None

    def categories(self, name: str) -> list[str] | None:
        return None if self.view(name, CATEGORICAL) is None else [r[0] for r in category_dictionary(self.df, name).orderBy("code").select("category").collect()]

    def row_count(self) -> int:
        return self.summary()["rows"]

    def case_count(self) -> int:
        return self.summary()["cases"]

    def summary(self) -> dict:
        """Rows, cases and initial limits, from one aggregation over the whole frame."""
        if self._summary is None:
            row = self.df.agg(*self.summary_columns()).first()
            limits = []
            for f in self.features:
                if f.kind == CATEGORICAL:
                    limits.append((f.name, Categories(frozenset(row[f"set:{f.name}"]))))
                else:
                    limits.append((f.name, Range(f.kind, row[f"min:{f.name}"], row[f"max:{f.name}"])))
            self._summary = {"rows": row["rows"], "cases": row["cases"], "limits": BoxLimits(tuple(limits))}
        return self._summary

    def summary_columns(self) -> list[Column]:
        out = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(CASE)).alias("cases")]
        for f in self.features:
            x = F.col(f"`{f.name}`")
            out += [F.collect_set(x).alias(f"set:{f.name}")] if f.kind == CATEGORICAL else [F.min(x).alias(f"min:{f.name}"), F.max(x).alias(f"max:{f.name}")]
        return out

    def equal_rows(self) -> DataFrame:
        """Each combination of feature values that occurs: ROWS, how many rows have it, and CASES, how many of them are cases."""
        return self.df.groupBy(*(f"`{f.name}`" for f in self.features)).agg(F.count(F.lit(1)).alias(ROWS), F.count_if(F.col(CASE)).alias(CASES))

    def distinct(self) -> tuple[int, dict[str, int]]:
        """About how many combinations of feature values there are, and values of each feature, from one aggregation of sketches."""
        if self._distinct is None:
            names = [f"`{f.name}`" for f in self.features]
            whole, *each = self.df.agg(F.approx_count_distinct(F.xxhash64(*names)).alias("n"), *(F.approx_count_distinct(n).alias(f"n{k}") for k, n in enumerate(names))).first()
            self._distinct = whole, {f.name: n for f, n in zip(self.features, each, strict=True)}
        return self._distinct

    def initial_limits(self) -> BoxLimits:
        return self.summary()["limits"]

    def rows_in_box(self, limits: BoxLimits) -> DataFrame:
        return self.df.where(limits.column())


def features_of(df: DataFrame, names: list[str]) -> list[Feature]:
    """Features by the columns' types: floating point is continuous, integral is integer, strings and Booleans are categorical."""
    out = []
    for n in names:
        kind = df.schema[n].dataType
        if isinstance(kind, T.FractionalType):
            out.append(Feature.continuous(n))
        elif isinstance(kind, T.IntegralType):
            out.append(Feature.integer(n))
        elif isinstance(kind, T.StringType | T.BooleanType):
            out.append(Feature.categorical(n))
        else:
            raise DataError("UnsupportedFeature", f"column '{n}' of type {kind.simpleString()} is no feature", name=n, kind=kind.simpleString())
    return out
