"""Evaluation tables: requests paired with results, kept in order, classified and turned into scenario frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.errors import DataError, EvaluationDatasetError, EvaluationTableError
from vantage.functions.outcomes import SUCCESS, message_of
from vantage.functions.rules import CaseCondition, CaseRule
from vantage.functions.seeds import id_hex
from vantage.operators.frame import CASE, Feature, ScenarioFrame, numbered
from vantage.schema import SessionSchema, type_spelling

KEYS = ["evaluation_id", "row"]
COLUMNS = ["evaluation_id", "row", "seed", "inputs", "outputs", "outcome"]


def pair(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Rows of requests with the outputs and outcome of the result of equal id and row.

    An id on one side only, and different row counts of one id, are errors; one grouped pass over both sides finds them.
    """
    sides = requests.select("evaluation_id", F.lit(1).alias("q"), F.lit(0).alias("r")).unionByName(results.select("evaluation_id", F.lit(0).alias("q"), F.lit(1).alias("r")))
    wrong = sides.groupBy("evaluation_id").agg(F.sum("q").alias("expected"), F.sum("r").alias("actual")).where("expected <> actual")
    bad = wrong.orderBy("evaluation_id").first()
    if bad:
        name = id_hex(bytes(bad["evaluation_id"]))
        if not bad["expected"] or not bad["actual"]:
            raise EvaluationTableError("MismatchedId", f"evaluation {name} is on one side only", id=name)
        raise EvaluationTableError("RowCountMismatch", f"the result of evaluation {name} has {bad['actual']} rows, its request {bad['expected']}", id=name, expected=bad["expected"], actual=bad["actual"])
    return requests.join(results.select(*KEYS, "outputs", "outcome"), KEYS).select(*COLUMNS)


def missing_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Ids of requests that have no result."""
    return requests.select("evaluation_id").distinct().join(results.select("evaluation_id"), "evaluation_id", "left_anti")


def duplicate_ids(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Ids of added evaluations that the table has already."""
    return added.select("evaluation_id").distinct().join(existing.select("evaluation_id"), "evaluation_id", "left_semi")


class EvaluationTable:
    """Stored columns and `ordinal`, an evaluation's place in the table. Appending gives a new table and changes nothing else."""

    def __init__(self, session: SessionSchema, df: DataFrame | None = None, spark=None):
        self.session = session
        if df is None:
            df = spark.createDataFrame([], session.storage_type()).withColumn("ordinal", F.lit(0).cast("long"))
        elif "ordinal" not in df.columns:
            first = numbered(df.select("evaluation_id").distinct(), "evaluation_id", "ordinal")
            df = df.join(first, "evaluation_id")
        self.df = df.select(*COLUMNS, "ordinal")

    @classmethod
    def from_evaluations(cls, session: SessionSchema, parts: list[DataFrame], spark) -> EvaluationTable:
        """A table of evaluations in the order given, checked together: one plan, however many parts there are."""
        if not parts:
            return cls(session, spark=spark)
        cls._of_session(session, *parts)
        numbered_parts = [p.select(*COLUMNS, F.lit(k).alias("_part")) for k, p in enumerate(parts)]
        whole = reduce(DataFrame.unionByName, numbered_parts)
        cls._whole_outputs(whole)
        ids = whole.groupBy("evaluation_id").agg(F.min("_part").alias("_part"), F.max("_part").alias("_last"))
        double = ids.where("_part <> _last").first()
        if double:
            raise EvaluationTableError("DuplicateId", f"evaluation {id_hex(bytes(double[0]))} is in the table already", id=id_hex(bytes(double[0])))
        # within the order of the parts, evaluations stand by their ids
        key = F.concat(F.lpad(F.hex("_part"), 8, "0"), F.hex("evaluation_id"))
        order = numbered(ids.select("evaluation_id", key.alias("_key")), "_key", "ordinal", beginning=10).select("evaluation_id", "ordinal")
        return cls(session, whole.drop("_part").join(order, "evaluation_id").select(*COLUMNS, "ordinal"))

    @staticmethod
    def _of_session(session: SessionSchema, *parts: DataFrame) -> None:
        own = [(f.name, f.dataType.simpleString()) for f in session.storage_type().fields]
        for p in parts:
            if [(f.name, f.dataType.simpleString()) for f in p.select(*COLUMNS).schema.fields] != own:
                raise EvaluationTableError("InvalidInputs", "the evaluation is not of the table's session")

    @staticmethod
    def _whole_outputs(evaluated: DataFrame) -> None:
        bad = evaluated.where((F.col("outcome.kind") == SUCCESS) & F.col("outputs").isNull()).orderBy(*KEYS).first()
        if bad:
            raise EvaluationTableError("InvalidOutputRow", f"row {bad['row']} of evaluation {id_hex(bytes(bad['evaluation_id']))} succeeded without outputs", row=bad["row"])

    def push(self, requests: DataFrame, results: DataFrame) -> EvaluationTable:
        """Pairs, checks and appends."""
        return self.push_evaluated(pair(requests, results))

    def push_evaluated(self, evaluated: DataFrame) -> EvaluationTable:
        self._of_session(self.session, evaluated)
        self._whole_outputs(evaluated)
        double = duplicate_ids(self.df, evaluated).first()
        if double:
            raise EvaluationTableError("DuplicateId", f"evaluation {id_hex(bytes(double[0]))} is in the table already", id=id_hex(bytes(double[0])))
        base = self.df.agg(F.coalesce(F.max("ordinal"), F.lit(-1))).first()[0] + 1
        ids = evaluated.select("evaluation_id").distinct()
        order = numbered(ids, "evaluation_id", "ordinal", base)
        return EvaluationTable(self.session, self.df.unionByName(evaluated.select(*COLUMNS).join(order, "evaluation_id").select(*COLUMNS, "ordinal")))

    def sort_by_id(self) -> EvaluationTable:
        """Evaluations in the order of their ids as numbers."""
        return EvaluationTable(self.session, self.df.drop("ordinal"))

    def ordered(self) -> DataFrame:
        return self.df.orderBy("ordinal", "row")

    def row_count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def outcomes(self) -> DataFrame:
        return self.df.select(*KEYS, "outcome")

    def outcome_counts(self) -> DataFrame:
        return self.df.groupBy(F.col("outcome.kind").alias("kind")).agg(F.count(F.lit(1)).alias("rows"))

    # ------------------------------------------------------------ features and cases

    def features(self) -> list[tuple[Feature, Column]]:
        """A feature for each input, over the rows that failed too: quantities and datetimes are continuous, ints integer,
        keys and Booleans (true, false) categorical. Other inputs are errors."""
        out = []
        for p in self.session.inputs:
            x = F.col("inputs").getField(p.name)
            match p.wire.kind:
                case "quantity" | "datetime":
                    out.append((Feature.continuous(p.name), x))
                case "int":
                    out.append((Feature.integer(p.name), x))
                case "bool" | "key":
                    out.append((Feature.categorical(p.name), x.cast("string")))
                case _:
                    raise DataError("UnsupportedFeature", f"input '{p.name}' is a {p.wire.kind} value and no feature", name=p.name, kind=p.wire.kind)
        return out

    def _guard(self, rejected: Column | None = None) -> None:
        """The first failed row in table order is an error, and so is the first row that lacks a value it must have."""
        place = F.struct("ordinal", "row")
        columns = [F.min_by(F.struct("evaluation_id", "row", message_of(F.col("outcome")).alias("why")), F.when(F.col("outcome.kind") != SUCCESS, place)).alias("failed")]
        if rejected is not None:
            columns.append(F.min_by(F.struct("evaluation_id", "row", rejected.alias("why"), "ordinal"), F.when((F.col("outcome.kind") == SUCCESS) & rejected.isNotNull(), place)).alias("absent"))
            columns.append(F.min_by("ordinal", F.when(F.col("outcome.kind") != SUCCESS, place)).alias("failed_at"))
        found = self.df.agg(*columns).first()
        bad, absent = found["failed"], found["absent"] if rejected is not None else None
        if absent and (not bad or (absent["ordinal"], absent["row"]) < (found["failed_at"], bad["row"])):
            raise EvaluationDatasetError("Condition", f"row {absent['row']} of evaluation {id_hex(bytes(absent['evaluation_id']))} has no value at '{absent['why']}'", row=absent["row"], path=absent["why"])
        if bad:
            raise EvaluationDatasetError("FailedRow", f"row {bad['row']} of evaluation {id_hex(bytes(bad['evaluation_id']))} failed: {bad['why']}", row=bad["row"], id=id_hex(bytes(bad["evaluation_id"])))

    def _classified(self, case: Column, rejected: Column | None = None) -> DataFrame:
        self._guard(rejected)
        return self.df.withColumn(CASE, case)

    def cases(self, slot: int) -> DataFrame:
        """Rows with a case column: the Boolean output at a position."""
        return self.cases_where(slot, CaseRule.is_true())

    def cases_where(self, slot: int, rule: CaseRule) -> DataFrame:
        if not 0 <= slot < len(self.session.outputs):
            raise EvaluationDatasetError("OutputSlotOutOfBounds", f"output {slot} was asked for, of {len(self.session.outputs)}", slot=slot)
        port = self.session.outputs[slot]
        if not rule.applies_to(port.wire):
            raise EvaluationDatasetError("InapplicableRule", f"rule {rule.kind} does not apply to output '{port.name}' of type {type_spelling(port.wire)}", output=port.name)
        return self._classified(rule.column(F.col("outputs").getField(port.name)))

    def cases_by(self, case: Column) -> DataFrame:
        """Cases by any Boolean column over outputs (built-in functions, or an Arrow UDF of the user's)."""
        return self._classified(case)

    def cases_matching(self, condition: CaseCondition) -> DataFrame:
        foreign = condition.first_foreign_path(self.session)
        if foreign is not None:
            raise EvaluationDatasetError("ForeignPath", f"'{foreign}' belongs to another session", path=str(foreign))
        outputs = F.col("outputs")
        return self._classified(condition.column(outputs), condition.rejected(outputs))

    def _frame(self, classified: DataFrame) -> ScenarioFrame:
        try:
            features = self.features()
            rows = classified.select(F.struct("ordinal", "row").alias("row_id"), *(c.alias(f.name) for f, c in features), CASE)
            return ScenarioFrame(rows, [f for f, _ in features], row_id="row_id")
        except DataError as e:
            raise EvaluationDatasetError("InvalidDataset", str(e), cause=e) from e

    def dataset(self, slot: int) -> ScenarioFrame:
        return self._frame(self.cases(slot))

    def dataset_where(self, slot: int, rule: CaseRule) -> ScenarioFrame:
        return self._frame(self.cases_where(slot, rule))

    def dataset_matching(self, condition: CaseCondition) -> ScenarioFrame:
        return self._frame(self.cases_matching(condition))


def key_label(column: Column) -> Column:
    """A coordinate as its label: no fraction of zero, no exponent. A power of ten is written out by a decimal cast."""
    text = column.cast("string")
    plain = F.when(F.contains(text, F.lit("E")), F.regexp_replace(F.format_string("%s", column.cast("decimal(38,18)").cast("string")), r"\.?0+$", "")).otherwise(text)
    return F.regexp_replace(plain, r"\.0$", "")
