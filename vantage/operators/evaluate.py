"""Evaluation of requests by models: rows in, outputs or recorded failures out."""

from __future__ import annotations

import collections
import math
import queue
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vantage.errors import ChunkingPolicyError, ChunkResultError, EvaluatorPoolError, InputAccessError, OutputRowError, PoolEvaluationError, VantageError
from vantage.functions import outcomes as oc
from vantage.functions.outcomes import outcome
from vantage.functions.seeds import ROW_DOMAIN, derive_seed
from vantage.schema import SessionSchema, Wire


class ModelFailure(Exception):
    """Raised by a model for a row it cannot evaluate: evaluation_error, or assertion_failed with the assertion's name."""

    def __init__(self, message: str, assertion: str | None = None):
        super().__init__(message)
        self.message, self.assertion = message, assertion


@dataclass(frozen=True)
class RowContext:
    """Where a row stands, and its own seed."""

    evaluation_id: bytes
    request_seed: int
    row_index: int

    @property
    def seed(self) -> int:
        return derive_seed(self.request_seed, self.row_index, ROW_DOMAIN)


@dataclass(frozen=True)
class InputRow:
    """Typed access to the inputs of one row, by name or position."""

    session: SessionSchema
    values: dict[str, Any]
    index: int = 0

    def _read(self, slot: str | int, kinds: tuple[str, ...]):
        ports = self.session.inputs
        port = self.session.input(slot) if isinstance(slot, str) else ports[slot] if 0 <= slot < len(ports) else None
        if port is None:
            raise InputAccessError("UnknownSlot", f"the session has no input {slot!r}", slot=slot)
        if port.wire.kind not in kinds:
            raise InputAccessError("KindMismatch", f"input '{port.name}' is a {port.wire.kind} value, not {kinds[0]}", name=port.name, expected=kinds[0], actual=port.wire.kind)
        return self.values[port.name]

    def quantity(self, slot: str | int) -> float:
        return self._read(slot, ("quantity",))

    def datetime(self, slot: str | int) -> float:
        return self._read(slot, ("datetime",))

    def int(self, slot: str | int) -> int:
        return self._read(slot, ("int",))

    def bool(self, slot: str | int) -> bool:
        return self._read(slot, ("bool",))

    def key(self, slot: str | int) -> str:
        return self._read(slot, ("key",))

    def value(self, slot: str | int):
        return self._read(slot, ("quantity", "int", "bool", "key", "complex", "datetime", "indexed", "algebraic"))


Model = Callable[[InputRow, RowContext], list | tuple]


def conforms(value, wire: Wire) -> bool:
    """Whether a Python value is one of a wire type: floats finite, keys on their axis, records and unions complete."""
    match wire.kind:
        case "quantity" | "datetime":
            return isinstance(value, float | int) and not isinstance(value, bool) and math.isfinite(value)
        case "int":
            return isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63
        case "bool":
            return isinstance(value, bool)
        case "key":
            return isinstance(value, str) and value in wire.axis.labels()
        case "complex":
            return isinstance(value, dict) and set(value) == {"re", "im"} and all(isinstance(x, float | int) and math.isfinite(x) for x in value.values())
        case "indexed":
            return isinstance(value, list | tuple) and len(value) == len(wire.axis) and all(conforms(v, wire.element) for v in value)
    if not isinstance(value, dict):
        return False
    if not wire.is_union:
        own = wire.fields()
        return set(value) == set(own) and all(conforms(value[n], w) for n, w in own.items())
    tag = value.get("_tag")
    if tag not in dict(wire.variants):
        return False
    own = wire.fields(tag)
    held = value.get(tag) or {}
    return set(held) == set(own) and all(conforms(held[n], w) for n, w in own.items())


def checked_outputs(session: SessionSchema, values) -> dict[str, Any]:
    """Outputs by name; another number of values, or the first value of another kind, is an error."""
    if len(values) != len(session.outputs):
        raise OutputRowError("CountMismatch", f"expected {len(session.outputs)} outputs, not {len(values)}", expected=len(session.outputs), actual=len(values))
    for port, value in zip(session.outputs, values, strict=True):
        if not conforms(value, port.wire):
            raise OutputRowError("KindMismatch", f"output '{port.name}' has a value of another kind", output=port.name)
    return {p.name: float(v) if p.wire.kind in ("quantity", "datetime") else v for p, v in zip(session.outputs, values, strict=True)}


def out_of_domain(session: SessionSchema, values: dict[str, Any]) -> dict | None:
    """Outcome for the first input, in session order, outside its closed domain."""
    for p in session.inputs:
        if p.domain is not None and p.wire.kind in ("quantity", "int") and not p.domain.holds(values[p.name]):
            return outcome(oc.INPUT_OUT_OF_DOMAIN, p.name, oc.violation(p.domain.min, p.domain.max, oc.shown(values[p.name])))
    return None


def evaluate_row(session: SessionSchema, model: Model, values: dict[str, Any], context: RowContext) -> tuple[dict | None, dict]:
    """Outputs and outcome of one row: its domain, then the model, then the model's outputs are checked."""
    if outside := out_of_domain(session, values):
        return None, outside
    try:
        return checked_outputs(session, model(InputRow(session, values, context.row_index), context)), outcome(oc.SUCCESS)
    except ModelFailure as e:
        return None, outcome(oc.ASSERTION_FAILED, e.assertion, e.message) if e.assertion else outcome(oc.EVALUATION_ERROR, message=e.message)
    except InputAccessError as e:
        return None, outcome(oc.EVALUATION_ERROR, message=str(e))
    except OutputRowError as e:
        if e.variant == "CountMismatch":
            return None, outcome(oc.OUTPUT_COUNT_MISMATCH, expected_count=e.expected, actual_count=e.actual)
        return None, outcome(oc.OUTPUT_KIND_MISMATCH, e.output)
    except Exception as e:  # what a model lets escape is that row's failure and nobody else's
        said = e.args[0] if len(e.args) == 1 else str(e)
        return None, outcome(oc.PANIC, message=said) if isinstance(said, str) else outcome(oc.NON_STRING_PANIC)


class Evaluator(Protocol):
    """Evaluates requests (evaluation_id, row, seed, inputs) to results (evaluation_id, row, outputs, outcome)."""

    session: SessionSchema

    def evaluate(self, requests: DataFrame) -> DataFrame: ...


def _mapped(session: SessionSchema, model: Model, requests: DataFrame) -> DataFrame:
    result = session.result_type()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(result)
        for part in parts:
            columns = [part.column(c).to_pylist() for c in ("evaluation_id", "row", "seed", "inputs")]
            done = [evaluate_row(session, model, i, RowContext(bytes(e), int(s), r)) for e, r, s, i in zip(*columns, strict=True)]
            arrays = [part.column("evaluation_id"), part.column("row"), pa.array([o for o, _ in done], kind.field("outputs").type), pa.array([o for _, o in done], kind.field("outcome").type)]
            yield pa.record_batch(arrays, names=kind.names)

    return requests.select("evaluation_id", "row", "seed", "inputs").mapInArrow(run, result)


def rejected_rows(session: SessionSchema, requests: DataFrame) -> DataFrame:
    """Results of requests that are of another session: the model is not called."""
    nothing = F.lit(None).cast(session.output_type())
    return requests.select("evaluation_id", "row", nothing.alias("outputs"), oc.outcome_column(oc.INVALID_INPUT).alias("outcome"))


def is_of(session: SessionSchema, requests: DataFrame) -> bool:
    return requests.schema["inputs"].dataType.simpleString() == session.input_type().simpleString()


@dataclass
class InProcessEvaluator:
    """One task, rows in order: for small runs and tests."""

    session: SessionSchema
    model: Model

    def evaluate(self, requests: DataFrame) -> DataFrame:
        if not is_of(self.session, requests):
            return rejected_rows(self.session, requests)
        return _mapped(self.session, self.model, requests.coalesce(1).sortWithinPartitions("evaluation_id", "row"))


@dataclass(frozen=True)
class ChunkingPolicy:
    """Rows of one work item."""

    rows_per_chunk: int

    def __post_init__(self):
        if self.rows_per_chunk < 1:
            raise ChunkingPolicyError("ZeroRowsPerChunk", "a work item has one row at least")


@dataclass
class ParallelEvaluator:
    """Rows are dealt to tasks by chunk; Spark schedules them and runs lost ones again."""

    session: SessionSchema
    model: Model
    chunking: ChunkingPolicy = ChunkingPolicy(1024)
    partitions: int | None = None

    def evaluate(self, requests: DataFrame) -> DataFrame:
        if not is_of(self.session, requests):
            return rejected_rows(self.session, requests)
        chunk = F.expr(f"row div {self.chunking.rows_per_chunk}")
        keys = ["evaluation_id", chunk]
        dealt = requests.repartition(self.partitions, *keys) if self.partitions else requests.repartition(*keys)
        return _mapped(self.session, self.model, dealt)


@dataclass
class ExternalEvaluator:
    """The connector to a model server: `serve` opens a connection in each task and returns a function from a batch of
    requests to a batch of results. The request seed is not sent; an error of the session ends the run."""

    session: SessionSchema
    serve: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]

    def evaluate(self, requests: DataFrame) -> DataFrame:
        if not is_of(self.session, requests):
            return rejected_rows(self.session, requests)
        serve = self.serve

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            send = serve()
            for part in parts:
                yield send(part)
            close = getattr(send, "close", None)
            if close:
                close()

        return requests.select("evaluation_id", "row", "inputs").mapInArrow(run, self.session.result_type())


#: Status of a request in a pool's report.
EVALUATED, FAILED, PANICKED, MISSING, NOT_EVALUATED = "evaluated", "evaluator", "panic", "missing_result", "not_evaluated"
_STATUS = {"Evaluator": FAILED, "Panic": PANICKED, "MissingResult": MISSING, "NotEvaluated": NOT_EVALUATED}


class EvaluatorFailure(Exception):
    """Raised by an evaluator that fails as a whole."""


class EvaluatorPool:
    """Evaluators of one session that share the requests of a run. An evaluator that raises stops, its request is reported
    and the others go on; when none is left the rest is reported as not evaluated."""

    def __init__(self, evaluators: list[Evaluator]):
        if not evaluators:
            raise EvaluatorPoolError("NoEvaluators", "a pool has one evaluator at least")
        for k, e in enumerate(evaluators):
            if e.session != evaluators[0].session:
                raise EvaluatorPoolError("SchemaMismatch", f"evaluator {k} is of another session than evaluator 0", position=k)
        self.evaluators = list(evaluators)
        self.running = list(evaluators)
        self.session = evaluators[0].session

    @property
    def evaluator_count(self) -> int:
        return len(self.evaluators)

    @property
    def running_count(self) -> int:
        return len(self.running)

    def into_evaluators(self) -> list[Evaluator]:
        return self.evaluators

    def results(self, requests: list[DataFrame]) -> PoolResults:
        """The results of each request (a DataFrame of one evaluation) as they come; see PoolResults."""
        return PoolResults(self, requests)

    def evaluate(self, requests: list[DataFrame], sink: Callable[[DataFrame], None]) -> list[tuple[int, str, str | None]]:
        """Gives the results of each request to sink as they come, in the caller's thread; a report (position, status, message) for
        each request."""
        report: dict[int, tuple[str, str | None]] = {}
        with self.results(requests) as items:
            for item in items:
                if item.error is None:
                    sink(item.results)
                    item.results.unpersist()
                    report[item.position] = (EVALUATED, None)
                else:
                    report[item.position] = (_STATUS[item.error.variant], str(item.error))
        return [(k, *report[k]) for k in range(len(requests))]


@dataclass(frozen=True)
class PoolItem:
    """A request's place in the run, and its results, cached, or why there are none."""

    position: int
    results: DataFrame | None = None
    error: PoolEvaluationError | None = None


class PoolResults:
    """Items of a pool's run in the order in which they are done.

    Each running evaluator has a thread of the driver that submits its jobs; models run there, side by side, and the one who
    iterates only takes what is done. An evaluator that fails stops. Closing, or leaving a with block, takes the requests that
    wait out of the run, and returns when those begun are done; the evaluators are free then.
    """

    def __init__(self, pool: EvaluatorPool, requests: list[DataFrame]):
        self._pool = pool
        self._waiting = collections.deque(enumerate(requests))
        self._done: queue.Queue[PoolItem | None] = queue.Queue()
        self._threads = [threading.Thread(target=self._work, args=(e,), daemon=True) for e in list(pool.running)]
        self._alive = len(self._threads)
        for t in self._threads:
            t.start()

    def _take(self) -> tuple[int, DataFrame] | None:
        try:
            return self._waiting.popleft()
        except IndexError:
            return None

    def _work(self, evaluator: Evaluator) -> None:
        try:
            while (taken := self._take()) is not None:
                position, request = taken
                try:
                    found = evaluator.evaluate(request)
                    found = found.persist(StorageLevel.MEMORY_AND_DISK) if found is not None else None
                    error = None if found is not None and found.count() else PoolEvaluationError("MissingResult", f"the evaluator returned no result for request {position}", position=position)
                except (EvaluatorFailure, VantageError, PySparkException) as e:
                    error = PoolEvaluationError("Evaluator", f"the evaluator failed on request {position}: {_first_line(e)}", position=position, source=e)
                except Exception as e:
                    error = PoolEvaluationError("Panic", f"the evaluator panicked on request {position}: {_first_line(e)}", position=position, source=e)
                if error is not None and evaluator in self._pool.running:
                    self._pool.running.remove(evaluator)
                self._done.put(PoolItem(position, None if error else found, error))
                if error is not None:
                    return
        finally:
            self._done.put(None)

    def __iter__(self) -> PoolResults:
        return self

    def __next__(self) -> PoolItem:
        while self._alive:
            if (item := self._done.get()) is not None:
                return item
            self._alive -= 1
        if (taken := self._take()) is not None:
            position = taken[0]
            return PoolItem(position, error=PoolEvaluationError("NotEvaluated", f"request {position} was not evaluated: every evaluator of the pool has stopped", position=position))
        raise StopIteration

    def close(self) -> None:
        self._waiting.clear()
        for t in self._threads:
            t.join()

    def __enter__(self) -> PoolResults:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _first_line(e: Exception) -> str:
    return str(e).splitlines()[0] if str(e) else type(e).__name__


def chunk_result(rows: list) -> list:
    """Outcomes of one request; there is one at least."""
    if not rows:
        raise ChunkResultError("NoRows", "a result has one row at least")
    return rows
