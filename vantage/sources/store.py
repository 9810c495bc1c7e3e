"""Stored evaluation tables: appended Parquet, and Arrow streams with one record batch for each evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from vantage.errors import EvaluationDecodeError, EvaluationReadError, EvaluationTableError, EvaluationWriteError
from vantage.functions import outcomes as oc
from vantage.functions.seeds import id_hex
from vantage.operators.table import COLUMNS, EvaluationTable
from vantage.schema import LAYOUT_KEY, LAYOUT_VERSION, SESSION_KEY, SessionSchema

# ---------------------------------------------------------------- Parquet


def append_parquet(table: DataFrame, path: str, session: SessionSchema) -> None:
    """Appends evaluations to a folder; the writer commits all of them or none. Ids that are there already are an error. The
    session goes with the columns, as metadata."""
    spark = table.sparkSession
    if _exists(spark, path):
        double = spark.read.parquet(path).select("evaluation_id").join(table.select("evaluation_id").distinct(), "evaluation_id", "left_semi").first()
        if double:
            raise EvaluationTableError("DuplicateId", f"evaluation {id_hex(bytes(double[0]))} is stored already", id=id_hex(bytes(double[0])))
    about = session.storage_type()["evaluation_id"].metadata
    table.select(F.col("evaluation_id").alias("evaluation_id", metadata=about), *COLUMNS[1:]).write.mode("append").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> EvaluationTable:
    """The table and its session, which the column metadata holds."""
    df = spark.read.parquet(path)
    session = SessionSchema.from_storage_type(df.schema)
    check_stored(df)
    return EvaluationTable(session, df)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def check_stored(df: DataFrame) -> None:
    """Rows of an evaluation are 0, 1, 2, … with one seed, outcomes are known and complete, successes have outputs and
    failures none. One aggregation by evaluation finds the first fault."""
    fault = oc.undecodable(F.col("outcome"))
    success = F.col("outcome.kind") == oc.SUCCESS
    per = df.groupBy("evaluation_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("row").alias("low"),
        F.max("row").alias("high"),
        F.count_distinct("row").alias("rows"),
        F.min("seed").alias("a"),
        F.max("seed").alias("b"),
        F.min(fault).alias("fault"),
        F.count_if(success & F.col("outputs").isNull() | ~success & F.col("outputs").isNotNull()).alias("odd"),
        F.count_if(F.col("inputs").isNull()).alias("empty"),
    )
    kind = (
        F.when((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("rows") != F.col("n")), "RowOrder")
        .when(F.col("a") != F.col("b"), "SeedMismatch")
        .when(F.col("empty") > 0, "Inputs")
        .when(F.col("fault").isNotNull(), F.split("fault", ":")[0])
        .when(F.col("odd") > 0, "OutcomeValues")
    )
    bad = per.select("evaluation_id", kind.alias("kind"), "fault").where("kind is not null").orderBy("evaluation_id").first()
    if bad:
        name = id_hex(bytes(bad["evaluation_id"]))
        raise EvaluationDecodeError(bad["kind"], f"evaluation {name} cannot be read: {bad['kind']}", id=name)


# ---------------------------------------------------------------- Arrow streams


def arrow_schema(session: SessionSchema) -> pa.Schema:
    return to_arrow_schema(session.storage_type()).with_metadata({LAYOUT_KEY: str(LAYOUT_VERSION), SESSION_KEY: session.to_json()})


class EvaluationWriter:
    """Writes evaluations to a binary stream, each as one record batch that is flushed at once."""

    def __init__(self, sink: BinaryIO, session: SessionSchema):
        self.session, self.sink = session, sink
        self.schema = arrow_schema(session)
        self.writer = pa.ipc.new_stream(sink, self.schema)

    def write(self, evaluation: DataFrame | pa.Table) -> None:
        """One evaluation, in row order. A table of another session is refused."""
        table = evaluation if isinstance(evaluation, pa.Table) else evaluation.select(*COLUMNS).orderBy("row").toArrow()
        if table.schema.names != self.schema.names or [f.type for f in table.schema] != [f.type for f in self.schema]:
            raise EvaluationWriteError("Session", "the evaluation is not of the stream's session")
        try:
            for batch in table.cast(self.schema).combine_chunks().to_batches():
                self.writer.write_batch(batch)
            self.sink.flush()
        except (pa.ArrowException, OSError) as e:
            raise EvaluationWriteError("Arrow", str(e)) from e

    def write_table(self, table: EvaluationTable) -> None:
        """All evaluations in table order, from one sorted pass. A stream is a file of one writer, so rows come to the driver, one
        partition at a time; what it holds besides is one evaluation."""
        rows = table.df.orderBy("ordinal", "row").select(*COLUMNS)
        held: list[dict] = []
        for row in rows.toLocalIterator(prefetchPartitions=True):
            if held and held[-1]["evaluation_id"] != row["evaluation_id"]:
                self._flush(held)
            held.append(row.asDict(recursive=True))
        if held:
            self._flush(held)

    def _flush(self, held: list[dict]) -> None:
        kind = to_arrow_schema(self.session.storage_type())
        whole = pa.table([pa.array([r[f.name] for r in held], f.type) for f in kind], schema=kind)
        held.clear()
        self.write(whole)

    def finish(self) -> None:
        self.writer.close()


def _evaluations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole evaluations: a batch may hold several, and an evaluation may span batches; empty batches are skipped. Rows of
    an evaluation must stand together, in order and with one seed."""
    held: list[pa.Table] = []
    now, done = None, set()
    for batch in batches:
        ids = batch.column("evaluation_id").to_pylist()
        start = 0
        while start < len(ids):
            stop = start
            while stop < len(ids) and ids[stop] == ids[start]:
                stop += 1
            part = pa.Table.from_batches([batch.slice(start, stop - start)])
            if ids[start] != now:
                if held:
                    yield _checked(held)
                    done.add(now)
                if ids[start] in done:
                    raise EvaluationDecodeError("Table", f"rows of evaluation {ids[start].hex()} stand apart")
                held, now = [], ids[start]
            held.append(part)
            start = stop
    if held:
        yield _checked(held)


def _checked(parts: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(parts).combine_chunks()
    name = table.column("evaluation_id")[0].as_py().hex()
    if table.column("row").to_pylist() != list(range(len(table))):
        raise EvaluationDecodeError("RowOrder", f"rows of evaluation {name} are not 0, 1, 2, …", id=name)
    if len(table.column("seed").unique()) != 1:
        raise EvaluationDecodeError("SeedMismatch", f"evaluation {name} has several seeds", id=name)
    for o, out in zip(table.column("outcome").to_pylist(), table.column("outputs").is_valid().to_pylist(), strict=True):
        if o["kind"] not in oc.KINDS:
            raise EvaluationDecodeError("UnknownOutcome", f"'{o['kind']}' is no outcome", id=name)
        for part in oc.PARTS.get(o["kind"], ()):
            if o[part] is None:
                raise EvaluationDecodeError("MissingOutcomePart", f"outcome {o['kind']} lacks its {part}", id=name)
        if (o["kind"] == oc.SUCCESS) != out:
            raise EvaluationDecodeError("OutcomeValues", f"outcome {o['kind']} and outputs disagree", id=name)
    return table


@dataclass
class Recovered:
    """What could be read, and why reading stopped (None at the end of the stream)."""

    table: list[pa.Table]
    stopped_by: str | None


class EvaluationReader:
    """Reads a stream's session and its evaluations, strictly or up to the first unreadable message."""

    def __init__(self, source):
        try:
            self.reader = pa.ipc.open_stream(source)
        except (pa.ArrowException, OSError, EOFError) as e:
            raise EvaluationReadError("Arrow", str(e)) from e
        about = self.reader.schema.metadata or {}
        self.session = SessionSchema.from_metadata(*(about[k.encode()].decode() if k.encode() in about else None for k in (LAYOUT_KEY, SESSION_KEY)))
        if not self.reader.schema.equals(arrow_schema(self.session), check_metadata=False):
            raise EvaluationDecodeError("Schema", "the stream's columns are not those of its session")

    def _batches(self, stopped: list[str] | None) -> Iterator[pa.RecordBatch]:
        while True:
            try:
                batch = self.reader.read_next_batch()
            except StopIteration:
                return
            except (pa.ArrowException, OSError, EOFError) as e:
                if stopped is None:
                    raise EvaluationReadError("Arrow", str(e)) from e
                stopped.append(str(e))
                return
            yield batch

    def read_table(self) -> list[pa.Table]:
        return list(_evaluations(self._batches(None)))

    def recover_table(self) -> Recovered:
        """Evaluations before the first message that cannot be read. Messages that can be read but not decoded stay errors;
        a stream that ends between messages looks finished."""
        stopped: list[str] = []
        whole = list(_evaluations(self._batches(stopped)))
        return Recovered(whole, stopped[0] if stopped else None)


def to_evaluation_table(spark: SparkSession, session: SessionSchema, parts: list[pa.Table]) -> EvaluationTable:
    kind = session.storage_type()
    if not parts:
        return EvaluationTable(session, spark=spark)
    numbers = pa.chunked_array([pa.array(np.full(len(p), k, np.int64)) for k, p in enumerate(parts)])
    whole = pa.concat_tables([p.cast(arrow_schema(session).remove_metadata()) for p in parts]).append_column("ordinal", numbers)
    return EvaluationTable(session, spark.createDataFrame(whole, T.StructType([*kind.fields, T.StructField("ordinal", T.LongType(), False)])))


class _StreamFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _StreamReader(DataSourceReader):
    def __init__(self, paths: list[str], strict: bool):
        self.paths, self.strict = paths, strict

    def partitions(self):
        return [_StreamFile(p) for p in self.paths]

    def read(self, partition):
        from pyarrow import fs

        where = partition.path if "://" in partition.path or partition.path.startswith("file:") else f"file://{partition.path}"
        system, path = fs.FileSystem.from_uri(where)
        with system.open_input_stream(path, compression=None) as file:
            reader = EvaluationReader(file)
            for table in reader.read_table() if self.strict else reader.recover_table().table:
                yield from table.to_batches()


class ArrowStreamSource(DataSource):
    """spark.read.format("evaluation_stream").option("paths", "a.arrows,b.arrows"): one task for each file; mode=PERMISSIVE reads what is whole,
    FAILFAST (the default) fails on a truncated file. Files of one read are of one session."""

    @classmethod
    def name(cls) -> str:
        return "evaluation_stream"

    def _paths(self) -> list[str]:
        return [p for p in (self.options.get("paths") or self.options["path"]).split(",") if p]

    def schema(self):
        from pyarrow import fs

        first = self._paths()[0]
        system, path = fs.FileSystem.from_uri(first if "://" in first or first.startswith("file:") else f"file://{first}")
        with system.open_input_stream(path, compression=None) as file:
            return EvaluationReader(file).session.storage_type()

    def reader(self, schema):
        return _StreamReader(self._paths(), self.options.get("mode", "FAILFAST").upper() != "PERMISSIVE")
