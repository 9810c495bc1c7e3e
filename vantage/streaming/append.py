"""Evaluation tables that grow while a run goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vantage.operators.evaluate import Evaluator
from vantage.operators.table import COLUMNS, KEYS
from vantage.schema import SessionSchema


def append_batch(rows: DataFrame, number: int, path: str) -> None:
    """Commits one micro-batch under its number. Evaluations that another batch stored stay out, and a batch that runs again
    after a failure replaces itself, so nothing is added twice."""
    spark = rows.sparkSession
    rows = rows.select(*COLUMNS).dropDuplicates(KEYS)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        there = spark.read.parquet(path).where(F.col("batch") != number).select("evaluation_id").distinct()
        rows = rows.join(there, "evaluation_id", "left_anti").select(*COLUMNS)
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def append_stream(evaluated: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream of evaluated rows to a Parquet folder. stop() ends it; what is committed stays readable."""
    writer = evaluated.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: append_batch(batch, number, path))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def evaluate_stream(spark: SparkSession, session: SessionSchema, requests_path: str, evaluator: Evaluator, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Evaluates request files as they arrive in a folder and appends the evaluations."""

    def add(batch: DataFrame, number: int) -> None:
        append_batch(batch.join(evaluator.evaluate(batch), KEYS), number, path)

    writer = spark.readStream.schema(session.request_type()).parquet(requests_path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
