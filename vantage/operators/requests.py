"""Requests: batches of input rows under one identifier and seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.errors import RequestSplitError
from vantage.functions.seeds import SPLIT_DOMAIN, id_hex, id_plus, seed_column


def split(requests: DataFrame, rows_per_request: int) -> DataFrame:
    """Consecutive chunks of each request: chunk k has the identifier plus k, a seed derived from k, and rows from 0.

    A request whose last chunk would not fit the low 64 bits of its identifier is an error, found before anything is split.
    """
    if rows_per_request < 1:
        raise ValueError("a chunk has one row at least")
    chunk = F.expr(f"row div {rows_per_request}")
    low = F.conv(F.hex(F.substring("evaluation_id", 9, 8)), 16, 10).cast("decimal(20,0)")
    over = requests.groupBy("evaluation_id").agg((F.first(low) + F.max(chunk)).alias("last")).where(F.col("last") > F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")).first()
    if over:
        name = id_hex(bytes(over["evaluation_id"]))
        raise RequestSplitError("SequenceOverflow", f"the chunks of request {name} leave its 64-bit sequence", id=name)
    others = [c for c in requests.columns if c not in ("evaluation_id", "row", "seed")]
    return requests.select(
        id_plus(F.col("evaluation_id"), chunk).alias("evaluation_id"),
        (F.col("row") - chunk * rows_per_request).alias("row"),
        seed_column(F.col("seed"), chunk, SPLIT_DOMAIN).alias("seed"),
        *others,
    )
