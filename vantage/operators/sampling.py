"""Designs: uniform and Latin hypercube samples of a session's inputs.

Draws come from a counter-based generator: the value of a row depends on the seed, the input and the row alone, and not on
partitioning. Identifiers and seeds follow the documented derivation; the draws themselves are this library's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.errors import SamplingError
from vantage.functions import seeds
from vantage.schema import Port, SessionSchema

#: Rows up to which a double counts every stratum exactly.
MAX_STRATA = 1 << 53


def _check(session: SessionSchema, rows: int) -> None:
    if rows < 1:
        raise SamplingError("NoRows", "a sample has one row at least")
    if rows > (1 << 63) - 1:
        raise SamplingError("RowCountOverflow", f"{rows} rows are more than can be numbered", rows=rows)
    for p in session.inputs:
        if p.wire.kind in ("complex", "indexed", "algebraic"):
            raise SamplingError("UnsupportedInput", f"input '{p.name}' is a {p.wire.kind} value, which is not sampled", name=p.name, kind=p.wire.kind)
        if p.wire.kind in ("quantity", "datetime", "int"):
            if p.domain is None or p.domain.min is None or p.domain.max is None:
                raise SamplingError("UnboundedInput", f"input '{p.name}' needs both bounds to be sampled", name=p.name)
            if p.wire.kind != "int" and not math.isfinite(p.domain.max - p.domain.min):
                raise SamplingError("UnsampleableDomain", f"the domain of input '{p.name}' is too wide", name=p.name)


def _unit(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _words(stream: int, rows: np.ndarray) -> np.ndarray:
    return seeds.splitmix64_array(np.uint64(stream) ^ seeds.splitmix64_array(rows.astype(np.uint64)))


def permuted(rows: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at some positions: a Feistel network, walked until it falls below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = rows.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        x = out[open_]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            f = seeds.splitmix64_array(right ^ np.uint64(seeds.derive_seed(key, r, 0)))
            left, right = right, left ^ (f & mask)
        out[open_] = left << np.uint64(half) | right
        open_ = open_[out[open_] >= np.uint64(n)]
    return out.astype(np.int64)


def _levels(port: Port) -> tuple[list | None, int, int]:
    """Entries of a discrete input (or None for a range of integers), its first integer and its number of levels."""
    if port.wire.kind == "int":
        return None, port.domain.min, port.domain.max - port.domain.min + 1
    entries = [False, True] if port.wire.kind == "bool" else port.wire.axis.labels()
    return entries, 0, len(entries)


def discrete_level(stratum: int, cardinality: int, rows: int) -> int:
    """Level of a stratum: levels are met equally often, give or take one."""
    return (stratum * cardinality + cardinality // 2) // rows


def _column(port: Port, rows: np.ndarray, n: int, stream: int, hypercube: bool) -> pa.Array:
    kind = port.wire.kind
    if kind in ("quantity", "datetime"):
        low, high = float(port.domain.min), float(port.domain.max)
        unit = _unit(_words(stream, rows))
        if hypercube:
            unit = (permuted(rows, n, seeds.splitmix64(stream)) + unit) / n
        return pa.array(np.clip(low + unit * (high - low), low, high))
    entries, first, count = _levels(port)
    if hypercube:
        strata = permuted(rows, n, seeds.splitmix64(stream))
        if n * count + count < 1 << 63:
            level = (strata * count + count // 2) // n
        else:  # products beyond 64 bits
            level = [discrete_level(int(s), count, n) for s in strata]
    else:
        words = _words(stream, rows)
        level = [int(w) * count >> 64 for w in words.tolist()] if count >= 1 << 32 else ((words >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    if entries is None:
        return pa.array([first + int(k) for k in level], pa.int64())
    return pa.array(np.array(entries)[np.asarray(level, np.int64)].tolist())


def _sampled(spark: SparkSession, session: SessionSchema, rows: int, run_seed: int, sequence: int, hypercube: bool) -> DataFrame:
    _check(session, rows)
    request, feature = (seeds.LHS_REQUEST_DOMAIN, seeds.LHS_FEATURE_DOMAIN) if hypercube else (seeds.SAMPLE_REQUEST_DOMAIN, seeds.SAMPLE_FEATURE_DOMAIN)
    root = seeds.derive_seed(run_seed, sequence, request)
    streams = [seeds.derive_seed(root, k, feature) for k in range(len(session.inputs))]
    kinds = session.input_type()

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for part in parts:
            at = part.column("id").to_numpy()
            columns = [_column(p, at, rows, s, hypercube).cast(to_arrow_type(f.dataType)) for p, s, f in zip(session.inputs, streams, kinds.fields, strict=True)]
            yield pa.record_batch([part.column("id"), *columns], names=["row", *(p.name for p in session.inputs)])

    schema = "row long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
    drawn = spark.range(rows).mapInArrow(draw, schema)
    identifier, seed = seeds.evaluation_id(run_seed, sequence), seeds.derive_seed(run_seed, sequence, seeds.MODEL_DOMAIN)
    own = F.struct(*(F.col(f"`{p.name}`") for p in session.inputs)).cast(kinds)
    df = drawn.select(F.lit(identifier).alias("evaluation_id"), "row", F.lit(str(seed)).cast("decimal(20,0)").alias("seed"), own.alias("inputs"))
    return df


def sample_uniform(spark: SparkSession, session: SessionSchema, rows: int, run_seed: int, sequence: int) -> DataFrame:
    """One request: independent uniform draws within closed bounds; keys and Booleans are equally likely."""
    return _sampled(spark, session, rows, run_seed, sequence, False)


def sample_latin_hypercube(spark: SparkSession, session: SessionSchema, rows: int, run_seed: int, sequence: int) -> DataFrame:
    """One request: every continuous input has one row in each of `rows` equal strata, every discrete one meets its levels
    equally often, in orders of their own."""
    if rows > MAX_STRATA and any(p.wire.kind in ("quantity", "datetime") for p in session.inputs):
        raise SamplingError("TooManyContinuousStrata", f"{rows} strata are more than doubles tell apart", rows=rows)
    return _sampled(spark, session, rows, run_seed, sequence, True)
