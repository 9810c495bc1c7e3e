"""What the operators of this subpackage share: shared-storage tables, components of a graph, array tokenising."""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an explicit broadcast may have; beyond it the shuffling form is used.
BROADCAST_ROWS = 500_000
#: Bytes of rows that Spark hands to a Python worker at once, where the session does not say (10,000 rows otherwise).
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession) -> None:
    """Bounds what a Python worker and the executor's buffers hold, whatever the length of texts."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is made only where one machine runs everything."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "local-cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir for local-cluster")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="vantage-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    lean(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table has few enough rows to be broadcast (its count comes from Parquet footers)."""
    return df.count() <= rows


def components(edges: DataFrame) -> DataFrame:
    """Smallest member of each node's component: columns node, component, for every node of edges (a, b).

    Alternating large-star and small-star steps. Each step keeps one edge per node and neighbour, its
    groupings combine on the map side, and its output is stored so that lineage stays flat.
    Null ends and loops are ignored; an empty table gives an empty result.
    """
    now = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    spark = edges.sparkSession
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u > v").distinct(), "large")
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(first, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = step.unionByName(first.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        step = stored(step, "small")
        done = step.count() == step.select("u").distinct().count() and step.join(
            step.select(F.col("u").alias("v")).distinct(), "v", "left_semi"
        ).isEmpty()
        forget(now)
        forget(large)
        now = step
        if done:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stored(pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct()), "components")


# ---------------------------------------------------------------- arrays of text

#: Odd, so that its powers have inverses modulo 2**64.
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


#: Bytes that span_hashes works on at a time.
_WINDOW = 1 << 18
_CACHE: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse below n, at most _WINDOW."""
    if not _CACHE:
        _CACHE.extend((_powers(_P, _WINDOW), _powers(_P_INV, _WINDOW)))
    return _CACHE[0][:n], _CACHE[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        out = x >> np.uint64(30)  # one array is worked on, not a new one for each step
        out ^= x
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(27)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return out


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins and ends (nulls are empty)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]).astype(np.int64)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand.

    Spans ascend and do not overlap. Bytes are taken a window at a time, so what is held beside them is bounded.
    """
    out = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for low in range(0, len(data), _WINDOW):
            high = min(low + _WINDOW, len(data))
            first, last = np.searchsorted(end, low, "right"), np.searchsorted(begin, high, "left")
            if first >= last:
                continue
            up, down = _tables(high - low)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
            b, e = np.maximum(begin[first:last], low), np.maximum(np.minimum(end[first:last], high), low)
            part = (total[e - low] - total[b - low]) * down[np.minimum(b - low, high - low - 1)]
            if b[0] > begin[first]:  # only the first can have begun before this window
                part[0] *= np.uint64(pow(int(_P), int(b[0] - begin[first]), 1 << 64))
            out[first:last] += part
        return mix(out + (end - begin).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray, separates: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words of each text: text number, begin, end, hash of each word."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separates[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    touching = cut[inside[cut + 1] & inside[cut]]
    begins[touching] = True
    ends[touching - 1] = True
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(bounds, begin, "right") - 1
    return doc, begin, end, span_hashes(data, begin, end)


def release() -> None:
    """Gives freed memory back to the system: a worker lives through many stages, beside an executor of fixed size."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


_HANDED = [0]


def batches(table_of: pa.RecordBatch, column: str, limit: int = 512_000):
    """Parts of a batch whose texts together have at most limit bytes (one text at least)."""
    column_of = table_of.column(column)
    sizes = pc.fill_null(pc.binary_length(column_of), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > first:
            yield table_of.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield table_of.slice(first)
    _HANDED[0] += 1
    if _HANDED[0] % 32 == 0:  # after each batch it would cost as much as the work
        release()


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def bloom(keys: DataFrame, column: str, bits: int = 24) -> bytes:
    """A Bloom filter of 2**bits bits with two probes over a column of well-mixed 64-bit hashes.

    Its size is fixed: at most 2**(bits-6) words come to the driver however many keys there are. Where many keys
    fill it, it lets more rows through, and the join that follows decides as before.
    """
    probes = F.explode(F.array(*_probes(F.col(column), bits)))
    rows = (
        keys.select(probes.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("mask"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return out.tobytes()


def _probes(x: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1)
    return [x.bitwiseAND(mask), F.shiftrightunsigned(x, 32).bitwiseAND(mask)]


def bloom_has(packed: bytes, hashed: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes the filter may hold."""
    bytes_of = np.frombuffer(packed, np.uint8)
    mask = np.uint64(len(packed) * 8 - 1)
    hashed = hashed.view(np.uint64)
    first = (hashed & mask).astype(np.int64)
    out = (bytes_of[first >> 3] >> (first & 7).astype(np.uint8)) & 1 == 1
    left = np.flatnonzero(out)
    second = ((hashed[left] >> np.uint64(32)) & mask).astype(np.int64)
    out[left] = (bytes_of[second >> 3] >> (second & 7).astype(np.uint8)) & 1 == 1
    return out


def public_dir() -> str:
    return os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
