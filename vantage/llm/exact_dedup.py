"""Exact duplicates by counting quotient filters.

Every partition keeps a counting quotient filter of its text fingerprints. Filters are cut by quotient, so
that equal quotients of all partitions meet, and merge without loss because remainders are sorted within a
quotient. A fingerprint with a count above one sends its rows to a comparison of the texts themselves.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.shared import small, stored

#: Bits of a quotient; the other bits of a 64-bit fingerprint are the remainder.
QUOTIENT_BITS = 20
_R = np.uint64(64 - QUOTIENT_BITS)


@dataclass
class CountingQuotientFilter:
    """Runs of sorted remainders, one run per occupied quotient, with a count for each remainder."""

    quotients: np.ndarray  # uint32, ascending: the occupied ones
    runs: np.ndarray  # uint32: remainders in each run
    remainders: np.ndarray  # uint64, ascending within a run
    counts: np.ndarray  # uint64

    @classmethod
    def of_counts(cls, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From ascending distinct fingerprints."""
        quotients, runs = np.unique((fingerprints >> _R).astype(np.uint32), return_counts=True)
        return cls(quotients, runs.astype(np.uint32), fingerprints & ((np.uint64(1) << _R) - np.uint64(1)), counts.astype(np.uint64))

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls.of_counts(*np.unique(fingerprints.view(np.uint64), return_counts=True))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order and their counts: nothing is lost."""
        return (np.repeat(self.quotients.astype(np.uint64), self.runs) << _R) | self.remainders, self.counts

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Quotient by quotient the sorted remainders interleave; equal ones add their counts."""
        if not filters:
            return cls.of(np.zeros(0, np.uint64))
        parts = [f.items() for f in filters]
        fingerprints = np.concatenate([p[0] for p in parts])
        order = np.argsort(fingerprints, kind="stable")  # merges the ascending stretches
        distinct, first = np.unique(fingerprints[order], return_index=True)
        counts = np.concatenate([p[1] for p in parts])[order]
        return cls.of_counts(distinct, np.add.reduceat(counts, first) if len(first) else counts)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQ", len(self.quotients), len(self.remainders))
        return head + b"".join(x.tobytes() for x in (self.remainders, self.counts, self.quotients, self.runs))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, n = struct.unpack_from("<QQ", data)
        at = 16
        out = []
        for kind, size in ((np.uint64, n), (np.uint64, n), (np.uint32, q), (np.uint32, q)):
            out.append(np.frombuffer(data, kind, size, at))
            at += out[-1].nbytes
        return cls(out[2], out[3], out[0], out[1])


def _build(blocks: int):
    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[CountingQuotientFilter] = []
        for part in parts:
            held.append(CountingQuotientFilter.of(part.column("fp").to_numpy()))
            # filters of about equal size merge, so that a fingerprint is merged a few times and not with every batch
            while len(held) > 1 and len(held[-2].counts) <= 2 * len(held[-1].counts):
                held[-2:] = [CountingQuotientFilter.merged(held[-2:])]
        fingerprints, counts = CountingQuotientFilter.merged(held).items()
        block = ((fingerprints >> _R) * np.uint64(blocks)) >> np.uint64(QUOTIENT_BITS)
        cuts = np.flatnonzero(np.diff(block)) + 1
        for at, f, c in zip(block[[0, *cuts]] if len(block) else [], np.split(fingerprints, cuts), np.split(counts, cuts), strict=False):
            yield pa.record_batch({"block": pa.array([int(at)], pa.int64()), "filter": pa.array([CountingQuotientFilter.of_counts(f, c).to_bytes()], pa.large_binary())})

    return build


def _merge(part: pa.Table) -> pa.Table:
    merged = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x.as_py()) for x in part.column("filter")])
    fingerprints, counts = merged.items()
    return pa.table({"fp": fingerprints.view(np.int64), "n": counts.view(np.int64)})


def fingerprint_counts(rows: DataFrame) -> DataFrame:
    """Columns fp and n: how often each value of the column fp occurs, by merged filters.

    A block holds the distinct fingerprints of a range of quotients, and there are at least as many blocks as
    shuffle partitions, so what meets in one task follows the size of a partition and not of a copied text.
    """
    blocks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filters = rows.select("fp").mapInArrow(_build(blocks), "block long, filter binary")
    return filters.groupBy("block").applyInArrow(_merge, "fp long, n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to the rows of docs (their other columns stay out).

    Texts are equal when their bytes are; null counts as empty. The largest id of a group stays. Rows that repeat
    an id as well as a text share the mark of that id. A group in which every id is null keeps nothing by id:
    keep_id is null and its rows are kept. An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    prints = base.select(F.xxhash64("body").alias("fp"))
    copied = stored(fingerprint_counts(prints).where("n > 1").select("fp"), "copied")
    rows = base.withColumn("fp", F.xxhash64("body"))
    if small(copied):
        routed = rows.join(F.broadcast(copied), "fp", "left_semi")
    else:  # rows of one fingerprint are spread over salts
        salts = 64
        salted = copied.select("fp", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        routed = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, ["fp", "salt"], "left_semi")
    groups = (
        routed.groupBy("fp", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    )
    marked = rows.select("doc_id", "fp", F.unhex(F.sha2("body", 256)).alias("sha")).join(groups, ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    return marked.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
