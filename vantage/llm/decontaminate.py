"""Benchmark decontamination by spaced seeds.

A mask keeps some of a window's words and ignores the others, so two windows that differ in ignored places have equal
seeds. Seeds of the benchmark and of the corpus are joined; around each hit the two texts are compared word by word on
the same diagonal, what neighbouring hits compare is put together, and an overlap that is long enough is a leak even if
words were substituted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.shared import as_long, batches, bloom, bloom_has, joined, mix, small, stored, words

#: Windows of up to 12 words of which 6 count. Together the masks hit every overlap of LEAST_WORDS words or more with
#: LEAST_SHARE equal, wherever its substitutions are: enumerated up to 29 words, and a longer one has a half that is one.
MASKS = ("1101111", "11100010011", "11000110101", "110001010101")
SPAN = max(map(len, MASKS))
#: Words around a hit that are compared, to each side of its window. Within an overlap the next hit is never further, so that
#: what the hits of a diagonal compare covers every overlap whole.
REACH = 24
#: An overlap has at least this many words (an item with fewer: all of them), of which at least this share agree.
LEAST_WORDS = 13
LEAST_SHARE = 0.8
_PARTS, _OF = 4, 5  # the share as a fraction

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII; all else separates.
_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, first word and number of words of each text."""
    data, bounds = joined(texts)
    doc, _, _, hashed = words(data, bounds, _SEPARATES)
    count = np.bincount(doc, minlength=len(bounds) - 1)
    return hashed, np.cumsum(count) - count, count


def short_masks(n: int) -> list[str]:
    """Masks of n words, for an item of fewer than LEAST_WORDS. Its ends agree; of the words between, cut into one part more
    than may be substituted, some part agrees whole, and each mask keeps one."""
    parts = int(n - np.ceil(LEAST_SHARE * n - 1e-9)) + 1
    return ["".join("1" if k in (0, n - 1) or (k - 1) * parts // (n - 2) == part else "0" for k in range(n)) for part in range(parts)]


def seeds(hashed: np.ndarray, first: np.ndarray, count: np.ndarray, short: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask: seed, text and position of every window. short: lengths of items below LEAST_WORDS words, each of which
    has masks of its own, since such an item may hold no window that agrees."""
    for number, mask in [*enumerate(MASKS, 1), *((1000 * n + k, m) for n in short for k, m in enumerate(short_masks(n)))]:
        span = len(mask)
        made = np.maximum(count - span + 1, 0)
        own = np.repeat(np.arange(len(count)), made)
        at = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
        begin = first[own] + at
        out = np.full(len(own), mix(np.array([number], np.uint64))[0], np.uint64)
        with np.errstate(over="ignore"):
            for k, c in enumerate(mask):
                if c == "1":
                    out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashed[begin + k])
        yield out, own, at


def _seed_rows(texts: pa.Array, short: tuple[int, ...], wanted: bytes | None) -> dict[str, np.ndarray | list]:
    """seed, own, at and the hashes of the words around each window (wanted: only seeds that the filter may hold)."""
    hashed, first, count = _windows(texts)
    found = {"seed": [], "own": [], "at": []}
    for seed, own, at in seeds(hashed, first, count, short):
        if wanted is not None:
            good = np.flatnonzero(bloom_has(wanted, seed))
            seed, own, at = seed[good], own[good], at[good]
        for k, v in zip(found, (seed, own, at), strict=True):
            found[k].append(v)
    out = {k: np.concatenate(v) for k, v in found.items()}
    low = np.maximum(out["at"] - REACH, 0)
    high = np.minimum(out["at"] + SPAN + REACH, count[out["own"]])
    bounds = np.zeros(len(low) + 1, np.int64)
    np.cumsum(high - low, out=bounds[1:])
    flat = np.arange(bounds[-1]) + np.repeat(first[out["own"]] + low - bounds[:-1], high - low)
    around = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(as_long(hashed[flat])))
    return out | {"from": low, "around": around, "words": count[out["own"]]}


def _rows(df: DataFrame, id_col: str, text_col: str, prefix: str, short: tuple[int, ...], wanted=None) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches(batch, "text"):
                x = _seed_rows(part.column("text"), short, wanted.value if wanted else None)
                names = ("seed", f"{prefix}_id", f"{prefix}_version", f"{prefix}_at", f"{prefix}_from", f"{prefix}_around", f"{prefix}_words")
                own = pa.array(x["own"])
                yield pa.record_batch([pa.array(as_long(x["seed"])), part.column("id").take(own), part.column("version").take(own), pa.array(x["at"], pa.int32()), pa.array(x["from"], pa.int32()), x["around"], pa.array(x["words"], pa.int32())], names=list(names))

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    return chosen.mapInArrow(make, f"seed long, {prefix}_id {kind}, {prefix}_version long, {prefix}_at int, {prefix}_from int, {prefix}_around array<long>, {prefix}_words int")


def longest_overlap(same: np.ndarray) -> tuple[int, int, int]:
    """The longest stretch that begins and ends in equal words and of which at least LEAST_SHARE agrees: its first place, its
    words, and how many agree."""
    places = np.flatnonzero(same)
    if not len(places):
        return 0, 0, 0
    number = np.arange(len(places))
    # from place i to place j: _OF * (j - i + 1) >= _PARTS * (places[j] - places[i] + 1)
    least = np.minimum.accumulate(_OF * number - _PARTS * places)
    first = np.searchsorted(-least, -(_OF * (number + 1) - _PARTS * (places + 1)), "left")
    length = places - places[first] + 1
    last = int(length.argmax())
    return int(places[first[last]]), int(length[last]), last - int(first[last]) + 1


def _aligned(part: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """Of each hit: the item's word where the comparison begins, and which words agree from there on."""
    numbers = [part.column(c).to_pylist() for c in ("doc_at", "doc_from", "item_at", "item_from")]
    docs, items = part.column("doc_around"), part.column("item_around")
    for k, (doc_at, doc_from, item_at, item_from) in enumerate(zip(*numbers, strict=True)):
        doc, item = docs[k].values.to_numpy(), items[k].values.to_numpy()
        x, y = doc_at - doc_from, item_at - item_from
        back, ahead = min(x, y), min(len(doc) - x, len(item) - y)
        yield item_at - back, (doc[x - back : x + ahead] == item[y - back : y + ahead]).tobytes()


def _stretches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps that are long enough, from rows sorted by document, item and diagonal; what is held is of one diagonal."""
    keys = ("doc_id", "doc_version", "item_id", "item_version", "diagonal")
    now, words_of, held, found = None, 0, [], []

    def close() -> None:
        if not held:
            return
        begin = min(low for low, _ in held)
        same = np.zeros(max(low + len(x) for low, x in held) - begin, bool)
        for low, x in held:
            same[low - begin : low - begin + len(x)] |= np.frombuffer(x, bool)
        at, n, agreeing = longest_overlap(same)
        if n >= min(LEAST_WORDS, words_of):
            found.append((now[0], now[1], now[2], now[4] + begin + at, n, agreeing))
        held.clear()

    def rows(kinds: list[pa.DataType]) -> pa.RecordBatch:
        out = pa.record_batch([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["doc_id", "doc_version", "item_id", "word", "overlap", "agreeing"])
        found.clear()
        return out

    kinds: list[pa.DataType] = []
    for part in parts:
        kinds = [part.schema.field("doc_id").type, pa.int64(), part.schema.field("item_id").type, pa.int32(), pa.int32(), pa.int32()]
        for (*key, n), (low, same) in zip(zip(*(part.column(c).to_pylist() for c in (*keys, "item_words")), strict=True), _aligned(part), strict=True):
            if key != now:
                close()
                now, words_of = key, n
            held.append((low, same))
        yield rows(kinds)
    close()
    if found:
        yield rows(kinds)


def overlaps_found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """doc_id, doc_version (a hash of the text), item_id, word, overlap, agreeing: the longest overlap on each diagonal.

    A filter of fixed size keeps most windows of the corpus from leaving their task; a benchmark that fills it costs more
    shuffling and loses nothing.
    """
    spark = docs.sparkSession
    texts = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))

    def count_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.record_batch({"n": pa.array(_windows(part.column("text"))[2], pa.int32())})

    counted = texts.mapInArrow(count_words, "n int").where(f"n > 0 and n < {LEAST_WORDS}").distinct()
    short = tuple(sorted(r["n"] for r in counted.collect()))  # fewer than LEAST_WORDS values
    items = stored(_rows(texts, "id", "text", "item", short), "item-seeds")
    wanted = spark.sparkContext.broadcast(bloom(items, "seed"))
    rows = _rows(docs, id_col, text_col, "doc", short, wanted)
    hits = rows.join(F.broadcast(items) if small(items, 50_000) else items, "seed")
    doc_kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    key = ("doc_id", "doc_version", "item_id", "item_version", "diagonal")
    # the comparison comes after the exchange: two Python workers in one task would hold twice the memory
    dealt = hits.withColumn("diagonal", F.col("doc_at") - F.col("item_at")).repartition(*key).sortWithinPartitions(*key)
    dealt = dealt.select(*key, "doc_at", "doc_from", "doc_around", "item_at", "item_from", "item_around", "item_words")
    found = dealt.mapInArrow(_stretches, f"doc_id {doc_kind}, doc_version long, item_id {item_kind}, word int, overlap int, agreeing int")
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, word, overlap, agreeing: one row for each document and benchmark item that overlap, with the longest
    overlap in words, how many of them agree, and the document's word where it begins.

    Null and empty texts have no words and overlap with nothing; rows that repeat an id count as one document; a row without
    an id is reported with a null id; an empty table on either side gives an empty result; other columns are ignored.
    """
    found = overlaps_found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "agreeing", (-F.col("word")).alias("w"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.w")).alias("word"), "best.overlap", "best.agreeing")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs without those whose text overlaps with an item, with or without an id."""
    found = overlaps_found(docs, benchmark, id_col, text_col, "item_id", "text")
    bad = stored(found.select(F.col("doc_id").alias("_leaking_id"), F.col("doc_version").alias("_leaking_version")).distinct(), "leaking")
    same = F.col(id_col).eqNullSafe(F.col("_leaking_id")) & (F.xxhash64(text_col) == F.col("_leaking_version"))
    return docs.join(F.broadcast(bad) if small(bad) else bad, same, "left_anti")
