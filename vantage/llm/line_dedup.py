"""Fuzzy deduplication of lines by MinHash.

Lines are shingled by character, one pass of hashing fills all bins of a signature, and bands of bins bring similar
lines together. Pairs are verified by the exact Jaccard similarity of their shingles, verified links join to components
by a distributed union-find, and the first line of each component stays. Texts leave their task only for verification.
Lines that a crowded bucket left apart meet once more, in prefix trees of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.set_join import leading_of, linked, places_across, with_probes
from vantage.llm.shared import _BLANK, BROADCAST_ROWS, as_long, batches, bloom, bloom_has, components, forget, joined, mix, small, span_hashes, stored

#: Bytes of text that are hashed together: what fits in a core's cache.
HASH_BYTES = 128_000
#: Characters in a shingle; least similarity of two lines; bands and bins in each.
SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 14, 5
# Blank lines are left alone, all others are compared; those without a shingle have only equal lines as copies.

_NEWLINE = 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number within it, begin and end of each line; every text has one line at least."""
    breaks = np.flatnonzero(data == _NEWLINE)
    doc = np.concatenate((np.searchsorted(bounds, breaks, "right") - 1, np.arange(len(bounds) - 1)))
    end = np.concatenate((breaks, bounds[1:]))
    order = np.lexsort((end, doc))
    doc, end = doc[order], end[order]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    begin = np.empty_like(end)
    if len(end):
        begin[first] = bounds[:-1][doc[first]]
        begin[1:][~first[1:]] = (end[:-1] + 1)[~first[1:]]
    at = np.flatnonzero(first)
    number = np.arange(len(doc)) - np.repeat(at, np.diff(np.append(at, len(doc))))
    return doc, number, begin, end


def worded(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines have a byte that is not blank."""
    out = end > begin
    some = np.flatnonzero(out)
    for k in some[_BLANK[data[begin[some]]]].tolist():  # few lines begin with a blank
        out[k] = not _BLANK[data[begin[k] : end[k]]].all()
    return out


def line_ids(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each line's bytes."""
    return span_hashes(data, begin, end) | np.uint64(1)


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character, A-Z lower-cased, and how many characters stand before each byte and the end.

    A character is a byte with the continuation bytes that follow it, so bytes that are no UTF-8 do no harm.
    """
    first = (data & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, np.int32)
    np.cumsum(first, out=before[1:], dtype=np.int32)
    if before[-1] == len(data):
        return _LOWER[data], before
    at = np.flatnonzero(first)
    lead = _LOWER[data[at]]
    wide = np.flatnonzero(lead > 127)
    out = lead.astype(np.uint64)
    after = np.append(at, len(data))[wide + 1]
    for k in (1, 2, 3):
        more = at[wide] + k < after
        out[wide[more]] |= data[at[wide[more]] + k].astype(np.uint64) << np.uint64(8 * k)
    return out, before


def _shingle_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of the SHINGLE characters from each position (the last positions have none)."""
    n = len(points) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = np.flatnonzero(points > 127)
    x = points.astype(np.uint64)
    if len(wide):  # a character beyond ASCII takes more than its byte: it is spread over the 64 bits
        x[wide] = mix(x[wide])
    for step in (1, 2, 4):  # of one character to two, of two to four, of four to eight
        bits = np.uint64(8 * step)
        later = x[step:]
        turned = later << bits
        turned |= later >> (np.uint64(64) - bits)
        turned ^= x[:-step]
        x = turned
    return mix(x)


def signatures(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of each span of characters: BANDS * ROWS bins; an empty bin takes a neighbour's value in a fixed order."""
    bins = BANDS * ROWS
    hashed = _shingle_hashes(points)
    size = np.maximum(end - begin - SHINGLE + 1, 0)
    h = np.concatenate([hashed[b : b + n] for b, n in zip(begin.tolist(), size.tolist(), strict=True)]) if len(begin) else hashed[:0]
    cell = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell += np.repeat(np.arange(0, len(begin) * bins, bins), size)
    out = np.full(len(begin) * bins, 0xFFFFFFFF, np.uint32)
    np.minimum.at(out, cell, h.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    out = out.reshape(-1, bins)
    empty = out == 0xFFFFFFFF
    step = 1
    rng = np.random.default_rng(7)
    while empty.any() and step <= 4 * bins:
        rows = np.flatnonzero(empty.any(1))
        own, hollow = out[rows], empty[rows]
        lent = own[:, rng.permutation(bins)]  # in every line the same bin lends to the same bin
        good = hollow & (lent != 0xFFFFFFFF)
        own[good] = (lent[good] * np.uint32(2654435761) + np.uint32(step)) & np.uint32(0xFFFFFFFE)
        out[rows] = own
        empty[rows] = hollow & ~good & (own != 0xFFFFFFFF).any(1)[:, None]
        step += 1
    return out


def band_keys(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each span of characters (rows) and band (columns)."""
    bins = signatures(points, begin, end).astype(np.uint64).reshape(len(begin), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(begin), BANDS)).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + bins[:, :, k])
    return out


def jaccard(a: str, b: str) -> float:
    """Exact similarity of two lines' shingle sets."""
    x, y = (set(np.unique(_shingle_hashes(characters(np.frombuffer(s.encode(), np.uint8))[0])).tolist()) for s in (a, b))
    return len(x & y) / len(x | y) if x or y else float(a == b)


def _set_keys(texts: pa.Array) -> np.ndarray:
    """Ascending distinct keys of all texts' shingles: the text's number above 44 bits of the shingle's hash."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    points, before = characters(data)
    bounds = before[offsets - offsets[0]]
    begin = bounds[:-1]
    size = np.maximum(np.diff(bounds) - SHINGLE + 1, 0)
    own = np.repeat(np.arange(n), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    keys = np.sort((own.astype(np.uint64) << np.uint64(44)) | (_shingle_hashes(points)[at] >> np.uint64(20)))
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def overlaps(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and the union of the shingle sets of two columns of lines, row by row."""
    n = len(a)
    keys = np.sort(np.concatenate((_set_keys(a), _set_keys(b))))
    own = (keys >> np.uint64(44)).astype(np.int64)
    shared = np.bincount(own[1:][keys[1:] == keys[:-1]], minlength=n)
    return shared, np.bincount(own, minlength=n) - shared


def _unmet(ids: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some ids are not in seen, and seen with them; both ascend and hold each id once. Nothing is sorted again."""
    at = np.searchsorted(seen, ids)
    new = np.ones(len(ids), bool)
    inside = at < len(seen)
    new[inside] = seen[at[inside]] != ids[inside]
    if len(seen) > 4_000_000:  # memory of what was sent is a saving only
        return new, ids[new]
    return new, np.insert(seen, at[new], ids[new])


def _banded(docs: DataFrame) -> DataFrame:
    """bucket, line: of every line that has a shingle, each distinct line of a task once."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in parts:
            for part in batches(batch, "text", HASH_BYTES):
                data, bounds = joined(part.column("text"))
                _, _, begin, end = lines(data, bounds)
                points, before = characters(data)
                long = (before[end] - before[begin] >= SHINGLE) & worded(data, begin, end)
                begin, end = begin[long], end[long]
                ids, first = np.unique(line_ids(data, begin, end), return_index=True)
                new, seen = _unmet(ids, seen)
                ids, first = ids[new], first[new]
                if len(ids):
                    keys = band_keys(points, before[begin[first]], before[end[first]])
                    yield pa.record_batch({"bucket": pa.array(as_long(keys.reshape(-1))), "line": pa.array(as_long(np.repeat(ids, BANDS)))})

    return docs.select("text").mapInArrow(make, "bucket long, line long")


def _bucket_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line but its bucket's first, with that first and with the one before it, from rows sorted by bucket and line."""
    bucket_before = line_before = head_before = None
    for part in parts:
        bucket, line = (part.column(c).to_numpy() for c in ("bucket", "line"))
        if not len(bucket):
            continue
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        if bucket_before == bucket[0]:
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), -1))
        head = np.where(at >= 0, line[at], head_before if head_before is not None else 0)
        before = np.concatenate(([line_before if line_before is not None else 0], line[:-1]))
        bucket_before, line_before, head_before = bucket[-1], line[-1], head[-1]
        good = ~new & (before != line)
        if good.any():
            yield pa.record_batch({"bucket": pa.array(bucket[good]), "line": pa.array(line[good]), "head": pa.array(head[good]), "before": pa.array(before[good])})


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of lines that are similar enough."""

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, "x", 1_000_000):
                shared, union = overlaps(part.column("x"), part.column("y"))
                good = pa.array(shared >= similarity * union)
                yield pa.record_batch({"a": part.column("a").filter(good), "b": part.column("b").filter(good)})

    body = F.col("body")
    both = pairs.join(texts.select(F.col("line").alias("a"), body.alias("x")), "a").join(texts.select(F.col("line").alias("b"), body.alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def line_components(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, component: the identities of lines of the column text that are joined to others by verified links.

    In a bucket every line first meets the bucket's first line and its neighbour in order, which joins most. Buckets that
    still hold lines of several components have pairs that were not compared; their lines meet in a second round, which
    finds every similar pair among them (_crossing_pairs).
    """
    dealt = _banded(docs).repartition("bucket").sortWithinPartitions("bucket", "line")
    met = stored(dealt.mapInArrow(_bucket_rows, "bucket long, line long, head long, before long"), "line-buckets")
    pairs = stored(met.select(F.col("line").alias("a"), F.explode(F.array("head", "before")).alias("b")).distinct(), "line-pairs")
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))).distinct()
    wanted = spark.sparkContext.broadcast(bloom(ends, "line"))

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in parts:
            for part in batches(batch, "text"):
                data, bounds = joined(part.column("text"))
                _, _, begin, end = lines(data, bounds)
                long = (end - begin >= SHINGLE) & worded(data, begin, end)
                begin, end = begin[long], end[long]
                ids, first = np.unique(line_ids(data, begin, end), return_index=True)
                good = bloom_has(wanted.value, ids)
                ids, first = ids[good], first[good]
                new, seen = _unmet(ids, seen)
                ids, first = ids[new], first[new]
                if len(ids):
                    whole = data.tobytes()
                    yield pa.record_batch({"line": pa.array(as_long(ids)), "body": pa.array([whole[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)], pa.binary())})

    texts = docs.select("text").mapInArrow(fetch, "line long, body binary").groupBy("line").agg(F.first("body").alias("body"))
    texts = stored(texts, "line-texts")
    near = components(stored(_verified(pairs, texts, similarity), "line-links"))

    # buckets of four lines or more; in smaller ones the first round compared every pair
    crowded = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("bucket")
    placed = met.join(crowded, "bucket", "left_semi").select("bucket", "head", F.explode(F.array("head", "line")).alias("line")).distinct()
    placed = placed.join(near.withColumnRenamed("node", "line"), "line", "left").select("bucket", "head", "line", F.coalesce("component", "line").alias("component"))
    placed = stored(placed, "line-crowds")
    mixed = stored(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket"), "line-mixed")
    left = stored(placed.join(F.broadcast(mixed) if small(mixed) else mixed, "bucket", "left_semi").select("head", "line", "component").distinct(), "line-left")
    more = _crossings(left, texts, similarity) if not left.isEmpty() else None
    forget(met, pairs, texts, placed, mixed, left)
    if more is None or more.isEmpty():
        return near
    wider = components(more)
    every = near.unionByName(wider.select("node", F.col("node").alias("component"))).distinct()
    return stored(every.join(wider.select(F.col("node").alias("component"), F.col("component").alias("wide")), "component", "left").select("node", F.coalesce("wide", "component").alias("component")), "line-components")


#: Bits of a cell's number in the second round's count of shingles.
CELL_BITS = 18
#: Lines up to which those of buckets with one first line are compared in one place.
FAMILY = 20_000


def _crossings(left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of components that similar lines of different ones join, stored (left: head, line, component of mixed buckets).

    The lines' shingles are sets, rare ones first. Lines of buckets with one first line are a family, and its sets meet in trees of
    bounded size; of the lines of larger families those meet that share leading shingles. Either way no similar pair of a bucket
    is missed. The order rests on counts by cell, of fixed size; it spares work and decides no link.
    """
    lines_of = stored(left.groupBy("line").agg(F.min("component").alias("component")), "line-crossing")
    bodies = stored(texts.join(lines_of.select("line"), "line"), "line-bodies")

    def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for whole in parts:
            for part in batches(whole, "body"):
                keys = _set_keys(part.column("body")) & np.uint64((1 << 44) - 1)
                counts += np.bincount((keys >> np.uint64(44 - CELL_BITS)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.record_batch({"cell": pa.array(at, pa.int32()), "n": pa.array(counts[at])})

    counted = bodies.select("body").mapInArrow(cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << CELL_BITS, np.int64)
    often[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    often = left.sparkSession.sparkContext.broadcast(np.minimum(often, (1 << 32) - 1).astype(np.uint32))

    def order(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, "body"):
                keys = _set_keys(part.column("body"))
                own = (keys >> np.uint64(44)).astype(np.int64)
                token = keys & np.uint64((1 << 44) - 1)
                token = token[np.lexsort((token, often.value[(token >> np.uint64(44 - CELL_BITS)).astype(np.int64)], own))]
                ends = np.searchsorted(own, np.arange(len(part) + 1))
                yield pa.record_batch({"sid": part.column("line"), "tokens": pa.array([token[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})

    sets = stored(bodies.mapInArrow(order, "sid long, tokens binary"), "line-sets")
    often.destroy()
    link = (round(similarity * 10_000), 10_000)
    placed = left.select(F.col("head").alias("owner"), F.col("line").alias("sid"), F.col("component").alias("comp"))
    large = stored(placed.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).where(f"n > {FAMILY}").select("owner"), "line-large")
    sized = sets.select("sid", (F.octet_length("tokens") / 8).cast("long").alias("size"))
    places = with_probes(placed.join(large, "owner", "left_anti").join(sized, "sid"))
    if not large.isEmpty():
        theirs = stored(placed.join(large, "owner", "left_semi").groupBy("sid").agg(F.min("comp").alias("comp"), F.min("owner").alias("label")), "line-about")
        places = places.unionByName(places_across(leading_of(sets.join(theirs.select("sid"), "sid", "left_semi"), link), theirs, link))
    out = linked(places, sets, link)
    forget(lines_of, bodies, sets, large)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """All columns of docs with text_col rewritten, and n_lines and dropped, the numbers of the lines that went.

    Equal lines and lines linked through similar ones are one component; its line in the document with the smallest id,
    and there the first, stays (rows without an id come last). Blank lines stay. A null text stays null
    with no lines; an empty one has one empty line. Rows that repeat both id and text are treated as one; an empty table
    gives an empty result; columns of docs named n_lines or dropped are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "dropped")]
    place = F.col(id_col)
    version = F.xxhash64(text_col)
    texts = docs.select(F.col(text_col).alias("text"), place.alias("place"), version.alias("version"))
    drops = repeated_lines(texts, line_components(texts, similarity))

    few = drops.agg(F.coalesce(F.sum(F.size("dropped") + 4), F.lit(0))).first()[0] <= 4 * BROADCAST_ROWS
    kept_as = {c: f"k{k}" for k, c in enumerate(kept)}
    text = F.col(kept_as[text_col])
    placed = docs.select(*(F.col(c).alias(k) for c, k in kept_as.items()), place.alias("own_place"), version.alias("own_version"))
    same = F.col("own_place").eqNullSafe(F.col("place")) & F.col("own_version").eqNullSafe(F.col("version"))
    marked = placed.join(F.broadcast(drops) if few else drops, same, "left")
    parts = F.split(text, "\n", -1)
    rest = F.filter(parts, lambda x, i: ~F.array_contains("dropped", i))
    return marked.select(
        *[F.when(F.col("dropped").isNotNull(), F.array_join(rest, "\n")).otherwise(text).alias(c) if c == text_col else F.col(k).alias(c) for c, k in kept_as.items()],
        F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).cast("int").alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def repeated_lines(texts: DataFrame, near: DataFrame) -> DataFrame:
    """place, version, dropped: the lines of each text that are not the first of their component (stored)."""

    def occurrences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches(batch, "text"):
                data, bounds = joined(part.column("text"))
                doc, number, begin, end = lines(data, bounds)
                long = worded(data, begin, end)
                doc, number = doc[long], number[long]
                ids = line_ids(data, begin[long], end[long])
                at = pa.array(doc)
                yield pa.record_batch({"line": pa.array(as_long(ids)), "place": part.column("place").take(at), "version": part.column("version").take(at), "number": pa.array(number.astype(np.int32))})

    schema = f"line long, place {texts.schema['place'].dataType.simpleString()}, version long, number int"
    places = stored(texts.mapInArrow(occurrences, schema), "line-places")
    found = places.select("line", F.struct(F.col("place").isNull().alias("unnamed"), "place", "version", "number").alias("at"))
    first = found.groupBy("line").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.join(near.select(F.col("node").alias("line"), "component"), "line", "left").where("n > 1 or component is not null")
    first = stored(first.select("line", "first", F.coalesce("component", "line").alias("component")), "line-firsts")
    keep = first.groupBy("component").agg(F.min("first").alias("keep"))
    marks = stored(first.join(keep, "component").select("line", "keep"), "line-marks")
    gone = found.join(F.broadcast(marks) if small(marks) else marks, "line").where("at <> keep")
    drops = gone.groupBy(F.col("at.place").alias("place"), F.col("at.version").alias("version")).agg(F.array_sort(F.collect_set("at.number")).alias("dropped"))
    drops = stored(drops, "line-drops")
    forget(places, first, marks)
    return drops
