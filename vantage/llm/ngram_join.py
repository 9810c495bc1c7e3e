"""Exact Jaccard join of documents on their word n-grams, by prefix trees.

All n-grams have one global order: those that a counting sketch of fixed size finds to be very frequent come last,
by their frequency, the others by hash. In this order two sets with a similarity of t share a token among their
first n - ceil(t * n) + 1 tokens. Sets are sent only to places where they may meet a partner; there a prefix tree holds
the ordered sets, all probes walk it together with one running overlap for each shared path, and subtrees whose
remaining length cannot reach the overlap needed are left.

Links are looked for in two rounds. First every set meets one partner, the most central one that it shares leading
tokens with. Sets that these links join need not meet again: the second round takes only pairs from different
components. Where few sets share a token, their pairs are counted and compared if they share enough; where many do, the
sets meet in one place, each sent once, and the tree finds their links: no list of their pairs is made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vantage.llm.set_join import linked, places_across, prefix_length
from vantage.llm.shared import as_long, batches, bloom, bloom_has, components, forget, joined, mix, stored, words

N = 5
#: Two sets link when LINK[1] * intersection >= LINK[0] * union.
LINK = (75, 100)
#: Cells of the frequency sketch, and of one of its parts.
SKETCH_BITS = 23
_PART_BITS = 16
BLOOM_BITS = 24
#: Repeated tokens that a task holds before it sends their counts.
_HELD = 1 << 20


def shingle_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct word n-grams, text by text in ascending order, and the bounds of each text.

    Words are runs of non-blank bytes, with A-Z lower-cased. A text with fewer than n words has one n-gram, all of
    them; one without words has none.
    """
    data, bounds = joined(texts)
    doc, _, _, hashed = words(data, bounds)
    m, total = len(bounds) - 1, len(doc)
    count = np.bincount(doc, minlength=m)
    first = np.cumsum(count) - count
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    own = np.repeat(np.arange(m), made)
    begin = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(made.sum())
    grams = np.zeros(len(own), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            at = begin + k
            inside = k < count[own]
            word = np.where(inside, hashed[np.minimum(at, max(total - 1, 0))], np.uint64(0)) if total else grams
            grams = mix(grams * np.uint64(0xD6E8FEB86659FD93) + word + np.uint64(k + 1) * inside.astype(np.uint64))
    cuts = np.cumsum(made)
    for a, b in zip((cuts - made).tolist(), cuts.tolist(), strict=True):  # one text after another: shorter sorts are faster
        grams[a:b].sort()
    distinct = np.ones(len(own), bool)
    distinct[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
    own, grams = own[distinct], grams[distinct]
    ends = np.zeros(m + 1, np.int64)
    np.cumsum(np.bincount(own, minlength=m), out=ends[1:])
    return grams, ends


def set_ids(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set (0 for an empty one)."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams), out=total[1:])
        size = np.diff(ends).astype(np.uint64)
        return np.where(size > 0, mix(total[ends[1:]] - total[ends[:-1]] + size * np.uint64(0xA24BAED4963EE407)) | np.uint64(1), np.uint64(0))


def _each(docs: DataFrame, n: int, make, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Runs make(part, grams, ends, ids, seen) over parts of the texts; seen holds the set ids of the task so far."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in parts:
            for part in batches(batch, "text"):
                grams, ends = shingle_sets(part.column("text"), n)
                out = make(part, grams, ends, set_ids(grams, ends), seen)
                if out is not None:
                    yield out

    return docs.select("text", *keep).mapInArrow(run, schema)


def _fresh(ids: np.ndarray, seen: set[int]) -> np.ndarray:
    """Numbers of the non-empty sets that the task has not met before."""
    out = []
    for k, s in enumerate(ids.tolist()):
        if s and s not in seen:
            seen.add(s)
            out.append(k)
    return np.array(out, np.int64)


def _taken(ends: np.ndarray, rows: np.ndarray, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first limit tokens (or all) of some sets, and the row each belongs to."""
    size = ends[rows + 1] - ends[rows]
    take = size if limit is None else np.minimum(size, limit)
    own = np.repeat(np.arange(len(rows)), take)
    at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(ends[rows], take)
    return at, own


#: Cells that remember, within a task, what it has met before.
_SEEN_BITS = 25


def members_and_sketch(docs: DataFrame, n: int = N) -> tuple[DataFrame, np.ndarray]:
    """doc_id, sid, n_shingles of every row (stored), and a class for each cell of a frequency sketch, from one pass.

    A task counts a token from its second occurrence there, so that the many tokens that occur once stay out; tasks send
    the cells they met by part of the sketch and these add up in a grouped step. The result has 2**SKETCH_BITS bytes whatever
    the corpus: 0, or the power of two of a count well above the mean. Any classes give right results; good ones put passages
    that many documents share at the end of the order, so that sets with little else in common share no leading token.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def counted(cells: list[np.ndarray]) -> pa.RecordBatch:
        cell, times = np.unique(np.concatenate([*cells, np.zeros(0, np.uint32)]), return_counts=True)
        times = np.minimum(times, 0xFFFF).astype("<u2")
        part, first = np.unique(cell >> np.uint32(_PART_BITS), return_index=True)
        own = (cell & np.uint32((1 << _PART_BITS) - 1)).astype("<u2")
        sent = [zlib.compress(x.tobytes() + y.tobytes(), 1) for x, y in zip(np.split(own, first[1:]), np.split(times, first[1:]), strict=True)] if len(part) else []
        m = len(sent)
        return pa.record_batch({"doc_id": pa.nulls(m, id_type), "sid": pa.nulls(m, pa.int64()), "n_shingles": pa.nulls(m, pa.int64()), "part": pa.array(part, pa.int32()), "counts": pa.array(sent, pa.binary())})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[np.ndarray] = []
        seen = np.zeros(1 << _SEEN_BITS, bool)
        for batch in parts:
            for part in batches(batch, "text"):
                grams, ends = shingle_sets(part.column("text"), n)
                cell = (grams >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)
                cells.append((grams[seen[cell]] & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.uint32))
                seen[cell] = True
                m = len(part)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "sid": pa.array(as_long(set_ids(grams, ends))), "n_shingles": pa.array(np.diff(ends), pa.int64()), "part": pa.nulls(m, pa.int32()), "counts": pa.nulls(m, pa.binary())})
                if sum(map(len, cells)) > _HELD:
                    yield counted(cells)
                    cells = []
        yield counted(cells)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << _PART_BITS, np.int64)
        for x in group.column("counts"):
            cell, times = np.frombuffer(zlib.decompress(x.as_py()), "<u2").reshape(2, -1)
            total[cell] += times
        usual = total.mean() + 6 * np.sqrt(total.mean()) + 8
        classes = np.where(total > usual, np.floor(np.log2(np.maximum(total, 1))) + 1, 0).astype(np.uint8)
        return pa.table({"part": group.column("part").slice(0, 1).cast(pa.int32()), "classes": pa.array([zlib.compress(classes.tobytes(), 1)], pa.binary())})

    both = stored(docs.select("text", "doc_id").mapInArrow(run, f"doc_id {kind}, sid long, n_shingles long, part int, counts binary"), "members")
    parts = both.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, classes binary")
    classes = np.zeros((1 << SKETCH_BITS - _PART_BITS, 1 << _PART_BITS), np.uint8)
    for r in parts.collect():  # at most 128 rows
        classes[r["part"]] = np.frombuffer(zlib.decompress(r["classes"]), np.uint8)
    return both.where("part is null").select("doc_id", "sid", "n_shingles"), classes.reshape(-1)


def _ordered(grams: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each set in the global order, and their classes."""
    kind = classes[(grams & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    late = np.flatnonzero(kind)
    if not len(late):
        return grams, kind  # within a text they ascend already
    # tokens of class 0 move up and keep their order; the others follow them, by class
    own = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    behind = np.cumsum(kind > 0)
    to = np.arange(len(grams)) - behind + np.concatenate(([0], behind))[ends[:-1]][own]
    early = np.bincount(own[kind == 0], minlength=len(ends) - 1)
    order = np.lexsort((kind[late], own[late]))
    late = late[order]
    rank = np.arange(len(late)) - np.searchsorted(own[late], own[late], "left")
    to[late] = ends[:-1][own[late]] + early[own[late]] + rank
    out, kinds = np.empty_like(grams), np.empty_like(kind)
    out[to], kinds[to] = grams, kind
    return out, kinds


def leading_tokens(docs: DataFrame, classes, n: int = N) -> DataFrame:
    """token, sid, place, weight: the leading tokens of every distinct set (copies within a task are sent once). place holds
    the set's size above the token's position in it, 32 bits each; weight is how frequent the set's leading tokens are."""

    def make(part, grams, ends, ids, seen):
        rows = _fresh(ids, seen)
        if not len(rows):
            return None
        tokens, kinds = _ordered(grams, ends, classes.value)
        size = ends[rows + 1] - ends[rows]
        at, own = _taken(ends, rows, prefix_length(size, LINK))
        place = size[own] << 32 | (at - ends[rows[own]])
        often = np.bincount(own, np.where(kinds[at] > 0, np.exp2(kinds[at]), 0.0), len(rows))
        return pa.record_batch({"token": pa.array(as_long(tokens[at])), "sid": pa.array(as_long(ids[rows[own]])), "place": pa.array(place), "weight": pa.array(often[own].astype(np.float32))})

    return _each(docs, n, make, "token long, sid long, place long, weight float")


def _met(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, sid, place, head, head_size: rows of tokens that more than one set leads with, each set once, with the token's
    first set; from rows sorted by token, weight (heaviest first) and sid. One row is held back at a time."""
    held, several, head_before = None, False, (0, 0)
    for part in parts:
        token, sid, place = (part.column(c).to_numpy() for c in ("token", "sid", "place"))
        if held is not None:
            token, sid, place = (np.concatenate(([x], y)) for x, y in zip(held, (token, sid, place), strict=True))
        if not len(token):
            continue
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
        token, sid, place = token[fresh], sid[fresh], place[fresh]
        same = token[1:] == token[:-1]
        at = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(token)), 0))
        head, size = sid[at], place[at] >> 32
        if held is not None:  # the first run began before
            head[at == 0], size[at == 0] = head_before
        keep = np.concatenate(([several], same)) | np.concatenate((same, [False]))
        held, head_before, several = (token[-1], sid[-1], place[-1]), (head[-1], size[-1]), bool(keep[-1])
        keep[-1] = False
        if keep.any():
            yield pa.record_batch({c: pa.array(x[keep]) for c, x in zip(("token", "sid", "place", "head", "head_size"), (token, sid, place, head, size), strict=True)})
    if several:
        yield pa.record_batch({c: pa.array([x], pa.int64()) for c, x in zip(("token", "sid", "place", "head", "head_size"), (*held, *head_before), strict=True)})


def candidate_sets(places: DataFrame, docs: DataFrame, classes, n: int = N) -> DataFrame:
    """sid, tokens (in the global order) of the sets that have a place where they may meet a partner, stored.

    A Bloom filter of fixed size keeps the others in their tasks; a set with copies in several tasks comes from each.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(places.select("sid").distinct(), "sid", BLOOM_BITS))

    def make(part, grams, ends, ids, seen):
        rows = _fresh(np.where(bloom_has(wanted.value, ids), ids, np.uint64(0)), seen)
        if not len(rows):
            return None
        tokens, _ = _ordered(grams, ends, classes.value)
        return pa.record_batch({"sid": pa.array(as_long(ids[rows])), "tokens": pa.array([tokens[ends[k] : ends[k + 1]].tobytes() for k in rows], pa.binary())})

    out = stored(_each(docs, n, make, "sid long, tokens binary"), "sets")
    wanted.destroy()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest id that links reach, its own included.

    Sets of word n-grams are equal where 64-bit hashes are. A null or blank text has an empty set and is linked with
    nothing; texts with equal sets are linked. Rows that repeat an id are one node; rows without an id take part, but
    their component may be null if no row in it has one. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    members, classes = members_and_sketch(docs, n)
    classes = spark.sparkContext.broadcast(classes)

    leading = leading_tokens(docs, classes, n).repartition("token").sortWithinPartitions("token", F.desc("weight"), "sid")
    leading = stored(leading.mapInArrow(_met, "token long, sid long, place long, head long, head_size long"), "leading")

    # the set that shares most, of those that are first at a token: what near copies were made from, if it is there
    size = F.shiftright("place", 32)
    fits = (F.col("head") != F.col("sid")) & (LINK[1] * F.least(size, "head_size") >= LINK[0] * F.greatest(size, "head_size"))
    counted = leading.where(fits).groupBy("sid", F.col("head").alias("pivot")).agg(F.count(F.lit(1)).alias("shared"), F.first(size).alias("size"), F.first("head_size").alias("pivot_size"))
    best = F.max_by(F.struct("pivot", "pivot_size", "size", "shared"), F.struct("shared", -F.col("pivot"))).alias("p")
    first = stored(counted.groupBy("sid").agg(best).select("sid", "p.*"), "first")
    # tokens at which the partner is not the first are not counted, so half of what links need is asked for
    need = F.ceil(LINK[0] * (F.col("size") + F.col("pivot_size")) / (LINK[0] + LINK[1])) - F.ceil(LINK[0] * F.greatest("size", "pivot_size") / LINK[1]) + 1
    near_enough = first.where(2 * F.col("shared") >= need)
    side = lambda sid, n, member: near_enough.select(F.col("pivot").alias("owner"), F.col(sid).alias("sid"), F.col(sid).alias("comp"), F.col(n).alias("size"), F.lit(member).alias("member"), F.lit(not member).alias("probe"))
    places = stored(side("sid", "size", True).unionByName(side("pivot", "pivot_size", False).distinct()), "first-places")
    sets = candidate_sets(places, docs, classes, n)
    near = components(linked(places, sets, LINK))
    forget(places, sets)

    # the partner of a set's partner is its label
    comps, to = near.select(F.col("node").alias("sid"), F.col("component").alias("comp")), first.select("sid", "pivot")
    label = to.join(to.select(F.col("sid").alias("pivot"), F.col("pivot").alias("further")), "pivot", "left").select("sid", F.coalesce("further", "pivot").alias("label"))
    about = stored(comps.join(label, "sid", "full").select("sid", F.coalesce("comp", "sid").alias("comp"), F.coalesce("label", "sid").alias("label")), "about")
    places = stored(places_across(leading, about, LINK), "second-places")
    forget(leading, first, about)
    sets = candidate_sets(places, docs, classes, n)
    classes.destroy()
    more = linked(places, sets, LINK)
    forget(places, sets)
    if more.isEmpty():
        return _named(members, near)
    wider = components(more)
    every = near.unionByName(wider.select("node", F.col("node").alias("component"))).distinct()
    every = every.join(wider.select(F.col("node").alias("component"), F.col("component").alias("wide")), "component", "left")
    return _named(members, stored(every.select("node", F.coalesce("wide", "component").alias("component")), "near"))


def _named(members: DataFrame, near: DataFrame) -> DataFrame:
    """Sets to documents: rows with equal sets are one node, and a component has the smallest id of its rows."""
    placed = members.join(near.select(F.col("node").alias("sid"), "component"), "sid", "left")
    placed = placed.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "sid")))
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    tying = placed.where("doc_id is not null and component is not null").groupBy("doc_id").agg(F.min("component").alias("b"), F.max("component").alias("last")).where("b <> last")
    if not tying.isEmpty():  # an id on rows with different texts joins their components
        tied = components(placed.join(tying.select("doc_id", "b"), "doc_id").select(F.col("component").alias("a"), "b"))
        joined = least.join(tied.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").withColumn("joined", F.coalesce("joined", "component"))
        least = joined.join(joined.groupBy("joined").agg(F.min("least").alias("lowest")), "joined").select("component", F.col("lowest").alias("least"))
    return placed.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
