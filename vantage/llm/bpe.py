"""Byte-level BPE over a block of texts at once.

The distinct pieces of a block form one array of tokens. An inverted index holds, for each merge that can be
made, the positions of its token pair; merges are replayed in rank order over all pieces together, and each
one touches only the pairs on either side of it. Pieces are encoded once however often they occur.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vantage.llm.shared import batches, lean

_NONE = np.int32(-1)
#: Bytes of text whose pieces are encoded together.
BLOCK_BYTES = 3_000_000


class Vocabulary:
    """Ranks of a byte-level vocabulary, and a table of every token pair whose bytes are a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # open addressing at a quarter full
        self.bits = (4 * len(pairs) + 1).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        key = np.fromiter(pairs, np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]
            lost = self.keys[slot] != key
            self.values[slot[~lost]] = value[~lost]
            key, value, slot = key[lost], value[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or -1."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key = np.where((left < 0) | (right < 0), np.int64(-2), key)
        slot = self._slot(key)
        out = np.full(len(key), _NONE, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            at = self.keys[slot[open_]]
            hit = at == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values; for the many short arrays of the replay sorting costs less than np.unique's hashing."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and where each piece begins and ends among them.

    A piece takes its merges as if alone: always the lowest rank, leftmost first.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    bounds = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    n = int(bounds[-1])
    token = vocabulary.single[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    full = sizes > 0
    before[bounds[:-1][full]] = -1
    after[bounds[1:][full] - 1] = -1

    def right_of(at: np.ndarray) -> np.ndarray:
        """Token after each position; -1 at a piece's end."""
        to = after[at]
        return np.where(to < 0, _NONE, token[to])

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray, rank: np.ndarray) -> None:
        good = rank >= 0
        at, rank = at[good], rank[good]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        for r, part in zip(rank[first].tolist(), np.split(at, first[1:]), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    for first in range(0, n, 500_000):
        some = np.arange(first, min(first + 500_000, n), dtype=np.int32)
        add(some, vocabulary.rank(token[some], right_of(some)))
    while heap:
        r = heapq.heappop(heap)
        at = _distinct(np.concatenate(index.pop(r)))
        at = at[token[at] >= 0]
        at = at[vocabulary.rank(token[at], right_of(at)) == r]
        if not len(at):
            continue
        # of a chain of pairs that share tokens every second one can be merged
        chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
        start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        take = (np.arange(len(at)) - start) % 2 == 0
        own = piece[at]
        several = np.concatenate((own[1:] == own[:-1], [False])) | np.concatenate(([False], own[1:] == own[:-1]))
        if several.any():
            # a piece with several such pairs takes one alone if a merge would open a lower rank on either side
            these = np.flatnonzero(several)
            x = at[these]
            left, right = before[x], after[after[x]]
            made = np.full(len(x), r, np.int32)
            lower = np.zeros(len(x), bool)
            for other in (np.where(left < 0, _NONE, token[left]), made):
                rank = vocabulary.rank(np.where(left < 0, _NONE, other), made)
                lower |= (rank >= 0) & (rank < r)
            for other in (np.where(right < 0, _NONE, token[right]), made):
                rank = vocabulary.rank(made, np.where(right < 0, _NONE, other))
                lower |= (rank >= 0) & (rank < r)
            unsafe = _distinct(own[these[lower]])
            if len(unsafe):
                leftmost = np.concatenate(([True], own[1:] != own[:-1]))
                take = np.where(np.isin(own, unsafe), leftmost, take)
        late = at[~take]
        at = at[take]
        gone = after[at]
        token[at] = r
        token[gone] = -1
        beyond = after[gone]
        after[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        left = before[at]
        touched = _distinct(np.concatenate((at, left[left >= 0])))
        add(touched, vocabulary.rank(token[touched], right_of(touched)))
        late = late[token[late] >= 0]
        if len(late):
            add(late, vocabulary.rank(token[late], right_of(late)))
    alive = token >= 0
    counts = np.bincount(piece[alive], minlength=len(pieces)) if n else np.zeros(len(pieces), np.int64)
    ends = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    return token[alive], ends


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the bounds of each text among them."""
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    split, fetch = vocabulary.pattern.findall, number.__getitem__
    of = [np.fromiter(map(fetch, split(text)), np.int32) for text in texts]
    counts = np.array([len(x) for x in of], np.int64)
    ids, bounds = encode_pieces([p.encode() for p in number], vocabulary)
    occurrence = np.concatenate(of) if of else np.zeros(0, np.int32)
    del number, of
    begin, size = bounds[:-1][occurrence], np.diff(bounds)[occurrence]
    total = np.zeros(len(occurrence) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    flat = ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    return flat, total[ends]


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids.tolist()))


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def loaded(path: str, pattern: str) -> Vocabulary:
    """The vocabulary, read once in each process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary.load(path, pattern)
    return _LOADED[path, pattern]


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to BLOCK_BYTES, about: the replay has a cost for each block."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        held.append(part)
        if sum(x.nbytes for x in held) >= BLOCK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: its id, n_tokens, ids (unless keep_ids is false), and digests of ids and decoded bytes.

    path names a rank file that every executor can read. Special tokens are not recognised. Null text counts as
    empty and has no ids; repeated rows are each encoded; an empty table gives an empty result; other columns are
    ignored. A task holds one part of a batch at a time, some megabytes of text or one longer text.
    """
    lean(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(path, pattern)
        for whole in _blocks(parts):
            for part in batches(whole, text_col, BLOCK_BYTES):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                ids, bounds = encode_texts(texts, vocabulary)
                own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                out = {
                    "doc_id": part.column(id_col),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]),
                    "decoded_sha256": pa.array([hashlib.sha256(decode(x, vocabulary)).hexdigest() for x in own]),
                }
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch(out)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(encode, schema)
