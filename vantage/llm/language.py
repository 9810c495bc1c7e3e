"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers longest-match queries. A text is parsed from left
to right into the longest phrases that occur in a language's sample; the language that needs the fewest phrases
per letter describes the text best. The automata are arrays, so the pieces of a block of texts are parsed in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.shared import batches, lean

UNKNOWN = "und"
#: Code points of labelled text kept for each language: the bound of the sample that a model is fitted on.
SAMPLE_CHARS = 60_000
#: Code points of one sampled document: a stretch of it, at a place that a hash chooses.
SAMPLE_DOC_CHARS = 1_500
#: Symbols that are parsed in step. A longer text is cut into such pieces, and each is parsed again from the state in which the
#: piece before it ended, until all agree: its phrases are those of the whole text.
PIECE = 512
#: Cells up to which an automaton is a full table; a wider one (many letters) is a table by hash, with the same answers.
FULL_CELLS = 8_000_000
#: Bytes of text that are parsed together.
BLOCK_BYTES = 1_500_000


def symbols(texts: list[str], alphabet: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts one after another, bounds of each, and its number of letters.

    Letters are lower-cased; a run of anything else is one blank (symbol 0); the symbol after the alphabet's stands
    for every letter that no sample has.
    """
    parts = [t.lower() for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    top = int(points.max()) + 1 if len(points) else 1
    table = np.zeros(max(top, 1), np.int32)
    seen = np.flatnonzero(np.bincount(points, minlength=1)) if top <= 1 << 16 else np.unique(points)
    for p in seen.tolist():
        if chr(p).isalpha():
            table[p] = alphabet.get(p, len(alphabet) + 1)
    out = table[points]
    letter = out > 0
    counts = np.zeros(len(out) + 1, np.int64)
    np.cumsum(letter, out=counts[1:])
    letters = counts[bounds[1:]] - counts[bounds[:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank of a run stays, but none at a text's begin
    first = bounds[:-1][np.diff(bounds) > 0]
    keep[first] = letter[first]
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[bounds], letters


def transitions(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix automaton of a symbol sequence: from state, symbol, to state, for every transition; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sample.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    rows = [(s, c, to) for s, out in enumerate(step) for c, to in out.items()]
    out = np.array(rows, np.int32).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


class Automaton:
    """Moves of a parse: the next state times four, plus the phrases that begin.

    From state s a symbol c leads to the state of the longer match if there is one. If not, or at the root, c begins a phrase; a
    symbol that the sample lacks counts as two, an escape and itself, and leads to the root.
    """

    def __init__(self, moves: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, full_cells: int = FULL_CELLS):
        source, symbol, target = (x.astype(np.int64) for x in moves)
        self.width = width
        self.begin = np.full(width, 2, np.int64)
        self.begin[symbol[source == 0]] = 4 * target[source == 0] + 1
        states = int(target.max(initial=0)) + 1
        self.table = None
        if states * width <= full_cells:
            self.table = np.tile(self.begin.astype(np.int32), (states, 1))
            self.table[source, symbol] = 4 * target + (source == 0)
            self.table = self.table.reshape(-1)
            return
        self.bits = (4 * len(source) + 1).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        key, value = source * width + symbol, 4 * target + (source == 0)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]
            put = self.keys[slot] == key
            self.values[slot[put]] = value[put]
            key, value, slot = key[~put], value[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state * self.width + symbol
        if self.table is not None:
            return self.table[key]
        out = self.begin[symbol]
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out


def phrases(stream: np.ndarray, bounds: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Phrases that each text's symbols are parsed into."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // PIECE)
    total = int(pieces.sum())
    if not total:
        return np.zeros(len(sizes), np.int64)
    own = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = bounds[:-1][own] + number * PIECE
    size = np.minimum(bounds[1:][own] - begin, PIECE)
    start = np.zeros(total, np.int64)
    stop, begun = np.zeros(total, np.int64), np.zeros(total, np.int64)
    todo = np.arange(total)
    while len(todo):
        order = todo[np.argsort(-size[todo], kind="stable")]
        at, left = begin[order], size[order]
        live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), "right")
        state, count = start[order], np.zeros(len(order), np.int64)
        for t, n in enumerate(live.tolist()):
            to = automaton.move(state[:n], stream[at[:n] + t])
            count[:n] += to & 3
            state[:n] = to >> 2
        stop[order], begun[order] = state, count
        now = np.where(number > 0, np.concatenate(([0], stop[:-1])), 0)
        todo = np.flatnonzero(now != start)
        start = now
    return np.bincount(own, begun, len(sizes)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """The alphabet of all samples, and each language's automaton. Its size is bounded by that of the samples."""

    alphabet: dict[int, int]
    automata: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of_samples(cls, samples: dict[str, str]) -> LanguageModel:
        letters = sorted({ord(c) for text in samples.values() for c in text.lower() if c.isalpha()})
        alphabet = {p: k for k, p in enumerate(letters, 1)}
        return cls(alphabet, {lang: transitions(symbols([text], alphabet)[0]) for lang, text in sorted(samples.items())})

    def parsers(self, full_cells: int = FULL_CELLS) -> list[Automaton]:
        return [Automaton(moves, len(self.alphabet) + 2, full_cells) for moves in self.automata.values()]

    def rates(self, texts: list[str], parsers: list[Automaton]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per letter of each text (rows) in each language (columns), and the letters."""
        stream, bounds, letters = symbols(texts, self.alphabet)
        found = np.stack([phrases(stream, bounds, a) for a in parsers], 1) if parsers else np.zeros((len(texts), 0))
        return found / np.maximum(letters, 1)[:, None], letters


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """A model of the labelled rows of docs (non-null lang and text).

    A language's sample is about sample_chars code points, from distinct texts taken by a hash of the text, so that
    it is the same at any partitioning and copies count once. What comes to the driver is about that for each language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    h, n = F.xxhash64(text_col), F.length(text_col)
    first = F.pmod(F.shiftright(h, 20), F.greatest(n - SAMPLE_DOC_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select(F.col(lang_col).alias("lang"), F.substr(F.col(text_col), first, F.lit(SAMPLE_DOC_CHARS)).alias("part"), h.alias("h"))
    sizes = {r["lang"]: r["chars"] for r in rows.groupBy("lang").agg(F.sum(F.length("part")).alias("chars")).collect()}
    if not sizes:
        return LanguageModel({}, {})
    # a threshold on the hash takes twice the characters wanted; a smaller language is taken whole
    share = F.create_map(*[F.lit(x) for lang, chars in sizes.items() for x in (lang, min(1.0, 2.0 * sample_chars / chars))])
    picked = rows.where(F.pmod("h", F.lit(1 << 20)) <= share[F.col("lang")] * (1 << 20))
    picked = picked.groupBy("lang", "h").agg(F.min("part").alias("part"))
    before = F.sum(F.length("part")).over(Window.partitionBy("lang").orderBy("h")) - F.length("part")
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.withColumn("before", before).where(F.col("before") < sample_chars).collect():
        texts.setdefault(r["lang"], []).append((r["h"], r["part"]))
    return LanguageModel.of_samples({lang: "\n".join(t for _, t in sorted(parts)) for lang, parts in texts.items()})


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and rate to all rows and columns of docs (names of its own win over clashing ones).

    lang_pred is `und`, with score 0, for a null text, a text without a letter, and a model without languages. Ties
    go to the language first in order. score is the best language's share of the evidence: one over its phrases,
    against the sum over all. rate is the best language's phrases per letter (null for `und`). Repeated rows get
    equal answers; an empty table gives an empty result.
    """
    lean(docs.sparkSession)
    names = list(model.automata)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = ("lang_pred", "score", "rate")
    kept = docs.select(*[c for c in docs.columns if c not in own])
    schema = T.StructType([*kept.schema.fields, T.StructField(own[0], T.StringType()), *(T.StructField(n, T.DoubleType()) for n in own[1:])])

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers = sent.value.parsers()
        for batch in parts:
            for part in batches(batch, text_col, BLOCK_BYTES):
                rates, letters = sent.value.rates([t or "" for t in part.column(text_col).to_pylist()], parsers)
                known = (letters > 0) & (rates.shape[1] > 0)
                best = rates.argmin(1) if rates.shape[1] else np.zeros(len(rates), int)
                with np.errstate(divide="ignore", invalid="ignore"):
                    evidence = 1 / rates
                    score = np.where(known, evidence.max(1, initial=0) / evidence.sum(1), 0.0) if rates.shape[1] else np.zeros(len(rates))
                lang = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                least = rates.min(1, initial=np.inf)
                out = [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(np.where(known, least, 0.0), pa.float64(), mask=~known)]
                yield pa.record_batch(out, names=[*part.schema.names, *own])

    return kept.mapInArrow(judge, schema)
