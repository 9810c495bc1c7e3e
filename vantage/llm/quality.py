"""Quality classifier: a sparse rule ensemble.

Small boosted trees over text statistics are cut into their paths. Each path is a conjunctive rule; a lasso
logistic regression weighs the rules and drops most of them; what is left becomes one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.shared import batches, joined, lean, span_hashes, words

#: Labelled rows that a model is fitted on, at most about: the bound of the sample.
SAMPLE_ROWS = 20_000
#: A score from here on predicts label 1.
THRESHOLD = 0.7

STATISTICS = ("bytes", "n_words", "word_length", "longest_word", "upper", "digit", "blank", "stop_mark", "symbol", "beyond_ascii", "marked_words", "short_words", "distinct_words", "commonest_word", "distinct_pairs", "n_lines", "words_per_line", "repeated_lines", "upper_words")

_CLASS = np.full(256, 5, np.uint8)  # other symbols
_CLASS[list(range(65, 91))] = 0
_CLASS[list(range(48, 58))] = 1
_CLASS[[32, *range(9, 14)]] = 2
_CLASS[list(b".,;:?'\"()-")] = 3
_CLASS[list(range(97, 123))] = 4
_CLASS[128:] = 6


def _repeats(doc: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and how often its commonest occurs."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (hashed >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    run = np.diff(np.append(first, len(key)))
    own = (key[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, own, run)
    return np.bincount(own, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text, as doubles; a null or empty text has zeros throughout."""
    data, bounds = joined(texts)
    n = len(bounds) - 1
    kinds = _CLASS[data]

    def share(kind: int) -> np.ndarray:
        total = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum(kinds == kind, out=total[1:])
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)

    doc, begin, end, hashed = words(data, bounds)
    count = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(count, 1)
    size = end - begin
    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    per_word = lambda x: np.bincount(doc, x, n) / some
    distinct, commonest = _repeats(doc, hashed, n)
    same = doc[1:] == doc[:-1]
    with np.errstate(over="ignore"):
        pair = hashed[1:][same] * np.uint64(0x9E3779B97F4A7C15) + hashed[:-1][same]
    pairs, _ = _repeats(doc[1:][same], pair, n)
    breaks = np.flatnonzero(data == 10)
    break_doc = np.searchsorted(bounds, breaks, "right") - 1
    filled = np.diff(bounds) > 0
    line_doc = np.concatenate((break_doc, np.flatnonzero(filled)))
    stop = np.concatenate((breaks, bounds[1:][filled]))
    order = np.lexsort((stop, line_doc))
    line_doc, stop = line_doc[order], stop[order]
    start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
    start = np.maximum(start, bounds[:-1][line_doc]) if len(stop) else stop
    start = np.minimum(start, stop)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    distinct_lines, _ = _repeats(line_doc, span_hashes(data, start, stop), n)
    return {
        "bytes": np.diff(bounds).astype(float),
        "n_words": count,
        "word_length": per_word(size),
        "longest_word": longest,
        "upper": share(0),
        "digit": share(1),
        "blank": share(2),
        "stop_mark": share(3),
        "symbol": share(5),
        "beyond_ascii": share(6),
        "marked_words": per_word(kinds[end - 1] == 5),
        "short_words": per_word(size <= 3),
        "distinct_words": distinct / some,
        "commonest_word": commonest / some,
        "distinct_pairs": pairs / np.maximum(count - 1, 1),
        "n_lines": lines,
        "words_per_line": count / np.maximum(lines, 1),
        "repeated_lines": 1 - distinct_lines / np.maximum(lines, 1) - (lines == 0),
        "upper_words": per_word(kinds[begin] == 0),
    }


def with_statistics(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The columns of keep and the statistics of text_col, each as a column stat_<name>."""
    lean(docs.sparkSession)
    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("body"))
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField(f"stat_{s}", T.DoubleType()) for s in STATISTICS])

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches(batch, "body"):
                found = statistics(part.column("body"))
                yield pa.record_batch([*part.columns[:-1], *(pa.array(found[s], pa.float64()) for s in STATISTICS)], names=[*keep, *(f"stat_{s}" for s in STATISTICS)])

    return chosen.mapInArrow(measure, schema)


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Test:
    """stat <= bound, or stat > bound."""

    stat: str
    above: bool
    bound: float

    def column(self) -> Column:
        x = F.col(f"stat_{self.stat}")
        return x > F.lit(self.bound) if self.above else x <= F.lit(self.bound)


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted conjunctions of tests and an intercept."""

    rules: tuple[tuple[tuple[Test, ...], float], ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as an expression over stat_ columns."""
        total = F.lit(float(self.intercept))
        for tests, weight in self.rules:
            total = total + F.when(reduce(lambda a, b: a & b, (t.column() for t in tests)), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def __str__(self) -> str:
        said = [f"{w:+.3f}  " + " and ".join(f"{t.stat} {'>' if t.above else '<='} {t.bound:.4g}" for t in tests) for tests, w in self.rules]
        return "\n".join([f"{self.intercept:+.3f}", *said])


def _tree(bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int, least: int) -> tuple[list[tuple[Test, ...]], np.ndarray]:
    """Paths of a second-order regression tree, and its value for each row."""
    value = np.zeros(len(slope))
    paths: list[tuple[Test, ...]] = []

    def grow(rows: np.ndarray, path: tuple[Test, ...], left_depth: int) -> None:
        g, h = slope[rows].sum(), curve[rows].sum()
        value[rows] = -g / (h + 1)
        if not left_depth or len(rows) < 2 * least:
            return
        best = (1e-6, 0, 0)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            own = bins[rows, f]
            gs = np.cumsum(np.bincount(own, slope[rows], len(edges) + 1))[:-1]
            hs = np.cumsum(np.bincount(own, curve[rows], len(edges) + 1))[:-1]
            ns = np.cumsum(np.bincount(own, minlength=len(edges) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
        gain, f, at = best
        if gain <= 1e-6:
            return
        below = bins[rows, f] <= at
        for part, above in ((rows[below], False), (rows[~below], True)):
            longer = (*path, Test(STATISTICS[f], above, float(cuts[f][at])))
            paths.append(longer)
            grow(part, longer, left_depth - 1)

    grow(np.arange(len(slope)), (), depth)
    return paths, value


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 2e-3, steps: int = 400) -> RuleEnsemble:
    """From statistics (columns in the order of STATISTICS) and labels 0/1. One class alone gives its smoothed rate."""
    n = len(y)
    rate = (y.sum() + 1) / (n + 2)
    start = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return RuleEnsemble((), start)
    cuts = []
    for f in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1]))
        cuts.append(edges[edges < x[:, f].max()])
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    raw = np.full(n, start)
    found: dict[frozenset[Test], tuple[Test, ...]] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        paths, value = _tree(bins, cuts, p - y, p * (1 - p), depth, max(5, n // 500))
        raw += 0.3 * value
        for path in paths:
            found.setdefault(frozenset(path), path)
    rules = list(found.values())
    column = {s: f for f, s in enumerate(STATISTICS)}
    on = lambda t: (x[:, column[t.stat]] > t.bound) if t.above else (x[:, column[t.stat]] <= t.bound)
    if not rules:
        return RuleEnsemble((), start)
    matrix = np.stack([reduce(np.logical_and, map(on, r)) for r in rules], 1).astype(np.float32)
    _, kept = np.unique(np.packbits(matrix.astype(bool), axis=0), axis=1, return_index=True)
    matrix, rules = matrix[:, kept], [rules[k] for k in kept]
    # accelerated proximal gradient; centred columns leave the intercept free
    centre = matrix.mean(0)
    z = matrix - centre
    vector = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        vector = z.T @ (z @ vector)
        vector /= np.linalg.norm(vector) + 1e-12
    rate_of = 4 / (float(np.linalg.norm(z @ vector)) ** 2 / n + 1e-9)
    w = ahead = np.zeros(z.shape[1], np.float32)
    b = b_ahead = start
    t = 1.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(z @ ahead + b_ahead))) - y).astype(np.float32)
        stepped = ahead - rate_of * (z.T @ error) / n
        new = np.sign(stepped) * np.maximum(np.abs(stepped) - rate_of * penalty, 0)
        new_b = b_ahead - 4 * float(error.mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, b_ahead = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new.astype(np.float32), new_b, t_new
    active = np.flatnonzero(np.abs(w) > 1e-4)
    chosen = sorted(((rules[k], float(w[k])) for k in active), key=lambda r: -abs(r[1]))
    return RuleEnsemble(tuple(chosen), float(b - centre @ w))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """A model of the labelled documents. Rows with a null id, label or text are left out; an id labelled both ways counts twice.

    Of more than sample_rows labels a hash of the id keeps about that many. Those ids are broadcast, so the texts
    stay where they are; their statistics come to the driver, some 20 numbers for each.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).distinct()
    share = min(1.0, sample_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).limit(2 * sample_rows)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "label_id")
    got = with_statistics(rows, ("label_id", "y")).orderBy("label_id", "y", "stat_bytes").toArrow()
    x = np.stack([got.column(f"stat_{s}").to_numpy() for s in STATISTICS], 1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return fit_rules(x, got.column("y").to_numpy())


def scored(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every row. Null text counts as empty and gets the score of its zeros; repeated
    rows get equal scores; an empty table gives an empty result; other columns are ignored."""
    measured = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ("doc_id",))
    return measured.select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
