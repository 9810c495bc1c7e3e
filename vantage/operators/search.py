"""Box search by patient rule induction: peel, then paste, keeping every accepted step.

The loop runs on the driver over limits and counts. What it asks of the data — quantiles, counts of candidate boxes,
observed ranges — comes from one of two engines with the same answers: batched Spark aggregations over the frame, or
NumPy on a frame of few enough combinations of values to be collected once. Rows of equal values stay together in every box,
so the engines keep one row for them and how many they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.errors import PrimError
from vantage.functions import statistics as st
from vantage.functions.quantile import Ask, quantiles, value_counts
from vantage.operators.boxes import CATEGORICAL, CONTINUOUS, INTEGER, BoxLimits, Categories, Range
from vantage.operators.frame import CASE, CASES, ROWS, Feature, ScenarioFrame

#: Combinations of feature values times columns up to which a frame is collected and searched in memory.
LOCAL_CELLS = 20_000_000
#: Distinct values up to which a numeric feature is counted by value instead of bracketed.
FEW_VALUES = 10_000
#: Aggregate expressions of one job.
BATCH = 120


@dataclass(frozen=True)
class PrimConfig:
    """Peel and paste fractions in (0, 1), least mass in (0, 1], objective."""

    peel_alpha: float = 0.05
    paste_alpha: float = 0.05
    mass_min: float = 0.05
    objective: str = st.LENIENT1

    def __post_init__(self):
        for name in ("peel_alpha", "paste_alpha"):
            value = getattr(self, name)
            if not (math.isfinite(value) and 0 < value < 1):
                raise PrimError("InvalidParameter", f"{name} is {value}, but must lie between 0 and 1", parameter=name, value=value)
        if not (math.isfinite(self.mass_min) and 0 < self.mass_min <= 1):
            raise PrimError("InvalidParameter", f"mass_min is {self.mass_min}, but must be above 0 and at most 1", parameter="mass_min", value=self.mass_min)
        if self.objective not in (st.LENIENT1, st.LENIENT2, st.ORIGINAL):
            raise PrimError("InvalidParameter", f"objective is {self.objective}", parameter="objective", value=self.objective)


@dataclass(frozen=True)
class BoxStatistics:
    coverage: float
    density: float
    mean: float
    mass: float
    restricted_dimensions: int
    points: int
    cases_of_interest: int

    @classmethod
    def of(cls, points: int, cases: int, all_rows: int, all_cases: int, restricted: int) -> BoxStatistics:
        density = cases / points if points else math.nan
        return cls(cases / max(all_cases, 1), density, density, points / all_rows, restricted, points, cases)


@dataclass(frozen=True)
class QuasiP:
    name: str
    lower: float | None
    upper: float | None


@dataclass(frozen=True)
class BoxStep:
    limits: BoxLimits
    statistics: BoxStatistics
    quasi_p: tuple[QuasiP, ...]
    phase: str


@dataclass(frozen=True)
class Candidate:
    limits: BoxLimits
    points: int
    cases: int
    score: float = 0.0
    non_restricted: int = 0


class SparkCounts:
    """Answers from batched aggregations. Membership is a predicate; no row ids are kept.

    Every round scans the frame a few times, so its narrow rows are cached, on disk where memory is short; partitions of a
    lost executor are computed again. Where rows of equal values make the frame half as long or less and its numeric features
    have few values, what is cached is the table of their combinations.
    """

    def __init__(self, frame: ScenarioFrame):
        self.frame, self.removed = frame, []
        combinations, values = frame.distinct()
        self.few = {f.name for f in frame.features if f.kind != CATEGORICAL and values[f.name] <= FEW_VALUES}
        together = 2 * combinations <= frame.row_count() and all(f.kind == CATEGORICAL or f.name in self.few for f in frame.features)
        self.rows, self.cases = (F.col(ROWS), F.col(CASES)) if together else (None, None)
        self.df = (frame.equal_rows() if together else frame.df).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.df.unpersist()

    def _alive(self, df: DataFrame) -> DataFrame:
        for limits in self.removed:
            df = df.where(~limits.column())
        return df

    def remove(self, limits: BoxLimits) -> None:
        self.removed.append(limits)

    def _agg(self, columns: list) -> list:
        out: list = []
        for k in range(0, len(columns), BATCH):
            out += list(self._alive(self.df).agg(*(c.alias(str(i)) for i, c in enumerate(columns[k : k + BATCH]))).first())
        return out

    def tally(self, boxes: list[BoxLimits]) -> list[tuple[int, int]]:
        columns = []
        for box in boxes:
            inside = box.column()
            if self.rows is None:
                columns += [F.count_if(inside), F.count_if(inside & F.col(CASE))]
            else:
                columns += [F.sum(F.when(inside, x)) for x in (self.rows, self.cases)]
        found = [x or 0 for x in self._agg(columns)]
        return list(zip(found[::2], found[1::2], strict=True))

    def quantiles(self, asks: list[tuple[str, BoxLimits, int, float]]) -> list[float]:
        df, boxes = self._alive(self.df), list(dict.fromkeys(box for _, box, _, _ in asks))
        if len(boxes) == 1:
            df = df.where(boxes[0].column())
        inside = {box: F.lit(True) if len(boxes) == 1 else box.column() for box in boxes}
        by_value = list(dict.fromkeys((n, box) for n, box, _, _ in asks if n in self.few))
        counted = dict(zip(by_value, value_counts(df, [F.when(inside[box], F.col(f"`{n}`")) for n, box in by_value], self.rows), strict=True)) if by_value else {}
        wide = [Ask(F.col(f"`{n}`"), inside[box], rows, p) for n, box, rows, p in asks if n not in self.few]
        found = iter(quantiles(df, wide) if wide else [])
        return [st.counted_quantile(*counted[n, box], p) if n in self.few else next(found) for n, box, _, p in asks]

    def extremes(self, asks: list[tuple[str, BoxLimits, bool]]) -> list[int | None]:
        """Observed maximum (or minimum) of a feature inside a box."""
        return self._agg([(F.max if top else F.min)(F.when(box.column(), F.col(f"`{n}`"))) for n, box, top in asks]) if asks else []


class Ordered:
    """A numeric column in memory: codes into its ascending distinct values, so that no question sorts it again."""

    def __init__(self, values: np.ndarray):
        self.values, codes = np.unique(values, return_inverse=True)
        self.codes = codes.astype(np.int32)

    def __getitem__(self, keep: np.ndarray) -> Ordered:
        out = Ordered.__new__(Ordered)
        out.codes, out.values = self.codes[keep], self.values
        return out

    def mask(self, restriction: Range) -> np.ndarray:
        first, end = np.searchsorted(self.values, restriction.lower, "left"), np.searchsorted(self.values, restriction.upper, "right")
        return (self.codes >= first) & (self.codes < end)

    def end(self, top: bool, keep: np.ndarray | None = None) -> float | int | None:
        """The greatest (or least) value; None where there is none."""
        codes = self.codes if keep is None else self.codes[keep]
        return self.values[codes.max() if top else codes.min()].item() if len(codes) else None


class Coded:
    """A categorical column in memory: codes into its categories."""

    def __init__(self, values: pa.Array | pa.ChunkedArray):
        whole = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        found = whole.dictionary_encode()
        self.codes, self.categories = found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()

    def __getitem__(self, keep: np.ndarray) -> Coded:
        out = Coded.__new__(Coded)
        out.codes, out.categories = self.codes[keep], self.categories
        return out

    def mask(self, restriction: Categories) -> np.ndarray:
        return np.array([c in restriction.values for c in self.categories], bool)[self.codes]

    def present(self) -> frozenset[str]:
        return frozenset(self.categories[k] for k in np.flatnonzero(np.bincount(self.codes, minlength=len(self.categories))))


class LocalCounts:
    """The same answers from columns in memory: numbers, ordered, and Coded ones of categories.

    The boxes of a round differ from the current one in one restriction, so which rows a restriction holds is kept by feature.
    rows: how many rows of the frame each row stands for, one if not given; cases: how many of them are cases.
    """

    #: Restrictions whose rows are kept.
    KEPT = 48

    def __init__(self, columns: dict[str, np.ndarray | Coded], cases: np.ndarray, rows: np.ndarray | None = None):
        self.columns = {n: Ordered(x) if isinstance(x, np.ndarray) else x for n, x in columns.items()}
        self.cases, self.rows = cases, rows
        self._held: dict[tuple, np.ndarray | None] = {}

    @classmethod
    def collect(cls, frame: ScenarioFrame) -> LocalCounts:
        got = frame.equal_rows().toArrow()
        columns = {f.name: Coded(got.column(f.name)) if f.kind == CATEGORICAL else got.column(f.name).to_numpy() for f in frame.features}
        return cls(columns, got.column(CASES).to_numpy(), got.column(ROWS).to_numpy())

    def close(self) -> None:
        pass

    def limits(self, features: list[Feature]) -> BoxLimits:
        """The initial limits of these rows."""
        out = []
        for f in features:
            x = self.columns[f.name]
            out.append((f.name, Categories(x.present()) if f.kind == CATEGORICAL else Range(f.kind, x.end(False), x.end(True))))
        return BoxLimits(tuple(out))

    def _rows(self, name: str, restriction) -> np.ndarray | None:
        """Which rows a restriction holds; None for all."""
        key = (name, restriction)
        if key in self._held:
            self._held[key] = found = self._held.pop(key)  # the latest used stand last
            return found
        found = self.columns[name].mask(restriction)
        if len(self._held) >= self.KEPT:
            del self._held[next(iter(self._held))]
        self._held[key] = None if found.all() else found
        return self._held[key]

    def _mask(self, box: BoxLimits) -> np.ndarray:
        out = None
        for name, restriction in box:
            part = self._rows(name, restriction)
            if part is not None:
                out = part.copy() if out is None else np.logical_and(out, part, out=out)
        return np.ones(len(self.cases), bool) if out is None else out

    def remove(self, limits: BoxLimits) -> None:
        keep = ~self._mask(limits)
        self.columns = {n: v[keep] for n, v in self.columns.items()}
        self.cases = self.cases[keep]
        self.rows = None if self.rows is None else self.rows[keep]
        self._held.clear()

    def totals(self) -> tuple[int, int]:
        """Rows and cases."""
        return len(self.cases) if self.rows is None else int(self.rows.sum()), int(self.cases.sum())

    def tally(self, boxes: list[BoxLimits]) -> list[tuple[int, int]]:
        out = []
        for box in boxes:
            inside = self._mask(box)
            points = np.count_nonzero(inside) if self.rows is None else self.rows[inside].sum()
            out.append((int(points), int(self.cases[inside].sum())))
        return out

    def quantiles(self, asks: list[tuple[str, BoxLimits, int, float]]) -> list[float]:
        out, of, values, counts = [], None, None, None
        for n, box, _, p in asks:
            if of != (n, box):  # asks about the same values follow each other
                of, inside, x = (n, box), self._mask(box), self.columns[n]
                values = x.values.astype(np.float64)
                counts = np.bincount(x.codes[inside], None if self.rows is None else self.rows[inside], len(values)).astype(np.int64)
            out.append(st.counted_quantile(values, counts, p))
        return out

    def extremes(self, asks: list[tuple[str, BoxLimits, bool]]) -> list[int | None]:
        out = []
        for n, box, top in asks:
            found = self.columns[n].end(top, self._mask(box))
            out.append(None if found is None else int(found))
        return out


def best_of(candidates: list[Candidate], s: BoxStatistics, initial: BoxLimits, objective: str) -> Candidate | None:
    """Highest score, then most unrestricted features, then the first; s is of the box that they change."""
    best = None
    for c in candidates:
        score = st.objective_score(objective, s.cases_of_interest, s.points, c.cases, c.points)
        c = replace(c, score=score, non_restricted=len(initial.items) - len(c.limits.restricted(initial)))
        if best is None or (c.score, c.non_restricted) > (best.score, best.non_restricted):
            best = c
    return best


class Prim:
    """Finds boxes one after another; a found box's rows leave the population, the reference limits and masses do not move.

    strategy: "auto" searches in memory where the combinations of feature values make up to LOCAL_CELLS cells and by Spark jobs
    beyond; "local" or "distributed" fix it.
    """

    def __init__(self, frame: ScenarioFrame, config: PrimConfig | None = None, strategy: str = "auto"):
        self.frame, self.config = frame, config or PrimConfig()
        summary = frame.summary()
        self.initial, self.rows, self.cases = summary["limits"], summary["rows"], summary["cases"]
        most = LOCAL_CELLS // (len(frame.features) + 2)
        local = strategy == "local" or strategy == "auto" and (self.rows <= most or frame.distinct()[0] <= most)
        self.counts = LocalCounts.collect(frame) if local else SparkCounts(frame)
        self.left = (self.rows, self.cases)
        self.found: list[BoxLimits] = []
        self.order: list[Feature] = [f for kind in (CONTINUOUS, INTEGER, CATEGORICAL) for f in frame.features if f.kind == kind]

    @classmethod
    def over_columns(cls, counts: LocalCounts, features: list[Feature], initial: BoxLimits, config: PrimConfig) -> Prim:
        """A search over columns in memory, as inside a task: no frame and no session."""
        self = cls.__new__(cls)
        self.frame, self.config, self.counts, self.initial = None, config, counts, initial
        self.rows, self.cases = counts.totals()
        self.left, self.found = (self.rows, self.cases), []
        self.order = [f for kind in (CONTINUOUS, INTEGER, CATEGORICAL) for f in features if f.kind == kind]
        return self

    def remaining_rows(self) -> DataFrame:
        """Rows that no found box holds, by predicate."""
        df = self.frame.df
        for limits in self.found:
            df = df.where(~limits.column())
        return df

    def find_box(self) -> PrimBox | None:
        if not self.left[0]:
            return None
        current = self._step(self.initial, *self.left, "initial")
        steps = [current]
        while (best := self._best(self.peels(current), current)) and self._accepts_peel(current, best):
            current = self._step(best.limits, best.points, best.cases, "peel")
            steps.append(current)
        while (best := self._best(self.pastes(current), current)) and self._accepts_paste(current, best):
            current = self._step(best.limits, best.points, best.cases, "paste")
            steps.append(current)
        s = current.statistics
        self.counts.remove(current.limits)
        self.found.append(current.limits)
        population = self.left
        self.left = (self.left[0] - s.points, self.left[1] - s.cases_of_interest)
        return PrimBox(tuple(steps), self.initial, self.frame, tuple(self.found[:-1]), population)

    def close(self) -> None:
        """Lets go of what the search keeps cached."""
        self.counts.close()

    def boxes(self) -> Iterator[PrimBox]:
        """Boxes until every row is covered."""
        while (box := self.find_box()) is not None:
            yield box

    # ------------------------------------------------------------ candidates

    def peels(self, current: BoxStep) -> list[Candidate]:
        """Candidate peels: continuous features first, then integer, then categorical; upper before lower."""
        box, n = current.limits, current.statistics.points
        alpha = self.config.peel_alpha
        numeric = [f for f in self.order if f.kind != CATEGORICAL]
        asks = [(f.name, box, n, p) for f in numeric for p in (1 - alpha, alpha)]
        found = iter(self.counts.quantiles(asks))
        plans: list[tuple[BoxLimits, tuple[str, bool] | None]] = []
        for f in numeric:
            own = box[f.name]
            upper, lower = next(found), next(found)
            if f.kind == CONTINUOUS:
                plans.append((box.with_restriction(f.name, replace(own, upper=upper)), None))
                plans.append((box.with_restriction(f.name, replace(own, lower=lower)), None))
            else:
                upper, lower = math.trunc(upper), math.trunc(lower)
                top = upper - 1 if upper == own.upper else upper  # strict on the current bound
                bottom = lower + 1 if lower == own.lower else lower
                plans.append((box.with_restriction(f.name, replace(own, upper=top)), (f.name, True)))
                plans.append((box.with_restriction(f.name, replace(own, lower=bottom)), (f.name, False)))
        for f in self.order:
            if f.kind == CATEGORICAL and len(box[f.name].values) > 1:
                plans += [(box.with_restriction(f.name, Categories(box[f.name].values - {c})), None) for c in sorted(box[f.name].values)]
        counts = self.counts.tally([b for b, _ in plans])
        snapped = [k for k, (_, s) in enumerate(plans) if s]
        seen = dict(zip(snapped, self.counts.extremes([(plans[k][1][0], plans[k][0], plans[k][1][1]) for k in snapped]), strict=True))
        out = []
        for k, ((limits, snap), (points, cases)) in enumerate(zip(plans, counts, strict=True)):
            if snap:  # an integer limit is the outermost value that is left
                name, top = snap
                bound = seen[k]
                if bound is None:
                    bound = self.counts.extremes([(name, box, top)])[0]
                limits = box.with_restriction(name, replace(box[name], **{"upper" if top else "lower": bound}))
            out.append(Candidate(limits, points, cases))
        return out

    def pastes(self, current: BoxStep) -> list[Candidate]:
        """Candidate pastes of restricted features, in the same order; lower before upper."""
        box, initial = current.limits, self.initial
        alpha = self.config.paste_alpha
        open_ = set(box.restricted(initial))
        numeric = [f for f in self.order if f.name in open_ and f.kind != CATEGORICAL]
        regions = []
        for f in numeric:
            own, whole = box[f.name], initial[f.name]
            regions.append((f, "lower", box.with_restriction(f.name, Range(f.kind, whole.lower, own.lower)), 1 - alpha))
            regions.append((f, "upper", box.with_restriction(f.name, Range(f.kind, own.upper, whole.upper)), alpha))
        sizes = [n for n, _ in self.counts.tally([r[2] for r in regions])] if regions else []
        filled = [k for k, n in enumerate(sizes) if n]
        values = dict(zip(filled, self.counts.quantiles([(regions[k][0].name, regions[k][2], sizes[k], regions[k][3]) for k in filled]), strict=True))
        boxes = []
        for k, (f, side, _, _) in enumerate(regions):
            bound = values.get(k, getattr(initial[f.name], side))
            boxes.append(box.with_restriction(f.name, replace(box[f.name], **{side: math.trunc(bound) if f.kind == INTEGER else bound})))
        for f in self.order:
            if f.kind == CATEGORICAL and f.name in open_:
                boxes += [box.with_restriction(f.name, Categories(box[f.name].values | {c})) for c in sorted(initial[f.name].values - box[f.name].values)]
        return [Candidate(b, n, k) for b, (n, k) in zip(boxes, self.counts.tally(boxes) if boxes else [], strict=True)]

    def _best(self, candidates: list[Candidate], current: BoxStep) -> Candidate | None:
        return best_of(candidates, current.statistics, self.initial, self.config.objective)

    def _accepts_peel(self, current: BoxStep, c: Candidate) -> bool:
        mass = c.points / self.rows
        return mass >= self.config.mass_min and mass < current.statistics.mass and c.score > 0

    def _accepts_paste(self, current: BoxStep, c: Candidate) -> bool:
        mass, s = c.points / self.rows, current.statistics
        return mass >= self.config.mass_min and mass > s.mass and c.score > 0 and st.mean(c.cases, c.points) > st.mean(s.cases_of_interest, s.points)

    def _step(self, limits: BoxLimits, points: int, cases: int, phase: str) -> BoxStep:
        restricted = limits.restricted(self.initial)
        statistics = BoxStatistics.of(points, cases, self.rows, self.cases, len(restricted))
        return BoxStep(limits, statistics, tuple(self._quasi_p(limits, restricted, statistics)), phase)

    def _quasi_p(self, limits: BoxLimits, restricted: list[str], s: BoxStatistics) -> list[QuasiP]:
        """For each restriction, how likely the box's cases are if the rows without that bound had their own rate."""
        relaxed = relaxed_boxes(limits, self.initial, restricted)
        counts = self.counts.tally([b for _, _, b in relaxed]) if relaxed else []
        found: dict[str, dict[str, float]] = {}
        for (name, side, _), (n, k) in zip(relaxed, counts, strict=True):
            found.setdefault(name, {})[side] = st.binomial_greater(s.cases_of_interest, s.points, k / n)
        return [QuasiP(n, found.get(n, {}).get("lower"), found.get(n, {}).get("upper")) for n in restricted]


def relaxed_boxes(limits: BoxLimits, initial: BoxLimits, restricted: list[str]) -> list[tuple[str, str, BoxLimits]]:
    """(feature, side, box) with that one bound opened to its initial value; a categorical feature counts as one lower side."""
    out = []
    for name in restricted:
        own, whole = limits[name], initial[name]
        if isinstance(own, Categories):
            out.append((name, "lower", limits.with_restriction(name, whole)))
            continue
        for side in ("lower", "upper"):
            if getattr(own, side) != getattr(whole, side):
                out.append((name, side, limits.with_restriction(name, replace(own, **{side: getattr(whole, side)}))))
    return out


TRAJECTORY = "step int, phase string, coverage double, density double, mean double, mass double, restricted_dimensions int, points long, cases_of_interest long"
LIMITS = "step int, feature string, kind string, lower double, upper double, categories array<string>, quasi_p_lower double, quasi_p_upper double"


@dataclass(frozen=True)
class PrimBox:
    """A found box: its steps, and what it was found in. population: rows and cases at its first step."""

    trajectory: tuple[BoxStep, ...]
    initial: BoxLimits
    frame: ScenarioFrame
    removed: tuple[BoxLimits, ...] = ()
    population: tuple[int, int] = (0, 0)

    @property
    def final_step(self) -> BoxStep:
        return self.trajectory[-1]

    def rows(self, position: int = -1) -> DataFrame:
        """Member rows of a step, by predicate."""
        df = self.frame.df
        for limits in self.removed:
            df = df.where(~limits.column())
        return df.where(self.trajectory[position].limits.column())

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = []
        for k, step in enumerate(self.trajectory):
            s = step.statistics
            rows.append((k, step.phase, s.coverage, s.density, s.mean, s.mass, s.restricted_dimensions, s.points, s.cases_of_interest))
        return spark.createDataFrame(rows, TRAJECTORY)

    def limits_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = []
        for k, step in enumerate(self.trajectory):
            p = {q.name: q for q in step.quasi_p}
            for name, kind, lower, upper, categories in step.limits.as_rows():
                q = p.get(name)
                rows.append((k, name, kind, lower, upper, categories, q and q.lower, q and q.upper))
        return spark.createDataFrame(rows, LIMITS)
