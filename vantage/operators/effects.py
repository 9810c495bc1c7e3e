"""What each restriction of a box contributes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.errors import RestrictionEffectError
from vantage.operators.boxes import Restriction
from vantage.operators.frame import CASE, ScenarioFrame
from vantage.operators.search import BoxStatistics, PrimBox


@dataclass(frozen=True)
class RestrictionEffect:
    """A restriction, and the box's statistics with it and without it."""

    name: str
    restriction: Restriction
    with_it: BoxStatistics
    without: BoxStatistics

    @property
    def density_gain(self) -> float:
        return self.with_it.density - self.without.density


def _step(box: PrimBox, position: int):
    if not 0 <= position < len(box.trajectory):
        raise RestrictionEffectError("PositionOutOfRange", f"step {position} was asked for, but the trajectory has {len(box.trajectory)} steps", position=position, steps=len(box.trajectory))
    return box.trajectory[position]


def restricted_limits(box: PrimBox, position: int) -> list[tuple[str, Restriction]]:
    """The restrictions of a step that differ from those of step 0."""
    step = _step(box, position)
    return [(n, step.limits[n]) for n in step.limits.restricted(box.trajectory[0].limits)]


def restriction_effects(box: PrimBox, frame: ScenarioFrame, position: int) -> list[RestrictionEffect]:
    """One effect for each restriction of a step, over the rows of step 0, from one aggregation.

    The frame must be the one that the box was found in: same features, and the same counts for the box.
    """
    step = _step(box, position)
    own = [(f.name, f.kind) for f in frame.features]
    if own != [(f.name, f.kind) for f in box.frame.features]:
        raise RestrictionEffectError("DatasetMismatch", "the frame has other features than the one the box was found in", reason="features")
    names = [n for n, _ in restricted_limits(box, position)]
    first = box.trajectory[0].limits
    boxes = [step.limits, *(step.limits.with_restriction(n, first[n]) for n in names)]
    df = frame.df
    for limits in box.removed:
        df = df.where(~limits.column())
    whole = frame.summary()
    columns = [c for b in boxes for c in (F.count_if(b.column()), F.count_if(b.column() & F.col(CASE)))]
    counts = list(df.agg(*(c.alias(str(k)) for k, c in enumerate(columns))).first())
    pairs = list(zip(counts[::2], counts[1::2], strict=True))
    s = step.statistics
    if pairs[0] != (s.points, s.cases_of_interest):
        raise RestrictionEffectError("DatasetMismatch", f"the box holds {pairs[0]} rows and cases of the frame, not {(s.points, s.cases_of_interest)}", reason="counts")
    return [RestrictionEffect(n, step.limits[n], s, BoxStatistics.of(*pair, whole["rows"], whole["cases"], len(names) - 1)) for n, pair in zip(names, pairs[1:], strict=True)]


def effects_dataframe(spark: SparkSession, effects: list[RestrictionEffect]) -> DataFrame:
    rows = [(e.name, e.without.points, e.without.cases_of_interest, e.without.coverage, e.without.density, e.density_gain) for e in effects]
    return spark.createDataFrame(rows, "feature string, points long, cases_of_interest long, coverage double, density double, density_gain double")
