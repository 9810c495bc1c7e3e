"""Choice of one step of a trajectory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.errors import CandidateSelectionError
from vantage.functions.statistics import harmonic_mean
from vantage.operators.search import BoxStatistics, PrimBox


@dataclass(frozen=True)
class Balanced:
    """Highest harmonic mean of coverage and density."""

    def eligible(self, s: BoxStatistics) -> bool:
        return True

    def score(self, s: BoxStatistics) -> float:
        return harmonic_mean(s.coverage, s.density)

    def eligible_column(self) -> Column:
        return F.lit(True)

    def score_column(self) -> Column:
        c, d = F.col("coverage"), F.col("density")
        return F.when(c + d == 0, 0.0).otherwise(2 * c * d / (c + d))


@dataclass(frozen=True)
class HighDensity:
    """Highest coverage among steps of at least a density in (0, 1]."""

    minimum: float

    def __post_init__(self):
        if not 0 < self.minimum <= 1:
            raise CandidateSelectionError("InvalidMinimumDensity", f"a minimum density of {self.minimum} is not in (0, 1]", value=self.minimum)

    def eligible(self, s: BoxStatistics) -> bool:
        return s.density >= self.minimum

    def score(self, s: BoxStatistics) -> float:
        return s.coverage

    def eligible_column(self) -> Column:
        return F.col("density") >= self.minimum

    def score_column(self) -> Column:
        return F.col("coverage")


@dataclass(frozen=True)
class CandidateSelection:
    """An objective, at most so many restricted features, and whether the unrestricted box may be chosen."""

    objective: Balanced | HighDensity = Balanced()
    max_restricted_dimensions: int | None = None
    requires_restriction: bool = False

    @classmethod
    def restricting_at_least_one(cls, objective=Balanced(), max_restricted_dimensions: int | None = None) -> CandidateSelection:  # noqa: B008
        return cls(objective, max_restricted_dimensions, True)

    def eligible(self, s: BoxStatistics) -> bool:
        most = self.max_restricted_dimensions
        return (not self.requires_restriction or s.restricted_dimensions >= 1) and (most is None or s.restricted_dimensions <= most) and self.objective.eligible(s)

    def eligible_column(self) -> Column:
        own = self.objective.eligible_column()
        if self.requires_restriction:
            own = own & (F.col("restricted_dimensions") >= 1)
        if self.max_restricted_dimensions is not None:
            own = own & (F.col("restricted_dimensions") <= self.max_restricted_dimensions)
        return own


def select_candidate(box: PrimBox, selection: CandidateSelection) -> int | None:
    """Position of the best eligible step, the earliest of equals; None without an eligible one."""
    best = None
    for k, step in enumerate(box.trajectory):
        if selection.eligible(step.statistics):
            score = selection.objective.score(step.statistics)
            if best is None or score > best[0]:
                best = (score, k)
    return best[1] if best else None


def select_from(trajectory: DataFrame, selection: CandidateSelection) -> DataFrame:
    """The same over a trajectory table: one row at most, with its score."""
    return trajectory.where(selection.eligible_column()).withColumn("score", selection.objective.score_column()).orderBy(F.desc("score"), "step").limit(1)
