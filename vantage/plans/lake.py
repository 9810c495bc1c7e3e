"""The shallow-lake problem with a closed-loop policy, as an example of a vectorised model.

A town releases phosphorus into a lake by a rule on the lake's state (two cubic radial basis functions). Natural inflow is
log-normal. All rows and realisations of a batch step through the years together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from vantage.functions import outcomes as oc
from vantage.functions.seeds import ROW_DOMAIN, derive_seed
from vantage.operators.evaluate import is_of, out_of_domain, rejected_rows
from vantage.schema import SchemaBuilder, SessionSchema

# Fixed values of the example: bounds of a yearly release, of the critical state, and the change that counts as inert.
RELEASE = (0.01, 0.1)
ROOT = (0.01, 1.5)
INERT = 0.02
#: Inputs with their domains.
INPUTS = {"b": (0.1, 0.45), "q": (2.0, 4.5), "mean": (0.01, 0.05), "stdev": (0.001, 0.005), "delta": (0.93, 0.99), "c1": (-2.0, 2.0), "c2": (-2.0, 2.0), "r1": (0.0, 2.0), "r2": (0.0, 2.0), "w1": (0.0, 1.0)}
OUTPUTS = ("max_p", "utility", "inertia", "reliability")


def session(threshold_output: bool = True) -> SessionSchema:
    builder = SchemaBuilder()
    for name, (low, high) in INPUTS.items():
        builder.continuous(name, low, high)
    for name in OUTPUTS:
        builder.quantity_output(name)
    return (builder.boolean_output("desirable_lake_state") if threshold_output else builder).build()


def critical_phosphorus(b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Where natural recycling balances decay, by bisection; NaN where it does not between the bounds of ROOT."""
    balance = lambda p: p**q / (1 + p**q) - b * p
    low, high = np.full_like(b, ROOT[0]), np.full_like(b, ROOT[1])
    bracketed = np.signbit(balance(low)) != np.signbit(balance(high))
    sign = np.signbit(balance(low))
    for _ in range(80):
        middle = (low + high) / 2
        same = np.signbit(balance(middle)) == sign
        low, high = np.where(same, middle, low), np.where(same, high, middle)
    return np.where(bracketed, (low + high) / 2, np.nan)


def release(p: np.ndarray, x: dict[str, np.ndarray]) -> np.ndarray:
    """The policy's release for a state of the lake."""
    rule = x["w1"] * (np.abs(p - x["c1"]) / x["r1"]) ** 3 + (1 - x["w1"]) * (np.abs(p - x["c2"]) / x["r2"]) ** 3
    return np.clip(rule, *RELEASE)


@dataclass(frozen=True)
class Lake:
    """Fixed controls of an evaluation."""

    alpha: float = 0.41
    realizations: int = 150
    years: int = 100

    def __post_init__(self):
        if self.realizations < 1 or self.years < 2 or not np.isfinite(self.alpha):
            raise ValueError("the lake needs a realisation, two years and a finite utility of pollution")

    def run(self, columns: dict[str, np.ndarray], seeds: list[int]) -> tuple[dict[str, np.ndarray], list[str | None]]:
        """Outcomes of each row, and why a row has none."""
        n, r, t = len(seeds), self.realizations, self.years
        x = {k: np.asarray(v, np.float64)[:, None] for k, v in columns.items()}
        why: list[str | None] = [None] * n

        def fail(rows: np.ndarray, message: str) -> None:
            for k in np.flatnonzero(rows):
                why[k] = why[k] or message

        for name in INPUTS:
            fail(~np.isfinite(x[name][:, 0]), f"{name} must be finite")
        for name in ("b", "q", "mean", "r1", "r2"):
            fail(~(x[name][:, 0] > 0), f"{name} must be greater than zero")
        fail(x["stdev"][:, 0] < 0, "stdev must not be negative")
        fail(~((x["delta"][:, 0] > 0) & (x["delta"][:, 0] <= 1)), "delta must be greater than zero and at most one")
        fail(~((x["w1"][:, 0] >= 0) & (x["w1"][:, 0] <= 1)), "w1 must lie between zero and one")
        with np.errstate(all="ignore"):
            critical = critical_phosphorus(x["b"], x["q"])
            fail(np.isnan(critical[:, 0]), "the critical state is not bracketed")
            variance = np.log1p((x["stdev"] / x["mean"]) ** 2)
            mu = np.log(x["mean"]) - variance / 2
            draws = np.stack([np.random.Generator(np.random.Philox(key=s)).standard_normal((r, t)) for s in seeds]) if n else np.zeros((0, r, t))
            inflow = np.exp(mu[:, :, None] + np.sqrt(variance)[:, :, None] * draws)
            p, decision, discount = np.zeros((n, r)), np.full((n, r), RELEASE[1]), np.ones((n, 1))
            reliable = (p < critical).astype(np.int64)
            inert = np.zeros((n, r), np.int64)
            utility = self.alpha * decision.mean(1)
            highest = np.zeros(n)
            for year in range(1, t):
                following = release(p, x)
                power = p ** x["q"]
                p = (1 - x["b"]) * p + power / (1 + power) + following + inflow[:, :, year - 1]
                fail(~np.isfinite(p).all(1), f"the state is not finite in year {year}")
                highest = np.maximum(highest, p.mean(1))
                reliable += p < critical
                inert += np.abs(following - decision) < INERT
                discount = discount * x["delta"]
                utility += self.alpha * (following * discount).mean(1)
                decision = following
        found = {"max_p": highest, "utility": utility, "inertia": inert.mean(1) / t, "reliability": reliable.mean(1) / t}
        for name, value in found.items():
            fail(~np.isfinite(value), f"{name} is not finite")
        return found, why


@dataclass
class LakeEvaluator:
    """Evaluates requests batch by batch; a desirable state has an average phosphorus below threshold throughout."""

    lake: Lake = Lake()
    threshold: float = 0.8

    @property
    def session(self) -> SessionSchema:
        return session()

    def evaluate(self, requests: DataFrame) -> DataFrame:
        own = self.session
        if not is_of(own, requests):
            return rejected_rows(own, requests)
        lake, threshold, kind = self.lake, self.threshold, own.result_type()

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow = to_arrow_schema(kind)
            for whole in parts:
                for at in range(0, len(whole), 16):
                    part = whole.slice(at, 16)
                    inputs = part.column("inputs")
                    columns = {n: inputs.field(k).to_numpy(zero_copy_only=False) for k, n in enumerate(INPUTS)}
                    rows = part.column("row").to_pylist()
                    found, why = lake.run(columns, [derive_seed(int(s), r, ROW_DOMAIN) for s, r in zip(part.column("seed").to_pylist(), rows, strict=True)])
                    outside = [out_of_domain(own, x) for x in inputs.to_pylist()]
                    why = [w or (o and "") for w, o in zip(why, outside, strict=True)]
                    outputs = [None if w is not None else {**{n: float(found[n][k]) for n in OUTPUTS}, "desirable_lake_state": bool(found["max_p"][k] < threshold)} for k, w in enumerate(why)]
                    said = [o or (oc.outcome(oc.EVALUATION_ERROR, message=w) if w else oc.outcome(oc.SUCCESS)) for w, o in zip(why, outside, strict=True)]
                    yield pa.record_batch([part.column("evaluation_id"), part.column("row"), pa.array(outputs, arrow.field("outputs").type), pa.array(said, arrow.field("outcome").type)], names=arrow.names)

        return requests.select("evaluation_id", "row", "seed", "inputs").mapInArrow(run, kind)
