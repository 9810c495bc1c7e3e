"""Inputs of the golden search cases (FIXTURES.md, section 1), and the plain search that they are held against."""

import math

import numpy as np
import pandas as pd

from vantage.operators.frame import Feature, ScenarioFrame
from vantage.operators.search import PrimConfig


def _continuous() -> pd.DataFrame:
    r = np.arange(160)
    df = pd.DataFrame({"load": (r + 0.5) / 160, "resilience": ((47 * r) % 160 + 0.5) / 160, "recovery": ((89 * r) % 160 + 0.5) / 160})
    df["case"] = ((df.load >= 0.58) & (df.resilience <= 0.44)) | ((df.load >= 0.82) & (df.recovery >= 0.75))
    return df


def _lenient2() -> pd.DataFrame:
    rng = np.random.default_rng(112)
    df = pd.DataFrame({n: rng.random(180) for n in ("x1", "x2", "x3")})
    df["case"] = rng.random(180) < 0.03 + 0.5 * ((df.x1 > 0.5) & (df.x2 < 0.6)) + 0.3 * ((df.x3 > 0.8) & (df.x1 > 0.2))
    return df


def _pasting() -> pd.DataFrame:
    rng = np.random.default_rng(6)
    df = pd.DataFrame({n: rng.random(200) for n in ("x1", "x2")})
    df["case"] = rng.random(200) < 0.04 + 0.72 * ((df.x1 > 0.48) & (df.x2 < 0.58)) + 0.12 * (df.x1 > 0.72)
    return df


def _mixed() -> pd.DataFrame:
    rows = [(c, d, g) for g in ("baseline", "efficient", "fragile", "robust") for c in range(10) for d in range(10)]
    df = pd.DataFrame(rows, columns=["capacity", "demand", "regime"])
    c, d, g = df.capacity, df.demand, df.regime
    df["case"] = ((g == "fragile") & (c >= 5) & (d <= 4)) | ((g == "baseline") & (c >= 8) & (d <= 2)) | ((g == "efficient") & (c == 9) & (d == 0))
    return df


#: name: data, configuration, (steps, peels, pastes, points, cases, coverage, density)
GOLDEN = {
    "continuous_lenient1": (_continuous, PrimConfig(0.1, 0.1, 0.1, "lenient1"), (16, 15, 0, 29, 29, 0.805556, 1.0)),
    "continuous_original": (_continuous, PrimConfig(0.1, 0.1, 0.15, "original"), (17, 16, 0, 26, 26, 0.722222, 1.0)),
    "continuous_lenient2": (_lenient2, PrimConfig(0.1, 0.1, 0.1, "lenient2"), (19, 14, 4, 44, 34, 0.68, 0.772727)),
    "continuous_with_pasting": (_pasting, PrimConfig(0.1, 0.1, 0.1, "lenient1"), (21, 17, 3, 33, 31, 0.563636, 0.939394)),
    "mixed_lenient1": (_mixed, PrimConfig(0.1, 0.1, 0.05, "lenient1"), (14, 13, 0, 25, 25, 0.78125, 1.0)),
}


def frame(spark, df: pd.DataFrame) -> ScenarioFrame:
    features = []
    for n in df.columns[:-1]:
        kind = df[n].dtype.kind
        features.append(Feature.continuous(n) if kind == "f" else Feature.integer(n) if kind == "i" else Feature.categorical(n))
    return ScenarioFrame(spark.createDataFrame(df), features)


# ---------------------------------------------------------------- the search, row by row


def _quantile(values, p):
    s = sorted(values)
    pos = (len(s) - 1) * p
    lo, hi = math.floor(pos), math.ceil(pos)
    if p > 0.5:
        while s[lo] == s[hi] and lo > 0:
            lo -= 1
    else:
        while s[lo] == s[hi] and hi < len(s) - 1:
            hi += 1
    return (s[lo] + s[hi]) / 2


def plain_search(df: pd.DataFrame, config: PrimConfig):
    """Trajectory of the first box as (phase, row positions, limits), with row lists and no shared code."""
    names = list(df.columns[:-1])
    kinds = {n: {"f": "c", "i": "i"}.get(df[n].dtype.kind, "k") for n in names}
    columns = {n: df[n].tolist() for n in names}
    case = df["case"].tolist()
    everyone = list(range(len(df)))
    initial = {n: frozenset(columns[n]) if kinds[n] == "k" else (min(columns[n]), max(columns[n])) for n in names}
    ordered = [n for k in "cik" for n in names if kinds[n] == k]

    def holds(limits, i):
        return all(columns[n][i] in limits[n] if kinds[n] == "k" else limits[n][0] <= columns[n][i] <= limits[n][1] for n in names)

    def inside(limits):
        return [i for i in everyone if holds(limits, i)]

    def rate(rows):
        return sum(case[i] for i in rows) / len(rows) if rows else 0.0

    def score(old, new):
        if config.objective == "original":
            return rate(new) if new else -1
        if rate(old) == rate(new) or len(old) == len(new):
            return 0
        gain = (rate(new) - rate(old)) / abs(len(old) - len(new))
        return gain if config.objective == "lenient1" else len(new) * (rate(new) - rate(old)) / abs(len(old) - len(new))

    def best(rows, found):
        def free(limits):
            return sum(limits[n] == initial[n] for n in names)

        top = None
        for limits, new in found:
            key = (score(rows, new), free(limits))
            if top is None or key > top[0]:
                top = (key, limits, new)
        return top

    rows, limits = everyone, dict(initial)
    out = [("initial", rows, limits)]
    while True:
        found = []
        for n in ordered:
            x = columns[n]
            values = [x[i] for i in rows]
            if kinds[n] == "c":
                q = _quantile(values, 1 - config.peel_alpha)
                found.append(({**limits, n: (limits[n][0], q)}, [i for i in rows if x[i] <= q]))
                q = _quantile(values, config.peel_alpha)
                found.append(({**limits, n: (q, limits[n][1])}, [i for i in rows if x[i] >= q]))
            elif kinds[n] == "i":
                q = int(_quantile(values, 1 - config.peel_alpha))
                new = [i for i in rows if (x[i] < q if q == limits[n][1] else x[i] <= q)]
                found.append(({**limits, n: (limits[n][0], max(([x[i] for i in new]) or values))}, new))
                q = int(_quantile(values, config.peel_alpha))
                new = [i for i in rows if (x[i] > q if q == limits[n][0] else x[i] >= q)]
                found.append(({**limits, n: (min(([x[i] for i in new]) or values), limits[n][1])}, new))
            elif len(limits[n]) > 1:
                found += [({**limits, n: limits[n] - {c}}, [i for i in rows if x[i] != c]) for c in sorted(limits[n])]
        top = best(rows, found)
        if not (top and len(top[2]) / len(df) >= config.mass_min and len(top[2]) < len(rows) and top[0][0] > 0):
            break
        rows, limits = top[2], top[1]
        out.append(("peel", rows, limits))
    while True:
        found = []
        for n in ordered:
            if limits[n] == initial[n]:
                continue
            if kinds[n] == "k":
                found += [({**limits, n: limits[n] | {c}}, None) for c in sorted(initial[n] - limits[n])]
                continue
            for side, region, p in ((0, (initial[n][0], limits[n][0]), 1 - config.paste_alpha), (1, (limits[n][1], initial[n][1]), config.paste_alpha)):
                there = [columns[n][i] for i in inside({**limits, n: region})]
                q = _quantile(there, p) if there else initial[n][side]
                q = int(q) if kinds[n] == "i" else q
                found.append(({**limits, n: (q, limits[n][1]) if side == 0 else (limits[n][0], q)}, None))
        found = [(l, inside(l)) for l, _ in found]
        top = best(rows, found)
        if not (top and len(top[2]) / len(df) >= config.mass_min and len(top[2]) > len(rows) and top[0][0] > 0 and rate(top[2]) > rate(rows)):
            break
        rows, limits = top[2], top[1]
        out.append(("paste", rows, limits))
    return out


