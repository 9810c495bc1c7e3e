import math

import numpy as np
import pytest
from cases import GOLDEN, frame, plain_search

from vantage.errors import CandidateSelectionError, PrimError, RestrictionEffectError
from vantage.functions import statistics as st
from vantage.functions.quantile import Ask, quantiles
from vantage.operators.boxes import Categories
from vantage.operators.effects import effects_dataframe, restricted_limits, restriction_effects
from vantage.operators.search import BoxStatistics, BoxStep, LocalCounts, Prim, PrimConfig, SparkCounts
from vantage.operators.selection import Balanced, CandidateSelection, HighDensity, select_candidate, select_from
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_case_matches_plain_search_in_memory(spark, name):
    make, config, expected = GOLDEN[name]
    df = make()
    box = Prim(frame(spark, df), config, "local").find_box()
    plain = plain_search(df, config)
    assert [s.phase for s in box.trajectory] == [p for p, _, _ in plain]
    for step, (_, rows, limits) in zip(box.trajectory, plain):
        s = step.statistics
        assert s.points == len(rows)
        assert s.cases_of_interest == sum(df["case"].iloc[rows])
        for feature, r in step.limits:
            assert (r.values if isinstance(r, Categories) else (r.lower, r.upper)) == limits[feature]
    steps, peels, pastes, points, cases, coverage, density = expected
    s = box.final_step.statistics
    phases = [x.phase for x in box.trajectory]
    assert (len(phases), phases.count("peel"), phases.count("paste"), s.points, s.cases_of_interest) == (steps, peels, pastes, points, cases)
    assert s.coverage == pytest.approx(coverage, abs=1e-6) and s.density == pytest.approx(density, abs=1e-6)


@pytest.mark.parametrize("name", ["continuous_with_pasting", "mixed_lenient1"])
def test_distributed_search_equals_local(spark, name):
    make, config, _ = GOLDEN[name]
    f = frame(spark, make())
    f.df.cache()
    a, b = (Prim(f, config, s).find_box() for s in ("local", "distributed"))
    assert a.trajectory == b.trajectory


def test_repeated_boxes_partition_the_rows(spark):
    make, config, _ = GOLDEN["mixed_lenient1"]
    f = frame(spark, make())
    prim = Prim(f, config)
    boxes = list(prim.boxes())
    assert sum(b.final_step.statistics.points for b in boxes) == 400
    assert prim.remaining_rows().count() == 0
    assert boxes[1].rows(0).count() == 400 - boxes[0].final_step.statistics.points
    effects = restriction_effects(boxes[1], f, len(boxes[1].trajectory) - 1)
    assert all(e.without.points <= boxes[1].trajectory[0].statistics.points for e in effects)


def test_quantile_vectors(spark):
    for values, p, want in [(range(10), 0.9, 8.5), (range(10), 0.95, 8.5), (range(10), 0.1, 0.5), (range(10), 0.05, 0.5), ([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9], 0.95, 8.5), ([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9], 0.05, 1.5)]:
        assert st.quantile(np.array(values), p) == want
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        assert quantiles(df, [Ask(F.col("x"), F.lit(True), len(list(values)), p)]) == [want]


def test_bracketed_quantiles_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr("vantage.functions.quantile.BRACKET_ROWS", 50)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), rng.integers(0, 4, 3000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    asks, want = [], []
    for p in (0.01, 0.05, 0.4, 0.5, 0.7, 0.95):
        for where, part in ((F.lit(True), x), (F.col("x") > 0, x[x > 0])):
            asks.append(Ask(F.col("x"), where, len(part), p))
            want.append(st.quantile(part, p))
    assert quantiles(df, asks) == want


def test_binomial_tail():
    assert [st.binomial_greater(*a) for a in ((0, 5, 0.2), (2, 5, 0.0), (5, 5, 1.0))] == [1, 0, 1]
    assert st.binomial_greater(3, 5, 0.5) == pytest.approx(0.5, abs=1e-12)
    for n, k, p in ((30, 12, 0.3), (500, 480, 0.9), (800, 10, 0.005)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert st.binomial_greater(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_configuration_bounds():
    for bad in ((0, 0.1, 0.1), (1, 0.1, 0.1), (0.1, 0, 0.1), (0.1, 0.1, 0), (0.1, 0.1, 1.1), (math.nan, 0.1, 0.1)):
        with pytest.raises(PrimError) as e:
            PrimConfig(*bad)
        assert e.value.variant == "InvalidParameter"
    PrimConfig(0.8, 0.8, 1)


@pytest.fixture(scope="module")
def selected(spark):
    import pandas as pd

    i = np.arange(400)
    df = pd.DataFrame({"x": (i % 100) / 100, "c": np.where(i // 100 % 2, "b", "a"), "n": i % 7})
    df["case"] = (i % 100 >= 60) & (i // 100 % 2 == 1)
    f = frame(spark, df)
    return f, Prim(f).find_box()


def test_effects_name_the_restrictions_that_matter(selected, spark):
    f, box = selected
    last = len(box.trajectory) - 1
    effects = restriction_effects(box, f, last)
    assert {e.name for e in effects} == {n for n, _ in restricted_limits(box, last)} == {"x", "c"}
    assert all(e.density_gain > 0 and e.without.restricted_dimensions == e.with_it.restricted_dimensions - 1 for e in effects)
    assert effects_dataframe(spark, effects).count() == 2
    with pytest.raises(RestrictionEffectError) as e:
        restriction_effects(box, f, last + 1)
    assert e.value.variant == "PositionOutOfRange"
    import pandas as pd

    other = frame(spark, pd.DataFrame({"x": [0.5], "c": ["a"], "n": [1], "case": [True]}))
    with pytest.raises(RestrictionEffectError) as e:
        restriction_effects(box, other, last)
    assert e.value.variant == "DatasetMismatch"


def test_selection(selected, spark):
    _, box = selected
    table = box.to_dataframe(spark)
    for selection in (CandidateSelection(), CandidateSelection(HighDensity(0.9)), CandidateSelection.restricting_at_least_one(Balanced(), 1), CandidateSelection(HighDensity(1.0), 0)):
        at = select_candidate(box, selection)
        rows = select_from(table, selection).collect()
        assert ([at] if at is not None else []) == [r["step"] for r in rows]
    for bad in (0, 1.1, math.nan):
        with pytest.raises(CandidateSelectionError):
            HighDensity(bad)
    assert box.limits_dataframe(spark).where("step = 0").count() == 3


def test_quasi_p_over_all_orders(spark, tmp_path):
    from fractions import Fraction
    from math import comb

    from vantage.plans.queries import QUERIES

    rows = [(k, 1, 1.0, "AB"[k % 2], "F" if k % 5 < 2 else "O") for k in range(700)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    p = Fraction(12, 25)
    want = {}
    for g in "AB":
        n, k = sum(r[3] == g for r in rows), sum(r[3] == g and r[4] == "F" for r in rows)
        want[g] = round(float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))), 7)
    got = {r["grp"]: r["p"] for r in QUERIES["quasi_p"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) <= 2e-7 for g in want)


def repeated(copies: int):
    """The mixed golden case with every row repeated, so it has 400 combinations of values."""
    import pandas as pd

    make, config, _ = GOLDEN["mixed_lenient1"]
    return pd.concat([make()] * copies, ignore_index=True), config


def test_search_in_memory_collects_equal_rows_once(spark):
    df, config = repeated(7)
    f = frame(spark, df)
    counts = LocalCounts.collect(f)
    assert len(counts.cases) == 400 and counts.totals() == (2800, int(df["case"].sum()))
    assert [(s.phase, s.statistics.points) for s in Prim(f, config, "local").find_box().trajectory] == [(p, len(rows)) for p, rows, _ in plain_search(df, config)]


def test_search_of_few_combinations_is_in_memory(spark, monkeypatch):
    monkeypatch.setattr("vantage.operators.search.LOCAL_CELLS", 5 * 600)
    df, config = repeated(7)
    f = frame(spark, df)
    auto, jobs = Prim(f, config), Prim(f, config, "distributed")
    assert isinstance(auto.counts, LocalCounts)
    a, b = auto.find_box(), jobs.find_box()
    assert a.trajectory == b.trajectory and len(a.limits_dataframe(spark).collect()) == 3 * len(a.trajectory)
    jobs.close()
    monkeypatch.setattr("vantage.operators.search.LOCAL_CELLS", 5 * 200)
    wide = Prim(f, config)
    assert isinstance(wide.counts, SparkCounts)
    wide.close()


def test_repeated_boxes_leave_nothing_cached(spark, tmp_path, monkeypatch):
    from vantage.plans.queries import QUERIES

    rows = [(float(k % 50), 900.0 * (k % 60), k % 11 / 100, k % 9 / 100, k % 7, "ANR"[k % 3], "FO"[k % 2]) for k in range(600)]  # no cases: one box
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    held = spark.sparkContext._jsc.getPersistentRDDs
    before = held().size()
    local = QUERIES["prim_repeated_boxes"](spark, str(tmp_path)).collect()
    monkeypatch.setattr("vantage.operators.search.LOCAL_CELLS", 1)
    assert QUERIES["prim_repeated_boxes"](spark, str(tmp_path)).collect() == local
    assert held().size() == before


@pytest.mark.parametrize("few", [0, 5, 10_000])
def test_peels_by_value_and_by_bracket_are_those_in_memory(spark, monkeypatch, few):
    monkeypatch.setattr("vantage.operators.search.FEW_VALUES", few)
    df, config = repeated(2)
    df["demand"] = df["demand"] % 4 + 0.5
    f = frame(spark, df)
    jobs, local = Prim(f, config, "distributed"), Prim(f, config, "local")
    assert jobs.counts.few == {0: set(), 5: {"demand"}, 10_000: {"capacity", "demand"}}[few]
    assert (jobs.counts.rows is not None) == (few == 10_000)
    whole = BoxStep(local.initial, BoxStatistics.of(800, local.cases, 800, local.cases, 0), (), "initial")
    assert jobs.peels(whole) == local.peels(whole)
    jobs.close()


def test_binomial_tail_of_many_rows():
    import tracemalloc

    tracemalloc.start()
    for n, k, p in ((4_000_000, 2_000_100, 0.5), (4_000_000, 700, 0.0002), (216_000_000, 86_400_000, 0.4), (216_000_000, 100, 0.4)):
        assert st.binomial_greater(k, n, p) + st.binomial_greater(n - k + 1, n, 1 - p) == pytest.approx(1, abs=1e-9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000
    n, k = 2000, 1100
    exact = sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
    assert st.binomial_greater(k, n, 0.5) == pytest.approx(exact, rel=1e-12)
