import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators.sampling import sample_uniform
from vantage.operators.search import Prim
from vantage.operators.table import EvaluationTable, pair
from vantage.plans.lake import INPUTS, Lake, LakeEvaluator, release, session

DEFAULTS = {"b": 0.42, "q": 2.0, "mean": 0.02, "stdev": 0.0, "delta": 0.98, "c1": 0.25, "c2": 0.25, "r1": 0.5, "r2": 0.5, "w1": 0.5}


def columns(**other):
    return {k: np.array([v]) for k, v in (DEFAULTS | other).items()}


def test_deterministic_trace():
    found, why = Lake(0.41, 1, 5).run(columns(), [42])
    assert why == [None]
    want = {"max_p": 0.12217678889441548, "utility": 0.10102459870651728, "inertia": 0.6, "reliability": 1.0}
    assert {k: v[0] for k, v in found.items()} == pytest.approx(want, abs=1e-14)


def test_release_is_bounded_and_errors_are_rows():
    x = {k: v[:, None] for k, v in columns().items()}
    assert release(np.array([[0.25]]), x)[0, 0] == 0.01 and release(np.array([[2.0]]), x)[0, 0] == 0.1
    assert Lake(0.41, 4, 12).run(columns(r1=0.0), [1])[1] == ["r1 must be greater than zero"]
    for name, value, said in (("c1", np.nan, "c1 must be finite"), ("stdev", -0.1, "stdev must not be negative"), ("delta", 1.5, "delta must be greater than zero and at most one"), ("delta", 0.0, "delta must be greater than zero and at most one"), ("w1", -0.5, "w1 must lie between zero and one")):
        assert Lake(0.41, 4, 12).run(columns(**{name: value}), [1])[1] == [said]
    same = [Lake(0.41, 4, 12).run(columns(stdev=0.001), [42])[0]["utility"][0] for _ in range(2)]
    assert same[0] == same[1]
    with pytest.raises(ValueError):
        Lake(years=1)


def test_search_over_lake_evaluations(spark):
    requests = sample_uniform(spark, session(), 600, 0x5EED1A6E, 0)
    results = LakeEvaluator(Lake(0.41, 10, 100)).evaluate(requests)
    odd = requests.where("row < 3").withColumn("inputs", F.col("inputs").withField("b", F.when(F.col("row") == 1, 0.9).otherwise(F.col("inputs.b"))))
    assert [r["outcome"]["kind"] for r in LakeEvaluator(Lake(0.41, 4, 12)).evaluate(odd).orderBy("row").collect()] == ["success", "input_out_of_domain", "success"]
    frame = EvaluationTable(session(), pair(requests.cache(), results.cache())).dataset(4)
    assert [f.name for f in frame.features] == list(INPUTS) and 0.05 < frame.case_count() / frame.row_count() < 0.3
    box = Prim(frame).find_box()
    assert box.final_step.statistics.density > 0.8
    assert {"b", "q"} <= set(box.final_step.limits.restricted(box.initial))
