import io
import math
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vantage.errors import (
    CaseConditionError,
    ChunkingPolicyError,
    DataError,
    EvaluationDatasetError,
    EvaluationDecodeError,
    EvaluationReadError,
    EvaluationTableError,
    EvaluationWriteError,
    EvaluatorPoolError,
    InputAccessError,
    ModelSchemaError,
    OutputPathError,
    RequestSplitError,
    SamplingError,
)
from vantage.functions import outcomes as oc
from vantage.functions import seeds
from vantage.functions.paths import OutputPath
from vantage.functions.rules import AT_MOST, BELOW, NOT_A_CASE, REJECT, CaseCondition, CaseRule
from vantage.operators.evaluate import ChunkingPolicy, EvaluatorFailure, EvaluatorPool, ExternalEvaluator, InProcessEvaluator, InputRow, ModelFailure, ParallelEvaluator, RowContext, chunk_result
from vantage.operators.frame import Feature, ScenarioFrame, categorical_from_dictionary, category_dictionary, encoded_as, features_of
from vantage.operators.requests import split
from vantage.operators.sampling import sample_latin_hypercube, sample_uniform
from vantage.operators.search import Prim, PrimConfig
from vantage.operators.table import EvaluationTable, key_label, pair
from vantage.schema import BOOL, COMPLEX, Axis, SchemaBuilder, SessionSchema, coordinate_label, datetime, describe, indexed, key, quantity, record, type_spelling, union
from vantage.sources import reports
from vantage.sources.store import ArrowStreamSource, EvaluationReader, EvaluationWriter, append_parquet, read_parquet, to_evaluation_table
from vantage.streaming.append import evaluate_stream

TOY = SchemaBuilder().continuous("load", 0, 1).categorical("regime", ["fragile", "stable"]).boolean_output("failure").build()
RICH = (
    SchemaBuilder()
    .continuous("x", 0.0, 1.0)
    .output("report", record("Report", cost=quantity("Mass", "kg"), latency=union("Latency", Available={"p90": quantity("Time", "s")}, Pending={}), checks=indexed(BOOL, Axis("Check", ("First", "Second"))), grade=key(Axis("Grade", ("Good", "Bad")))))
    .output("z", COMPLEX)
    .output("at", datetime("TAI"))
    .build()
)


def toy(row, context):
    return [row.quantity("load") >= 0.7 and row.key("regime") == "fragile"]


def rich(row, context):
    x = row.quantity("x")
    latency = {"_tag": "Available", "Available": {"p90": 3600 * x}} if x >= 0.5 else {"_tag": "Pending", "Available": None}
    return [{"cost": 10 * x, "latency": latency, "checks": [x > 0.2, x > 0.8], "grade": "Good" if x < 0.6 else "Bad"}, {"re": x, "im": -x}, 1e8 + x]


# ---------------------------------------------------------------- features


def test_frame_checks_in_order(spark):
    df = spark.createDataFrame([(0, 0.0, "a", True), (1, float("nan"), " ", False)], "row_id long, x double, c string, case boolean")
    with pytest.raises(DataError) as e:
        ScenarioFrame(df, [])
    assert e.value.variant == "NoFeatures"
    with pytest.raises(DataError) as e:
        ScenarioFrame(df.limit(0), [Feature.continuous("x")])
    assert e.value.variant == "NoOutcomes"
    with pytest.raises(DataError) as e:
        ScenarioFrame(df, [Feature.continuous("x"), Feature.continuous("x")], row_id="row_id")
    assert e.value.variant == "DuplicateFeatureName"
    with pytest.raises(DataError) as e:
        ScenarioFrame(df, [Feature.continuous("x")], row_id="row_id")
    assert (e.value.variant, e.value.row) == ("NonFiniteValue", 1)
    with pytest.raises(DataError) as e:
        ScenarioFrame(df, [Feature.categorical("c")], row_id="row_id")
    assert (e.value.variant, e.value.row) == ("EmptyCategoryValue", 1)
    with pytest.raises(DataError):
        Feature.continuous(" ")
    good = ScenarioFrame(df.limit(1), [Feature.continuous("x"), Feature.categorical("c")], row_id="row_id")
    assert (good.row_count(), good.case_count(), good.kind("c"), good.categories("c"), good.categories("x")) == (1, 1, "categorical", ["a"], None)
    assert good.view("x", "integer") is None and good.view("x").columns == ["x"]
    assert [f.kind for f in features_of(df, ["row_id", "x", "c"])] == ["integer", "continuous", "categorical"]


def test_dictionaries(spark):
    df = spark.createDataFrame([(0, "zeta"), (1, "alpha"), (2, "zeta")], "row_id long, mode string")
    codes = category_dictionary(df, "mode")
    assert {r["category"]: r["code"] for r in codes.collect()} == {"alpha": 0, "zeta": 1}
    assert [r["code"] for r in encoded_as(df, "mode", codes).orderBy("row_id").collect()] == [1, 0, 1]
    foreign = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "row_id long, code int")
    assert [r["mode"] for r in categorical_from_dictionary(foreign, "code", ["zeta", "alpha"], "mode").orderBy("row_id").collect()] == ["zeta", "alpha", "zeta"]
    with pytest.raises(DataError) as e:
        categorical_from_dictionary(spark.createDataFrame([(0, 0), (7, 2)], "row_id long, code int"), "code", ["a", "b"], "mode")
    assert (e.value.variant, e.value.row) == ("InvalidCategoryCode", 7)
    assert [coordinate_label(x) for x in (0.0, 0.5, 1e21, 1e-7)] == ["0", "0.5", "1000000000000000000000", "0.0000001"]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.5,), (1e-7,)], "x double").select(key_label(F.col("x"))).collect()] == ["0", "0.5", "0.0000001"]


# ---------------------------------------------------------------- schema and paths


def test_schema_round_trip_and_errors():
    assert SessionSchema.from_json(RICH.to_json()) == RICH
    assert SessionSchema.from_storage_type(RICH.storage_type()) == RICH
    assert "Mass in kg" in describe(RICH) and type_spelling(COMPLEX).startswith("Complex")
    for wrong, variant in (
        (lambda: SchemaBuilder().continuous("x", 1, 0), "InvalidBounds"),
        (lambda: SchemaBuilder().continuous("x", 0, math.inf), "NonFiniteBound"),
        (lambda: SchemaBuilder().categorical("m", ["a", "a"]), "InvalidKey"),
        (lambda: SchemaBuilder().boolean("1x"), "Label"),
        (lambda: SchemaBuilder().boolean("x").build(), "Interface"),
        (lambda: SchemaBuilder().boolean("x").boolean("x").boolean_output("y").build(), "Session"),
    ):
        with pytest.raises(ModelSchemaError) as e:
            wrong()
        assert e.value.variant == variant
    SchemaBuilder().continuous("x", 1, 1).quantity("y", "Mass", low=0.0)
    with pytest.raises(EvaluationDecodeError) as e:
        SessionSchema.from_metadata(9, RICH.to_json())
    assert e.value.variant == "FormatVersion"


def test_paths():
    p = lambda text: OutputPath.parse(RICH, text)
    assert p("report.latency.Available.p90").target == quantity("Time", "s")
    assert p("report.latency.Pending").target == BOOL and str(p("report.checks.Second")) == "report.checks.Second"
    for text, variant in (("nothing", "UnknownOutput"), ("report.price", "UnknownField"), ("report.latency.Gone", "UnknownVariant"), ("report.latency.p90", "FieldOfUnion"), ("report.checks.Third", "UnknownKey"), ("report.cost.x", "NotSelectable")):
        with pytest.raises(OutputPathError) as e:
            p(text)
        assert e.value.variant == variant
    assert p("report.cost").belongs_to(RICH) and not p("report.cost").belongs_to(TOY)
    with pytest.raises(CaseConditionError) as e:
        CaseCondition.at(p("report.grade"), CaseRule.key_in("Fair"), REJECT)
    assert e.value.variant == "InapplicableRule"
    with pytest.raises(CaseConditionError):
        CaseCondition.all()


# ---------------------------------------------------------------- seeds, samples, requests


def test_seed_vectors(spark):
    assert seeds.derive_seed(42, 7, 11) == 0x9D3B18701655846F
    assert seeds.derive_seed(42, 3, seeds.MODEL_DOMAIN) == 0x5027A070F5ED0CD9
    assert RowContext(b"", 5, 2).seed == seeds.derive_seed(5, 2, seeds.ROW_DOMAIN)
    got = spark.range(5).select(seeds.seed_column(F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"), F.col("id"), 3)).collect()
    assert [int(r[0]) for r in got] == [seeds.derive_seed((1 << 64) - 1, k, 3) for k in range(5)]


def test_samples(spark):
    mixed = SchemaBuilder().continuous("x", -1, 1).integer("count", -2, 2).categorical("mode", ["risky", "safe"]).boolean("on").boolean_output("failure").build()
    rows = sample_latin_hypercube(spark, mixed, 10, 42, 3).orderBy("row").collect()
    assert {bytes(r["evaluation_id"]) for r in rows} == {((42 << 64) | 3).to_bytes(16, "big")} and {int(r["seed"]) for r in rows} == {0x5027A070F5ED0CD9}
    inputs = [r["inputs"] for r in rows]
    assert sorted(int((i["x"] + 1) * 5) for i in inputs) == list(range(10))
    assert sorted(i["count"] for i in inputs) == [-2, -2, -1, -1, 0, 0, 1, 1, 2, 2]
    assert sum(i["mode"] == "safe" for i in inputs) == 5 and sum(i["on"] for i in inputs) == 5
    again = sample_latin_hypercube(spark, mixed, 10, 42, 3).repartition(7).orderBy("row").collect()
    assert again == rows
    uniform = sample_uniform(spark, mixed, 2000, 1, 0)
    assert int(uniform.first()["seed"]) == seeds.derive_seed(1, 0, seeds.MODEL_DOMAIN)
    mean, low, high, safe = uniform.agg(F.avg("inputs.x"), F.min("inputs.count"), F.max("inputs.count"), F.avg((F.col("inputs.mode") == "safe").cast("int"))).first()
    assert abs(mean) < 0.06 and (low, high) == (-2, 2) and abs(safe - 0.5) < 0.05
    whole = SchemaBuilder().integer("value", -(1 << 63), (1 << 63) - 1).boolean_output("y").build()
    assert sample_latin_hypercube(spark, whole, 5, 1, 1).select("inputs.value").distinct().count() == 5
    single = SchemaBuilder().continuous("x", 0.5, 0.5).integer("n", 7, 7).categorical("m", ["only"]).boolean_output("y").build()
    assert {tuple(r) for r in sample_uniform(spark, single, 4, 1, 1).select("inputs.*").collect()} == {(0.5, 7, "only")}
    for session, rows, variant in ((mixed, 0, "NoRows"), (SchemaBuilder().quantity("x", "Mass", 0.0).boolean_output("y").build(), 5, "UnboundedInput"), (SchemaBuilder().continuous("x", -1.7e308, 1.7e308).boolean_output("y").build(), 5, "UnsampleableDomain"), (SchemaBuilder().input("z", COMPLEX).boolean_output("y").build(), 5, "UnsupportedInput")):
        with pytest.raises(SamplingError) as e:
            sample_uniform(spark, session, rows, 1, 1)
        assert e.value.variant == variant


def test_split(spark):
    request = sample_uniform(spark, TOY, 7, 42, 5)
    parts = split(request, 3).orderBy("evaluation_id", "row").collect()
    assert [(bytes(r["evaluation_id"]).hex()[-2:], r["row"]) for r in parts] == [("05", 0), ("05", 1), ("05", 2), ("06", 0), ("06", 1), ("06", 2), ("07", 0)]
    assert [p["inputs"] for p in parts] == [r["inputs"] for r in request.orderBy("row").collect()]
    assert int(parts[3]["seed"]) == seeds.derive_seed(int(request.first()["seed"]), 1, seeds.SPLIT_DOMAIN)
    with pytest.raises(RequestSplitError):
        split(sample_uniform(spark, TOY, 7, 42, (1 << 64) - 2), 3)
    assert split(request.limit(0), 3).count() == 0


# ---------------------------------------------------------------- evaluation


def test_every_outcome(spark):
    session = SchemaBuilder().integer("x", 0, 8).boolean_output("even").build()

    def model(row, context):
        x = row.int("x")
        if x == 1:
            raise ModelFailure("odd")
        if x == 2:
            raise ModelFailure("too much", assertion="limit")
        if x == 3:
            raise RuntimeError("broken")
        if x == 4:
            raise RuntimeError(17)
        if x == 5:
            return [True, False]
        if x == 6:
            return ["yes"]
        if x == 7:
            row.quantity("x")
        return [x % 2 == 0]

    inputs = [(bytes(16), k, 1, (k,)) for k in range(10)]
    requests = spark.createDataFrame(inputs, "evaluation_id binary, row long, seed long, inputs struct<x:bigint>").withColumn("seed", F.col("seed").cast("decimal(20,0)"))
    results = InProcessEvaluator(session, model).evaluate(requests).orderBy("row").collect()
    assert [r["outcome"]["kind"] for r in results] == [oc.SUCCESS, oc.EVALUATION_ERROR, oc.ASSERTION_FAILED, oc.PANIC, oc.NON_STRING_PANIC, oc.OUTPUT_COUNT_MISMATCH, oc.OUTPUT_KIND_MISMATCH, oc.EVALUATION_ERROR, oc.SUCCESS, oc.INPUT_OUT_OF_DOMAIN]
    assert results[9]["outcome"]["message"] == "value 9 lies outside [0, 8]" and results[2]["outcome"]["subject"] == "limit"
    assert [r["outputs"] is not None for r in results] == [r["outcome"]["kind"] == oc.SUCCESS for r in results]
    parallel = ParallelEvaluator(session, model, ChunkingPolicy(3)).evaluate(requests).orderBy("row").collect()
    assert parallel == results
    said = spark.createDataFrame(results, session.result_type()).select(oc.message_of(F.col("outcome")).alias("m")).collect()
    assert [s["m"] is None for s in said] == [r["outcome"]["kind"] == oc.SUCCESS for r in results]
    foreign = InProcessEvaluator(TOY, toy).evaluate(requests).collect()
    assert {r["outcome"]["kind"] for r in foreign} == {oc.INVALID_INPUT}
    with pytest.raises(ChunkingPolicyError):
        ChunkingPolicy(0)
    with pytest.raises(InputAccessError) as e:
        InputRow(session, {"x": 1}).int("y")
    assert e.value.variant == "UnknownSlot"
    with pytest.raises(Exception):
        chunk_result([])


def test_pool(spark):
    requests = [sample_uniform(spark, TOY, 10, 9, k) for k in range(4)]
    got = []
    pool = EvaluatorPool([ParallelEvaluator(TOY, toy), InProcessEvaluator(TOY, toy)])
    report = pool.evaluate(requests, lambda r: got.extend(r.collect()))
    assert [s for _, s, _ in report] == ["evaluated"] * 4 and len(got) == 40 and pool.running_count == pool.evaluator_count == 2

    class Broken:
        session = TOY

        def evaluate(self, requests):
            raise OSError("gone")

    report = EvaluatorPool([Broken()]).evaluate(requests, got.append)
    assert [s for _, s, _ in report] == ["panic", "not_evaluated", "not_evaluated", "not_evaluated"]

    class Failing(Broken):
        def __init__(self, what):
            self.what = what

        def evaluate(self, requests):
            if isinstance(self.what, Exception):
                raise self.what
            return self.what

    for what, variant in ((EvaluatorFailure("gone"), "Evaluator"), (OSError("gone"), "Panic"), (None, "MissingResult"), (requests[0].sparkSession.createDataFrame([], TOY.result_type()), "MissingResult")):
        pool = EvaluatorPool([Failing(what)])
        items = list(pool.results(requests[:2]))
        assert [i.error.variant for i in items] == [variant, "NotEvaluated"] and [i.error.position for i in items] == [0, 1]
        assert pool.running_count == 0 and [i.error.variant for i in pool.results(requests[:1])] == ["NotEvaluated"]
    # one evaluator that fails leaves the requests to the others
    pool = EvaluatorPool([Failing(EvaluatorFailure("gone")), InProcessEvaluator(TOY, toy)])
    items = list(pool.results(requests))
    assert sum(i.error is None for i in items) >= 3 and pool.running_count in (1, 2)
    with pytest.raises(EvaluatorPoolError):
        EvaluatorPool([])
    with pytest.raises(EvaluatorPoolError):
        EvaluatorPool([InProcessEvaluator(TOY, toy), InProcessEvaluator(RICH, rich)])

    def serve():
        kind = TOY.result_type()

        def send(batch):
            from pyspark.sql.pandas.types import to_arrow_schema

            n = len(batch)
            arrow = to_arrow_schema(kind)
            return pa.record_batch([batch.column("evaluation_id"), batch.column("row"), pa.array([{"failure": True}] * n, arrow.field("outputs").type), pa.array([oc.outcome(oc.SUCCESS)] * n, arrow.field("outcome").type)], names=arrow.names)

        return send

    assert ExternalEvaluator(TOY, serve).evaluate(requests[0]).where("outputs.failure").count() == 10


def slow_toy(row, context):
    import time

    time.sleep(0.6)
    return toy(row, context)


def test_pool_works_side_by_side_and_stops_early(spark):
    requests = [sample_uniform(spark, TOY, 4, 9, k) for k in range(6)]
    pool = EvaluatorPool([InProcessEvaluator(TOY, slow_toy) for _ in range(3)])
    pool.evaluate(requests[:3], lambda r: None)
    began = time.time()
    report = pool.evaluate(requests[:3], lambda r: r.count())
    assert [s for _, s, _ in report] == ["evaluated"] * 3 and time.time() - began < 3 * 4 * 0.6
    with pool.results(requests) as items:
        first = next(items)
        assert first.error is None and first.results.count() == 4
    assert not items._waiting and pool.running_count == 3  # waiting requests are dropped, evaluators are free
    assert sum(i.error is None for i in pool.results(requests[:2])) == 2


def test_one_message_for_a_violation(spark):
    from vantage.operators.evaluate import out_of_domain

    session = SchemaBuilder().continuous("x", 0.0, 1e-9).boolean_output("y").build()
    values = [-0.5, 1e7, 12345678.9, 1.5e16, 2e-5, 0.00012, 123456789012.125, -1e300, 7.0, 1e22, 0.1]
    df = spark.createDataFrame([((v,),) for v in values], "inputs struct<x:double>")
    got = [r["m"] for r in df.select(oc.domain_violation(session, F.col("inputs"))["message"].alias("m")).collect()]
    assert got == [out_of_domain(session, {"x": v})["message"] for v in values]


def evaluated(spark, session, model, rows=200, seed=0x5EED, sequence=0, sample=sample_uniform):
    requests = sample(spark, session, rows, seed, sequence)
    return pair(requests, InProcessEvaluator(session, model).evaluate(requests))


def test_table_pairing_and_order(spark):
    one, two = (evaluated(spark, TOY, toy, 20, 7, k) for k in (2, 1))
    table = EvaluationTable(TOY, spark=spark).push_evaluated(one).push_evaluated(two)
    assert table.row_count() == 40 and not table.is_empty()
    ids = lambda t: [bytes(r[0]).hex()[-1] for r in t.df.select("evaluation_id", "ordinal").distinct().orderBy("ordinal").collect()]
    assert ids(table) == ["2", "1"] and ids(table.sort_by_id()) == ["1", "2"]
    with pytest.raises(EvaluationTableError) as e:
        table.push_evaluated(two)
    assert e.value.variant == "DuplicateId"
    requests = sample_uniform(spark, TOY, 5, 1, 1)
    results = InProcessEvaluator(TOY, toy).evaluate(requests)
    with pytest.raises(EvaluationTableError) as e:
        pair(requests, results.where("row < 4"))
    assert e.value.variant == "RowCountMismatch"
    with pytest.raises(EvaluationTableError) as e:
        pair(requests, InProcessEvaluator(TOY, toy).evaluate(sample_uniform(spark, TOY, 5, 1, 2)))
    assert e.value.variant == "MismatchedId"
    with pytest.raises(EvaluationTableError) as e:
        table.push_evaluated(evaluated(spark, RICH, rich, 3))
    assert e.value.variant == "InvalidInputs"
    assert table.outcome_counts().collect()[0]["rows"] == 40


def test_classification_and_errors(spark):
    table = EvaluationTable(RICH, evaluated(spark, RICH, rich))
    path = lambda text: OutputPath.parse(RICH, text)
    fast = CaseCondition.at(path("report.latency.Available.p90"), CaseRule.quantity(AT_MOST, 2700.0), NOT_A_CASE)
    good = CaseCondition.at(path("report.grade"), CaseRule.key_in("Good"), REJECT)
    counts = table.cases_matching(CaseCondition.all(fast, good)).select("case", F.col("inputs.x").alias("x")).collect()
    assert all(r["case"] == (0.5 <= r["x"] <= 0.75 and r["x"] < 0.6) for r in counts)
    assert all(r["case"] == (not 0.5 <= r["x"] <= 0.75) for r in table.cases_matching(~fast).select("case", F.col("inputs.x").alias("x")).collect())
    must = CaseCondition.at(path("report.latency.Available.p90"), CaseRule.quantity(BELOW, 1.0), REJECT)
    with pytest.raises(EvaluationDatasetError) as e:
        table.cases_matching(CaseCondition.any(good, must))
    first = next(r["row"] for r in table.ordered().select("row", "inputs.x").collect() if r["x"] < 0.5)
    assert (e.value.variant, e.value.row) == ("Condition", first)
    for wrong, variant in ((lambda: table.cases(3), "OutputSlotOutOfBounds"), (lambda: table.cases(0), "InapplicableRule"), (lambda: EvaluationTable(TOY, evaluated(spark, TOY, toy, 3)).cases_matching(good), "ForeignPath")):
        with pytest.raises(EvaluationDatasetError) as e:
            wrong()
        assert e.value.variant == variant

    def picky(row, context):
        if row.quantity("load") > 0.5:
            raise ModelFailure("no")
        return [True]

    failing = EvaluationTable(TOY, evaluated(spark, TOY, picky, 50))
    with pytest.raises(EvaluationDatasetError) as e:
        failing.dataset(0)
    assert e.value.variant == "FailedRow" and e.value.row == failing.df.where("outcome.kind <> 'success'").agg(F.min("row")).first()[0]
    assert failing.df.select(*(c.alias(f.name) for f, c in failing.features())).count() == 50
    unsupported = SchemaBuilder().input("z", COMPLEX).boolean_output("y").build()
    with pytest.raises(DataError) as e:
        EvaluationTable(unsupported, spark=spark).features()
    assert e.value.variant == "UnsupportedFeature"


def test_workflow_recovers_the_region(spark):
    frame = EvaluationTable(TOY, evaluated(spark, TOY, toy, 5000)).dataset(0)
    s = (box := Prim(frame, PrimConfig()).find_box()).final_step.statistics
    assert s.density >= 0.99 and s.coverage >= 0.9
    assert 0.69 <= box.final_step.limits["load"].lower <= 0.72 and box.final_step.limits["regime"].values == {"fragile"}


# ---------------------------------------------------------------- storage


def test_arrow_stream_round_trip_and_recovery(spark, tmp_path):
    parts = [evaluated(spark, RICH, rich, n, 7, k) for k, n in ((5, 2), (6, 3))]
    path = tmp_path / "run.arrows"
    with open(path, "wb") as sink:
        writer = EvaluationWriter(sink, RICH)
        sizes = []
        for p in parts:
            writer.write(p)
            sizes.append(sink.tell())
        writer.finish()
        with pytest.raises(EvaluationWriteError):
            EvaluationWriter(io.BytesIO(), RICH).write(evaluated(spark, TOY, toy, 2))
    whole = path.read_bytes()
    reader = EvaluationReader(io.BytesIO(whole))
    assert reader.session == RICH
    back = to_evaluation_table(spark, RICH, reader.read_table())
    want = sorted((r for p in parts for r in p.collect()), key=lambda r: (r["evaluation_id"], r["row"]))
    assert sorted(back.df.drop("ordinal").collect(), key=lambda r: (r["evaluation_id"], r["row"])) == want
    for cut in (sizes[0] + 40, sizes[1] - 5):
        with pytest.raises(EvaluationReadError):
            EvaluationReader(io.BytesIO(whole[:cut])).read_table()
        found = EvaluationReader(io.BytesIO(whole[:cut])).recover_table()
        assert [len(t) for t in found.table] == [2] and found.stopped_by
    spark.dataSource.register(ArrowStreamSource)
    assert spark.read.format("evaluation_stream").option("paths", str(path)).load().count() == 5
    short = tmp_path / "short.arrows"
    short.write_bytes(whole[: sizes[1] - 5])
    assert spark.read.format("evaluation_stream").option("paths", f"{path},{short}").option("mode", "PERMISSIVE").load().count() == 7


def test_stream_decoding_errors(spark):
    from vantage.sources.store import arrow_schema

    good = evaluated(spark, TOY, toy, 4, 1, 1).orderBy("row").toArrow().cast(arrow_schema(TOY))

    def read(*batches, schema=None):
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, schema or good.schema) as w:
            for b in batches:
                w.write_table(b)
        return EvaluationReader(io.BytesIO(sink.getvalue())).read_table()

    assert [len(t) for t in read(good.slice(0, 2), good.slice(0, 0), good.slice(2))] == [4]
    for wrong, variant in ((good.slice(1), "RowOrder"), (good.set_column(2, "seed", pa.array([1, 1, 2, 1], pa.decimal128(20, 0))).cast(good.schema), "SeedMismatch")):
        with pytest.raises(EvaluationDecodeError) as e:
            read(wrong)
        assert e.value.variant == variant
    with pytest.raises(EvaluationDecodeError) as e:
        read(good, schema=good.schema.remove_metadata())
    assert e.value.variant == "LayoutMetadata"
    odd = good.to_pylist()
    odd[1]["outcome"]["kind"] = "lost"
    with pytest.raises(EvaluationDecodeError) as e:
        read(pa.Table.from_pylist(odd, good.schema))
    assert e.value.variant == "UnknownOutcome"


def test_parquet_append_and_checks(spark, tmp_path):
    path = str(tmp_path / "table")
    one, two = (evaluated(spark, RICH, rich, 5, 3, k) for k in (1, 2))
    append_parquet(one, path, RICH)
    append_parquet(two, path, RICH)
    with pytest.raises(EvaluationTableError):
        append_parquet(two, path, RICH)
    back = read_parquet(spark, path)
    assert back.session == RICH and back.row_count() == 10
    bad = str(tmp_path / "bad")
    append_parquet(one.where("row <> 2"), bad, RICH)
    with pytest.raises(EvaluationDecodeError) as e:
        read_parquet(spark, bad)
    assert e.value.variant == "RowOrder"


def test_streaming_append_is_idempotent(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("requests", "out", "check"))
    sample_uniform(spark, TOY, 10, 1, 1).write.parquet(source)
    evaluate_stream(spark, TOY, source, ParallelEvaluator(TOY, toy), path, check).awaitTermination()
    sample_uniform(spark, TOY, 10, 1, 2).write.mode("append").parquet(source)
    evaluate_stream(spark, TOY, source, ParallelEvaluator(TOY, toy), path, check).awaitTermination()
    evaluate_stream(spark, TOY, source, ParallelEvaluator(TOY, toy), path, str(tmp_path / "fresh")).awaitTermination()
    assert spark.read.parquet(path).count() == 20


def test_reports(spark, tmp_path):
    frame = EvaluationTable(TOY, evaluated(spark, TOY, lambda row, c: [row.quantity("load") >= 0.7], 400)).dataset(0)
    numbered = ScenarioFrame(frame.df.withColumn("row_id", F.col("row_id.row")), [Feature.continuous("load")], row_id="row_id")
    box = Prim(numbered, PrimConfig()).find_box()
    files = {"trajectory": reports.trajectory_table(spark, box), "limits": reports.limits_table(spark, box), "experiments": reports.experiments_table(numbered)}
    for name, df in files.items():
        reports.write_csv(df, str(tmp_path / name))
    trajectory = reports.read_trajectory(spark, str(tmp_path / "trajectory"))
    limits = reports.read_csv(spark, str(tmp_path / "limits"), reports.LIMITS)
    experiments = reports.read_csv(spark, str(tmp_path / "experiments"), "row_index long, load double, case_of_interest boolean")
    last = reports.select_step(trajectory)
    assert last == len(box.trajectory) - 1
    reports.validate_membership(experiments, limits, trajectory, last)
    assert reports.restricted_feature_limits(limits, trajectory, last).count() == 1
    shares = reports.normalized_limits(limits).where(F.col("step") == last).first()
    assert 0.6 < shares["lower_share"] < 0.8
    assert reports.padded(limits).first()["axis_lower"] < limits.first()["domain_lower"]
    assert reports.tradeoff(trajectory).count() == last + 1
    assert reports.box_from_table(limits, last).get("load").lower == box.final_step.limits["load"].lower
    assert reports.restrictions_text(box.final_step.limits, box.initial)
    with pytest.raises(Exception):
        reports.select_step(trajectory, last + 1)
    with pytest.raises(Exception):
        reports.validate_membership(experiments.limit(10), limits, trajectory, last)
