"""Driver queries of the scenario-discovery engine, and the DuckDB SQL that gives the same rows.

Base relation: lineitem with continuous l_quantity, l_extendedprice, l_discount, l_tax, integer l_linenumber, categorical
l_returnflag, l_linestatus; a case has a discounted price of 60,000 at least.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.functions import outcomes as oc
from vantage.functions import seeds
from vantage.functions import statistics as st
from vantage.functions.paths import OutputPath
from vantage.functions.quantile import Ask, quantile_sql, quantiles
from vantage.functions.rules import ABOVE, AT_LEAST, AT_MOST, BELOW, NOT_A_CASE, CaseCondition, CaseRule
from vantage.operators.boxes import CATEGORICAL, BoxLimits, Categories, Range
from vantage.operators.effects import effects_dataframe, restriction_effects
from vantage.operators.frame import CASE, Feature, ScenarioFrame, category_dictionary, decoded
from vantage.operators.requests import split
from vantage.operators.sampling import sample_latin_hypercube, sample_uniform
from vantage.operators.search import BoxStatistics, BoxStep, Candidate, Prim, PrimBox, PrimConfig, best_of, relaxed_boxes
from vantage.operators.selection import Balanced, CandidateSelection, HighDensity, select_from
from vantage.operators.table import EvaluationTable, duplicate_ids, key_label, missing_results, pair
from vantage.schema import BOOL, SchemaBuilder, SessionSchema, datetime, indexed, key, quantity, record, union, Axis
from vantage.sources.reports import normalized_limits, tradeoff

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CONTINUOUS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
FEATURES = [*map(Feature.continuous, CONTINUOUS), Feature.integer("l_linenumber"), Feature.categorical("l_returnflag"), Feature.categorical("l_linestatus")]
NAMES = [f.name for f in FEATURES]
EXP = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus, l_extendedprice * (1 - l_discount) >= CAST(60000 AS DOUBLE) AS is_case FROM lineitem) AS exp"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def experiments(spark: SparkSession, sf: str) -> ScenarioFrame:
    rows = table(spark, sf, "lineitem").withColumn(CASE, F.col("l_extendedprice") * (1 - F.col("l_discount")) >= 60000.0)
    return ScenarioFrame(rows, FEATURES)


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


#: A box that several queries use.
BOX = {"l_quantity": (20.0, 50.0), "l_extendedprice": (50000.0, 95000.0), "l_linenumber": (2, 5), "l_returnflag": ("A", "R")}


def fixed_box(initial: BoxLimits) -> BoxLimits:
    out = initial
    for name, value in BOX.items():
        own = initial[name]
        out = out.with_restriction(name, Categories(frozenset(value)) if own.kind == CATEGORICAL else Range(own.kind, *value))
    return out


def box_sql(box: dict = BOX) -> str:
    parts = []
    for name, value in box.items():
        if isinstance(value[0], str):
            parts.append(f"{name} IN ({', '.join(repr(v) for v in value)})")
        else:
            parts.append(f"{name} BETWEEN {d(float(value[0]))} AND {d(float(value[1]))}")
    return " AND ".join(parts)


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- datasets


@query("dataset_summary", f"SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (is_case)::BIGINT AS n_cases FROM {EXP}")
def dataset_summary(spark, sf):
    return experiments(spark, sf).df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(CASE).alias("n_cases"))


@query(
    "initial_limits",
    " UNION ALL ".join(f"SELECT '{n}' AS feature, min({n})::DOUBLE + 0 AS lower, max({n})::DOUBLE AS upper, NULL AS categories FROM {EXP}" for n in NAMES[:5])
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{n}', NULL, NULL, string_agg(DISTINCT {n}, ',' ORDER BY {n}) FROM {EXP}" for n in NAMES[5:]),
)
def initial_limits(spark, sf):
    limits = experiments(spark, sf).initial_limits()
    return rows_of(spark, [(n, lo, hi, ",".join(c) if c else None) for n, _, lo, hi, c in limits.as_rows()], "feature string, lower double, upper double, categories string")


@query("category_dictionary", "SELECT p_type AS category, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS code FROM (SELECT DISTINCT p_type FROM part)")
def q_dictionary(spark, sf):
    return category_dictionary(table(spark, sf, "part"), "p_type")


@query(
    "category_decode",
    "WITH dict AS (SELECT p_type AS category, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)) "
    "SELECT p_partkey, p_size, category FROM part LEFT JOIN dict ON code = p_size",
)
def category_decode(spark, sf):
    part = table(spark, sf, "part")
    return decoded(part.select("p_partkey", "p_size"), "p_size", category_dictionary(part, "p_type"))


_ODD = "CASE WHEN value < 10 THEN CAST('NaN' AS DOUBLE) WHEN value > 100 THEN CAST('Infinity' AS DOUBLE) ELSE value END"


@query(
    "nonfinite_rows",
    f"SELECT 0 AS position, 'x' AS feature, count(*)::BIGINT AS n, min(event_id)::BIGINT AS row, CASE WHEN isnan(arg_min(x, event_id)) THEN 'NaN' ELSE 'Infinity' END AS value "
    f"FROM (SELECT event_id, {_ODD} AS x FROM events) AS e WHERE x IS NULL OR isnan(x) OR isinf(x)",
)
def nonfinite_rows(spark, sf):
    """What a frame's check finds in a continuous feature that has some."""
    odd = table(spark, sf, "events").select(F.col("event_id").cast("long"), F.expr(_ODD).alias("x"), F.lit(True).alias(CASE))
    return ScenarioFrame(odd, [Feature.continuous("x")], row_id="event_id", check=False).faults().where("n > 0")


@query("blank_categories", "SELECT 'o_orderstatus' AS feature, count(*) FILTER (s IS NULL OR trim(s) = '')::BIGINT AS n, min(o_orderkey) FILTER (s IS NULL OR trim(s) = '')::BIGINT AS row FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS s FROM orders) AS o")
def blank_categories(spark, sf):
    """What a frame's check finds in a categorical feature with blanks."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.lit(True).alias(CASE))
    return ScenarioFrame(rows, [Feature.categorical("o_orderstatus")], row_id="o_orderkey", check=False).faults().where("position = 0").select("feature", "n", "row")


@query("rows_in_box", f"SELECT l_quantity, l_extendedprice, l_linenumber, l_returnflag, is_case FROM {EXP} WHERE {box_sql()}")
def rows_in_box(spark, sf):
    f = experiments(spark, sf)
    box = BoxLimits(tuple((n, Categories(frozenset(v)) if isinstance(v[0], str) else Range(f.kind(n), *v)) for n, v in BOX.items()))
    return f.rows_in_box(box).select("l_quantity", "l_extendedprice", "l_linenumber", "l_returnflag", F.col(CASE).alias("is_case"))


@query(
    "box_statistics",
    f"SELECT k / greatest(kk, 1) AS coverage, k / n AS density, n / nn AS mass, n AS points, k AS cases FROM (SELECT count(*) FILTER ({box_sql()}) AS n, count(*) FILTER (is_case AND {box_sql()}) AS k, count(*) AS nn, count(*) FILTER (is_case) AS kk FROM {EXP}) AS s",
)
def box_statistics(spark, sf):
    f = experiments(spark, sf)
    box = BoxLimits(tuple((n, Categories(frozenset(v)) if isinstance(v[0], str) else Range(f.kind(n), *v)) for n, v in BOX.items())).column()
    n, k, rows, cases = f.df.agg(F.count_if(box), F.count_if(box & F.col(CASE)), F.count(F.lit(1)), F.count_if(CASE)).first()
    s = BoxStatistics.of(n, k, rows, cases, len(BOX))
    return rows_of(spark, [(s.coverage, s.density, s.mass, n, k)], "coverage double, density double, mass double, points long, cases long")


# ---------------------------------------------------------------- quantiles and candidates


def _bounds_sql(names, alpha=0.05, truncate=False) -> str:
    cast = (lambda e: f"CAST(trunc({e}) AS BIGINT)") if truncate else (lambda e: e)
    return " UNION ALL ".join(f"SELECT '{n}' AS feature, {cast(quantile_sql(EXP, n, 1 - alpha))} AS upper, {cast(quantile_sql(EXP, n, alpha))} AS lower" for n in names)


@query("quantile_peel_bounds", _bounds_sql(CONTINUOUS))
def quantile_peel_bounds(spark, sf):
    f = experiments(spark, sf)
    n = f.df.count()
    found = quantiles(f.df, [Ask(F.col(c), F.lit(True), n, p) for c in CONTINUOUS for p in (0.95, 0.05)])
    return rows_of(spark, [(c, found[2 * k], found[2 * k + 1]) for k, c in enumerate(CONTINUOUS)], "feature string, upper double, lower double")


@query("integer_quantile_bounds", _bounds_sql(["l_linenumber"], truncate=True))
def integer_quantile_bounds(spark, sf):
    f = experiments(spark, sf)
    n = f.df.count()
    upper, lower = quantiles(f.df, [Ask(F.col("l_linenumber"), F.lit(True), n, p) for p in (0.95, 0.05)])
    return rows_of(spark, [("l_linenumber", int(upper), int(lower))], "feature string, upper long, lower long")


def _candidates(spark, sf, names: list[str], paste: bool = False) -> DataFrame:
    """Peels of the whole frame, or pastes of the fixed box, for some features."""
    whole = experiments(spark, sf)
    f = ScenarioFrame(whole.df, [x for x in whole.features if x.name in names or paste], check=False)
    prim = Prim(f, PrimConfig(), "distributed")
    limits = fixed_box(prim.initial) if paste else prim.initial
    points, cases = prim.counts.tally([limits])[0] if paste else (prim.rows, prim.cases)
    current = BoxStep(limits, BoxStatistics.of(points, cases, prim.rows, prim.cases, 0), (), "initial")
    found = prim.pastes(current) if paste else prim.peels(current)
    prim.close()
    rows = []
    for c in found:
        for n in names:
            r = c.limits[n]
            if r != current.limits[n]:
                lower, upper, left = (None, None, ",".join(sorted(r.values))) if r.kind == CATEGORICAL else (float(r.lower) + 0.0, float(r.upper) + 0.0, None)
                rows.append((n, lower, upper, left, c.points, c.cases))
    return rows_of(spark, rows, "feature string, lower double, upper double, categories string, points long, cases long")


def _count_sql(feature, lower, upper, categories, where, source=EXP) -> str:
    return f"SELECT '{feature}' AS feature, {lower} AS lower, {upper} AS upper, {categories} AS categories, count(*) FILTER ({where})::BIGINT AS points, count(*) FILTER (is_case AND ({where}))::BIGINT AS cases FROM {source}"


def _peel_sql(n: str) -> str:
    hi, lo = quantile_sql(EXP, n, 0.95), quantile_sql(EXP, n, 0.05)
    whole = f"{EXP}, (SELECT min({n})::DOUBLE + 0 AS first, max({n})::DOUBLE AS last, {hi} AS hi, {lo} AS lo FROM {EXP}) AS q"
    return _count_sql(n, "first", "hi", "NULL::VARCHAR", f"{n} <= hi", whole) + " GROUP BY first, hi UNION ALL " + _count_sql(n, "lo", "last", "NULL::VARCHAR", f"{n} >= lo", whole) + " GROUP BY lo, last"


@query("peel_candidates_continuous", " UNION ALL ".join(_peel_sql(n) for n in CONTINUOUS[2:]))
def peel_candidates_continuous(spark, sf):
    return _candidates(spark, sf, list(CONTINUOUS[2:]))


def _integer_peel_sql(n: str) -> str:
    hi, lo = (f"trunc({quantile_sql(EXP, n, p)})" for p in (0.95, 0.05))
    q = f"(SELECT min({n})::DOUBLE AS first, max({n})::DOUBLE AS last, {hi} AS hi, {lo} AS lo FROM {EXP}) AS q"
    up = f"(CASE WHEN hi = last THEN {n} < last ELSE {n} <= hi END)"
    down = f"(CASE WHEN lo = first THEN {n} > first ELSE {n} >= lo END)"
    return (
        f"SELECT '{n}' AS feature, first AS lower, max({n})::DOUBLE AS upper, NULL::VARCHAR AS categories, count(*)::BIGINT AS points, count(*) FILTER (is_case)::BIGINT AS cases FROM {EXP}, {q} WHERE {up} GROUP BY first"
        f" UNION ALL SELECT '{n}', min({n})::DOUBLE, last, NULL, count(*)::BIGINT, count(*) FILTER (is_case)::BIGINT FROM {EXP}, {q} WHERE {down} GROUP BY last"
    )


@query("peel_candidates_integer", _integer_peel_sql("l_linenumber"))
def peel_candidates_integer(spark, sf):
    return _candidates(spark, sf, ["l_linenumber"])


@query(
    "peel_candidates_categorical",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, (SELECT string_agg(DISTINCT {n}, ',' ORDER BY {n}) FROM {EXP} WHERE {n} <> c.v) AS categories, count(*) FILTER ({n} <> c.v)::BIGINT AS points, count(*) FILTER (is_case AND {n} <> c.v)::BIGINT AS cases FROM {EXP}, (SELECT DISTINCT {n} AS v FROM {EXP}) AS c GROUP BY c.v"
        for n in NAMES[5:]
    ),
)
def peel_candidates_categorical(spark, sf):
    return _candidates(spark, sf, NAMES[5:])


def _paste_sql(n: str, truncate: bool = False) -> str:
    others = box_sql({k: v for k, v in BOX.items() if k != n})
    low, high = (float(x) for x in BOX[n])
    cut = (lambda e: f"trunc({e})") if truncate else (lambda e: e)
    first, last = (f"(SELECT {a}({n})::DOUBLE FROM {EXP})" for a in ("min", "max"))
    lower = f"coalesce({cut(quantile_sql(EXP, n, 0.95, f'{others} AND {n} BETWEEN {first} AND {d(low)}'))}, {first})"
    upper = f"coalesce({cut(quantile_sql(EXP, n, 0.05, f'{others} AND {n} BETWEEN {d(high)} AND {last}'))}, {last})"
    q = f"(SELECT {lower} AS lo, {upper} AS hi) AS q"
    a = _count_sql(n, "lo", d(high), "NULL::VARCHAR", f"{others} AND {n} BETWEEN lo AND {d(high)}", f"{EXP}, {q}") + " GROUP BY lo"
    b = _count_sql(n, d(low), "hi", "NULL::VARCHAR", f"{others} AND {n} BETWEEN {d(low)} AND hi", f"{EXP}, {q}") + " GROUP BY hi"
    moved = lambda s, c, v: f"SELECT * FROM ({s}) AS m WHERE {c} <> {d(v)}"  # noqa: E731  an unmoved bound is no candidate of this query
    return moved(a, "lower", low) + " UNION ALL " + moved(b, "upper", high)


@query("paste_candidates_continuous", " UNION ALL ".join(_paste_sql(n) for n in ("l_quantity", "l_extendedprice")))
def paste_candidates_continuous(spark, sf):
    return _candidates(spark, sf, ["l_quantity", "l_extendedprice"], True)


@query("paste_candidates_integer", _paste_sql("l_linenumber", True))
def paste_candidates_integer(spark, sf):
    return _candidates(spark, sf, ["l_linenumber"], True)


_OTHERS = box_sql({k: v for k, v in BOX.items() if k != "l_returnflag"})


@query(
    "paste_candidates_categorical",
    f"SELECT 'l_returnflag' AS feature, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, 'A,N,R' AS categories, count(*) FILTER ({_OTHERS} AND l_returnflag IN ('A','R','N'))::BIGINT AS points, count(*) FILTER (is_case AND {_OTHERS} AND l_returnflag IN ('A','R','N'))::BIGINT AS cases FROM {EXP} HAVING count(*) FILTER (l_returnflag = 'N') > 0",
)
def paste_candidates_categorical(spark, sf):
    return _candidates(spark, sf, ["l_returnflag"], True)


def _scores(objective: str) -> str:
    m0, m1 = "(k0 / n0)", "(CASE WHEN n1 = 0 THEN 0 ELSE k1 / n1 END)"
    gain = {"lenient1": f"({m1} - {m0}) / abs(n0 - n1)", "lenient2": f"n1 * ({m1} - {m0}) / abs(n0 - n1)"}
    if objective == "original":
        score = f"CASE WHEN n1 = 0 THEN -1 ELSE {m1} END"
    else:
        score = f"CASE WHEN {m0} = {m1} OR n0 = n1 THEN 0 ELSE {gain[objective]} END"
    base = f"SELECT o_orderpriority AS dropped, CAST(n0 AS DOUBLE) AS n0, CAST(k0 AS DOUBLE) AS k0, CAST(n0 - n AS DOUBLE) AS n1, CAST(k0 - k AS DOUBLE) AS k1 FROM (SELECT o_orderpriority, count(*) AS n, count(CASE WHEN o_totalprice >= 200000 THEN 1 END) AS k FROM orders GROUP BY 1) AS g, (SELECT count(*) AS n0, count(CASE WHEN o_totalprice >= 200000 THEN 1 END) AS k0 FROM orders) AS w"
    return f"SELECT dropped, CAST({score} AS DOUBLE) AS score FROM ({base}) AS c"


def _scored(objective: str) -> Query:
    def run(spark, sf):
        orders = table(spark, sf, "orders")
        case = F.col("o_totalprice") >= 200000
        groups = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(case).alias("k")).collect()
        n0, k0 = sum(g["n"] for g in groups), sum(g["k"] for g in groups)
        return rows_of(spark, [(g["o_orderpriority"], float(st.objective_score(objective, k0, n0, k0 - g["k"], n0 - g["n"]))) for g in groups], "dropped string, score double")

    return run


for _name in ("lenient1", "lenient2", "original"):
    query(f"score_{_name}", _scores(_name))(_scored(_name))


@query("best_candidate", f"SELECT dropped, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, dropped) AS rank FROM ({_scores('lenient1')}) AS s) AS r WHERE rank = 1")
def best_candidate(spark, sf):
    """The search's own choice among the boxes that leave one priority out."""
    groups = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") >= 200000).alias("k")).orderBy("o_orderpriority").collect()
    whole = frozenset(g["o_orderpriority"] for g in groups)
    n0, k0 = sum(g["n"] for g in groups), sum(g["k"] for g in groups)
    boxes = [(g["o_orderpriority"], Candidate(BoxLimits((("o_orderpriority", Categories(whole - {g["o_orderpriority"]})),)), n0 - g["n"], k0 - g["k"])) for g in groups]
    best = best_of([c for _, c in boxes], BoxStatistics.of(n0, k0, n0, k0, 0), BoxLimits((("o_orderpriority", Categories(whole)),)), st.LENIENT1)
    dropped = next(iter(whole - best.limits["o_orderpriority"].values))
    return rows_of(spark, [(dropped, float(best.score))], "dropped string, score double")


# ---------------------------------------------------------------- the search


PEEL_FEATURES = [Feature.continuous("l_quantity"), Feature.continuous("l_discount"), Feature.categorical("l_returnflag")]
PEELS = 3
#: A search that is followed to its last peel, and more steps than it has.
PATH = PrimConfig(peel_alpha=0.2, mass_min=0.2)
PATH_STEPS = 9


def _unrolled_peels(peels: int = PEELS, alpha: float = 0.05, mass_min: float | None = None) -> str:
    """The first peels as SQL: each step takes its best candidate's rows as a table of their own. With mass_min, those up to the
    first that a search does not accept."""
    steps = [f"b0 AS MATERIALIZED (SELECT l_quantity, l_discount, l_returnflag, is_case FROM {EXP})"]
    for k in range(peels):
        b = f"b{k}"
        options = []
        for n in ("l_quantity", "l_discount"):
            options.append((f"{n} <= {quantile_sql(b, n, 1 - alpha)}", f"SELECT {len(options)} AS no, 0 AS grp, {n} <= {quantile_sql(b, n, 1 - alpha)} AS keep, is_case, '{n}' AS feature, '' AS gone, 1 AS side FROM {b}"))
            options.append((f"{n} >= {quantile_sql(b, n, alpha)}", f"SELECT {len(options)} AS no, 0 AS grp, {n} >= {quantile_sql(b, n, alpha)} AS keep, is_case, '{n}' AS feature, '' AS gone, -1 AS side FROM {b}"))
        options.append(("", f"SELECT 4 AS no, 0 AS grp, l_returnflag <> v AS keep, is_case, 'l_returnflag' AS feature, v AS gone, 0 AS side FROM {b}, (SELECT DISTINCT l_returnflag AS v FROM {b}) AS vs WHERE (SELECT count(DISTINCT l_returnflag) FROM {b}) > 1"))
        steps.append(f"o{k} AS (" + " UNION ALL ".join(o for _, o in options) + ")")
        steps.append(
            f"c{k} AS (SELECT no, feature, gone, side, count(*) FILTER (keep) AS n1, count(*) FILTER (keep AND is_case) AS k1, count(*) AS n0, count(*) FILTER (is_case) AS k0 FROM o{k} GROUP BY no, feature, gone, side)"
        )
        joins = "".join(f", w{j}" for j in range(k))
        restricted = " + ".join(f"(CASE WHEN {' OR '.join([f'w{j}.feature = {n!r}' for j in range(k)] + [f'c.feature = {n!r}'])} THEN 1 ELSE 0 END)" for n in ("l_quantity", "l_discount", "l_returnflag"))
        score = "CASE WHEN c.n1 = c.n0 THEN 0 ELSE ((CASE WHEN c.n1 = 0 THEN 0 ELSE CAST(c.k1 AS DOUBLE) / c.n1 END) - CAST(c.k0 AS DOUBLE) / c.n0) / abs(c.n0 - c.n1) END"
        steps.append(f"w{k} AS MATERIALIZED (SELECT c.no, c.feature, c.gone, c.side, c.n1, c.k1, c.n0, {score} AS score FROM c{k} AS c{joins} ORDER BY {score} DESC, {restricted}, c.no, c.gone LIMIT 1)")
        keep = " OR ".join([f"(w{k}.no = {i} AND {cond})" for i, (cond, _) in enumerate(options[:4])] + [f"(w{k}.no = 4 AND l_returnflag <> w{k}.gone)"])
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT {b}.* FROM {b}, w{k} WHERE {keep})")
    whole = "(SELECT count(*) FROM b0)"
    accepted = lambda k: f"(SELECT n1 < n0 AND score > 0 AND CAST(n1 AS DOUBLE) / {whole} >= {mass_min} FROM w{k})"
    until = lambda k: " WHERE " + " AND ".join(accepted(j) for j in range(k + 1)) if mass_min is not None else ""
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {k + 1} AS step, n1::BIGINT AS points, k1::BIGINT AS cases_of_interest, feature FROM w{k}{until(k)}" for k in range(peels))


def first_box(frame: ScenarioFrame, config: PrimConfig | None = None, strategy: str = "auto") -> PrimBox:
    """The first box of a search, which then lets go of what it keeps cached."""
    prim = Prim(frame, config, strategy)
    try:
        return prim.find_box()
    finally:
        prim.close()


@query("prim_first_k_peels", _unrolled_peels())
def prim_first_k_peels(spark, sf):
    whole = experiments(spark, sf)
    box = first_box(ScenarioFrame(whole.df, PEEL_FEATURES, check=False))
    return rows_of(spark, _peeled(box)[:PEELS], _PEELED)


_PEELED = "step int, points long, cases_of_interest long, feature string"


def _peeled(box: PrimBox) -> list[tuple]:
    """Each peel of a box, and the feature that it restricts."""
    rows = []
    for k, (before, now) in enumerate(zip(box.trajectory, box.trajectory[1:], strict=False), 1):
        if now.phase == "peel":
            moved = next(n for n, r in now.limits if r != before.limits[n])
            rows.append((k, now.statistics.points, now.statistics.cases_of_interest, moved))
    return rows


def _peel_path(spark, sf, strategy: str) -> DataFrame:
    return rows_of(spark, _peeled(first_box(ScenarioFrame(experiments(spark, sf).df, PEEL_FEATURES, check=False), PATH, strategy)), _PEELED)


@query("prim_peel_path", _unrolled_peels(PATH_STEPS, 0.2, 0.2))
def prim_peel_path(spark, sf):
    """Every peel of a search, up to the one that it does not accept; in memory, since few combinations of values occur."""
    return _peel_path(spark, sf, "auto")


@query("prim_peel_path_distributed", _unrolled_peels(PATH_STEPS, 0.2, 0.2))
def prim_peel_path_distributed(spark, sf):
    """The same by Spark jobs."""
    return _peel_path(spark, sf, "distributed")


def search_frame(spark, sf) -> ScenarioFrame:
    """Features that do not spell out the case themselves."""
    whole = experiments(spark, sf)
    return ScenarioFrame(whole.df, [f for f in whole.features if f.name != "l_extendedprice"], check=False)


@query("prim_trajectory")
def prim_trajectory(spark, sf):
    return first_box(search_frame(spark, sf)).to_dataframe(spark)


@query("prim_limits")
def prim_limits(spark, sf):
    return first_box(search_frame(spark, sf)).limits_dataframe(spark)


@query("prim_repeated_boxes")
def prim_repeated_boxes(spark, sf):
    prim, rows = Prim(search_frame(spark, sf), PrimConfig(mass_min=0.1)), []
    for k in range(3):
        if (box := prim.find_box()) is None:
            break
        s = box.final_step.statistics
        rows.append((k, len(box.trajectory), s.points, s.cases_of_interest, s.coverage, s.density, s.mass))
    prim.close()
    return rows_of(spark, rows, "box int, steps int, points long, cases_of_interest long, coverage double, density double, mass double")


@query("prim_by_segment")
def prim_by_segment(spark, sf):
    """One search for each market segment, in parallel: grouped by segment, each group searched in memory."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select("c_mktsegment", F.col("o_totalprice").alias("price"), "c_acctbal", "o_orderpriority", (F.col("o_orderstatus") == "F").alias(CASE))

    def search(part):
        import pyarrow as pa

        from vantage.operators.search import Coded, LocalCounts

        columns = {n: part.column(n).to_numpy() for n in ("price", "c_acctbal")} | {"o_orderpriority": Coded(part.column("o_orderpriority"))}
        counts = LocalCounts(columns, part.column(CASE).to_numpy(zero_copy_only=False))
        box = search_local(counts, [Feature.continuous("price"), Feature.continuous("c_acctbal"), Feature.categorical("o_orderpriority")])
        s = box[-1].statistics
        return pa.table({"segment": [part.column("c_mktsegment")[0].as_py()], "steps": [len(box)], "points": [s.points], "cases": [s.cases_of_interest], "density": [s.density]})

    return rows.groupBy("c_mktsegment").applyInArrow(search, "segment string, steps long, points long, cases long, density double")


def search_local(counts, features: list[Feature], config: PrimConfig | None = None) -> tuple[BoxStep, ...]:
    """The steps of the first box over columns in memory, without a Spark session."""
    prim = Prim.over_columns(counts, features, counts.limits(features), config or PrimConfig())
    return prim.find_box().trajectory


RELAXED = [("l_quantity", "lower"), ("l_extendedprice", "lower"), ("l_extendedprice", "upper"), ("l_linenumber", "lower"), ("l_linenumber", "upper"), ("l_returnflag", "lower")]


def _relaxed_sql(name: str, side: str) -> str:
    rest = box_sql({k: v for k, v in BOX.items() if k != name})
    if name == "l_returnflag":
        return rest
    low, high = (float(x) for x in BOX[name])
    return f"{rest} AND {name} {f'<= {d(high)}' if side == 'lower' else f'>= {d(low)}'}"


@query("quasi_p_inputs", " UNION ALL ".join(f"SELECT '{n}' AS feature, '{s}' AS side, count(*) FILTER ({_relaxed_sql(n, s)})::BIGINT AS points, count(*) FILTER (is_case AND {_relaxed_sql(n, s)})::BIGINT AS cases FROM {EXP}" for n, s in RELAXED))
def quasi_p_inputs(spark, sf):
    f = experiments(spark, sf)
    initial = f.initial_limits()
    box = fixed_box(initial)
    open_ = [r for r in relaxed_boxes(box, initial, box.restricted(initial)) if (r[0], r[1]) in RELAXED]
    return f.df.agg(*(c.alias(f"{i}{k}") for k, (_, _, b) in enumerate(open_) for i, c in (("n", F.count_if(b.column())), ("k", F.count_if(b.column() & F.col(CASE)))))).select(
        F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(s).alias("side"), F.col(f"n{k}").alias("points"), F.col(f"k{k}").alias("cases")) for k, (n, s, _) in enumerate(open_)))).alias("r")
    ).select("r.*")


@query(
    "quasi_p",
    "WITH g AS (SELECT o_orderpriority AS grp, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1), "
    "u AS (SELECT grp, n, k, unnest(range(1, n + 1)) AS i FROM g), "
    "t AS (SELECT *, sum(ln((n - i + 1) / i::DOUBLE)) OVER (PARTITION BY grp ORDER BY i) + i * ln(0.48::DOUBLE) + (n - i) * ln(1 - 0.48::DOUBLE) AS term FROM u) "
    "SELECT grp, round(least(1, sum(exp(term)) FILTER (i >= k)), 7) AS p FROM t GROUP BY grp",
)
def quasi_p(spark, sf):
    """How likely a priority's finished orders are at a rate of 0.48, over all orders."""
    groups = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k")).collect()
    return rows_of(spark, [(g["grp"], round(st.binomial_greater(g["k"], g["n"], 0.48), 7)) for g in groups], "grp string, p double")


def _fixed_prim_box(f: ScenarioFrame) -> PrimBox:
    initial, s = f.initial_limits(), f.summary()
    box = fixed_box(initial)
    n, k = f.df.agg(F.count_if(box.column()), F.count_if(box.column() & F.col(CASE))).first()
    first = BoxStep(initial, BoxStatistics.of(s["rows"], s["cases"], s["rows"], s["cases"], 0), (), "initial")
    return PrimBox((first, BoxStep(box, BoxStatistics.of(n, k, s["rows"], s["cases"], len(box.restricted(initial))), (), "peel")), initial, f)


@query(
    "restriction_effects",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, n::BIGINT AS points, k::BIGINT AS cases_of_interest, k / greatest(kk, 1) AS coverage, k / n AS density, k0 / n0 - k / n AS density_gain FROM (SELECT count(*) FILTER ({box_sql({a: b for a, b in BOX.items() if a != n})}) AS n, count(*) FILTER (is_case AND {box_sql({a: b for a, b in BOX.items() if a != n})}) AS k, count(*) FILTER (is_case) AS kk, count(*) FILTER ({box_sql()}) AS n0, count(*) FILTER (is_case AND {box_sql()}) AS k0 FROM {EXP}) AS s"
        for n in BOX
    ),
)
def q_effects(spark, sf):
    f = experiments(spark, sf)
    box = _fixed_prim_box(f)
    return effects_dataframe(spark, restriction_effects(box, f, 1))


@query(
    "restricted_limits",
    "SELECT * FROM (VALUES ('l_extendedprice', 50000.0::DOUBLE, 95000.0::DOUBLE, NULL), ('l_linenumber', 2.0::DOUBLE, 5.0::DOUBLE, NULL), ('l_quantity', 20.0::DOUBLE, 50.0::DOUBLE, NULL), ('l_returnflag', NULL, NULL, 'A,R')) AS v(feature, lower, upper, categories)",
)
def q_restricted(spark, sf):
    f = experiments(spark, sf)
    initial = f.initial_limits()
    box = fixed_box(initial)
    open_ = set(box.restricted(initial))
    return rows_of(spark, [(n, lo, hi, ",".join(c) if c else None) for n, _, lo, hi, c in box.as_rows() if n in open_], "feature string, lower double, upper double, categories string")


#: Boxes of a trajectory: the least quantity and the least price, None where the feature is open.
STEPS = [(None, None), (5.0, None), (12.0, None), (20.0, None), (20.0, 40000.0), (28.0, 50000.0), (35.0, 60000.0), (30.0, 60000.0)]


def _step_sql(k: int, quantity: float | None, price: float | None) -> str:
    where = " AND ".join([f"{n} >= {d(x)}" for n, x in (("l_quantity", quantity), ("l_extendedprice", price)) if x is not None] or ["true"])
    phase = "initial" if k == 0 else "paste" if k == len(STEPS) - 1 else "peel"
    inside, cases = f"count(*) FILTER ({where})", f"count(*) FILTER (is_case AND ({where}))"
    density = f"{cases}::DOUBLE / {inside}"
    return (
        f"SELECT {k} AS step, '{phase}' AS phase, {cases}::DOUBLE / count(*) FILTER (is_case) AS coverage, {density} AS density, {density} AS mean, {inside}::DOUBLE / count(*) AS mass, "
        f"{(quantity is not None) + (price is not None)} AS restricted_dimensions, {inside} AS points, {cases} AS cases_of_interest FROM {EXP}"
    )


_TRAJECTORY = "(" + " UNION ALL ".join(_step_sql(k, *box) for k, box in enumerate(STEPS)) + ") AS t"
_STEP_COLUMNS = "step::INTEGER AS step, phase, coverage::DOUBLE AS coverage, density::DOUBLE AS density, mean::DOUBLE AS mean, mass::DOUBLE AS mass, restricted_dimensions::INTEGER AS restricted_dimensions, points::BIGINT AS points, cases_of_interest::BIGINT AS cases_of_interest"


def trajectory(spark, sf) -> DataFrame:
    """The steps of STEPS over all rows, as a found box has them."""
    f = experiments(spark, sf)
    initial, s = f.initial_limits(), f.summary()
    boxes = []
    for quantity_, price in STEPS:
        box = initial
        for n, x in (("l_quantity", quantity_), ("l_extendedprice", price)):
            box = box if x is None else box.with_restriction(n, Range("continuous", x, initial[n].upper))
        boxes.append(box)
    found = f.df.agg(*(c.alias(f"{i}{k}") for k, b in enumerate(boxes) for i, c in (("n", F.count_if(b.changed_column(initial))), ("k", F.count_if(b.changed_column(initial) & F.col(CASE)))))).first()
    steps = []
    for k, b in enumerate(boxes):
        phase = "initial" if k == 0 else "paste" if k == len(boxes) - 1 else "peel"
        steps.append(BoxStep(b, BoxStatistics.of(found[f"n{k}"], found[f"k{k}"], s["rows"], s["cases"], len(b.restricted(initial))), (), phase))
    return PrimBox(tuple(steps), initial, f).to_dataframe(spark)


@query("select_balanced", f"SELECT * FROM (SELECT {_STEP_COLUMNS}, 2 * coverage::DOUBLE * density::DOUBLE / (coverage::DOUBLE + density::DOUBLE) AS score FROM {_TRAJECTORY} WHERE restricted_dimensions BETWEEN 1 AND 2) AS s ORDER BY score DESC, step LIMIT 1")
def select_balanced(spark, sf):
    return select_from(trajectory(spark, sf), CandidateSelection.restricting_at_least_one(Balanced(), 2))


@query("select_high_density", f"SELECT * FROM (SELECT {_STEP_COLUMNS}, coverage::DOUBLE AS score FROM {_TRAJECTORY} WHERE density >= 0.45) AS s ORDER BY score DESC, step LIMIT 1")
def select_high_density(spark, sf):
    return select_from(trajectory(spark, sf), CandidateSelection(HighDensity(0.45)))


# ---------------------------------------------------------------- evaluation tables over events


KINDS = ("click", "login", "purchase", "view")
EVENT_SESSION: SessionSchema = (
    SchemaBuilder()
    .quantity("value", "Dimensionless", 0.0, 400.0)
    .integer("user", 0, 1 << 40)
    .categorical("parity", ["even", "odd"])
    .boolean("early")
    .quantity_output("cost")
    .boolean_output("failure")
    .integer_output("count")
    .key_output("grade", ["low", "high"])
    .output("at", datetime("UTC"))
    .output("report", record("Report", cost=quantity(), latency=union("Latency", Available={"p90": quantity()}, Pending={}), checks=indexed(BOOL, Axis("Check", ("First", "Second"))), grade=key(Axis("Grade", ("Good", "Bad")))))
    .build()
)
_J2000 = "(epoch(ts) - 946728000)"


def evaluations(spark: SparkSession, sf: str, failures: bool = False) -> DataFrame:
    """Events as evaluated rows: one evaluation for each remainder of the event number by four, with nested outputs."""
    e = table(spark, sf, "events")
    v, user = F.col("value"), F.col("user_id")
    cost, even = v * 2, user % 2 == 0
    latency = F.struct(F.when(v >= 40, "Available").otherwise("Pending").alias("_tag"), F.when(v >= 40, F.struct((v / 10).alias("p90"))).alias("Available"))
    report = F.struct(cost.alias("cost"), latency.alias("latency"), F.array(v >= 60, even).alias("checks"), F.when(v >= 30, "Good").otherwise("Bad").alias("grade"))
    outputs = F.struct(cost.alias("cost"), (v >= 80).alias("failure"), (user % 100).alias("count"), F.when(v < 50, "low").otherwise("high").alias("grade"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2000-01-01 12:00:00', ts)") / 1000000).alias("at"), report.alias("report"))
    inputs = F.struct(v.alias("value"), user.alias("user"), F.when(even, "even").otherwise("odd").alias("parity"), (F.col("event_id") < 500).alias("early"))
    part = F.col("event_id") % 4
    identifier = F.unhex(F.concat(F.lit("000000000000002a"), F.lpad(F.hex(part), 16, "0")))
    bad = F.lit(failures) & (v < 5)
    kinds = EVENT_SESSION.storage_type()
    return e.select(
        identifier.alias("evaluation_id"),
        F.expr("event_id div 4").alias("row"),
        part.cast("decimal(20,0)").alias("seed"),
        inputs.cast(kinds["inputs"].dataType).alias("inputs"),
        F.when(~bad, outputs.cast(kinds["outputs"].dataType)).alias("outputs"),
        F.when(bad, oc.outcome_column(oc.EVALUATION_ERROR, None, "too small")).otherwise(oc.outcome_column(oc.SUCCESS)).alias("outcome"),
        "event_id",
    )


class _Events(EvaluationTable):
    """The same, with the event number beside the rows for comparison."""

    def __init__(self, spark, sf, failures=False):
        self.session = EVENT_SESSION
        self.df = evaluations(spark, sf, failures).withColumn("ordinal", F.col("event_id") % 4)


@query("table_features", "SELECT event_id, value, user_id AS \"user\", CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CASE WHEN event_id < 500 THEN 'true' ELSE 'false' END AS early FROM events")
def table_features(spark, sf):
    t = _Events(spark, sf, True)
    return t.df.select("event_id", *(c.alias(f.name) for f, c in t.features()))


@query("table_cases", "SELECT event_id, value >= 80 AS is_case FROM events")
def table_cases(spark, sf):
    return _Events(spark, sf).cases(1).select("event_id", F.col(CASE).alias("is_case"))


@query("table_dataset", "SELECT value, user_id AS \"user\", CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CASE WHEN event_id < 500 THEN 'true' ELSE 'false' END AS early, value * 2 > 100 AS is_case FROM events")
def table_dataset(spark, sf):
    f = _Events(spark, sf).dataset_where(0, CaseRule.quantity(ABOVE, 100.0))
    return f.df.select("value", "user", "parity", "early", F.col(CASE).alias("is_case"))


@query("key_labels", "SELECT DISTINCT s_nationkey / 2.0 AS x, regexp_replace(CAST(CAST(s_nationkey / 2.0 AS DOUBLE) AS VARCHAR), '\\.0$', '') AS label FROM supplier")
def key_labels(spark, sf):
    x = (F.col("s_nationkey") / 2).cast("double")
    return table(spark, sf, "supplier").select(x.alias("x"), key_label(x).alias("label")).distinct()


_RULES: dict[str, tuple[int, CaseRule, str]] = {
    "is_true": (1, CaseRule.is_true(), "value >= 80"),
    "is_false": (1, CaseRule.is_false(), "NOT value >= 80"),
    "key_in": (3, CaseRule.key_in("high"), "value >= 50"),
    "key_in_none": (3, CaseRule.key_in(), "FALSE"),
}
for _cmp, _op in ((BELOW, "<"), (AT_MOST, "<="), (AT_LEAST, ">="), (ABOVE, ">")):
    _RULES[f"quantity_{_cmp}"] = (0, CaseRule.quantity(_cmp, 100.0), f"value * 2 {_op} 100")
    _RULES[f"integer_{_cmp}"] = (2, CaseRule.integer(_cmp, 50), f"user_id % 100 {_op} 50")
    _RULES[f"datetime_{_cmp}"] = (4, CaseRule.datetime(_cmp, 758600000.0), f"{_J2000} {_op} 758600000")
for _name, (_slot, _rule, _test) in _RULES.items():
    query(f"case_rule_{_name}", f"SELECT event_id FROM events WHERE {_test}")(lambda spark, sf, s=_slot, r=_rule: _Events(spark, sf).cases_where(s, r).where(CASE).select("event_id"))


def _at(path: str, rule: CaseRule, absent: str = NOT_A_CASE) -> CaseCondition:
    return CaseCondition.at(OutputPath.parse(EVENT_SESSION, path), rule, absent)


_FAST = _at("report.latency.Available.p90", CaseRule.quantity(AT_MOST, 6.0))
_GOOD = _at("report.grade", CaseRule.key_in("Good"))
_FAST_SQL, _GOOD_SQL = "(value >= 40 AND value / 10 <= 6)", "(value >= 30)"
for _name, _condition, _test in (
    ("all", CaseCondition.all(_FAST, _GOOD), f"{_FAST_SQL} AND {_GOOD_SQL}"),
    ("any", CaseCondition.any(_FAST, ~_GOOD), f"{_FAST_SQL} OR NOT {_GOOD_SQL}"),
    ("not", ~_FAST, f"NOT {_FAST_SQL}"),
    ("absent", CaseCondition.any(_FAST, _at("report.latency.Pending", CaseRule.is_true())), f"{_FAST_SQL} OR value < 40"),
):
    query(f"case_condition_{_name}", f"SELECT event_id, {_test} AS is_case FROM events")(lambda spark, sf, c=_condition: _Events(spark, sf).cases_matching(c).select("event_id", F.col(CASE).alias("is_case")))
for _name, _path, _value in (
    ("field", "report.cost", "value * 2"),
    ("variant", "report.latency.Available", "value >= 40"),
    ("variant_field", "report.latency.Available.p90", "CASE WHEN value >= 40 THEN value / 10 END"),
    ("entry", "report.checks.Second", "user_id % 2 = 0"),
):
    query(f"output_path_{_name}", f"SELECT event_id, {_value} AS selected FROM events")(lambda spark, sf, p=_path: evaluations(spark, sf).select("event_id", OutputPath.parse(EVENT_SESSION, p).column(F.col("outputs")).alias("selected")))


# ---------------------------------------------------------------- pairing, order, requests


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = evaluations(spark, sf)
    return e.select("evaluation_id", "row", "seed", "inputs"), e.select("evaluation_id", "row", "outputs", "outcome")


@query("evaluation_pairing", "SELECT event_id % 4 AS part, event_id // 4 AS \"row\", value, value * 2 AS cost FROM events")
def evaluation_pairing(spark, sf):
    requests, results = _sides(spark, sf)
    return pair(requests, results).select(F.col("seed").cast("long").alias("part"), "row", F.col("inputs.value").alias("value"), F.col("outputs.cost").alias("cost"))


@query("duplicate_ids", "SELECT DISTINCT lower(printf('000000000000002a%016x', event_id % 4)) AS id FROM events WHERE event_id % 4 < 2")
def q_duplicates(spark, sf):
    e = evaluations(spark, sf)
    return duplicate_ids(e, e.where("seed < 2")).select(seeds.id_hex(F.col("evaluation_id")).alias("id"))


@query("missing_results", "SELECT DISTINCT lower(printf('000000000000002a%016x', event_id % 4)) AS id FROM events WHERE event_id % 4 <> 1")
def q_missing(spark, sf):
    requests, results = _sides(spark, sf)
    return missing_results(requests, results.where("seed = 1") if "seed" in results.columns else results.join(requests.where("seed = 1").select("evaluation_id").distinct(), "evaluation_id", "left_semi")).select(seeds.id_hex(F.col("evaluation_id")).alias("id"))


@query("append_and_sort", "SELECT (row_number() OVER (ORDER BY event_id % 4, event_id // 4) - 1)::BIGINT AS place, event_id % 4 AS part, event_id // 4 AS \"row\" FROM events")
def append_and_sort(spark, sf):
    e = evaluations(spark, sf).drop("event_id")
    whole = EvaluationTable.from_evaluations(EVENT_SESSION, [e.where("seed >= 2"), e.where("seed < 2")], spark).sort_by_id()
    sizes = whole.df.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
    # one row for each evaluation, of which there are few beside their rows
    offset = F.coalesce(F.sum("n").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return whole.df.join(sizes.select("ordinal", offset.alias("offset")), "ordinal").select((F.col("offset") + F.col("row")).alias("place"), F.col("seed").cast("long").alias("part"), "row")


@query("remaining_rows", f"SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (is_case)::BIGINT AS n_cases FROM {EXP} WHERE NOT ({box_sql()})")
def remaining_rows(spark, sf):
    f = experiments(spark, sf)
    return f.df.where(~fixed_box(f.initial_limits()).column()).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(CASE).alias("n_cases"))


@query("request_split", "SELECT lower(printf('000000000000002a%016x', event_id % 4 + (event_id // 4) // 7)) AS id, (event_id // 4) % 7 AS \"row\", value FROM events")
def request_split(spark, sf):
    requests, _ = _sides(spark, sf)
    return split(requests, 7).select(seeds.id_hex(F.col("evaluation_id")).alias("id"), "row", F.col("inputs.value").alias("value"))


@query(
    "domain_violations",
    "SELECT event_id, CASE WHEN value < 10 OR value > 100 THEN 'value' ELSE 'user' END AS subject, CASE WHEN value < 10 OR value > 100 THEN 'outside' ELSE concat('value ', user_id, ' is greater than the maximum 90') END AS message FROM events WHERE value < 10 OR value > 100 OR user_id > 90",
)
def domain_violations(spark, sf):
    from vantage.schema import INT, Bounds, Port

    narrow = SessionSchema((Port("value", quantity(), Bounds(10.0, 100.0)), Port("user", INT, Bounds(None, 90))), EVENT_SESSION.outputs)
    found = evaluations(spark, sf).select("event_id", oc.domain_violation(narrow, F.col("inputs")).alias("o")).where("o is not null")
    return found.select("event_id", "o.subject", F.when(F.col("o.subject") == "value", "outside").otherwise(F.col("o.message")).alias("message"))


@query("outcome_counts", "SELECT CASE WHEN value < 5 THEN 'evaluation_error' ELSE 'success' END AS kind, count(*)::BIGINT AS n_rows FROM events GROUP BY 1")
def outcome_counts(spark, sf):
    return _Events(spark, sf, True).outcome_counts().withColumnRenamed("rows", "n_rows")


# ---------------------------------------------------------------- designs and seeds


DESIGN = SchemaBuilder().continuous("x", -1.0, 1.0).integer("count", -2, 2).categorical("mode", ["risky", "safe"]).boolean_output("failure").build()
ROWS = 1000


@query("lhs_discrete_levels", f"SELECT level::BIGINT AS level, count(*)::BIGINT AS n FROM (SELECT (i * 5 + 2) // {ROWS} - 2 AS level FROM range({ROWS}) AS r(i)) AS l GROUP BY 1")
def lhs_discrete_levels(spark, sf):
    return sample_latin_hypercube(spark, DESIGN, ROWS, 42, 3).groupBy(F.col("inputs.count").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("lhs_strata_histogram", f"SELECT i::BIGINT AS stratum, 1::BIGINT AS n FROM range({ROWS}) AS r(i)")
def lhs_strata_histogram(spark, sf):
    stratum = F.least(F.floor((F.col("inputs.x") + 1) / 2 * ROWS), F.lit(ROWS - 1))
    return sample_latin_hypercube(spark, DESIGN, ROWS, 42, 3).groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("uniform_sample")
def uniform_sample(spark, sf):
    return sample_uniform(spark, DESIGN, ROWS, 42, 3).select(seeds.id_hex(F.col("evaluation_id")).alias("id"), "row", F.col("seed").cast("string").alias("seed"), "inputs.*")


def _seed_sql() -> str:
    mul = lambda a, b: f"(({a})::UHUGEINT * {b}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    add = f"((s0::UHUGEINT + {seeds._GOLDEN}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return (
        f"WITH a AS (SELECT event_id, xor(xor({42}::UBIGINT, {seeds.ROW_DOMAIN}::UBIGINT), {mul('event_id', seeds._GOLDEN)}) AS s0 FROM events), b AS (SELECT event_id, {add} AS s1 FROM a), "
        f"c AS (SELECT event_id, {mul('xor(s1, s1 >> 30)', seeds._M1)} AS s2 FROM b), e AS (SELECT event_id, {mul('xor(s2, s2 >> 27)', seeds._M2)} AS s3 FROM c) SELECT event_id, CAST(xor(s3, s3 >> 31) AS VARCHAR) AS seed FROM e"
    )


@query("derive_seed_table", _seed_sql())
def derive_seed_table(spark, sf):
    return table(spark, sf, "events").select("event_id", seeds.seed_column(F.lit(42), F.col("event_id"), seeds.ROW_DOMAIN).cast("string").alias("seed"))


# ---------------------------------------------------------------- chart data


@query("tradeoff_curve", f"SELECT step::INTEGER AS step, phase, coverage::DOUBLE AS coverage, density::DOUBLE AS density, restricted_dimensions::INTEGER AS restricted_dimensions FROM {_TRAJECTORY}")
def tradeoff_curve(spark, sf):
    return tradeoff(trajectory(spark, sf))


_DOMAINS = " UNION ALL ".join(f"SELECT '{n}' AS feature, min({n}) AS a, max({n}) AS b, {d(float(BOX[n][0]))} AS lo, {d(float(BOX[n][1]))} AS hi FROM {EXP}" for n in ("l_quantity", "l_extendedprice", "l_linenumber"))


@query("normalized_limits", f"SELECT feature, (lo - a) / (b - a) AS lower_share, (hi - a) / (b - a) AS upper_share FROM ({_DOMAINS}) AS s")
def q_normalized(spark, sf):
    f = experiments(spark, sf)
    initial = f.initial_limits()
    rows = [(n, float(initial[n].lower), float(initial[n].upper), float(BOX[n][0]), float(BOX[n][1])) for n in ("l_quantity", "l_extendedprice", "l_linenumber")]
    return normalized_limits(rows_of(spark, rows, "feature string, domain_lower double, domain_upper double, box_lower double, box_upper double")).select("feature", "lower_share", "upper_share")


@query("pairs_projection", f"SELECT l_quantity, l_discount, is_case, {box_sql()} AS is_member, count(*)::BIGINT AS n FROM {EXP} GROUP BY ALL")
def pairs_projection(spark, sf):
    f = experiments(spark, sf)
    inside = BoxLimits(tuple((n, Categories(frozenset(v)) if isinstance(v[0], str) else Range(f.kind(n), *v)) for n, v in BOX.items())).column()
    return f.df.groupBy("l_quantity", "l_discount", F.col(CASE).alias("is_case"), inside.alias("is_member")).agg(F.count(F.lit(1)).alias("n"))


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: a whole box search over the smallest tables."""
    return prim_trajectory(spark, "/root/testdata/sf0.001")
