"""CSV reports of a search: experiments, trajectory, limits; reading and checking them again; data for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.errors import ExportError
from vantage.operators.boxes import BoxLimits, Categories, Range
from vantage.operators.frame import CASE, ScenarioFrame
from vantage.operators.search import PrimBox

TRAJECTORY = "step int, phase string, coverage double, density double, mass double, restricted_dimensions int, points long, cases_of_interest long"
LIMITS = "step int, feature string, domain_lower double, domain_upper double, box_lower double, box_upper double, quasi_p_lower double, quasi_p_upper double"


def trajectory_table(spark: SparkSession, box: PrimBox) -> DataFrame:
    return box.to_dataframe(spark).drop("mean")


def limits_table(spark: SparkSession, box: PrimBox) -> DataFrame:
    """Numeric limits of every step beside the features' domains: the trajectory's limits joined with those of step 0."""
    limits = box.limits_dataframe(spark).where("kind <> 'categorical'")
    domain = limits.where("step = 0").select("feature", F.col("lower").alias("domain_lower"), F.col("upper").alias("domain_upper"))
    return limits.join(F.broadcast(domain), "feature").select("step", "feature", "domain_lower", "domain_upper", F.col("lower").alias("box_lower"), F.col("upper").alias("box_upper"), "quasi_p_lower", "quasi_p_upper")


def experiments_table(frame: ScenarioFrame) -> DataFrame:
    """row_index, the features and case_of_interest."""
    if frame.row_id is None:
        raise ExportError("InvalidFile", "experiments are exported from a frame with row ids")
    return frame.df.select(F.col("row_id").alias("row_index"), *(f"`{f.name}`" for f in frame.features), F.col(CASE).alias("case_of_interest"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a value of another type, or a Boolean other than true and false, fails."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """With steps 0, 1, 2, … , one at least."""
    df = read_csv(spark, path, TRAJECTORY)
    n, low, high, distinct = df.agg(F.count("step"), F.min("step"), F.max("step"), F.count_distinct("step")).first()
    if not n or (low, high, distinct) != (0, n - 1, n):
        raise ExportError("InvalidFile", "a trajectory has steps 0, 1, 2, …", path=path)
    return df


def select_step(trajectory: DataFrame, requested: int | None = None) -> int:
    """The step asked for, the last one by default."""
    last = trajectory.agg(F.max("step")).first()[0]
    if requested is None:
        return last
    if not 0 <= requested <= last:
        raise ExportError("StepOutOfRange", f"step {requested} is not between 0 and {last}", step=requested)
    return requested


def restricted_feature_limits(limits: DataFrame, trajectory: DataFrame, step: int) -> DataFrame:
    """Limits of a step that differ from the domain; as many as the trajectory says."""
    own = limits.where((F.col("step") == step) & ((F.col("box_lower") != F.col("domain_lower")) | (F.col("box_upper") != F.col("domain_upper"))))
    said = trajectory.where(F.col("step") == step).first()["restricted_dimensions"]
    if own.count() != said:
        raise ExportError("DimensionMismatch", f"step {step} restricts {said} features by the trajectory, but {own.count()} by the limits", step=step)
    return own


def members(experiments: DataFrame, limits: DataFrame, step: int) -> DataFrame:
    """Experiments with `member`: inside all limits of a step."""
    inside = F.lit(True)
    for r in limits.where(F.col("step") == step).collect():  # one row a feature
        inside = inside & F.col(f"`{r['feature']}`").between(r["box_lower"], r["box_upper"])
    return experiments.withColumn("member", inside)


def validate_membership(experiments: DataFrame, limits: DataFrame, trajectory: DataFrame, step: int) -> None:
    """The members of a step are as many, with as many cases, as the trajectory says."""
    found = members(experiments, limits, step).agg(F.count_if("member").alias("points"), F.count_if(F.col("member") & F.col("case_of_interest")).alias("cases")).first()
    said = trajectory.where(F.col("step") == step).first()
    if (found["points"], found["cases"]) != (said["points"], said["cases_of_interest"]):
        raise ExportError("MembershipMismatch", f"step {step} holds {tuple(found)} rows and cases, not {(said['points'], said['cases_of_interest'])}", step=step)


# ---------------------------------------------------------------- data for charts


def tradeoff(trajectory: DataFrame) -> DataFrame:
    """Coverage against density along the trajectory."""
    return trajectory.select("step", "phase", "coverage", "density", "restricted_dimensions")


def normalized_limits(limits: DataFrame) -> DataFrame:
    """Box limits as shares of their domains; a domain of one point has 0 and 1."""
    width = F.col("domain_upper") - F.col("domain_lower")
    share = lambda c, alone: F.when(width == 0, alone).otherwise((F.col(c) - F.col("domain_lower")) / width)
    return limits.withColumns({"lower_share": share("box_lower", 0.0), "upper_share": share("box_upper", 1.0)})


def padded(limits: DataFrame, share: float = 0.04) -> DataFrame:
    """Axis ranges: the domain and a margin on either side; a domain of one point gets a width of one."""
    width = F.col("domain_upper") - F.col("domain_lower")
    margin = F.when(width == 0, 0.5).otherwise(width * share)
    return limits.withColumns({"axis_lower": F.col("domain_lower") - margin, "axis_upper": F.col("domain_upper") + margin})


def pairs(experiments: DataFrame, limits: DataFrame, features: list[str], step: int) -> DataFrame:
    """Points of every pair of features, long: x_feature, y_feature, x, y, case, member. One scan, exploded."""
    cells = [F.struct(F.lit(a).alias("x_feature"), F.lit(b).alias("y_feature"), F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for i, a in enumerate(features) for b in features[i + 1 :]]
    marked = members(experiments, limits, step)
    return marked.select("row_index", "case_of_interest", "member", F.explode(F.array(*cells)).alias("c")).select("row_index", "c.*", "case_of_interest", "member")


def box_from_table(limits: DataFrame, step: int) -> BoxLimits:
    """Limits of a step as a box (numeric features as continuous ones)."""
    return BoxLimits(tuple((r["feature"], Range("continuous", r["box_lower"], r["box_upper"])) for r in limits.where(F.col("step") == step).orderBy("feature").collect()))


def restrictions_text(limits: BoxLimits, initial: BoxLimits) -> list[str]:
    return [f"{n} in {{{', '.join(sorted(r.values))}}}" if isinstance(r, Categories) else f"{n} in [{r.lower}, {r.upper}]" for n, r in limits if r != initial[n]]
