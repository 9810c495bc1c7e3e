"""Row outcomes as structs: success or one of eight failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage.schema import OUTCOME, SessionSchema

# Labels of the outcome kinds.
SUCCESS = "success"
ASSERTION_FAILED = "assertion_failed"
INPUT_OUT_OF_DOMAIN = "input_out_of_domain"
EVALUATION_ERROR = "evaluation_error"
PANIC = "panic"
NON_STRING_PANIC = "non_string_panic"
INVALID_INPUT = "invalid_input"
OUTPUT_COUNT_MISMATCH = "output_count_mismatch"
OUTPUT_KIND_MISMATCH = "output_kind_mismatch"
KINDS = (SUCCESS, ASSERTION_FAILED, INPUT_OUT_OF_DOMAIN, EVALUATION_ERROR, PANIC, NON_STRING_PANIC, INVALID_INPUT, OUTPUT_COUNT_MISMATCH, OUTPUT_KIND_MISMATCH)

#: Parts that a kind must have.
PARTS = {ASSERTION_FAILED: ("subject", "message"), INPUT_OUT_OF_DOMAIN: ("subject", "message"), EVALUATION_ERROR: ("message",), PANIC: ("message",), OUTPUT_COUNT_MISMATCH: ("expected_count", "actual_count"), OUTPUT_KIND_MISMATCH: ("subject",)}


def outcome(kind: str, subject=None, message=None, expected_count=None, actual_count=None) -> dict:
    return {"kind": kind, "subject": subject, "message": message, "expected_count": expected_count, "actual_count": actual_count}


def outcome_column(kind: str, subject: Column | str | None = None, message: Column | str | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = (as_column(kind).alias("kind"), as_column(subject).cast("string").alias("subject"), as_column(message).cast("string").alias("message"))
    return F.struct(*parts, F.lit(None).cast("bigint").alias("expected_count"), F.lit(None).cast("bigint").alias("actual_count")).cast(OUTCOME)


def message_of(o: Column) -> Column:
    """The sentence that says why a row failed; null for a success."""
    kind, subject, message = o["kind"], o["subject"], o["message"]
    return (
        F.when(kind == ASSERTION_FAILED, F.concat(F.lit("model evaluation failed: assertion `"), subject, F.lit("` failed: "), message))
        .when(kind == INPUT_OUT_OF_DOMAIN, F.concat(F.lit("model evaluation failed: input '"), subject, F.lit("' is out of domain: "), message))
        .when(kind == EVALUATION_ERROR, F.concat(F.lit("model evaluation failed: "), message))
        .when(kind == PANIC, F.concat(F.lit("model evaluation panicked: "), message))
        .when(kind == NON_STRING_PANIC, "model evaluation panicked: non-string panic payload")
        .when(kind == INVALID_INPUT, "invalid model input: the request is of another session")
        .when(kind == OUTPUT_COUNT_MISMATCH, F.concat(F.lit("invalid model output: expected "), o["expected_count"].cast("string"), F.lit(" values, not "), o["actual_count"].cast("string")))
        .when(kind == OUTPUT_KIND_MISMATCH, F.concat(F.lit("invalid model output: '"), subject, F.lit("' has a value of another kind")))
    )


def undecodable(o: Column) -> Column:
    """What is wrong with a stored outcome: UnknownOutcome or MissingOutcomePart with its part; null if nothing."""
    missing = F.lit(None).cast("string")
    for kind, parts in PARTS.items():
        for part in reversed(parts):
            missing = F.when((o["kind"] == kind) & o[part].isNull(), F.lit(f"MissingOutcomePart:{part}")).otherwise(missing)
    return F.when(~o["kind"].isin(*KINDS) | o["kind"].isNull(), "UnknownOutcome").otherwise(missing)


def shown(x) -> str:
    """A number as messages show it: whole floating-point numbers without a fraction."""
    return str(int(x)) if isinstance(x, float) and x.is_integer() and abs(x) < 1e16 else str(x)


def violation(low, high, text: str) -> str:
    """How messages say that a number, as shown, is outside its bounds."""
    if low is not None and high is not None:
        return f"value {text} lies outside [{shown(low)}, {shown(high)}]"
    return f"value {text} is less than the minimum {shown(low)}" if low is not None else f"value {text} is greater than the maximum {shown(high)}"


def shown_column(x: Column) -> Column:
    """What `shown` gives: whole numbers below 1e16 without a fraction, others in shortest form, from 1e-4 to 1e16 in full."""
    number = x.cast("double")
    size = F.abs(number)
    short = F.regexp_replace(F.lower(number.cast("string")), r"\.0(?=e|$)", "")
    exponent = F.regexp_extract(short, r"e(-?)(\d+)$", 2)
    padded = F.concat(F.regexp_extract(short, r"^(.*e)", 1), F.when(short.contains("e-"), "-").otherwise("+"), F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent))
    # digits of a number that the cast gives in scientific form although it is within the full range
    digits = F.regexp_replace(F.regexp_extract(short, r"^-?([\d.]+)", 1), r"\.", "")
    power = F.regexp_extract(short, r"e(-?\d+)$", 1).try_cast("int")
    sign = F.when(number < 0, "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(sign, F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    full = F.when(size < 1, small).otherwise(large)
    fraction = F.when(short.contains("e"), F.when((size >= 1e-4) & (size < 1e16), full).otherwise(padded)).otherwise(short)
    return F.when((number == F.floor(number)) & (size < 1e16), number.cast("decimal(38,0)").cast("string")).otherwise(fraction)


def domain_violation(session: SessionSchema, inputs: Column) -> Column:
    """Outcome for the first input, in session order, outside its closed domain; null if all are inside. Quantities and
    integers are checked, datetimes are not."""
    found = []
    for port in session.inputs:
        if port.domain is None or port.wire.kind not in ("quantity", "int"):
            continue
        x, low, high = inputs.getField(port.name), port.domain.min, port.domain.max
        outside = F.lit(False)
        if low is not None:
            outside = outside | (x < F.lit(low))
        if high is not None:
            outside = outside | (x > F.lit(high))
        before, after = violation(low, high, "\0").split("\0")
        text = shown_column(x) if port.wire.kind == "quantity" else x.cast("string")
        found.append(F.when(outside, outcome_column(INPUT_OUT_OF_DOMAIN, port.name, F.concat(F.lit(before), text, F.lit(after)))))
    return F.coalesce(*found) if found else F.lit(None).cast(OUTCOME)
