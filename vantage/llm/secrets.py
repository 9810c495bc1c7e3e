"""Secret scans: base patterns, and multipart credentials linked by their distance in the text.

A 40-character key, a temporary key identifier or an address is too common to report by itself. Such weak
candidates are reported where complementary parts stand within reach of each other: interval joins between the
identifiers, secrets and endpoints of one text. Everything is built from Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN_LEAST = 6
#: Runs are taken whole, so a least length inside the pattern drops the same matches as a test after it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Weak parts: identifiers of temporary or role keys, bare 40-character keys, addresses.
WEAK_ID = r"(?:ASIA|AROA|AIDA)[A-Z0-9]{16,}"
ANY_ID = r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}"
WEAK_KEY = r"[A-Za-z0-9/+=]{40,}"
WEAK_KEY_LENGTH = 40
ENDPOINT = r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
#: Code points between two parts of one credential, at most.
REACH = 300

#: In this order spans of equal start are listed.
KINDS = ("assign", "access", "hex", "key_id", "key", "endpoint")

_SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _running(lengths: Column) -> Column:
    """(gap, size, ok) of successive matches to (start, stop, ok), in stretches of about the square root of their number."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths)))).cast("int")
    stretches = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / width).cast("int")),
        lambda i: F.slice(lengths, i * width + 1, width),
    )
    zero = F.lit(0).cast("bigint")
    span = "array<struct<start:bigint,stop:bigint,ok:boolean>>"

    def walk(xs: Column, base: Column) -> Column:
        return F.aggregate(
            xs,
            F.struct(base.alias("at"), F.array().cast(span).alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("stop"), x["ok"].alias("ok")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x["gap"] + x["size"])
    based = F.aggregate(
        stretches,
        F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda a, xs: F.struct((a["at"] + total(xs)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )
    return F.flatten(F.transform(F.arrays_zip(stretches.alias("xs"), based.alias("base")), lambda p: walk(p["xs"], p["base"])))


def _matches(text: Column, pattern: str, hint: Column, ok=None) -> Column:
    """Leftmost non-overlapping matches as (gap before, size, ok), in code points; ok tests a match's own text.

    The hint, a cheap test that holds wherever there is a match, spares most texts the search.
    """
    # \G: a search that finds no further match ends at once, not again from every later position
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps = F.regexp_extract_all(text, whole, F.lit(1))
    found = F.regexp_extract_all(text, whole, F.lit(2))
    lengths = F.zip_with(
        gaps,
        found,
        lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("size"), (ok(m) if ok else F.lit(True)).alias("ok")),
    )
    return F.when(hint, lengths).otherwise(F.array().cast("array<struct<gap:bigint,size:bigint,ok:boolean>>"))


def _spans(kind: str) -> Column:
    """Spans from the column of matches of that name, ends exclusive."""
    kept = F.filter(_running(F.col(kind)), lambda x: x["ok"])
    out = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["stop"].alias("stop")))
    return F.when(F.size(kind) > 0, out).otherwise(F.array().cast(_SPAN)).alias(kind)


def _ranks(points: Column, at: Column, inclusive: bool) -> Column:
    """For each value of the ascending array at, how many points are below it (or equal to it, if inclusive)."""
    mark = lambda own: lambda x: F.struct(x.alias("value"), F.lit(own).alias("own"))
    merged = F.array_sort(F.concat(F.transform(points, mark(not inclusive)), F.transform(at, mark(inclusive))))
    placed = F.transform(merged, lambda x, i: F.struct(x["own"].alias("own"), i.alias("i")))
    return F.transform(F.filter(placed, lambda x: x["own"] == F.lit(inclusive)), lambda x, j: x["i"] - j)


def _near(parts: Column, xs: Column, reach: int) -> Column:
    """For each of xs, spans of one kind in order, whether a part is within reach: more parts begin before its end than end
    before its begin."""
    begun = _ranks(F.transform(parts, lambda y: y["start"]), F.transform(xs, lambda x: x["stop"] + reach), True)
    over = _ranks(F.transform(parts, lambda y: y["stop"]), F.transform(xs, lambda x: x["start"] - reach), False)
    return F.zip_with(begun, over, lambda a, b: a > b)


def _where(xs: Column, flags: Column) -> Column:
    both = F.zip_with(xs, flags, lambda x, f: F.struct(x.alias("x"), f.alias("f")))
    return F.transform(F.filter(both, lambda z: z["f"]), lambda z: z["x"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: its id, base_spans and weak_spans, arrays of (start, kind, stop) in listed order.

    Weak candidates: a key needs an identifier within reach, an identifier of a temporary key needs a key or an
    assigned secret, an endpoint needs both. Null text counts as empty and has no spans; repeated rows are each
    judged; an empty table gives an empty result; other columns are ignored. The work grows with the text; linking sorts the
    parts of a text, and compares no pairs of them.
    """
    text = F.col("body")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    linked = F.col("linked")
    rows = rows.withColumn("linked", F.regexp_like(text, F.lit(ANY_ID)))
    assigned = F.regexp_like(text, F.lit(ASSIGN_HINT))
    matches = rows.select(
        "doc_id",
        _matches(text, ASSIGN, assigned, lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 2)) >= ASSIGN_LEAST).alias("assign"),
        _matches(text, ACCESS, linked & F.contains(text, F.lit("AKIA"))).alias("access"),
        _matches(text, HEX, F.regexp_like(text, F.lit(HEX))).alias("hex"),
        _matches(text, WEAK_ID, linked).alias("key_id"),
        _matches(text, WEAK_KEY, linked, lambda m: F.length(m) == WEAK_KEY_LENGTH).alias("key"),
        _matches(text, ENDPOINT, linked).alias("endpoint"),
    )
    found = matches.select("doc_id", *map(_spans, KINDS))

    ids, keys = F.concat("access", "key_id"), F.concat("assign", "key")
    key_id, key, endpoint = F.col("key_id"), F.col("key"), F.col("endpoint")
    weak = F.concat(
        _where(key_id, _near(keys, key_id, reach)),
        _where(key, _near(ids, key, reach)),
        _where(endpoint, F.zip_with(_near(ids, endpoint, reach), _near(keys, endpoint, reach), lambda a, b: a & b)),
    )
    weak = F.when((F.size(ids) > 0) & (F.size(keys) > 0), weak).otherwise(F.array().cast(_SPAN))
    return found.select("doc_id", "assign", "access", "hex", F.array_sort(F.concat("assign", "access", "hex")).alias("base_spans"), F.array_sort(weak).alias("weak_spans"))


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))))
