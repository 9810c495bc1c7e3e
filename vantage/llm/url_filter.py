"""URL filters: fixed host rules first, then association rules mined from labelled pages.

Spark's FP-growth finds combinations of URL tokens that are frequent among labelled pages together with a label. Their support
and confidence are counted over all labelled pages; those that say more than chance would, and that no shorter rule makes
superfluous, are matched through an inverted index from each rule's rarest token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.shared import forget, stored

# Host, path and verdict of the rules that come first.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Labelled pages that combinations are mined from, at most about: the bound of the sample.
SAMPLE_PAGES = 100_000
#: Least labelled pages and least share of bad ones (of good ones) that a block (an allow) rule's tokens have; most tokens.
SUPPORT = 20
CONFIDENCE = 0.6
ALLOW_CONFIDENCE = 0.9
TOKENS = 4
#: Standard deviations by which a rule's pages differ from as many taken by chance, at least.
DEVIATIONS = 4.0

_BAD, _GOOD = "label:bad", "label:good"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels, or their parts if they have some; path segments; query keys. None implies another."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    named = lambda prefix, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    return F.array_distinct(
        F.concat(
            named("host:", F.filter(F.split(host, r"\."), lambda x: ~x.rlike("[-_]"))),
            named("part:", F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda x: x.rlike("[-_]")), lambda x: F.split(x, "[-_]")))),
            named("path:", F.split(F.lower(path), "/")),
            named("key:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        )
    )


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits: its host or a subdomain, a path that starts with its
    path. Null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer one overrides
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name = F.when(fits, F.lit(own + start)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class UrlRule:
    """support: labelled pages with all tokens; confidence: the share of them that the verdict suits."""

    tokens: tuple[str, ...]
    confidence: float
    support: int
    verdict: str = "block"


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, tokens, bad of every labelled page (page_id = doc_id), stored; rows that repeat an id and a url count once. A page is bad
    where any of its labels is toxic or of quality 0. Pages without an id, url or label take no part."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad"))
    urls = pages.select("page_id", "url").where("url is not null").distinct()
    known = urls.join(marks, F.col("page_id") == F.col("doc_id")).select("page_id", tokens_of(F.col("url")).alias("tokens"), "bad")
    return stored(known.where(F.size("tokens") > 0), "labelled-pages")


def mine(pages: DataFrame, labels: DataFrame, sample_pages: int = SAMPLE_PAGES, support: int = SUPPORT, confidence: float = CONFIDENCE, allow_confidence: float = ALLOW_CONFIDENCE) -> list[UrlRule]:
    """Block and allow rules from labelled pages.

    Of more than sample_pages labelled pages a hash of the id keeps about that many for FP-growth, with the least support in
    proportion, so that what it finds and the rules that come to the driver are bounded by the sample. Support and confidence
    are counted over all labelled pages and judged there, alike at every size. Without labelled pages there are no rules;
    other columns are ignored.
    """
    spark = pages.sparkSession
    known = labelled(pages, labels)
    total, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if total < support or bad in (0, total):
        return []
    share = min(1.0, sample_pages / total)
    least = max(2, int(support * share))
    sample = known.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    items = F.concat("tokens", F.array(F.when(F.col("bad") == 1, F.lit(_BAD)).otherwise(F.lit(_GOOD))))
    baskets = stored(sample.select(items.alias("items")).repartition(tasks), "baskets")
    n = baskets.count()
    if n < least:
        return []
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=1.0, numPartitions=tasks).fit(baskets)
    of = lambda label: F.coalesce(F.max(F.when(F.array_contains("items", label), F.col("freq"))), F.lit(0))
    sets = model.freqItemsets.where((F.size("items") > 1) & (F.size("items") <= TOKENS + 1) & (F.array_contains("items", _BAD) | F.array_contains("items", _GOOD)))
    found = sets.groupBy(F.array_sort(F.array_except("items", F.array(F.lit(_BAD), F.lit(_GOOD)))).alias("tokens")).agg(of(_BAD).alias("bad"), of(_GOOD).alias("good"))
    # a rule that all pages will bear out is not far below its confidence in the sample
    near = (F.col("bad") >= 0.9 * confidence * (F.col("bad") + F.col("good"))) | (F.col("good") >= 0.9 * allow_confidence * (F.col("bad") + F.col("good")))
    candidates = [tuple(r["tokens"]) for r in found.where(near).select("tokens").collect()]
    rules = []
    for tokens, pages_with, bad_with in counted(known, candidates):
        if pages_with < support:
            continue
        for verdict, hits, rate, wanted in (("block", bad_with, bad / total, confidence), ("allow", pages_with - bad_with, 1 - bad / total, allow_confidence)):
            beyond = (hits - pages_with * rate) / math.sqrt(pages_with * rate * (1 - rate))
            if hits >= wanted * pages_with and beyond >= DEVIATIONS:
                rules.append(UrlRule(tokens, hits / pages_with, pages_with, verdict))
    often = {t: 0 for r in rules for t in r.tokens}
    for (t,), n, _ in counted(known, [(t,) for t in often]):
        often[t] = n
    forget(known, baskets)
    return pruned(rules, often)


def counted(known: DataFrame, sets: list[tuple[str, ...]]) -> list[tuple[tuple[str, ...], int, int]]:
    """Each set of tokens, the labelled pages that have them all, and the bad ones of these."""
    if not sets:
        return []
    index: dict[str, list[tuple[int, frozenset[str]]]] = {}
    for k, tokens in enumerate(sets):
        index.setdefault(tokens[0], []).append((k, frozenset(tokens)))

    def match(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bad = [0] * len(sets), [0] * len(sets)
        for part in parts:
            for tokens, is_bad in zip(part.column("tokens").to_pylist(), part.column("bad").to_pylist(), strict=True):
                own = set(tokens)
                for token in own:
                    for k, needed in index.get(token, ()):
                        if needed <= own:
                            total[k] += 1
                            bad[k] += is_bad
        some = [k for k, n in enumerate(total) if n]
        yield pa.record_batch({"k": pa.array(some, pa.int32()), "n": pa.array([total[k] for k in some], pa.int64()), "bad": pa.array([bad[k] for k in some], pa.int64())})

    rows = known.select("tokens", "bad").mapInArrow(match, "k int, n long, bad long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).orderBy("k").collect()
    return [(sets[r["k"]], r["n"], r["bad"]) for r in rows]


def pruned(rules: list[UrlRule], often: dict[str, int]) -> list[UrlRule]:
    """Without rules that contain another of the same verdict and the same or higher confidence; each with its rarest token
    first."""
    kept: dict[tuple[str, frozenset[str]], float] = {}
    out = []
    for rule in sorted(rules, key=lambda r: (len(r.tokens), r.tokens, r.verdict)):
        subsets = [frozenset(t for k, t in enumerate(rule.tokens) if m >> k & 1) for m in range(1, 1 << len(rule.tokens))]
        if not any(kept.get((rule.verdict, s), -1.0) >= rule.confidence for s in subsets):
            kept[rule.verdict, frozenset(rule.tokens)] = rule.confidence
            out.append(replace(rule, tokens=tuple(sorted(rule.tokens, key=lambda t: (often.get(t, 0), t)))))
    return out


def judge(pages: DataFrame, mined: list[UrlRule], id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, matched (tokens of the mined rule that decided) for every row.

    Without a fixed rule the most confident of the mined rules whose tokens are all in the url decides (of equally confident
    ones a block rule), and is named; a page that none fits is allowed. A null url, or one without ://, has an empty host and path and no tokens and is allowed.
    Repeated rows get equal answers; an empty table gives an empty result; other columns are ignored.
    """
    index: dict[str, list[tuple[frozenset[str], tuple[float, bool, str]]]] = {}
    for rule in mined:
        index.setdefault(rule.tokens[0], []).append((frozenset(rule.tokens), (rule.confidence, rule.verdict == "block", " ".join(sorted(rule.tokens)))))
    url = F.col(url_col)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "tokens")

    def match(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for tokens in part.column("tokens").to_pylist():
                own = set(tokens or ())
                out.append(max((says for token in own for needed, says in index.get(token, ()) if needed <= own), default=None))
            said = pa.array([x and x[2] for x in out], pa.string())
            blocks = pa.array([x and x[1] for x in out], pa.bool_())
            yield pa.record_batch([*part.columns[:-1], said, blocks], names=[*part.schema.names[:-1], "matched", "blocks"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("matched", T.StringType()), T.StructField("blocks", T.BooleanType())])
    judged = rows.mapInArrow(match, schema)
    by_method = F.when(F.col("blocks"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), F.when(F.col("rule").isNull(), F.col("matched")).alias("matched"))
