"""Driver queries of the operators of this subpackage, each over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import language
from vantage.llm import quality
from vantage.llm import url_filter
from vantage.llm.bpe import encode_documents
from vantage.llm.decontaminate import leaks
from vantage.llm.exact_dedup import exact_duplicates
from vantage.llm.line_dedup import dedup_lines
from vantage.llm.ngram_join import near_duplicates
from vantage.llm.secrets import find_secrets, listed
from vantage.llm.shared import table
from vantage.llm.warc import archive, read_records


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base_spans", "weak_spans"))).alias("spans"),
    )


def _span_sql(kind: str, order: int, pattern: str, keep: str = "true") -> str:
    """A list of spans, the way the operator takes them: gaps and matches in turn, lengths added up."""
    quoted = pattern.replace("'", "''")
    pairs = f"list_zip(regexp_extract_all(body, '(?s)(.*?)({quoted})', 1), regexp_extract_all(body, '(?s)(.*?)({quoted})', 2))"
    return f"""
      list_transform(list_filter(list_transform({pairs},
        lambda p, i: {{'m': p[2], 'e': list_sum(list_transform({pairs}[1:i], lambda q: length(q[1]) + length(q[2])))}}),
        lambda x: {keep}),
        lambda x: {{'start': (x.e - length(x.m))::BIGINT, 'kind': {order}, 'stop': x.e::BIGINT, 'name': '{kind}'}})"""


def _op10_sql() -> str:
    from vantage.llm import secrets as s

    assign = s.ASSIGN.replace("'", "''")
    near = lambda parts, x: f"len(list_filter({parts}, lambda y: y.start <= {x}.stop + {s.REACH} AND y.stop >= {x}.start - {s.REACH})) > 0"
    text = lambda spans: f"coalesce(array_to_string(list_transform({spans}, lambda x: concat(x.name, ':', x.start, ':', x.stop)), ','), '')"
    return f"""
      WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
      parts AS (SELECT doc_id,
        {_span_sql("assign", 0, s.ASSIGN, f"length(regexp_extract(x.m, '^{assign}$', 2)) >= {s.ASSIGN_LEAST}")} AS a,
        {_span_sql("access", 1, s.ACCESS)} AS c, {_span_sql("hex", 2, s.HEX)} AS h, {_span_sql("key_id", 3, s.WEAK_ID)} AS i,
        {_span_sql("key", 4, s.WEAK_KEY, f"length(x.m) = {s.WEAK_KEY_LENGTH}")} AS k, {_span_sql("endpoint", 5, s.ENDPOINT)} AS e FROM docs),
      sets AS (SELECT *, list_concat(c, i) AS ids, list_concat(a, k) AS keys, list_sort(list_concat(list_concat(a, c), h)) AS base FROM parts),
      linked AS (SELECT *, list_concat(list_concat(list_filter(i, lambda x: {near("keys", "x")}), list_filter(k, lambda x: {near("ids", "x")})),
        list_filter(e, lambda x: {near("ids", "x")} AND {near("keys", "x")})) AS weak FROM sets)
      SELECT doc_id, len(a)::BIGINT AS n_assign, len(c)::BIGINT AS n_access, len(h)::BIGINT AS n_hex,
        sha256({text("base")}) AS base_sha256, {text("list_sort(list_concat(base, weak))")} AS spans FROM linked"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = archive(table(spark, sf_dir, "pages"))
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Where the tokenizers' files are; their package gives both by default.
TOKENIZER_FILE: str | None = None
TOKENIZER_PATTERN: str | None = None


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return TOKENIZER_FILE or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), TOKENIZER_PATTERN or public_tokenizers.PATTERN


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *tokenizer(), keep_ids=False)


def held_out() -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped", "text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.mine(pages, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op9_exact_dedup": op9_exact_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op3_warc": op3_warc,
    "op8_bpe": op8_bpe,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op7_ngram_join": op7_ngram_join,
    "op2_line_dedup": op2_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op1_url_filter": op1_url_filter,
}

SQL: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_secret_scan": _op10_sql(),
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
                     min(page_id) OVER (PARTITION BY body) AS first_id FROM p),
        r AS (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first_id END AS refers_to FROM r""",
}
