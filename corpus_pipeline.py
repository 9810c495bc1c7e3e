"""A corpus pipeline over documents: language, repeated lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before it kept; run() writes each stage's result to
shared storage as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import language
from vantage.llm.bpe import encode_documents
from vantage.llm.decontaminate import decontaminated
from vantage.llm.line_dedup import dedup_lines
from vantage.llm.ngram_join import near_duplicates
from vantage.llm.queries import held_out, tokenizer
from vantage.llm.shared import small, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is recognised: null texts and texts without a letter. lang stays as it was; without a
    labelled document nothing is recognised."""
    judged = language.identify(docs.select(*COLUMNS), language.fit(docs.where(~held_out())))
    return judged.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated and similar lines out, and drops documents that have only blanks left by it; n_chars follows the text. Null,
    empty and blank texts stay; rows that repeat an id and a text are treated as one and stay both."""
    cleaned = dedup_lines(docs.select(*COLUMNS))
    kept = cleaned.where((F.size("dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0d]"))
    length = F.when(F.size("dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, and all that are in none. Rows that repeat that id, and
    rows without an id, stay."""
    groups = near_duplicates(docs)
    copies = stored(groups.where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct(), "copies")
    return docs.select(*COLUMNS).join(F.broadcast(copies) if small(copies) else copies, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text overlaps with a benchmark item, with or without an id."""
    return decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: ids, their number and digests of ids and of the decoded bytes. A null text counts as empty."""
    return encode_documents(docs, *tokenizer()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL cannot express a suffix automaton, MinHash components or merges by rank; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
