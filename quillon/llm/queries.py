"""The operators over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import encode
from quillon.llm.chat import format_chats
from quillon.llm.exact_dedup import exact_repeats
from quillon.llm.mil import quality_scores
from quillon.llm.mixing import choose
from quillon.llm.paragraphs import repeated_paragraphs
from quillon.llm.repetition import repetition
from quillon.llm.simhash import near_groups
from quillon.llm.suffixes import repeated_spans
from quillon.llm.toxicity import toxicity
from quillon.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def quality_weights(labels: DataFrame) -> DataFrame:
    """Documents labelled good weigh four times as much as those labelled bad, the rest lie between."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.when(F.max("quality") == 1, 2.0).when(F.max("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op1_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_repeats(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = choose(table(spark, sf_dir, "documents"), quality=quality_weights(table(spark, sf_dir, "labels")))
    return chosen.select("doc_id", "source", "n_tokens", "copies")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def _shipped(f: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


_ALL = (op1_paragraph_dedup, op2_quality_classifier, op3_exact_dedup, op4_mix_sources, op5_toxicity, op6_suffix_array_dedup, op7_simhash_near_dedup, op8_chat_format, op9_repetition_rules, op10_bpe)
QUERIES: dict[str, Query] = {f.__name__: _shipped(f) for f in _ALL}

SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS winner_id,
               doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_repeat
        FROM documents""",
    "op4_mix_sources": """
        WITH w AS (
          SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
          FROM labels GROUP BY doc_id),
        d AS (
          SELECT d.doc_id, d.source, len(regexp_extract_all(d.text, '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens,
                 -ln((('0x' || substr(md5('7:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / coalesce(w.weight, 1.0::DOUBLE) AS k
          FROM documents d LEFT JOIN w USING (doc_id)),
        t AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM d GROUP BY source),
        q AS (
          SELECT source, total,
                 floor((SELECT sum(total) FROM t)::DOUBLE * (1.0::DOUBLE / (SELECT count(*) FROM t)::DOUBLE))::BIGINT AS quota
          FROM t WHERE total > 0),
        p AS (
          SELECT d.*, sum(n_tokens) OVER (PARTITION BY source ORDER BY k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS prefix FROM d)
        SELECT p.doc_id, p.source, p.n_tokens,
               (q.quota // q.total + CASE WHEN p.n_tokens > 0 AND p.prefix <= q.quota % q.total THEN 1 ELSE 0 END)::BIGINT AS copies
        FROM p JOIN q USING (source)
        WHERE q.quota // q.total + CASE WHEN p.n_tokens > 0 AND p.prefix <= q.quota % q.total THEN 1 ELSE 0 END > 0""",
}
