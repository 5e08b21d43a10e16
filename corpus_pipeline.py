"""From raw documents to token ids: reject bad documents, drop exact and near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's docs. All but the last keep the columns of docs, whatever else those hold. Texts of any
length go through whole; an empty table stays empty. Nulls, ties and repeated rows are as each stage says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.bpe import encode
from quillon.llm.exact_dedup import drop_repeats
from quillon.llm.mil import keep_good
from quillon.llm.mixing import mix_sources
from quillon.llm.queries import quality_weights
from quillon.llm.simhash import drop_near_copies
from quillon.session import discard, materialize, ship, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention-based classifier doesn't reject. Null and empty texts go; null ids and repeated rows are judged like others."""
    ship(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, with the least id. Rows whose id or text is null stay; of rows that share both one stays."""
    ship(spark)
    return drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with the least id. Null and empty texts are alone; null ids stay; rows that share an id share its fate."""
    ship(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, the same for each source: whole epochs, then a weighted sample.

    A null source is one of its own; texts without tokens come with whole epochs alone; equal keys go by id;
    repeated rows are one document.
    """
    ship(spark)
    return mix_sources(docs, quality=quality_weights(table(spark, sf_dir, "labels")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, repeated ones too; null and empty texts have none."""
    ship(spark)
    return encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixing),
    ("bpe", tokens),
]

#: SQL expresses neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the whole table of documents, each stage's rows written to the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            discard(spark, before)
        before = path
    return docs
