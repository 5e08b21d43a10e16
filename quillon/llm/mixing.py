"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Within a source the documents are ordered by -ln(u) / quality weight, u a hash of the
id, and their tokens prefix-summed. A source whose budget is above its tokens is first
taken whole as often as it fits; what remains is filled by the longest prefix that fits.
Spark's range partitioning cuts (source, key) at quantiles that it samples, so that prefix sums are
those of sorted ranges plus the sums of the ranges before them: a hot source, and whatever weights,
are spread evenly over the tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.names import fresh
from quillon.plans.index import ranged
from quillon.session import materialize

_NONE = "\x00none"


def token_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """Exponential key of rate `weight` from an md5 of seed and id; the least keys are taken first."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / weight


def _unit(text: Column) -> list[Column]:
    """96 bits that name a document: its id, source and text, with nulls told apart."""
    parts = [F.col("doc_id"), F.col("doc_id").isNull(), F.col("source"), F.col("source").isNull(), text]
    return [F.xxhash64(*parts), F.hash(*parts)]


def choose(docs: DataFrame, shares: Mapping[str, float] | None = None, budget: int | None = None, quality: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """(unit, unit2, doc_id, source, n_tokens, copies) of the chosen documents; texts are read, not shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.select(*(c.alias(n) for c, n in zip(_unit(F.col("text")), ("unit", "unit2"), strict=True)), "doc_id", "source", token_count(F.col("text")).alias("n"))
    rows = rows.groupBy("unit", "unit2").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.sum("n").alias("n"))
    if quality is not None:
        given = quality.select(F.col("doc_id").alias("own"), F.col("weight").cast("double").alias("w")).groupBy("own").agg(F.max("w").alias("w"))
        rows = rows.join(given, F.col("doc_id") == F.col("own"), "left").drop("own").withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    rows = rows.withColumns({"src": F.coalesce("source", F.lit(_NONE)), "k": sampling_key(F.col("doc_id"), F.col("w"), seed)})
    rows, _ = materialize(ranged(rows, "src", "k", "doc_id", "n", "unit", "unit2"), "sampling-keys")
    sums = rows.groupBy("src", "run").agg(F.sum("n").alias("part"))
    sums = sums.withColumns({"before": F.sum("part").over(Window.partitionBy("src").orderBy("run")) - F.col("part"), "total": F.sum("part").over(Window.partitionBy("src"))})
    totals = rows.groupBy("src").agg(F.sum("n").alias("total"))
    if shares is None:
        totals = totals.withColumn("share", F.lit(1.0))
    else:
        totals = totals.join(docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in shares.items()], "src string, share double"), "src")
    whole = rows.agg(F.sum("n").alias("quota")) if budget is None else docs.sparkSession.range(1).select(F.lit(int(budget)).cast("long").alias("quota"))
    totals = totals.crossJoin(whole.crossJoin(totals.agg(F.sum("share").alias("shares"))))  # one row
    totals = totals.filter("total > 0").withColumn("quota", F.floor(F.col("quota") * (F.col("share") / F.col("shares"))).cast("long"))
    totals = totals.select("src", F.expr("quota div total").alias("epochs"), F.expr("quota % total").alias("left"))
    sums = sums.select("src", "run", "before").join(totals, "src")
    within = Window.partitionBy("src", "run").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, ["src", "run"]).withColumn("prefix", F.col("before") + F.sum("n").over(within))
    taken = F.col("epochs") + F.when((F.col("n") > 0) & (F.col("prefix") <= F.col("left")), 1).otherwise(0)
    return rows.withColumn("copies", taken).filter("copies > 0").select("unit", "unit2", "doc_id", "source", F.col("n").alias("n_tokens"), "copies")


def mix_sources(docs: DataFrame, shares: Mapping[str, float] | None = None, budget: int | None = None, quality: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """The chosen rows of docs (doc_id, text, source and others), each as often as it is to be read.

    shares: a target weight for each source, scaled to sum to one over the sources at hand
    (a source without one gets nothing; None: all equal). budget: tokens in all (None: as many
    as docs has). quality: (doc_id, weight) rows, weight > 0; where absent or null 1.

    A row comes once for each complete epoch of its source, and once more if it is in the
    fractional prefix. A null source is a source of its own; a null or empty text has no tokens
    and comes with complete epochs alone; a source without tokens gives nothing. Rows that
    repeat id, source and text are one document, whose tokens are those of all its rows;
    equal keys are ordered by id, then by tokens. A text of any length is counted by Spark's own
    expressions. An empty table gives an empty result. docs keeps its columns, whatever their names; texts
    are shuffled once.
    """
    u, v, copies, one = fresh(docs, "mix_unit", "mix_unit2", "mix_copies", "mix_copy")
    chosen = choose(docs, shares, budget, quality, seed).select(F.col("unit").alias(u), F.col("unit2").alias(v), F.col("copies").alias(copies))
    typed = docs.select("*", *(c.alias(n) for c, n in zip(_unit(F.col("text").cast("string")), (u, v), strict=True)))
    return typed.join(chosen, [u, v]).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
