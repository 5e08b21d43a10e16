"""Search by substring and by regular expression over stored texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.regex import count_matches


def overlapping(text: Column, pattern: str) -> Column:
    """Occurrences of a literal in a text, overlapping ones too: a lookahead matches without consuming."""
    if not pattern:
        return F.lit(0)
    return F.regexp_count(text, F.lit("(?=" + "".join(f"\\x{{{ord(c):X}}}" for c in pattern) + ")"))


def substring_search(corpus: DataFrame, pattern: str, k: int = 10, straddling: bool = False) -> DataFrame:
    """(ord, score): documents by occurrences of a literal, case and all, in title and text put together.

    straddling also counts matches that begin in a document and end in the next one's text.
    """
    if not pattern:
        return corpus.select("ord", F.lit(0).cast("long").alias("score")).filter("false")
    whole = F.concat("title", "text")
    rows = corpus.filter(F.contains(whole, F.lit(pattern))).select("ord", overlapping(whole, pattern).cast("long").alias("score"))
    if straddling and len(pattern) > 1:
        # ends and beginnings alone are moved: every document hands its beginning to as many before it as a match can reach back over
        reach = len(pattern) - 1
        ends = corpus.select("ord", F.substring(whole, 1, reach).alias("head"), F.right(whole, F.lit(reach)).alias("tail"))
        heads = ends.select("head", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("j"), "ord").filter("head <> ''")
        after = heads.groupBy((F.col("ord") - F.col("j")).alias("ord")).agg(F.array_sort(F.collect_list(F.struct("j", "head"))).alias("x"))
        after = after.select("ord", F.substring(F.array_join(F.transform("x", lambda x: x["head"]), ""), 1, reach).alias("after"))
        over = F.concat("tail", "after")
        crossing = ends.filter("tail <> ''").join(after, "ord").filter(F.contains(over, F.lit(pattern))).select("ord", overlapping(over, pattern).cast("long").alias("score"))
        rows = rows.union(crossing).groupBy("ord").agg(F.sum("score").alias("score"))
    return rows.orderBy(F.desc("score"), "ord").limit(k)


def locate(corpus: DataFrame, pattern: str) -> DataFrame:
    """(ord, at): byte offset of every occurrence of a literal in title and text put together, overlapping ones too."""
    view = F.decode(F.encode(F.concat("title", "text"), "UTF-8"), "ISO-8859-1")
    wanted = F.lit(pattern.encode().decode("latin-1"))
    held = corpus.filter(F.contains(F.concat("title", "text"), F.lit(pattern))).select("ord", view.alias("v"))
    pieces = F.split(F.col("v"), "(?=" + "".join(f"\\x{{{c:X}}}" for c in pattern.encode()) + ")", -1)
    size = F.explode(F.arrays_zip(F.col("p"), F.sequence(F.lit(0), F.size("p") - 1).alias("n")))
    each = held.select("ord", "v", pieces.alias("p")).select("ord", size.alias("x"), F.size("p").alias("parts"), F.startswith("v", wanted).alias("head"))
    upto = Window.partitionBy("ord").orderBy("x.n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("x.p")).over(upto), F.lit(0))
    return each.select("ord", "head", F.col("x.n").alias("n"), at.cast("long").alias("at")).filter("n > 0 or head").select("ord", "at")


def offset_to_doc(spans: DataFrame, offsets: DataFrame, width: int = 4096) -> DataFrame:
    """offsets (at) with the document (start, end, ord) whose bytes hold them: a range join on blocks of `width` bytes."""
    blocks = spans.filter("end > start").withColumn("block", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))))
    asked = offsets.withColumn("block", F.expr(f"at div {width}"))
    return asked.join(blocks, "block").filter("at >= start and at < end").select("at", "ord")


def safe_for_java(pattern: str) -> bool:
    """Whether the JVM's leftmost-first regex gives the same matches: one class or literal run, at most repeated by +."""
    return bool(re.fullmatch(r"\[[A-Za-z0-9_ -]+\]\+?|\\d\+?|[A-Za-z0-9 ]+", pattern))


def regex_search(corpus: DataFrame, pattern: str, k: int = 10) -> DataFrame:
    """(ord, score): documents by leftmost-longest matches in title and in text, counted apart."""
    if safe_for_java(pattern):
        jvm = F.lit(pattern.replace("\\d", "[0-9]"))
        score = F.regexp_count("title", jvm) + F.regexp_count("text", jvm)
    else:
        score = count_matches(F.col("title"), pattern) + count_matches(F.col("text"), pattern)
    rows = corpus.select("ord", score.cast("long").alias("score")).filter("score > 0")
    return rows.orderBy(F.desc("score"), "ord").limit(k)
