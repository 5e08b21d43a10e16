"""Term lookup by prefix and edit distance, and spelling suggestions, over a lexicon (term, doc_freq)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.regex import full_match
from quillon.functions.snippet import analyze
from quillon.functions.text import byte_view, edit_distance, fold_py

_LAST = "\U0010ffff"


def prefix_terms(lexicon: DataFrame, prefix: str, most: int) -> DataFrame:
    """The first `most` terms with a prefix, in depth-first order: shorter before longer, siblings in descending byte order."""
    found = lexicon.filter(F.col("term").startswith(prefix))
    return found.orderBy(F.concat("term", F.lit(_LAST)).desc()).limit(most)


def accepted_terms(lexicon: DataFrame, pattern: str) -> DataFrame:
    """The terms that an automaton accepts whole, of the byte regex dialect."""
    return lexicon.filter(full_match(F.col("term"), pattern))


def prefix_suggest(lexicon: DataFrame, prefix: str, k: int = 10, exact: bool = False) -> DataFrame:
    """(term, doc_freq, edit_distance, score): of the first 2k terms with the prefix (all, if exact) the k most frequent."""
    if not prefix:
        return _suggestions(lexicon.filter("false"), F.lit(0))
    folded = fold_py(prefix)
    found = lexicon.filter(F.col("term").startswith(folded)) if exact else prefix_terms(lexicon, folded, 2 * k)
    return _suggestions(found, F.lit(0)).orderBy(F.desc("doc_freq"), "term").limit(k)


def _suggestions(found: DataFrame, distance: Column) -> DataFrame:
    found = found.withColumn("edit_distance", distance.cast("int"))
    return found.select("term", F.col("doc_freq").cast("long").alias("doc_freq"), "edit_distance", (F.col("doc_freq") / (F.col("edit_distance") + 1.0)).alias("score"))


def near_terms(lexicon: DataFrame, words: DataFrame, distance: int, most: int) -> DataFrame:
    """words (slot, word) with their `most` terms within an edit distance over bytes: by distance, frequency, term.

    The few words are broadcast; lengths filter before distances are computed, and a window
    keeps the best of each word.
    """
    sized = lexicon.select("term", "doc_freq", F.octet_length("term").alias("size"))
    asked = F.broadcast(words.select("slot", "word", F.octet_length("word").alias("word_size")))  # a query's words
    close = sized.join(asked, F.abs(F.col("size") - F.col("word_size")) <= distance)
    close = close.withColumn("edit_distance", edit_distance(F.col("term"), F.col("word"), distance)).filter("edit_distance >= 0")
    best = Window.partitionBy("slot").orderBy("edit_distance", F.desc("doc_freq"), "term")
    return close.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).select("slot", "word", "r", "term", "doc_freq", "edit_distance")


def deletion_keys(word: Column, distance: int) -> Column:
    """Every string left when up to `distance` bytes of a word are deleted: words at most that far apart share one."""
    view = byte_view(word)
    once = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    keys = F.array(view)
    for _ in range(distance):
        keys = F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, once))))
    return keys


def near_terms_batch(lexicon: DataFrame, words: DataFrame, distance: int, most: int) -> DataFrame:
    """near_terms() for any number of words: an equi-join on deletion keys finds the candidates, so no side is broadcast."""
    left = lexicon.select("term", "doc_freq", F.explode(deletion_keys(F.col("term"), distance)).alias("k"))
    right = words.select("slot", "word", F.explode(deletion_keys(F.col("word"), distance)).alias("k"))
    pairs = left.join(right, "k").select("slot", "word", "term", "doc_freq").distinct()
    close = pairs.withColumn("edit_distance", edit_distance(F.col("term"), F.col("word"), distance)).filter("edit_distance >= 0")
    best = Window.partitionBy("slot").orderBy("edit_distance", F.desc("doc_freq"), "term")
    return close.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).select("slot", "word", "r", "term", "doc_freq", "edit_distance")


def _words(lexicon: DataFrame, words: Sequence[str]) -> DataFrame:
    return lexicon.sparkSession.createDataFrame(list(enumerate(words)), "slot int, word string")


def fuzzy_suggest(lexicon: DataFrame, word: str, distance: int = 2, k: int = 10) -> DataFrame:
    found = near_terms(lexicon, _words(lexicon, [fold_py(word)] if word else []), distance, k)
    return _suggestions(found, F.col("edit_distance")).orderBy("edit_distance", F.desc("doc_freq"), "term")


def fuzzy_expansions(lexicon: DataFrame, terms: Sequence[str], distance: int, each: int = 10, most: int = 50) -> DataFrame:
    """(slot, term): up to `each` near terms of every query term, the first of equals, `most` in all."""
    found = near_terms(lexicon, _words(lexicon, terms), distance, each)
    first = found.withColumn("again", F.row_number().over(Window.partitionBy("term").orderBy("slot", "r"))).filter("again = 1")
    return first.orderBy("slot", "r").limit(most).select("slot", "term")


def did_you_mean(lexicon: DataFrame, query: str) -> DataFrame:
    """(suggestion): unknown words replaced by their nearest terms; "" if nothing changes, the query if it has no words."""
    spark = lexicon.sparkSession
    words = [t[0] for t in analyze(query, stemming=False, stopwords=frozenset())]
    if not words:
        return spark.createDataFrame([(query,)], "suggestion string")
    asked = _words(lexicon, words)
    unknown = asked.join(lexicon.select(F.col("term").alias("word")), "word", "left_anti")
    best = near_terms(lexicon, unknown, 2, 1).select("slot", F.col("term").alias("better"))
    chosen = asked.join(F.broadcast(best), "slot", "left")  # the query's words
    parts = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("better", "word").alias("w"))))
    changed = F.max(F.when(F.col("better").isNotNull() & (F.col("better") != F.col("word")), 1).otherwise(0))
    return chosen.agg(F.when(changed == 1, F.array_join(F.transform(parts, lambda x: x["w"]), " ")).otherwise("").alias("suggestion"))
