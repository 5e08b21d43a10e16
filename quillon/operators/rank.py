"""Ranked retrieval: a table of queries is evaluated in one plan of joins and aggregations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quillon.functions import codecs
from quillon.functions.porter import stem
from quillon.functions.snippet import analyze
from quillon.functions.text import fold_py
from quillon.plans.index import BLOCK, Index, bm25, idf
from quillon.plans.parser import ParsedQuery, parse
from quillon.session import materialize

DIGITS = 6
#: Terms up to which a lookup is a predicate, too.
MOST_PUSHED = 500
#: Blocks of a query's terms up to which they are pruned on the driver (some 40 bytes each).
MOST_BLOCKS = 2_000_000
#: Postings from which pruning is tried, and ranges of documents for which bounds are summed.
LEAST_POSTINGS, CELLS = 1_000_000, 1 << 16
#: Terms of a batch of queries up to which they are broadcast (some 100 bytes each), and documents that are scored together then.
MOST_TERMS, CELL = 100_000, 1 << 14
_TERMS = "query_id long, kind string, role string, slot int, place int, n int, raw string, stemmed string"
_HITS = "query_id long, rank int, ord long, score double"


def _term_rows(query_id: int, q: ParsedQuery) -> list[tuple]:
    chosen = q.phrase if q.kind == "phrase" else q.positive
    places = q.phrase_places if q.kind == "phrase" else range(len(chosen))
    rows = [(query_id, q.kind, "+", slot, int(place), len(chosen), t, stem(fold_py(t))) for slot, (t, place) in enumerate(zip(chosen, places, strict=True))]
    return rows + [(query_id, q.kind, "-", slot, 0, len(q.negative), t, stem(fold_py(t))) for slot, t in enumerate(q.negative)]


def query_terms(index: Index, queries: Sequence[tuple[int, ParsedQuery]]) -> DataFrame:
    """One row for each term of parsed queries, small as the queries are."""
    return index.corpus.sparkSession.createDataFrame([r for query_id, q in queries for r in _term_rows(query_id, q)], _TERMS)


def _only(table: DataFrame, names: set[str] | None) -> DataFrame:
    """table's rows of some terms, as a predicate that reaches the Parquet scan (sorted by term) if they are few."""
    return table.filter(F.col("term").isin(sorted(names))) if names and len(names) <= MOST_PUSHED else table


def _names(queries: Sequence[tuple[int, ParsedQuery]]) -> set[str]:
    words = {t for _, q in queries for t in (*q.positive, *q.negative, *q.phrase)}
    return words | {stem(fold_py(t)) for t in words}


def resolve(index: Index, terms: DataFrame, names: set[str] | None = None, small: bool = True) -> DataFrame:
    """terms with the index's term: as it is, else stemmed once more; unknown ones are left out."""
    hint = F.broadcast if small else lambda x: x
    if not index.stemming:
        known = terms.join(_only(index.lexicon, names).select(F.col("term").alias("raw")), "raw", "left_semi")
        return known.withColumn("term", F.col("raw"))
    words = terms.select(F.explode(F.array_distinct(F.array("raw", "stemmed"))).alias("term")).distinct()
    have = hint(_only(index.lexicon, names).join(hint(words), "term", "left_semi").select("term"))  # at most the queries' words
    direct = have.select(F.col("term").alias("raw"), F.col("term").alias("hit1"))
    again = have.select(F.col("term").alias("stemmed"), F.col("term").alias("hit2"))
    return terms.join(direct, "raw", "left").join(again, "stemmed", "left").withColumn("term", F.coalesce("hit1", "hit2")).drop("hit1", "hit2").filter("term is not null")


def _looked_up(index: Index, parsed: Sequence[tuple[int, ParsedQuery]], names: set[str]) -> DataFrame:
    """query_terms as resolve gives them, with doc_freq and idf, of few terms: one look at the lexicon, no joins."""
    got = {r["term"]: r for r in _only(index.lexicon, names).select("term", "doc_freq", "idf").collect()}  # at most the queries' terms
    rows = []
    for query_id, q in parsed:
        chosen = q.phrase if q.kind == "phrase" else q.positive
        places = q.phrase_places if q.kind == "phrase" else range(len(chosen))
        each = [("+", slot, int(place), len(chosen), t) for slot, (t, place) in enumerate(zip(chosen, places, strict=True))]
        for role, slot, place, n, t in each + [("-", k, 0, len(q.negative), t) for k, t in enumerate(q.negative)]:
            hit = got.get(t) or (got.get(stem(fold_py(t))) if index.stemming else None)
            if hit:
                rows.append((query_id, q.kind, role, slot, place, n, hit["term"], hit["doc_freq"], hit["idf"]))
    return index.corpus.sparkSession.createDataFrame(rows, "query_id long, kind string, role string, slot int, place int, n int, term string, doc_freq long, idf double")


def _parsed(index: Index, q: str | ParsedQuery) -> ParsedQuery:
    return q if isinstance(q, ParsedQuery) else parse(q, index.stemming, index.stopwords)


def evaluate(index: Index, queries: Sequence[tuple[int, str | ParsedQuery]], k: int = 10, strict_phrase: bool = False, gaps: bool = False) -> DataFrame:
    """(query_id, rank, ord, score) of the best k documents of each query.

    A query's kind decides: any of its terms (or), all (and), or a phrase. Scores are rounded before
    they are ranked; equal ones go by ord. strict_phrase also requires the phrase where
    words stand beside it; gaps lets stop words inside a phrase count as places.
    """
    parsed = [(i, _parsed(index, q)) for i, q in queries]
    names = _names(parsed)
    small = len(names) <= MOST_PUSHED
    terms_of = (lambda own: _looked_up(index, own, names)) if small else (lambda own: _weighed(index, resolve(index, query_terms(index, own), names), True))
    terms = terms_of(parsed)
    hits = _scored(index, terms, gaps, names, {q.kind for _, q in parsed})
    extra = [(i, q._replace(positive=[])) for i, q in parsed if q.phrase and q.positive] if strict_phrase else []
    if extra:
        hits = hits.join(_scored(index, terms_of(extra), gaps, names).select("query_id", "ord"), ["query_id", "ord"], "left_semi").union(hits.join(F.broadcast(index.corpus.sparkSession.createDataFrame([(i,) for i, _ in extra], "query_id long")), "query_id", "left_anti"))  # a row for each query
    if any(q.negative for _, q in parsed):
        hits = _without(index, hits, terms, names)
    return best_of_one(hits, k) if len(parsed) == 1 else top_k(hits, k)


def evaluate_frame(index: Index, queries: DataFrame, k: int = 10, any_term: bool = False) -> DataFrame:
    """As evaluate, for a table (query_id, query) of any length: parsed by its tasks, and joined.

    any_term takes a text's words, whatever its signs, and asks for any of them. Up to MOST_TERMS
    terms go to all tasks, which score queries of words by ranges of documents; more are shuffled. Null queries have no hits.
    """
    stemming, stopwords = index.stemming, index.stopwords

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, text in zip(batch["query_id"], batch["query"], strict=True):
                q = ParsedQuery(list(dict.fromkeys(t[0] for t in analyze(text, stemming, stopwords))), [], [], [], True) if any_term else parse(text, stemming, stopwords)
                rows += _term_rows(query_id, q)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TERMS.split(", ")])

    found = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("string").alias("query")).dropna().mapInPandas(terms, _TERMS)
    found, _ = materialize(found, "query-terms")
    kinds = {r[0] for r in found.select("kind").distinct().collect()}  # at most four
    small = found.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    best = []
    if small:
        best.append(_best_by_words(index, found.filter("kind in ('or', 'and')").collect(), k))  # at most MOST_TERMS rows
        found, kinds = found.filter("kind = 'phrase'"), kinds & {"phrase"}
    if kinds:
        found = _weighed(index, resolve(index, found, None, small), small)
        best.append(top_k(_without(index, _scored(index, found, False, None, kinds, small), found, None, small), k))
    return best[0] if len(best) == 1 else best[0].unionByName(best[1])


def _packed_cells(width: int):  # noqa: ANN202
    """Postings (no, ord, tf, length) as a row for each stretch of one term in one cell of `width` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, ord_, tf, length = (c.to_numpy().astype(np.int64) for c in batch.columns)
            cell = ord_ // width
            first = np.flatnonzero(np.append(True, (no[1:] != no[:-1]) | (cell[1:] != cell[:-1]) | (ord_[1:] <= ord_[:-1]))) if len(no) else np.zeros(0, np.int64)
            step = np.append(0, np.diff(ord_))[: len(no)]
            step[first] = ord_[first] - cell[first] * width
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(no[first].astype(np.int32)), codecs.varint_rows(np.stack([step, tf, length], 1).ravel(), np.append(first, len(no)) * 3)], ["cell", "no", "postings"])

    return run


def _best_by_words(index: Index, terms: Sequence[Row], k: int) -> DataFrame:
    """top_k of the queries that ask for any or all of their words: a posting is moved once, however many queries have its term.

    The postings of the queries' terms are brought together by cells of CELL documents; there all
    queries are scored, and the best k of each and whatever rounding may lift to them go on.
    """
    spark = index.corpus.sparkSession
    names = {t for r in terms for t in ((r["raw"], r["stemmed"]) if index.stemming else (r["raw"],))}
    asked = spark.createDataFrame([(t,) for t in sorted(names)], "term string")
    got = {r["term"]: r["idf"] for r in index.lexicon.join(F.broadcast(asked), "term").select("term", "idf").collect()}  # at most the queries' terms
    number = {t: n for n, t in enumerate(sorted(got))}
    queries: dict[tuple, tuple[list[int], list[int]]] = {}
    for r in terms:
        t = r["raw"] if r["raw"] in got else r["stemmed"] if index.stemming else None
        if t in got:
            queries.setdefault((r["query_id"], r["kind"], r["n"] if r["role"] == "+" else None), ([], []))[r["role"] == "-"].append(number[t])
    without = {(q, kind): out for (q, kind, n), (_, out) in queries.items() if n is None}
    wanted = [(q, n if kind == "and" else 1, own, without.get((q, kind), [])) for (q, kind, n), (own, _) in queries.items() if n is not None]
    weight = np.array([got[t] for t in number])
    k1, b, average, width = index.k1, index.b, index.average, CELL

    def best(table: pa.Table) -> pa.Table:
        values, at = codecs.varint_flat(table["postings"].combine_chunks())
        step, tf, length = values.reshape(-1, 3).T
        first = at // 3
        total = np.append(0, np.cumsum(step))
        size = np.diff(first)
        doc = total[1:] - np.repeat(total[first[:-1]], size)
        no = table["no"].to_numpy()
        part = tf + k1 * (1 - b + b * (length / average if average > 0 else 1.0))
        score = weight[np.repeat(no, size)] * (tf * (k1 + 1)) / np.where(part > 0, part, 1.0)
        lists: dict[int, list[slice]] = {}
        for n, a, z in zip(no.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            lists.setdefault(n, []).append(slice(a, z))
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q, need, own, minus in wanted:
            sums, have = np.zeros(width), np.zeros(width, np.int32)
            for t in own:
                for s in lists.get(t, ()):
                    sums[doc[s]] += score[s]
                    have[doc[s]] += 1
            for t in minus:
                for s in lists.get(t, ()):
                    have[doc[s]] = 0
            hit = np.flatnonzero(have >= need)
            unit = sums[hit] * 10.0**DIGITS + 0.5
            near = np.abs(unit - np.rint(unit)) < 1e-3  # Spark may round it otherwise
            whole = np.floor(unit)
            sure = np.flatnonzero(~near)
            sure = sure[np.argsort(-whole[sure], kind="stable")[:k]]
            low = whole[sure[-1]] - 1 if len(sure) == k else -1.0
            hit = hit[np.concatenate([sure, np.flatnonzero(near & (whole >= low))])]
            out.append((q, hit, sums[hit]))
        start = table["cell"][0].as_py() * width
        sizes = [len(h) for _, h, _ in out]
        return pa.table({"query_id": np.repeat(np.array([q for q, *_ in out], np.int64), sizes), "ord": np.concatenate([h for _, h, _ in out]) + start, "score": np.concatenate([x for *_, x in out])})

    if not wanted or k <= 0:
        return spark.createDataFrame([], _HITS)
    numbers = F.broadcast(spark.createDataFrame(list(number.items()), "term string, no int"))  # the queries' terms
    cells = _only(index.postings, set(got)).join(numbers, "term").select("no", "ord", "tf", "length").mapInArrow(_packed_cells(CELL), "cell long, no int, postings binary")
    hits = cells.groupBy("cell").applyInArrow(best, "query_id long, ord long, score double")
    return top_k(hits.select("query_id", "ord", F.round("score", DIGITS).alias("score")), k)


def _weighed(index: Index, terms: DataFrame, small: bool) -> DataFrame:
    hint = F.broadcast if small else lambda x: x
    return index.lexicon.select("term", "doc_freq", "idf").join(hint(terms), "term")


def _without(index: Index, hits: DataFrame, terms: DataFrame, names: set[str] | None, small: bool = True) -> DataFrame:
    hint = F.broadcast if small else lambda x: x
    out = terms.filter("role = '-'").select("query_id", "term")
    return hits.join(_only(index.postings, names).select("term", "ord").join(hint(out), "term").select("query_id", "ord"), ["query_id", "ord"], "left_anti")


def best_of_one(hits: DataFrame, k: int) -> DataFrame:
    """top_k of a single query: each task keeps its best k."""
    best = hits.orderBy(F.desc("score"), "ord").limit(k)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "ord"))  # k rows
    return best.select("query_id", place.cast("int").alias("rank"), "ord", "score")


def top_k(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "ord", "score")


def _scored(index: Index, terms: DataFrame, gaps: bool, names: set[str] | None, kinds: set[str] | None = None, small: bool = True) -> DataFrame:
    """(query_id, ord, score) of the documents that a query's terms select; small: the terms are few enough to be broadcast."""
    hint = F.broadcast if small else lambda x: x
    wanted = hint(terms.filter("role = '+'").select("query_id", "kind", "slot", "place", "n", "term", "doc_freq", "idf"))  # the queries' terms
    found = _only(index.postings, names).join(wanted, "term")
    score = bm25(F.col("tf"), F.col("length"), F.lit(index.average), F.col("idf"), index.k1, index.b)
    words = found.filter("kind <> 'phrase'").select("query_id", "kind", "ord", "n", score.alias("score")).groupBy("query_id", "kind", "ord", "n").agg(F.sum("score").alias("score"), F.count("*").alias("have"))
    words = words.filter("kind = 'or' or have = n").select("query_id", "ord", F.round("score", DIGITS).alias("score"))
    kinds = kinds or {"or", "and", "phrase"}
    if "phrase" not in kinds:
        return words
    phrases = _phrases(index, found.filter("kind = 'phrase'"), gaps)
    return words.unionByName(phrases) if kinds - {"phrase", "none"} else phrases


def _phrases(index: Index, found: DataFrame, gaps: bool) -> DataFrame:
    """Positions are shifted to where the phrase would begin; a beginning that all terms share is a match."""
    place = "place" if gaps else "slot"
    begins = found.select("query_id", "ord", "n", "slot", "length", "doc_freq", F.explode(F.transform("positions", lambda x: x - F.col(place))).alias("begin"))
    whole = begins.groupBy("query_id", "ord", "n", "begin").agg(F.countDistinct("slot").alias("have"), F.first("length").alias("length"), F.sort_array(F.collect_list("doc_freq")).alias("freqs")).filter("have = n")
    matches = whole.groupBy("query_id", "ord").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.first("freqs").alias("freqs"))
    part = lambda f: bm25(F.col("tf"), F.col("length"), F.lit(index.average), idf(f, F.lit(index.total)), index.k1, index.b)
    score = F.aggregate("freqs", F.lit(0.0), lambda acc, f: acc + part(f))
    return matches.select("query_id", "ord", F.round(score, DIGITS).alias("score"))


def disjunction_pruned(index: Index, terms: list[str], k: int, least: int = LEAST_POSTINGS) -> DataFrame:
    """The best k documents that hold any of the terms, by block bounds that lose nothing.

    The documents are cut into CELLS ranges; in each, a score is at most the sum, over the terms, of
    the greatest bound of a block that reaches into it. The cells with the highest bounds give k real scores, of
    which the least is a threshold; then the postings of the cells whose bound comes up to it (or less than a unit
    of rounding below) are scored. With fewer than `least` postings, more than MOST_BLOCKS blocks, or where the cells
    that stay hold most postings anyway, all postings are scored. The driver holds the blocks of the query's
    terms, one for BLOCK postings and MOST_BLOCKS at most.
    """
    asked = [(0, ParsedQuery(terms, [], [], [], True))]
    names = _names(asked)
    wanted = _looked_up(index, asked, names)
    found = {r["term"]: r["doc_freq"] for r in wanted.collect()}  # the query's terms
    postings = _only(index.postings, set(found)) if found else index.postings.filter("false")

    def hits(chosen: DataFrame) -> DataFrame:
        score = bm25(F.col("tf"), F.col("length"), F.lit(index.average), F.col("idf"), index.k1, index.b)
        total = chosen.join(F.broadcast(wanted.select("term", "idf")), "term").groupBy("ord").agg(F.sum(score).alias("score"))  # the query's terms
        return total.select(F.lit(0).cast("long").alias("query_id"), "ord", F.round("score", DIGITS).alias("score"))

    if not least <= sum(found.values()) <= MOST_BLOCKS * BLOCK:
        return best_of_one(hits(postings), k)
    got = _only(index.blocks, set(found)).select("term", "min_ord", "max_ord", "num_docs", "block_max_score").toArrow()  # at most MOST_BLOCKS rows and one a term
    lo, hi, n, top = (got[c].to_numpy() for c in ("min_ord", "max_ord", "num_docs", "block_max_score"))
    width = -(-index.total // CELLS)
    bound, order = np.zeros(-(-index.total // width)), sorted(found)
    term = np.searchsorted(order, got["term"].to_pylist())
    for t in range(len(order)):
        own, most = np.flatnonzero(term == t), np.zeros(len(bound))
        a, b = lo[own] // width, hi[own] // width
        for step in range(int((b - a).max()) + 1):  # at most CELLS
            there = a + step <= b
            np.maximum.at(most, a[there] + step, top[own[there]])
        bound += most
    cell = F.expr(f"ord div {width}")

    def inside(which: np.ndarray) -> DataFrame:
        cells = index.corpus.sparkSession.createDataFrame(pa.table({"cell": np.sort(which)}), "cell long")
        return postings.filter(F.col("ord").between(int(which.min()) * width, (int(which.max()) + 1) * width)).join(F.broadcast(cells), cell == F.col("cell"), "left_semi")  # at most CELLS rows

    best = hits(inside(np.argsort(-bound, kind="stable")[: max(4, k)])).orderBy(F.desc("score")).limit(k).collect()
    low = best[-1]["score"] if len(best) == k else 0.0
    keep = np.flatnonzero(bound + 10.0**-DIGITS >= low)
    reach = np.searchsorted(keep, hi // width, "right") > np.searchsorted(keep, lo // width)
    return best_of_one(hits(inside(keep) if n[reach].sum() <= 0.5 * n.sum() else postings), k)


def simple_tokens(corpus: DataFrame) -> DataFrame:
    """(ord, w): the plain engine's words, [a-z0-9]+ of lower-cased title and text."""
    return corpus.select("ord", F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "text")), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))


def simple_bm25(corpus: DataFrame, query: str, k: int = 15, k1: float = 0.9, b: float = 0.4, fuzzy: bool = False) -> DataFrame:
    """(ord, score): the plain engine: OR only, repeated query words count again.

    fuzzy: a word that no document has stands for the first word of the corpus, in order of
    documents and places, within an edit distance of 2. A document's row holds all it needs, so
    rows of words are neither made, sorted nor shuffled.
    """
    import re

    words = re.findall("[a-z0-9]+", query.lower())
    times = {w: float(words.count(w)) for w in words}
    tokens, among = simple_tokens(corpus), lambda test: F.filter("w", test)
    if fuzzy and times:
        first = {w: F.when(F.array_contains("w", w), F.lit(w)).otherwise(F.get(among(lambda x: F.levenshtein(x, F.lit(w), 2) >= 0), F.lit(0))) for w in times}
        nearest = tokens.agg(*(F.min(F.when(f.isNotNull(), F.struct((f != w).alias("other"), "ord", f.alias("term")))) for w, f in first.items())).first()  # one row
        found = Counter()
        for n, near in zip(times.values(), nearest, strict=True):
            if near:
                found[near["term"]] += n
        times = dict(found)
    if not times:
        return corpus.sparkSession.createDataFrame([], "ord long, score double")
    has = [F.array_contains("w", t) for t in times]
    total, average, *df = tokens.agg(F.count("*"), F.avg(F.size("w")), *(F.count_if(h) for h in has)).first()
    tf = [F.size(among(lambda x: x == t)).alias(f"tf{n}") for n, t in enumerate(times)]
    held = tokens.filter(F.arrays_overlap("w", F.array(*map(F.lit, times)))).select("ord", F.size("w").alias("length"), *tf)
    parts = [F.when(F.col(f"tf{n}") > 0, x * bm25(F.col(f"tf{n}"), F.col("length"), F.lit(average), idf(F.lit(df[n]), F.lit(total)), k1, b)).otherwise(0.0) for n, x in enumerate(times.values())]
    return held.select("ord", F.round(reduce(add, parts), DIGITS).alias("score")).orderBy(F.desc("score"), "ord").limit(k)


def simple_suggest(corpus: DataFrame, prefix: str, k: int = 8) -> DataFrame:
    """(term, doc_freq, edit_distance): the plain engine's first words with a prefix, by spelling."""
    words = simple_tokens(corpus).select("ord", F.explode(F.array_distinct("w")).alias("term")).filter(F.col("term").startswith(prefix.lower()))
    return words.groupBy("term").agg(F.count("*").alias("doc_freq")).orderBy("term").limit(k).withColumn("edit_distance", F.lit(0))
