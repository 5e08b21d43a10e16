"""Searcher: one object over an index, with the modes, limits and JSON shapes of a service."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.snippet import analyze, highlight
from quillon.operators import lexical, patterns, rank
from quillon.plans.index import VERSION, Index
from quillon.plans.parser import ParsedQuery, parse, route


@dataclass
class SearchResult:
    """hits has rank, ord, score; total_matches is counted when it is asked for."""

    mode: str
    hits: DataFrame
    terms: list[str] = field(default_factory=list)
    did_you_mean: str = ""
    took_us: int = 0

    @property
    def returned_hits(self) -> int:
        return self.hits.count()


class Searcher:
    """straddling: substrings may begin in one document and end in the next. A closed searcher raises."""

    def __init__(self, index: Index, straddling: bool = False) -> None:
        self._index, self.straddling, self.started = index, straddling, time.time()

    @property
    def index(self) -> Index:
        if self._index is None:
            raise RuntimeError("the index is closed")
        return self._index

    def close(self) -> None:
        self._index = None

    def __enter__(self) -> Searcher:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def total_docs(self) -> int:
        return self.stats()["total_docs"]

    def evaluate(self, query: str, k: int = 10, **options: bool) -> DataFrame:
        """(rank, ord, score) without routing by syntax."""
        return rank.evaluate(self.index, [(0, query)], k, **options).drop("query_id")

    def evaluate_many(self, queries: Sequence[tuple[int, str]] | DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, ord, score) of all queries in one plan: a list, or a table (query_id, query) of any length."""
        return rank.evaluate_frame(self.index, queries, k) if isinstance(queries, DataFrame) else rank.evaluate(self.index, queries, k)

    def fuzzy(self, query: str, distance: int, k: int) -> DataFrame:
        terms = [t[0] for t in analyze(query, self.index.stemming, self.index.stopwords)]
        found = [r["term"] for r in lexical.fuzzy_expansions(self.index.lexicon, terms, distance).collect()]  # at most 50
        return self._ranked(rank.evaluate(self.index, [(0, ParsedQuery(found, [], [], [], True))], k)) if found else self._none()

    def _ranked(self, hits: DataFrame) -> DataFrame:
        return hits.select("rank", "ord", "score")

    def _none(self) -> DataFrame:
        return self.index.corpus.sparkSession.createDataFrame([], "rank int, ord long, score double")

    def _numbered(self, hits: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "ord"))  # at most k rows
        return hits.select(place.cast("int").alias("rank"), "ord", F.col("score").cast("double").alias("score"))

    def search(self, query: str, k: int = 10, mode: str = "auto", max_fuzzy: int = 0) -> SearchResult:
        """mode: auto (by syntax; so are bm25, standard and unknown ones), regex, substring, fuzzy. No hits in standard mode bring a suggestion."""
        begun = time.time()
        way = route(query, max_fuzzy if mode != "fuzzy" else max_fuzzy or 2)
        if mode == "substring":
            result = SearchResult("substring", self._numbered(patterns.substring_search(self.index.corpus, query, k, self.straddling)))
        elif mode == "regex" or way.mode == "regex":
            pattern = way.query if way.mode == "regex" else query
            result = SearchResult("regex", self._numbered(patterns.regex_search(self.index.corpus, pattern, k)))
        elif way.mode == "fuzzy":
            result = SearchResult("fuzzy", self.fuzzy(way.query, way.distance, k))
        elif way.mode == "empty" or k <= 0:
            result = SearchResult("standard", self._none())
        else:
            parsed = parse(query, self.index.stemming, self.index.stopwords)
            result = SearchResult("standard", self._ranked(rank.evaluate(self.index, [(0, parsed)], k)), parsed.positive or parsed.phrase)
            if not result.hits.take(1):
                result.did_you_mean = self.did_you_mean(query)
        result.terms = result.terms or [t[0] for t in analyze(query, self.index.stemming, self.index.stopwords)]
        result.took_us = int((time.time() - begun) * 1e6)
        return result

    def show(self, result: SearchResult, snippet_chars: int = 160) -> list[dict]:
        """The hits with ext_id, title and snippet."""
        rows = self.index.corpus.join(F.broadcast(result.hits), "ord").orderBy("rank").collect()  # at most k rows
        return [{"rank": r["rank"], "doc_id": r["ext_id"], "score": r["score"], "title": r["title"] or "(Untitled)", "snippet": highlight(r["text"], result.terms, snippet_chars)} for r in rows]

    def suggest(self, text: str, k: int = 10, fuzzy: bool = False, max_dist: int = 2) -> list[dict]:
        k, max_dist = max(1, min(100, k)), max(0, min(2, max_dist))
        found = lexical.fuzzy_suggest(self.index.lexicon, text, max_dist, k) if fuzzy else lexical.prefix_suggest(self.index.lexicon, text, k)
        return [r.asDict() for r in found.collect()]  # at most k

    def did_you_mean(self, query: str) -> str:
        return lexical.did_you_mean(self.index.lexicon, query).first()[0]

    def stats(self) -> dict:
        one = self.index.index_stats.first()
        return {"total_docs": one["total_docs"], "total_tokens": one["total_tokens"], "avg_doc_length": one["avg_doc_len"], "unique_terms": self.index.lexicon.count(), "k1": self.index.k1, "b": self.index.b}

    def health(self) -> dict:
        return {"status": "ok", "version": VERSION, "total_docs": self.total_docs, "uptime_seconds": int(time.time() - self.started)}

    def search_json(self, query: str, k: int = 10, mode: str = "auto", fuzzy: int = 0) -> str:
        """The response of a search service; queries above 256 bytes and other errors come as {"error": ...}."""
        if len(query.encode()) > 256:
            return json.dumps({"error": "the query is longer than 256 bytes"})
        try:
            result = self.search(query, min(100, k or 10), mode, fuzzy)
            hits = self.show(result)
        except ValueError as e:
            return json.dumps({"error": str(e)})
        return json.dumps({"query": query, "mode": result.mode, "took_us": result.took_us, "total_hits": len(hits), "did_you_mean": result.did_you_mean, "hits": hits}, ensure_ascii=False)

    def suggest_json(self, text: str, k: int = 10, fuzzy: bool = False, max_dist: int = 2) -> str:
        return json.dumps({"query": text, "suggestions": self.suggest(text, k, fuzzy, max(1, max_dist))}, ensure_ascii=False)
