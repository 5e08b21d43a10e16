"""From a query string to terms: words, one phrase, negations, and routing by syntax."""

from __future__ import annotations

import re
from typing import NamedTuple

from quillon.functions.snippet import analyze
from quillon.functions.text import STOPWORDS


class ParsedQuery(NamedTuple):
    positive: list[str]
    negative: list[str]
    phrase: list[str]
    phrase_places: list[int]
    has_or: bool

    @property
    def kind(self) -> str:
        """phrase, or, and, none: how the query is evaluated."""
        if self.phrase and not self.positive:
            return "phrase"
        if not self.positive:
            return "none"
        return "or" if self.has_or or len(self.positive) == 1 else "and"


def parse(query: str, stemming: bool = True, stopwords: frozenset[str] = STOPWORDS) -> ParsedQuery:
    """All words are required unless OR or or stands anywhere; -word excludes; the first "..." is a phrase.

    A phrase counts only where it stands alone; words beside it decide without it.
    """
    terms = lambda text: [t[0] for t in analyze(text, stemming, stopwords)]
    quoted = re.search(r'"([^"]*)"', query)
    phrase = analyze(quoted[1], stemming, stopwords) if quoted else []
    rest = query[: quoted.start()] + " " + query[quoted.end() :] if quoted else query
    positive, negative, has_or = [], [], False
    for token in re.split(r"[ \t\n\v\f\r]+", rest):
        if token in ("OR", "or"):
            has_or = True
        elif len(token.encode()) > 1 and token[0] == "-":
            negative += terms(token[1:])
        else:
            positive += terms(token)
    return ParsedQuery(list(dict.fromkeys(positive)), list(dict.fromkeys(negative)), [t[0] for t in phrase], [t[1] - phrase[0][1] for t in phrase], has_or)


class Route(NamedTuple):
    mode: str  # empty, regex, fuzzy, standard
    query: str
    distance: int = 0


def route(query: str, max_fuzzy: int = 0) -> Route:
    """/.../ is a regex; a ~ (or max_fuzzy) asks for fuzzy terms, a number after it for their distance, at most 2."""
    if not query:
        return Route("empty", "")
    if len(query) >= 2 and query[0] == query[-1] == "/":
        return Route("regex", query[1:-1])
    if max_fuzzy > 0 or "~" in query:
        text, tilde, number = query.partition("~")
        distance = max_fuzzy if max_fuzzy > 0 else 2
        if tilde and number:
            m = re.match(r"\s*([+-]?\d+)", number)
            distance = max(0, min(2, int(m[1]))) if m and len(m[1]) < 19 else 2
        return Route("fuzzy", text, min(distance, 2))
    return Route("standard", query)
