"""Porter stemming as a chain of DuckDB SELECTs, written apart from the procedural one to check it.

A consonant y is kept as Y along the way, so that vowels are [aeiouy] and consonants the rest.
"""

from __future__ import annotations

from quillon.functions.porter import _STEP2, _STEP3, _STEP4

_M0 = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_M1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
_DOUBLE = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx0123456789_") + "|yY)$"
_SHORT = r"[^aeiouy][aeiouy][^aeiouywxY\x{80}-\x{10FFFF}]$"  # a character of several bytes is several consonants


def _has(word: str, pattern: str) -> str:
    return f"regexp_matches({word}, '{pattern}')"


def _less(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def _swap(rules: dict[str, str]) -> str:
    cases = "".join(f" WHEN suffix(w, '{a}') THEN CASE WHEN {_has(_less('w', len(a)), _M0)} THEN {_less('w', len(a))} || '{b}' ELSE w END" for a, b in sorted(rules.items(), key=lambda x: -len(x[0])))
    return f"CASE{cases} ELSE w END"


def stem_ctes(source: str, name: str = "stems") -> str:
    """CTEs that end in `name` (word, stem), for the distinct words of a CTE or table `source` (word)."""
    steps = [
        "CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN " + _less("w", 2) + " WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN " + _less("w", 1) + " ELSE w END",
        # the mark # says that ed or ing went
        "CASE WHEN suffix(w, 'eed') THEN CASE WHEN " + _has(_less("w", 3), _M0) + " THEN " + _less("w", 1) + " ELSE w END"
        " WHEN suffix(w, 'ed') AND " + _has(_less("w", 2), "[aeiouy]") + " THEN " + _less("w", 2) + " || '#'"
        " WHEN suffix(w, 'ing') AND " + _has(_less("w", 3), "[aeiouy]") + " THEN " + _less("w", 3) + " || '#' ELSE w END",
        "CASE WHEN NOT suffix(w, '#') THEN w WHEN " + _has("w", "(at|bl|iz)#$") + " THEN " + _less("w", 1) + " || 'e'"
        " WHEN " + _has(_less("w", 1), _DOUBLE) + " THEN " + _less("w", 2) + " WHEN " + _has("w", "(ll|ss|zz)#$") + " THEN " + _less("w", 1) +
        " WHEN " + _has(_less("w", 1), _M0) + " AND NOT " + _has(_less("w", 1), _M1) + " AND " + _has(_less("w", 1), _SHORT) + " THEN " + _less("w", 1) + " || 'e' ELSE " + _less("w", 1) + " END",
        "CASE WHEN " + _has("w", "[yY]$") + " AND " + _has(_less("w", 1), "[aeiouy]") + " THEN " + _less("w", 1) + " || 'i' ELSE w END",
        _swap(_STEP2),
        _swap(_STEP3),
        "CASE" + "".join(f" WHEN suffix(w, '{e}')" + (" AND regexp_matches(w, '[st]ion$')" if e == "ion" else "") + f" THEN CASE WHEN {_has(_less('w', len(e)), _M1)} THEN {_less('w', len(e))} ELSE w END" for e in sorted(_STEP4, key=len, reverse=True)) + " ELSE w END",
        "CASE WHEN suffix(w, 'e') AND (" + _has(_less("w", 1), _M1) + " OR (" + _has(_less("w", 1), _M0) + " AND NOT " + _has(_less("w", 1), _SHORT) + ")) THEN " + _less("w", 1) + " WHEN suffix(w, 'll') AND " + _has("w", _M1) + " THEN " + _less("w", 1) + " ELSE w END",
        "CASE WHEN suffix(w, 'll') AND e AND " + _has("w", _M1) + " THEN " + _less("w", 1) + " ELSE w END",
    ]
    ctes = [f"{name}_0 AS (SELECT word, regexp_replace(regexp_replace(word, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g') AS w, false AS e FROM (SELECT DISTINCT word FROM {source}) WHERE strlen(word) > 2)"]
    for k, step in enumerate(steps):
        ended = "suffix(w, 'e')" if k == 7 else "e"
        ctes.append(f"{name}_{k + 1} AS (SELECT word, {step} AS w, {ended} AS e FROM {name}_{k})")
    ctes.append(f"{name} AS (SELECT word, replace(w, 'Y', 'y') AS stem FROM {name}_{len(steps)} UNION ALL SELECT word, word FROM (SELECT DISTINCT word FROM {source}) WHERE strlen(word) <= 2)")
    return ",\n".join(ctes)
