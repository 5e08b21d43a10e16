"""Scalar text functions: word characters, case folding, stop words, tokens, escaping, checksums.

Everything here is a column expression (JVM-side); stemming lives in `porter`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters, digits and underscore of ASCII, Latin-1, Latin Extended A and B, Greek and Coptic, Cyrillic, and CJK ideographs.
WORD_CLASS = r"A-Za-z0-9_\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{370}-\x{3FF}\x{400}-\x{4FF}\x{4E00}-\x{9FFF}"
WORD = f"[{WORD_CLASS}]+"

_CAPITALS = [chr(c) for a, z in ((0x41, 0x5B), (0xC0, 0xD7), (0xD8, 0xDF)) for c in range(a, z)]
UPPER = "".join(_CAPITALS)
LOWER = "".join(chr(ord(c) + 32) for c in _CAPITALS)

#: 123 function words of English.
STOPWORDS = frozenset(
    """
    a about above after again against all am an and any are as at be because been before being below between both but by could did do does doing down
    during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself me more most my
    myself no nor not of off on once only or other ought our ours ourselves out over own same she should so some such than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which while who whom why with would you
    your yours yourself yourselves
    """.split()
)


def is_word(text: Column) -> Column:
    """Whether a text is one or more word characters and nothing else."""
    return text.rlike(f"^{WORD}$")


def fold(text: Column) -> Column:
    """Lower case of ASCII and Latin-1 capitals only."""
    return F.translate(text, UPPER, LOWER)


def fold_py(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_TABLE)


_TABLE = str.maketrans(UPPER, LOWER)


def word_list(text: Column) -> Column:
    """The folded words of a text in order; ARRAY<STRING>."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def is_stopword(word: Column, stopwords: frozenset[str] = STOPWORDS) -> Column:
    return word.isin(sorted(stopwords)) if stopwords else F.lit(False)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def byte_view(text: Column) -> Column:
    """One character for each UTF-8 byte, so that string functions work on bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def word_offsets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word as written, start_byte, end_byte) for every word, stop words too.

    The gaps between words come from splitting on them; a running sum of the bytes of
    gaps and words gives the offsets.
    """
    words = docs.select(key, F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)).alias("w"), F.split(F.col(text), WORD, -1).alias("g"))
    each = words.select(key, F.posexplode(F.arrays_zip("w", F.slice("g", F.lit(1), F.size("w")).alias("g"))).alias("pos", "x"))
    each = each.select(key, "pos", F.col("x.w").alias("word"), byte_length("x.g").alias("gap"))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + byte_length("word")).over(upto).cast("int")
    return each.select(key, "pos", "word", (end - byte_length("word")).alias("start_byte"), end.alias("end_byte"))


def html_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def html_escape_py(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


def json_escape(text: Column) -> Column:
    """The text as the inside of a JSON string."""
    quoted = F.to_json(F.struct(text.alias("x")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def url_decode(text: Column, in_query: Column) -> Column:
    """%HH where both digits are hexadecimal, anything else as it is; + is a blank in a query only."""
    parts = F.regexp_extract_all(F.when(in_query, F.replace(text, F.lit("+"), F.lit(" "))).otherwise(text), F.lit("(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    hexed = F.transform(parts, lambda x: F.when((F.length(x) == 3) & F.startswith(x, F.lit("%")), F.substring(x, 2, 2)).otherwise(F.hex(F.encode(x, "UTF-8"))))
    return utf8_decode(F.unhex(F.array_join(hexed, "")))


def utf8_decode(data: Column) -> Column:
    """Text of UTF-8 bytes; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def utf8_encode(code_points: Column) -> Column:
    """Text of an array of code points; those that name no character become U+FFFD."""
    good = lambda c: (c >= 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
    hexed = lambda c: F.lpad(F.hex(F.when(good(c), c).otherwise(0xFFFD)), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(code_points, hexed), "")), "UTF-32")


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance over bytes; -1 above `most`."""
    return F.levenshtein(byte_view(a), byte_view(b)) if most is None else F.levenshtein(byte_view(a), byte_view(b), most)


def checksum(data: Column) -> Column:
    """CRC-32 (IEEE)."""
    return F.crc32(data)
