"""Scalar functions, codecs, regexes and snippets: hand-worked values and brute force."""

import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import codecs, porter, regex, snippet, text
from quillon.plans.porter_sql import stem_ctes


def one(spark, column, *values, names="abc"):
    return spark.createDataFrame([values], list(names[: len(values)])).select(column).first()[0]


def test_fold_covers_ascii_and_latin1_only(spark):
    assert one(spark, text.fold(F.col("a")), "ÀÉÞ ÑZ ΣЖ Ā ×ß÷") == "àéþ ñz ΣЖ Ā ×ß÷"
    assert text.fold_py("ÀÉÞ ÑZ ΣЖ") == "àéþ ñz ΣЖ"


def test_word_characters(spark):
    words = one(spark, text.word_list(F.col("a")), "It's b-tree_2 naïve 数学漢字 かな Ж ﬁ x̀ ×÷ ΑΒ")
    assert words == ["it", "s", "b", "tree_2", "naïve", "数学漢字", "Ж", "x", "ΑΒ"]


def test_stopwords():
    assert len(text.STOPWORDS) == 123 and not {"will", "can", "just"} & text.STOPWORDS


def test_positions_of_the_pangram(spark):
    got = snippet.analyze("The quick brown fox jumps over the lazy dog")
    assert [(t, p) for t, p, *_ in got] == [("quick", 1), ("brown", 2), ("fox", 3), ("jump", 4), ("lazi", 7), ("dog", 8)]


def test_word_offsets(spark):
    for s in ("", "  é ab", "ab", "x, ÿz!", "数 a"):
        rows = text.word_offsets(spark.createDataFrame([(1, s)], "k int, t string"), "k", "t").orderBy("pos").collect()
        assert [s.encode()[r["start_byte"] : r["end_byte"]].decode() for r in rows] == [r["word"] for r in rows] == snippet._WORD.findall(s)


STEMS = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit radically:radic vietnamization:vietnam feudalism:feudal decisiveness:decis formality:formal triplicate:triplic electrical:electr goodness:good revival:reviv allowance:allow adjustable:adjust replacement:replac adoption:adopt effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll is:is by:by saying:sai archaeology:archaeolog possibly:possibl"


@pytest.mark.parametrize("pair", STEMS.split())
def test_stems(pair):
    word, want = pair.split(":")
    assert porter.stem(word) == want


def test_stemmer_against_sql():
    rng = random.Random(1)
    parts = ["at", "bl", "iz", "y", "yy", "ing", "ed", "eed", "s", "ss", "ies", "ational", "ization", "ement", "ion", "ll", "e", "l", "é", "a", "t", "b", "x", "w", "ful", "ness", "logi", "bli", "o", "ry", "c", "iti"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(6000)})
    con = duckdb.connect()
    con.execute("CREATE TABLE w (word VARCHAR)")
    con.executemany("INSERT INTO w VALUES (?)", [[x] for x in words])
    got = dict(con.execute(f"WITH {stem_ctes('w')} SELECT word, stem FROM stems").fetchall())
    assert {w: s for w, s in got.items() if porter.stem(w) != s} == {}


def test_stemmed_arrays(spark):
    df = spark.createDataFrame([(1, ["cats", None, "feed"]), (2, []), (3, None)], "k int, w array<string>")
    assert {r["k"]: r["w"] for r in porter.stemmed(df, "w").collect()} == {1: ["cat", None, "feed"], 2: [], 3: []}


def test_escapes(spark):
    assert one(spark, text.html_escape(F.col("a")), "<a href=\"x\">'&'</a>") == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"
    assert one(spark, text.json_escape(F.col("a")), 'q"\\\n\t') == 'q\\"\\\\\\n\\t'
    for raw, query, want in (("a%20b+c", True, "a b c"), ("a%2Fb+c", False, "a/b+c"), ("%zz%4", True, "%zz%4"), ("%C3%A9", False, "é")):
        assert one(spark, text.url_decode(F.col("a"), F.col("b")), raw, query) == want


def test_utf8(spark):
    assert one(spark, text.utf8_decode(F.unhex(F.col("a"))), "61FF62") == "a�b"
    assert one(spark, text.utf8_encode(F.col("a")), [97, 0x1F600, 0x110000, 0xD800]) == "a\U0001f600��"


def test_edit_distance_counts_bytes(spark):
    assert one(spark, text.edit_distance(F.col("a"), F.col("b")), "é", "e") == 2
    assert [one(spark, text.edit_distance(F.col("a"), F.col("b"), 2), "algorithm", w) for w in ("algorythm", "algoritm", "algorithms", "xyz")] == [1, 1, 1, -1]
    assert one(spark, text.edit_distance(F.col("a"), F.col("b")), "a", "apple") == 4


def test_checksum(spark):
    assert one(spark, text.checksum(F.encode("a", "UTF-8")), "123456789") == 0xCBF43926


def test_varint():
    values = np.array([0, 1, 127, 128, 255, 300, 16384, 1_000_000, 4_294_967_295], np.uint64)
    data = codecs.varint_encode(values)
    assert data[:5] == bytes([0, 1, 127, 128, 1]) and (codecs.varint_decode(data) == values).all() and codecs.varint_encode(np.array([])) == b""
    for bad in (b"\x80", b"\x80" * 5 + b"\x01"):
        with pytest.raises(ValueError):
            codecs.varint_decode(bad)


@pytest.mark.parametrize("width", range(33))
def test_bit_packing(width):
    values = np.random.default_rng(width).integers(0, 1 << width, 128, dtype=np.uint64)
    data = codecs.pack(values, width)
    assert len(data) == 16 * width and (codecs.unpack(data, width) == values).all() and codecs.required_bits(np.array([0, (1 << width) - 1])) == width


def test_bit_width(spark):
    assert [one(spark, codecs.bit_width(F.col("a")), v) for v in (0, 1, 2, 255, 256)] == [0, 1, 2, 8, 9]


# --- regex ---


def spans(pattern, s):
    return [s.encode()[a:b].decode() for a, b in regex.compile_regex(pattern).find_all(s.encode())]


def test_regex_dialect():
    assert spans(r"\d+", "Items: 42 apples, 100 oranges, 9 bananas") == ["42", "100", "9"]
    assert spans("a|ab", "abX") == ["ab"]
    assert spans("a*", "baac") == ["aa"]
    assert spans("^a$", "a ^a$") == ["^a$"]
    assert spans("a.b", "a\nb") == ["a\nb"]
    assert spans(r"[\d]", "d1") == ["d"] and spans(r"\n", "n\n") == ["n"]
    dfa = regex.compile_regex("a{2,4}")
    assert [dfa.full_match(b"a" * n) for n in range(1, 6)] == [False, True, True, True, False]
    assert regex.compile_regex("(ab)*").full_match(b"") and regex.compile_regex("x{2,}").full_match(b"x" * 100) and not regex.compile_regex("x{2,}").full_match(b"x" * 101)


@pytest.mark.parametrize("bad", ["a" * 513, "a{200}", "a{10,5}", "|".join("a" * 101), "(a", "[a", "a{2", "a)", "(" * 70 + ")" * 70, "a\\"])
def test_regex_errors(bad):
    with pytest.raises(regex.RegexError):
        regex.compile_regex(bad)


def test_regex_against_brute_force():
    rng = random.Random(2)

    def pattern(depth=0):
        kind = rng.randrange(7 if depth < 3 else 2)
        if kind < 2:
            return rng.choice(["a", "b", "c", "[ab]", "[^a]", "."])
        if kind == 2:
            return f"({pattern(depth + 1)}|{pattern(depth + 1)})"
        if kind == 3:
            return f"({pattern(depth + 1)})" + rng.choice(["*", "+", "?", "{1,2}", "{2}"])
        return pattern(depth + 1) + pattern(depth + 1)

    for _ in range(250):
        p = pattern()
        s = "".join(rng.choice("abc") for _ in range(10))
        whole = re.compile(p, re.S)
        want, at = [], 0
        while at < len(s):
            end = max((e for e in range(at + 1, len(s) + 1) if whole.fullmatch(s, at, e)), default=None)
            if end:
                want.append(s[at:end])
            at = end or at + 1
        assert spans(p, s) == want, p


def test_regex_many_texts_and_long_runs(monkeypatch):
    """Texts side by side give what each gives alone, with lanes cut short or not; long runs take linear time."""
    rng = random.Random(9)
    for pattern in ("a*b+c", "(ab|a)*c?", "[ab]+c", "a{2,5}|b", "(a|b)*abb", "a*(c|ba)"):
        dfa = regex.compile_regex(pattern)
        texts = ["".join(rng.choice("aabbc") for _ in range(rng.randrange(60))).encode() for _ in range(200)]
        want = [dfa._linear(t) for t in texts]
        for steps in (64, 1, 3):
            monkeypatch.setattr(regex, "STEPS", steps)
            assert [dfa.find_all(t) for t in texts] == want
            which, begin, end = dfa.spans(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
            assert list(zip(which.tolist(), begin.tolist(), end.tolist())) == [(k, a, b) for k, x in enumerate(want) for a, b in x]
    monkeypatch.setattr(regex, "STEPS", 64)
    began = time.time()
    assert regex.compile_regex("a*b+c").find_all(b"a" * 300_000) == [] and regex.compile_regex("[a-z]+1").find_all(b"ab" * 150_000) == []
    assert time.time() - began < 10  # squared, it would be hours


def test_regex_columns(spark):
    df = spark.createDataFrame([("é1 22",), ("",), (None,)], "t string")
    rows = df.select(regex.count_matches(F.col("t"), r"\d+").alias("n"), regex.find_matches(F.col("t"), r"\d+").alias("m"), regex.full_match(F.col("t"), ".*").alias("f")).collect()
    assert [r["n"] for r in rows] == [2, 0, 0] and [tuple(x) for x in rows[0]["m"]] == [(2, 3), (4, 6)] and [r["f"] for r in rows] == [True, True, False]


# --- snippets ---


def test_snippet():
    h = snippet.highlight
    assert h("", ["a"]) == "" and h(None, ["a"]) == ""
    assert h("The cats sat", ["cat"]) == "...<em>cats</em> sat"
    assert h("x" * 200, [], 160) == "x" * 160 + "..." and h("-- <", ["a"]) == "-- &lt;"
    long = "filler words here. " * 40 + "needle in <hay> & needle. " + "more text after " * 20
    got = h(long, ["needle"])
    assert got.count("<em>needle</em>") == 2 and "&lt;hay&gt; &amp;" in got and got.startswith("...") and got.endswith("...")
    assert "�" not in h("é" * 300, ["é"], 161)


def test_browser_snippet(spark):
    got = one(spark, snippet.browser_snippet(F.col("a"), ["zebra", "lion"]), "x" * 100 + " Lion & zebra " + "y" * 300)
    assert got.startswith("...") and "<em>Lion</em> &amp; <em>zebra</em>" in got and got.endswith("...")
