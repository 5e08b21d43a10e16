"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, exact_dedup, golay, mil, mixing, paragraphs, repetition, simhash, suffixes, toxicity
from quillon.llm import textnp as X
from quillon.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
WORDS = [a + b + c for a in ("ka", "mo", "ti", "ré", "su") for b in ("lo", "na", "pe", "vi") for c in ("", "s", "tor", "ñu", "x1")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "b"), (5, long, "b"), (5, long, "b"), (None, "no id here", "a"), (None, None, None), (6, "one", "c"), (7, "one", "c"), (7, "other text of the same id", None), (8, "naïve 数学 \U0001f600 text", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).withColumns({"digest": F.lit("x"), "rank": F.lit(1), "key": F.lit("y"), "winner": F.lit(2), "unit": F.lit(3)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


# --- text helpers ---


def test_words_match_python():
    rng = random.Random(1)
    texts = ["", "a", " a  b ", "naïve\tcafé", "x\n\ny", "end", "start of next"] + ["".join(rng.choice("ab \n,é数") for _ in range(rng.randrange(40))) for _ in range(300)]
    data, offsets = X.string_buffer(pa.array(texts))
    w = X.words(data, offsets)
    got = [[data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [re.findall(r"[^\t-\r\x1c-\x20]+", t) for t in texts]
    by_word = defaultdict(set)
    for i, ws in enumerate(got):
        for k, word in enumerate(ws):
            by_word[word].add(int(w.hash[w.first[i] + k]))
    assert all(len(h) == 1 for h in by_word.values()) and len({h for (h,) in by_word.values()}) == len(by_word)


def test_slices_cover_all_texts():
    _, offsets = X.string_buffer(pa.array(["a" * n for n in (0, 5, 2000, 1, 0, 7, 3, 900)]))
    parts = list(X.slices(offsets, 1000))
    assert parts[0][0] == 0 and parts[-1][1] == 8 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_grams_are_equal_for_equal_runs():
    h = np.array([1, 2, 3, 1, 2, 3, 1], np.uint64)
    g = X.grams(h, 3)
    assert g[0] == g[3] and g[1] == g[4] and len(set(g.tolist())) == 3


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(9, 9), (999, 999)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 paragraphs ---


def brute_paragraphs(text):
    """[(start, end, words)] of a text's paragraphs in characters, cut by looking at each word's neighbours one by one."""
    found = [(m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    low = text.translate({c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]})
    words = [low[a:b] for a, b in found]
    blocks = []
    for k, (a, _) in enumerate(found):
        end = found[k - 1][1] if k else 0
        if not k or text[end:a].count("\n") > 1 or ("\n" in text[end:a] and text[end] in ".!?:;\"')"):
            blocks.append([])
        blocks[-1].append(k)
    h = {w: int(X.words(*X.string_buffer(pa.array([w]))).hash[0]) for w in set(words)}
    out, most = [], (1 << 64) - 1
    for block in blocks:
        g = [int(X.mix(np.array([(h[words[k]] * 0x9E3779B97F4A7C15 + h[words[k + 1]]) & most], np.uint64), 3)[0]) for k in block[:-1]] + [most]
        begin = [0]
        for k in range(paragraphs.MIN_WORDS, len(block) - paragraphs.MIN_WORDS + 1):
            before, after = g[max(0, k - paragraphs.REACH) : k], g[k + 1 : k + 1 + paragraphs.REACH]
            if g[k] < min(before) and g[k] <= min(after):
                begin.append(k)
        for x, y in zip(begin, [*begin[1:], len(block)]):
            out.append((found[block[x]][0], found[block[y - 1]][1], words[block[x] : block[y - 1] + 1]))
    return out


def brute_repeats(docs):
    """{(id, paragraph): (id, paragraph) that stays} by all pairs, and those that exact copies alone join; spans of all."""
    sets, spans = {}, {}
    for i, t in docs:
        for n, (a, b, ws) in enumerate(brute_paragraphs(t or "")):
            if len(ws) >= paragraphs.MIN_WORDS:
                sets[i, n], spans[i, n] = (set(zip(ws, ws[1:])), tuple(ws)), (a, b)
    order = sorted(sets)
    root, sure = ({p: p for p in order} for _ in "ab")

    def find(up, p):
        while up[p] != p:
            p = up[p]
        return p

    by_words, small = {}, {}
    for p in order:
        first = by_words.setdefault(sets[p][1], p)
        root[p] = sure[p] = first
        small.setdefault(first, sets[p][0])
    own = sorted(small)
    for x, a in enumerate(own):
        for b in own[x + 1 :]:
            if len(small[a] & small[b]) >= paragraphs.LEAST_JACCARD * len(small[a] | small[b]):
                p, q = find(root, a), find(root, b)
                root[max(p, q)] = min(p, q)
    return {p: find(root, p) for p in order if find(root, p) != p}, {p: q for p, q in sure.items() if p != q}, spans


def test_paragraphs_against_brute_force(spark):
    rng = random.Random(7)
    docs = []
    base = [sentence(rng, rng.randrange(35, 80)) for _ in range(25)]
    for i in range(120):
        lines = [sentence(rng, rng.randrange(3, 60)) + rng.choice(["", "."]) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.6:
            words = rng.choice(base).split()
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            lines.insert(rng.randrange(len(lines) + 1), " ".join(words) + rng.choice(["", ".", "!"]))
        docs.append((i, rng.choice(["\n", "\n\n"]).join(lines), "s"))
    got = paragraphs.repeated_paragraphs(frame(spark, docs)).collect()
    want, _, spans = brute_repeats([(i, t) for i, t, _ in docs])
    found = {(r["doc_id"], r["paragraph"]): (r["kept_doc_id"], r["kept_paragraph"]) for r in got}
    assert found.keys() <= want.keys() and len(found) >= 0.95 * len(want) > 50
    assert all(spans[r["doc_id"], r["paragraph"]] == (r["start"], r["end"]) for r in got)


@pytest.mark.parametrize("size", [55, 70, 120])
def test_passages_wrapped_and_embedded(spark, size):
    """A passage is found wherever it stands: inside a line, wrapped over short ones, or on its own."""
    rng = random.Random(size)
    new = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(n))
    docs = []
    for k in range(60):
        words = new(size).split()
        wrapped = "\n".join(" ".join(words[j : j + 10]) for j in range(0, size, 10))
        for form, text in enumerate((f"{new(60)} {' '.join(words)} {new(40)}", f"{new(30)}.\n\n{wrapped}\n\n{new(30)}", f"{new(25)}\n{wrapped}\n{new(10)} {new(9)}.")):
            docs.append((k * 3 + form, text, "s"))
    docs += [(1000 + k, new(150), "s") for k in range(60)]
    got = paragraphs.repeated_paragraphs(frame(spark, docs)).collect()
    pairs = {(r["doc_id"], r["kept_doc_id"]) for r in got}
    assert all(a < 1000 and a // 3 == b // 3 for a, b in pairs)
    assert np.mean([bool({(3 * k + f, 3 * k), (3 * k + f, 3 * k + 1)} & pairs) for k in range(60) for f in (1, 2)]) >= (0.9 if size < 60 else 0.97)


@pytest.mark.parametrize("small", [1, 48, 10_000])
def test_paragraphs_in_large_groups(spark, small):
    """Variants of a passage, and many unlike paragraphs of one band, whatever the size from which bands are split."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(60)]
    docs = []
    for i in range(90):
        words = list(base)
        words[rng.randrange(60)] = f"only{i}"
        docs.append((i, " ".join(words), "s"))
    docs += [(100 + i, "foo " * 30 + f"tail{i}x tail{i}y tail{i}z" if i % 2 else "foo " * 30 + f"tail{i - 1}x tail{i - 1}y other{i}", "s") for i in range(160)]
    got = {(r["doc_id"], r["paragraph"]): (r["kept_doc_id"], r["kept_paragraph"]) for r in paragraphs.repeated_paragraphs(frame(spark, docs), small=small).collect()}
    want, sure, _ = brute_repeats([(i, t) for i, t, _ in docs])
    assert got.keys() <= want.keys() and sure.keys() <= got.keys() and len(got) >= 0.97 * len(want)
    assert {i for i, _ in got} >= set(range(1, 90))


def test_short_paragraphs(spark):
    rng = random.Random(18)
    notice, short = "All rights of this text are reserved.", [" ".join(f"p{k}x{n}" for n in range(6)) + "." for k in range(8)]
    docs = [(i, "\n".join([" ".join(f"w{rng.randrange(10**9)}" for _ in range(9)) + ".", notice, *(short if i % 3 == 0 else []), "Too short."]), "s") for i in range(9)]
    got = {(r["doc_id"], r["paragraph"]): (r["kept_doc_id"], r["kept_paragraph"]) for r in paragraphs.repeated_paragraphs(frame(spark, docs)).collect()}
    want = {(i, 1): (0, 1) for i in range(1, 9)} | {(i, k): (0, k) for i in (3, 6) for k in range(2, 10)}
    assert got == want


def test_paragraphs_odd(odd, empty):
    got = paragraphs.repeated_paragraphs(odd).collect()
    assert [(r["doc_id"], r["kept_doc_id"]) for r in got if r["doc_id"] == 5] and all(r["kept_doc_id"] == 4 for r in got)
    assert paragraphs.repeated_paragraphs(empty).count() == 0


# --- 2 quality ---


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = "\n".join(sentence(rng, rng.randrange(20, 120)).capitalize() + "." for _ in range(rng.randrange(1, 4)))
        if not good:
            text = re.sub(" ", lambda _: rng.choice([" | ", "### ", "!! "]), text)
        rows.append((i, text, "s"))
        if i % 2:
            labels.append((i, int(good), 0))
        rows[-1] += (good,)
    return frame(spark, [r[:3] for r in rows]), spark.createDataFrame(labels, LABELS), {r[0]: r[3] for r in rows}


def test_quality_held_out(graded):
    docs, labels, good = graded
    got = {r["doc_id"]: r for r in mil.quality_scores(docs, labels).collect()}
    held = [i for i in good if i % 2 == 0]
    assert np.mean([got[i]["keep"] == good[i] for i in held]) > 0.95
    kept = mil.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, first = rng.normal(size=(40, mil.DIMENSIONS)).astype(np.float32), np.array([0, 5, 12, 20, 33])
    m = mil.fit(x, first, np.array([0, 1, 0, 1, 1]), epochs=60, bags=5)
    f = mil._forward(m, np.clip((x - m.mean) / m.scale, -8, 8), first)
    assert np.allclose(np.add.reduceat(f["a"], first), 1, atol=1e-5) and ((f["p"] > 0.5) == [0, 1, 0, 1, 1]).all()


def test_quality_odd(odd, empty, graded, no_labels):
    _, labels, _ = graded
    got = mil.quality_scores(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(r["score"] == 0 and not r["keep"] for r in got if r["doc_id"] in (1, 2, 3))
    one = mil.quality_scores(odd, no_labels).collect()
    assert {r["score"] for r in one} == {0.0, 1.0}
    assert mil.quality_scores(empty, labels).count() == 0 and mil.keep_good(odd, labels).columns == odd.columns


# --- 3 exact ---


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 3000):
        digests = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
        displaced, slots = exact_dedup.build_mph(digests)
        assert sorted(slots) == list(range(n))  # minimal
        table = digests[np.argsort(slots)]
        assert (exact_dedup.probe_mph(displaced, table, digests) == slots).all()
        assert (exact_dedup.probe_mph(displaced, table, rng.integers(0, 1 << 63, (500, 4), dtype=np.uint64)) == -1).all()


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_repeats(spark, share, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 16)
    rng = random.Random(2)
    rows = [(i, f"text {rng.randrange(90)}", "s") for i in range(200)]
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    got = exact_dedup.exact_repeats(frame(spark, rows), history_share=share).collect()
    assert {r["doc_id"]: (r["winner_id"], r["is_repeat"]) for r in got} == {i: (first[t], first[t] != i) for i, t, _ in rows}
    kept = exact_dedup.drop_repeats(frame(spark, rows), history_share=share)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())


def test_exact_odd(odd, empty):
    got = Counter((r["doc_id"], r["winner_id"], r["is_repeat"]) for r in exact_dedup.exact_repeats(odd).collect())
    assert got[5, 4, True] == 2 and got[1, 1, False] == 1 and got[None, None, False] == 2 and got[7, 6, True] == 1 and got[7, 7, False] == 1
    kept = exact_dedup.drop_repeats(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect() if r["doc_id"] in (5, 6, 7, None)) == [(0, 0), (0, 10), (6, 3), (7, 25)]
    assert exact_dedup.exact_repeats(empty).count() == 0 and exact_dedup.drop_repeats(empty).count() == 0


# --- 4 mixing ---


def brute_mix(rows, shares, budget, weights, seed=7):
    import hashlib
    import math

    by = defaultdict(list)
    for i, t, s in rows:
        n = len(re.findall(r"[^ \t\n\r]+", t or ""))
        u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[s].append((-math.log(u) / weights.get(i, 1.0), i, n))
    budget = sum(n for d in by.values() for _, _, n in d) if budget is None else budget
    shares = {s: shares.get(s, 0) if shares else 1.0 for s in by}
    out = Counter()
    for s, d in by.items():
        total = sum(n for *_, n in d)
        if not total or not shares[s]:
            continue
        quota = math.floor(budget * (shares[s] / sum(shares.values())))
        upto = 0
        for _, i, n in sorted(d):
            upto += n
            out[i] += quota // total + (n > 0 and upto <= quota % total)
    return +out


@pytest.mark.parametrize(("shares", "budget"), [(None, None), ({"a": 5, "b": 1, "zz": 3}, 9000), (None, 100), (None, 30_000)])
def test_mixing_against_brute_force(spark, shares, budget):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randrange(0, 60)), rng.choice("aaab" + "c")) for i in range(300)]
    weights = {i: rng.choice([0.5, 2.0]) for i in range(0, 300, 3)}
    quality = spark.createDataFrame(list(weights.items()), "doc_id long, weight double")
    got = mixing.mix_sources(frame(spark, rows), shares, budget, quality)
    assert Counter(r["doc_id"] for r in got.collect()) == brute_mix(rows, shares, budget, weights)


def test_mixing_odd(odd, empty):
    got = mixing.mix_sources(odd, budget=10_000_000)
    assert got.columns == odd.columns and got.filter("source is null").count() > 0
    assert mixing.mix_sources(odd, budget=0).count() == 0 and mixing.mix_sources(empty).count() == 0


@pytest.mark.parametrize("weight", [0.01, 1.0, 100.0])
def test_mixing_cuts_even_ranges(spark, weight, monkeypatch):
    """Whatever the weights, one hot source is spread over the ranges."""
    written = []
    monkeypatch.setattr(mixing, "materialize", lambda df, name, own=mixing.materialize: written.append(own(df, name)) or written[-1])
    rows = [(i, "a b c", "hot" if i % 10 else "small") for i in range(4000)]
    quality = spark.createDataFrame([(i, weight) for i in range(4000)], "doc_id long, weight double")
    got = {r["doc_id"]: r["copies"] for r in mixing.choose(frame(spark, rows), quality=quality, budget=6000).collect()}
    assert got == brute_mix(rows, None, 6000, {i: weight for i in range(4000)})
    sizes = [r["count"] for r in written[0][0].groupBy("run").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 1000


def test_mixing_prefers_weight(spark):
    rows = [(i, "w " * 10, "s") for i in range(600)]
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 0.5) for i in range(600)], "doc_id long, weight double")
    ids = [r["doc_id"] for r in mixing.mix_sources(frame(spark, rows), budget=2000, quality=quality).collect()]
    assert len(ids) == 200 and sum(i % 2 for i in ids) > 140


# --- 5 toxicity ---


@pytest.fixture(scope="module")
def rude(spark):
    rng = random.Random(6)
    bad = ["zorp", "blick", "vrull", "gnash", "mudde", "snork"]
    rows, labels = [], []
    for i in range(700):
        toxic = rng.random() < 0.2
        words = sentence(rng, rng.randrange(30, 150)).split()
        if toxic:
            for _ in range(rng.randrange(3, 9)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "s"))
        if i % 2:
            labels.append((i, 1, int(toxic)))
        rows[-1] += (toxic,)
    return frame(spark, [r[:3] for r in rows]), spark.createDataFrame(labels, LABELS), {r[0]: r[3] for r in rows}


def test_toxicity_held_out(rude):
    docs, labels, truth = rude
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in truth if i % 2 == 0]
    assert np.mean([got[i] for i in held if truth[i]]) > 0.95 and np.mean([got[i] for i in held if not truth[i]]) < 0.02
    _, words, weight, _ = toxicity.lexicon(docs, labels)
    assert {"zorp", "blick", "vrull", "gnash", "mudde", "snork"} <= set(words) and weight.min() >= toxicity.LEAST_POLARITY


def test_toxicity_of_words_without_labels(rude, spark):
    docs, labels, _ = rude
    rng = random.Random(16)
    more = []
    for i in range(1000, 1040):
        words = sentence(rng, 60).split()
        words[20:20] = ["zorp", "quexx", "blick", "quexx", "vrull"]
        more.append((i, " ".join(words), "s"))
    more += [(2000, f"{sentence(rng, 30)} quexx quexx quexx quexx", "s"), (2001, sentence(rng, 30), "s")]
    every = docs.union(frame(spark, more))
    _, words, _, _ = toxicity.lexicon(every, labels)
    assert "quexx" in words
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(every, labels).collect()}
    assert got[2000] and not got[2001]


def test_toxicity_walks_beyond_the_seeds_neighbours(rude, spark):
    """Three steps from the seeds: cthree is near btwo alone, which is near aone, which is near seeds."""
    docs, labels, _ = rude
    fill = lambda i, j: " ".join(f"u{i}x{j}x{k}" for k in range(30))
    more = [(i, f"zorp blick vrull gnash aone {fill(i, 0)} aone btwo {fill(i, 1)} btwo cthree {fill(i, 2)}", "s") for i in range(1000, 1040)]
    _, words, _, _ = toxicity.lexicon(docs.union(frame(spark, more)), labels)
    assert {"aone", "btwo", "cthree"} <= set(words)


def test_packed_pairs():
    code = np.cumsum(np.array([0, 1, 65534, 65535, 1 << 40, 3]))
    for n in (0, 6):
        for x, y in zip(toxicity._unpack(toxicity._pack(code[:n], np.array([1, 254, 255, 1 << 33, 7, 300])[:n])), (code, np.array([1, 254, 255, 1 << 33, 7, 300]))):
            assert x.tolist() == y[:n].tolist()


def test_toxicity_keeps_rare_edges_of_frequent_words(spark):
    rng = random.Random(17)
    rows = []
    for i in range(250):
        words = [f"w{rng.randrange(3000)}" for _ in range(260)]
        words[30::60] = ["zeta"] * len(words[30::60])
        if i < 5:
            words[31] = "rarum"
        rows.append((i, " ".join(words), "s"))
    docs = frame(spark, rows + [(i, "alone", "s") for i in range(250, 1000)])
    known, usual, total = toxicity.vocabulary(docs)
    h = {w: X.words(*X.string_buffer(pa.array([w]))).hash for w in ("zeta", "rarum")}
    active = toxicity._table(docs, {"h": h["zeta"].view(np.int64)}, "h long")
    steps = toxicity.transitions(docs, known, usual, total, active, h["zeta"]).collect()
    assert int(h["rarum"].view(np.int64)[0]) in {r["b"] for r in steps} and sum(r["p"] for r in steps) == pytest.approx(1)


def test_pair_counts():
    known = np.sort(X.words(*X.string_buffer(pa.array(["a b c"]))).hash)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b a x c", "b", None])], ["text"])
    place = {w: int(np.searchsorted(known, X.words(*X.string_buffer(pa.array([w]))).hash[0])) for w in "abc"}
    out = next(toxicity._count_pairs(known, np.array([place["a"]]))(iter([batch])))
    got = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    assert got == {place["a"] * 3 + place["b"]: 2, place["a"] * 3 + place["a"]: 2, place["a"] * 3 + place["c"]: 2}


def test_toxicity_edges_are_all_pairs_near_each_other(spark):
    """Counts over a byte, from several tasks, against counting by hand; windows end with their text."""
    rng = random.Random(18)
    texts = [" ".join(["often", "usual"] * 40 + [f"v{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(80))]) for _ in range(40)]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate([*texts, *["alone"] * 100, None, ""])]).repartition(3)
    known, _, total = toxicity.vocabulary(docs)
    h, n = toxicity._words(known)
    name = {r["h"]: r["word"].decode() for r in known.collect()}
    name = [name[x] for x in h.view(np.int64).tolist()]
    tokens, _ = toxicity.numbered(docs, spark.createDataFrame([(0, 1, 0)], LABELS), h)
    edges, _ = toxicity.graph(tokens, n, total)
    got = {}
    for r in edges.collect():
        code, count = toxicity._unpack(r["edges"])
        got |= {(name[c // len(n)], name[c % len(n)]): k for c, k in zip(code.tolist(), count.tolist())}
    place, want = {w: i for i, w in enumerate(name)}, {}
    for t in texts:
        words = t.split()
        for i, x in enumerate(words):
            for y in words[i + 1 : i + 1 + toxicity.WINDOW]:
                if x != y and x in place and y in place:
                    pair = (x, y) if place[x] > place[y] else (y, x)
                    want[pair] = want.get(pair, 0) + 1
    keep = lambda x, y, k: k >= 3 and np.log(k * total / (n[place[x]] * n[place[y]] * 2 * toxicity.WINDOW)) > 0
    assert got == {(x, y): k for (x, y), k in want.items() if keep(x, y, k)} and max(got.values()) > 3 * 255


def test_toxicity_moves_little(spark):
    """What is shuffled stands on disk until the driver collects it: packed pairs, and a row for a range of words and not for each in a step."""
    folder = "/root/testdata/sf0.01"
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages() -> dict[int, int]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    last = max(stages(), default=-1)
    toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).count()
    moved = sum(n for k, n in stages().items() if k > last)
    assert 0 < moved < 7 * Path(folder, "documents.parquet").stat().st_size


def test_toxicity_odd(odd, empty, rude, no_labels):
    _, labels, _ = rude
    assert all(r["score"] == 0 and not r["toxic"] for r in toxicity.toxicity(odd, no_labels).collect())
    assert toxicity.toxicity(odd, labels).count() == len(odd_rows()) and toxicity.toxicity(empty, labels).count() == 0


# --- 6 suffix array ---


def brute_spans(rows, length):
    seen = defaultdict(list)
    texts = {(i, t): re.findall(r"[^\t-\r\x1c-\x20]+", t or "") for i, t, _ in rows if i is not None}
    for key in sorted(texts, key=lambda k: (k[0], k[1] or "")):
        for s in range(len(texts[key]) - length + 1):
            seen[tuple(texts[key][s : s + length])].append((key, s))
    marks = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for n, (key, s) in enumerate(places):
                marks[key, n == 0].add(s)
    out = []
    for (key, first), starts in marks.items():
        begin = end = None
        for s in sorted(starts):
            if end is not None and s <= end:
                end = s + length
            else:
                if end is not None:
                    out.append((key[0], begin, end, first))
                begin, end = s, s + length
        out.append((key[0], begin, end, first))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, suffixes.CHUNK_BYTES])
def test_suffixes_against_brute_force(spark, chunk):
    rng = random.Random(9)
    passages = [sentence(rng, rng.randrange(45, 140)).split() for _ in range(12)]
    rows = []
    for i in range(100):
        words = sentence(rng, rng.randrange(0, 80)).split()
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            part = p[a : len(p) - rng.randrange(0, 20)]
            if rng.random() < 0.3:
                part = list(part)
                part[rng.randrange(len(part))] = "changed"
            k = rng.randrange(len(words) + 1)
            words[k:k] = part
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), "s"))
    got = sorted(tuple(r) for r in suffixes.repeated_spans(frame(spark, rows), chunk_bytes=chunk).collect())
    assert got == brute_spans(rows, suffixes.LENGTH) and len(got) > 40


def test_suffixes_of_a_hot_passage(spark):
    rng = random.Random(10)
    hot = sentence(rng, 120)
    rows = [(i, f"{sentence(rng, rng.randrange(0, 9))} {hot} {sentence(rng, 3)}", "s") for i in range(300)]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in suffixes.repeated_spans(frame(spark, rows)).collect())
    assert got == brute_spans(rows, suffixes.LENGTH)


@pytest.mark.parametrize("times", [2, 5])
def test_suffixes_of_repeated_rows(spark, times):
    rng = random.Random(19)
    texts = [sentence(rng, 90) for _ in range(4)]
    rows = [(1, texts[0], "s")] * times + [(2, texts[1], "s")] * times + [(3, texts[1], "s")] * times + [(4, texts[2], "s"), (0, texts[3] + " " + texts[3], "s")] + [(0, texts[3] + " " + texts[3], "s")]
    got = sorted(tuple(r) for r in suffixes.repeated_spans(frame(spark, rows).coalesce(1)).collect())
    assert got == brute_spans(rows, suffixes.LENGTH) and {r[0] for r in got} == {0, 2, 3}


def test_suffixes_compare_bytes(spark, monkeypatch):
    """Where all words of a length share a hash, only equal bytes count."""
    monkeypatch.setattr(suffixes.X, "words", lambda *a, own=X.words, **k: (w := own(*a, **k))._replace(hash=(w.end - w.start).astype(np.uint64) if len(w.hash) else w.hash))
    rng = random.Random(20)
    base = sentence(rng, 70).split()
    rows = [(i, " ".join(base if i % 2 else [w[::-1] if k == 30 else w for k, w in enumerate(base)]), "s") for i in range(4)]
    batch = lambda columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["unit", "doc_id", "text"])
    got = list(suffixes._anchor_batches(iter([batch([[0, 1, 2, 3], [0, 1, 2, 3], [t for _, t, _ in rows]])])))
    runs = [[{"s": r["s"], "e": r["e"], "p": r["p"]} for b in got for r in b.to_pylist() if r["unit"] == u] for u in range(4)]
    held = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array([0, 1, 2, 3]), pa.array([t for _, t, _ in rows]), pa.array(runs, pa.list_(pa.struct([(x, pa.int32()) for x in "sep"])))], ["unit", "doc_id", "text", "runs"])
    cut = pa.Table.from_batches(list(suffixes._cut(iter([held])))).sort_by([("head", "ascending"), ("salt", "ascending")]).combine_chunks().to_batches()
    spans = [tuple(r.values())[1:4] for b in suffixes._ranges(1)(iter(cut)) for r in b.to_pylist()]
    want = brute_spans(rows, suffixes.LENGTH)
    assert {d for d, *_ in spans} == {d for d, *_ in want} and all((min(a for x, a, _ in spans if x == d), max(b for x, _, b in spans if x == d)) == (a, b) for d, a, b, _ in want)


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, (6, 400)).astype(np.uint64)
    order, common = suffixes.multikey_quicksort(keys)
    rows = [tuple(keys[:, k]) for k in order]
    assert rows == sorted(rows)
    for k in range(1, 400):
        n = next((d for d in range(6) if rows[k][d] != rows[k - 1][d]), 6)
        assert common[k] == n


def test_suffixes_odd(odd, empty, spark):
    got = sorted(tuple(r) for r in suffixes.repeated_spans(odd).collect())
    assert [g for g in got if g[0] == 4] == [(4, 0, 30_000, True)] and [g for g in got if g[0] == 5] == [(5, 0, 30_000, False)]
    assert suffixes.repeated_spans(empty).count() == 0
    again = frame(spark, [(1, "a b " * 60, "s"), (2, None, "s")])  # repeats inside one text
    assert [(r["doc_id"], r["first_occurrence"]) for r in suffixes.repeated_spans(again).orderBy("first_occurrence").collect()] == [(1, False), (1, True)]


# --- 7 simhash ---


def test_golay_is_perfect():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 500).astype(np.int32)
    code = {int(m): int(m) << 11 | int(golay._HIGH[m]) for m in range(1 << 12)}
    assert all(int(w ^ code[int(m)]).bit_count() <= 3 for w, m in zip(words, golay.decode(words)))
    near = golay.near_indices(words)
    assert set((near >= 0).sum(1).tolist()) <= {1, 6}
    for w, own in zip(words[:100], near[:100]):
        for _ in range(5):
            a, b = rng.choice(23, 2, replace=False)
            assert set(golay.near_indices(np.array([w ^ (1 << a) ^ (1 << b)]))[0]) & set(own[own >= 0])


@pytest.mark.parametrize("split", [0, 2, 12])
def test_near_pairs_exact_up_to_8_bits(split):
    rng = np.random.default_rng(4)
    hi, lo = (np.concatenate([x, x, x]) for x in (rng.integers(0, 1 << 46, 150), rng.integers(0, 1 << 46, 150)))
    for k in range(150, 450):
        for b in rng.choice(92, rng.integers(0, 6), replace=False):
            if b < 46:
                hi[k] ^= 1 << int(b)
            else:
                lo[k] ^= 1 << int(b - 46)
    row, g = simhash.groups(hi, lo, split)
    o = np.argsort(g, kind="stable")
    batch = pa.RecordBatch.from_arrays([pa.array(g[o]), pa.array(hi[row[o]]), pa.array(lo[row[o]]), pa.array(row[o])], ["g", "hi", "lo", "rep"])
    found = {tuple(r.values()) for part in simhash._edge_batches(split)(iter([batch.slice(i, 333) for i in range(0, batch.num_rows, 333)])) for r in part.to_pylist()}
    for a in range(450):
        d = simhash.distance(hi[a], lo[a], hi, lo)
        for b in np.flatnonzero((d > 0) & (d <= 8)):
            assert (min(a, b), max(a, b)) in found


def test_forest_spans_large_groups():
    rng = np.random.default_rng(5)
    hi, lo = np.zeros(300, np.int64), rng.integers(0, 4, 300)
    hi[150:] = (1 << 46) - 1
    edges = simhash.forest(hi, lo)
    assert len(edges) == 298 and all((a < 150) == (b < 150) for a, b in edges)


def test_near_groups(spark):
    rng = random.Random(12)
    rows, truth = [], {}
    for g in range(40):
        words = sentence(rng, 200).split() + [f"w{g}x{k}" for k in range(150)]
        for c in range(rng.choice([1, 1, 2, 3, 8])):
            mine = list(words)
            for _ in range(rng.randrange(0, 6) if c else 0):
                mine[rng.randrange(len(mine))] = f"new{rng.randrange(9999)}"
            truth[len(rows)] = g
            rows.append((len(rows), " ".join(mine), "s"))
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(frame(spark, rows)).collect()}
    pairs = [(a, b) for a in truth for b in truth if a < b]
    same = [p for p in pairs if truth[p[0]] == truth[p[1]]]
    assert np.mean([got[a] == got[b] for a, b in same]) >= 0.9
    assert not [p for p in pairs if truth[p[0]] != truth[p[1]] and got[p[0]] == got[p[1]]]
    kept = simhash.drop_near_copies(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if got[i] == i)


@pytest.mark.parametrize("size", [50, 90, 180, 450])
def test_near_recall_by_length(spark, size):
    rng, rows = random.Random(size), []
    for g in range(150):
        words = [f"w{g}x{k}" for k in range(size)]
        own = list(words)
        for k in rng.sample(range(size), size // 10):  # word-set Jaccard 0.82
            own[k] = f"new{g}x{k}"
        rows += [(2 * g, " ".join(words), "s"), (2 * g + 1, " ".join(own), "s")]
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(frame(spark, rows)).collect()}
    assert np.mean([got[2 * g + 1] == 2 * g for g in range(150)]) >= 0.9 and all(i // 2 == g // 2 for i, g in got.items())


def test_forest_grows_along_alike_points():
    rng = np.random.default_rng(6)
    hi, lo = np.zeros(60, np.int64), np.append(0, 1 << rng.integers(0, 8, 59))
    sketch = np.append(np.zeros((1, simhash.SKETCH), np.uint16), np.ones((59, simhash.SKETCH), np.uint16), axis=0)
    edges = simhash.bucket_edges(np.zeros(60, np.int64), hi, lo, sketch, np.arange(60))
    assert len(edges) == 58 and edges.min() > 0


def components_of(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in edges:
        x, y = find(int(x)), find(int(y))
        up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_groups_are_the_same_for_any_bucket_size(monkeypatch):
    """All pairs, a forest and a forest by groups, of alike and unlike points."""
    rng = np.random.default_rng(7)
    n, hi = 300, np.zeros(300, np.int64)
    lo = rng.integers(0, 1 << 46, n) & rng.integers(0, 1 << 46, n) & rng.integers(0, 1 << 46, n)
    base = rng.integers(0, 1 << 16, (6, simhash.SKETCH)).astype(np.uint16)
    sketch = base[rng.integers(0, 6, n)]
    other = rng.random(sketch.shape) < 0.35
    sketch[other] = rng.integers(0, 1 << 16, other.sum())
    own = lambda most: components_of(n, simhash.bucket_edges(np.zeros(n, np.int64), hi, lo, sketch, np.arange(n), most))
    want = own(10_000)
    assert 5 < len(set(want)) < n and own(1) == want
    monkeypatch.setattr(simhash, "MANY", 50)
    assert own(1) == want


def test_large_buckets_are_not_compared_pair_by_pair(monkeypatch):
    """Unlike points share the minima of usual words, each in other positions; their copies alone are alike."""
    rng = np.random.default_rng(8)
    n = 6000
    hi, lo = rng.integers(0, 1 << 46, (2, n))
    sketch = rng.integers(0, 1 << 16, (n, simhash.SKETCH)).astype(np.uint16)
    usual = rng.random(sketch.shape) < 0.3
    usual &= np.cumsum(usual, axis=1) < simhash.LEAST_EQUAL  # alone they make no pair alike
    sketch[usual] = np.broadcast_to(np.arange(simhash.SKETCH, dtype=np.uint16), sketch.shape)[usual]
    hi[n // 2 :], lo[n // 2 :], sketch[n // 2 :] = hi[: n // 2], lo[: n // 2] ^ 1, sketch[: n // 2]
    sketch[n // 2 :, ::3] = rng.integers(0, 1 << 16, sketch[n // 2 :, ::3].shape)
    compared, plain = [], simhash.distance

    def distance(*x):
        compared.append(np.broadcast(*x).size)
        return plain(*x)

    monkeypatch.setattr(simhash, "distance", distance)
    edges = simhash.bucket_edges(np.zeros(n, np.int64), hi, lo, sketch, np.arange(n))
    assert {(int(min(e)), int(max(e))) for e in edges} == {(k, k + n // 2) for k in range(n // 2)}
    assert sum(compared) < 50 * n


def test_equal_fingerprints_of_unlike_texts(spark):
    """A word that outweighs the rest gives unlike texts the same bits; only their copies are joined."""
    tail = lambda k, n=19: " ".join(f"t{k}x{j}" for j in range(n))
    rows = [(k, "foo " * 4000 + tail(k % 40), "s") for k in range(80)]
    seg, _, _ = simhash.fingerprints(*X.string_buffer(pa.array([t for _, t, _ in rows])))
    assert len(np.unique(seg, axis=0)) == 1
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(frame(spark, rows)).collect()}
    assert got == {k: k % 40 for k in range(80)}


def test_near_odd(odd, empty):
    got = Counter(tuple(r) for r in simhash.near_groups(odd).collect())
    assert got[5, 4, False] == 2 and got[4, 4, True] == 1 and got[1, 1, True] == 1 and got[2, 2, True] == 1 and got[3, 3, True] == 1
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 2
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


# --- 8 chat ---


def test_chat_round_trip(spark):
    turns = [(1, 2, "assistant", "hi <|im_end|> there"), (1, 1, "user", "hello\n<|im_start|>system"), (2, 1, "assistant", None), (3, 1, None, "x"), (None, 1, "user", "lost"), (3, 1, None, "x"), (4, 1, "assistant", r"<\|im_end|> and <|endoftext|>"), (5, None, "user", "数学 \U0001f600")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    enc = chat._encoder(chat.VOCABULARY)
    names = {v: k for k, v in chat.RESERVED.items()}
    for conv, r in got.items():
        ids, mask = r["input_ids"], r["loss_mask"]
        assert len(ids) == len(mask) == r["n_tokens"] and sum(mask) == r["n_trained"]
        parts, plain = [], []
        for k in ids:
            if k in names:
                parts += [enc.decode(plain), names[k]]
                plain = []
            else:
                plain.append(k)
        own = sorted([t for t in turns if t[0] == conv], key=lambda t: (t[1] or 0, t[2] or "", t[3] or ""))
        assert parts.count(chat.START) == parts.count(chat.END) == len(own) and parts[-1] == chat.TEXT_END
        bodies = [parts[k + 1] for k, p in enumerate(parts) if p == chat.START]
        assert [chat.unescape(b) for b in bodies] == [f"{t[2] or ''}\n{t[3] or ''}" for t in own]
        assert not any(c in b for b in bodies for c in chat.RESERVED)
        trained = "".join(enc.decode([k]) if k not in names else names[k] for k, m in zip(ids, mask) if m)
        assert chat.unescape(trained) == "".join(chat.unescape(chat.escape(t[3] or "")) + chat.END for t in own if t[2] == "assistant")


def test_chat_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 9 repetition ---


def brute_repetition(text):
    words = re.findall(r"[^\t-\r\x1c-\x20]+", text or "")
    total = max(1, sum(map(len, words)))
    lines = [tuple(x) for x in (re.findall(r"[^\t-\r\x1c-\x20]+", line) for line in (text or "").split("\n")) if x]
    counts = Counter(lines)
    out = {"line": sum(sum(map(len, x)) for x in lines if counts[x] > 1) / total}
    for rule in list(repetition.RULES)[1:]:
        kind, n = rule.split("_")
        n = int(n)
        runs = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        c = Counter(runs)
        if kind == "top":
            inside = defaultdict(set)
            for k, g in enumerate(runs):
                inside[g].update(range(k, k + n))
            out[rule] = max([sum(len(words[k]) for k in inside[g]) for g, v in c.items() if v > 1], default=0) / total
        else:
            inside = {k + d for k, g in enumerate(runs) if c[g] > 1 for d in range(n)}
            out[rule] = sum(len(words[k]) for k in inside) / total
    return out


def test_repetition_against_brute_force(spark):
    rng = random.Random(13)
    texts = [None, "", "a", "a a", "x\nx", "é é é é", "one two three " * 30]
    for _ in range(150):
        few = rng.sample(WORDS, rng.choice([3, 10, 60]))
        texts.append("".join(rng.choice(few) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(rng.randrange(1, 150))))
    got = {r["doc_id"]: r for r in repetition.repetition(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = brute_repetition(t)
        assert {k: got[i][k] for k in want} == pytest.approx(want, abs=1e-6)
        assert got[i]["keep"] == all(v <= repetition.RULES[k] + 1e-9 for k, v in want.items())


def test_repetition_odd(odd, empty):
    rows = {r["doc_id"]: r for r in repetition.repetition(odd).collect()}
    assert all(r[k] == 0 for i in (1, 2, 3) for r in [rows[i]] for k in repetition.RULES) and all(rows[i]["keep"] for i in (1, 2, 3, 6))
    assert {k: rows[5][k] for k in repetition.RULES} == {k: rows[4][k] for k in repetition.RULES} == pytest.approx(brute_repetition(odd_rows()[3][1]), abs=1e-6)
    assert repetition.repetition(odd).count() == len(odd_rows()) and repetition.repetition(empty).count() == 0


# --- 10 bpe ---


def whole_encoder():
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=chat._PATTERN, mergeable_ranks=bpe._ranks(bpe.VOCABULARY), special_tokens={})


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_bpe_equals_encoding_whole_texts(spark, most):
    rng = random.Random(14)
    texts = [None, "", " ", "  two  blanks ", "it's we'll I'm", "a\n\n b\t", "naïve 数学 \U0001f600", "<|endoftext|>", "x" * 3000, " nb em\x85", "12345 67a"]
    texts += ["".join(rng.choice(["ab", "é", " ", "  ", "\n", "9", "'s", "!?", "数", "The"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, "again", "s"), (None, "again", "s")]
    got = bpe.encode(frame(spark, rows), map_side_bytes=most).collect()
    enc = whole_encoder()
    assert len(got) == len(rows) and all(r["lossless"] and len(r["ids"]) == r["n_tokens"] for r in got)
    want = Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want


def test_bpe_decode(spark):
    texts = ["", "naïve 数学 \U0001f600", "plain text, twice twice", " lead"]
    back = bpe.decode(bpe.encode(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))


def test_bpe_words_decode_by_join(spark):
    """What ids give decides: a word with another's ids, and ids outside the vocabulary, don't come back."""
    ranks = {v: k.decode() for k, v in bpe._ranks(bpe.VOCABULARY).items() if k.isalpha() and k.isascii()}
    (i, a), (j, b) = list(ranks.items())[:2]
    table = spark.createDataFrame([(a + b, 1, [i, j]), (b + a, 2, [i, j]), (a, 3, [i, 1 << 30])], "word string, hash long, ids array<int>")
    assert {r["word"]: bytes(r["back"]).decode() for r in bpe.decoded(table).collect()} == {a + b: a + b, b + a: a + b, a: a}


def test_bpe_odd(odd, empty):
    got = bpe.encode(odd)
    assert got.columns == ["doc_id", "ids", "n_tokens", "lossless"] and got.count() == len(odd_rows()) and got.filter("not lossless").count() == 0
    assert bpe.encode(empty).count() == 0
