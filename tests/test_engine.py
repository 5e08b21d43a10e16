"""Index, evaluation, suggestions, search modes: small corpora with answers worked out by hand, and plain-Python scoring."""

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.functions.snippet import analyze
from quillon.operators import lexical, patterns, rank, succinct
from quillon.plans.engine import Searcher
from quillon.plans.index import Index, corpus_of, numbered
from quillon.plans.parser import ParsedQuery, parse, route
from quillon.sources import corpora

TINY = [
    (0, "Retrieval", "Information retrieval ranks documents for a query."),
    (1, "Suffixes", "A suffix array sorts the suffixes of a text."),
    (2, "Wavelets", "A wavelet tree answers rank on a sequence."),
    (3, "Engines", "A search engine joins an inverted index with ranking; C++17 and C++20 builds exist."),
    (4, "Codes", "Compression combines an array of deltas with codes for a suffix of bits."),
]


def corpus(spark, rows):
    return corpus_of(spark.createDataFrame(rows, "doc_id long, title string, text string"), title="title")


def build(spark, rows, **kw):
    return Index.build(corpus(spark, rows), **kw)


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    return build(spark, TINY, path=str(tmp_path_factory.mktemp("tiny")))


@pytest.fixture(scope="module")
def rand(spark, tmp_path_factory):
    """400 documents, so that frequent terms fill several blocks."""
    rng = random.Random(1)
    rows = [(i, "", " ".join(f"term{int(rng.paretovariate(0.7)) % 50}" for _ in range(rng.randrange(20, 100)))) for i in range(400)]
    return rows, build(spark, rows, stemming=False, path=str(tmp_path_factory.mktemp("rand")))


def ords(hits):
    return [r["ord"] for r in hits.orderBy("rank").collect()]


def brute(rows, terms, k, need=1):
    docs = [Counter(t for t, *_ in analyze(f"{a} {b}", stemming=False)) for _, a, b in rows]
    sizes = [sum(d.values()) for d in docs]
    avg = sum(sizes) / len(docs)
    out = []
    for o, d in enumerate(docs):
        score = 0.0
        have = [t for t in terms if d[t]]
        for t in have:
            df = sum(1 for x in docs if x[t])
            score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * d[t] * 1.9 / (d[t] + 0.9 * (0.6 + 0.4 * sizes[o] / avg))
        if len(have) >= need:
            out.append((-round(score, 6), o))
    return [o for _, o in sorted(out)[:k]]


def test_parse():
    assert parse("suffix array") == ParsedQuery(["suffix", "arrai"], [], [], [], False) and parse("suffix array").kind == "and"
    assert parse("a OR b cats").has_or and parse("cats Or dogs").kind == "and" and parse("AND NOT cats").positive == ["cat"]
    assert parse("b-tree -key-value -").negative == ["kei", "valu"] and parse("-only").kind == "none"
    p = parse('x1 "state of the art" "second part" y1')
    assert p.phrase == ["state", "art"] and p.phrase_places == [0, 3] and p.positive == ["x1", "second", "part", "y1"] and p.kind == "and"
    assert parse('"open quote').positive == ["open", "quot"] and parse('"apple pie" -tart').kind == "phrase"
    assert parse("cats cat cats").positive == ["cat"]


def test_route():
    assert route("").mode == "empty" and route("/a+/") == ("regex", "a+", 0) and route("/").mode == "standard"
    assert route("foo~1 bar") == ("fuzzy", "foo", 1) and route("foo~") == ("fuzzy", "foo", 2) and route("foo~9").distance == 2 and route("foo~x").distance == 2
    assert route("foo", 1) == ("fuzzy", "foo", 1) and route("foo~0", 2).distance == 0


def test_boolean_and_phrase(tiny):
    e = Searcher(tiny)
    assert set(ords(e.evaluate("suffix array"))) == {1, 4}
    assert ords(e.evaluate('"suffix array"')) == [1] and ords(e.evaluate('"suffix combines"')) == []
    assert set(ords(e.evaluate("suffix OR wavelet"))) == {1, 2, 4} and ords(e.evaluate("suffix -compression")) == [1]
    assert ords(e.evaluate("-suffix")) == [] and ords(e.evaluate("suffix nosuchword")) == [] and ords(e.evaluate("the of")) == [] and ords(e.evaluate("")) == []
    assert len(ords(e.evaluate("array OR suffix OR rank OR index", 2))) == 2


def test_mixed_phrase_is_ignored_unless_strict(tiny):
    e = Searcher(tiny)
    assert set(ords(e.evaluate('array "suffix combines"'))) == {1, 4}
    assert ords(e.evaluate('array "suffix array"', strict_phrase=True)) == [1]


def test_phrase_over_stopwords(spark):
    e = Searcher(build(spark, [(0, "", "a state of the art machine"), (1, "", "state art")]))
    assert ords(e.evaluate('"state of the art"')) == [1] and ords(e.evaluate('"state of the art"', gaps=True)) == [0]


def test_phrase_stems_twice_at_need(spark):
    e = Searcher(build(spark, [(0, "", "organizations agreed the rest"), (1, "", "other")]))
    assert ords(e.evaluate('"organizations agreed"')) == [0]


def test_ties_follow_ids(spark):
    e = Searcher(build(spark, [(40, "", "equal text"), (10, "", "equal text"), (30, "", "equal text"), (20, "", "equal text")]))
    hits = e.show(e.search("equal"))
    assert [h["doc_id"] for h in hits] == [10, 20, 30, 40] and [h["rank"] for h in hits] == [1, 2, 3, 4]


def test_heavy_negation(spark):
    e = Searcher(build(spark, [(i, "", "target common" + (" stopword" if i % 2 == 0 else "")) for i in range(30)]))
    assert ords(e.evaluate("target common -stopword")) == list(range(1, 21, 2))


def test_random_or_and_against_python(rand):
    rows, index = rand
    rng = random.Random(2)
    asked = [(i, [f"term{rng.randrange(50)}" for _ in range(rng.randrange(1, 5))]) for i in range(25)]
    both = [(i, ParsedQuery(list(dict.fromkeys(t)), [], [], [], i % 2 == 0)) for i, t in asked]
    got = defaultdict(list)
    for r in rank.evaluate(index, both, 7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["ord"])
    for i, q in both:
        assert got[i] == brute(rows, q.positive, 7, 1 if q.kind == "or" else len(q.positive)), q


@pytest.mark.parametrize("terms", [["term1", "term2", "term3"], ["term1"], ["term40", "term1", "term7"], ["nosuch"], ["term3", "term49", "term30", "term2"]])
def test_pruning_loses_nothing(rand, terms):
    rows, index = rand
    assert index.blocks.groupBy("term").count().agg(F.max("count")).first()[0] > 1
    assert ords(rank.disjunction_pruned(index, terms, 10)) == brute(rows, terms, 10)


def test_best_document_in_a_later_block(spark):
    rows = [(i, "", "common filler words here") for i in range(300)] + [(300, "", "common " * 30)]
    index = build(spark, rows, stemming=False)
    assert ords(rank.disjunction_pruned(index, ["common"], 3))[0] == 300


def test_empty_documents_count(spark):
    index = build(spark, [(0, None, None), (1, "", "the of and"), (2, "", "word")])
    one = index.index_stats.first()
    assert (one["total_docs"], one["total_tokens"]) == (3, 1) and one["avg_doc_len"] == pytest.approx(1 / 3)
    none = Index.build(corpus(spark, []))
    assert none.index_stats.first()["total_docs"] == 0 and ords(Searcher(none).evaluate("x y")) == []


def test_save_load_checks(spark, tmp_path):
    build(spark, TINY, path=str(tmp_path))
    assert Index.load(spark, str(tmp_path)).corpus.count() == 5
    with pytest.raises(ValueError):
        Index.load(spark, str(tmp_path), k1=1.2)
    spark.createDataFrame([(0, 0, 0, 0)], "ord long, ext_id long, length long, bytes long").write.mode("append").parquet(f"{tmp_path}/doc_stats")
    with pytest.raises(ValueError):
        Index.load(spark, str(tmp_path))


@pytest.mark.parametrize("runs", [None, 1, 37, 5000])
def test_numbered_in_runs(spark, runs):
    rng = random.Random(3)
    words = sorted({f"w{rng.randrange(10**6)}" for _ in range(700)})
    for column, values in (("string", words), ("long", sorted(rng.sample(range(10**6), 700)))):
        mixed = list(values)
        rng.shuffle(mixed)
        got = numbered(spark.createDataFrame([(v,) for v in mixed], f"v {column}").repartition(4), "v", "n", runs).collect()
        assert [r["v"] for r in sorted(got, key=lambda r: r["n"])] == values and sorted(r["n"] for r in got) == list(range(len(values)))
    assert numbered(spark.createDataFrame([], "v long"), "v", "n", runs).count() == 0


def test_blocks_of_a_term_in_many_ranges(spark):
    """A common term's list spans ranges; its blocks of 128 go on over their boundaries."""
    rows = [(i, "", "common " + ("often " if i % 3 else "") + f"rare{i}") for i in range(1500)]
    index = build(spark, rows, stemming=False)
    for term, ords in (("common", list(range(1500))), ("often", [i for i in range(1500) if i % 3])):
        got = [(r["block_no"], r["min_ord"], r["max_ord"], r["num_docs"]) for r in index.blocks.filter(F.col("term") == term).orderBy("block_no").collect()]
        cut = [ords[k : k + 128] for k in range(0, len(ords), 128)]
        assert got == [(k, c[0], c[-1], len(c)) for k, c in enumerate(cut)]


def test_numbered_where_they_lie(spark, tmp_path):
    """Files whose ids ascend are numbered without an exchange; others, and gaps, nulls and overlaps, give the same numbers."""
    from quillon.plans.index import _in_place

    rng = random.Random(6)
    ids = sorted(rng.sample(range(10**6), 3000))
    cut = [ids[k * 500 : (k + 1) * 500] for k in range(6)]
    rng.shuffle(cut)
    write = lambda path, parts: [spark.createDataFrame([(i, f"text {i}") for i in p], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(path)) for p in parts]
    write(tmp_path / "a", cut)
    docs = spark.read.parquet(str(tmp_path / "a"))
    want = [(n, i, "", f"text {i}") for n, i in enumerate(ids)]
    placed = corpus_of(docs)
    assert "RangePartitioning" not in (plan := placed._jdf.queryExecution().toString()) and "rangepartitioning" not in plan and "ranges-" not in plan
    assert sorted(tuple(r) for r in placed.collect()) == want
    assert sorted(tuple(r)[:2] for r in corpus_of(docs.filter("doc_id % 3 <> 0")).collect()) == list(enumerate(i for i in ids if i % 3))
    write(tmp_path / "b", [cut[0], cut[1], cut[2] + [None], cut[3], cut[4], cut[5] + [cut[5][-1]]])
    other = spark.read.parquet(str(tmp_path / "b"))
    assert _in_place(other.select("doc_id"), "doc_id", "n") is None and [r["ord"] for r in corpus_of(other).orderBy("ord").collect()] == list(range(3002))
    write(tmp_path / "c", [ids[k::6] for k in range(6)])
    assert sorted(tuple(r) for r in corpus_of(spark.read.parquet(str(tmp_path / "c"))).collect()) == want


def test_postings_of_an_index(spark, monkeypatch):
    """Packed and unpacked postings are the words' places, in any order of documents, with few words or ranges at once; deltas and blocks go on over ranges."""
    from quillon.plans import index as module

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["common", "The", "of", "Ähnlich", "ähnlich", *(f"w{rng.randrange(300)}" for _ in range(3))]) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(700)]
    want = defaultdict(list)
    for o, t in enumerate(texts):
        for p, w in enumerate(t.lower().split()):
            if w not in ("the", "of"):
                want[w, o].append(p)
    c = corpus(spark, [(i, "", t) for i, t in enumerate(texts)]).repartition(3)  # a text begins after the title and a blank
    for most in (2_000_000, 40):
        monkeypatch.setattr(module, "MOST_WORDS", most)
        index = Index.build(c, stemming=False)
        rows = index.postings.collect()
        lengths = Counter()
        for (_, o), p in want.items():
            lengths[o] += len(p)
        assert {(r["term"], r["ord"]): r["tf"] for r in rows}.keys() == want.keys() and len(rows) == len(want)
        assert all([x - r["positions"][0] for x in r["positions"]] == [x - want[r["term"], r["ord"]][0] for x in want[r["term"], r["ord"]]] and r["tf"] == len(r["positions"]) and r["length"] == lengths[r["ord"]] for r in rows)
        assert {r["ord"]: r["length"] for r in index.doc_stats.collect()} == {o: lengths[o] for o in range(700)}
        before, steps = {}, {}
        for w, o in sorted(want):
            steps[w, o] = o - before.get(w, 0)
            before[w] = o
        plan = (deltas := index.deltas())._jdf.queryExecution().executedPlan().toString()
        assert {(r["term"], r["ord"]): r["delta"] for r in deltas.collect()} == steps and "Window" not in plan and "hashpartitioning" not in plan
        df = Counter(w for w, _ in want)
        assert {r["term"]: r["doc_freq"] for r in index.lexicon.collect()} == df
        of = defaultdict(list)
        for w, o in sorted(want):
            of[w].append(o)
        blocks = {(r["term"], r["block_no"]): (r["min_ord"], r["max_ord"], r["num_docs"]) for r in index.blocks.collect()}
        assert blocks == {(w, k // 128): (o[k], o[min(k + 127, len(o) - 1)], len(o[k : k + 128])) for w, o in of.items() for k in range(0, len(o), 128)}


def test_pruning_loses_nothing(spark, monkeypatch):
    """Ties after rounding go by ord across blocks; cells of one and of many documents."""
    rng = random.Random(4)
    rows = [(i, "", " ".join(["apple"] * rng.choice([0, 1, 1, 1, 2, 9 if rng.random() < 0.02 else 1]) + ["pear"] * rng.choice([0, 1, 3]) + ["filler"] * rng.choice([4, 4, 20]))) for i in range(2500)]
    index = build(spark, rows, stemming=False)
    for words in (["apple", "pear"], ["apple"], ["pear", "unknown"]):
        want = [tuple(r) for r in rank.evaluate(index, [(0, " OR ".join([*words, "x"]))], 15).collect()]
        for cells in (1 << 16, 40, 3):
            monkeypatch.setattr(rank, "CELLS", cells)
            assert [tuple(r) for r in rank.disjunction_pruned(index, words, 15, least=1).collect()] == want
    assert rank.disjunction_pruned(index, ["unknown"], 15, least=0).count() == 0


def test_table_of_queries(spark, tiny, monkeypatch):
    """A table of queries gives what each gives alone, broadcast or shuffled; free text takes any of its words."""
    asked = [(1, "search engine"), (2, "fast OR index"), (3, '"search engine"'), (4, "search -fast"), (5, ""), (6, None), (7, "nothingofthekind")]
    table = spark.createDataFrame(asked, "query_id long, query string")
    want = sorted(tuple(r) for r in rank.evaluate(tiny, [(i, q) for i, q in asked if q], 10).collect())
    for most in (100_000, 0):
        monkeypatch.setattr(rank, "MOST_TERMS", most)
        assert sorted(tuple(r) for r in rank.evaluate_frame(tiny, table).collect()) == want and want
    free = rank.evaluate_frame(tiny, spark.createDataFrame([(1, "search -fast"), (2, "search fast")], "query_id long, query string"), any_term=True).collect()
    either = rank.evaluate(tiny, [(0, "search OR fast")]).collect()
    assert [[tuple(r)[1:] for r in free if r[0] == i] for i in (1, 2)] == [[tuple(r)[1:] for r in either]] * 2


@pytest.mark.parametrize("width", [1 << 14, 64, 1])
def test_batch_by_cells(rand, spark, monkeypatch, width):
    """A batch gives what each query gives alone, with ties, in cells of any size; what is shuffled are packed postings, not pairs of query and document."""
    rows, index = rand
    rng = random.Random(8)
    asked = [(i, (" OR " if i % 2 else " ").join(f"term{rng.randrange(52)}" for _ in range(rng.randrange(1, 5))) + (" -term3" if i % 3 == 0 else "")) for i in range(30)]
    asked += [(30, '"term1 term2"'), (31, "nosuch"), (32, "term1 OR nosuch"), (33, "term1 nosuch")]
    want = sorted(tuple(r) for i, q in asked for r in rank.evaluate(index, [(i, q)], 7).select(F.lit(i).cast("long"), "rank", "ord", "score").collect()) if width == 64 else None
    monkeypatch.setattr(rank, "CELL", width)
    words = rank.evaluate_frame(index, spark.createDataFrame([a for a in asked if a[0] != 30], "query_id long, query string"), 7)
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cell" in plan and "hashpartitioning(query_id#" in plan and ", ord#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    got = sorted(tuple(r) for r in rank.evaluate_frame(index, spark.createDataFrame(asked, "query_id long, query string"), 7).collect())
    assert got and (want is None or got == want) and len({r[0] for r in got}) > 20
    monkeypatch.setattr(rank, "MOST_TERMS", 0)
    assert got == sorted(tuple(r) for r in rank.evaluate_frame(index, spark.createDataFrame(asked, "query_id long, query string"), 7).collect())


def test_simple_engine_keeps_rows_whole(spark, tmp_path):
    """The plain engine's scores, exact and by near words, against plain Python; words are neither sorted nor shuffled."""
    rng = random.Random(9)
    near = lambda a, b: a == b or any(a[:i] + c + a[i + d :] == b for i in range(len(a) + 1) for c in ("", *"abcx") for d in (0, 1))
    within = lambda a, b: any(near(a[:i] + c + a[i + d :], b) for i in range(len(a) + 1) for c in ("", *"abcx") for d in (0, 1))
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 4, 6, 9]))) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    docs = [t.split() for t in texts]
    corpus(spark, [(i, "", t) for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "c"))
    c = spark.read.parquet(str(tmp_path / "c"))
    for query, fuzzy in (("ab c ab zzzzzzz", False), ("abcabx xxxxxxxx ab abcabcabc", True), ("", True), ("qqqqqq", True)):
        times = Counter(query.split())
        if fuzzy:
            found = Counter()
            for w, n in times.items():
                all_ = [x for d in docs for x in d]
                best = w if w in all_ else next((x for x in all_ if within(x, w)), None)
                if best:
                    found[best] += n
            times = found
        df = {w: sum(w in d for d in docs) for w in times}
        avg = sum(map(len, docs)) / len(docs)
        score = lambda d: sum(n * math.log(1 + (60 - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 1.9 / (d.count(w) + 0.9 * (0.6 + 0.4 * len(d) / avg)) for w, n in times.items() if w in d)  # noqa: B023, E731
        want = sorted((-round(score(d), 6), o) for o, d in enumerate(docs) if any(w in d for w in times))[:15]
        got = rank.simple_bm25(c, query, fuzzy=fuzzy)
        assert [(r["ord"], r["score"]) for r in got.collect()] == [(o, -s) for s, o in want]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "hashpartitioning" not in plan and "Aggregate" not in plan


def test_costly_rows_are_made_once(spark):
    """Pages that are parsed and cleaned, and lines of JSON, are numbered without making them again to cut ranges."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, "0", None, f"Page {i}", "word " * 30) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_no long, ns string, redirect string, title string, text string").repartition(5, "page_no")
    got = corpora.wiki_articles(pages.mapInArrow(count, pages.schema))
    assert sorted((r["id"], r["title"]) for r in got.collect()) == [(i + 1, f"Page {i}") for i in range(300)] and made.value == 300
    lines = spark.createDataFrame([(i, json.dumps({"id": i + 5, "text": "x"})) for i in range(200)], "n long, value string")
    got = corpora.parse_json_lines(lines.mapInArrow(count, lines.schema), "value", "n")
    assert sorted((r["ord"], r["ext_id"]) for r in got.collect()) == [(i, i + 5) for i in range(200)] and made.value == 500


def test_prefix_order_and_suggest(spark):
    terms = ["an", "ant", "ants", "any", "b", "anz", "ané"]
    lexicon = spark.createDataFrame([(t, k + 1) for k, t in enumerate(terms)], "term string, doc_freq long")
    assert [r["term"] for r in lexical.prefix_terms(lexicon, "an", 10).collect()] == ["an", "ané", "anz", "any", "ant", "ants"]
    assert [r["term"] for r in lexical.prefix_suggest(lexicon, "AN", 2).collect()] == ["ané", "anz"]
    assert [r["term"] for r in lexical.prefix_suggest(lexicon, "an", 1, exact=True).collect()] == ["ané"] and lexical.prefix_suggest(lexicon, "").count() == 0


def test_fuzzy(spark):
    words = ["search", "seraph", "succinct", "march", "perch", "se", "sêarch"]
    lexicon = spark.createDataFrame([(t, k + 1) for k, t in enumerate(words)], "term string, doc_freq long")
    got = [(r["term"], r["edit_distance"]) for r in lexical.fuzzy_suggest(lexicon, "Serach").collect()]
    assert got == [("seraph", 1), ("perch", 2), ("search", 2)]
    asked = spark.createDataFrame([(k, w) for k, w in enumerate(["serach", "succint", "zzz", "é"])], "slot int, word string")
    plain = {tuple(r) for r in lexical.near_terms(lexicon, asked, 2, 5).collect()}
    assert plain == {tuple(r) for r in lexical.near_terms_batch(lexicon, asked, 2, 5).collect()} and plain


def test_did_you_mean(tiny):
    e = Searcher(tiny)
    assert e.did_you_mean("wavelt") == "wavelet" and e.did_you_mean("wavelet") == "" and e.did_you_mean("!!") == "!!" and e.did_you_mean("zzzzzzzzz") == ""
    assert e.search("wavelt treee").did_you_mean == "wavelet tree"


def test_modes(tiny):
    e = Searcher(tiny)
    assert ords(e.search(r"/C\+\+\d+/").hits) == [3] and e.search(r"/C\+\+\d+/").hits.first()["score"] == 2
    assert ords(e.search("inverted index", mode="substring").hits) == [3] and ords(e.search("wavelat~1").hits) == [2]
    assert e.search("retrieval").mode == "standard" and e.search("").hits.count() == 0 and e.search("x", 0).hits.count() == 0
    assert [s["term"] for s in e.suggest("suff")] == ["suffix"] and e.suggest("sufix", fuzzy=True)[0]["edit_distance"] == 1
    out = json.loads(e.search_json("suffix array"))
    assert out["total_hits"] == 2 and {h["doc_id"] for h in out["hits"]} == {1, 4} and "<em>suffix</em>" in out["hits"][0]["snippet"]
    assert "error" in json.loads(e.search_json("x" * 300)) and "error" in json.loads(e.search_json("/(/"))
    assert e.stats()["total_docs"] == 5 and e.health()["status"] == "ok" and json.loads(e.suggest_json("suff"))["suggestions"]
    many = e.evaluate_many([(7, "suffix"), (8, '"suffix array"')]).collect()
    assert {r["query_id"] for r in many} == {7, 8}


def test_substring(spark):
    c = corpus(spark, [(0, "ban", "ana nana"), (1, "", "BANANA"), (2, "x", "an"), (3, "", "a end")])
    assert [(r["ord"], r["score"]) for r in patterns.substring_search(c, "ana").collect()] == [(0, 3)]
    assert {r["ord"]: r["score"] for r in patterns.substring_search(c, "ana", straddling=True).collect()} == {0: 3, 2: 1}
    assert patterns.substring_search(c, "").count() == 0 and patterns.substring_search(c, "a.a").count() == 0
    text = corpus(spark, [(0, "", "éanana"), (1, "", "ananas")])
    assert sorted((r["ord"], r["at"]) for r in patterns.locate(text, "ana").collect()) == [(0, 2), (0, 4), (1, 0), (1, 2)]


def test_offset_to_doc(spark):
    spans = spark.createDataFrame([(0, 0, 10), (1, 10, 10), (2, 10, 9000), (3, 9000, 9001)], "ord long, start long, end long")
    asked = spark.createDataFrame([(0,), (9,), (10,), (8999,), (9000,), (9001,)], "at long")
    assert {r["at"]: r["ord"] for r in patterns.offset_to_doc(spans, asked).collect()} == {0: 0, 9: 0, 10: 2, 8999: 2, 9000: 3}


def test_succinct(spark):
    t = spark.createDataFrame([(1, "banana"), (2, "mmiissiissiippii"), (3, "a" * 50), (4, "é"), (5, "")], "k long, t string")
    sa = succinct.suffix_array(t, "k", "t")
    got = defaultdict(list)
    for r in sa.orderBy("k", "rank").collect():
        got[r["k"]].append(r["pos"])
    for k, s in ((1, "banana"), (2, "mmiissiissiippii"), (3, "a" * 50), (4, "é")):
        data = s.encode()
        assert got[k] == sorted(range(len(data)), key=lambda i: data[i:])
    b = succinct.bwt(t, "k", "t")
    rows = defaultdict(dict)
    for r in b.collect():
        rows[r["k"]][r["row"]] = r["byte"]
    assert [rows[1][i] for i in range(7)] == [97, 110, 110, 98, -1, 97, 97]
    lf = {(r["k"], r["row"]): r["lf"] for r in succinct.lf_map(b, "k").collect()}
    row, out = 0, []
    for _ in range(6):
        out.append(rows[1][row])
        row = lf[1, row]
    assert bytes(out[::-1]) == b"banana"
    hits = {r["k"]: (r["lo"], r["hi"]) for r in succinct.suffix_range(sa, t, "k", "t", "ana").collect()}
    assert hits == {1: (1, 3)} and succinct.suffix_range(sa, t, "k", "t", "xyz").count() == 0
    word = spark.createDataFrame([(1, "abracadabra")], "k long, t string")
    bytes_ = succinct.byte_rows(word, "k", "t")
    sel = {r["k_"]: r["idx"] for r in succinct.selects(bytes_, "k", "byte").filter("byte = 97").toDF("key", "byte", "k_", "idx").collect()}
    assert sel == {1: 0, 2: 3, 3: 5, 4: 7, 5: 10}


def test_succinct_of_whole_texts(spark, monkeypatch):
    """Each text's rows come from the task that reads it: no exchange, join or aggregate; several texts at once or one at a time give the same."""
    rng = random.Random(5)
    texts = {i: "".join(rng.choice("abé") for _ in range(rng.randrange(0, 40))) for i in range(60)} | {60: "", 61: "in" * 300, 62: None}
    t = spark.createDataFrame(list(texts.items()), "k long, t string").coalesce(1)
    made = [lambda: succinct.suffix_array(t, "k", "t"), lambda: succinct.bwt(t, "k", "t"), lambda: succinct.lf_of(t, "k", "t"), lambda: succinct.c_table(t, "k", "t"), lambda: succinct.range_of(t, "k", "t", "ba"), lambda: succinct.byte_rows(t, "k", "t")]
    want = [set() for _ in made]
    for k, s in texts.items():
        if s is None:
            continue
        data = s.encode()
        sa = sorted(range(len(data)), key=lambda i: data[i:])
        want[0] |= {(k, r, p) for r, p in enumerate(sa)}
        last = [data[p - 1] if p else -1 for p in [len(data), *sa]]
        want[1] |= {(k, r, b) for r, b in enumerate(last)}
        want[2] |= {(k, r, sum(x < b for x in last) + last[:r].count(b)) for r, b in enumerate(last)}
        want[3] |= {(k, b, sum(x < b for x in data)) for b in data}
        hits = [r for r, p in enumerate(sa) if data[p:].startswith(b"ba")]
        want[4] |= {(k, hits[0], hits[-1] + 1)} if hits else set()
        want[5] |= {(k, i, b) for i, b in enumerate(data)}
    for most in (1 << 20, 50):
        monkeypatch.setattr(succinct, "MOST_BYTES", most)
        for f, rows in zip(made, want, strict=True):
            got = [tuple(r) for r in f().collect()]
            assert len(got) == len(rows) and set(got) == rows
    for f in made:
        plan = f()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan
    lf = {tuple(r) for r in succinct.lf_map(succinct.bwt(t, "k", "t"), "k").collect()}
    assert lf == want[2] and made[0]().schema.simpleString() == "struct<k:bigint,rank:bigint,pos:bigint>"


def test_malformed_json_lines(spark):
    lines = ['{"id": 7, "title": "a \\"b\\"", "text": "cut off \\u00e9", "more": ', '{"id": "8", "text": "no brace"', 'nothing here', '{"text": "x", "id": 9,}', '{"id": 0, "text": "fine"}']
    rows = corpora.parse_json_lines(spark.createDataFrame(list(enumerate(lines)), "n int, value string"), "value", "n")
    assert [tuple(r) for r in rows.orderBy("ord").collect()] == [(0, 7, 'a "b"', "cut off é"), (1, 8, "", "no brace"), (2, 9, "", "x"), (3, 4, "", "fine")]


def test_command_line(spark, tmp_path, capsys):
    from quillon.__main__ import main

    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"id": i, "title": t, "text": x}) + "\n" for i, t, x in TINY))
    run = lambda *args: (main(list(args)), json.loads(capsys.readouterr().out))
    assert run("index", "-i", str(tmp_path / "a.jsonl"), "-o", str(tmp_path / "x"))[1]["total_docs"] == 5
    assert run("stats", "-i", str(tmp_path / "x"))[1]["total_docs"] == 5
    found = run("search", "-i", str(tmp_path / "x"), "-q", "wavelet tree")
    assert found[0] == 0 and [h["title"] for h in found[1]["hits"]] == ["Wavelets"]
    assert run("suggest", "-i", str(tmp_path / "x"), "-p", "suff")[1]["suggestions"]


def test_closed_searcher(tiny):
    with Searcher(tiny) as opened:
        assert opened.total_docs == 5
    with pytest.raises(RuntimeError):
        opened.search("rank")


def test_terms_of_an_automaton(spark):
    lexicon = spark.createDataFrame([(t,) for t in ("a", "ab", "abab", "abc", "", None)], "term string")
    assert [r["term"] for r in lexical.accepted_terms(lexicon, "(ab)+").collect()] == ["ab", "abab"]


def test_json_lines(spark, tmp_path):
    lines = [r'{"id": 7, "title": "A", "text": "café 😀 \"q\"", "x": [1]}', "", "   ", '{"title": "no id or text"}', '{"text": "only text"}', '{"id": "abc", "text": "bad id"}', '{"id": "12", "text": ""}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows = [tuple(r) for r in corpora.read_json_lines(spark, str(tmp_path / "a.jsonl")).orderBy("ord").collect()]
    assert rows == [(0, 7, "A", 'café \U0001f600 "q"'), (1, 2, "", "only text"), (2, 3, "", "bad id"), (3, 12, "", "")]


def test_wikitext(spark):
    raw = "<!-- note\n -->''Intro'' to [[Target|anchors]] and [[Plain]][[File:x.png|thumb]].<ref name=a>z</ref><ref b/>{{t|{{u}}}}\n{| a\n|}\n== Head ==\n  [http://x.y label one] [http://x.y] <b>bold</b> '''B'''  \n\n"
    got = spark.createDataFrame([(raw,)], "t string").select(corpora.clean_wikitext(F.col("t"))).first()[0]
    assert got == "Intro to anchors and Plain. Head label one  bold B"


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><id>{}</id>{}<revision><text>{}</text></revision></page>"
    body = "word " * 30
    pages = [page.format("Good", 0, 3, "", body), page.format("Redir", 0, 4, '<redirect title="Good"/>', body), page.format("Talk", 1, 5, "", body), page.format("Category:X", 0, 6, "", body), page.format("Short", 0, 7, "", "tiny"), page.format("Next", 0, 9, "", body)]
    (tmp_path / "d.xml").write_text("<mediawiki>" + "".join(pages) + "</mediawiki>")
    got = corpora.wiki_articles(corpora.read_wiki_dump(spark, str(tmp_path / "d.xml")))
    assert [(r["id"], r["title"]) for r in got.orderBy("id").collect()] == [(1, "Good"), (2, "Next")]


def test_select_corpus(spark):
    rng = random.Random(4)
    rows = [(i, f"t{rng.randrange(60)}", ("keyword " if rng.random() < 0.3 else "") + "x" * rng.choice([100, 200, 2000])) for i in range(200)]
    want, seen = [], set()
    for i, title, t in rows:
        if title in seen or len(t) < 150:
            continue
        if "keyword" in (title + " " + t[:500]).lower() or len(want) < 20:
            seen.add(title)
            want.append((len(want) + 1, title, t[:1200]))
        if len(want) >= 45:
            break
    got = corpora.select_corpus(spark.createDataFrame(rows, "ord long, title string, text string"), ["keyword"], 45, 20)
    assert [tuple(r) for r in got.orderBy("id").collect()] == want


def test_entry_survives_without_llm(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_or' in q and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
