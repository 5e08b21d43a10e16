"""The engine's operators over the driver's tables, each with DuckDB SQL for the same rows.

documents is the corpus (untitled); pages, conversations, benchmark, events and part serve
where their shape fits. The stemmed and the plain index are written once for an
application and folder, and read by all queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import codecs, porter, snippet, text
from quillon.operators import lexical, patterns, rank, succinct
from quillon.plans.index import Index, analyzed, corpus_of, numbered, whole_text
from quillon.plans.porter_sql import stem_ctes
from quillon.session import scratch_path, ship, table
from quillon.sources import corpora

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_built: dict[tuple[str, str, bool], Index] = {}


def index_for(spark: SparkSession, sf_dir: str, stemming: bool = False) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, stemming)
    if key not in _built:
        _built[key] = Index.build(corpus_of(table(spark, sf_dir, "documents")), scratch_path(spark, "index"), stemming)
    return _built[key]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_W = text.WORD
_STOP = ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS))
_DOCS = "docs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id AS ext_id, '' AS title, coalesce(text, '') AS text FROM documents)"
_WORDS = f"words AS (SELECT ord, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT ord, regexp_extract_all(translate(title || ' ' || text, '{text.UPPER}', '{text.LOWER}'), '{_W}') AS w FROM docs))"
_PLAIN = f"tokens AS (SELECT ord, pos, word AS term FROM words WHERE word NOT IN ({_STOP}))"
_STEMMED = stem_ctes("words") + f",\ntokens AS (SELECT ord, pos, stem AS term FROM words JOIN stems USING (word) WHERE word NOT IN ({_STOP}))"
_INDEX = """postings AS (SELECT term, ord, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tokens GROUP BY ALL),
lengths AS (SELECT ord, count(t.ord) AS length FROM docs LEFT JOIN (SELECT ord FROM tokens) t USING (ord) GROUP BY ord),
stats AS (SELECT count(*) AS n, avg(length) AS average FROM lengths),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (
  SELECT term, ord, tf, positions, length, df, average, n, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf,
         ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 1.9::DOUBLE) / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * length / average)) AS score
  FROM postings JOIN freq USING (term) JOIN lengths USING (ord), stats)"""


def _base(stemming: bool = False) -> str:
    return f"WITH {_DOCS},\n{_WORDS},\n{_STEMMED if stemming else _PLAIN},\n{_INDEX}"


def _ranked(inner: str, k: int = 10, stemming: bool = False) -> str:
    """The k best of rows (ord, score)."""
    return f"""{_base(stemming)},
hits AS ({inner})
SELECT row_number() OVER (ORDER BY score DESC, ord)::INT AS rank, ord, score FROM hits ORDER BY score DESC, ord LIMIT {k}"""


def _any(*terms: str) -> str:
    return ", ".join(f"'{t}'" for t in terms)


# --- text functions and analysis ---


@query(f"WITH {_DOCS} SELECT ord, md5(translate(text, '{text.UPPER}', '{text.LOWER}')) AS folded FROM docs")
def case_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_of(table(spark, sf_dir, "documents")).select("ord", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@query(f"WITH {_DOCS}, {_WORDS} SELECT word, count(*) AS n, regexp_matches(word, '^{_W}$') AS is_word FROM words GROUP BY word")
def word_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus_of(table(spark, sf_dir, "documents")).select(F.explode(text.word_list(whole_text())).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("is_word", text.is_word(F.col("word")))


@query(f"WITH {_DOCS}, {_WORDS}, {_PLAIN} SELECT ord, pos, term FROM tokens")
def tokens_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzed(corpus_of(table(spark, sf_dir, "documents")), stemming=False)


@query(f"WITH {_DOCS}, {_WORDS} SELECT word, count(*) AS n FROM words WHERE word IN ({_STOP}) GROUP BY word")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus_of(table(spark, sf_dir, "documents")).select(F.explode(text.word_list(whole_text())).alias("word"))
    return words.filter(text.is_stopword(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w,
  regexp_split_to_array(coalesce(text, ''), '{_W}') AS g FROM conversations),
e AS (SELECT conv_id, turn, unnest(w) AS word, unnest(g[:len(w)]) AS gap, unnest(range(len(w))) AS pos FROM t),
s AS (SELECT conv_id, turn, pos, word, sum(strlen(gap) + strlen(word)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS e FROM e)
SELECT conv_id, turn, pos::INT AS pos, word, (e - strlen(word))::INT AS start_byte, e::INT AS end_byte FROM s""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    return text.word_offsets(turns, "k", "text").select("k.conv_id", "k.turn", "pos", "word", "start_byte", "end_byte")


@query(f"WITH {_DOCS}, {_WORDS}, {stem_ctes('words')} SELECT word, stem FROM stems")
def porter_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus_of(table(spark, sf_dir, "documents")).select(F.explode(text.word_list(whole_text())).alias("word")).distinct()
    return porter.stemmed(words.withColumn("stem", F.col("word")), "stem")


@query(f"""WITH w AS (SELECT conv_id, turn, translate(role, '{text.UPPER}', '{text.LOWER}') AS word FROM conversations),
{stem_ctes('w')} SELECT conv_id, turn, stem AS term FROM w JOIN stems USING (word)""")
def normalize_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return porter.stemmed(table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fold(F.col("role")).alias("term")), "term")


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escape(F.col("html")).cast("binary")).alias("escaped"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars FROM documents")
def utf8_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.byte_length(F.col("text")).cast("long").alias("bytes"), F.length(text.utf8_decode(F.encode("text", "UTF-8"))).cast("long").alias("chars"))


def _crc_table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return ", ".join(map(str, out))


@query(f"""WITH b AS (SELECT doc_id, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)) AS v, [{_crc_table()}]::BIGINT[] AS t FROM documents)
SELECT doc_id, xor(4294967295::BIGINT, list_reduce(v, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))::BIGINT AS crc FROM b""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.checksum(F.encode("text", "UTF-8")).alias("crc"))


@query("SELECT doc_id, md5(url_decode(replace(replace(replace(text, ' ', '+'), 'e', '%65') || '%zz%4', '+', ' '))) AS decoded FROM documents")
def url_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.concat(F.replace(F.replace("text", F.lit(" "), F.lit("+")), F.lit("e"), F.lit("%65")), F.lit("%zz%4"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.url_decode(coded, F.lit(True)).cast("binary")).alias("decoded"))


@query("SELECT doc_id, md5(substr(to_json(text)::VARCHAR, 2, length(to_json(text)::VARCHAR) - 2)) AS escaped FROM documents")
def json_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.json_escape(F.col("text")).cast("binary")).alias("escaped"))


@query("""SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::INT AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(after, "p_partkey").select("p_partkey", text.edit_distance(F.col("p_name"), F.col("other")).alias("distance"))


# --- index construction ---


@query(f"WITH {_DOCS} SELECT ord, ext_id, md5(text) AS text FROM docs")
def corpus_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_of(table(spark, sf_dir, "documents")).select("ord", "ext_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"{_base()} SELECT term, ord, tf::INT AS tf, array_to_string(positions, ',') AS positions FROM postings")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_for(spark, sf_dir).postings.select("term", "ord", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"{_base()} SELECT term, ord, round(score, 6) AS score FROM scored")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_for(spark, sf_dir).scored().select("term", "ord", F.round("score", 6).alias("score"))


@query(f"{_base()} SELECT ord, length FROM lengths")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_for(spark, sf_dir).doc_stats.select("ord", "length")


@query(f"{_base()} SELECT (SELECT count(*) FROM docs) AS total_docs, (SELECT sum(length) FROM lengths)::BIGINT AS total_tokens, round((SELECT average FROM stats), 6) AS avg_doc_len, (SELECT count(*) FROM freq) AS unique_terms")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_for(spark, sf_dir)
    terms = index.lexicon.agg(F.count("*").alias("unique_terms"))
    return index.index_stats.crossJoin(terms).select("total_docs", "total_tokens", F.round("avg_doc_len", 6).alias("avg_doc_len"), "unique_terms")


@query(f"{_base()} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df AS doc_freq FROM freq")
def lexicon_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_for(spark, sf_dir).with_term_ids().select("term", F.col("term_id").cast("long").alias("term_id"), "doc_freq")


@query(f"{_base()}, b AS (SELECT term, ord, score, (row_number() OVER (PARTITION BY term ORDER BY ord) - 1) // 128 AS block_no FROM scored) SELECT term, block_no, min(ord) AS min_ord, max(ord) AS max_ord, count(*) AS num_docs, round(max(score), 6) AS block_max_score FROM b GROUP BY term, block_no")
def block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_for(spark, sf_dir).blocks.select("term", "block_no", "min_ord", "max_ord", "num_docs", F.round("block_max_score", 6).alias("block_max_score"))


@query(f"{_base()} SELECT term, round(max(score), 6) AS max_term_score FROM scored GROUP BY term")
def term_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_for(spark, sf_dir).lexicon.select("term", F.round("max_term_score", 6).alias("max_term_score"))


@query(f"WITH {_DOCS}, s AS (SELECT ord, strlen(title) + strlen(text) AS bytes FROM docs) SELECT ord, (sum(bytes) OVER (ORDER BY ord) - bytes)::BIGINT AS start, (sum(bytes) OVER (ORDER BY ord))::BIGINT AS \"end\" FROM s")
def stored_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_for(spark, sf_dir).offsets()


@query(f"{_base()} SELECT term, ord, (ord - coalesce(lag(ord) OVER (PARTITION BY term ORDER BY ord), 0))::BIGINT AS delta FROM postings")
def posting_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_for(spark, sf_dir).deltas()


@query(f"{_base()} SELECT term, CASE WHEN max(ord) <= 0 THEN 0 ELSE length(bin(max(ord)::BIGINT)) END::INT AS width FROM postings GROUP BY term")
def posting_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_for(spark, sf_dir).postings.groupBy("term").agg(F.max("ord").alias("m")).select("term", codecs.bit_width(F.col("m")).alias("width"))


@query(f"""{_base()} SELECT term, ord, list_sum(list_transform(positions, lambda p: CASE WHEN p < 128 THEN 1 WHEN p < 16384 THEN 2 WHEN p < 2097152 THEN 3 WHEN p < 268435456 THEN 4 ELSE 5 END))::INT AS bytes, array_to_string(positions, ',') AS positions FROM postings""")
def varint_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index_for(spark, sf_dir).postings.select("term", "ord", codecs.varint_bytes(F.col("positions")).alias("packed"))
    return rows.select("term", "ord", F.octet_length("packed").alias("bytes"), F.array_join(codecs.varint_numbers(F.col("packed")).cast("array<string>"), ",").alias("positions"))


@query(f"{_base()} SELECT (ord // 128)::BIGINT AS block_no, length(bin(max(length)::BIGINT))::INT AS width, 16 * length(bin(max(length)::BIGINT))::INT AS bytes, true AS same FROM lengths GROUP BY ALL HAVING max(length) > 0")
def block_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of documents in blocks of 128, packed and unpacked."""
    lengths = index_for(spark, sf_dir).doc_stats.groupBy(F.expr("ord div 128").alias("block_no")).agg(F.sort_array(F.collect_list(F.struct("ord", "length"))).alias("x"))  # 128 a block
    packed = lengths.select("block_no", codecs.packed_blocks(F.col("x.length")).alias("b"))
    return packed.filter("b.width > 0").select("block_no", F.col("b.width").alias("width"), F.octet_length("b.packed").alias("bytes"), F.col("b.same").alias("same"))


@query(f"{_base()} SELECT ord, tf FROM postings WHERE term = 'der'")
def posting_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_for(spark, sf_dir).postings.filter("term = 'der'").select("ord", F.col("tf").cast("long").alias("tf"))


# --- ranked retrieval ---


def _hits(index: Index, asked: str, k: int = 10, **options: bool) -> DataFrame:
    return rank.evaluate(index, [(0, asked)], k, **options).select("rank", "ord", "score")


def _or(*terms: str) -> str:
    return f"SELECT ord, round(sum(score), 6) AS score FROM scored WHERE term IN ({_any(*terms)}) GROUP BY ord"


def _and(*terms: str) -> str:
    return f"{_or(*terms)} HAVING count(*) = {len(terms)}"


@query(_ranked(_or("der")))
def bm25_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(index_for(spark, sf_dir), "der")


@query(_ranked(_or("tion", "nd", "ing")))
def bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(index_for(spark, sf_dir), "tion OR nd OR ing")


@query(_ranked(_or("tion", "nd", "ing")))
def bm25_or_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.disjunction_pruned(index_for(spark, sf_dir), ["tion", "nd", "ing"], 10).select("rank", "ord", "score")


@query(_ranked(_and("tion", "nd", "ing")))
def bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(index_for(spark, sf_dir), "tion nd ing")


@query(_ranked(_and("tion", "nd") + " AND NOT bool_or(ord IN (SELECT ord FROM postings WHERE term = 'ing'))"))
def bm25_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(index_for(spark, sf_dir), "tion nd -ing")


@query(_ranked(_or("tion", "licens", "reserv"), stemming=True))
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(index_for(spark, sf_dir, True), "tions OR licensed OR reserved")


@query(f"""WITH {_DOCS}, {_WORDS}, kept AS MATERIALIZED (SELECT DISTINCT word FROM words WHERE word NOT IN ({_STOP})),
{stem_ctes('kept')}, known AS MATERIALIZED (SELECT DISTINCT stem AS term FROM stems), q AS (SELECT unnest(['licens', 'licensed', 'reserv', 'qzx']) AS raw),
qs AS (SELECT raw AS word FROM q), {stem_ctes('qs', 'again')}, twice AS MATERIALIZED (SELECT word AS raw, stem FROM again)
SELECT raw, CASE WHEN raw IN (SELECT term FROM known) THEN raw ELSE stem END AS term FROM twice WHERE raw IN (SELECT term FROM known) OR stem IN (SELECT term FROM known)""")
def term_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.plans.parser import ParsedQuery

    index = index_for(spark, sf_dir, True)
    asked = rank.query_terms(index, [(0, ParsedQuery(["licens", "licensed", "reserv", "qzx"], [], [], [], True))])
    return rank.resolve(index, asked).select("raw", "term")


def _phrase(*terms: str, gaps: tuple[int, ...] = ()) -> str:
    places = gaps or tuple(range(len(terms)))
    begins = " INTERSECT ".join(f"SELECT ord, unnest(positions) - {p} AS b FROM postings WHERE term = '{t}'" for t, p in zip(terms, places, strict=True))
    part = " + ".join(f"ln(1 + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * (tf * 1.9::DOUBLE) / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * length / average))" for i in range(len(terms)))
    freqs = ", ".join(f"(SELECT df FROM freq WHERE term = '{t}') AS d{i}" for i, t in enumerate(terms))
    return f"SELECT ord, round({part}, 6) AS score FROM (SELECT ord, count(*) AS tf FROM ({begins}) GROUP BY ord) JOIN lengths USING (ord), stats, (SELECT {freqs})"


@query(_ranked(_phrase("apache", "license", "version")))
def phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(index_for(spark, sf_dir), '"apache license version"')


@query(_ranked(f"SELECT * FROM ({_phrase('apache', 'license')}) WHERE ord NOT IN (SELECT ord FROM postings WHERE term = 'tion')"))
def phrase_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(index_for(spark, sf_dir), '"apache license" -tion')


@query(_ranked(_phrase("licensed", "apache", gaps=(0, 3))))
def phrase_stopword_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(index_for(spark, sf_dir), '"licensed under the apache"', gaps=True)


@query(f"""{_base()}, qw AS (SELECT item_id AS query_id, unnest(regexp_extract_all(translate(' ' || text, '{text.UPPER}', '{text.LOWER}'), '{_W}')) AS term FROM benchmark),
q AS (SELECT DISTINCT query_id, term FROM qw WHERE term NOT IN ({_STOP})),
h AS (SELECT query_id, ord, round(sum(score), 6) AS score FROM scored JOIN q USING (term) GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord)::INT AS rank, ord, score FROM h)
SELECT * FROM r WHERE rank <= 10""")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rank.evaluate_frame(index_for(spark, sf_dir), asked, 10, any_term=True)


@query(f"""{_base()}, hits AS ({_or('tion', 'nd', 'ing')}), t AS (SELECT ord, score, row_number() OVER (ORDER BY score DESC, ord)::INT AS rank FROM hits ORDER BY score DESC, ord LIMIT 10)
SELECT rank, ext_id, title, md5(text) AS text, score FROM t JOIN docs USING (ord)""")
def display_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_for(spark, sf_dir)
    hits = _hits(index, "tion OR nd OR ing")
    return index.corpus.join(F.broadcast(hits), "ord").select("rank", "ext_id", "title", F.md5(F.col("text").cast("binary")).alias("text"), "score")  # 10 rows


@query()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_for(spark, sf_dir)
    hits = _hits(index, "tion OR nd OR ing")
    shown = index.corpus.join(F.broadcast(hits), "ord")  # 10 rows
    return shown.select("rank", "ext_id", snippet.snippet(F.col("text"), F.array(F.lit("tion"), F.lit("nd"), F.lit("ing"))).alias("snippet"))


@query(f"""WITH t AS (SELECT conv_id, turn, text, regexp_extract_all(text, '{_W}') AS w, regexp_split_to_array(text, '{_W}') AS g FROM conversations),
e AS (SELECT conv_id, turn, unnest(w) AS word, unnest(g[:len(w)]) AS gap, unnest(range(len(w))) AS pos FROM t),
s AS (SELECT conv_id, turn, pos, word, sum(strlen(gap) + strlen(word)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS e FROM e),
k AS (SELECT conv_id, turn, e - strlen(word) AS a, e AS b, translate(word, '{text.UPPER}', '{text.LOWER}') AS word FROM s WHERE translate(word, '{text.UPPER}', '{text.LOWER}') NOT IN ({_STOP})),
c AS (SELECT x.conv_id, x.turn, x.a, count(*) FILTER (y.word IN ('tion', 'nd', 'ing')) AS hits FROM k x JOIN k y ON x.conv_id = y.conv_id AND x.turn = y.turn AND y.a >= x.a AND y.b <= x.a + 160 GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, a) AS r FROM c)
SELECT conv_id, turn, a::INT AS window_start, hits::BIGINT AS hits FROM m WHERE r = 1""")
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", snippet.windows(F.col("text"), ("tion", "nd", "ing")).alias("w"))
    return turns.filter("w is not null").select("conv_id", "turn", F.col("w.start").alias("window_start"), F.col("w.hits").alias("hits"))


@query(f"""WITH {_DOCS}, w AS (SELECT ord, regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+') AS w FROM docs),
s AS (SELECT count(*) AS n, avg(len(w)) AS average FROM w), e AS (SELECT ord, len(w) AS length, unnest(w) AS term FROM w),
f AS (SELECT ord, length, term, count(*) AS tf FROM e WHERE term IN ('tion', 'nd') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT ord, round(sum((CASE term WHEN 'tion' THEN 2 ELSE 1 END) * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 1.9::DOUBLE) / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * length / average))), 6) AS score
FROM f JOIN d USING (term), s GROUP BY ord ORDER BY score DESC, ord LIMIT 15""")
def simple_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.simple_bm25(corpus_of(table(spark, sf_dir, "documents")), "tion nd tion")


_SIMPLE = f"""{_DOCS}, w AS (SELECT ord, regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+') AS w FROM docs),
s AS (SELECT count(*) AS n, avg(len(w)) AS average FROM w), e AS (SELECT ord, len(w) AS length, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w)"""


@query(f"""WITH {_SIMPLE}, q AS (SELECT unnest(['tionxq', 'thwhatx', 'nd']) AS asked),
c AS (SELECT asked, term, row_number() OVER (PARTITION BY asked ORDER BY term <> asked, ord, pos) AS r FROM q JOIN e ON levenshtein(term, asked) <= 2),
t AS (SELECT term, count(*) AS times FROM c WHERE r = 1 GROUP BY term),
f AS (SELECT ord, length, term, times, count(*) AS tf FROM e JOIN t USING (term) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT ord, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 1.9::DOUBLE) / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * length / average))), 6) AS score
FROM f JOIN d USING (term), s GROUP BY ord ORDER BY score DESC, ord LIMIT 15""")
def simple_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.simple_bm25(corpus_of(table(spark, sf_dir, "documents")), "tionxq thwhatx nd", fuzzy=True)


@query(f"WITH {_SIMPLE} SELECT term, count(DISTINCT ord) AS doc_freq, 0::INT AS edit_distance FROM e WHERE starts_with(term, 'in') GROUP BY term ORDER BY term LIMIT 8")
def simple_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.simple_suggest(corpus_of(table(spark, sf_dir, "documents")), "IN")


# --- lexical ---


@query(f"""{_base()}, p AS (SELECT term, df FROM freq WHERE starts_with(term, 'th') ORDER BY term || chr(1114111) DESC LIMIT 20)
SELECT term, df AS doc_freq, 0::INT AS edit_distance, df::DOUBLE AS score FROM p ORDER BY df DESC, term LIMIT 10""")
def prefix_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.prefix_suggest(index_for(spark, sf_dir).lexicon, "TH")


@query(f"{_base()} SELECT term, df AS doc_freq FROM freq WHERE starts_with(term, 'in') ORDER BY term || chr(1114111) DESC LIMIT 25")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.prefix_terms(index_for(spark, sf_dir).lexicon, "in", 25).select("term", "doc_freq")


def _near(word: str, distance: int, most: int) -> str:
    return f"SELECT term, df, levenshtein(term, '{word}')::INT AS d FROM freq WHERE levenshtein(term, '{word}') <= {distance} ORDER BY d, df DESC, term LIMIT {most}"


@query(f"{_base()}, m AS ({_near('licence', 2, 10)}) SELECT term, df AS doc_freq, d AS edit_distance, df / (d + 1.0::DOUBLE) AS score FROM m")
def fuzzy_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.fuzzy_suggest(index_for(spark, sf_dir).lexicon, "licence")


@query(f"{_base()}, m AS ({_near('licence', 2, 10)}), n AS ({_near('versoin', 2, 10)}), x AS (SELECT term FROM m UNION SELECT term FROM n), hits AS (SELECT ord, round(sum(score), 6) AS score FROM scored JOIN x USING (term) GROUP BY ord) SELECT row_number() OVER (ORDER BY score DESC, ord)::INT AS rank, ord, score FROM hits ORDER BY score DESC, ord LIMIT 10")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.plans.engine import Searcher

    return Searcher(index_for(spark, sf_dir)).search("licence versoin~2").hits


@query(f"{_base()}, u AS ({_near('licence', 2, 1)}) SELECT 'apache ' || (SELECT term FROM u) || ' version' AS suggestion")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.did_you_mean(index_for(spark, sf_dir).lexicon, "Apache licence version")


@query("""WITH p AS (SELECT DISTINCT p_name AS term FROM part), c AS (SELECT term, 1 AS df FROM p), w AS (SELECT DISTINCT p_partkey AS slot, p_name AS word FROM part)
SELECT slot, count(*) AS n, min(levenshtein(term, word))::INT AS least FROM w, c WHERE abs(strlen(term) - strlen(word)) <= 1 AND levenshtein(term, word) <= 1 GROUP BY slot""")
def fuzzy_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    terms = part.select(F.col("p_name").alias("term")).distinct().withColumn("doc_freq", F.lit(1).cast("long"))
    found = lexical.near_terms_batch(terms, part.select(F.col("p_partkey").alias("slot"), F.col("p_name").alias("word")), 1, 1 << 30)
    return found.groupBy("slot").agg(F.count("*").alias("n"), F.min("edit_distance").alias("least"))


@query(f"{_base()} SELECT term, df AS doc_freq FROM freq WHERE regexp_full_match(term, '(th|wh)[aeiou]+(n|ts?)?')")
def lexicon_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.accepted_terms(index_for(spark, sf_dir).lexicon, "(th|wh)[aeiou]+(n|ts?)?").select("term", "doc_freq")


# --- patterns ---


@query(f"WITH {_DOCS}, c AS (SELECT ord, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS score FROM docs) SELECT ord, score FROM c WHERE score > 0 ORDER BY score DESC, ord LIMIT 20")
def regex_count_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.regex_search(index_for(spark, sf_dir).corpus, "[0-9]+", 20)


@query(f"WITH {_DOCS}, c AS (SELECT ord, len(regexp_extract_all(text, '(?s)(?:inging|ing|tion)[a-z]*'))::BIGINT AS score FROM docs) SELECT ord, score FROM c WHERE score > 0 ORDER BY score DESC, ord LIMIT 20")
def regex_search_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.regex_search(index_for(spark, sf_dir).corpus, "(ing|inging|tion)[a-z]*", 20)


@query(f"WITH {_DOCS}, c AS (SELECT ord, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 4) = 'inin'))::BIGINT AS score FROM docs WHERE contains(text, 'inin')) SELECT ord, score FROM c ORDER BY score DESC, ord LIMIT 20")
def substring_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.substring_search(index_for(spark, sf_dir).corpus, "inin", 20)


@query(f"""WITH {_DOCS}, j AS (SELECT ord, text, coalesce(substr(string_agg(substr(text, 1, 2), '') OVER (ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 1, 2), '') AS after FROM docs),
c AS (SELECT ord, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '.Th' OR (i > length(text) - 2 AND substr(right(text, 2) || after, i - greatest(length(text) - 2, 0), 3) = '.Th')))::BIGINT AS score FROM j WHERE contains(text || after, '.Th'))
SELECT ord, score FROM c ORDER BY score DESC, ord LIMIT 20""")
def substring_straddling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts end in a full stop and begin with a capital: these matches lie over the boundaries."""
    return patterns.substring_search(index_for(spark, sf_dir).corpus, ".Th", 20, straddling=True)


@query(f"""WITH {_DOCS}, b AS (SELECT ord, encode(text) AS v FROM docs WHERE contains(text, 'License')),
o AS (SELECT ord, text, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 7) = 'License')) AS i FROM docs WHERE contains(text, 'License'))
SELECT ord, strlen(substr(text, 1, i - 1))::BIGINT AS at FROM o""")
def substring_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.locate(index_for(spark, sf_dir).corpus, "License")


@query(f"""WITH {_DOCS}, s AS (SELECT ord, strlen(text) AS bytes FROM docs), r AS (SELECT ord, sum(bytes) OVER (ORDER BY ord) - bytes AS a, sum(bytes) OVER (ORDER BY ord) AS b FROM s),
o AS (SELECT item_id * 1009 AS "at" FROM benchmark) SELECT "at", ord FROM o JOIN r ON "at" >= a AND "at" < b""")
def offset_to_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 1009).alias("at"))
    return patterns.offset_to_doc(index_for(spark, sf_dir).offsets(), asked)


# --- succinct structures, on short texts ---

_SHORT = "p AS (SELECT p_partkey, p_name AS t FROM part WHERE length(p_name) > 0)"
_SUFFIX = f"{_SHORT}, x AS (SELECT p_partkey, t, unnest(range(strlen(t))) AS pos FROM p), sa AS (SELECT p_partkey, t, pos, row_number() OVER (PARTITION BY p_partkey ORDER BY substr(t, pos + 1)) - 1 AS rank FROM x)"
_BYTES = f"{_SHORT}, b AS (SELECT p_partkey, unnest(range(strlen(t))) AS idx, unnest(list_transform(range(1, length(t) + 1), lambda i: ascii(substr(t, i, 1)))) AS byte FROM p)"


@query(f"WITH {_SUFFIX} SELECT p_partkey, rank, pos FROM sa")
def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return succinct.suffix_array(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query(f"WITH {_SUFFIX}, r AS (SELECT p_partkey, t, pos, rank + 1 AS row FROM sa UNION ALL SELECT p_partkey, t, strlen(t), 0 FROM p) SELECT p_partkey, row, CASE WHEN pos = 0 THEN -1 ELSE ascii(substr(t, pos, 1)) END::INT AS byte FROM r")
def bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return succinct.bwt(table(spark, sf_dir, "part").filter("p_name <> ''"), "p_partkey", "p_name")


@query(f"""WITH {_SUFFIX}, r AS (SELECT p_partkey, t, pos, rank + 1 AS row FROM sa UNION ALL SELECT p_partkey, t, strlen(t), 0 FROM p),
w AS (SELECT p_partkey, row, CASE WHEN pos = 0 THEN -1 ELSE ascii(substr(t, pos, 1)) END AS byte FROM r)
SELECT p_partkey, row, ((SELECT count(*) FROM w v WHERE v.p_partkey = w.p_partkey AND v.byte < w.byte) + row_number() OVER (PARTITION BY p_partkey, byte ORDER BY row) - 1)::BIGINT AS lf FROM w""")
def lf_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return succinct.lf_of(table(spark, sf_dir, "part").filter("p_name <> ''"), "p_partkey", "p_name")


@query(f"WITH {_SUFFIX} SELECT p_partkey, min(rank) AS lo, max(rank) + 1 AS hi FROM sa WHERE starts_with(substr(t, pos + 1), 'in') GROUP BY p_partkey")
def backward_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return succinct.range_of(table(spark, sf_dir, "part"), "p_partkey", "p_name", "in")


@query(f"WITH {_BYTES} SELECT p_partkey, idx::INT AS idx, byte, row_number() OVER (PARTITION BY p_partkey, byte ORDER BY idx) - 1 AS rank FROM b")
def wavelet_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return succinct.ranks(succinct.byte_rows(table(spark, sf_dir, "part"), "p_partkey", "p_name"), "p_partkey", "byte")


@query(f"WITH {_BYTES}, c AS (SELECT p_partkey, byte, count(*) AS n FROM b GROUP BY ALL) SELECT p_partkey, byte, coalesce(sum(n) OVER (PARTITION BY p_partkey ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c")
def wavelet_c_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return succinct.c_table(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query(f"WITH {_BYTES}, v AS (SELECT p_partkey, idx, byte % 2 = 1 AS bit FROM b) SELECT p_partkey, bit, row_number() OVER (PARTITION BY p_partkey, bit ORDER BY idx) AS k, idx::INT AS idx FROM v")
def bitvector_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = succinct.byte_rows(table(spark, sf_dir, "part"), "p_partkey", "p_name").withColumn("bit", F.col("byte") % 2 == 1)
    return succinct.selects(bits, "p_partkey", "bit")


@query("SELECT doc_id, hex(encode(text)[101:200]) AS bytes FROM documents WHERE strlen(text) >= 0")
def fm_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return succinct.extract(table(spark, sf_dir, "documents"), "doc_id", "text", 100, 200).select("doc_id", F.hex("bytes").alias("bytes"))


# --- sources ---


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, CASE WHEN doc_id = 0 THEN row_number() OVER (ORDER BY doc_id) ELSE doc_id END AS ext_id, source AS title, md5(text) AS text FROM documents")
def jsonl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text", "lang")).alias("value"))
    return corpora.parse_json_lines(lines, "value", "doc_id").withColumn("text", F.md5(F.col("text").cast("binary")))


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\r\n]+', ' ', 'g')) AS title,
md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))) AS text FROM pages""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", corpora.html_title(F.col("html")).alias("title"), F.md5(corpora.clean_html(F.col("html")).cast("binary")).alias("text"))


def _wiki_sql(text: str) -> str:
    """clean_wikitext in RE2, which has no lookahead."""
    inside, plain, single = r"(?:[^\]\n]|\][^\]\n])*", r"(?:[^\]\n:]|\][^\]\n:])*", r"(?:[^\]\n|]|\][^\]\n|])*"
    for pattern, by in (
        (r"(?s)<!--.*?-->", ""), (r"(?is)<ref[^>]*>.*?</ref>", ""), (r"(?i)<ref[^>]*/>", ""), (r"<[^>]+>", ""), (r"\{\{[^{}]*\}\}", ""), (r"\{\{[^{}]*\}\}", ""), (r"(?s)\{\|.*?\|\}", ""),
        (rf"\[\[{plain}:{inside}\]\]", ""), (rf"\[\[(?:{inside}\|)?({single})\]\]", r"\1"),
        (r"\[https?://[^\s\]]+\s+([^\]]+)\]", r"\1"), (r"\[https?://[^\s\]]+\]", ""), (r"\x27{2,5}", ""), (r"={2,}\s*(.*?)\s*={2,}", r"\1"),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    lines = f"list_transform(regexp_split_to_array({text}, '\\r\\n|[\\n\\r\\x0B\\f]'), lambda x: regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'))"
    return f"array_to_string(list_filter({lines}, lambda x: x <> ''), ' ')"


#: Literals and, at odd places, columns that put documents in wiki markup: what a dump's pages hold.
_PARTS = (
    "{{Box|a={{b}}|c}} <!-- no --> '''", "source", "''' [[File:x.png|thumb]] [[a|b]] and [[", "lang",
    ']]<ref name="n">r</ref><ref name="m" />\n== Head ==\n[https://a.b/c named] [https://a.b/d]\n{| class="t"\n| cell\n|}\n \t\n', "text",
)
_MARKUP = " || ".join(x if k % 2 else "'" + x.replace("'", "''") + "'" for k, x in enumerate(_PARTS))


@query(f"SELECT doc_id, md5({_wiki_sql('t')}) AS text FROM (SELECT doc_id, {_MARKUP} AS t FROM documents)")
def wikitext_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(corpora.clean_wikitext(_marked_up()).cast("binary")).alias("text"))


def _marked_up() -> Column:
    return F.concat(*(F.col(x) if k % 2 else F.lit(x) for k, x in enumerate(_PARTS)))


@query(f"""WITH c AS (SELECT doc_id, 'Page ' || doc_id AS title, {_wiki_sql('t')} AS text FROM (SELECT doc_id, {_MARKUP} AS t FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0))
SELECT row_number() OVER (ORDER BY doc_id) AS id, title, md5(text) AS text FROM c WHERE length(text) >= 80""")
def wiki_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a dump of all documents, some in another namespace, some redirects, and reads its articles."""
    page = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "1").otherwise("0").alias("ns"), F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("doc_id") % 7 == 0, F.struct(F.lit("Other").alias("_title"))).alias("redirect"), F.struct(F.struct(_marked_up().alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text")).alias("revision"),
    )
    page.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path := scratch_path(spark, "dump"))
    return corpora.wiki_articles(corpora.read_wiki_dump(spark, path)).select(F.col("id").cast("long").alias("id"), "title", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""WITH d AS (SELECT doc_id AS ord, source || '/' || (doc_id % 701) AS title, text FROM documents WHERE length(text) >= 150),
h AS (SELECT *, contains(lower(title || ' ' || substr(text, 1, 500)), 'license') OR contains(lower(title || ' ' || substr(text, 1, 500)), 'thing') AS hit FROM d),
f AS (SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY title ORDER BY ord) AS r FROM h) WHERE r = 1 ORDER BY ord LIMIT 100),
m AS (SELECT CASE WHEN count(*) >= 100 THEN max(ord) END AS last FROM f),
c AS (SELECT h.*, row_number() OVER (PARTITION BY title ORDER BY ord) AS r FROM h, m WHERE hit OR last IS NULL OR ord <= last),
k AS (SELECT ord, title, text FROM c WHERE r = 1 ORDER BY ord LIMIT 600)
SELECT row_number() OVER (ORDER BY ord) AS id, title, substr(text, 1, 1200) AS text FROM k""")
def corpus_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat("source", F.lit("/"), (F.col("doc_id") % 701).cast("string")).alias("title"), "text")
    return corpora.select_corpus(docs, ["license", "thing"], 600, 100)


@query(f"{_base()} SELECT count(*) AS docs, (SELECT sum(tf) FROM postings)::BIGINT AS tokens, (SELECT count(*) FROM postings) AS postings FROM docs")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds, writes and opens an index."""
    index = Index.build(corpus_of(table(spark, sf_dir, "documents")), scratch_path(spark, "index"), stemming=False)
    return index.postings.agg(F.sum("tf").alias("tokens"), F.count("*").alias("postings")).crossJoin(index.doc_stats.agg(F.count("*").alias("docs"))).select("docs", "tokens", "postings")


@query("SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS n, conv_id, turn FROM conversations")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("k"))
    return numbered(turns, "k", "n").select(F.col("n").cast("long").alias("n"), "conv_id", "turn")
