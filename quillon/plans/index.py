"""The inverted index as tables: postings, lexicon, blocks, document and corpus statistics.

A corpus has ord (0-based), ext_id, title and text. Each task turns its documents into
packed postings, cut to ranges of (term, ord) once and unpacked to a row for each term and document, so
that a common term lies in many files and Parquet's statistics serve lookups and skipping.
Scores aren't stored: they follow from a posting, the lexicon's idf and the mean length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import codecs, porter
from quillon.functions.text import STOPWORDS, WORD_CLASS, fold_py, is_stopword, word_list
from quillon.session import discard, materialize, scratch_path

K1, B, BLOCK = 0.9, 0.4, 128
VERSION = 3
_TABLES = ("corpus", "postings", "lexicon", "blocks", "doc_stats", "index_stats", "bounds")
#: Words whose postings a task packs at once, and known words from which it forgets them.
MOST_WORDS, MOST_KNOWN = 2_000_000, 500_000
#: Stretches of ascending ids in the rows of a task up to which documents are numbered where they lie.
MOST_STRETCHES = 1000
#: Documents of one run where offsets are summed.
RUN_ROWS = 200_000
_IN_RUN = (1 << 33) - 1  # monotonically_increasing_id has a row's place in its partition there


def ranged(df: DataFrame, *by: str, runs: int | None = None) -> DataFrame:
    """df cut to sorted ranges (as many as Spark's shuffle partitions, or `runs`), with a row's range (run) and its place there (row)."""
    runs = runs or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(runs, *by).sortWithinPartitions(*by)
    return cut.withColumns({"run": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_RUN))})


def numbered(df: DataFrame, by: str, name: str, runs: int | None = None, costly: bool = False) -> DataFrame:
    """df with its 0-based rank by a column: a row's place in its range and the rows of the ranges before.

    The ranges are written, so that a task that runs again finds the same; no task sees more than one. Equal
    values are numbered in any order. Nulls come first; an empty table stays empty. costly: df takes time to make, so it
    is written once before; ranges make it twice, to cut them and to fill them. Where that is in order it is numbered there.
    """
    if costly:
        df, _ = materialize(df, "rows")
        if (placed := _in_place(df, by, name)) is not None:
            return placed
    rows, _ = materialize(ranged(df, by, runs=runs), "ranges")
    sizes = rows.groupBy("run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("run")) - F.col("n")  # a row for each range
    placed = rows.join(F.broadcast(sizes.select("run", before.alias("before"))), "run")  # a row for each range
    return placed.select(*df.columns, (F.col("before") + F.col("row")).alias(name))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, end, least, most): rows of a file, one after another, whose ids ascend. After MOST_STRETCHES of a task, or a null id, one without a file."""
    out: list[list] = []
    for batch in batches:
        file, row, key = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        if key.null_count or len(out) > MOST_STRETCHES:
            out = [[None, 0, 0, 0, 0]]
            break
        key = key.to_numpy()
        same = pc.equal(file.slice(1), file.slice(0, max(0, len(file) - 1))).to_numpy(zero_copy_only=False).astype(bool)
        cut = np.flatnonzero(np.append(True, ~(same & (row[1:] == row[:-1] + 1) & (key[1:] > key[:-1]))) if len(row) else [])[: MOST_STRETCHES + 2]
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(row)], strict=True):
            piece = [file[a].as_py(), int(row[a]), int(row[b - 1]), int(key[a]), int(key[b - 1])]
            if a == 0 and out and out[-1][0] == piece[0] and out[-1][2] + 1 == piece[1] and out[-1][4] < piece[3]:
                before = out.pop()
                piece = [*before[:2], piece[2], before[3], piece[4]]
            out.append(piece)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, [pa.string(), *[pa.int64()] * 4], strict=True)], ["file", "start", "end", "least", "most"])


def _in_place(rows: DataFrame, by: str, name: str) -> DataFrame | None:
    """numbered() where rows are a Parquet table whose files hold an ascending BIGINT, in stretches that don't overlap: a row's number is its place in its file and the rows before that.

    Nothing is moved or written. None where that isn't so, and where there are fewer stretches than cores: then ranges spread the work.
    """
    if dict(rows.dtypes)[by] != "bigint" or " parquet" not in rows._jdf.queryExecution().analyzed().toString():
        return None
    try:
        marked = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return None
    spark = rows.sparkSession
    found = marked.select("file", "at", by).mapInArrow(_stretches, "file string, start long, end long, least long, most long").collect()  # at most MOST_STRETCHES a task
    if len(found) < spark.sparkContext.defaultParallelism or any(r["file"] is None for r in found):
        return None
    found = sorted(found, key=lambda r: r["least"])
    if any(a["most"] >= b["least"] for a, b in zip(found, found[1:], strict=False)):
        return None
    n, first = 0, []
    for r in found:
        first.append((r["file"], r["start"], r["end"], n - r["start"]))
        n += r["end"] - r["start"] + 1
    table = F.broadcast(spark.createDataFrame(first, "file string, start long, end long, shift long"))  # a row for each stretch
    placed = marked.join(table, (marked["file"] == table["file"]) & F.col("at").between(F.col("start"), F.col("end")))
    return placed.select(*rows.columns, (F.col("at") + F.col("shift")).alias(name))


def corpus_of(docs: DataFrame, id_col: str = "doc_id", title: str | None = None, text: str = "text") -> DataFrame:
    """Any table of texts as a corpus; missing titles and texts are empty, ord follows the id."""
    titled = F.coalesce(F.col(title).cast("string"), F.lit("")) if title else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("ext_id"), titled.alias("title"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    placed = _in_place(rows, "ext_id", "ord")
    if placed is None:
        placed = numbered(rows, "ext_id", "ord")
    return placed.select(F.col("ord").cast("long").alias("ord"), "ext_id", "title", "text")


class _Codes(dict):
    """Words as written -> the number of their term, or -1 for a stop word; a word is folded, looked up and stemmed once."""

    def __init__(self, stemming: bool, stopwords: frozenset[str]) -> None:
        super().__init__()
        self.stemming, self.stopwords, self.terms = stemming, stopwords, {}

    def __missing__(self, word: str) -> int:
        w = fold_py(word)
        code = -1 if w in self.stopwords else self.terms.setdefault(porter.stem(w) if self.stemming else w, len(self.terms))
        self[word] = code
        return code


def _pieces(docs: list[tuple], words: list[np.ndarray], known: _Codes) -> Iterator[pa.RecordBatch]:
    """A row for each term and BLOCK of its postings among some documents, and one of the documents' statistics."""
    ord_, ext, size = (np.array([d[k] for d in docs], np.int64) for k in range(3))
    each = np.array([len(w) for w in words])
    code = np.concatenate(words)
    doc = np.repeat(np.arange(len(docs)), each)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    kept = np.flatnonzero(code >= 0)
    code, doc, pos = code[kept].astype(np.int64), doc[kept], pos[kept]
    length = np.bincount(doc, minlength=len(docs))
    stretch = np.cumsum(np.append(0, np.diff(ord_) != 1))[doc]  # ords without a gap: no other task's lie between
    key = stretch * max(1, len(known.terms)) + code
    order = np.argsort(key, kind="stable")
    key, code, doc, pos = key[order], code[order], doc[order], pos[order]
    new = lambda x: np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)
    first = np.flatnonzero(new(key) | new(doc))  # of each posting
    tf = np.diff(np.append(first, len(doc)))
    heads = np.flatnonzero(new(key[first]))
    place = np.arange(len(first)) - np.repeat(heads, np.diff(np.append(heads, len(first))))
    cut = np.flatnonzero(place % BLOCK == 0)  # of each row
    o = ord_[doc[first]]
    delta = np.append(0, np.diff(o))[: len(o)]
    delta[cut] = 0
    gap = np.append(0, np.diff(pos))[: len(pos)]
    gap[first] = pos[first]
    name = pa.array(list(known.terms), pa.string()).take(pa.array(code[first[cut]]))
    rows = np.stack([delta, tf, length[doc[first]]], 1).ravel()
    yield pa.RecordBatch.from_arrays([name, pa.array(o[cut]), codecs.varint_rows(rows, np.append(cut, len(first)) * 3), codecs.varint_rows(gap, np.append(first[cut], len(doc))), pa.nulls(len(cut), pa.binary())], _PIECE)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array(ord_[:1]), *[pa.nulls(1, pa.binary())] * 2, pa.array([np.stack([ord_, ext, length, size], 1).tobytes()], pa.binary())], _PIECE)


_PIECE = ["term", "first", "docs", "places", "stats"]


def _pieces_of(stemming: bool, stopwords: frozenset[str]):  # noqa: ANN202
    """Batches of (ord, ext_id, bytes, text) as _pieces of some MOST_WORDS words each."""
    find = re.compile(f"[{re.sub(r'.x.([0-9A-F]+).', lambda m: chr(int(m[1], 16)), WORD_CLASS)}]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, words, n = _Codes(stemming, stopwords), [], [], 0
        for batch in batches:
            for *d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = find(text)
                docs.append(d)
                words.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                n += len(found)
                if n + len(docs) >= MOST_WORDS:
                    yield from _pieces(docs, words, known)
                    docs, words, n = [], [], 0
                    if len(known) > MOST_KNOWN:
                        known = _Codes(stemming, stopwords)
        if docs:
            yield from _pieces(docs, words, known)

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range of rows (term, first, docs, places, run) as postings; see Index.placed for the last columns."""
    term, count, last, held = None, 0, 0, None
    for batch in batches:
        if not len(batch):
            continue
        rows, at = codecs.varint_flat(batch.column(2))
        delta, tf, length = rows.reshape(-1, 3).T
        n = np.diff(at) // 3
        first = np.cumsum(n) - n
        total = np.cumsum(delta)
        ord_ = total - np.repeat(total[first] - batch.column(1).to_numpy(), n)
        gap, _ = codecs.varint_flat(batch.column(3))
        ends = np.append(0, np.cumsum(tf))
        whole = np.append(0, np.cumsum(gap))
        pos = whole[1:] - np.repeat(whole[ends[:-1]], tf)

        names = batch.column(0)
        head = np.append(names[0].as_py() != term, pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False))
        starts = first[head]  # where a term begins here
        sizes = np.diff(np.append(starts, len(ord_)))
        lead = len(ord_) - sizes.sum()  # postings of the term before
        place = np.concatenate([count + np.arange(lead), np.arange(lead, len(ord_)) - np.repeat(starts, sizes)])
        step = ord_ - np.append(last, ord_[:-1])
        step[starts] = ord_[starts]
        edge = np.zeros(len(ord_), np.int8)
        if held is None:
            edge[0] = 1
        else:
            yield held
        term, count, last = names[len(names) - 1].as_py(), int(place[-1]) + 1, int(ord_[-1])
        held = pa.RecordBatch.from_arrays(
            [names.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(ord_), pa.array(tf.astype(np.int32)), pa.array(length), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pos.astype(np.int32))), pa.array(np.full(len(ord_), batch.column(4)[0].as_py(), np.int32)), pa.array(place), pa.array(step), pa.array(edge)],
            _PLACED,
        )
    if held is not None:
        edge = held.column(8).to_numpy().copy()
        edge[-1] += 2
        yield held.set_column(8, "edge", pa.array(edge))


_PLACED = ["term", "ord", "tf", "length", "positions", "run", "place", "delta", "edge"]
_STATS = ["ord", "ext_id", "length", "bytes"]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], _STATS)


def _bounds(edges: Sequence[Row]) -> list[tuple[int, str, int, int]]:
    """(run, term, before, last) of the ranges that begin inside a term's list: its postings in ranges before, and their last ord."""
    out, term, count, last = [], None, 0, 0
    ends = {r["run"]: r for r in edges if r["edge"] & 2}
    for a in sorted((r for r in edges if r["edge"] & 1), key=lambda r: r["run"]):
        z, before = ends[a["run"]], count if a["term"] == term else 0
        if before:
            out.append((a["run"], term, before, last))
        term, count, last = z["term"], z["place"] + 1 + (before if z["term"] == a["term"] else 0), z["ord"]
    return out


def whole_text() -> Column:
    return F.concat_ws(" ", "title", "text")


def analyzed(corpus: DataFrame, stemming: bool = True, stopwords: frozenset[str] = STOPWORDS) -> DataFrame:
    """(ord, pos, term): every word takes a position, stop words give no row."""
    words = corpus.select("ord", word_list(whole_text()).alias("word"))
    if stemming:
        words = words.select("ord", F.col("word").alias("raw"), F.col("word").alias("term"))
        words = porter.stemmed(words, "term").select("ord", F.posexplode(F.arrays_zip("raw", "term")).alias("pos", "x")).select("ord", "pos", F.col("x.raw").alias("word"), F.col("x.term").alias("term"))
    else:
        words = words.select("ord", F.posexplode("word").alias("pos", "word")).withColumn("term", F.col("word"))
    return words.filter(~is_stopword(F.col("word"), stopwords)).select("ord", "pos", "term")


def idf(df: Column, documents: Column) -> Column:
    return F.when(documents > 0, F.log(1 + (documents - df + 0.5) / (df + 0.5))).otherwise(0.0)


def bm25(tf: Column, length: Column, average: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    part = tf + k1 * (1 - b + b * F.when(average > 0, length / average).otherwise(1.0))
    return weight * (tf * (k1 + 1)) / F.when(part > 0, part).otherwise(1.0)


@dataclass
class Index:
    corpus: DataFrame  # ord, ext_id, title, text, bytes
    postings: DataFrame  # term, ord, tf, length, positions
    lexicon: DataFrame  # term, doc_freq, idf, max_term_score
    blocks: DataFrame  # term, block_no, min_ord, max_ord, num_docs, block_max_score
    doc_stats: DataFrame
    index_stats: DataFrame
    #: The postings with run, their range; place, how many of their term precede them there; delta, from the ord before there; and edge, 1 on a range's first, 2 on its last, 3 on an only one.
    placed: DataFrame
    bounds: DataFrame  # run, term, before, last: ranges that begin inside a term's list, its postings before them and their last ord
    stemming: bool = True
    stopwords: frozenset[str] = STOPWORDS
    k1: float = K1
    b: float = B
    total: int = 0  # documents
    average: float = 0.0  # words of a document

    @staticmethod
    def build(corpus: DataFrame, path: str | None = None, stemming: bool = True, stopwords: frozenset[str] = STOPWORDS, k1: float = K1, b: float = B) -> Index:
        """Write the index of a corpus to a folder (None: one in the shared folder) and open it.

        Texts are read twice. Each task turns some MOST_WORDS words into rows of a term and up to BLOCK of its
        postings, packed; these are shuffled and sorted once, and unpacked where they are written. Blocks are
        counted from a posting's place in its term and range; the lexicon follows from them.
        """
        spark = corpus.sparkSession
        path = path or scratch_path(spark, "index")
        bytes_of = F.octet_length(F.col("title")) + F.octet_length(F.col("text"))
        corpus.withColumn("bytes", bytes_of.cast("long")).write.mode("overwrite").parquet(f"{path}/corpus")
        corpus = spark.read.parquet(f"{path}/corpus")
        texts = corpus.select("ord", "ext_id", "bytes", whole_text().alias("text"))
        raw, scratch = materialize(texts.mapInArrow(_pieces_of(stemming, stopwords), "term string, first long, docs binary, places binary, stats binary"), "postings-by-document")
        cut = ranged(raw.filter("term is not null").drop("stats"), "term", "first").drop("row")
        cut.mapInArrow(_postings, "term string, ord long, tf int, length long, positions array<int>, run int, place long, delta long, edge byte").write.mode("overwrite").parquet(f"{path}/postings")
        raw.filter("stats is not null").select("stats").mapInArrow(_statistics, "ord long, ext_id long, length long, bytes long").write.mode("overwrite").parquet(f"{path}/doc_stats")
        discard(spark, scratch)
        whole = spark.read.parquet(f"{path}/doc_stats").agg(F.count("*").alias("total_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_doc_len"))
        whole.coalesce(1).write.mode("overwrite").parquet(f"{path}/index_stats")
        total = spark.read.parquet(f"{path}/index_stats").first()

        kept = spark.read.parquet(f"{path}/postings")
        bounds = _bounds(kept.filter("edge > 0").select("run", "edge", "term", "ord", "place").collect())  # two rows a range at most
        spark.createDataFrame(bounds, "run int, term string, before long, last long").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
        own = kept.join(F.broadcast(spark.read.parquet(f"{path}/bounds").drop("last")), ["run", "term"], "left")  # at most a row for each range
        one = bm25(F.col("tf"), F.col("length"), F.lit(total["avg_doc_len"]), F.lit(1.0), k1, b)
        blocks = own.select("term", "ord", one.alias("part"), F.expr(f"(place + coalesce(before, 0)) div {BLOCK}").alias("block_no")).groupBy("term", "block_no")
        blocks = blocks.agg(F.min("ord").alias("min_ord"), F.max("ord").alias("max_ord"), F.count("*").alias("num_docs"), F.max("part").alias("most"))
        of_term = Window.partitionBy("term")  # its blocks
        blocks = blocks.withColumns({"doc_freq": F.sum("num_docs").over(of_term), "top": F.max("most").over(of_term)}).withColumn("idf", idf(F.col("doc_freq"), F.lit(total["total_docs"])))
        blocks.select("term", "block_no", "min_ord", "max_ord", "num_docs", (F.col("idf") * F.col("most")).alias("block_max_score"), "doc_freq", "idf", (F.col("idf") * F.col("top")).alias("max_term_score")).write.mode("overwrite").parquet(f"{path}/blocks")
        terms = spark.read.parquet(f"{path}/blocks").filter("block_no = 0")
        terms.select("term", "doc_freq", "idf", "max_term_score").sort("term").write.mode("overwrite").parquet(f"{path}/lexicon")

        counts = {"corpus": total["total_docs"], "doc_stats": total["total_docs"], "index_stats": 1} | {name: spark.read.parquet(f"{path}/{name}").count() for name in ("postings", "lexicon", "blocks")}
        manifest = {"version": VERSION, "stemming": stemming, "stopwords": sorted(stopwords), "k1": k1, "b": b, "rows": counts}
        spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        return Index.load(spark, path)

    def scored(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, ord, tf, length, positions, doc_freq, idf, score): all postings, or those of a small table of distinct terms."""
        lexicon = self.lexicon.select("term", "doc_freq", "idf")
        if terms is not None:
            lexicon = F.broadcast(lexicon.join(F.broadcast(terms.select("term")), "term", "left_semi"))  # the caller's few terms
        return self.postings.join(lexicon, "term").withColumn("score", bm25(F.col("tf"), F.col("length"), F.lit(self.average), F.col("idf"), self.k1, self.b))

    @staticmethod
    def load(spark: SparkSession, path: str, k1: float | None = None, b: float | None = None) -> Index:
        """Open an index; ValueError where its version, a table's row count or the parameters are others."""
        found = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if found["version"] != VERSION:
            raise ValueError(f"the index has version {found['version']}, not {VERSION}")
        for name, asked in (("k1", k1), ("b", b)):
            if asked is not None and abs(asked - found[name]) > 1e-4:
                raise ValueError(f"the index was built with {name} = {found[name]}")
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in _TABLES}
        for name, rows in found["rows"].items():
            if tables[name].count() != rows:
                raise ValueError(f"the index has other {name} than were written")
        tables["placed"], tables["postings"] = tables["postings"], tables["postings"].drop("run", "place", "delta", "edge")
        tables["blocks"] = tables["blocks"].drop("doc_freq", "idf", "max_term_score")
        one = tables["index_stats"].first()
        return Index(**tables, total=one["total_docs"], average=one["avg_doc_len"], stemming=found["stemming"], stopwords=frozenset(found["stopwords"]), k1=found["k1"], b=found["b"])

    def deltas(self) -> DataFrame:
        """(term, ord, delta): the difference from the term's posting before, the first from 0."""
        rows = self.placed.select("term", "ord", "run", "place", "delta").join(F.broadcast(self.bounds), ["run", "term"], "left")  # at most a row for each range
        return rows.select("term", "ord", F.when((F.col("place") == 0) & F.col("last").isNotNull(), F.col("ord") - F.col("last")).otherwise(F.col("delta")).alias("delta"))

    def with_term_ids(self) -> DataFrame:
        """The lexicon with term_id, the rank of a term in byte order."""
        return numbered(self.lexicon, "term", "term_id")

    def offsets(self) -> DataFrame:
        """(ord, start, end): the bytes of title and text in the concatenation of all documents."""
        runs = self.doc_stats.select("ord", "bytes", F.expr(f"ord div {RUN_ROWS}").alias("run"))
        before = F.sum("n").over(Window.orderBy("run")) - F.col("n")
        totals = runs.groupBy("run").agg(F.sum("bytes").alias("n")).select("run", before.alias("before"))
        within = F.sum("bytes").over(Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
        placed = runs.join(F.broadcast(totals), "run").withColumn("end", F.col("before") + within)  # a row for each run
        return placed.select("ord", (F.col("end") - F.col("bytes")).alias("start"), "end")
