"""Reading documents: JSON lines, wiki dumps, web pages; choosing a web corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.index import numbered

_FIELDS = "id string, title string, text string"


def parse_json_lines(lines: DataFrame, value: str, order: str) -> DataFrame:
    """(ord, ext_id, title, text) of JSON lines in the order of a column.

    Blank lines are skipped, and lines with neither id nor text. Missing titles and texts are
    empty; an id that doesn't begin with digits, or is 0, becomes ord + 1. Other fields are ignored.
    Of a line that is no valid JSON the fields are taken as they can be found.
    """
    read = F.from_json(F.col(value), f"{_FIELDS}, bad string", {"columnNameOfCorruptRecord": "bad"})
    held = lines.filter(F.trim(F.col(value)) != "").select(order, value, read.alias("j"))
    field = lambda name: F.coalesce(F.when(F.col("j.bad").isNotNull(), _found(F.col(value), name)).otherwise(F.col(f"j.{name}")), F.lit("")).alias(name)
    held = held.select(order, field("id"), field("title"), field("text"))
    rows = numbered(held.filter("id <> '' or text <> ''"), order, "ord", costly=True)
    given = F.expr("try_cast(nullif(regexp_extract(id, '^[0-9]+', 0), '') as bigint)")
    return rows.select(F.col("ord").cast("long").alias("ord"), F.coalesce(F.nullif(given, F.lit(0)), F.col("ord") + 1).cast("long").alias("ext_id"), "title", "text")


def _found(line: Column, name: str) -> Column:
    """A field of a line that may be cut off or malformed elsewhere: a quoted string, else what stands up to a comma, brace or blank."""
    head = r'(?s)(?:^|[{,])[ \t\r\n]*"' + name + r'"[^:]*:[ \t\r\n]*'
    quoted = F.regexp_extract(line, head + r'"((?:[^"\\]|\\.)*)"', 1)
    whole = F.from_json(F.concat(F.lit('{"v":"'), quoted, F.lit('"}')), "v string")["v"]
    bare = F.regexp_extract(line, head + r'([^" \t\r\n,}][^,}\r\n ]*)', 1)
    return F.when(quoted != "", F.coalesce(whole, quoted)).otherwise(bare)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines file or folder as a corpus, in file and line order."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("line")).alias("at"))
    return parse_json_lines(lines.withColumn("place", F.concat("at.file_path", F.lit("\x00"), F.lpad(F.col("at.line").cast("string"), 20, "0"))), "value", "place")


def clean_wikitext(text: Column) -> Column:
    """Plain text of wiki markup: comments, references, tags, templates, tables, links, quotes and headings go or are unwrapped."""
    text = F.coalesce(text, F.lit(""))
    for pattern, by in (
        (r"(?s)<!--.*?-->", ""),
        (r"(?is)<ref[^>]*>.*?</ref>", ""),
        (r"(?i)<ref[^>]*/>", ""),
        (r"<[^>]+>", ""),
        (r"\{\{[^{}]*\}\}", ""),
        (r"\{\{[^{}]*\}\}", ""),
        (r"(?s)\{\|.*?\|\}", ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    text = _links(text)
    for pattern, by in (
        (r"\[https?://[^\s\]]+\s+([^\]]+)\]", "$1"),
        (r"\[https?://[^\s\]]+\]", ""),
        (r"'{2,5}", ""),
        (r"={2,}\s*(.*?)\s*={2,}", "$1"),
    ):
        text = F.regexp_replace(text, pattern, by)
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1), lambda x: F.regexp_replace(x, r"^[\s\x1C-\x1F\x{85}\x{A0}]+|[\s\x1C-\x1F\x{85}\x{A0}]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def _links(text: Column) -> Column:
    """[[a|b]] becomes b; a link whose inside has a colon goes. Links don't span lines, and end at the first ]]."""
    inner = r"(?:(?!\]\])[^\n])*"
    no_colon = r"(?:(?!\]\])[^\n:])*"
    text = F.regexp_replace(text, rf"\[\[{no_colon}:{inner}\]\]", "")
    return F.regexp_replace(text, rf"\[\[(?:(?:(?!\]\])[^\n])*\|)?((?:(?!\]\])[^\n|])*)\]\]", "$1")


def clean_html(html: Column) -> Column:
    """Plain text of a web page: comments, scripts and styles go, tags part words, the commonest entities are resolved."""
    for pattern, by in ((r"(?s)<!--.*?-->", " "), (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"<[^>]+>", " ")):
        html = F.regexp_replace(html, pattern, by)
    for name, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        html = F.replace(html, F.lit(name), F.lit(raw))
    return F.trim(F.regexp_replace(html, "[ \t\r\n]+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "[ \t\r\n]+", " "))


def wiki_articles(pages: DataFrame, most: int | None = None, order: str = "page_no") -> DataFrame:
    """(id, title, text) of dump pages (order, ns, redirect, title, text): articles of at least 80 characters, numbered from 1.

    Redirects, other namespaces and titles of categories, templates, files and Wikipedia pages are left out.
    """
    kept = pages.filter((F.col("ns") == "0") & F.col("redirect").isNull() & ~F.col("title").rlike("^(Category|Template|File|Wikipedia):"))
    kept = kept.select(order, "title", clean_wikitext(F.col("text")).alias("text")).filter(F.length("text") >= 80)
    rows = numbered(kept, order, "n", costly=True).select((F.col("n") + 1).alias("id"), "title", "text")
    return rows.filter(F.col("id") <= most) if most is not None else rows


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a MediaWiki XML dump, compressed or not, in the shape wiki_articles() takes."""
    schema = "id long, ns string, title string, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.select(F.col("id").alias("page_no"), "ns", F.col("redirect._title").alias("redirect"), "title", F.col("revision.text._VALUE").alias("text"))


def select_corpus(docs: DataFrame, keywords: Sequence[str], most: int = 1500, first: int = 500, order: str = "ord", least_chars: int = 150) -> DataFrame:
    """(id, title, text): of long enough texts the first of each title; those with a keyword up front, or while fewer than `first` are chosen.

    Texts are cut at 1200 characters; the result is a corpus of at most `most` documents.
    Up to the `first`-th every candidate is chosen, so its rank decides; later, keywords do.
    A title is taken by its first document that is chosen, not by its first at all.
    """
    long = docs.filter(F.length("text") >= least_chars)
    head = F.lower(F.concat_ws(" ", "title", F.substring("text", 1, 500)))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(head, F.lit(word))
    rows = long.select(order, "title", "text", hit.alias("hit"))
    first_of = Window.partitionBy("title").orderBy(order)
    heads = rows.select(order, "title", F.row_number().over(first_of).alias("r")).filter("r = 1").orderBy(order).limit(first)
    last = heads.agg(F.max(order).alias("last"), F.count("*").alias("n")).select(F.when(F.col("n") >= first, F.col("last")).alias("last"))
    marked = rows.crossJoin(F.broadcast(last)).filter(F.col("hit") | F.col("last").isNull() | (F.col(order) <= F.col("last")))  # one row
    chosen = marked.withColumn("r", F.row_number().over(first_of)).filter("r = 1").orderBy(order).limit(most)
    number = F.row_number().over(Window.orderBy(order))
    return chosen.select(number.cast("long").alias("id"), "title", F.substring("text", 1, 1200).alias("text"))
