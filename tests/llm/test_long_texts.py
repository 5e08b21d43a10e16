"""A text above one Arrow batch and one slice goes through every operator and the pipeline whole."""

import random

import numpy as np
import pytest
from test_operators import LABELS, frame

import corpus_pipeline
from quillon.llm import bpe, chat, exact_dedup, mil, mixing, paragraphs, repetition, simhash, suffixes, toxicity
from quillon.session import BATCH_BYTES

WORDS = 1_500_000


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(3)
    known = np.array(["".join(random.Random(k).choices("abcdefghijklmnop", k=3 + k % 6)) for k in range(30_000)])
    words = known[rng.integers(0, len(known), WORDS)]
    text = "\n".join(" ".join(words[k : k + 500]) + "." for k in range(0, WORDS, 500))
    assert len(text) > BATCH_BYTES
    return text


@pytest.fixture(scope="module")
def docs(spark, long_text):
    return frame(spark, [(1, long_text, "a"), (2, long_text, "b"), (3, "short and plain text", "a"), (4, None, "b")]).repartition(2, "doc_id")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1)], LABELS)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_dedup(docs, long_text):
    got = paragraphs.repeated_paragraphs(docs).collect()
    assert {(r["doc_id"], r["kept_doc_id"]) for r in got} == {(2, 1)}
    assert min(r["start"] for r in got) == 0 and max(r["end"] for r in got) == len(long_text) - 1 and sum(r["end"] - r["start"] for r in got) > 0.99 * (len(long_text) - len(got))
    assert [(i, r["winner_id"]) for i, r in sorted(rows(exact_dedup.exact_repeats(docs)).items())] == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert {tuple(r) for r in suffixes.repeated_spans(docs).collect()} == {(1, 0, WORDS, True), (2, 0, WORDS, False)}
    assert [(i, r["group_id"]) for i, r in sorted(rows(simhash.near_groups(docs)).items())] == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_scores(docs, labels):
    kept = rows(mil.quality_scores(docs, labels))
    assert kept[1]["score"] == kept[2]["score"] > 0 and kept[4]["score"] == 0
    toxic = rows(toxicity.toxicity(docs, labels))
    assert toxic[1]["score"] == toxic[2]["score"] and len(toxic) == 4
    found = rows(repetition.repetition(docs))
    assert all(found[1][k] == found[2][k] for k in repetition.RULES) and found[1]["in_5"] == 0
    taken = rows(mixing.choose(docs))
    assert taken[1]["n_tokens"] == taken[2]["n_tokens"] == WORDS


def test_tokens(docs, long_text, spark):
    got = rows(bpe.encode(docs))
    assert got[1]["lossless"] and got[1]["n_tokens"] > WORDS and got[1]["ids"] == got[2]["ids"] and got[4]["ids"] == []
    turns = spark.createDataFrame([(1, 1, "user", "hello"), (1, 2, "assistant", long_text)], "conv_id long, turn int, role string, text string")
    chatted = chat.format_chats(turns).collect()[0]
    assert chatted["n_tokens"] > got[1]["n_tokens"] and chatted["n_trained"] > WORDS


def test_pipeline(docs, spark, tmp_path):
    """Without labels of both classes the classifier keeps every text with words; the copy goes."""
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(corpus_pipeline.run(spark, str(tmp_path)))
    assert 1 in got and 2 not in got and got[1]["lossless"]
