"""Toxicity: whole documents' scores against brute force, what features are fitted, and how many toxic documents are found."""

import math
import re

import numpy as np
import pytest

from lakewarden.llm import toxicity


def plain_score(text, weights, odds):
    """A document's score, sentence by sentence and word by word."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = [w for w in re.split(r"[ \t\v\f\r,]+", sentence) if w]
        if words:
            z = odds.sentence
            for word in words:
                lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word).lower()
                z += float(weights[toxicity.grams([lower])[1]].astype(float).sum())
            clean *= 1 - 1 / (1 + math.exp(-z))
    if not re.search(r"[^.!?\n \t\v\f\r,]", text or ""):
        clean = 1 - 1 / (1 + math.exp(-odds.sentence))
    toxic = (1 - clean) / clean * math.exp(odds.even) if clean > 0 else math.inf
    return 1.0 if math.isinf(toxic) else toxic / (1 + toxic)


def test_scores_of_whole_documents(spark):
    rng = np.random.default_rng(5)
    weights = (rng.normal(size=1 << toxicity.BITS) * 0.3).astype(np.float32)
    texts = ["You, fool! Go away.\nOr not?", "one", "", None, " \n.", "Straße ÄÖ über, naïve 日本語. x!?y", "word " * 400 + ". end", "A.b.c\rd"]
    for odds in (toxicity.Odds(-4.0, 2.0), toxicity.Odds(-1.5, 0.0)):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        for r in toxicity.score(docs, weights, odds, ["doc_id", "text"]).collect():
            assert r.score == pytest.approx(plain_score(r.text, weights, odds), rel=1e-4, abs=1e-9), r.text


def test_statistic_of_telling_features():
    toxic, clean = np.array([10, 5, 0, 3, 20]), np.array([0, 50, 40, 30, 200])

    def plain(a, b, n=20, m=200):
        table = [(a, n, a + b), (n - a, n, n + m - a - b), (b, m, a + b), (m - b, m, n + m - a - b)]
        return 2 * sum(o * math.log(o * (n + m) / (size * row)) for o, size, row in table if o)

    assert toxicity.telling(toxic, clean, 20, 200) == pytest.approx([plain(a, b) for a, b in zip(toxic, clean, strict=True)])


def test_named_sentences_reach_the_threshold():
    text, p = "a. b. c. d.", np.array([0.1, 0.3, 0.05, 0.2])
    assert [s["begin"] for s in toxicity.offending(text, p, 0.25)] == [2]
    assert [s["begin"] for s in toxicity.offending(text, p, 0.4)] == [2, 8]


def test_held_out_documents(spark):
    """At the size of the larger test data, of what is held out, most toxic documents are found and few clean ones taken for such; a share of the labels is noise."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.rate(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null")
    found = {(r.toxic, r.predicted): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    right, missed, false = found[1, 1], found.get((1, 0), 0), found.get((0, 1), 0)
    assert right >= 0.85 * (right + missed) and right >= 0.93 * (right + false), found
