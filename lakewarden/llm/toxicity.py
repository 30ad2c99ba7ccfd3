"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, fitted from document labels.

A sentence's score is logistic in the hashed character n-grams of its words; a document is toxic if at least
one of its sentences is: 1 - product of (1 - p). What is returned is stated for even odds of both labels, so that it does not hang on how many toxic rows
the labels happen to have, or for less toxic ones, if else too many of the clean rows that were learned from would be rejected. The gradient of the document's log-likelihood reaches the
sentences through that product, so that no sentence needs a label. Partitions fit on their own rows and the
weights are averaged after each round (iterative parameter mixing). A partition of few rows would learn only what it knows by
heart, so small samples are fitted in fewer partitions; what the model is hangs on the sample, not on the table's size.

Cases: null or empty text has the score of one empty sentence; null labels are not learned; null ids are the id
'' for the fold; without labels all scores are 0; repeated rows are scored each, and of equal labels each counts; other
columns are ignored, and columns to keep that have the name of a result are left out.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import FOLDED, MIX, SPACES, Bytes, WordCodes, blocks, char_matrix, chunks, flags, id_remainder, keys_of_spans, ragged, remember, segment_sums, stage_table
from lakewarden.llm.lattice import keys_of

BITS = 20
#: Lengths of the character n-grams, of the word between '^' and '$'; each whole word is one more feature.
GRAMS = (4, 5, 6)
ENDS = b".!?\n"
SENTENCE = re.compile(r"[^.!?\n]*[^.!?\n \t\v\f\r,][^.!?\n]*")  # with a word in it
PARTING, ENDING = flags(SPACES + b"," + ENDS), flags(ENDS)
#: A feature is fitted if the labels of the texts that have it differ from the others' by this much (G statistic): of a million features that
#: tell nothing about a few reach it. Without that, rare features would learn texts by heart and leave nothing to learn to the telling ones.
TELLING = 20.0
#: Pull of every weight towards zero, so that few features remain.
SPARSITY = 5e-5
#: Rejected from here on.
THRESHOLD = 0.7
#: Of the clean texts of the sample at most this share is to be rejected.
REJECTED = 0.002


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, features): each feature of each word, whole words and n-grams of words of any length."""
    words = [f"^{w}$" for w in words]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.ascontiguousarray(char_matrix(words, int(lengths.max())).T)
    whole = np.zeros(len(words), np.uint64)
    for j, column in enumerate(chars):
        whole = np.where(j < lengths, whole * np.uint64(0x100000001B3) + column.astype(np.uint64), whole)
    owners, features = [np.arange(len(words))], [feature(whole, 0)]
    for n, keys in enumerate(keys_of(chars, max(GRAMS)), 1):
        if n in GRAMS and n <= len(chars):
            at = np.nonzero(chars[n - 1 :])
            owners.append(at[1])
            features.append(feature(keys[n - 1 :][at], n))
    return np.concatenate(owners), np.concatenate(features)


def feature(keys: np.ndarray, kind: int) -> np.ndarray:
    return ((keys * np.uint64(int(MIX) + 2 * kind)) >> np.uint64(64 - BITS)).astype(np.int32)


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence that has a word; a text without any is one empty sentence."""
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, len(text))]


def split(part: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of all words, how many each sentence has, and how many sentences each text has."""
    begins, ends, counts = part.words(PARTING)
    passed = np.searchsorted(np.flatnonzero(ENDING[part.data]), begins)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(np.diff(passed, prepend=-1) | np.diff(row, prepend=-1)) if len(begins) else np.zeros(0, np.int64)
    own = np.bincount(row[first], minlength=len(counts))
    per_text = np.maximum(own, 1)
    per_sentence = np.zeros(int(per_text.sum()), np.int64)
    per_sentence[ragged(np.cumsum(per_text) - per_text, own)] = np.diff(np.append(first, len(begins)))
    return begins, ends, per_sentence, per_text


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The G statistic of independence of each feature and the label, from how many toxic and clean texts have it."""
    total, found = n_toxic + n_clean, np.zeros(len(toxic))
    for seen, size in ((toxic, n_toxic), (clean, n_clean)):
        for own, others in ((seen, toxic + clean), (size - seen, total - toxic - clean)):
            found += np.where(own > 0, own * np.log(np.maximum(own, 1) * float(total) / np.maximum(others * float(size), 1)), 0.0)
    return 2 * found


def log_safe(z: np.ndarray) -> np.ndarray:
    """log(1 - p) of sentences with the given log-odds."""
    return -np.logaddexp(0, z)


class Odds(NamedTuple):
    """sentence: log-odds of a sentence without a telling word; even: what a document's log-odds gain, at most where toxic and clean documents are as many."""

    sentence: float
    even: float


class WordLogits(WordCodes):
    """The part of each word in the log-odds of its sentence."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        super().__init__(terms=FOLDED)

    def forget(self) -> None:
        self.logits = np.zeros(0, np.float32)

    def learn(self, words: list[str]) -> None:
        own = np.zeros(len(words), np.float32)
        for places, block in blocks([w.lower() for w in words]):
            rows, features = grams(block)
            own[places] = np.bincount(rows, self.weights[features], len(block))
        self.logits = np.concatenate([self.logits, own])

    def score(self, part: Bytes, odds: Odds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of all sentences, how many each text has, and the texts' noisy-or at even odds of the labels."""
        begins, ends, per_sentence, per_text = split(part)
        found = self.of(part.data, begins, ends)
        z = odds.sentence + segment_sums(self.logits[found], per_sentence)
        safe = segment_sums(log_safe(z), per_text)
        with np.errstate(divide="ignore"):
            return z, per_text, 1 / (1 + np.exp(safe - np.log(-np.expm1(safe)) - odds.even))


class Bag:
    """The training rows of one partition as arrays: sentences of word numbers, words of feature numbers."""

    def __init__(self, texts: list[str], labels: list[int], row_weights: list[float]) -> None:
        part = Bytes.of(pa.array(texts, pa.large_string()))
        begins, ends, self.per_sentence, self.per_text = split(part)
        self.labels, self.row_weights = np.array(labels), np.array(row_weights) / sum(row_weights)
        _, some, self.words = np.unique(keys_of_spans(part.data, begins, ends, FOLDED), return_index=True, return_inverse=True)
        raw = part.data.tobytes()
        number = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(begins[some].tolist(), ends[some].tolist(), strict=True)]
        rows, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for places, block in blocks(number):
            own, numbers = grams(block)
            rows.append(places[own])
            features.append(numbers)
        order = np.argsort(row := np.concatenate(rows), kind="stable")
        features, per_word = np.concatenate(features)[order], np.bincount(row, minlength=len(number))
        del rows, row, order, raw, part

        first, at, texts_of = np.cumsum(per_word) - per_word, 0, np.zeros((2, 1 << BITS), np.int32)
        sizes = np.add.reduceat(self.per_sentence, np.cumsum(self.per_text) - self.per_text)
        for size, label in zip(sizes, labels, strict=True):
            own = np.unique(self.words[at : at + size])
            texts_of[int(label == 1), np.unique(features[ragged(first[own], per_word[own])])] += 1
            at += size
        n_toxic = sum(y == 1 for y in labels)
        often = telling(texts_of[1], texts_of[0], n_toxic, len(labels) - n_toxic) >= TELLING
        self.numbers = np.flatnonzero(often)  # of the features that are fitted
        place = (np.cumsum(often) - 1).astype(np.int32)
        self.features = place[features[often[features]]]
        self.per_word = np.bincount(np.repeat(np.arange(len(number)), per_word)[often[features]], minlength=len(number))

    def gradient(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Of the mean negative log-likelihood of the labels."""
        z = bias + segment_sums(segment_sums(weights[self.features], self.per_word)[self.words], self.per_sentence)
        safe = segment_sums(log_safe(z), self.per_text)
        toxic = np.exp(safe) / np.maximum(-np.expm1(safe), 1e-12)
        pull = np.where(self.labels == 1, -toxic, 1.0) * self.row_weights
        dz = np.repeat(pull, self.per_text) / (1 + np.exp(-np.clip(z, -30, 30)))
        by_word = np.bincount(self.words, np.repeat(dz, self.per_sentence), len(self.per_word))
        return np.bincount(self.features, np.repeat(by_word, self.per_word), len(weights)), float(dz.sum())

    def descend(self, weights: np.ndarray, squares: np.ndarray, bias: float, bias_square: float, steps: int) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Adaptive gradient steps, each followed by the pull towards zero."""
        w, g2 = weights[self.numbers].astype(np.float64), squares[self.numbers].astype(np.float64)
        for _ in range(steps):
            gw, gb = self.gradient(w, bias)
            g2, bias_square = g2 + gw * gw, bias_square + gb * gb
            size = 0.1 / np.sqrt(g2)
            w -= size * gw
            w = np.sign(w) * np.maximum(np.abs(w) - size * SPARSITY, 0)
            bias -= 0.1 * gb / np.sqrt(bias_square)
        return w, g2, bias, bias_square


def fit(docs: DataFrame, labels: DataFrame, *, rounds: int = 3, steps: int = 150, max_positive: int = 3000, max_negative: int = 9000, max_chars: int = 50_000, workers: int = 6) -> tuple[np.ndarray, Odds]:
    """Weights and odds, from docs (doc_id, text) and labels (labelled_id, label of 0 or 1, an id once).

    The classifier is fitted on about max_positive and max_negative labelled documents, those with the smallest hash of the
    id, of texts of at most max_chars characters; rows are weighted so that the labels keep their shares. The chosen
    ids are so many at most and are broadcast; texts are not shuffled before they are chosen.
    """
    weights, squares = np.zeros(1 << BITS, np.float32), np.full(1 << BITS, 1e-6, np.float32)
    bias, bias_square = -5.0, 1e-6
    counts = {r.label: r.n for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return weights, Odds(-50.0, 0.0)
    rates = {0: min(1.0, max_negative / counts[0]), 1: min(1.0, max_positive / counts[1])}
    rate = F.when(F.col("label") == 1, rates[1]).otherwise(rates[0])
    chosen = labels.filter(F.pmod(F.xxhash64("labelled_id"), F.lit(1 << 20)) < rate * (1 << 20))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(f"text is not null and length(text) <= {max_chars}")
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("text", "label")
    # a partition of fewer rows would learn little, and the mean of many such ones nothing
    workers = max(1, min(workers, int(sum(counts[y] * rates[y] for y in (0, 1))) // 1500))
    sample = stage_table(found.repartition(workers), "labelled")
    for _ in range(rounds):

        def local(batches: Iterator[pa.RecordBatch], state: tuple = (weights, squares, bias, bias_square)) -> Iterator[pa.RecordBatch]:
            texts, labels = [], []
            for batch in batches:
                texts += batch.column("text").to_pylist()
                labels += batch.column("label").to_pylist()
            if texts:
                bag = Bag(texts, labels, [1 / rates[y] for y in labels])
                w, g2, b, b2 = bag.descend(*state, steps)
                arrays = (pa.array([x.tobytes()], pa.binary()) for x in (bag.numbers.astype(np.int32), w.astype(np.float32), g2.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array([len(texts)], pa.int64()), pa.array([b]), pa.array([b2]), *arrays], names=["n", "bias", "bias_square", "numbers", "weights", "squares"])

        found = sample.coalesce(workers).mapInArrow(local, "n bigint, bias double, bias_square double, numbers binary, weights binary, squares binary").collect()
        total = sum(r.n for r in found)
        mean_w, mean_g = np.zeros(len(weights)), np.zeros(len(weights))
        for r in found:
            own_w, own_g, at = weights.astype(np.float64), squares.astype(np.float64), np.frombuffer(r.numbers, np.int32)
            own_w[at], own_g[at] = np.frombuffer(r.weights, np.float32), np.frombuffer(r.squares, np.float32)
            mean_w += r.n / total * own_w
            mean_g += r.n / total * own_g
        weights, squares = mean_w.astype(np.float32), mean_g.astype(np.float32)
        bias, bias_square = (sum(r.n / total * r[c] for r in found) for c in ("bias", "bias_square"))
    # the score that all but a few of the sample's clean texts stay below
    clean = score(sample.filter("label = 0"), weights, Odds(bias, 0.0), ["label"]).agg(F.percentile("score", 1 - REJECTED)).first()[0]
    room = math.log(THRESHOLD / (1 - THRESHOLD)) - math.log(clean / (1 - clean)) if clean and clean < 1 else 0.0
    return weights, Odds(bias, min(float(np.log(counts[0] / counts[1])), room))


def offending(text: str, p: np.ndarray, least: float) -> list[dict]:
    """The sentences at or above THRESHOLD, and the likeliest others until the noisy-or of those named reaches `least`, in the order of the text."""
    order = np.argsort(-p, kind="stable")
    safe = np.cumprod(1 - p[order])
    few = max(int((p >= THRESHOLD).sum()), int(np.searchsorted(-safe, -(1 - least), "left")) + 1)
    where = sentences(text)
    return [{"begin": where[i][0], "end": where[i][1], "score": float(p[i])} for i in sorted(order[:few].tolist())]


def score(docs: DataFrame, weights: np.ndarray, odds: Odds, keep: list[str], *, locate: bool = False) -> DataFrame:
    """The columns of keep, score and, if asked for, sentences: begin, end and score of those that make the document toxic."""
    keep = [c for c in keep if c.lower() not in ("score", "sentences")]
    text = "text" if "text" in keep else "__text"
    shared, key = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32)), uuid.uuid4().hex
    least = 1 / (1 + (1 - THRESHOLD) / THRESHOLD * math.exp(odds.even))  # the noisy-or of a score at the threshold
    found_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remember(key, lambda: WordLogits(shared.value.astype(np.float64)))
        for batch in (part for whole in batches for part in chunks(whole, text)):
            part = Bytes.of(batch.column(text))
            z, per_text, scores = words.score(part, odds)
            columns = [*(batch.column(c) for c in keep), pa.array(scores, pa.float64())]
            if locate:
                p, begins = 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.cumsum(per_text) - per_text
                columns.append(pa.array([offending(part.text(i), p[at : at + n], least) if score >= THRESHOLD else [] for i, (at, n, score) in enumerate(zip(begins, per_text, scores, strict=True))], found_type))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score"] + ["sentences"] * locate)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    needed = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").cast("string").alias(text))
    return needed.mapInArrow(run, f"{kinds}, score double" + ", sentences array<struct<begin: bigint, end: bigint, score: double>>" * locate)


def held_out(doc_id: str = "doc_id") -> Column:
    return id_remainder(doc_id, 3) == 1


def learnable(labels: DataFrame) -> DataFrame:
    """(labelled_id, label) of the rows that may be learned from; of several labels of an id the larger counts."""
    own = labels.select(F.col("doc_id").alias("labelled_id"), F.col("toxic").cast("int").alias("label"))
    own = own.filter("labelled_id is not null and label in (0, 1)").filter(~held_out("labelled_id"))
    return own.groupBy("labelled_id").agg(F.max("label").alias("label"))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences; a third of the ids is held out and never learned from."""
    weights, odds = fit(docs, learnable(labels))
    found = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), weights, odds, ["doc_id"], locate=True)
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return found.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"), "sentences")
