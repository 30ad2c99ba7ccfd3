"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, of the whole vocabulary and for words of any length, computed by the forward algorithm in logarithms;
that of a text is the product over its words, as no piece reaches over a space. Piece probabilities are fitted by expectation
maximisation with the forward-backward algorithm.

A model is a list of blocks of languages, so that no step holds the numbers of more than LANGUAGES_OF_BLOCK languages
at once; the driver holds pieces times languages 32-bit numbers.

Cases: null or letterless text gives 'und' with score 0; a null id is held out; null languages are not learned; without any
labelled text every prediction is 'und'; repeated rows are predicted each; ties go to the language that sorts first; other columns are
ignored, and columns to keep that have the name of a result are left out.
"""

from __future__ import annotations

import uuid
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import CACHE_WORDS, SPACES, Bytes, WordCodes, blocks, chunks, flags, id_remainder, remember, segment_sums, stage_table
from lakewarden.llm.lattice import PieceIndex, ending_at, ordinary_ids, read_pieces

UNKNOWN = "und"
#: Probability of a character that is no piece, in every language.
RARE = 1e-7
LANGUAGES_OF_BLOCK = 64
LETTERS = flags(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: What a model knows of the languages of one block: their names, piece probabilities (pieces by languages) and log shares of all texts.
Block = tuple[list[str], np.ndarray, np.ndarray]


def split_words(text: str) -> list[str]:
    return ["▁" + w.decode("utf-8", "replace").lower() for w in text.encode("utf-8", "replace").split()]


class Pieces:
    """The vocabulary's pieces and their index."""

    def __init__(self, path: str) -> None:
        every = read_pieces(path)
        self.pieces = [every[i] for i in ordinary_ids(path)]
        self.index = PieceIndex(self.pieces)
        self.size = self.index.size


def pieces(path: str) -> Pieces:
    return remember(f"pieces {path}", lambda: Pieces(path))


def extend(model: np.ndarray) -> np.ndarray:
    """Pieces by languages, with a row for an unknown character."""
    return np.vstack([model, np.full((1, model.shape[1]), RARE, model.dtype)])


def log_words(vocabulary: Pieces, model: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language of an extended model: the forward pass over a ring of the last columns."""
    out = np.zeros((len(words), model.shape[1]))
    for places, block in blocks(words, max(1, (1 << 20) // (4 + model.shape[1]))):
        edges = vocabulary.index.edges(block)
        lengths = np.fromiter(map(len, block), np.int64, len(block))  # descending
        last: deque = deque([np.zeros((len(block), model.shape[1]))], maxlen=len(edges))  # columns j, j - 1, ...
        for j in range(int(lengths[0])):
            (_, _, piece), *longer = ending_at(edges, j)
            total = model[piece].astype(np.float64)  # of the words of more than j characters, which stand first
            for k, rows, piece in longer:
                total[rows] += model[piece] * np.exp(last[k - 1][rows] - last[0][rows])
            now = last[0][: len(total)] + np.log(total)
            done = np.flatnonzero(lengths == j + 1)
            out[places[done]] = now[done]
            last.appendleft(now)
    return out


class WordScores(WordCodes):
    """Log-probability of words in every language of a block."""

    def __init__(self, vocabulary: Pieces, model: np.ndarray) -> None:
        self.vocabulary, self.model = vocabulary, extend(model)
        super().__init__(min(CACHE_WORDS, max(1, CACHE_WORDS * 8 // model.shape[1])))

    def forget(self) -> None:
        self.scores = np.zeros((0, self.model.shape[1]), np.float32)

    def learn(self, words: list[str]) -> None:
        self.scores = np.concatenate([self.scores, log_words(self.vocabulary, self.model, ["▁" + w.lower() for w in words]).astype(np.float32)])


def expect(vocabulary: Pieces, model: np.ndarray, words: list[str], language: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of times that each piece is used, by language, over all segmentations of the words."""
    model = extend(model)
    total = np.zeros(model.size)
    for places, block in blocks(words, 1 << 16):
        edges = vocabulary.index.edges(block)
        own, n = language[places], len(block)
        lengths = np.fromiter(map(len, block), np.int64, n)
        columns = [[(k, rows, piece, model[piece, own[rows]]) for k, rows, piece in ending_at(edges, j)] for j in range(int(lengths[0]))]
        forward, backward = np.zeros((len(columns) + 1, n)), np.zeros((len(columns) + 1, n))
        for j, column in enumerate(columns, 1):
            sums = np.zeros(n)
            for k, rows, _, p in column:
                sums[rows] += p * np.exp(forward[j - k, rows] - forward[j - 1, rows])
            forward[j] = forward[j - 1] + np.log(np.where(sums > 0, sums, 1.0))
        # backward sums go to the columns where edges begin; they are kept relative to the column after, times the edge of one character
        starting: list[list] = [[] for _ in columns]
        for j, column in enumerate(columns, 1):
            for k, rows, _, p in column:
                starting[j - k].append((j, rows, p))
        for j in range(len(columns) - 1, -1, -1):
            sums = np.zeros(n)
            for end, rows, p in starting[j]:
                sums[rows] += p * np.exp(backward[end, rows] - backward[j + 1, rows])
            backward[j] = np.where(j < lengths, backward[j + 1] + np.log(np.where(sums > 0, sums, 1.0)), 0.0)
        end = forward[lengths, np.arange(n)]
        spots, masses = [], []
        for j, column in enumerate(columns, 1):
            for k, rows, piece, p in column:
                masses.append(weight[places[rows]] * p * np.exp(forward[j - k, rows] + backward[j, rows] - end[rows]))
                spots.append(piece.astype(np.int64) * model.shape[1] + own[rows])
        total += np.bincount(np.concatenate(spots), np.concatenate(masses), model.size)
    return total.reshape(model.shape)[: vocabulary.size]


def fit(docs: DataFrame, vocabulary: str, *, rounds: int = 4, max_docs: int = 1500) -> list[Block]:
    """The model: blocks of languages in the order of their names.

    docs: text, lang; rows without either are passed over. The classifier is fitted on about max_docs texts of
    each language, those with the smallest hash of the text; shares count all rows.
    """
    docs = docs.filter("text is not null and lang is not null")
    counts = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    return [_fit(docs, vocabulary, names[low : low + LANGUAGES_OF_BLOCK], counts, rounds, max_docs) for low in range(0, len(names), LANGUAGES_OF_BLOCK)]


def _fit(docs: DataFrame, vocabulary: str, names: list[str], counts: dict[str, int], rounds: int, max_docs: int) -> Block:
    number = {n: i for i, n in enumerate(names)}
    rate = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, max_docs / counts[n]))])
    chosen = docs.filter(F.col("lang").isin(names)).filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                found: Counter = Counter()
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    for word in split_words(text):
                        found[number[lang], word] += 1
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["language", "word", "n"])

    words = chosen.select("text", "lang").mapInArrow(count, "language int, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))
    words = stage_table(words, "words")
    size = Pieces(vocabulary).size
    model = np.full((size, len(names)), 1 / size)
    for _ in range(rounds):

        def expected(batches: Iterator[pa.RecordBatch], now: np.ndarray = model.astype(np.float32)) -> Iterator[pa.RecordBatch]:
            own, total = pieces(vocabulary), np.zeros(now.shape)
            for batch in batches:
                if batch.num_rows:
                    total += expect(own, now.astype(np.float64), batch.column("word").to_pylist(), batch.column("language").to_numpy(), batch.column("n").to_numpy())
            piece, language = np.nonzero(total > 1e-3)
            yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, language])], names=["language", "piece", "n"])

        sums = words.mapInArrow(expected, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()
        fresh = np.full_like(model, 0.05)
        fresh[sums["piece"].to_numpy(), sums["language"].to_numpy()] += sums["n"].to_numpy()
        model = fresh / fresh.sum(axis=0)
    return names, model.astype(np.float32), np.log(np.array([counts[n] for n in names]) / sum(counts.values()))


def known(part: Bytes) -> np.ndarray:
    """Whether each text has a letter."""
    out = np.diff(np.searchsorted(np.flatnonzero(LETTERS[part.data]), part.offsets)) > 0
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(map(str.isalpha, part.text(i)))
    return out


def predict(docs: DataFrame, vocabulary: str, model: list[Block], keep: list[str]) -> DataFrame:
    """The columns of keep, lang_pred and score (its posterior probability) for every row of docs, from text alone."""
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    spaces = flags(SPACES)
    text = "text" if "text" in keep else "__text"
    given = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").cast("string").alias(text))
    out = given.select("*", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("__best"), F.lit(None).cast("double").alias("__all"))
    columns = given.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for names, probabilities, shares in model:
        shared, key = docs.sparkSession.sparkContext.broadcast(probabilities), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], names: list[str] = names, shares: np.ndarray = shares, shared=shared, key: str = key) -> Iterator[pa.RecordBatch]:
            """Adds a block of languages: the best so far, its log-probability, and that of all languages so far."""
            scores = remember(key, lambda: WordScores(Pieces(vocabulary), shared.value))
            for whole in batches:
                for batch in chunks(whole, text):
                    part = Bytes.of(batch.column(text))
                    begins, ends, counts = part.words(spaces)
                    codes = scores.of(part.data, begins, ends)
                    total = segment_sums(scores.scores[codes], counts) + shares
                    best = total.max(axis=1)
                    every = best + np.log(np.exp(total - best[:, None]).sum(axis=1))
                    found = np.where(known(part), np.array(names, object)[total.argmax(axis=1)], None)
                    before, sum_before = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("__best", "__all"))
                    first = np.isnan(before)
                    old = np.array(batch.column("lang_pred").to_pylist(), object)
                    found = np.where(first | (best > before), found, old)
                    best, every = np.where(first, best, np.fmax(best, before)), np.where(first, every, np.logaddexp(every, np.where(first, 0, sum_before)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.string()), pa.array(best), pa.array(every)], names=batch.schema.names)

        out = out.mapInArrow(run, kinds)
    sure = F.col("lang_pred").isNotNull()
    return out.select(*keep, F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.when(sure, F.least(F.lit(1.0), F.exp(F.col("__best") - F.col("__all")))).otherwise(0.0).alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    return id_remainder(doc_id, 5) == 0


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; held-out rows (a fifth, by id) are never learned from."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = predict(docs.select("doc_id", "text"), vocabulary, fit(docs.filter(~held_out()), vocabulary), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
