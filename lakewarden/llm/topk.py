"""Exact top-k inner products by columnar branch-and-bound.

Vectors are kept in vertical blocks: one row holds a block of vectors, dimension by dimension. A query adds up its inner
products with a block some dimensions at a time; the norms of the dimensions still to come bound what a vector can
still gain (Cauchy-Schwarz), and vectors whose bound is below the k-th best known score are dropped and the
survivors compacted. Queries go in blocks too; each block of queries meets each block of vectors once.

Cases: null vectors and those with a null or non-finite component take no part; only vectors of equal length are
compared; rows with an equal id and vector are one vector, so that it takes one rank; rows with the query's id are not its candidates; null
ids take no part; ties go to the smaller id; scores beyond 64 bits are refused; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VECTORS_OF_BLOCK = 4096
QUERIES_OF_BLOCK = 1024
DIMENSIONS_OF_STEP = 8
#: Sums below this are exact in 64-bit floats.
EXACT = float(1 << 53)


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vector): whole numbers, of the rows that take part."""
    good = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))"
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(good)
    return vectors.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("vector")).distinct()


def pack_blocks(rows: DataFrame, count: int) -> DataFrame:
    """(block, length, ids, columns): blocks of about equal numbers of vectors of one length, in vertical layout."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        matrix = np.array(pdf["vector"].tolist(), np.float64).reshape(len(pdf), pdf["length"].iloc[0])
        out = {"block": pdf["block"].iloc[0], "length": pdf["length"].iloc[0], "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "columns": np.ascontiguousarray(matrix.T).tobytes()}
        return pd.DataFrame([out])

    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(count)).cast("int")).withColumn("length", F.size("vector"))
    return placed.groupBy("block", "length").applyInPandas(run, "block int, length int, ids binary, columns binary")


def best(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best vectors of a block; ids ascend.

    queries: a row for each; columns: a row for each dimension.
    """
    order = np.argsort(-(columns * columns).sum(axis=1), kind="stable")  # heavy dimensions first: bounds shrink sooner
    columns, queries = columns[order], queries[:, order]
    steps = list(range(0, len(columns), DIMENSIONS_OF_STEP))
    rest = [np.sqrt((columns[low:] ** 2).sum(axis=0)) for low in steps[1:]]
    rest_q = [np.sqrt((queries[:, low:] ** 2).sum(axis=1)) for low in steps[1:]]
    first = queries[:, : DIMENSIONS_OF_STEP] @ columns[:DIMENSIONS_OF_STEP] if steps else np.zeros((len(queries), len(ids)))
    out = []
    for q in range(len(queries)):
        alive, total = np.flatnonzero(ids != query_ids[q]), first[q]
        total = total[alive]
        for s in range(1, len(steps)):
            slack = rest_q[s - 1][q] * rest[s - 1][alive] * (1 + 1e-9) + 1e-6
            if len(alive) > k:
                # the k-th largest of what is sure already
                sure = total - slack
                floor = np.partition(sure, len(sure) - k)[len(sure) - k]
                if s == 1:  # a few promising ones, in full, give a better floor
                    tops = alive[np.argpartition(total + slack, len(total) - k)[-k:]]
                    floor = max(floor, float((queries[q] @ columns[:, tops]).min()))
                keep = total + slack >= floor
                alive, total = alive[keep], total[keep]
            low = steps[s]
            total = total + queries[q, low : low + DIMENSIONS_OF_STEP] @ columns[low : low + DIMENSIONS_OF_STEP, alive]
        chosen = np.lexsort((ids[alive], -total))[:k]
        out += [(int(query_ids[q]), int(ids[alive[i]]), int(total[i])) for i in chosen]
    return out


def exact_best(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """As best, with whole numbers of any size, for components whose products floats cannot add up."""
    whole = np.array([[int(x) for x in row] for row in columns], object)
    out = []
    for own, name in zip(queries, query_ids, strict=True):
        scores = sum((int(x) * row for x, row in zip(own, whole, strict=True)), np.zeros(len(ids), object))
        if any(abs(s) >= 1 << 63 for s in scores):
            raise OverflowError("a score does not fit 64 bits")
        chosen = sorted((-s, int(i)) for s, i in zip(scores, ids, strict=True) if i != name)[:k]
        out += [(int(name), i, -s) for s, i in chosen]
    return out


def search(vectors: DataFrame, *, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by every. vectors: vec_id, embedding."""
    rows = usable(vectors, scale)
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    vector_blocks, query_blocks = -(-max(1, total) // VECTORS_OF_BLOCK), -(-max(1, asked) // QUERIES_OF_BLOCK)
    blocks = pack_blocks(rows, vector_blocks)
    wanted = pack_blocks(rows.filter(F.col("vec_id") % every == 0), query_blocks)
    # each block of vectors is sent to each block of queries
    blocks = blocks.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    wanted = wanted.select(F.col("block").alias("query_block"), "length", F.col("ids").alias("query_ids"), F.col("columns").alias("query_columns"))
    pairs = blocks.join(wanted, ["query_block", "length"]).select("length", "ids", "columns", "query_ids", "query_columns")
    pairs = pairs.repartition(max(1, min(vector_blocks * query_blocks, 4096)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                length, *data = (batch.column(c)[i].as_py() for c in range(5))
                ids, query_ids = np.frombuffer(data[0], np.int64), np.frombuffer(data[2], np.int64)
                columns, queries = np.frombuffer(data[1]).reshape(length, len(ids)), np.frombuffer(data[3]).reshape(length, len(query_ids)).T
                largest = float(np.abs(columns).max(initial=0) * np.abs(queries).max(initial=0) * max(1, length))
                found = (best if largest < EXACT else exact_best)(queries, query_ids, columns, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
