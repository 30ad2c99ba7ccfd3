"""Dense retrieval: the nearest vectors of each query by cosine similarity, in expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators import quality

#: Queries of a block, parts that vectors are dealt to, and numbers in queries that are broadcast at most.
BLOCK, PARTS, BROADCAST = 4096, 64, 4_000_000
#: Components that are columns of their own, so that products are compiled; those of longer vectors stay arrays.
WIDE = 512
#: One vector in so many is met first, for a score that each query's answers cannot be below.
FIRST = 64


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v, norm, size): vectors, their lengths and how many components they have. Null ids and vectors, vectors with components that are null or no number, and zero vectors have no direction."""
    rows = df.select(key, F.col(vector).cast("array<double>").alias("v")).filter(F.col(key).isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).filter("norm > 0")
    return rows.select(key, "v", "norm", F.size("v").alias("size"))


def balanced(terms: list[Column]) -> Column:
    """The sum of terms as a tree of fours: flat code, which is compiled in small pieces, where one long chain is nested too deep to be inlined."""
    while len(terms) > 1:
        terms = [reduce(Column.__add__, terms[i : i + 4]) for i in range(0, len(terms), 4)]
    return terms[0] if terms else F.lit(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, doc_id, score, rank: the k most similar vectors of each query, to six places, ties by id. A query does not find itself; vectors of other lengths are no candidates.

    Every vector meets every query, whatever files they lie in: work is queries times vectors. One vector in FIRST meets the queries first, and what is then a query's k-th best score is
    one that no answer is below; in the second pass, over all vectors, only scores that reach it go on, so that few are sorted and shuffled. Queries meet vectors in an equi-join by block
    and part: few are broadcast, else both sides are dealt evenly.
    """
    count, longest = usable(queries, key, vector).agg(F.count(F.lit(1)), F.max("size")).first()
    width = min(longest or 0, WIDE)
    found = _met(vectors, queries, k, key, vector, count, width, False)
    return quality.top(found.unionByName(_met(vectors, queries, k, key, vector, count, longest, True)) if (longest or 0) > WIDE else found, k)


def _met(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, count: int, width: int, wide: bool) -> DataFrame:
    """query_id, doc_id, score: the scores that may be among the k best, of vectors of up to WIDE components or of longer ones."""
    few = count * width <= BROADCAST
    blocks, parts = max(1, -(-count // BLOCK)), 1 if few else PARTS
    fits = F.col("size") > WIDE if wide else F.col("size") <= width

    def side(df: DataFrame, name: str, x: str) -> DataFrame:
        components = [F.transform("v", lambda c: c / F.col("norm")).alias(x)] if wide else [F.coalesce(F.get("v", F.lit(i)) / F.col("norm"), F.lit(0.0)).alias(f"{x}{i}") for i in range(width)]
        dealt = usable(df, key, vector).filter(fits).repartition(PARTS, key)  # norms are taken before, so that no component takes them anew
        return dealt.select(F.col(key).alias(name), F.col("size").alias(f"{name}_size"), *components)

    asked = side(queries, "query_id", "a").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    rows = side(vectors, "doc_id", "u").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    score = dot(F.col("a"), F.col("u")) if wide else balanced([F.col(f"a{i}") * F.col(f"u{i}") for i in range(width)])

    def scored(rows: DataFrame, asked: DataFrame, least: Column) -> DataFrame:
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = rows.join(F.broadcast(asked) if few else asked, ["block", "part"])
        return met.filter((F.col("query_id_size") == F.col("doc_id_size")) & (F.col("query_id") != F.col("doc_id")) & (score >= least)).select("query_id", "doc_id", score.alias("score"))

    first = scored(rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("first")), F.lit(FIRST)) == 0), asked, F.lit(-2.0))
    # less what rounding to six places can bring two scores nearer
    least = quality.top(first, k).filter(F.col("rank") == k).select("query_id", (F.col("score") - 2e-6).alias("least"))
    asked = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    return scored(rows, asked, F.col("least")).withColumn("score", F.round("score", 6))
