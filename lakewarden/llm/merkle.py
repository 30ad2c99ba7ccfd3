"""Merkle manifest of a dataset: a tree for each group, a tree over the groups' roots, and for each row the proof that leads to the root.

Rows are numbered within their group by one sort: a range shuffle by group and order, the place within each partition, and the number of the group's
rows in the partitions before. So no group is ever one task. At each level nodes meet their siblings in equi-joins on computed indices: in a
binary tree the sibling's index is the own one XOR 1, else the own slot plus 1, 2, ... modulo the arity within the run. The rows of slot zero emit the parents,
so that each level is a fraction of the one below. Proofs come down again: a node's path is its own siblings and then its parent's path, by one equi-join
a level. Levels are written, which cuts the lineage; only their number goes through the driver.

Cases: null columns have a mark of their own in a leaf, and a null group is a group; rows equal in the order are ordered by their leaves, so that equal rows may stand for
each other; a null id is tampered with by no test; a group of one row is its own root, and then its part of the proof is empty; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<before:string,after:string>"


def leaf_hash(*columns: Column) -> Column:
    """Hash of a row: each value with its length, so that no two rows are written alike; null is a mark without one."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with index (from 0, by order within the group) and n (rows of the group). Written once, as numbers hang on how rows were dealt."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # rows equal in all are dealt apart too
    ranged = rows.repartitionByRange(group, *order, "_row").sortWithinPartitions(group, *order, "_row").drop("_row")
    at = F.monotonically_increasing_id()
    placed = stage_table(ranged.withColumns({"part": F.shiftright(at, 33).cast("int"), "place": at.bitwiseAND((1 << 33) - 1)}), "places")
    # a row for each partition and group: written, so that its size is known when it is joined
    parts = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("held"), F.min("place").alias("first"))
    before = F.sum("held").over(Window.partitionBy(group).orderBy("part")) - F.col("held")  # a row for each partition, not for each row
    offsets = parts.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("held").over(Window.partitionBy(group)).alias("n"))
    return placed.join(stage_table(offsets, "offsets"), [group, "part"]).withColumn("index", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def sibling_slots(arity: int) -> Column:
    """The slots of a node's siblings, around its run: in a binary tree its own XOR 1, else its own and an offset."""
    if arity == 2:
        return F.array(F.col("slot").bitwiseXOR(F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda k: F.pmod(F.col("slot") + k, F.lit(arity)))


def with_siblings(nodes: DataFrame, arity: int, only_first: bool = False) -> DataFrame:
    """nodes (tree, index, n, hash, ...) with run, slot, before and after: the hashes of the siblings on either side, joined. only_first: those of slot zero.

    Nodes are dealt by run once. The join finds them there, and so does the aggregate behind it: the slots' equality is a condition beside the keys (tree, run), as one more
    key would deal both sides anew. A run has no more rows than the arity.
    """
    index = F.col("index")
    dealt = nodes.withColumns({"run": F.floor(index / arity).cast("bigint"), "slot": (index % arity).cast("int")}).repartition("tree", "run")
    rows = dealt.filter("slot = 0") if only_first else dealt
    asked = rows.withColumn("wanted", F.explode(sibling_slots(arity)))
    other = dealt.select(F.col("tree").alias("_tree"), F.col("run").alias("_run"), F.col("slot").alias("_slot"), F.col("hash").alias("_hash"))
    met = asked.join(other, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run")) & (F.col("wanted") - F.col("_slot") == 0), "left")
    kept = [c for c in nodes.columns if c not in ("tree", "index")]
    found = F.when(F.col("_slot").isNotNull(), F.struct("_slot", "_hash"))
    whole = met.groupBy("tree", "run", "index", "slot").agg(F.first(F.struct(*kept)).alias("own"), F.array_sort(F.collect_list(found)).alias("near"))  # fewer than the arity
    side = lambda test: F.array_join(F.transform(F.filter("near", test), lambda s: s["_hash"]), "")
    around = {"before": side(lambda s: s["_slot"] < F.col("slot")), "after": side(lambda s: s["_slot"] > F.col("slot"))}
    return whole.withColumns(around).select("tree", "index", "own.*", "run", "slot", "before", "after")


def grow(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels above the leaves, each (tree, index, n, hash, run, slot, before, after), and tops (tree, level, subroot)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    top = lambda df, level: df.filter("n = 1").select("tree", F.lit(level).alias("level"), F.col("hash").alias("subroot"))
    levels, tops = [], [top(leaves, 0)]
    below = with_siblings(leaves.filter("n > 1").select("tree", "index", "n", "hash"), arity, only_first=True)
    while most > 1:
        most = -(-most // arity)
        parents = below.select("tree", F.col("run").alias("index"), F.ceil(F.col("n") / arity).cast("bigint").alias("n"), F.sha2(F.concat("hash", "after"), 256).alias("hash"))
        level = stage_table(with_siblings(parents, arity), "level")
        levels.append(level)
        tops.append(top(level, len(levels)))
        below = level.filter("slot = 0 and n > 1")
    return levels, reduce(DataFrame.unionByName, tops)


def paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """leaves with path, from the leaf up, and what else tops (tree, level, path, ...) have for the whole tree."""
    whole = [c for c in tops.columns if c not in ("level", "path")]
    step = F.array(F.struct("before", "after"))
    ended = lambda level: tops.filter(F.col("level") == level).select(*whole, F.lit(0).cast("bigint").alias("run"), "path")
    above = ended(len(levels))
    for number, level in reversed(list(enumerate(levels, 1))):
        if number < len(levels):
            known = level.filter("n > 1").select("tree", F.col("index"), "run", "before", "after").join(above, ["tree", "run"])
            above = known.select(*whole, F.col("index").alias("run"), F.concat(step, "path").alias("path")).unionByName(ended(number))
    rows = with_siblings(leaves, arity).join(above.unionByName(ended(0)) if levels else above, ["tree", "run"])
    return rows.withColumn("path", F.when(F.col("n") > 1, F.concat(step, "path")).otherwise(F.col("path"))).drop("run", "slot", "before", "after")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings of a path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def prove(leaves: DataFrame, arity: int = 8) -> DataFrame:
    """leaves (tree, index, n, hash, ...) with path, subroot and root: trees are ordered by name, and their roots are the leaves of one more tree."""
    levels, tops = grow(leaves, arity)
    roots = numbered(tops.select("tree", "level", "subroot", F.lit("").alias("all")), "all", "tree")
    upper = roots.select(F.col("all").alias("tree"), "index", "n", F.col("subroot").alias("hash"), F.col("tree").alias("name"), "level")
    upper_levels, upper_tops = grow(upper, arity)
    last = upper_tops.select("tree", "level", F.col("subroot").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    known = paths(upper, upper_levels, last, arity).select(F.col("name").alias("tree"), "level", F.col("hash").alias("subroot"), "root", "path")
    return paths(leaves, levels, stage_table(known, "roots"), arity)


def manifest(docs: DataFrame, arity: int = 8) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each document; a tree for each lang, rows by doc_id.

    Every third document, by crc32 of its id, is read as if its text had been lower-cased since: its proof leads to the root only if that changed nothing.
    """
    facts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"), leaf_hash(*facts, F.col("text")).alias("hash"),
        F.when(tampered, leaf_hash(*facts, F.translate("text", UPPER, LOWER))).alias("found"),
    )
    # hashed once: a range shuffle looks at its rows twice
    rows = prove(numbered(stage_table(rows, "leaves"), "tree", "doc_id", "hash"), arity)
    folded = rows.withColumn("folded_root", fold(F.coalesce("found", "hash"), F.col("path")))
    return folded.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
