"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document's set of word shingles is hashed once; each bin keeps its smallest hash, and an empty bin copies that of
a bin drawn by its own sequence of hashes (optimal densification), the same for all documents. Bands of bins
give buckets. Documents of equal sets are one class, and only its smallest id goes on. In each bucket the
member that meets most others is the centre c, and candidates are the edges from the members to it. Links are
confirmed on full sets. A star alone could miss a link between two members x and y of which one is not in the centre's component (loose), so
these are compared once more, bounded exactly. x and y must share at least `percent` of the larger one's shingles; at
most as many as both share with c lie in c. So either they share a shingle outside c, and then one among the first few of
what each has outside c, in an order common to all (the prefix bound); or both lie in c but for a few, and share one of the first few of all
they have. The order is rarest first, by a sketch of counts of fixed size that covers all members; what the sketch
saw once in a group can be shared by none and is left out. So near copies of one text, each with edits of its own, do not meet in
pairs. Components are found by hooking and pointer jumping over tables.

With 40 bands of 6 bins, two sets at a similarity of 0.8 share no bucket with a probability of 5e-6.

Cases: null, empty or wordless text has an empty set and is linked with nothing; fewer words than a shingle make one shingle;
ids are whole numbers of 64 bits, others are an error; null ids take no part in links and are their own component (null); repeated rows (equal ids) are one document for the
links and come back each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import FOLDED, MIX, SPACES, Bytes, chunks, flags, forget, keys_of_spans, mixed, stage_table

BANDS, BINS_OF_BAND = 40, 6
BINS = BANDS * BINS_OF_BAND
PARTING = flags(SPACES)
#: Ids of documents that have a candidate are broadcast up to this number (8 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000
#: Cells of the sketch that counts how often a shingle occurs in a star's group.
CELLS = 1 << 22


def probes() -> np.ndarray:
    """For each bin the bins that it tries when it is empty, in order."""
    numbers = np.arange(BINS * 4096, dtype=np.uint64).reshape(BINS, 4096)
    return (mixed(numbers * MIX + np.uint64(1)) % np.uint64(BINS)).astype(np.int16)


PROBES = probes()


def shingle_sets(part: Bytes, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    begins, ends, counts = part.words(PARTING)
    words = keys_of_spans(part.data, begins, ends, FOLDED)
    at = 0
    for n in counts.tolist():
        own, width = words[at : at + n], min(size, n)
        at += n
        total = np.full(max(0, n - width + 1) if width else 0, np.uint64(width))
        for k in range(width):
            total = mixed(total * MIX + own[k : n - width + 1 + k])
        yield np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin; the sorted hashes' upper bits tell the bin."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = shingles[first], True
    empty, low, width = np.flatnonzero(~full), 0, 64
    while len(empty):
        tries = PROBES[empty, low : low + width]
        if not tries.shape[1]:  # none of its probes met a full bin
            out[empty] = shingles[0]
            break
        hit = full[tries]
        found = hit.any(axis=1)
        out[empty[found]] = out[tries[found, hit[found].argmax(axis=1)]]
        empty, low, width = empty[~found], low + width, 512
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, BINS_OF_BAND)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BINS_OF_BAND):
        total = mixed(total * MIX + rows[:, k])
    return total.view(np.int64)


def sign(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, key, bands): the set's size, a 128-bit key of the set, and its bucket keys; no bands without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget()
        for batch in (part for whole in batches for part in chunks(whole)):
            n, keys, bands = [], [], []
            for shingles in shingle_sets(Bytes.of(batch.column("text")), size):
                n.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                bands.append(bands_of(signature(shingles)) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, key binary, bands array<bigint>")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles): the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (part for whole in batches for part in chunks(whole)):
            own = [s.tobytes() for s in shingle_sets(Bytes.of(batch.column("text")), size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, shingles binary")


def joined_sets(edges: DataFrame, shingles: DataFrame) -> DataFrame:
    """edges (a, b, ...) with set_a and set_b."""
    near = shingles.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    far = shingles.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    return edges.join(near, "a").join(far, "b")


def overlap(edges: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, common, linked): set sizes, their intersection, and whether 100 * intersection >= percent * union."""
    names = ["a", "b", "n_a", "n_b", "common", "linked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                rows.append((len(x), len(y), common, 100 * common >= percent * (len(x) + len(y) - common)))
            columns = [pa.array([r[i] for r in rows], pa.bool_() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], names=names)

    sets_of = joined_sets(edges.select("a", "b"), shingles).select("a", "b", "set_a", "set_b")
    return sets_of.mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint, common bigint, linked boolean")


def material(members: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a, b, inside, n, keep, shingles): what decides whether a meets others of the group of b, and of how many of them, in the common order, one is shared.

    members: a, b, common, n_a, need (the fewest shingles that a shares with what it is linked with), and within: whether it may be linked with
    one that shares enough with it inside b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                owner, inside, sizes, keep, own = [], [], [], [], []
                columns = (batch.column(c).to_pylist() for c in ("common", "n_a", "need", "within"))
                for i, (common, n, need, within) in enumerate(zip(*columns, strict=True)):
                    x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
                    found = [(False, n - common - max(1, need - common) + 1, np.setdiff1d(x, y, assume_unique=True))]
                    found += [(True, n - need + 1, x)] if within else []
                    for kind, most, values in found:
                        if most > 0 and len(values):
                            owner.append(i)
                            inside.append(kind)
                            sizes.append(n)
                            keep.append(most)
                            own.append(values.tobytes())
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(inside, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(keep, pa.int64()), pa.array(own, pa.binary())], names=["a", "b", "inside", "n", "keep", "shingles"])

    return joined_sets(members, shingles).mapInArrow(run, "a bigint, b bigint, inside boolean, n bigint, keep bigint, shingles binary")


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * 50).cast("int")


def cells(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row of material its shingles and their cells of the sketch."""
    for b, inside, own in zip(batch.column("b").to_pylist(), batch.column("inside").to_pylist(), batch.column("shingles"), strict=True):
        values = np.frombuffer(own.as_buffer(), np.uint64)
        yield values, (mixed(values + np.uint64((2 * b + inside) * int(MIX) % (1 << 64))) % np.uint64(CELLS)).astype(np.int64)


def sketch(rows: DataFrame) -> np.ndarray:
    """How often the shingles of a cell occur in their groups, up to 65535: sums of fixed size, of tasks, then of some tasks, then of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for _, own in cells(batch):
                np.add.at(total, own, 1)
        yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for own in batch.column("cells"):
                total += np.frombuffer(zlib.decompress(own.as_py()), np.uint16)
        yield packed(total)

    def packed(total: np.ndarray) -> pa.RecordBatch:
        data = zlib.compress(np.minimum(total, 65535).astype(np.uint16).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["cells"])

    parts = rows.mapInArrow(count, "cells binary").repartition(32).mapInArrow(add, "cells binary")
    total = np.zeros(CELLS, np.uint32)
    for r in parts.collect():  # 32 rows
        total += np.frombuffer(zlib.decompress(r.cells), np.uint16)
    return np.minimum(total, 65535).astype(np.uint16)


def first_few(rows: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(a, b, inside, shingles, limits): of each row of material the first `keep` in the common order, without those that no other member of the group has.

    A limit is the size of the largest set that must have a shingle of the first ones up to this: a set of m must share at least percent of the union,
    so it meets a set of n among the first n + 1 - (n + m) * percent / (100 + percent).
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                out, limits = [], []
                for n, keep, (values, own) in zip(batch.column("n").to_pylist(), batch.column("keep").to_pylist(), cells(batch), strict=True):
                    seen = shared.value[own]
                    order = np.lexsort((values, seen))[:keep]
                    shared_too = np.flatnonzero(seen[order] > 1)
                    out.append(values[order][shared_too].view(np.int64))
                    limits.append((n - shared_too) * (100 + percent) // percent - n)
                ends = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int64())) for x in (out, limits)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "inside")] + lists, names=["a", "b", "inside", "shingles", "limits"])

    return rows.mapInArrow(run, "a bigint, b bigint, inside boolean, shingles array<bigint>, limits array<bigint>")


def components(links: DataFrame, nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, component): the smallest id reachable from each node over the links (a, b). known: components so far."""
    labels = nodes.select("doc_id", F.col("doc_id").alias("component")) if known is None else known
    arcs = stage_table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "arcs")
    while True:
        # every component hooks to the smallest one that a link leads to, then follows the hooks to their end
        a, b = labels.select(F.col("doc_id").alias("a"), F.col("component").alias("from")), labels.select(F.col("doc_id").alias("b"), F.col("component").alias("to"))
        hooks = arcs.join(a, "a").join(b, "b").filter("to < from").groupBy("from").agg(F.min("to").alias("to"))
        hooks = stage_table(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        while True:
            after = hooks.select(F.col("from").alias("to"), F.col("to").alias("beyond"))
            jumped = stage_table(hooks.join(after, "to", "left").select("from", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("from", "to")
            if jumped.filter("moved").isEmpty():
                break
        step = labels.join(hooks.withColumnRenamed("from", "component"), "component", "left")
        labels = stage_table(step.select("doc_id", F.coalesce("to", "component").alias("component")), "labels")


def classes(signed: DataFrame) -> DataFrame:
    """(key, class, n): documents of equal sets, named by the smallest id."""
    return signed.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("class"), F.first("n").alias("n"))


def link(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text); kept is one document of each component."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = stage_table(sign(docs, size), "signed")
    groups = stage_table(classes(signed), "classes")

    # One row for each class and band; the class's set size bounds what it can link with.
    members = signed.select("doc_id", "n", "bands").join(groups.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    members = members.select("doc_id", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = members.join(full, "bucket")
    degree = buckets.groupBy("doc_id").agg(F.sum(F.col("members") - 1).alias("degree"))
    buckets = stage_table(buckets.select("bucket", "doc_id", "n").join(degree, "doc_id"), "buckets")

    involved = stage_table(buckets.select("doc_id").distinct(), "involved")
    labels = involved.select("doc_id", F.col("doc_id").alias("component"))
    if not involved.isEmpty():
        few = involved.count() <= MAX_BROADCAST_IDS
        texts = docs.join(F.broadcast(involved) if few else involved, "doc_id", "left_semi")
        shingles = sets(texts, size)
        if not signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
            shingles = shingles.dropDuplicates(["doc_id"])
        shingles = stage_table(shingles, "sets")
        labels = settle(buckets, shingles, labels, percent)

    named = groups.join(labels.withColumnRenamed("doc_id", "class"), "class", "left").select("key", F.coalesce("component", "class").alias("found"))
    out = signed.select("doc_id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("found", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def settle(buckets: DataFrame, shingles: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """labels (doc_id, component) after all links within buckets."""
    # The centre: the member of highest degree, limited within each task before the shuffle.
    placed = buckets.withColumn("rank", F.expr("row_number() over (partition by bucket order by degree desc, doc_id)"))
    centres = placed.filter("rank = 1").select("bucket", F.col("doc_id").alias("b"))
    stars = buckets.join(centres, "bucket").filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    stars = stage_table(overlap(stars, shingles, percent), "stars")
    labels = components(stars.filter("linked"), labels)

    # Groups whose members, but for the centre, are of several components.
    of = lambda side: labels.select(F.col("doc_id").alias(side), F.col("component").alias(f"of_{side}"))
    members = stage_table(stars.join(of("a"), "a").join(of("b"), "b"), "members")
    members = members.withColumn("loose", F.col("of_a") != F.col("of_b"))
    groups = members.groupBy("b").agg(F.min("of_a").alias("low"), F.max("of_a").alias("high")).filter("low <> high").select("b")
    # n_a and n_y share enough inside b only if n_y <= most(a) and n_a <= most(y); sizes meet in classes of two percent
    members = members.join(groups, "b").withColumn("need", F.expr(f"(n_a * {percent} + 99) div 100")).withColumn("most", F.expr(f"least(common * {100 + percent} div {percent} - n_a, n_a * 100 div {percent})"))
    members = stage_table(members.select("a", "b", "of_a", "n_a", "common", "need", "loose", "most", size_class(F.col("n_a")).alias("class")), "members")
    if members.isEmpty():
        return labels
    held = members.filter("most >= need")
    wanted = held.filter("loose").select("a", "b", F.explode(F.sequence(size_class(F.col("need")), size_class(F.col("most")))).alias("class"))
    wanted = stage_table(wanted.join(held.select("b", "class").distinct(), ["b", "class"], "left_semi"), "wanted")
    within = wanted.select("a", "b").union(held.join(wanted.select("b", "class").distinct(), ["b", "class"], "left_semi").select("a", "b")).distinct()
    asked = members.join(within.withColumn("within", F.lit(True)), ["a", "b"], "left").withColumn("within", F.coalesce("within", F.lit(False)))
    rows = stage_table(material(asked.select("a", "b", "common", "n_a", "need", "within"), shingles), "material")
    few = first_few(rows, sketch(rows), percent).select("a", "b", "inside", F.explode(F.arrays_zip("shingles", "limits")).alias("s")).select("a", "b", "inside", F.col("s.shingles").alias("shingle"), F.col("s.limits").alias("limit"))
    few = stage_table(few.join(members.select("a", "b", "of_a", "n_a", "loose", "most", "class"), ["a", "b"]), "few")
    other = few.select("b", "inside", "shingle", "class", F.col("a").alias("y"), F.col("of_a").alias("of_y"), F.col("n_a").alias("n_y"), F.col("most").alias("most_y"), F.col("limit").alias("limit_y"))
    sized = f"100 * least(n_a, n_y) >= {percent} * greatest(n_a, n_y) and of_a <> of_y and n_y <= limit and n_a <= limit_y"
    beyond = few.filter("loose and not inside").join(other.filter("not inside").drop("class"), ["b", "shingle"]).filter(sized)
    inner = few.filter("loose and inside").drop("class").join(wanted, ["a", "b"]).join(other.filter("inside"), ["b", "class", "shingle"]).filter(f"{sized} and n_y <= most and n_a <= most_y")
    pairs = beyond.select("a", "y").union(inner.select("a", "y"))
    pairs = stage_table(pairs.select(F.least("a", "y").alias("a"), F.greatest("a", "y").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return labels
    links = stage_table(overlap(pairs, shingles, percent).filter("linked"), "links")
    return components(links, labels, labels)


def deduplicate(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, without those that are not their component's kept document; of rows with equal ids one stays, rows with a null id all stay."""
    linked = link(docs, size=size, percent=percent).select("doc_id", "kept")
    gone = stage_table(linked.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    few = gone.count() <= MAX_BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    if docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        return left
    return left.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.filter("doc_id is null"))
