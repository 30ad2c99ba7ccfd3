"""Quotation linking: reply-ordered conversations without quotes.

Each line's quote level is its number of leading '>' marks. Runs of lines of one level are passages; a quoted passage is
normalised (lower case, single spaces) and hashed, and so are its paragraphs and lines, for passages that quote a message in part or are
answered between their lines. Each is joined to the messages of which a whole text, a run of own lines, a paragraph or a line has the same hash: the latest
earlier one of its conversation or else the first of all. A passage is linked as a whole if it can be, else by its first paragraph that can be, else by its
first such line. A message replies to the original of its first level-1 passage. Threads follow from replies, by pointer jumping, and are ordered by depth and turn.

Cases: null text is the empty one; empty passages link to nothing; a message cannot quote itself or a later one of its conversation;
null ids or turns are kept as rows without a reply; repeated (conv_id, turn) count once for links and threads and come back
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import chunks, stage_table

MARKS = re.compile(r" ?((?:> ?)*)")
GAP, SPACE = re.compile(r"\n[ \t]*\n"), re.compile(r"[ \t\n\x0b\f\r]+")
Part = tuple[int, int, bytes]
HASH = pa.struct([("rank", pa.int32()), ("at", pa.int32()), ("hash", pa.binary())])
PASSAGE = pa.struct([("place", pa.int32()), ("level", pa.int32()), ("hashes", pa.list_(HASH))])


class Digests:
    """The first 16 bytes of the SHA-256 of normalised texts, none for one that is empty then. Those of lines are kept, as they come again in quotes."""

    def __init__(self) -> None:
        self.lines: dict[str, bytes | None] = {}

    @staticmethod
    def of(text: str) -> bytes | None:
        plain = SPACE.sub(" ", text.lower()).strip(" ")
        return hashlib.sha256(plain.encode("utf-8", "surrogatepass")).digest()[:16] if plain else None

    def line(self, text: str) -> bytes | None:
        if text not in self.lines:
            self.lines[text] = self.of(text)
        return self.lines[text]

    def parts(self, text: str) -> list[Part]:
        """(rank, place, hash) of a text: the whole (rank 0), and if it has several its paragraphs (rank 1) and lines (rank 2)."""
        lines = text.split("\n")
        if len(lines) == 1:
            found = [(0, 0, self.line(text))]
        else:
            paragraphs = GAP.split(text)
            found = [(0, 0, self.of(text)), *((1, i, self.of(t)) for i, t in enumerate(paragraphs) if len(paragraphs) > 1), *((2, i, self.line(t)) for i, t in enumerate(lines))]
        return [(rank, at, own) for rank, at, own in found if own is not None]


def runs(text: str) -> list[tuple[int, str]]:
    """(level, text) of each longest run of lines of one level, without their marks."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        marks = MARKS.match(line) if line[:1] in (">", " ") else None
        level = marks[1].count(">") if marks else 0
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(line[marks.end() :] if marks and level else line)
    return [(level, "\n".join(lines)) for level, lines in out]


def parsed_message(text: str, digests: Digests) -> tuple[str, list[bytes], list[tuple[int, int, list[Part]]]]:
    """A message's text without quotes, the hashes that others may quote, and its quoted passages (place, level, hashes)."""
    found = runs(text)
    own = "\n".join(t for level, t in found if not level).strip("\n")
    units = dict.fromkeys(h for t in (*(t for level, t in found if not level), own) for _, _, h in digests.parts(t))
    quoted = ((level, t) for level, t in found if level)
    passages = [(place, level, parts) for place, (level, t) in enumerate(quoted) if (parts := digests.parts(t))]
    return own, list(units), passages


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), units: array of hashes that others may quote, and passages: array of (place, level, hashes) of quoted runs of lines."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = Digests()
        rows = [parsed_message(t or "", digests) for t in batch.column("text").to_pylist()]
        passages = [[{"place": p, "level": v, "hashes": [{"rank": r, "at": a, "hash": h} for r, a, h in parts]} for p, v, parts in row[2]] for row in rows]
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary())), pa.array(passages, pa.list_(PASSAGE))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), *columns], names=["conv_id", "turn", "role", "own", "units", "passages"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield step(part)

    given = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    keys = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    return given.mapInArrow(run, f"{keys}, role string, own string, units array<binary>, passages array<struct<place: int, level: int, hashes: array<struct<rank: int, at: int, hash: binary>>>>")


#: Rows of one hash that is quoted everywhere are dealt into so many parts.
SALTS = 8


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, place, level, to_conv, to_turn): the originals of quoted passages; a row for each passage that has one."""
    known = parsed.filter("conv_id is not null and turn is not null")
    quoted = known.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.place", "p.level", F.explode("p.hashes").alias("h"))
    quoted = quoted.select("conv_id", "turn", "place", "level", "h.rank", "h.at", "h.hash")
    originals = known.select(F.explode("units").alias("hash"), "conv_id", "turn")  # a repeated one changes no maximum
    # within a conversation: the latest original before the quote, as a running maximum over both in turn order
    quote = F.struct("place", "level", "rank", "at").alias("quote")
    both = originals.select("conv_id", "hash", "turn", F.col("turn").alias("original"), F.lit(None).cast("struct<place: int, level: int, rank: int, at: int>").alias("quote"))
    both = both.unionByName(quoted.select("conv_id", "hash", "turn", F.lit(None).cast(parsed.schema["turn"].dataType).alias("original"), quote))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("original").over(before)).filter("quote is not null")
    inner = near.filter("near is not null").select("conv_id", "turn", "quote", F.col("conv_id").alias("to_conv"), F.col("near").alias("to_turn"))
    # the first of all for what is left; a hash that many quote is dealt out
    first = originals.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = near.filter("near is null").withColumn("salt", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(SALTS)).cast("int"))
    outer = left.join(first, ["hash", "salt"]).filter(F.col("first.conv_id") != F.col("conv_id")).select("conv_id", "turn", "quote", F.col("first.conv_id").alias("to_conv"), F.col("first.turn").alias("to_turn"))
    best = inner.unionByName(outer).groupBy("conv_id", "turn", "quote.place", "quote.level").agg(F.min_by(F.struct("to_conv", "to_turn"), F.struct("quote.rank", "quote.at")).alias("to"))
    return best.select("conv_id", "turn", "place", "level", "to.to_conv", "to.to_turn")


def threads(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """node, root, depth, by pointer jumping over (node, parent). Replies can go in a circle only across conversations; what does, or leads into a circle, has depth 0 and the smallest node on its way as root.

    A node whose root is known is done; each round moves only the others on, past where those they point to have come.
    """
    columns = ["node", "root", "depth", "least"]
    state = nodes.join(parents, "node", "left").select("node", F.coalesce("parent", "node").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.least("node", F.coalesce("parent", "node")).alias("least"))
    state = stage_table(state, "threads")
    done, open_ = [state.filter("root = node")], state.filter("root <> node")  # no message replies to itself
    rounds, enough = 0, state.count().bit_length()
    while rounds < enough and not open_.isEmpty():  # no chain takes more rounds; what is open then is a circle or leads into one
        known = reduce(DataFrame.unionByName, (df.withColumn("final", F.lit(True)) for df in done), open_.withColumn("final", F.lit(False)))
        far = known.select("final", F.col("node").alias("root"), F.col("root").alias("beyond"), F.col("depth").alias("more"), F.col("least").alias("least_beyond"))
        jumped = open_.join(far, "root").select("node", F.col("beyond").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.least("least", "least_beyond").alias("least"), "final")
        jumped, rounds = stage_table(jumped, "threads"), rounds + 1
        done, open_ = [*done, jumped.filter("final").select(*columns)], jumped.filter("not final").select(*columns)
    found = reduce(DataFrame.unionByName, done).select("node", "root", "depth")
    return found.unionByName(open_.select("node", F.col("least").alias("root"), F.lit(0).cast("long").alias("depth")))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, reply_conv, reply_turn, root_conv, root_turn, depth, position for each message (conv_id, turn, role, text)."""
    parsed = stage_table(parse(messages), "messages")
    found = stage_table(links(parsed), "links")
    counts = found.groupBy("conv_id", "turn").agg(F.count_distinct("place").alias("n_linked"))
    replies = found.filter("level = 1").groupBy("conv_id", "turn").agg(F.min_by(F.struct("to_conv", "to_turn"), "place").alias("to"))
    node = F.struct("conv_id", "turn").alias("node")
    nodes = parsed.filter("conv_id is not null and turn is not null").select(node).distinct()
    parents = replies.select(node, F.struct(F.col("to.to_conv").alias("conv_id"), F.col("to.to_turn").alias("turn")).alias("parent"))
    placed = threads(nodes, parents)
    order = Window.partitionBy("root").orderBy("depth", "node")
    placed = placed.withColumn("position", F.row_number().over(order).cast("long"))
    placed = placed.select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("root.conv_id").alias("root_conv"), F.col("root.turn").alias("root_turn"), "depth", "position")
    out = parsed.join(placed, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left").join(replies, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("passages").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("to.to_conv").alias("reply_conv"), F.col("to.to_turn").alias("reply_turn"), "root_conv", "root_turn", "depth", "position",
    )


def as_mail(turns: DataFrame) -> DataFrame:
    """Messages that quote, as mail does, the turn before (level 1) and the one before that (level 2), for tables of plain turns."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", "role", text.alias("text"), F.lag(text, 1).over(order).alias("one"), F.lag(text, 2).over(order).alias("two"))
    quoted = lambda c, mark: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.regexp_replace(F.col(c), r"(?m)^", mark), F.lit("\n")))
    return rows.select("conv_id", "turn", "role", F.concat(quoted("two", "> > "), quoted("one", "> "), "text").alias("text"))
