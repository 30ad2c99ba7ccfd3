"""Mixture-controlled packing: deficit round-robin over source queues.

The tokens of each source form one queue, ordered by a hash of id and tokens, so that the order hangs on the rows alone and not on
files or partitions. Every window of the output takes from each queue its quantum, the target share of the window; the fraction of a
token that a window cannot take is the queue's deficit and is carried to the next one. As a deficit
after w windows is a closed form of w (the carried fraction of w * quantum), any task can place any
document from the queue position of its first token, so windows and deficits run across
partitions without a sequential pass. When a queue runs dry, a new phase shares its part
among the others. A window is short of its size by less than a token of each source. Windows follow each other without gaps in one token stream, which is
cut into sequences; the last, partial sequence is cut into powers of two, so nothing is padded.

A queue's position comes from two levels of sums: over its slots (ranges of the hash, at most 2**SLOT_BITS rows a queue) and within a
slot, so that no task sorts more than a slot of a source. The schedule holds a few numbers for each source and phase, on the driver and in each
task; phases are as many as queues that run dry apart from each other, a few with the default weights.

Cases: null text packs as the empty text (one end token); a null source is the source ''; null ids stay
null; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import EXACT, FOLDED, Bytes, WordCodes, chunks, flags, ragged, remember, segment_sums, stage_table

#: Quanta are fixed-point numbers with this many parts of a token.
PARTS = 1 << 20
#: A queue's rows are dealt into 2**SLOT_BITS ranges of their hash.
SLOT_BITS = 12
#: Numbers of windows that a task remembers.
WINDOW_CELLS = 1 << 17
END_ID = 1


def byte_letters() -> dict[int, str]:
    """The letters that a byte-level vocabulary writes for the code points 0 to 255 of bytes: printable ones are themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}


#: Words of these characters are what the tokenizer's normalizer leaves them, but for case.
PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u00ff]+")
# How the tokenizer parts such a word, in lower case, before it looks for pieces.
LETTER, NUMBER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PRETOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{LETTER}{NUMBER}]+")
#: White space of ASCII that parts words for the tokenizer too.
PARTING = flags(b" \t\n\v\f\r")
#: Distinct parts that a Python worker remembers.
MOST_PARTS = 200_000


class WordTokens(WordCodes):
    """Token ids of words and texts. The tokenizer drops white space and no token crosses it, so the ids of a text are those of its words; those of a plain word are those of its parts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters, self.parts = byte_letters(), {}
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4")
        super().__init__()

    def forget(self) -> None:
        self.ids, self.starts, self.lengths = np.zeros(0, self.kind), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        parts, split, plain, tokenize = self.parts, PRETOKENS.findall, PLAIN.fullmatch, self.tokenizer.model.tokenize
        ids: list[int] = []
        ends = []
        for word in words:
            if plain(word) and not ("<" in word and any(s in word.encode() for s in self.special)):
                for part in split(word.lower()):
                    known = parts.get(part)
                    if known is None:
                        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                        known = parts[part] = [t.id for t in tokenize(shown)]
                    ids += known
            else:
                ids += self.tokenizer.encode(word, add_special_tokens=False).ids
            ends.append(len(ids))
        if len(parts) > MOST_PARTS:
            parts.clear()
        counts = np.diff(ends, prepend=0).astype(np.int32)
        self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, counts])
        self.ids = np.concatenate([self.ids, np.array(ids, self.kind)])

    def encode(self, part: Bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        begins, ends, counts = part.words(PARTING)
        folded = part.data.tobytes().lower()  # case tells special tokens from ordinary text, and nothing else
        self.terms = EXACT if any(s.lower() in folded for s in self.special) else FOLDED
        codes = self.of(part.data, begins, ends)
        lengths = self.lengths[codes]
        return self.ids[ragged(self.starts[codes], lengths)], segment_sums(lengths, counts).astype(np.int64)


def encoder(path: str) -> WordTokens:
    """One for each Python worker, as its memory of words is worth keeping between tasks."""
    return remember(f"tokens {path}", lambda: WordTokens(path))


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, queue, slot, place, n, ids): ids are little-endian unsigned numbers of 16 or 32 bits and end with END_ID; place is a hash of id and ids, slot its upper bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        width = words.kind.itemsize
        for whole in batches:
            for batch in chunks(whole):
                own, counts = words.encode(Bytes.of(batch.column("text")))
                ends = np.cumsum(counts + 1)
                ids = np.full(ends[-1], END_ID, words.kind)
                ids[ragged(ends - counts - 1, counts)] = own
                column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((np.append(0, ends) * width).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("queue"), pa.array(counts + 1), column], names=["doc_id", "queue", "n", "ids"])

    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    chosen = docs.select("doc_id", source.alias("queue"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = chosen.mapInArrow(run, f"doc_id {kind}, queue string, n bigint, ids binary")
    place = F.xxhash64("doc_id", "ids")
    return made.select("doc_id", "queue", F.shiftrightunsigned(place, 64 - SLOT_BITS).cast("int").alias("slot"), place.alias("place"), "n", "ids")


class Schedule:
    """Which tokens of which queue each window takes, from the queues' totals and weights."""

    def __init__(self, totals: list[int], weights: list[int], window: int) -> None:
        self.totals, taken, at = totals, [0] * len(totals), 0
        self.first: list[int] = []  # of each phase: its place in the stream
        self.bases: list[np.ndarray] = []
        self.quanta: list[np.ndarray] = []
        while any(t > x for t, x in zip(totals, taken, strict=True)):
            left = [t > x for t, x in zip(totals, taken, strict=True)]
            share = [w * on for w, on in zip(weights, left, strict=True)]
            if not any(share):  # only queues without a weight are left
                share = [int(on) for on in left]
            quanta = [max(1, w * window * PARTS // sum(share)) if w else 0 for w in share]
            windows = min(-(-(t - x) * PARTS // q) for t, x, q in zip(totals, taken, quanta, strict=True) if q)
            self.first.append(at)
            self.bases.append(np.array(taken, np.int64))
            self.quanta.append(np.array(quanta, np.int64))
            now = [int(x) for x in self.taken(len(self.first) - 1, windows)]
            at += sum(now) - sum(taken)
            taken = now
        self.size = at
        self.bases_of = np.array(self.bases, np.int64).T.tolist()
        self.quanta_of = np.array(self.quanta, np.int64).T.tolist()
        self.windows: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def taken(self, phase: int, w: int) -> np.ndarray:
        """Tokens taken from each queue before window w of a phase."""
        whole, part = np.divmod(self.quanta[phase], PARTS)
        return np.minimum(self.bases[phase] + w * whole + w * part // PARTS, self.totals)

    def window(self, phase: int, w: int) -> list[tuple[int, int, int]]:
        """Of window w of a phase: each queue's first token, its end, and its place in the stream."""
        if (phase, w) not in self.windows:
            if len(self.windows) * len(self.totals) > WINDOW_CELLS:
                self.windows.clear()
            low, high = self.taken(phase, w), self.taken(phase, w + 1)
            places = self.first[phase] + (low - self.bases[phase]).sum() + np.cumsum(high - low) - (high - low)
            self.windows[phase, w] = list(zip(low.tolist(), high.tolist(), places.tolist(), strict=True))
        return self.windows[phase, w]

    def pieces(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(queue position, length, place in the stream) of the runs that a queue's tokens start .. start + length lie in."""
        at, end = start, start + length
        while at < end:
            phase = bisect_right(self.bases_of[queue], at) - 1
            w = max(0, (at - self.bases_of[queue][phase]) * PARTS // self.quanta_of[queue][phase] - 1)
            while (found := self.window(phase, w)[queue])[1] <= at:
                w += 1
            low, high, place = found
            stop = min(end, high)
            yield at, stop - at, place + at - low
            at = stop


def sequence_ends(size: int, length: int) -> list[int]:
    """Ends of the sequences after the last full one: the rest, cut into powers of two."""
    at, out = size - size % length, []
    while at < size:
        at += 1 << ((size - at).bit_length() - 1)
        out.append(at)
    return out


def pack(docs: DataFrame, tokenizer: str, *, length: int = 2048, window_sequences: int = 16, weights: dict[str, int] | None = None) -> DataFrame:
    """Pieces of all documents in packed sequences.

    docs needs doc_id, text, source. weights: the target of each source (none: its share of all tokens, which
    every window can then keep to until all queues run dry together). Sources without a weight come last.
    A window is window_sequences sequences long.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    tokens = stage_table(tokenize(docs, tokenizer), "tokens")
    by_slot = tokens.groupBy("queue", "slot").agg(F.sum("n").alias("total"))
    totals = {r.queue: r.total for r in by_slot.groupBy("queue").agg(F.sum("total").alias("total")).collect()}
    names = sorted(totals)
    plan = Schedule([totals[q] for q in names], [int((weights or totals).get(q, 0)) for q in names], length * window_sequences)
    ends = np.array(sequence_ends(plan.size, length), np.int64)
    number = {q: i for i, q in enumerate(names)}

    slots = Window.partitionBy("queue").orderBy("slot")  # a row for each slot, not for each document
    begins = by_slot.select("queue", "slot", (F.sum("total").over(slots) - F.col("total")).alias("slot_start"))
    rows = Window.partitionBy("queue", "slot").orderBy("place", "doc_id", "ids")
    placed = tokens.withColumn("within", F.sum("n").over(rows.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = placed.join(begins, ["queue", "slot"]).select("doc_id", "queue", "n", "ids", (F.col("slot_start") + F.col("within")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = plan.size - plan.size % length
        for batch in (whole.slice(low, 1024) for whole in batches for low in range(0, whole.num_rows, 1024)):
            owner, out = [], []
            columns = (batch.column(c).to_pylist() for c in ("queue", "n", "ids", "at"))
            for i, (queue, n, ids, at) in enumerate(zip(*columns, strict=True)):
                wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                for position, size, place in plan.pieces(number[queue], at, n):
                    done = 0
                    while done < size:
                        here = place + done
                        if here < full:
                            sequence, offset = divmod(here, length)
                            stop = here - offset + length
                        else:
                            k = int(np.searchsorted(ends, here, "right"))
                            sequence, stop = full // length + k, int(ends[k])
                            offset = here - (int(ends[k - 1]) if k else full)
                        take = min(size - done, stop - here)
                        start = position - at + done
                        owner.append(i)
                        out.append((start, take, zlib.crc32(wide[4 * start : 4 * (start + take)]), n, sequence, offset))
                        done += take
            numbers = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 6
            owners = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owners), *numbers, batch.column("queue").take(owners)], names=names_out)

    names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in names_out[1:7])}, queue string")
