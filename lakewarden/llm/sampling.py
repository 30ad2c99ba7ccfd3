"""Sampled segmentations: forward filtering, backward sampling over the piece lattice, and lossless decoding.

A text is cut wherever two bytes meet that stand side by side in no piece of the vocabulary, so before each space that follows something else
and around each newline. No piece reaches over such a cut; the lattice of the text is that of its chunks, one after the other, of any
length. The forward pass gives each place of a chunk the summed probability of all segmentations up to it; the backward pass draws the last
piece in proportion to its share, then the one before. Draws are hashes of the row key, the chunk's place and the step, so
a row's sample depends on nothing else. The vocabulary's pieces have ranks; probabilities follow these by Zipf's law.

Cases: null text encodes as the empty text, which has no pieces; a null key is the key ''; characters without a piece become
bytes; equal rows get equal samples; an empty table gives no rows; other columns are kept or ignored as asked; columns to keep that have
the name of a result are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import MIX, Bytes, WordCodes, blocks, chunks, mixed, ragged, remember
from lakewarden.llm.lattice import PieceIndex, ending_at, ordinary_ids, read_pieces

#: Byte pieces start here, in sentencepiece models with byte fallback.
FIRST_BYTE = 3
#: Marks a character without a piece; the rest is its code point.
BYTES = 1 << 24
RARE = 1e-9
MARK = "▁".encode()
#: Chunks that a Python worker remembers with their lattices.
CACHE_CHUNKS = 200_000


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1, as hashes of 64-bit keys."""
    return (mixed(keys) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def probabilities(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pieces that a lattice uses, which are all ordinary ones, their ids, and their probabilities by rank."""
    pieces, ids = read_pieces(path), np.array(ordinary_ids(path))
    weight = 1 / (np.arange(len(ids)) + 2.7)
    return [pieces[i] for i in ids], ids, weight / weight.sum()


def neighbours(pieces: list[str]) -> np.ndarray:
    """Whether two bytes (the first times 256 plus the second) stand side by side in a piece."""
    out = np.zeros(1 << 16, bool)
    for piece in pieces:
        own = np.frombuffer(piece.replace("▁", " ").encode(), np.uint8).astype(np.int32)
        out[own[:-1] << 8 | own[1:]] = True
    return out


def piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the pieces decode to, one after the other, and begin and length of each."""
    pieces, ordinary = read_pieces(path), set(ordinary_ids(path))
    plain = [p.replace("▁", " ").encode() if i in ordinary else bytes([i - FIRST_BYTE]) if FIRST_BYTE <= i < FIRST_BYTE + 256 else b"" for i, p in enumerate(pieces)]
    lengths = np.array(list(map(len, plain)), np.int64)
    return np.frombuffer(b"".join(plain), np.uint8), np.cumsum(lengths) - lengths, lengths


def cut(part: Bytes, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each chunk of some texts, and how many chunks each text has. Chunks cover the texts; a literal '▁' is one of its own."""
    data, n = part.data, len(part.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(part.offsets) - 1, np.int64)
    begins = np.zeros(n, bool)
    begins[1:] = ~joined[data[:-1].astype(np.int32) << 8 | data[1:]] & (data[1:] & 0xC0 != 0x80)  # never inside a character
    marks = np.flatnonzero(data[:-2] == MARK[0]) if n > 2 else np.zeros(0, np.int64)
    marks = marks[(data[marks + 1] == MARK[1]) & (data[marks + 2] == MARK[2])]
    begins[marks] = True
    begins[marks[marks + 3 < n] + 3] = True
    begins[part.offsets[part.offsets < n]] = True
    begins = np.flatnonzero(begins)
    return begins, np.append(begins[1:], n), np.diff(np.searchsorted(begins, part.offsets))


class Lattices(WordCodes):
    """Backward choices of chunks. A node is a place in a chunk; its choices are the pieces that end there, with their cumulated shares."""

    def __init__(self, path: str) -> None:
        own, ids, p = probabilities(path)
        self.index, self.joined = PieceIndex(own), neighbours(own)
        self.ids, self.p = np.append(ids, -1).astype(np.int32), np.append(p, RARE)  # the last one is no piece
        super().__init__(CACHE_CHUNKS)

    def forget(self) -> None:
        self.ends = np.zeros(0, np.int32)  # last node of each chunk
        self.first = np.zeros(1, np.int32)  # of each node: its first choice
        self.cumulated, self.piece, self.back = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int8)

    def learn(self, words: list[str]) -> None:
        made = [self.lattice(places, block) for places, block in blocks([w.replace(" ", "▁") if w != "▁" else "\0" for w in words], 1 << 17)]
        # back in the order of the words, as every word's nodes and choices must follow those of the word before
        place = np.concatenate([m[0] for m in made])
        order = np.argsort(place)
        nodes, choices = (np.concatenate([m[i] for m in made]) for i in (1, 2))
        per_node = np.concatenate([m[3] for m in made])
        literal = {i for i, w in enumerate(words) if w == "▁"}
        take_nodes = ragged((np.cumsum(nodes) - nodes)[order], nodes[order])
        take = ragged((np.cumsum(choices) - choices)[order], choices[order])
        cumulated, piece, back = (np.concatenate([m[i] for m in made])[take] for i in (4, 5, 6))
        if literal:  # a space is written so, this is none
            at = np.cumsum(choices[order]) - choices[order]
            piece[at[list(literal)]] = BYTES + ord("▁")
        node, choice = len(self.first) - 1, len(self.piece)
        self.ends = np.concatenate([self.ends, (node + np.cumsum(nodes[order]) - 1).astype(np.int32)])
        self.first = np.concatenate([self.first, (choice + np.cumsum(per_node[take_nodes])).astype(np.int32)])
        self.cumulated, self.piece, self.back = np.concatenate([self.cumulated, cumulated]), np.concatenate([self.piece, piece]), np.concatenate([self.back, back])

    def lattice(self, places: np.ndarray, block: list[str]) -> tuple[np.ndarray, ...]:
        """Of words of a block: places, nodes and choices of each, choices of each node, and of each choice its cumulated share, piece and length."""
        edges, n = self.index.edges(block), len(block)
        lengths = np.fromiter(map(len, block), np.int64, n)
        width = int(lengths[0])
        forward, degree = np.zeros((width + 1, n)), np.zeros((width + 1, n), np.int32)
        found = []
        for j in range(width):
            column, sums = [], np.zeros(n)
            for k, rows, piece in ending_at(edges, j):
                mass = self.p[piece] * np.exp(forward[j + 1 - k, rows] - forward[j, rows])
                before = sums[rows]
                sums[rows] = before + mass
                column.append((rows, degree[j + 1, rows], piece, np.full(len(rows), k, np.int8), sums[rows]))
                degree[j + 1, rows] += 1
            there = lengths > j
            forward[j + 1] = forward[j] + np.log(np.where(there, sums, 1.0))
            found += [(j + 1, rows, rank, piece, k, upto / sums[rows]) for rows, rank, piece, k, upto in column]
        inside = np.arange(width + 1) <= lengths[:, None]
        per_node = degree.T[inside]
        first = np.zeros((n, width + 1), np.int64)
        first[inside] = np.cumsum(per_node) - per_node
        total = int(per_node.sum())
        cumulated, pieces, back = np.zeros(total, np.float32), np.zeros(total, np.int32), np.zeros(total, np.int8)
        for j, rows, rank, piece, k, upto in found:
            at = first[rows, j] + rank
            cumulated[at], pieces[at], back[at] = upto, self.ids[piece], k
        odd = np.flatnonzero(pieces < 0)  # characters without a piece
        if len(odd):
            codes = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            node = np.searchsorted(np.cumsum(per_node), odd, "right")
            code = codes[node - np.searchsorted(np.cumsum(lengths + 1), node, "right") - 1]
            pieces[odd] = np.where(code < 128, FIRST_BYTE + code, BYTES + code)
        return places, lengths + 1, degree.sum(axis=0), per_node, cumulated, pieces, back

    def draw(self, chunks_: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the chunks, one after the other, and how many each has."""
        node, who, step = self.ends[chunks_], np.arange(len(chunks_), dtype=np.int32), 0
        counts = np.zeros(len(chunks_), np.int64)
        drawn = []
        while len(who):
            u = uniform(seeds[who] + np.uint64(step * int(MIX) % (1 << 64)))
            choice, last = self.first[node], self.first[node + 1] - 1
            open_ = np.flatnonzero((choice < last) & (self.cumulated[choice] <= u))
            while len(open_):
                choice[open_] += 1
                open_ = open_[(choice[open_] < last[open_]) & (self.cumulated[choice[open_]] <= u[open_])]
            drawn.append((who, self.piece[choice]))
            counts[who] += 1
            node = node - self.back[choice]
            more = self.first[node] < self.first[node + 1]  # the first node of a chunk has no choice
            node, who, step = node[more], who[more], step + 1
        ends = np.cumsum(counts)
        out = np.zeros(ends[-1] if len(ends) else 0, np.int32)
        for step, (who, piece) in enumerate(drawn):
            out[ends[who] - 1 - step] = piece
        return out, counts

    def encode(self, part: Bytes, keys: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        begins, ends, per_text = cut(part, self.joined)
        base = np.array([int.from_bytes(hashlib.blake2b(f"{seed}/{k}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for k in keys], np.uint64)
        ids, counts = [], []
        for low in range(0, len(begins), 1 << 18):  # the chunks of a long text come in turns, which bounds what is held of them
            here = slice(low, low + (1 << 18))
            codes = self.of(part.data, begins[here], ends[here])
            row = np.searchsorted(np.cumsum(per_text), np.arange(low, low + len(codes)), "right")
            place = np.arange(low, low + len(codes)) - (np.cumsum(per_text) - per_text)[row]
            own, n = self.draw(codes, base[row] ^ (place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
            if (own >= BYTES).any():
                lengths = np.ones(len(own), np.int64)
                odd = np.flatnonzero(own >= BYTES)
                spelt = [[FIRST_BYTE + x for x in chr(i - BYTES).encode("utf-8", "surrogatepass")] for i in own[odd].tolist()]
                lengths[odd] = list(map(len, spelt))
                n = segment_counts(lengths, n)
                at = np.cumsum(lengths) - lengths
                own = np.repeat(own, lengths)
                own[ragged(at[odd], lengths[odd])] = np.concatenate(spelt)
            ids.append(own)
            counts.append(n)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))])
        cuts = total[np.cumsum(np.concatenate([[0], per_text]))]
        return np.concatenate(ids or [np.zeros(0, np.int32)]), np.diff(cuts)


def segment_counts(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def lattices(path: str) -> Lattices:
    return remember(f"lattices {path}", lambda: Lattices(path))


def encode(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (default: the key) and ids, a sampled segmentation of the text."""
    keep = [c for c in keep or [key] if c.lower() != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattices(vocabulary)
        for whole in batches:
            for batch in chunks(whole, "__text"):
                ids, counts = own.encode(Bytes.of(batch.column("__text")), batch.column("__key").to_pylist(), seed)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    needed = docs.select(*keep, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    return needed.mapInArrow(run, f"{kinds}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, *, keep: list[str]) -> DataFrame:
    """The columns of keep and text, from ids; null ids give the empty text."""
    keep = [c for c in keep if c.lower() != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, begins, lengths = piece_bytes(vocabulary)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                column = batch.column("ids")
                ids = column.flatten().to_numpy()
                per_row = np.asarray([len(x) if x.is_valid else 0 for x in column], np.int64)
                sizes = lengths[ids]
                ends = np.concatenate([[0], np.cumsum(segment_counts(sizes, per_row))]).astype(np.int32)
                texts = pa.StringArray.from_buffers(len(per_row), pa.py_buffer(ends), pa.py_buffer(data[ragged(begins[ids], sizes)]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    needed = encoded.select(*keep) if "ids" in keep else encoded.select(*keep, "ids")
    return needed.mapInArrow(run, f"{kinds}, text string")


def round_trip(docs: DataFrame, vocabulary: str, *, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids, comma-joined), text_sha256, decoded_sha256 and lossless for every row."""
    source = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    encoded = encode(docs.select("doc_id", "text", source.alias("text_sha256")), vocabulary, seed=seed, keep=["doc_id", "text_sha256"])
    decoded = decode(encoded, vocabulary, keep=["doc_id", "text_sha256", "ids"])
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "text_sha256", F.sha2("text", 256).alias("decoded_sha256"), (F.sha2("text", 256) == F.col("text_sha256")).alias("lossless"),
    )
