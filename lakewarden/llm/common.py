"""Helpers that several training-data operators share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: Bytes of text that one step inside a task works on; one text is never divided between steps.
CHUNK_BYTES = 1 << 20
#: Distinct words that a Python worker remembers before it starts afresh.
CACHE_WORDS = 500_000
#: White space of ASCII, which parts words.
SPACES = b" \t\n\v\f\r"
MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it. Where it is unset, a temporary one if all runs in one process (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lakewarden-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakewarden-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(divisor))


def without(docs: DataFrame, *names: str) -> list[str]:
    """The columns of docs but for some names, whatever their case: those would clash with columns that an operator adds."""
    taken = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in taken]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of the given lengths, which may be zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def char_matrix(words: list[str], width: int) -> np.ndarray:
    """Code points plus one, a row for each word, zero after its end."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(words), width), np.uint32)
    out[np.arange(width) < lengths[:, None]] = codes + 1
    return out


def blocks(words: list[str], area: int = 1 << 18) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Blocks of words of similar length, with their places; a block's words times its longest word's characters are at most area, unless it is one word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-lengths, kind="stable")
    low = 0
    while low < len(order):
        high = low + max(1, area // max(1, int(lengths[order[low]])))
        yield order[low:high], [words[i] for i in order[low:high].tolist()]
        low = high


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that leaves no visible pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bytes:
    """Some texts as one run of UTF-8 bytes; row i has the bytes offsets[i] to offsets[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, column: pa.Array) -> Bytes:
        """Of a string column; null is the empty text. Nothing is copied."""
        if column.null_count:
            column = pc.fill_null(column, "")
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, places, data = column.buffers()
        offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        return cls(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0])

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def counts(self, *characters: str) -> np.ndarray:
        """How many of some ASCII characters each text has."""
        found = flags("".join(characters).encode())[self.data] if len(characters) > 1 else self.data == ord(characters[0])
        return np.diff(np.searchsorted(np.flatnonzero(found), self.offsets))

    def words(self, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word, a longest run without parting bytes, and how many each text has."""
        inside = ~parting[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]  # a text's end is a word's end too
        begins[inner] = inside[inner]
        ends[inner - 1] = inside[inner - 1]
        begins = np.flatnonzero(begins)
        return begins, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(begins, self.offsets))


def flags(characters: bytes) -> np.ndarray:
    """True for the bytes of some characters."""
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes, so that a task's memory hangs on no batch size; a long text is a slice of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    ends, low = np.cumsum(lengths), 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


_LETTERS = np.arange(256)
#: A number for each byte, as it is, and with A-Z taken as a-z.
EXACT = np.arange(1, 257, dtype=np.uint64)
FOLDED = EXACT[np.where((_LETTERS >= 65) & (_LETTERS <= 90), _LETTERS + 32, _LETTERS)]
#: Keys are sums modulo a prime: modulo 2**64 some words of 1,024 letters and more have one sum, whatever the base.
PRIME, _BASE = (1 << 61) - 1, 0xD1342543DE82EF95
_HALF = np.uint64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Of 64-bit numbers the remainders modulo PRIME."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of numbers below PRIME modulo PRIME, from halves of 31 and 30 bits."""
    x1, x0, y1, y0 = x >> np.uint64(31), x & _HALF, y >> np.uint64(31), y & _HALF
    middle = x1 * y0 + x0 * y1
    low = (middle & np.uint64((1 << 30) - 1)) << np.uint64(31)
    return _reduced(np.uint64(2) * x1 * y1 + (middle >> np.uint64(30)) + low + x0 * y0)


class _Powers:
    """Powers of the base for up to CHUNK_BYTES bytes, whole and in two halves."""

    def __init__(self) -> None:
        self.whole = np.ones(1, np.uint64)
        while len(self.whole) < CHUNK_BYTES + 1:
            self.whole = np.concatenate([self.whole, _product(self.whole, np.uint64(pow(_BASE, len(self.whole), PRIME)))])
        self.high, self.low = (self.whole >> np.uint64(31)).astype(np.uint32), (self.whole & _HALF).astype(np.uint32)


@functools.cache
def _powers() -> _Powers:
    return _Powers()


def _sums(values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total


def keys_of_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, terms: np.ndarray = EXACT) -> np.ndarray:
    """A 64-bit key of the bytes of each span, never 0. Spans ascend and do not overlap. A word longer than CHUNK_BYTES is a chain of its parts' keys."""
    long = np.flatnonzero(ends - begins > CHUNK_BYTES)
    if len(long):
        out = np.zeros(len(begins), np.uint64)
        short = np.setdiff1d(np.arange(len(begins)), long, assume_unique=True)
        out[short] = keys_of_spans(data, begins[short], ends[short], terms)
        for i in long.tolist():
            cuts = np.append(np.arange(begins[i], ends[i], CHUNK_BYTES), ends[i])
            key = np.zeros(1, np.uint64)
            for part in keys_of_spans(data, cuts[:-1], cuts[1:], terms):
                key = mixed(key * MIX + part)
            out[i] = key[0] | np.uint64(1)
        return out
    out, low, powers = np.zeros(len(begins), np.uint64), 0, _powers()
    while low < len(begins):
        first = int(begins[low])
        high = max(low + 1, int(np.searchsorted(ends, first + CHUNK_BYTES, "right")))
        part = data[first : int(ends[high - 1])]
        a, b, n = begins[low:high] - first, ends[low:high] - first, len(part)
        letters = terms[part]  # at most 256, so that sums over CHUNK_BYTES stay below 2**59
        total = _sums(letters * powers.high[:n])
        upper = total[b] - total[a]
        total = _sums(letters * powers.low[:n])
        shifted = ((upper & np.uint64((1 << 30) - 1)) << np.uint64(31)) + (upper >> np.uint64(30))  # upper * 2**31, as 2**61 is 1
        own = _product(_reduced(shifted + total[b] - total[a]), powers.whole[CHUNK_BYTES - a])
        out[low:high] = mixed(own ^ (b - a).astype(np.uint64) * MIX)
        low = high
    return np.where(out == 0, np.uint64(1), out)


class KeyTable:
    """Finds the numbers that 64-bit keys (other than 0) were given, many at a time."""

    def __init__(self) -> None:
        self.count = 0
        self._make(1 << 12)

    def _make(self, slots: int) -> None:
        self.held, self.numbers = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.shift, self.mask = np.uint64(65 - slots.bit_length()), slots - 1

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Of each key its number, or -1."""
        at, who, out = self._first(keys), None, np.full(len(keys), -1, np.int32)
        while len(at):
            held = self.held[at]
            hit = held == keys
            places = np.flatnonzero(hit)
            out[places if who is None else who[places]] = self.numbers[at[places]]
            on = np.flatnonzero(~hit & (held != 0))
            at, keys, who = (at[on] + 1) & self.mask, keys[on], on if who is None else who[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Gives keys that are new and distinct the next numbers, in their order."""
        numbers = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        if 2 * self.count > len(self.held):
            old = np.flatnonzero(self.held)
            kept = self.held[old], self.numbers[old]
            self._make(1 << (2 * self.count).bit_length())
            self._place(*kept)
        self._place(keys, numbers)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = self._first(keys)
        while len(at):
            free = np.flatnonzero(self.held[at] == 0)
            self.held[at[free]] = keys[free]  # of several that want a place one gets it
            won = np.zeros(len(at), bool)
            won[free] = self.held[at[free]] == keys[free]
            self.numbers[at[won]] = numbers[won]
            at, keys, numbers = (at[~won] + 1) & self.mask, keys[~won], numbers[~won]


_remembered: dict[str, object] = {}


def remember(key: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks: one thing at a time, so that operators that follow each other do not add up."""
    if key not in _remembered:
        forget()
        _remembered[key] = make()
    return _remembered[key]  # type: ignore[return-value]


def forget() -> None:
    """What operators that keep nothing begin a task with: what the one before has kept would stand beside their own."""
    if _remembered:
        _remembered.clear()
        pa.default_memory_pool().release_unused()


class WordCodes:
    """Numbers words as they come, by 64-bit keys of their bytes; a subclass fills what it keeps for new ones."""

    def __init__(self, most: int = CACHE_WORDS, terms: np.ndarray = EXACT) -> None:
        self.most, self.terms = most, terms
        self.table = KeyTable()
        self.forget()

    def learn(self, words: list[str]) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def of(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = keys_of_spans(data, begins, ends, self.terms)
        codes = self.table.find(keys)
        new = np.flatnonzero(codes < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if self.table.count and self.table.count + len(fresh) > self.most:
                self.table = KeyTable()
                self.forget()
                new = np.arange(len(keys))
                fresh, first = np.unique(keys, return_index=True)
            at = new[first]
            raw = data.tobytes()
            self.learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(begins[at].tolist(), ends[at].tolist(), strict=True)])
            self.table.add(fresh)
            codes[new] = self.table.find(keys[new])
        return codes

    def of_words(self, words: list[str]) -> np.ndarray:
        """The same for words given one by one."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([0, *map(len, raw)])
        return self.of(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:])
