"""Runs of repeated words, found by string synchronising sets.

A run is a maximal stretch of words that repeats with a smallest period of q words, at least four times. Runs of periods in [t, 2t) are
found at scale t = 1, 2, 4, ...: the positions whose hash of t words is the smallest, among those of the next t positions and their own, at either end of that
window make a synchronising set. Whether a position is in it hangs on its 2t words alone, so in a run positions a period apart are in it together; and
of each position that follows some position in it does. So a position and the next one with the same 2t words, its context, propose
their distance as a period, and a long enough run proposes its own. Where t words have a period of at most t/4 the set would be dense: those
positions are left out of it. The runs of such periods are those that smaller scales have found already, so that
nothing is lost. Proposals are checked, and runs measured, on the words themselves.

A text is taken as a whole. The texts of one step in a task are worked on as one string with a mark of its own after each text, which no run
can cross; at each scale only texts that can hold a run of it are left. Rows are not shuffled.

Cases: null, empty and wordless texts have no words and no run; a text with a null id stays as it is, without the repetition that the ids of others may plant; repeated rows come back each;
an empty table gives no rows; extra columns, of whatever names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakewarden.llm.common import MIX, chunks, mixed

#: A run has at least this many words, and this many of its periods.
LEAST, TIMES = 6, 4
FOUND = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
Run = tuple[int, int, int]


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Of each of n words the number of the word that stands there: of some texts, by their id, the end repeats."""
    order = np.arange(n)
    if doc_id is None or n == 0:
        return order
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return order
    a = g % n
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order


def synchronising(hashes: np.ndarray, scale: int, dense: np.ndarray) -> np.ndarray:
    """Positions whose window of scale + 1 hashes has its smallest at an end; dense ones count as largest."""
    own = np.where(dense, np.uint64(0xFFFFFFFFFFFFFFFF), hashes)
    smallest, width = own, 1
    while width < scale:
        smallest = np.minimum(smallest[:-width], smallest[width:])
        width *= 2
    first, last = own[: len(own) - scale], own[scale:]
    smallest = np.minimum(smallest[: len(first)], last)
    return np.flatnonzero((smallest == np.minimum(first, last)) & ~(dense[: len(first)] & dense[scale:]))


def proposals(positions: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period), by period and position: positions with the same context as the next one a period of this scale on; of those in one run the first."""
    order = np.lexsort((positions, contexts))
    at, context = positions[order], contexts[order]
    gap = np.diff(at)
    hit = np.flatnonzero((context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale))
    at, period = at[hit], gap[hit]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    follows = np.zeros(len(at), bool)
    follows[1:] = (period[1:] == period[:-1]) & (np.diff(at) <= period[1:])  # they share a period of the run
    return at[~follows], period[~follows]


def reach(same: np.ndarray, other: np.ndarray) -> int:
    """How many words two stretches have in common from their beginning, looked at in growing steps."""
    at, step = 0, 64
    while at < len(same):
        differs = np.flatnonzero(same[at : at + step] != other[at : at + step])
        if len(differs):
            return at + int(differs[0])
        at, step = at + step, 2 * step
    return len(same)


def measured(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """Begin and end of the longest stretch around a position in which words a period apart are the same."""
    right = reach(words[at : len(words) - period], words[at + period :])
    left = reach(words[:at][::-1], words[period : at + period][::-1])
    return at - left, at + right + period


def runs(words: np.ndarray, texts: np.ndarray) -> dict[tuple[int, int], int]:
    """(begin, end) to period of all stretches of at least TIMES periods. texts: offsets of the texts, each of which ends with a mark of its own."""
    found: dict[tuple[int, int], int] = {}
    lengths = np.diff(texts)
    kept, origin = words, np.arange(len(words))
    hashes, scale = mixed(words.astype(np.uint64) * MIX), 1
    while True:
        wide = lengths > TIMES * scale  # a text's mark is no word
        if not wide.any():
            return found
        here = np.repeat(wide, lengths)
        kept, origin, hashes, lengths = kept[here], origin[here], hashes[here], lengths[wide]
        # what is not followed by enough words within the kept texts has a hash that no other position has, or is cut off with the mark
        doubled = mixed(hashes[: len(hashes) - scale] + mixed(hashes[scale:] * MIX))
        change = np.zeros(len(kept) + 1, np.int64)
        if scale >= TIMES:  # of what is known in the kept texts, where scale words lie within a run of a small period
            for (begin, end), period in found.items():
                if TIMES * period <= scale <= end - begin:
                    low = int(np.searchsorted(origin, begin))
                    if low < len(origin) and origin[low] == begin:
                        change[low] += 1
                        change[low + end - begin - scale + 1] -= 1
        dense = np.cumsum(change[:-1]) > 0
        positions = synchronising(hashes, scale, dense)
        positions = positions[positions < len(doubled)]
        for at, period in zip(*(x.tolist() for x in proposals(positions, doubled[positions], scale)), strict=True):
            begin, end = measured(kept, at, period)
            if end - begin >= TIMES * period:
                shift = int(origin[begin]) - begin
                found.setdefault((begin + shift, end + shift), period)
        hashes = np.concatenate([doubled, mixed(np.arange(1, scale + 1, dtype=np.uint64) * MIX ^ hashes[len(hashes) - scale :])])
        scale *= 2


def described(words: list[bytes], order: np.ndarray, own: list[Run]) -> tuple[object, ...]:
    """What is said of one text: its words, which of them stand where, and its runs (start, length, period)."""
    own = sorted(own, key=lambda r: (r[0], r[2]))
    dropped = np.zeros(len(order) + 1, np.int64)
    for start, length, period in own:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    kept = order[np.cumsum(dropped[:-1]) == 0].tolist() if own else order.tolist()
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in own)
    start, length, period = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
    exponent = 1000 * length // period if length is not None and period is not None else None
    collapsed = b" ".join([words[i] for i in kept])
    return len(own), start, length, period, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the text without repetitions, for each document (doc_id, text)."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in batch.column("text")]
        numbers: dict[bytes, int] = {}
        orders, parts = [], []
        for i, words in enumerate(texts):
            order = planted(ids[i], len(words))
            codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            orders.append(order)
            parts += [codes[order], np.array([-1 - i])]  # no other word is the mark of this text
        offsets = np.cumsum([0, *(len(w) + 1 for w in texts)])
        own: list[list[Run]] = [[] for _ in texts]
        for (begin, end), period in runs(np.concatenate(parts), offsets).items():
            text = int(np.searchsorted(offsets, begin, "right")) - 1
            if end - begin >= LEAST:
                own[text].append((begin - int(offsets[text]), end - begin, period))
        rows = [described(*x) for x in zip(texts, orders, own, strict=True)]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield step(part)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, FOUND)
