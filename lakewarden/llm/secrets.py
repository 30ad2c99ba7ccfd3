"""Secret scans: a linear-chain conditional random field over words, beside three fixed patterns.

Words (runs without ASCII white space) are tagged begin, inside or outside. Their features are the shape of a word in several
respects, its letters, the same of both neighbours, and features of the whole file. The field is fitted by the gradient of its
conditional log-likelihood (forward-backward), with the words of the fixed patterns' matches as labels, and decoded by
Viterbi. Further copies of the training windows hide some respects of a match's words or put bare values in other alphabets in their place, beside harmless long words,
so that the field learns what secrets look like and not only the key words of the patterns. What it tags beyond the fixed patterns becomes a span of the kind crf; such a span may
overlap base spans, and is left out only where these cover all of it.

Cases: null text is the empty text, which has no spans; null ids stay null; repeated rows are scanned each; an
empty table gives no rows; a field without any training match tags nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import CHUNK_BYTES, SPACES, Bytes, WordCodes, blocks, char_matrix, chunks, flags, forget, keys_of_spans, remember, stage_table

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The same matches as of HEX, without a match for each short run.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
WORD = re.compile(r"[^ \t\n\v\f\r]+")
PARTING = flags(SPACES)
HEX_BYTES = flags(b"0123456789abcdef")
#: Lower-case bytes without which no match of ASSIGN begins.
KEY_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

BEGIN, INSIDE, OUTSIDE = range(3)
#: Numbers that each respect of a word can have: shape as a whole, letters, length, share of digits, case, changes, marks, variety.
RESPECTS = (1 << 10, 1 << 12, 8, 5, 5, 6, 32, 6)
FIRSTS = np.cumsum((0, *RESPECTS[:-1]))
STEP, FILES = sum(RESPECTS), 64
#: Rows of the weights: respects of the word, of the one before, of the one after, then the file's features.
ROWS = 3 * STEP + FILES
WINDOW = 64
#: Windows whose gradient is worked out at a time, so that what it takes beside the windows themselves does not grow with them.
AT_ONCE = 256
#: The respects of neighbours that count: shape as a whole, letters and marks.
NEAR = [0, 1, 6]
FEATURES = len(RESPECTS) + 2 * len(NEAR) + 1
LETTERS = 1
#: Respects that are hidden in a further copy of windows with a match: shape and letters.
HIDDEN = [0, LETTERS]
#: Alphabets of the bare values that stand in for matches in further copies.
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789-_")
#: Harmless words of a secret's length that stand beside these, made of the window's words.
HARMLESS = ("https://{}.com/{}/{}.html?id=20417", "/usr/{}/{}/{}.py", "2023-11-05T10:{}:{}", "{}_{}_{}_id", "{}{}.{}@mail4.example.com", "{}-{}-{}-2021", "3f2b8c1a-5d4e-4f6a-9b7c-{}{}{}")


#: All letters of a word count in its hash: a polynomial modulo a prime, whose powers come round.
PRIME = 1_000_003


def powers_of(base: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < PRIME - 1:
        out = np.concatenate([out, out * pow(base, len(out), PRIME) % PRIME])
    return out[: PRIME - 1]


POWERS = powers_of(31)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def base_of(part: Bytes) -> dict[int, list[tuple[int, int, int]]]:
    """The base spans of the texts that have any, by the text's number. Only texts with what every match must contain are searched."""
    data, raw = part.data, part.data.tobytes()
    places = []
    run = np.flatnonzero(np.diff(np.concatenate([[0], HEX_BYTES[data].view(np.int8), [0]])))
    places.append(run[::2][run[1::2] - run[::2] >= LEAST["hex"]])
    lower = raw.lower()
    for text, words in ((raw, (b"AKIA",)), (lower, KEY_WORDS)):
        for word in words:
            at = text.find(word)
            while at >= 0:
                places.append([at])
                at = text.find(word, at + len(word))
    rows = np.unique(np.searchsorted(part.offsets, np.concatenate(places), "right") - 1).tolist()
    return {i: spans for i in rows if (spans := base_spans(part.text(i)))}


def respects(words: list[str]) -> np.ndarray:
    """A row for each word, with its numbers in the order of RESPECTS."""
    out = np.zeros((len(words), len(RESPECTS)), np.int16)
    for places, block in blocks(words):
        code = char_matrix(block, len(block[0])).astype(np.int64) - 1
        digit, upper = (code >= 48) & (code <= 57), (code >= 65) & (code <= 90)
        letter = upper | (code >= 97) & (code <= 122) | (code >= 0xC0)
        digits, uppers, letters = digit.sum(axis=1), upper.sum(axis=1), letter.sum(axis=1)
        size = digits + letters
        kind = digit + 2 * upper
        changes = ((kind[:, 1:] != kind[:, :-1]) & (digit | letter)[:, 1:] & (digit | letter)[:, :-1]).sum(axis=1)
        length = np.minimum(7, (size + 3) // 6)
        share = np.where(digits == 0, 0, 1 + np.minimum(3, 4 * digits // (size + 1)))
        first = upper[np.arange(len(block)), letter.argmax(axis=1)]
        case = np.where(letters == 0, 0, np.where(uppers == 0, 1, np.where(uppers == letters, 2, np.where(first & (uppers == 1), 3, 4))))
        has = lambda *characters: np.isin(code, [ord(c) for c in characters]).any(axis=1)
        marks = has(":", "=") | has('"', "'") << 1 | has("@") << 2 | has("/") << 3 | has("_", "-", "+") << 4
        own = np.sort(np.where(digit | letter, code, -1), axis=1)
        variety = np.minimum(5, ((np.diff(own, axis=1) > 0).sum(axis=1) + 1) // 4)
        shape = length | (digits > 0) << 3 | (4 * digits > size) << 4 | (case == 4) << 5 | (changes > 3) << 6 | (marks & 1) << 7 | (marks >> 1 & 1) << 8 | (case == 2) << 9
        following = letter[:, ::-1].cumsum(axis=1)[:, ::-1] - letter  # letters after each
        hashed = np.where(letter, np.where(upper, code + 32, code) * POWERS[following % (PRIME - 1)] % PRIME, 0).sum(axis=1) % PRIME
        out[places] = np.stack([shape, hashed % RESPECTS[LETTERS], length, share, case, np.minimum(5, (changes + 2) // 3), marks, variety], axis=1)
    return out


def file_features(part: Bytes) -> np.ndarray:
    """A number for each file's length, whether it assigns much, and whether it looks like code."""
    lines = part.counts("\n") + 1
    sizes = np.diff(part.offsets)
    bits = np.minimum(15, np.ceil(np.log2(sizes + 1.0))).astype(np.int64)
    return bits | (4 * part.counts("=") > lines) << 4 | (part.counts("{", ";") > lines) << 5


class WordFeatures(WordCodes):
    """Respects of words and, given weights, what each adds to the scores of itself and its neighbours."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = np.zeros((ROWS, 3)) if weights is None else weights
        super().__init__()

    def forget(self) -> None:
        self.rows = np.zeros((0, len(RESPECTS)), np.int16)
        self.own, self.before, self.after = (np.zeros((0, 3), np.float32) for _ in range(3))

    def learn(self, words: list[str]) -> None:
        numbers = respects(words)
        rows = numbers + FIRSTS
        add = [self.weights[own].sum(axis=1).astype(np.float32) for own in (rows, rows[:, NEAR] + STEP, rows[:, NEAR] + 2 * STEP)]
        self.rows = np.concatenate([self.rows, numbers])
        self.own, self.before, self.after = (np.concatenate(x) for x in zip((self.own, self.before, self.after), add, strict=True))


def emissions(features: WordFeatures, codes: np.ndarray, starts: np.ndarray, files: np.ndarray) -> np.ndarray:
    """Scores of the tags of all words of some texts; starts: first word of each text; files: the texts' numbers by word."""
    out = features.own[codes] + features.weights[3 * STEP + files]
    before, after = features.before[codes[:-1]], features.after[codes[1:]]
    inner = np.ones(len(codes), bool)
    inner[starts[starts < len(codes)]] = False
    out[1:] += before * inner[1:, None]
    out[:-1] += after * inner[1:, None]
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of sequences that stand one after the other in scores."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    back = np.zeros((len(scores), 3), np.int8)
    best = scores[starts].copy()
    final = np.zeros((len(order), 3))
    active = len(order)
    for t in range(1, int(lengths[0]) if len(lengths) else 0):
        now = int(np.searchsorted(-lengths, -t, "left"))  # those longer than t
        final[now:active] = best[now:active]
        active = now
        paths = best[:active, :, None] + moves
        at = starts[:active] + t
        back[at] = choice = paths.argmax(axis=1)
        best = np.take_along_axis(paths, choice[:, None, :], axis=1)[:, 0] + scores[at]
    final[:active] = best[:active]
    tags = np.zeros(len(scores), np.int8)
    tag = final.argmax(axis=1)
    for t in range(int(lengths[0]) - 1 if len(lengths) else -1, -1, -1):
        on = int(np.searchsorted(-lengths, -t, "left"))
        at = starts[:on] + t
        tags[at] = tag[:on]
        tag[:on] = back[at, tag[:on]]
    return tags


def decode(features: WordFeatures, moves: np.ndarray, part: Bytes) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of the kind crf of the texts that have any, by the text's number."""
    begins, ends, lengths = part.words(PARTING)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(begins):
        return out
    codes = features.of(part.data, begins, ends)
    starts = np.cumsum(lengths) - lengths
    scores = emissions(features, codes, starts, np.repeat(file_features(part), lengths))
    # Another tag in place of one changes two moves: where OUTSIDE leads by more than that can bring, every best path has it, and the chain falls apart there.
    sure = scores[:, OUTSIDE] - scores[:, :2].max(axis=1) > 2 * (moves.max() - moves.min()) + 1e-3
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.diff(owner, prepend=-1) != 0
    open_ = np.flatnonzero(~sure)
    heads = np.flatnonzero(np.diff(open_, prepend=-2) != 1) if len(open_) else np.zeros(0, np.int64)
    heads = np.union1d(heads, np.flatnonzero(first[open_]))
    tags = np.full(len(codes), OUTSIDE, np.int8)
    if len(open_):
        runs = np.diff(np.append(heads, len(open_)))
        begin, end = open_[heads], open_[heads + runs - 1]
        scores[begin] += np.where(first[begin][:, None], 0, moves[OUTSIDE])
        scores[end] += np.where(np.append(first, True)[end + 1][:, None], 0, moves[:, OUTSIDE])
        tags[open_] = viterbi(scores[open_], runs, moves)
    for i in np.unique(owner[tags != OUTSIDE]).tolist():
        own = slice(int(starts[i]), int(starts[i] + lengths[i]))
        first = int(part.offsets[i])
        out[i] = tagged_spans(part.data[first : int(part.offsets[i + 1])], begins[own] - first, ends[own] - first, tags[own])
    return out


def tagged_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans in code points of a text's runs of tagged words."""
    characters = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    spans: list[tuple[int, int, int]] = []
    last = -2
    for k in np.flatnonzero(tags != OUTSIDE).tolist():
        start, end = int(characters[begins[k]]), int(characters[ends[k]])
        if tags[k] == BEGIN or last != k - 1:
            spans.append((start, 3, end))
        else:
            spans[-1] = (spans[-1][0], 3, end)
        last = k
    return spans


def beyond(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of which base spans do not cover every character; both ascend."""
    merged: list[list[int]] = []
    for start, _, end in base:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out, k = [], 0
    for span in spans:
        while k < len(merged) and merged[k][1] <= span[0]:
            k += 1
        if not (k < len(merged) and merged[k][0] <= span[0] and span[2] <= merged[k][1]):
            out.append(span)
    return out


def labels(text: str) -> np.ndarray:
    """Tags of the words of a text by the fixed patterns' matches."""
    spans, out, k, last = base_spans(text), [], 0, -1
    for m in WORD.finditer(text):
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.end():
            out.append(INSIDE if last == k else BEGIN)
            last = k
        else:
            out.append(OUTSIDE)
            last = -1
    return np.array(out, np.int8)


def rewritten(word: str, alphabet: str, seed: int) -> str:
    """A bare value in place of a match's last word: drawn from an alphabet, of the word's length or up to twice as long."""
    core = re.sub(r"^[A-Za-z_]+[:=]", "", word).strip("\"'")
    draws = hashlib.shake_128(f"{seed}{word}".encode("utf-8", "surrogatepass")).digest(2 * len(core) + 1)
    return "".join(alphabet[d % len(alphabet)] for d in draws[1 : 1 + max(16, len(core) + draws[0] * min(len(core), 40) // 255)])


class Windows:
    """Training windows of up to WINDOW words, padded, as feature rows and tags: those with a match; of each text one that a hash of it picks, and the
    one with most digits, where what looks like a secret is likeliest. Those with a match come again with respects of the match hidden, and with a bare
    value in another alphabet in its place, beside harmless words of a secret's length."""

    def __init__(self, texts: list[str]) -> None:
        rows, tags, low = [], [], 0
        ends = np.cumsum([len(t) for t in texts])
        while low < len(texts):  # some texts at a time
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK_BYTES, "right")))
            self._add(texts[low:high], rows, tags)
            low = high
        self.rows = np.array(rows, np.int32).reshape(-1, WINDOW, FEATURES)
        self.tags = np.array(tags, np.int8).reshape(-1, WINDOW)

    @staticmethod
    def _add(texts: list[str], rows: list[np.ndarray], tags: list[np.ndarray]) -> None:
        part = Bytes.of(pa.array(texts, pa.large_string()))
        begins, ends, counts = part.words(PARTING)
        _, some, every = np.unique(keys_of_spans(part.data, begins, ends), return_index=True, return_inverse=True)
        raw, files, at = part.data.tobytes(), 3 * STEP + file_features(part), 0
        known = respects([raw[begins[i] : ends[i]].decode("utf-8", "replace") for i in some.tolist()])
        for text, size, file in zip(texts, counts.tolist(), files.tolist(), strict=True):
            numbers, own = known[every[at : at + size]], labels(text)
            at += size
            if not size:
                continue
            hot = set((np.flatnonzero(own != OUTSIDE) // WINDOW).tolist())
            count = -(-size // WINDOW)
            digits = np.add.reduceat(numbers[:, 3], np.arange(0, size, WINDOW))
            others = {zlib.crc32(text.encode("utf-8", "surrogatepass")) % count, int(digits.argmax())} - hot
            split = WORD.findall(text) if hot else []
            for w, copy in [*((w, None) for w in sorted(hot | others)), *((w, c) for w in sorted(hot) for c in (-1, *range(len(ALPHABETS))))]:
                near_by = numbers[w * WINDOW : (w + 1) * WINDOW].astype(np.int64) + FIRSTS
                n, here = len(near_by), own[w * WINDOW : (w + 1) * WINDOW]
                match, rest = np.flatnonzero(here != OUTSIDE), np.flatnonzero(here == OUTSIDE)
                if copy == -1:  # a hidden respect adds nothing
                    near_by[np.ix_(match, HIDDEN)] = -3 * STEP
                elif copy is not None:
                    words = split[w * WINDOW : (w + 1) * WINDOW]
                    spots = rest[:: max(1, len(rest) // len(HARMLESS))][: len(HARMLESS)]
                    last = {i for i in match.tolist() if i + 1 == n or here[i + 1] != INSIDE}
                    shown = [rewritten(words[i], ALPHABETS[copy], copy) if i in last else words[(i + 7) % n] for i in match.tolist()]
                    here = np.where(np.isin(np.arange(n), list(last)), BEGIN, OUTSIDE).astype(np.int8)
                    shown += [form.format(*(words[(i + j) % n].strip(",.")[:8].lower() for j in range(3))) for i, form in zip(spots.tolist(), HARMLESS, strict=False)]
                    near_by[np.concatenate([match, spots])] = respects(shown) + FIRSTS
                row, k, then = np.full((WINDOW, FEATURES), -1, np.int32), len(RESPECTS), len(RESPECTS) + len(NEAR)
                row[:n, :k], row[1:n, k:then], row[: n - 1, then:-1] = near_by, near_by[:-1, NEAR] + STEP, near_by[1:, NEAR] + 2 * STEP
                row[:n, -1] = file
                rows.append(np.where(row < 0, ROWS, row).astype(np.int32))
                tags.append(np.pad(here, (0, WINDOW - n), constant_values=-1))

    def gradient(self, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean negative conditional log-likelihood, by forward-backward."""
        padded, n = np.vstack([weights, np.zeros((1, 3))]), len(self.rows)
        of_weights, of_moves = np.zeros((ROWS, 3)), np.zeros((3, 3))
        for low in range(0, n, AT_ONCE):
            found = self._gradient(padded, moves, self.rows[low : low + AT_ONCE], self.tags[low : low + AT_ONCE])
            of_weights += found[0]
            of_moves += found[1]
        return of_weights / n, of_moves / n

    @staticmethod
    def _gradient(padded: np.ndarray, moves: np.ndarray, rows: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum over some windows."""
        scores = np.zeros((*tags.shape, 3))
        for k in range(rows.shape[2]):
            scores += padded[rows[:, :, k]]
        there = tags >= 0
        step = np.exp(moves)
        local = np.exp(scores - scores.max(axis=2, keepdims=True))
        forward, backward = np.zeros_like(local), np.ones_like(local)
        forward[:, 0] = local[:, 0]
        for t in range(1, WINDOW):
            forward[:, t] = (forward[:, t - 1] @ step) * local[:, t]
            forward[:, t] /= forward[:, t].sum(axis=1, keepdims=True)
        for t in range(WINDOW - 2, -1, -1):
            backward[:, t] = (backward[:, t + 1] * local[:, t + 1]) @ step.T
            backward[:, t] /= backward[:, t].sum(axis=1, keepdims=True)
            backward[:, t] = np.where(there[:, t + 1, None], backward[:, t], 1.0)
        expected = forward * backward
        expected *= there[:, :, None] / expected.sum(axis=2, keepdims=True)
        pairs = forward[:, :-1, :, None] * step * (local * backward)[:, 1:, None, :]
        pairs *= there[:, 1:, None, None] / pairs.sum(axis=(2, 3), keepdims=True)
        of_moves = pairs.sum(axis=(0, 1))
        np.subtract.at(of_moves, (tags[:, :-1][there[:, 1:]], tags[:, 1:][there[:, 1:]]), 1)
        at = np.nonzero(there)
        expected[(*at, tags[at])] -= 1
        out = np.stack([np.bincount(rows.ravel(), np.repeat(expected[:, :, k].ravel(), rows.shape[2]), ROWS + 1)[:ROWS] for k in range(3)], axis=1)
        return out, of_moves

    def descend(self, state: tuple, steps: int) -> list[np.ndarray]:
        values, squares = [x.copy() for x in state[:2]], [x.copy() for x in state[2:]]
        for _ in range(steps if len(self.rows) else 0):
            for x, g2, g in zip(values, squares, self.gradient(*values), strict=True):
                g = g + 1e-4 * x
                g2 += g * g
                x -= 0.3 * g / np.sqrt(g2)
        return [*values, *squares]


def fit(docs: DataFrame, *, rounds: int = 2, steps: int = 20, max_docs: int = 4000, max_looked: int = 60_000, max_chars: int = 50_000, workers: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves.

    The field is fitted on about max_docs texts of at most max_chars characters, half of which, if there are so many, hold a match. They are chosen
    from about max_looked texts; all choices take the smallest hashes of the text.
    """
    texts = docs.filter(f"text is not null and length(text) <= {max_chars}").select("text")
    looked = min(1.0, max_looked / max(1, docs.count()))
    texts = texts.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 20)) < looked * (1 << 20))
    likely = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    texts = texts.select("text", likely.alias("likely"))
    counts = {r.likely: r.n for r in texts.groupBy("likely").agg(F.count(F.lit(1)).alias("n")).collect()}
    state = (np.zeros((ROWS, 3)), np.zeros((3, 3)), np.full((ROWS, 3), 1e-6), np.full((3, 3), 1e-6))
    if not counts.get(True):
        state[0][:, OUTSIDE] = 1.0
        return state[0], state[1]
    rate = F.when(F.col("likely"), max_docs / 2 / counts[True]).otherwise(max_docs / 2 / counts.get(False, 1))
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < rate * (1 << 20)).select("text").repartition(workers)
    sample = stage_table(sample, "secrets")
    for _ in range(rounds):

        def local(batches: Iterator[pa.RecordBatch], now: tuple = state) -> Iterator[pa.RecordBatch]:
            forget()
            windows = Windows([t for b in batches for t in b.column("text").to_pylist()])
            found = windows.descend(now, steps)
            yield pa.RecordBatch.from_arrays([pa.array([len(windows.rows)], pa.int64()), pa.array([np.concatenate([x.ravel() for x in found]).astype(np.float32).tobytes()], pa.binary())], names=["n", "state"])

        found = [r for r in sample.coalesce(workers).mapInArrow(local, "n bigint, state binary").collect() if r.n]
        total = sum(r.n for r in found)
        mean = sum(r.n / total * np.frombuffer(r.state, np.float32).astype(np.float64) for r in found)
        cuts = np.cumsum([x.size for x in state])[:-1]
        state = tuple(x.reshape(y.shape) for x, y in zip(np.split(mean, cuts), state, strict=True))
    return state[0], state[1]


def scan(docs: DataFrame, weights: np.ndarray, moves: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of keep, __base (spans of the fixed patterns) and __added (those of the field), as start, kind, end."""
    shared, key = docs.sparkSession.sparkContext.broadcast(weights), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remember(key, lambda: WordFeatures(shared.value))
        for batch in (part for whole in batches for part in chunks(whole, text)):
            part = Bytes.of(batch.column(text))
            base = base_of(part)
            added = {i: beyond(spans, base.get(i, [])) for i, spans in decode(words, moves, part).items()}
            columns = [pa.array([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans.get(i, ())] for i in range(batch.num_rows)], kind) for spans in (base, added)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, "__base", "__added"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    needed = docs.select(*keep) if text in keep else docs.select(*keep, text)
    span = "array<struct<start: bigint, kind: string, end: bigint>>"
    return needed.mapInArrow(run, f"{kinds}, __base {span}, __added {span}")


def ordered(spans):
    """Spans by start, then kind in the order of KINDS."""
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    turned = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(turned, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256, spans, n_crf."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = scan(docs, *fit(docs), ["doc_id"])
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS[:3]), F.sha2(ordered(F.col("__base")), 256).alias("base_sha256"),
        ordered(F.concat("__base", "__added")).alias("spans"), F.size("__added").cast("long").alias("n_crf"),
    )


def redact(docs: DataFrame, *, mark: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by a mark and n_chars counted again; overlapping spans get one mark. Null texts stay null."""
    columns = docs.columns
    found = scan(docs, *fit(docs), columns)
    spans = F.array_sort(F.transform(F.concat("__base", "__added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))

    def step(done, s):
        fresh = F.concat(done["text"], F.substring("text", done["at"].cast("int") + 1, (s["start"] - done["at"]).cast("int")), F.lit(mark))
        return F.struct(F.when(s["start"] >= done["at"], fresh).otherwise(done["text"]).alias("text"), F.greatest(s["end"], done["at"]).alias("at"))

    rest = lambda done: F.concat(done["text"], F.expr("substring(text, 1, 0)"), F.substring("text", done["at"].cast("int") + 1, F.length("text")))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(F.col("text"))
    found = found.withColumn("text", clean)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else found.select(*columns)
