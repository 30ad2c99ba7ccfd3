"""Piece lattices of many words at once, over the pieces of a public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lakewarden.llm.common import MIX, KeyTable, blocks, char_matrix

#: Any odd number serves; substrings are keyed by polynomials in it, modulo 2**64.
BASE = np.uint64(0xD1342543DE82EF95)


def read_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size())]


def ordinary_ids(path: str) -> list[int]:
    """The ids of the pieces that can stand in a text: all but control pieces and those for single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [i for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]


def keys_of(chars: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each length the keys of the characters that end at each place; chars has a row for each place, a column for each word, and no zero inside a word."""
    key = chars = chars.astype(np.uint64)
    yield key
    for _ in range(1, longest):
        last, key = key, np.zeros_like(chars)
        key[1:] = last[:-1] * BASE + chars[1:]
        yield key


class PieceIndex:
    """Finds the pieces of a vocabulary in words; pieces are numbered as given."""

    def __init__(self, pieces: list[str]) -> None:
        self.longest, self.size = max(map(len, pieces)), len(pieces)
        keys = np.zeros(len(pieces), np.uint64)
        for places, block in blocks(pieces):
            lengths = np.array([len(p) for p in block])
            for k, own in enumerate(keys_of(char_matrix(block, len(block[0])).T, len(block[0])), 1):
                keys[places[lengths == k]] = own[k - 1, lengths == k]
        self.table = KeyTable()
        self.table.add(keys)
        self.seen = np.zeros(1 << 20, bool)  # most substrings are no piece, which this tells at once
        self.seen[self._short(keys)] = True

    def _short(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(44)).astype(np.int32)

    def edges(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length l (from 1): (bounds, rows, pieces). The words rows[bounds[j] : bounds[j + 1]] have these pieces as the l characters that end
        at character j (from 0). Each character of a word has an edge of length 1, whose piece is `size` if the character is none."""
        width = max(map(len, words))
        chars = np.ascontiguousarray(char_matrix(words, width).T)
        out = []
        for k, keys in enumerate(keys_of(chars, min(self.longest, width)), 1):
            inside = chars[k - 1 :] != 0
            if k > 1:
                inside &= self.seen[self._short(keys[k - 1 :])]
            at, rows = np.nonzero(inside)
            at += k - 1
            pieces = self.table.find(keys[at, rows])
            if k > 1:
                real = np.flatnonzero(pieces >= 0)
                at, rows, pieces = at[real], rows[real], pieces[real]
            else:
                pieces[pieces < 0] = self.size
            out.append((np.searchsorted(at, np.arange(width + 1)), rows, pieces))
        return out


def ending_at(edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]], j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, words, pieces) of the edges that end at character j."""
    for k, (bounds, rows, pieces) in enumerate(edges[: j + 1], 1):
        low, high = bounds[j], bounds[j + 1]
        if low < high:
            yield k, rows[low:high], pieces[low:high]
