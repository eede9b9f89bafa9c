"""Texts as blocks of bytes for numpy: words, their hashes, and blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def blocks(texts) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts in UTF-8), each block of about ``BLOCK_BYTES`` or one longer text; null is empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8")
        if held and size + len(raw) > BLOCK_BYTES:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def space_separated() -> np.ndarray:
    """Which bytes belong to words that end at a blank or at one of tab to carriage return."""
    inside = np.ones(256, dtype=bool)
    inside[[32, *range(9, 14)]] = False
    return inside


def letters_only() -> np.ndarray:
    """Which bytes belong to words of letters: ASCII letters and everything outside ASCII."""
    inside = np.zeros(256, dtype=bool)
    inside[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return inside


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class WordHasher:
    """64-bit hashes of all words of a block, ASCII letters in lower case."""

    def __init__(self, inside: np.ndarray):
        self.inside, self.codes = inside, _BYTES[ascii_lower()]
        self.powers = np.ones(64, dtype=np.uint64)
        self._extend(64)

    def _extend(self, longest: int) -> None:
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _ODD)]), dtype=np.uint64)

    def __call__(self, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, offset of every text's first word, with the end)."""
        (hashes,), offsets = self.heads(held, ())
        return hashes, offsets

    def heads(self, held: list[bytes], sizes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
        """As a call, with the hashes of all words' first bytes for each of ``sizes`` after the hashes of the words."""
        data = np.frombuffer(b" ".join(held) + b" ", dtype=np.uint8)
        inside = self.inside[data]
        inside[-1] = False
        ends_of_texts = np.cumsum([len(x) + 1 for x in held])
        inside[ends_of_texts - 1] = False
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.searchsorted(starts, ends_of_texts)])
        if not len(starts):
            return [np.zeros(0, dtype=np.uint64)] * (1 + len(sizes)), offsets
        lengths = ends - starts
        if lengths.max() > len(self.powers):
            self._extend(int(lengths.max()))
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(lengths.sum()) - np.repeat(first, lengths)
        terms = self.codes[data[inside]] * self.powers[place]
        found = [mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))]
        for size in sizes:
            kept = np.where(place < size, terms, np.uint64(0))
            found.append(mix(np.add.reduceat(kept, first) + np.minimum(lengths, size).astype(np.uint64)))
        return found, offsets


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` words; a shorter text is one run; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = total * _ODD + words[i : n - width + 1 + i]
            total ^= total >> np.uint64(31)
        return mix(total + np.uint64(width))
