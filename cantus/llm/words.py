"""Vectorised word and shingle hashing over UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after
lower-casing A-Z, so it equals the character class ``[^\\x20\\x09-\\x0D]+``.
Each word gets a 64-bit polynomial hash from one running sum over the bytes
of a block, finished with an avalanche step.  Blocks hold about ``BLOCK``
bytes: memory depends on the longest word, not on the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACES = [bytes([c]) for c in (0x20, *range(0x09, 0x0E))]
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[0x41:0x5B] += 32
_U = np.uint64
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1024)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(p))])) for p in (_P, _INV)]
    return _powers[0], _powers[1]


def block_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and the byte offsets where they begin."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LOWER[raw] * up[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts]), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about BLOCK bytes, cut at white space only."""
    at = 0
    while len(data) - at > BLOCK:
        cut = max(data.rfind(c, at + 1, at + BLOCK) for c in _SPACES)
        if cut < 0:  # one word fills the block
            cut = min((k for c in _SPACES if (k := data.find(c, at + BLOCK)) >= 0), default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def words_of(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(position, word hashes) of each text in order; null counts as empty."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > BLOCK:
            yield from _flush(held)
            held, size = [], 0
            yield i, np.concatenate([block_words(p)[0] for p in _pieces(data)])
            continue
        held.append((i, data))
        size += len(data) + 1
        if size >= BLOCK:
            yield from _flush(held)
            held, size = [], 0
    yield from _flush(held)


def _flush(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
    if not held:
        return
    hashes, starts = block_words(b"\n".join(d for _, d in held))
    ends = np.cumsum([len(d) + 1 for _, d in held])
    cuts = np.searchsorted(starts, ends)
    for (i, _), lo, hi in zip(held, np.concatenate([[0], cuts[:-1]]), cuts, strict=True):
        yield i, hashes[lo:hi]


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words.

    A text with fewer words gives its whole sequence as one shingle; a text
    without words gives none.
    """
    if not len(words):
        return words
    k = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - k + 1, _U(k * 0x5851F42D4C957F2D & (1 << 64) - 1))
        for j in range(k):
            total += words[j : len(words) - k + 1 + j] * _U(pow(0xD1342543DE82EF95, j + 1, 1 << 64))
    return np.unique(mix(total))
