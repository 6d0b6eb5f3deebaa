"""Hashed word shingles of many texts at once, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
BATCH_BYTES = 1 << 20
U64 = np.uint64
BASE = 0xD6E8FEB86659FD93
STEP = U64(0x9E3779B97F4A7C15)
#: A-Z to lower case; ASCII that is neither letter nor digit to a blank.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Powers:
    """BASE ** j and BASE ** -j modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            raised = lambda base: np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, base, U64), dtype=U64)])
            self.up, self.down = raised(BASE), raised(pow(BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of bytes that are not blanks, by differences of a prefix polynomial."""
    up, down = powers.upto(len(data) + 1)
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * up[:-1], dtype=U64)])
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, mixed((prefix[ends] - prefix[starts]) * down[starts])


def batches(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > BATCH_BYTES:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(text)
    if texts:
        yield first, texts[first:]


def shingles(texts: list[bytes], bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle (a hash of `bits` bits) and its count in the text, sorted by the first two.

    A text of fewer than WORDS words, but not none, has one shingle.
    """
    powers, out = Powers(), []
    for first, group in batches(texts):
        data = np.frombuffer(b" ".join(group).translate(TO_WORDS), np.uint8)
        offsets = np.cumsum([0, *(len(t) + 1 for t in group)])
        starts, words = word_hashes(data, powers)
        text = np.searchsorted(offsets, starts, side="right") - 1
        n = np.bincount(text, minlength=len(group))
        size = np.minimum(n, WORDS)
        ordinal = np.arange(len(text)) - (np.cumsum(n) - n)[text]
        begins = np.flatnonzero(ordinal <= (n - size)[text])
        code = np.zeros(len(begins), U64)
        for k in range(WORDS):
            there = k < size[text[begins]]
            code = np.where(there, mixed(code * STEP + words[np.minimum(begins + k, len(words) - 1)]), code) if len(begins) else code
        code >>= U64(64 - bits)
        number = text[begins]
        order = np.lexsort((code, number))
        number, code = number[order], code[order]
        fresh = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(code, prepend=~code[:1]) != 0)) if len(code) else np.empty(0, np.int64)
        out.append((number[fresh] + first, code[fresh], np.diff(np.append(fresh, len(code)))))
    if not out:
        return np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))
