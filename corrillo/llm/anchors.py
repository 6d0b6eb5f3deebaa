"""Anchors of 50-byte strings: which positions of a text stand for all its substrings of that length.

A substring of SPAN bytes holds SPAN - GRAM + 1 grams of GRAM bytes; its anchor is the first one with the least hash.
Equal substrings have their anchor at the same place, so comparing what lies around equal anchors finds every equal
pair, with about one anchor for 14 bytes.

Each anchor is cut in two by the offset it has in its substrings: up to HALF, all of them hold the CORE bytes from the
anchor on; beyond HALF, the CORE bytes that end with the gram. Halves meet by their core, which is longer than the gram,
so that a gram that very many texts have in different surroundings is no hot key.
"""

from __future__ import annotations

import numpy as np

from corrillo.llm.shingles import mixed

SPAN, GRAM = 50, 24
SPREAD = SPAN - GRAM + 1
#: The largest offset of an anchor that stands for the bytes to its right, and the bytes that all substrings of a half share.
HALF = SPREAD // 2
CORE = SPAN - HALF
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 15
U64 = np.uint64


def powers(n: int) -> np.uint64:
    return U64(pow(BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every position of uint8 `data` (GRAM - 1 positions fewer), by doubling."""
    h1 = data.astype(U64) + U64(1)
    h2 = h1[:-1] * powers(1) + h1[1:]
    h4 = h2[:-2] * powers(2) + h2[2:]
    h8 = h4[:-4] * powers(4) + h4[4:]
    h16 = h8[:-8] * powers(8) + h8[8:]
    h = h16[:-8] * powers(8) + h8[16:]
    h ^= h >> U64(31)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    return h


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: anchor positions, and the first and last start of the substrings they stand for."""
    n = len(data)
    if n < SPAN:
        none = np.empty(0, np.int64)
        return none, none, none
    at, first = [], []
    last = -1
    for lo in range(0, n - SPAN + 1, BLOCK):
        hi = min(lo + BLOCK, n - SPAN + 1)  # starts lo..hi-1
        h = gram_hashes(data[lo : hi + SPAN - 1])
        key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        m = np.minimum(key[:-1], key[1:])
        m = np.minimum(m[:-2], m[2:])
        m = np.minimum(m[:-4], m[4:])
        m = np.minimum(m[:-8], m[8:])  # 16 grams
        m = np.minimum(m[: hi - lo], m[SPREAD - 16 : SPREAD - 16 + hi - lo])
        p = (m & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(p, prepend=last - lo) != 0)
        at.append(p[new] + lo)
        first.append(new + lo)
        last = int(p[-1]) + lo
    at, first = np.concatenate(at), np.concatenate(first)
    return at, first, np.append(first[1:], n - SPAN + 1) - 1


def halves_of(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors cut in two: which anchor, first and last start, and whether it stands for the bytes to its left."""
    cut = at - HALF  # starts from here on have the anchor at HALF at most
    right, left = np.flatnonzero(last >= cut), np.flatnonzero(first < cut)
    which = np.concatenate([right, left])
    firsts = np.concatenate([np.maximum(first, cut)[right], first[left]])
    lasts = np.concatenate([last[right], np.minimum(last, cut - 1)[left]])
    return which, firsts, lasts, np.arange(len(which)) >= len(right)


def core_hashes(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A 64-bit hash, evenly spread, of the core of each half at `at`."""
    if not len(at):
        return np.empty(0, U64)
    words = np.ndarray(len(data) - 7, U64, data, strides=(1,))  # eight bytes from every position
    begin = at - np.where(left, CORE - GRAM, 0)
    h = mixed(left.astype(U64) + U64(BASE))
    for k in (*range(0, CORE - 8, 8), CORE - 8):
        h = mixed(h * U64(BASE) + words[begin + k])
    return h


def anchors_of_all(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The halves of many texts' anchors, laid end to end: text number, position in `data`, core hash, first and last start in `data`; data and the texts' offsets."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    parts = [anchors_of(data[a:b]) for a, b in zip(offsets, offsets[1:])]
    number = np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts])
    at, first, last = (np.concatenate([np.empty(0, np.int64), *(p[i] for p in parts)]) + offsets[number] for i in range(3))
    which, first, last, left = halves_of(at, first, last)
    return number[which], at[which], core_hashes(data, at[which], left), first, last, data, offsets
