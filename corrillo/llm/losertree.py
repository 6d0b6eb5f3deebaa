"""A loser tree over sorted runs of strings that never compares a known common prefix again.

Each run gives (lcp, key): the key and how many bytes it shares with the run's key before. Every node keeps the loser
of its match with the bytes it shared with the winner. Against the last winner of all, the candidate with the longer
common prefix is the smaller one; only candidates with equal prefixes are compared, from there on.
"""

from __future__ import annotations

from collections.abc import Iterator


def common(a: bytes, b: bytes, start: int) -> int:
    """Bytes that a and b share, known to be `start` at least; keys have one length."""
    if a == b:
        return len(a)
    low, high = start, len(a)
    while high - low > 8:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    while a[low] == b[low]:
        low += 1
    return low


def merge(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """(lcp with the key before, key, payload) of all runs in order; equal keys follow each other."""
    k = max(1, len(runs))
    width = 1 << (k - 1).bit_length()
    heads: list = [next(iter_, None) for iter_ in runs] + [None] * (width - len(runs))
    lcps = [0] * width  # of each head with the last winner
    losers = [-1] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads; the loser's lcp becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = lcps[a], lcps[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, t = x[1], y[1]
        same = common(s, t, p)
        if same == len(s) or s[same] < t[same]:
            lcps[b] = same
            return a, b
        lcps[a] = same
        return b, a

    level = list(range(width))
    at = width >> 1
    while at:
        following = []
        for i in range(at):
            won, lost = play(level[2 * i], level[2 * i + 1])
            losers[at + i] = lost
            following.append(won)
        level, at = following, at >> 1
    winner = level[0]
    while heads[winner] is not None:
        yield (lcps[winner], *heads[winner][1:])
        head = heads[winner] = next(runs[winner], None)
        if head is not None:
            lcps[winner] = head[0]
        node = (winner + width) >> 1
        while node:
            other = losers[node]
            winner, losers[node] = play(winner, other)
            node >>= 1
