"""Suffix arrays of a shard of byte strings in numpy."""

from __future__ import annotations

import numpy as np


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; places past the end read as zero."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n, np.uint64)
    for off in range(min(8, n)):
        count = (n - off + 7) // 8
        out[off::8] = padded[off : off + 8 * count].view("<u8")
    return out


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces with one separator after each: bytes, piece of each place, places to its end."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    owner = np.repeat(np.arange(len(pieces)), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    return data, owner, ends[owner] - np.arange(len(data))


def suffix_array(data: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Suffixes of the joined pieces in order, by Larsson-Sadakane refinement.

    Separators sort before all bytes and among themselves by place, so all suffixes
    differ.  Groups of suffixes that agree so far are split by the rank of what
    follows, at twice the depth each time; suffixes alone in their group are left alone.
    """
    n = len(data)
    depth = 7
    symbols = np.zeros(n + depth, np.int64)
    symbols[:n] = np.where(rest > 0, data.astype(np.int64) + 1, 0)
    key = np.zeros(n, np.int64)
    for t in range(depth):
        key = (key << 9) | np.where(rest >= t, symbols[t : t + n], 0)
    sa = np.argsort(key)
    alone = (rest < depth)[sa]
    # Suffixes that end within the key differ by their separator, that is by place.
    ended = sa[alone]
    sa[alone] = ended[np.lexsort((ended, key[ended]))]
    first = np.ones(n, bool)
    first[1:] = (key[sa[1:]] != key[sa[:-1]]) | alone[1:] | alone[:-1]
    places = np.arange(n)
    start = np.maximum.accumulate(np.where(first, places, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    open_at = places[~(first & last)]
    while len(open_at):
        p = sa[open_at]
        group, onward = rank[p], rank[p + depth]
        order = np.argsort(group * (n + 1) + onward)
        p, group, onward = p[order], group[order], onward[order]
        sa[open_at] = p
        first = np.ones(len(p), bool)
        first[1:] = (group[1:] != group[:-1]) | (onward[1:] != onward[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
        rank[p] = open_at[start]
        last = np.ones(len(p), bool)
        last[:-1] = first[1:]
        open_at = open_at[~(first & last)]
        depth *= 2
    return sa


def common_prefixes(data: np.ndarray, rest: np.ndarray, sa: np.ndarray, cap: int, stripe: int = 256) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to ``cap``.

    Kasai's walk in text order: the prefix shrinks by one at most from place to place.
    The text is cut into stripes that walk in step, one vector operation for all.
    """
    n = len(sa)
    where = np.empty(n, np.int64)
    where[sa] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words = eight_bytes(data)
    words = np.concatenate([words, np.zeros(cap + 16, np.uint64)])
    prefix = np.zeros(n, np.int64)
    starts = np.arange(0, n, stripe)
    h = np.zeros(len(starts), np.int64)
    for t in range(min(stripe, n)):
        i = starts + t
        if i[-1] >= n:
            starts, h, i = starts[:-1], h[:-1], i[:-1]
        j = before[i]
        h = np.maximum(h - 1, 0)
        most = np.where(j >= 0, np.minimum(np.minimum(rest[i], rest[j]), cap), 0)
        active = np.flatnonzero(h < most)
        while len(active):
            differ = words[i[active] + h[active]] ^ words[j[active] + h[active]]
            same = differ == 0
            low = differ & (~differ + np.uint64(1))
            step = np.where(same, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            h[active] += step
            active = active[same]
            active = active[h[active] < most[active]]
        h = np.minimum(h, most)
        prefix[i] = h
    return prefix[sa]
