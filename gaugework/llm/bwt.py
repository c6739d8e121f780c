"""Repeated substrings of a pool of byte strings, by interval expansion on its Burrows-Wheeler transform.

From the empty string on, every interval of suffixes with a common prefix is extended backwards by each byte that stands
before one of them. Level by level this meets the boundaries between neighbouring suffixes in order of their common prefix:
level l settles those of exactly l bytes. It stops at the minimum length: boundaries not met by then are between
suffixes that agree on at least that many bytes. The rows between two met boundaries are one interval; its weight is the number of
times its prefix occurs, as each row weighs as much as its string has copies.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of the strings laid end to end, each closed by a 0, by at least ``depth`` symbols; ties in any order.

    ``text``: symbols 1 to 256 and the closing zeros; ``end``: for each position the place of its string's 0. Nothing beyond that 0 counts.
    Prefix doubling; each step sorts ranks and places packed in one number where they fit.
    """
    n = len(text)
    place = np.arange(n, dtype=np.int64)
    left = end - place  # symbols from a position to its closing 0
    bits = np.uint64(n.bit_length())
    packed = 3 * int(bits) <= 64
    known = min(4, (64 - int(bits)) // 9)
    key = text.astype(np.uint64)
    for k in range(1, known):
        key <<= np.uint64(9)
        inside = np.flatnonzero(left >= k)
        key[inside] |= text[inside + k].astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    numbers = place.astype(np.uint64)
    rank = np.empty(n, dtype=np.uint64)
    while True:
        if packed:
            both = key << bits | numbers
            both.sort()
            order = (both & mask).astype(np.int64)
            both >>= bits
        else:
            order = np.argsort(key)
            both = key[order]
        new = np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(both[1:], both[:-1], out=new[1:])
        rank[order] = np.cumsum(new, dtype=np.uint64)
        if known >= depth or int(rank[order[-1]]) == n:
            return order
        later = np.zeros(n, dtype=np.uint64)
        inside = np.flatnonzero(left >= known)
        later[inside] = rank[inside + known]
        key = rank << (bits if packed else np.uint64(32)) | later
        known *= 2


def repeated_suffixes(strings: list[bytes], least: int, weights: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each string and place (laid end to end, a closing place after each string): whether the ``least`` bytes from there occur twice or more in the pool; and the
    place of each string's first byte. A string of weight w stands for w equal ones. Matches never run over the end of a string."""
    sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = int(sizes.sum())
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    text[ends] = 0
    end = np.repeat(ends, sizes)
    order = sorted_suffixes(text, end, least)
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    before = np.where(first[order], np.uint16(0), text[order - 1])  # 0: nothing before, not extended

    by_byte = np.argsort(before, kind="stable").astype(np.int32)
    bytes_sorted = before[by_byte]
    count = np.bincount(text, minlength=258)
    base = np.concatenate(([0], np.cumsum(count)))
    group_start = np.concatenate(([0], np.cumsum(np.bincount(before, minlength=258))))
    follows = np.empty(n, dtype=np.int32)  # row of the suffix that is one byte longer
    follows[by_byte] = (base[bytes_sorted] - group_start[bytes_sorted]) + np.arange(n)
    # for each row: the nearest row of the same preceding byte on either side, and where a run of equal bytes ends
    earlier, later = np.full(n, -1, dtype=np.int32), np.full(n, n, dtype=np.int32)
    same = np.flatnonzero(bytes_sorted[1:] == bytes_sorted[:-1])
    earlier[by_byte[same + 1]] = by_byte[same]
    later[by_byte[same]] = by_byte[same + 1]
    change = np.flatnonzero(np.append(before[1:] != before[:-1], True))
    run_end = np.repeat(change, np.diff(np.append(-1, change))).astype(np.int32) + np.int32(1)

    met = np.zeros(n + 1, dtype=bool)
    met[0] = met[n] = True
    strings_count = len(strings)
    # level 0: one interval for each byte that occurs, and one for each closing mark, all of which differ
    edges = np.concatenate((np.arange(strings_count), base[1:258][count[1:] > 0] if n > strings_count else np.zeros(0, np.int64)))
    low = edges.astype(np.int32)
    high = np.append(low[1:], np.int32(n))
    met[high] = True
    for _ in range(1, least):
        if not len(low):
            break
        single = run_end[low] >= high
        keep = np.flatnonzero(single & (before[low] > 0))
        child_low, child_high = follows[low[keep]], follows[high[keep] - 1] + np.int32(1)
        wide = np.flatnonzero(~single)
        if len(wide):
            a, b = low[wide], high[wide]
            size = b - a
            rows = np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            good = before[rows] > 0
            opens = follows[rows[good & (earlier[rows] < np.repeat(a, size))]]
            closes = follows[rows[good & (later[rows] >= np.repeat(b, size))]]
            child_low = np.concatenate((child_low, np.sort(opens)))
            child_high = np.concatenate((child_high, np.sort(closes) + np.int32(1)))
        new = ~met[child_high]
        low, high = child_low[new], child_high[new]
        met[high] = True
    interval = np.cumsum(met[:n]) - 1
    weight = np.repeat(np.ones(strings_count) if weights is None else np.asarray(weights, dtype=float), sizes)
    often = np.bincount(interval, weights=weight[order])[interval] > 1
    out = np.zeros(n, dtype=bool)
    out[order] = often
    return out & (end - np.arange(n) >= least), starts
