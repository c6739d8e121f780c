"""Elias-Fano sequences, and an n-gram trie of such levels in one memory-mapped file.

A non-decreasing sequence is kept as low bits in a packed array and high parts in unary; an element is found by a rank
directory over the unary bytes and one table lookup. All calls take and give numpy arrays.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np
from pyarrow import fs

_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
#: Place of the k-th set bit of a byte.
_NTH = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], dtype=np.uint8)


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers."""

    def __init__(self, buffer, at: int = 0):
        self.n, self.low_bits, low_size, high_size = struct.unpack_from("<QIQQ", buffer, at)
        start = at + 28
        self.low = np.frombuffer(buffer, np.uint8, low_size, start)
        self.high = np.frombuffer(buffer, np.uint8, high_size, start + low_size)
        self.end = start + low_size + high_size
        self._ranks = np.cumsum(_ONES[self.high], dtype=np.int64)
        self._all: np.ndarray | None = None

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        mask = np.uint64((1 << bits) - 1)
        low = b""
        if bits and n:
            parts = []
            for a in range(0, n, 1 << 18):  # whole bytes at each cut, as 2 ** 18 is a multiple of 8
                chunk = values[a : a + (1 << 18)] & mask
                parts.append(np.packbits((chunk[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little").tobytes())
            low = b"".join(parts)
        low += b"\0" * 8
        marks = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(marks[-1]) if n else 0) // 8 + 1, dtype=np.uint8)
        np.bitwise_or.at(unary, marks >> 3, (1 << (marks & 7)).astype(np.uint8))
        return struct.pack("<QIQQ", n, bits, len(low), len(unary)) + low + unary.tobytes()

    def get(self, index: np.ndarray) -> np.ndarray:
        """Elements at the given places; many of them from the level decoded as a whole."""
        index = np.asarray(index, dtype=np.int64)
        if 8 * len(index) >= self.n:
            return self.all()[index]
        byte = np.searchsorted(self._ranks, index, side="right")
        before = np.where(byte > 0, self._ranks[byte - 1], 0)
        mark = byte * 8 + _NTH[self.high[byte], index - before]
        out = (mark - index).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            place = index * self.low_bits
            first, shift = place >> 3, (place & 7).astype(np.uint64)
            word = np.zeros(len(index), dtype=np.uint64)
            for k in range(8):
                word |= self.low[first + k].astype(np.uint64) << np.uint64(8 * k)
            word >>= shift
            if self.low_bits > 56:
                more = self.low[np.minimum(first + 8, len(self.low) - 1)].astype(np.uint64)
                word |= np.where(shift > 0, more << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
            out |= word & np.uint64((1 << self.low_bits) - 1)
        return out

    def all(self) -> np.ndarray:
        """Every element, decoded once."""
        if self._all is None:
            marks = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
            out = (marks - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
            for a in range(0, self.n if self.low_bits else 0, 1 << 18):
                b = min(self.n, a + (1 << 18))
                bits = np.unpackbits(self.low[a * self.low_bits // 8 :], count=(b - a) * self.low_bits, bitorder="little").reshape(b - a, self.low_bits)
                for k in range(self.low_bits):
                    out[a:b] |= bits[:, k].astype(np.uint64) << np.uint64(k)
            self._all = out
        return self._all

    def search(self, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First place in [low, high) whose element is not under ``wanted``, else high; all three are arrays.

        Few questions are answered element by element; as many as an eighth of the elements, from the level decoded as a whole.
        """
        if 8 * len(wanted) >= self.n:
            return np.clip(np.searchsorted(self.all(), wanted), low, high)
        low, high = low.astype(np.int64).copy(), high.astype(np.int64).copy()
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            less = self.get(middle) < wanted[active]
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
            active = active[low[active] < high[active]]
        return low


def stored(data: bytes, path: str, keep: bool = True):
    """The bytes written to ``path`` (a URI) and opened again: memory-mapped where the path is a local or mounted file, else read.

    Without ``keep`` the name goes once the file is open, and the file with its last reader.
    """
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(data)
    if isinstance(system, fs.LocalFileSystem):
        with open(place, "rb") as file:
            out = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with system.open_input_file(place) as file:
            out = file.read()
    if not keep:
        system.delete_file(place)
    return out


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1 to 255, and the 256 numbers they stand for (code 0: 0). Each code stands for the mean of a quantile bin, so few different values stay near exact."""
    distinct = np.unique(values)
    if len(distinct) > 255:
        distinct = np.unique(np.quantile(np.sort(values), (np.arange(255) + 0.5) / 255, method="nearest"))
    place = np.clip(np.searchsorted(distinct, values), 0, max(0, len(distinct) - 1))
    if len(distinct):
        lower = np.maximum(place - 1, 0)
        place = np.where(np.abs(distinct[lower] - values) < np.abs(distinct[place] - values), lower, place)
    book = np.zeros(256, dtype="<f4")
    sums, times = np.bincount(place, weights=values, minlength=255), np.bincount(place, minlength=255)
    book[1:] = sums / np.maximum(1, times)
    return (place + 1).astype(np.uint8), book


class Trie:
    """N-grams of up to three words around the middle one: words, their successors, their predecessors, and those pairs' successors.

    All four levels are monotone: a level's entry is its parent's place times the size of what it counts in, plus its own number, and pointers
    tell where a parent's entries begin. The last level counts a third word by its place among the successors of the second, not in
    the vocabulary (which takes fewer bits), so a query goes: find the middle word, search the third among its successors (the shorter n-gram, to back off to), search
    the first among its predecessors, then the third's place inside that pair.
    """

    LEVELS = ("middles", "thirds", "firsts", "to_successors", "successors", "to_predecessors", "predecessors", "to_triples", "triples")
    CODES = ("two", "weight", "three")  # probability of a pair, weight of what backs off from a pair, probability of a triple

    def __init__(self, buffer):
        *self.sizes, self.places = struct.unpack_from("<QQQ", buffer, 0)
        at = 24
        for name in self.LEVELS:
            level = EliasFano(buffer, at)
            setattr(self, name, level)
            at = level.end
        for name, level in zip(self.CODES, (self.successors, self.predecessors, self.triples)):
            setattr(self, f"{name}_book", np.frombuffer(buffer, "<f4", 256, at))
            setattr(self, name, np.frombuffer(buffer, np.uint8, level.n, at + 1024))
            at += 1024 + level.n

    @staticmethod
    def pack(middles: np.ndarray, thirds: np.ndarray, firsts: np.ndarray, pairs: tuple, contexts: tuple, triples: tuple) -> bytes:
        """Sorted keys of the words in each place, and sorted entries: pairs (middle, third, probability), contexts (middle, first, weight)
        and triples (context, third, probability), all as places in what is given before."""
        pair_middle, pair_third, two = pairs
        context_middle, context_first, weight = contexts
        triple_context, triple_third, three = triples
        n2, n1 = max(1, len(thirds)), max(1, len(firsts))
        successors = pair_middle.astype(np.uint64) * np.uint64(n2) + pair_third.astype(np.uint64)
        to_successors = np.searchsorted(pair_middle, np.arange(len(middles) + 1))
        middle = context_middle[triple_context] if len(triple_context) else triple_context
        spot = np.searchsorted(successors, middle.astype(np.uint64) * np.uint64(n2) + triple_third.astype(np.uint64)) - to_successors[middle]
        places = int(np.diff(to_successors).max()) if len(middles) else 1
        levels = (
            middles, thirds, firsts, to_successors, successors,
            np.searchsorted(context_middle, np.arange(len(middles) + 1)), context_middle.astype(np.uint64) * np.uint64(n1) + context_first.astype(np.uint64),
            np.searchsorted(triple_context, np.arange(len(context_middle) + 1)), triple_context.astype(np.uint64) * np.uint64(max(1, places)) + spot.astype(np.uint64),
        )
        out = struct.pack("<QQQ", n2, n1, max(1, places)) + b"".join(EliasFano.pack(v) for v in levels)
        for values in (two, weight, three):
            code, book = quantised(values)
            out += book.tobytes() + code.tobytes()
        return out

    @staticmethod
    def find(level: EliasFano, keys: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Places of keys in a level (within [low, high) where given), -1 for those that are not in it."""
        n = len(keys)
        if not level.n or not n:
            return np.full(n, -1, dtype=np.int64)
        high = np.full(n, level.n, np.int64) if high is None else high
        at = level.search(keys, np.zeros(n, np.int64) if low is None else low, high)
        good = at < high
        good[good] = level.get(at[good]) == keys[good]
        return np.where(good, at, -1)

    def pair(self, middle: tuple, third: tuple) -> np.ndarray:
        """Place among the successors of each (middle word, third word), or -1. A word in a question is (different keys, which of them)."""
        return self._successor(self._word(self.middles, middle), self._word(self.thirds, third))

    def _word(self, level: EliasFano, asked: tuple) -> np.ndarray:
        keys, which = asked
        return self.find(level, keys)[which]

    def _below(self, parent: np.ndarray, number: np.ndarray, size: int, pointers: EliasFano, level: EliasFano) -> np.ndarray:
        out = np.full(len(parent), -1, dtype=np.int64)
        ask = np.flatnonzero((parent >= 0) & (number >= 0))
        p = parent[ask]
        low, high = pointers.get(p).astype(np.int64), pointers.get(p + 1).astype(np.int64)
        out[ask] = self.find(level, p.astype(np.uint64) * np.uint64(size) + number[ask].astype(np.uint64), low, high)
        return out

    def _successor(self, middle: np.ndarray, third: np.ndarray) -> np.ndarray:
        return self._below(middle, third, self.sizes[0], self.to_successors, self.successors)

    def triple(self, middle: tuple, first: tuple, third: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of pair, back-off weight and triple for each (middle, first, third), words as in ``pair``; 0 where that n-gram or context is not known."""
        word = self._word(self.middles, middle)
        pair = self._successor(word, self._word(self.thirds, third))
        context = self._below(word, self._word(self.firsts, first), self.sizes[1], self.to_predecessors, self.predecessors)
        spot = np.where(pair >= 0, pair - self.to_successors.get(np.maximum(word, 0)).astype(np.int64), -1) if self.middles.n else pair
        triple = self._below(context, spot, self.places, self.to_triples, self.triples)
        return tuple(_coded(codes, at) for codes, at in ((self.two, pair), (self.weight, context), (self.three, triple)))


def _coded(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, codes[np.maximum(at, 0)], 0).astype(np.uint8) if len(codes) else np.zeros(len(at), np.uint8)
