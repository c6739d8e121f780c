"""Alignment of two tokenizers' ids over the same bytes, by diagonal run skipping, and how often ids are linked in a whole corpus.

Both encodings of a text cover the same bytes, so each is known by its tokens' end offsets, an ascending array. Where both have an end, a group of tokens of
the one equals a group of the other. From a common end on, the arrays are compared at the current shift of their indexes, in stretches of doubling
length as long as they are equal, then of halving length: one-to-one stretches are jumped over in few comparisons. Where the ends differ, the smaller one moves on until
both are equal again: an irregular group, after which the shift is another.

Texts are encoded by the libraries, in chunks that neither tokenizer joins: cut before a space that follows anything but white space and does not end the text (or, where each space stands
before a word, before each space). A worker keeps the ids of the chunks it has met (bounded), so each word is encoded about once; alignment runs over whole texts.

The corpus is cut into blocks. A block keeps its links as numbers in its list of different pairs, sends each different pair once with its count, and gets back
the pair's count over the corpus, and whether it is the highest of its B id.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .bpe_words import LONG_SPACE, encoder, shown_bytes
from .common import delete_table, split_batches, written

BLOCK_BYTES = 2 << 20
#: Chunks that a worker remembers, and their greatest length in characters.
MEMO_ENTRIES, MEMO_CHARS = 100_000, 48
SPACE = "▁"
_CUT = re.compile(r"(?<=\S)(?= [\s\S])")
_SPACE_BEFORE_SPACE = re.compile(r" (?:\s|$)")
_LOADED: dict[tuple[str, str], BothTokenizers] = {}


def matched(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-to-one stretches (i, j, n) of the common ends: ends_a[i + k] == ends_b[j + k] for k < n. Each common end is in one stretch, in order."""
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b, w = ends_a.tobytes(), ends_b.tobytes(), ends_a.itemsize
    found: list[int] = []
    i = j = 0
    most_a, most_b = len(a), len(b)
    while i < most_a and j < most_b:
        x, y = a[i], b[j]
        while x != y:  # an irregular group: the smaller end moves on
            if x < y:
                i += 1
                if i == most_a:
                    break
                x = a[i]
            else:
                j += 1
                if j == most_b:
                    break
                y = b[j]
        if x != y:
            break
        # at this shift: compare stretches of doubling length while they are equal, then of halving length
        n, step, left = 1, 1, min(most_a - i, most_b - j)
        at_a, at_b = w * i + w, w * j + w
        size = w
        while n + step <= left and raw_a[at_a : at_a + size] == raw_b[at_b : at_b + size]:
            n, at_a, at_b, step, size = n + step, at_a + size, at_b + size, 2 * step, 2 * size
        while step > 1:
            step, size = step // 2, size // 2
            if n + step <= left and raw_a[at_a : at_a + size] == raw_b[at_b : at_b + size]:
                n, at_a, at_b = n + step, at_a + size, at_b + size
        found += (i, j, n)
        i += n
        j += n
    i, j, n = np.array(found, dtype=np.int64).reshape(-1, 3).T
    return i, j, n


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of both sides that end together."""
    i, j, n = matched(ends_a, ends_b)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(i, n) + within, np.repeat(j, n) + within


class BothTokenizers:
    """Ids and token bytes of both files: a byte-level one of the tokenizers library and one of sentencepiece."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.encoding = getattr(encoder(path_a), "encoding", None)
        self.library = Tokenizer.from_file(path_a)
        self.library.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown, size = shown_bytes(), self.library.get_vocab_size()
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [t.encode() if t in added else bytes(shown[c] for c in t) for t in tokens]
        b = self.pieces
        names = [b.id_to_piece(i) for i in range(b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.length_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.length_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        #: Ids in decimal, each followed by what may stand behind it: within a side, between the sides, between groups.
        self.shown = np.array([f"{i}{mark}" for mark in ",|;" for i in range(max(size, len(names)))], dtype=object)
        self.memo: dict[str, tuple[list[int], list[int]] | None] = {}

    def encode_a(self, chunk: str) -> list[int]:
        """Ids of a chunk; special tokens' strings are plain text."""
        encoding = self.encoding
        if encoding is None or len(chunk) >= 10_000 and LONG_SPACE.search(chunk):
            return self.library.encode(chunk, add_special_tokens=False).ids
        return encoding.encode_ordinary(chunk)

    def chunks(self, text: str) -> list[str]:
        """Pieces of space + text that no token crosses, each with the space before it."""
        whole = " " + text
        if not _SPACE_BEFORE_SPACE.search(whole):
            return [" " + w for w in whole.split(" ")[1:]]
        return _CUT.split(whole)

    @staticmethod
    def _covers(lists: list[list[int]], table: list[bytes], length: np.ndarray, raw: list[bytes]) -> bool:
        """Whether each list's token bytes are the chunk's: all of them end to end are equal, and so is each one's length."""
        flat = list(chain.from_iterable(lists))
        if b"".join(map(table.__getitem__, flat)) != b"".join(raw):
            return False
        ends = np.append(0, np.cumsum(length[np.array(flat, dtype=np.int64)]))
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.array_equal(np.diff(ends[np.append(0, np.cumsum(count))]), np.fromiter(map(len, raw), np.int64, len(raw)))

    def encode(self, chunks: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides of different chunks; None where the bytes of a side are not the chunk's."""
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:  # keep what was met early: the frequent chunks
            for k in list(memo)[MEMO_ENTRIES // 2 :]:
                del memo[k]
        new = [c for c in chunks if c not in memo]
        side_a, side_b = [self.encode_a(c) for c in new], self.pieces.encode([c[1:] for c in new])
        raw = [c.encode() for c in new]
        if self._covers(side_a, self.bytes_a, self.length_a, raw) and self._covers(side_b, self.bytes_b, self.length_b, raw):
            found = dict(zip(new, zip(side_a, side_b)))
        else:  # some chunk's bytes differ: look at each
            join = lambda table, ids: b"".join(map(table.__getitem__, ids))
            found = {c: (x, y) if join(self.bytes_a, x) == r == join(self.bytes_b, y) else None for c, r, x, y in zip(new, raw, side_a, side_b)}
        out = [memo[c] if c in memo else found[c] for c in chunks]
        memo.update((c, v) for c, v in found.items() if len(c) <= MEMO_CHARS)
        return out


def loaded(path_a: str, path_b: str) -> BothTokenizers:
    """The Python worker's tokenizers."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = BothTokenizers(path_a, path_b)
    return _LOADED[path_a, path_b]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The lists number ``codes``, end to end, of lists that stand in ``flat``."""
    many = lengths[codes]
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return flat[np.repeat(starts[codes], many) + within]


class Aligned:
    """Texts encoded and aligned: ids of both sides end to end (``a``, ``b``), tokens of each text, and the tokens of both that end together."""

    def __init__(self, both: BothTokenizers, texts: list[str | None]):
        cut = [both.chunks(t) if t and SPACE not in t else [] for t in texts]  # a text with U+2581 has other bytes in B
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        number = {c: k for k, c in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
        codes = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, int(count.sum()))
        ids = both.encode(list(number))
        owner = np.repeat(np.arange(len(texts)), count)
        broken = np.fromiter((x is None for x in ids), bool, len(ids))
        good = np.ones(len(texts), dtype=bool)
        good[owner[broken[codes]]] = False
        codes, owner = codes[good[owner]], owner[good[owner]]
        sides = []
        for k in (0, 1):
            lists = [x[k] if x else [] for x in ids]
            length = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(length.sum()))
            n = np.bincount(owner, weights=length[codes], minlength=len(texts)).astype(np.int64) if len(codes) else np.zeros(len(texts), np.int64)
            sides.append((gathered(flat, np.cumsum(length) - length, length, codes), n))
        (self.a, self.n_a), (self.b, self.n_b) = sides
        self.both = both
        # texts lie end to end and have the same bytes on both sides, so the end of a text is a common end
        self.link_a, self.link_b = common_ends(np.cumsum(both.length_a[self.a]), np.cumsum(both.length_b[self.b]))
        self.n_groups = np.diff(np.searchsorted(self.link_a, np.cumsum(self.n_a)), prepend=0)

    def group_strings(self) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``, '' without tokens."""
        groups = np.arange(len(self.link_a))
        of_a = np.repeat(groups, np.diff(self.link_a, prepend=-1))
        of_b = np.repeat(groups, np.diff(self.link_b, prepend=-1))
        # a token stands behind the other side's tokens of earlier groups, B's also behind A's of its own
        before_a = np.append(0, self.link_b[:-1] + 1)[of_a] if len(groups) else of_a
        place = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        at_a, at_b = np.arange(len(self.a)) + before_a, np.arange(len(self.b)) + self.link_a[of_b] + 1
        size = len(self.both.shown) // 3
        place[at_a], place[at_b] = self.a, self.b
        place[at_a[self.link_a]] += size
        place[at_b[self.link_b]] += 2 * size
        ends = np.cumsum(self.n_a + self.n_b)
        return ["".join(self.both.shown[place[e - n : e]])[:-1] for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist())]


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers under 2 ** 32 as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


ROWS = "n_a long, n_b long, n_groups long, groups_sha256 string"


def aligned_blocks(df: DataFrame, key: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """The corpus in blocks: keys and ``ROWS`` of its texts as arrays, the block's different pairs (a << 32 | b, ascending) with their counts, and the links as numbers of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = loaded(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in (s for b in batches for s in split_batches([b], "t", rows=1 << 20, size=BLOCK_BYTES)):
            x = Aligned(both, batch.column("t").to_pylist())
            pairs, place, times = np.unique(x.a[x.link_a] << 32 | x.b[x.link_b], return_inverse=True, return_counts=True)
            sha = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in x.group_strings()]
            lists = [batch.column("k"), *map(pa.array, (x.n_a, x.n_b, x.n_groups, sha, pairs, times))]
            held = [pa.ListArray.from_arrays([0, len(v)], v) for v in lists]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *held, pa.array([_squeezed(place)], pa.binary())], names=names)
            number += 1

    names = ["block", "keys", "n_a", "n_b", "n_groups", "sha", "pairs", "times", "links"]
    kind = df.schema[key].dataType
    schema = f"block long, keys array<{kind.simpleString()}>, n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, pairs array<long>, times array<long>, links binary"
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus hold each pair of ids (a << 32 | b), and whether no pair of its B id has more."""
    spark = blocks.sparkSession
    each = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    each = written(spark, each, "pair-counts")
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1).alias("b")
    most = each.groupBy(b_id).agg(F.max("count").alias("most"))
    out = written(spark, each.select(b_id, "pair", "count").join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    delete_table(spark, each)
    return out


def aligned_digests(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    ``path_a``: a byte-level file of the tokenizers library, which encodes space + text; ``path_b``: a sentencepiece BPE file, which adds the space itself.
    Special tokens' strings are plain text. ``n_links``: A and B tokens that end at the same byte; ``n_best`` and ``count_sum`` take the pair's count
    over all rows. A null or empty text, and one whose tokens' bytes are not the text's, has zeros and ''. Keys may be null or repeat: each row has its own
    result. Other columns are dropped, whatever their names; texts of any length are read whole; an empty table gives an empty one.
    """
    spark = df.sparkSession
    blocks = written(spark, aligned_blocks(df, key, text, path_a, path_b), "aligned-blocks", compression="zstd")
    counts = pair_counts(blocks)
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").select("of", "pair", "count", "best")

    def tell(mine: pa.Table, got: pa.Table) -> pa.Table:
        order = np.argsort(got.column("pair").to_numpy())  # as the block's list of pairs ascends
        count, best = got.column("count").to_numpy()[order], got.column("best").to_numpy()[order].astype(np.int64)
        out = []
        for row in mine.to_batches():
            keys, n_a, n_b, groups, sha = (row.column(c).flatten() for c in ("keys", "n_a", "n_b", "n_groups", "sha"))
            links = _spread(row.column("links")[0].as_py()) if row.num_rows else np.zeros(0, np.int64)
            ends = np.cumsum(groups.to_numpy())
            total = [np.append(0, np.cumsum(x[links])) for x in (count, best)]
            sums = [t[ends] - t[ends - groups.to_numpy()] for t in total]
            out.append(pa.Table.from_arrays([keys, n_a, n_b, groups, groups, pa.array(sums[1]), pa.array(sums[0]), sha], names=columns))
        return pa.concat_tables(out)

    columns = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    fields = [StructField(key, df.schema[key].dataType), *StructType.fromDDL(", ".join(f"{c} long" for c in columns[1:-1]) + ", groups_sha256 string").fields]
    return blocks.select("block", "keys", "n_a", "n_b", "n_groups", "sha", "links").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(tell, StructType(fields))
