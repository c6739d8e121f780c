"""Trigram scores from sharded Elias-Fano tries.

The corpus is read once, into blocks: the documents of some megabytes as numbers in the block's own vocabulary. Each block then
asks for what it needs only, once for each distinct word and word triple, and brings its training counts with the question. Questions
are dealt to shards by the triple's middle word, where its pairs (middle, third) and contexts (first, middle) are whole too; a shard adds up the
counts, writes its trie to the shared folder, maps the file and answers from it by key. Middle words so frequent that one shard
would grow with the corpus are spread by first word, their pairs by third word, and contexts so frequent by third word; the driver has the exact counts of those
alone, a bounded number for each shard. Middle words are known by 64-bit hashes, first and third words by 32 bits beside them.
Nothing of the size of the corpus, its vocabulary or its n-grams passes through the driver.

P(w | u v) = (c(u v w) - D) / c(u v) + D * n(u v) / c(u v) * P(w | v), P(w | v) likewise from c(v w), c(v) and P(w), where n counts distinct
successors and a negative difference is 0; an unseen context leaves it to the shorter one. P(w) = (c + 0.5) / (N + 0.5 (V + 1)).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, delete_folder, mix64, new_folder, split_batches, written
from .elias_fano import Trie, quantised, stored

DISCOUNT = 0.75
BLOCK_BYTES = 6 << 20
SHARD_TOKENS = 1_500_000
MIN_SHARDS = 96
#: Each block names its most frequent words and word pairs; what is frequent in the corpus is among some block's.
TOP = 1000
END = b"\n"  # no word has white space
#: Stands for "no token yet" as a context.
BEGIN = np.uint64(0x5BE6157A7E97)
_CUT = np.uint64(32)
_STEP, _STEP2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; the bytes that bytes.split cuts at are space and U+0009 to U+000D."""
    return (text or "").encode("utf-8").lower().split()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def make_block(doc_ids: list, texts: list) -> dict:
    """The block's columns. Words are numbered as they come, so that frequent ones have small numbers."""
    tokens: list[bytes] = []
    lengths = []
    for t in texts:
        words = words_of(t)
        tokens += words
        tokens.append(END)
        lengths.append(len(words) + 1)
    codes, vocabulary = pd.factorize(np.array(tokens, dtype=object))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))
    del tokens
    sizes = np.array(lengths, dtype=np.int64)
    train = np.repeat([not held_out(d) for d in doc_ids], sizes)
    counts = np.bincount(codes, weights=train, minlength=len(hashes)).astype("<u4")
    squeeze = zstandard.ZstdCompressor(level=3).compress
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()  # byte planes compress far better than whole numbers
    return {
        "lengths": sizes.astype("<i8").tobytes(),
        "codes": squeeze(planes),
        "hashes": hashes.astype("<u8").tobytes(),
        "counts": squeeze(counts.tobytes()),
        "train_tokens": int(train.sum()),
        "train_docs": sum(not held_out(d) for d in doc_ids),
        "n_tokens": len(codes),
    }


class Tokens:
    """A block's tokens with the two before each, as numbers in the order of their words' hashes; the last number stands for BEGIN."""

    def __init__(self, row: dict):
        loose = zstandard.ZstdDecompressor().decompress
        planes = np.frombuffer(loose(row["codes"]), np.uint8).reshape(4, -1)
        hashes = np.frombuffer(row["hashes"], "<u8")
        order = np.argsort(hashes)
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.codes = rank[np.ascontiguousarray(planes.T).view("<i4")[:, 0]]
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.counts = np.frombuffer(loose(row["counts"]), "<u4").astype(np.int64)[order]
        self.keys = np.append(hashes[order], BEGIN)
        self.short = (self.keys >> _CUT).astype(np.uint32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.size = len(self.keys)
        self.middle = self._shifted(self.codes)
        self.first = self._shifted(self.middle)
        self.train = np.repeat(~np.array(row["held"], dtype=bool), self.lengths)

    def _shifted(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty_like(codes)
        out[1:], out[self.starts] = codes[:-1], self.size - 1
        return out


def pair_key(first_short: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Key of a context of two words."""
    with np.errstate(over="ignore"):
        return mix64(middle + first_short.astype(np.uint64) * _STEP2)


BLOCK_SCHEMA = "block long, doc_ids array<long>, held array<boolean>, lengths binary, codes binary, hashes binary, counts binary, train_tokens long, train_docs long, n_tokens long"


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """The corpus in blocks. Block numbers join the partition's number and the place within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in (s for b in batches for s in split_batches([b], "text", rows=1 << 20, size=BLOCK_BYTES)):
            ids = batch.column("key").to_pylist()
            row = {"block": number, "doc_ids": ids, "held": [held_out(d) for d in ids]} | make_block(ids, batch.column("text").to_pylist())
            number += 1
            yield pa.RecordBatch.from_pylist([row], schema=_arrow(BLOCK_SCHEMA))

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(part.split(" ")[0], kinds[part.split(" ")[1]]) for part in schema.split(", ")])


@dataclass
class Frequent:
    """Contexts that are spread over shards: exact training counts by key, and into how many parts each goes."""

    counts: dict[int, int] = field(default_factory=dict)
    parts: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.keys = np.array(sorted(self.counts), dtype=np.uint64)
        self.total = np.array([self.counts[int(k)] for k in self.keys], dtype=np.int64)
        self.fan = np.array([self.parts[int(k)] for k in self.keys], dtype=np.uint64)

    def at(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key here, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def fans(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.fan[np.maximum(at, 0)], 1).astype(np.uint64) if len(self.fan) else np.ones(len(at), np.uint64)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(h) % np.uint64(shards)).astype(np.int64)


class Plan(Tokens):
    """How a block's questions are laid out; the same every time it is made."""

    def __init__(self, row: dict, shards: int, often: Frequent):
        super().__init__(row)
        size = np.int64(self.size)
        key = self.middle.astype(np.int64)
        for other in (self.first, self.codes):
            key *= size
            key += other
        triples, of = np.unique(key, return_inverse=True)
        del key
        self.triple_of = of.astype(np.int32)
        self.t_third = (triples % size).astype(np.int32)
        triples //= size
        self.t_middle, self.t_first = ((triples // size).astype(np.int32), (triples % size).astype(np.int32))
        del triples, of
        word_at = often.at(self.keys)
        self.frequent_word = word_at  # of each word, its place among the frequent ones
        fan = often.fans(word_at)
        self.context_at = often.at(pair_key(self.short[self.t_first], self.keys[self.t_middle]))
        with np.errstate(over="ignore"):
            spread = self.short[self.t_first] % fan[self.t_middle] * _STEP + self.short[self.t_third] % often.fans(self.context_at) * _STEP2
            self.triple_shard = shard_of(self.keys[self.t_middle] + spread, shards)
            # pairs of frequent middle words, whose triples are not together
            hot = np.flatnonzero(word_at[self.middle] >= 0)
            pairs, of = np.unique(self.middle[hot] * size + self.codes[hot], return_inverse=True)
            self.hot, self.pair_of = hot, of
            self.p_middle, self.p_third = np.divmod(pairs, size)
            del pairs, of
            self.pair_middle_key = mix64(self.keys[self.p_middle] + np.uint64(1))
            self.pair_shard = shard_of(self.pair_middle_key + self.short[self.p_third] % fan[self.p_middle] * _STEP, shards)
        self.word_shard = shard_of(self.keys[:-1], shards)
        # in a shard: words; triples of words that are there too, in their order; triples of frequent words
        self.spread = word_at[self.t_middle] >= 0
        self.orders = [np.argsort(self.word_shard, kind="stable"), np.lexsort((self.spread, self.triple_shard)), np.argsort(self.pair_shard, kind="stable")]

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each shard that is asked, and its words, triples and pairs, as places in this block."""
        sides = [x[o] for x, o in zip((self.word_shard, self.triple_shard, self.pair_shard), self.orders)]
        used = np.unique(np.concatenate(sides))
        cuts = [(np.searchsorted(x, used), np.searchsorted(x, used, side="right")) for x in sides]
        for k, s in enumerate(used.tolist()):
            yield s, *(o[a[k] : b[k]] for o, (a, b) in zip(self.orders, cuts))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours begin, and how long they are."""
    new = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return new, np.diff(np.append(new, len(values)))


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers under 2 ** 32 as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def pack_parts(parts: list[bytes]) -> bytes:
    return struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def unpack_parts(data: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", data)[0]
    sizes = struct.unpack_from(f"<{n}Q", data, 4)
    cuts = np.cumsum([4 + 8 * n, *sizes]).tolist()
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def ask(block_rows: DataFrame, shards: int, often: Frequent) -> DataFrame:
    """(shard, block, question) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            plan = Plan(row, shards, often)
            times = np.bincount(plan.triple_of, weights=plan.train, minlength=len(plan.t_middle))
            pair_times = np.bincount(plan.pair_of, weights=plan.train[plan.hot], minlength=len(plan.p_middle))
            out = []
            for s, words, triples, pairs in plan.parts():
                first, third, pair_third = plan.t_first[triples], plan.t_third[triples], plan.p_third[pairs]
                # the words in first and third place, each once
                used = np.zeros(plan.size, dtype=bool)
                used[first] = used[third] = used[pair_third] = True
                number = np.cumsum(used) - 1
                middle, apart = plan.t_middle[triples], plan.spread[triples]
                mine, others = middle[~apart], middle[apart]
                begins, length = _runs(others)
                pair_begins, pair_length = _runs(plan.p_middle[pairs])
                parts = [
                    plan.keys[words].tobytes(), pack_numbers(plan.counts[words]), pack_numbers(np.searchsorted(mine, words, side="right") - np.searchsorted(mine, words)),
                    plan.keys[others[begins]].tobytes(), pack_numbers(length), pack_numbers(np.diff(plan.short[:-1][used[:-1]], prepend=np.uint32(0))), np.array([used[-1]]).tobytes(), pack_numbers(number[first]), pack_numbers(number[third]), pack_numbers(times[triples]),
                    plan.pair_middle_key[pairs][pair_begins].tobytes(), pack_numbers(pair_length), pack_numbers(number[pair_third]), pack_numbers(pair_times[pairs]),
                ]
                out.append((s, row["block"], pack_parts(parts)))
            s, b, d = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(b, pa.int64()), pa.array(d, pa.binary())], names=["shard", "block", "question"])

    return block_rows.select("block", "held", "lengths", "codes", "hashes", "counts").mapInArrow(run, "shard int, block long, question binary")


def _read_question(data: bytes) -> tuple[np.ndarray, ...]:
    """Words, their counts; triples' middles (repeated), firsts, thirds, times; pairs' middles, thirds, times."""
    words, counts, length, others, other_length, gaps, begin, first, third, times, pair_keys, pair_length, pair_third, pair_times = unpack_parts(data)
    keys = lambda x: np.frombuffer(x, "<u8")
    short = np.cumsum(unpack_numbers(gaps), dtype=np.uint64).astype(np.uint32)
    if begin == b"\1":  # the one word that is not in the order of hashes
        short = np.append(short, np.uint32(BEGIN >> _CUT))
    return (
        keys(words), unpack_numbers(counts),
        np.concatenate((np.repeat(keys(words), unpack_numbers(length)), np.repeat(keys(others), unpack_numbers(other_length)))), short[unpack_numbers(first)], short[unpack_numbers(third)], unpack_numbers(times),
        np.repeat(keys(pair_keys), unpack_numbers(pair_length)), short[unpack_numbers(pair_third)], unpack_numbers(pair_times),
    )


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each one's sum, and each value's place among them."""
    known, where = np.unique(keys, return_inverse=True)
    return known, np.bincount(where, weights=values, minlength=len(known)).astype(np.int64), where.astype(np.int32)


class Shard:
    """A shard's sums and its trie."""

    def __init__(self, asked: list[tuple[np.ndarray, ...]], often: Frequent, path: str, keep: bool = False):
        part = lambda *k: np.concatenate([x[j] for j in k for x in asked])
        self.words, self.counts, _ = _summed(part(0), part(1))
        n, times, pair_times = sum(len(x[2]) for x in asked), part(5), part(8)
        middles, m = np.unique(part(2, 6), return_inverse=True)
        thirds, w = np.unique(part(4, 7), return_inverse=True)
        firsts, u = np.unique(part(3), return_inverse=True)
        n3, n1 = max(1, len(thirds)), max(1, len(firsts))
        pair_key_of = m[n:] * n3 + w[n:]
        key = m[:n] * n1
        key += u
        key *= n3
        key += w[:n]
        del m, u, w
        triple, c3, self.triple_at = _summed(key, times)
        del key, times
        t_context, t_third = np.divmod(triple, n3)
        t_middle = t_context // n1
        pair, c2, at = _summed(np.concatenate((t_middle * n3 + t_third, pair_key_of)), np.concatenate((c3, pair_times)))
        self.pair_at = at[len(triple) :]
        self.asked_triple = (middles, t_middle), (firsts, t_context % n1), (thirds, t_third)
        self.asked_pair = (middles, pair // n3), (thirds, pair % n3)
        # what training has: pairs by middle, contexts (first, middle), triples by context
        pair, c2 = pair[c2 > 0], c2[c2 > 0]
        p_middle, p_third = np.divmod(pair, n3)
        seen = c3 > 0
        contexts, c_context, t_place = _summed(t_context[seen], c3[seen])
        c_middle, c_first = np.divmod(contexts, n1)
        total = np.bincount(p_middle, weights=c2, minlength=len(middles)).astype(np.int64)
        self.middles, self.followers = middles, np.bincount(p_middle, minlength=len(middles))
        hot = often.at(middles)
        total = np.where(hot >= 0, often.total[np.maximum(hot, 0)], total) if len(often.total) else total
        n_context = np.bincount(t_place, minlength=len(contexts))
        self.context_keys, self.n_context = pair_key(firsts[c_first], middles[c_middle]), n_context
        hot = often.at(self.context_keys)
        c_context = np.where(hot >= 0, often.total[np.maximum(hot, 0)], c_context) if len(often.total) else c_context
        two = np.maximum(c2 - DISCOUNT, 0) / np.maximum(1, total[p_middle])
        weight = DISCOUNT * n_context / np.maximum(1, c_context)
        three = np.maximum(c3[seen] - DISCOUNT, 0) / np.maximum(1, c_context[t_place])
        self.back, self.back_book = quantised(np.where(total > 0, DISCOUNT * self.followers / np.maximum(1, total), 1.0))
        packed = Trie.pack(middles, thirds, firsts, (p_middle, p_third, two), (c_middle, c_first, weight), (t_place, t_third[seen], three))
        self.trie = Trie(stored(packed, path, keep))


def answer(often: Frequent, folder: str, keep: bool) -> Callable[[pa.Table], pa.Table]:
    """The function of one shard: add up, build the trie, answer each block from it. Rows with block null hold sums for the whole model."""

    def run(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        asked = [_read_question(x.as_py()) for x in table.column("question")]
        number = table.column("shard")[0].as_py()
        shard = Shard(asked, often, f"{folder}/{number:08d}-{TaskContext.get().taskAttemptId()}.trie", keep)
        # every question once, however many blocks ask it
        trie = shard.trie
        codes = trie.triple(*shard.asked_triple)
        at = trie.pair(*shard.asked_pair)
        two = np.where(at >= 0, trie.two[np.maximum(at, 0)], 0).astype(np.uint8) if len(trie.two) else np.zeros(len(at), np.uint8)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        books = b"".join(getattr(trie, f"{c}_book").tobytes() for c in Trie.CODES) + shard.back_book.tobytes()
        rows, a, b = [], 0, 0
        for block, (words, _, middle, _, _, times, pair_middle, _, pair_times) in zip(table.column("block").to_pylist(), asked):
            triples, pairs = shard.triple_at[a : a + len(times)], shard.pair_at[b : b + len(pair_times)]
            new, _ = _runs(middle)
            back = shard.back[np.searchsorted(shard.middles, middle[new])]
            count = shard.counts[np.searchsorted(shard.words, words)]
            parts = [count.astype("<u8").tobytes(), back.tobytes(), *(c[triples].tobytes() for c in codes), two[pairs].tobytes(), books]
            rows.append((block, number, squeeze(pack_parts(parts)), None, None))
            a, b = a + len(times), b + len(pair_times)
        rows.append((None, number, None, -1, int((shard.counts > 0).sum())))
        # distinct successors of frequent words (under their pairs' keys) and contexts
        for keys, n in ((shard.middles, shard.followers), (shard.context_keys, shard.n_context)):
            hot = np.flatnonzero(often.at(keys) >= 0)
            rows += [(None, number, None, int(k.view(np.int64)), int(x)) for k, x in zip(keys[hot], n[hot])]
        names = ["block", "shard", "answer", "about", "amount"]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=names)

    return run


def score_block(row: dict, answers: dict[int, bytes], shards: int, often: Frequent, followers: dict[int, int], train_tokens: int, vocabulary: int) -> dict[str, np.ndarray]:
    plan = Plan(row, shards, often)
    loose = zstandard.ZstdDecompressor().decompress
    count = np.zeros(plan.size - 1, dtype=np.int64)
    back_word = np.ones(plan.size)
    two, weight, three = (np.zeros(len(plan.t_middle)) for _ in range(3))
    hot_two = np.zeros(len(plan.p_middle))
    for s, words, triples, pairs in plan.parts():
        counts, back, *codes, pair_codes, books = unpack_parts(loose(answers[s]))
        books = np.frombuffer(books, "<f4").reshape(4, 256).astype(float)
        count[words] = np.frombuffer(counts, "<u8").astype(np.int64)
        middle = plan.t_middle[triples]
        back_word[middle[_runs(middle)[0]]] = books[3][np.frombuffer(back, np.uint8)]
        for out, code, book in zip((two, weight, three), codes, books[:3]):
            out[triples] = book[np.frombuffer(code, np.uint8)]
        hot_two[pairs] = books[0][np.frombuffer(pair_codes, np.uint8)]
    weight[weight == 0] = 1.0  # a context that training has not
    # frequent words and contexts: their sums are exact and come from the driver
    n = np.array([followers.get(int(k), 0) for k in often.keys], dtype=float)
    share = DISCOUNT * n / np.maximum(1, often.total)
    if len(share):
        # a frequent word's pairs are counted under another key, see Plan
        at = often.at(mix64(plan.keys + np.uint64(1)))
        back_word = np.where(at >= 0, share[np.maximum(at, 0)], back_word)
        weight = np.where(plan.context_at >= 0, share[np.maximum(plan.context_at, 0)], weight)
    single = (count + 0.5) / (train_tokens + 0.5 * (vocabulary + 1))
    token = single[plan.codes]
    pair = two[plan.triple_of]
    pair[plan.hot] = hot_two[plan.pair_of]
    both = pair + back_word[plan.middle] * token
    score = three[plan.triple_of] + weight[plan.triple_of] * both
    return {
        "n_tokens": plan.lengths,
        "n_known": np.add.reduceat((count[plan.codes] > 0).astype(np.int64), plan.starts),
        "base_score": np.add.reduceat(np.log10(token), plan.starts),
        "score": np.add.reduceat(np.log10(score), plan.starts),
    }


def frequent_contexts(corpus: DataFrame, shards: int, train_tokens: int, train_docs: int) -> Frequent:
    """Words and word pairs over an eighth of a mean shard: at most 16 for each shard. Their counts are exact."""
    bound = max(1, train_tokens // (8 * shards))
    columns = corpus.select("held", "lengths", "codes", "hashes", "counts")

    def counted(pick: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pylist()):
                tokens = Tokens(row)
                inside = tokens.train & (tokens.middle != tokens.size - 1)
                code, times = np.unique(tokens.middle[inside] * np.int64(tokens.size) + tokens.first[inside], return_counts=True)
                middle, first = np.divmod(code, tokens.size)
                word = np.bincount(middle, weights=times, minlength=tokens.size).astype(np.int64)
                for keys, n in ((tokens.keys[:-1], word[:-1]), (pair_key(tokens.short[first], tokens.keys[middle]), times)):
                    mine = pick(keys, n)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[mine].view(np.int64)), pa.array(n[mine])], names=["h", "c"])

        return columns.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))

    wanted = np.array([r[0] for r in counted(lambda _, n: np.argsort(-n, kind="stable")[:TOP]).filter(F.col("c") > bound).select("h").collect()], dtype=np.int64).view(np.uint64)
    rows = counted(lambda keys, _: np.flatnonzero(np.isin(keys, wanted))).collect() if len(wanted) else []
    counts = {int(np.int64(h).view(np.uint64)): int(c) for h, c in rows}
    counts[int(BEGIN)] = counts[int(pair_key(np.array([BEGIN >> _CUT], np.uint32), np.array([BEGIN]))[0])] = train_docs
    # pairs of a frequent word are asked for, and counted, under a key of their own
    counts |= {int(mix64(np.array([k], np.uint64) + np.uint64(1))[0]): c for k, c in list(counts.items())}
    return Frequent(counts, {k: max(1, -(-8 * shards * c // max(1, train_tokens))) for k, c in counts.items()})


SCORE_SCHEMA = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(df: DataFrame, key: str = "doc_id", text: str = "text", tries: str | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    The model learns from all documents whose crc32 of the id modulo 5 is not 1 (a null id counts as ''). A null text counts as empty: its only
    token is the end. Ids are longs or null and may repeat; each row is a document. Texts of any length are read whole; other columns are
    dropped. The shards' tries stay in the folder ``tries`` if it is given, else each goes with its task. An empty table gives an empty one. Without training documents every word is unknown and both scores are the base's.
    """
    spark = df.sparkSession
    corpus = written(spark, blocks(df, key, text), "lm-blocks")
    sums = corpus.agg(F.sum("train_tokens"), F.sum("train_docs"), F.sum("n_tokens")).first()
    train_tokens, train_docs, n_tokens = (int(x or 0) for x in sums)
    shards = max(MIN_SHARDS, -(-n_tokens // SHARD_TOKENS))
    often = frequent_contexts(corpus, shards, train_tokens, train_docs)
    folder = tries or new_folder(spark, "lm-tries")
    asked = dealt(ask(corpus, shards, often), shards, "shard").groupBy("shard")
    answers = written(spark, asked.applyInArrow(answer(often, folder, tries is not None), "block long, shard int, answer binary, about long, amount long"), "lm-answers")
    if tries is None:
        delete_folder(spark, folder)
    model = {r[0]: r[1] for r in answers.filter("about is not null").groupBy("about").agg(F.sum("amount")).collect()}
    vocabulary = int(model.pop(-1, 0))
    followers = {int(np.int64(h).view(np.uint64)): int(n) for h, n in model.items()}

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return _arrow(f"{key} long, {SCORE_SCHEMA}").empty_table()
        got = dict(zip(right.column("shard").to_pylist(), right.column("answer").to_pylist()))
        out = score_block(rows[0], got, shards, often, followers, train_tokens, vocabulary)
        size = len(rows[0]["doc_ids"])
        columns = [pa.array(rows[0]["doc_ids"], pa.int64()), pa.array(rows[0]["held"], pa.bool_()), pa.array(out["n_tokens"]), pa.array(out["n_known"]), pa.array(np.full(size, train_tokens)), pa.array(out["base_score"]), pa.array(out["score"])]
        return pa.Table.from_arrays(columns, names=[key, *(x.split(" ")[0] for x in SCORE_SCHEMA.split(", "))])

    mine = corpus.select("block", "doc_ids", "held", "lengths", "codes", "hashes", "counts")
    theirs = answers.filter("block is not null").select("block", "shard", "answer")
    return mine.groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(finish, f"`{key}` long, {SCORE_SCHEMA}")
