"""Exact Jaccard self-join of word shingles under several global token orders.

1. Documents become blocks of word numbers; equal shingle sets get one set id, so copies cost nothing further.
2. Every shingle's document frequency is counted: blocks send their distinct shingles to shards, which answer with a frequency class.
3. Three global orders: rarest class first, and two hash orders that know nothing of frequency. Two sets of similarity t share a token among
   the first n - ceil(t n) + 1 of both, under every order. Sets whose prefix holds only shingles of their own under one of them drop out here.
4. Sets that share a prefix token of the first order meet in that token's list. Lists are not expanded into pairs: members are
   compared with list leaders, linked sets are joined to components, and lists that lie in one component are done. Only pairs
   of different components and near sizes that are left in a list are compared one by one, so no link between components is lost.
5. Before the exact check of a pair, its prefixes of the other orders must meet as well and its sizes must allow the similarity. Two sets that
   share a passage meet under the first order by its rarest shingles; a hash order puts the passage's shingles anywhere, so that few such pairs pass both.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, dealt, delete_table, mix64, runs, split_batches, written
from .components import components

WIDTH, PERCENT = 5, 75
BLOCK_BYTES = 6 << 20
SHARD_TOKENS, MIN_SHARDS = 4_000_000, 48
#: Seeds of the orders' hashes; the first order sorts by frequency class before its hash.
ORDERS = (0x51ED270B, 0x2545F491, 0x9E3779B9)
LEADER_ROUNDS = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Tokens go to their shard by 32 bits: a shard holds so few that one in a thousand is taken for another and called shared, which is safe.
_LOW32 = np.uint64((1 << 32) - 1)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, cut at space and U+0009 to U+000D."""
    return (text or "").encode("utf-8").lower().split()


def shingle_hashes(words: np.ndarray, lengths: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of documents laid end to end, and each one's document.

    ``words`` are hashes of words. A document of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    document = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            h = mix64(h * _STEP + words[k : k + len(h)]) if len(h) else h
    whole = np.flatnonzero(np.arange(len(h)) + width <= ends[document[: len(h)]])
    hashes, owners = [h[whole]], [document[whole]]
    for d in np.flatnonzero((lengths > 0) & (lengths < width)):
        x = xxhash.xxh3_64_intdigest(words[starts[d] : ends[d]].tobytes(), seed=int(lengths[d]))
        hashes.append(np.array([x], dtype=np.uint64))
        owners.append(np.array([d]))
    return np.concatenate(hashes), np.concatenate(owners)


def distinct_sets(codes: np.ndarray, vocabulary: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by document (tokens, in order of document and hash), their documents, and each document's set size."""
    h, d = shingle_hashes(vocabulary[codes], lengths, width)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    h, d = h[new], d[new]
    return h, d, np.bincount(d, minlength=len(lengths))


BLOCKS = "block long, doc_ids array<long>, tags array<long>, sids array<long>, sizes array<long>, lengths binary, codes binary, hashes binary, n_tokens long"


def blocks(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """The corpus in blocks; ``tags`` are 64-bit hashes of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in (s for b in batches for s in split_batches([b], "text", rows=1 << 20, size=BLOCK_BYTES)):
            words = [words_of(x) for x in batch.column("text").to_pylist()]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            flat = np.array([x for w in words for x in w], dtype=object)
            codes, vocabulary = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), [])
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))
            tokens, owner, sizes = distinct_sets(codes, hashes, lengths, width)
            ends = np.cumsum(sizes)
            sids = [xxhash.xxh3_64_intdigest(tokens[b - n : b].tobytes(), seed=int(n)) if n else None for b, n in zip(ends.tolist(), sizes.tolist())]
            planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            signed = [None if s is None else s - (1 << 64) if s >> 63 else s for s in sids]
            row = [number, batch.column("key").to_pylist(), batch.column("tag").to_pylist(), signed, sizes.tolist(), lengths.tobytes(), zstandard.ZstdCompressor(level=3).compress(planes), hashes.tobytes(), int(sizes.sum())]
            number += 1
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, *[pa.binary()] * 3, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[x.split(" ")[0] for x in BLOCKS.split(", ")])

    return df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tag"), F.col(text).alias("text")).mapInArrow(run, BLOCKS)


class BlockSets:
    """A block's sets, one for each set id, and the layout of its questions."""

    def __init__(self, row: dict, shards: int, width: int):
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), np.uint8).reshape(4, -1)
        codes = np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64) if planes.size else np.zeros(0, np.int64)
        tokens, owner, self.sizes = distinct_sets(codes, np.frombuffer(row["hashes"], "<u8"), np.frombuffer(row["lengths"], "<i8"), width)
        first: dict[int, int] = {}
        for k, s in enumerate(row["sids"]):
            if s is not None:
                first.setdefault(s, k)
        self.sid_of = row["sids"]
        chosen = np.zeros(len(self.sizes), dtype=bool)
        chosen[list(first.values())] = True
        keep = chosen[owner] if len(owner) else np.zeros(0, bool)
        self.tokens, self.owner = tokens[keep], owner[keep]
        self.shard = (mix64(self.tokens) % np.uint64(shards)).astype(np.int64)
        short = self.tokens & _LOW32
        order = np.lexsort((short, self.shard))
        shard, short = self.shard[order], short[order]
        new = np.append(True, (short[1:] != short[:-1]) | (shard[1:] != shard[:-1])) if len(short) else np.zeros(0, bool)
        self.place = np.empty(len(order), dtype=np.int64)  # of each token in the block's list of distinct short tokens
        self.place[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.short, self.times = short[new], np.minimum(np.diff(np.append(at, len(short))), 255)
        self.short_shard = shard[new]


def pack_sorted(values: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as compressed byte planes of their gaps, and their counts."""
    gaps = np.diff(values.astype(np.int64), prepend=0).astype("<u4")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
    return struct.pack("<I", len(gaps)) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes() + times.astype(np.uint8).tobytes())


def unpack_sorted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8)
    gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4")[:, 0]
    return np.cumsum(gaps.astype(np.int64)), raw[4 * n :]


def count_classes(table: pa.Table) -> pa.Table:
    """One shard: frequency class (bits of frequency - 1) of each token that a block asks about."""
    asked, times = zip(*(unpack_sorted(x.as_py()) for x in table.column("question")))
    known, where = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(times), minlength=len(known)).astype(np.int64)
    kind = np.minimum(63, np.ceil(np.log2(np.maximum(1, total)))).astype(np.uint8)[where]
    cuts = np.cumsum([0, *map(len, asked)])
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = [squeeze(kind[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.Table.from_arrays([table.column("block"), table.column("shard"), pa.array(out, pa.binary())], names=["block", "shard", "answer"])


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def prefix_order(owner: np.ndarray, kind: np.ndarray | None, tokens: np.ndarray, seed: int) -> np.ndarray:
    """Tokens by owner (under 2 ** 20 of them), then frequency class where given, then an own hash: sorted as one number each."""
    key = owner.astype(np.uint64) << np.uint64(44)
    spot = mix64(tokens ^ np.uint64(seed))
    return np.argsort(key | (spot >> np.uint64(20)) if kind is None else key | (kind.astype(np.uint64) << np.uint64(38)) | (spot >> np.uint64(26)))


def candidate_sets(spark, corpus: DataFrame, width: int, percent: int) -> DataFrame:
    """(sid, n, head array<long>, rest array<long>, others array<array<int>>, items array<long>) of sets that have a shingle of others in all prefixes.

    ``head`` holds the first order's prefix tokens that other documents have too, ``rest`` the set's number of tokens from each on, ``others`` those of the other orders by 32 bits (enough
    to tell that two do not meet); ``items`` all shared tokens of the set.
    """
    total = int(corpus.agg(F.sum("n_tokens")).first()[0] or 0)
    shards = max(MIN_SHARDS, -(-total // SHARD_TOKENS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            sets = BlockSets(row, shards, width)
            rows = [(s, row["block"], pack_sorted(sets.short[span], sets.times[span])) for s, span in runs(sets.short_shard)]
            if rows:
                s, k, q = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.int64()), pa.array(q, pa.binary())], names=["shard", "block", "question"])

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            sets = BlockSets(row, shards, width)
            if not len(sets.tokens):
                continue
            got = dict(zip(right.column("shard").to_pylist(), right.column("answer").to_pylist()))
            kinds = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(got[s]), np.uint8) for s, _ in runs(sets.short_shard)])
            kind = kinds[sets.place].astype(np.int64)
            size = sets.sizes[sets.owner]
            starts = np.flatnonzero(np.append(True, sets.owner[1:] != sets.owner[:-1]))
            nth = np.arange(len(kind)) - np.repeat(starts, np.diff(np.append(starts, len(kind))))  # tokens stand by owner
            prefix = prefix_length(size, percent)
            heads = []
            for number, seed in enumerate(ORDERS):
                order = prefix_order(sets.owner, kind if number == 0 else None, sets.tokens, seed)
                chosen = (nth < prefix) & (kind[order] > 0)
                inside = order[chosen]
                heads.append({int(o): t for o, t in _by_owner(sets.owner[inside], sets.tokens[inside])})
                if len(heads) == 1:  # how many of the set's tokens stand from each head token on
                    rest = {int(o): t for o, t in _by_owner(sets.owner[inside], (size - nth)[chosen])}
            shared = kind > 0
            items = {int(o): t for o, t in _by_owner(sets.owner[shared], sets.tokens[shared])}
            for o, first in heads[0].items():
                if all(o in h for h in heads):
                    others = [(h[o] & _LOW32).astype(np.uint32).view(np.int32) for h in heads[1:]]
                    rows.append((sets.sid_of[o], int(sets.sizes[o]), first.view(np.int64), rest[o], others, items[o].view(np.int64)))
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["sid", "n", "head", "rest", "others", "items"])

    asked = corpus.select("block", "sids", "lengths", "codes", "hashes").mapInArrow(ask, "shard int, block long, question binary")
    answers = dealt(asked, shards, "shard").groupBy("shard").applyInArrow(count_classes, "block long, shard int, answer binary")
    mine = corpus.select("block", "sids", "lengths", "codes", "hashes")
    chosen = mine.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(choose, "sid long, n long, head array<long>, rest array<long>, others array<array<int>>, items array<long>")
    one = chosen.groupBy("sid").agg(F.first(F.struct("n", "head", "rest", "others", "items")).alias("x"))
    return written(spark, one.select("sid", "x.n", "x.head", "x.rest", "x.others", "x.items"), "shingle-sets")


def _by_owner(owner: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(owner))):
        yield owner[a], values[a:b]


def met_in_all(pairs: DataFrame, sets: DataFrame, orders: int = len(ORDERS)) -> DataFrame:
    """(a, b, na, nb, xa, xb) of the pairs whose prefixes meet under the first ``orders`` orders; xa and xb: the sets' shared tokens."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("others").alias("ha"), F.col("items").alias("xa"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("others").alias("hb"), F.col("items").alias("xb"))
    both = pairs.join(left, "a").join(right, "b")
    for k in range(orders - 1):
        both = both.filter(F.arrays_overlap(F.col("ha")[k], F.col("hb")[k]))
    return both.select("a", "b", "na", "nb", "xa", "xb")


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: all orders' prefixes must meet, then the sets' overlap decides."""
    common = F.size(F.array_intersect("xa", "xb")).cast("long")
    return met_in_all(pairs, sets).filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _possible(percent: int):
    """Whether sizes allow the similarity: of the sets (nx, ny), and of their parts from the list's token on (sx, sy).

    In the list of their first common token, those parts hold all that two sets have in common, so each similar pair is possible there.
    """
    return (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & ((100 + percent) * F.least("sx", "sy") >= percent * (F.col("nx") + F.col("ny")))


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs with a < b that are possible, from (x, nx, sx, y, ny, sy)."""
    return pairs.filter((F.col("x") != F.col("y")) & _possible(percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def prefix_lists(sets: DataFrame) -> DataFrame:
    """(token, sid, n, s): the first order's lists, with each member's size and its number of tokens from the list's token on."""
    return sets.select("sid", "n", F.explode(F.arrays_zip("head", "rest")).alias("h")).select(F.col("h.head").alias("token"), "sid", "n", F.col("h.rest").alias("s"))


def _sides(*names: str) -> list[F.Column]:
    """(name, n, s) of the member ``sid`` as a side of a pair."""
    return [F.col(f).alias(t) for f, t in zip(("sid", "n", "s"), names)]


def left_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(x, nx, sx, y, ny, sy): possible pairs of different components in each list, dealt by list and by size.

    Sizes of similar sets differ by a factor of 100 / percent at most, so they lie in the same or neighbouring classes of that ratio.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int") if percent < 100 else F.col("n").cast("int")
    a = members.select("token", *_sides("x", "nx", "sx"), F.col("component").alias("cx"), F.explode(F.array(size_class - 1, size_class, size_class + 1)).alias("size_class"))
    b = members.select("token", *_sides("y", "ny", "sy"), F.col("component").alias("cy"), size_class.alias("size_class"))
    return a.join(b, ["token", "size_class"]).filter(_possible(percent) & F.expr("cx < cy"))


def link_sets(spark, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that are linked with another. ``sets`` is dropped when done.

    What is joined is written before, so that Spark can split the lists of frequent tokens between tasks.
    """
    now = written(spark, prefix_lists(sets).withColumn("component", F.col("sid")), "prefix-lists")
    links: list[DataFrame] = []
    labels = None
    for turn in range(LEADER_ROUNDS + 1):
        rank = F.xxhash64("sid", F.lit(turn))
        # two leaders: one with the fewest tokens of its own, as the source of a group of copies has, and one at random
        plain = F.struct(F.round(F.col("s") / F.col("n"), 2).alias("share"), rank.alias("rank"), "sid", "n", "s", "component")
        lead = now.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(plain).alias("p"), F.max_by(plain, F.struct(rank, "sid")).alias("q"))
        lead = written(spark, lead.filter("low <> high").select("token", F.array("p", "q").alias("leaders")), "leaders")
        now = written(spark, now.join(lead, "token"), "open-lists", finished=[now, lead])
        if turn < LEADER_ROUNDS:
            met = now.select("component", *_sides("x", "nx", "sx"), F.explode("leaders").alias("l")).filter("component <> l.component").select("x", "nx", "sx", F.col("l.sid").alias("y"), F.col("l.n").alias("ny"), F.col("l.s").alias("sy"))
        else:
            met = left_pairs(now, percent)
        candidates = written(spark, _ordered(met, percent), "candidates")
        links.append(written(spark, checked(candidates, sets, percent), "links", finished=[candidates]))
        old, labels = labels, components(reduce(DataFrame.unionByName, links))
        if old is not None:
            delete_table(spark, old)
        if turn < LEADER_ROUNDS:
            told = now.drop("component", "leaders").join(labels.withColumnRenamed("node", "sid"), "sid", "left")
            now = written(spark, told.select("token", "sid", "n", "s", F.coalesce("component", "sid").alias("component")), "lists", finished=[now])
    for table in (now, sets, *links):
        delete_table(spark, table)
    return labels


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id): each document's set size and the smallest key that links reach from it, itself included.

    Documents link when 100 * intersection >= percent * union of their distinct ``width``-word shingles. A document without words (null,
    empty or blank text) links with nothing. Keys are longs; rows with a null key group with their copies, and count in no minimum (a group of
    null keys alone has a null id). Repeated rows are documents. An empty table gives an empty one. Texts of any length are read whole; other
    columns are dropped. Shingles and sets are known by 64-bit hashes.
    """
    spark = df.sparkSession
    corpus = written(spark, blocks(df, key, text, width), "shingle-blocks")
    labels = link_sets(spark, candidate_sets(spark, corpus, width, percent), percent)
    members = corpus.select(F.explode(F.arrays_zip("doc_ids", "sids", "sizes")).alias("m")).select(F.col("m.doc_ids").alias(key), F.col("m.sids").alias("sid"), F.col("m.sizes").alias("n_shingles"))
    named = members.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select(key, "n_shingles", F.coalesce("component", "sid").alias("group"))
    named = written(spark, named, "members", finished=[corpus])
    least = written(spark, named.filter("group is not null").groupBy("group").agg(F.min(key).alias("component_id")), "least-keys", finished=[labels])
    alone = named.filter("group is null").select(key, "n_shingles", F.col(key).alias("component_id"))
    return named.filter("group is not null").join(least, "group").select(key, "n_shingles", "component_id").unionByName(alone)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that have the least key of their group, one row of each group; rows without words all stay.

    Of rows with equal keys in a group the one of least text hash stays, and any one of rows with equal keys and texts; a null key comes after
    all others. All columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    spark = df.sparkSession
    corpus = written(spark, blocks(df, key, text, width), "shingle-blocks")
    labels = link_sets(spark, candidate_sets(spark, corpus, width, percent), percent)
    members = corpus.select(F.explode(F.arrays_zip("doc_ids", "tags", "sids")).alias("m")).select(F.col("m.doc_ids").alias("id"), F.col("m.tags").alias("tag"), F.col("m.sids").alias("sid"))
    named = members.filter("sid is not null").join(labels.withColumnRenamed("node", "sid"), "sid", "left").groupBy(F.coalesce("component", "sid").alias("group"), "id", "tag").agg(F.count(F.lit(1)).alias("copies"))
    first = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "tag", "copies")).alias("x")).select(F.col("x.id").alias("id"), F.col("x.tag").alias("tag"), F.col("x.copies").alias("copies"))
    kept = written(spark, first, "kept-keys", finished=[corpus, labels])
    rows = df.select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_tag"), F.col(text).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    found = F.coalesce(F.col("_text"), F.lit("")).rlike(WORD_PATTERN)
    both = rows.filter(found).join(kept, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tag") == F.col("tag")))
    # a key and text that stand in several rows: one of them
    repeated = both.filter("copies > 1").groupBy("_id", "_tag").agg(F.first("_row").alias("_row")).select("_row.*")
    return both.filter("copies = 1").select("_row.*").unionByName(repeated).unionByName(rows.filter(~found).select("_row.*"))
