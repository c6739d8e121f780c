"""Removal of byte strings that occur more than once, by interval expansion on Burrows-Wheeler transforms.

No transform can hold a corpus, so windows of the minimum length are first dealt to pools in which all their equals are:
each window goes by its anchor, the least hash among its short grams, which depends on its bytes only. Neighbouring windows with
one anchor travel as one segment. A first exchange counts anchors and segments, so that segments of anchors found once stay home
and of equal segments one is sent, with its copies as weight. A second brings each anchor's different segments into one pool, whose
transform decides every window (``bwt.repeated_suffixes``), and verdicts go back to all blocks that hold the segment. Blocks lie in buckets and stay there:
answers come to them, texts are not shuffled but for the segments that the transforms need.
An anchor of more different segments than a pool should hold (a passage in very many texts) is dealt on: each of its windows becomes a segment of
its own, is counted in the same way, and goes to the transforms with the others if it is found twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeated_suffixes
from .common import bucketed, dealt, mix64, pack_rows, read_rows, runs, split_batches, with_fields, written

LEAST, GRAM = 200, 32
BLOCK_BYTES, SLICE_BYTES = 4 << 20, 1 << 20
SHARD_BYTES, MIN_SHARDS = 16 << 20, 48
#: Text that a bucket of blocks holds on average, and Spark's default limit of buckets; more text only makes them larger.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 100_000
#: A pool's transform is made for whole anchors, up to about this many bytes at once.
POOL_BYTES = 1 << 20
#: Different segments of one anchor that a pool takes.
MOST_SEGMENTS = 3000
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
FOUND_TWICE, SENDS, WEIGHTY, CROWDED = 1, 2, 4, 8
_PLACE = np.uint64((1 << 26) - 1)
_HALF = np.uint64(32)


class Hasher:
    """Hashes of all substrings of one byte array from prefix sums: sums of byte times power, shifted back to the start."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        with np.errstate(over="ignore"):
            up = np.full(n + 1, BASE, dtype=np.uint64)
            up[0] = 1
            np.multiply.accumulate(up, out=up)
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])
            down = np.full(n + 1, INVERSE, dtype=np.uint64)
            down[0] = 1
            self.down = np.multiply.accumulate(down)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))


def segments(raw: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, anchor hash and content hash of each segment of documents laid end to end.

    ``ends``: for each place the end of its document. Each window of ``least`` bytes within a document is in one segment, by the first of its grams of least hash.
    """
    none = np.zeros(0, dtype=np.int64)
    width = least - gram + 1
    starts = np.arange(max(0, len(raw) - least + 1))
    windows = np.flatnonzero(starts + least <= ends[: len(starts)])
    if not len(windows):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    hasher = Hasher(raw)
    grams = np.arange(len(raw) - gram + 1)
    hashes = hasher.of(grams, gram)
    best = (hashes & ~_PLACE) | grams.astype(np.uint64)
    reach = 1
    while 2 * reach <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
    anchor = (best[windows] & _PLACE).astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(windows)))
    start = windows[at]
    return start, count, mix64(hashes[anchor[at]]), hasher.of(start, count + least - 1)


def block_segments(raw: np.ndarray, lengths: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``segments`` of a block, made slice by slice; slices overlap, so that they need not end with a document."""
    ends = np.cumsum(lengths)
    parts = []
    for a in range(0, max(1, len(raw)), SLICE_BYTES):
        b = min(len(raw), a + SLICE_BYTES + least - 1)
        first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b, side="left")
        mine = ends[first : last + 1]
        inside = np.diff(np.concatenate(([a], np.minimum(mine, b))))
        start, *others = segments(raw[a:b], np.repeat(mine, inside) - a, least, gram)
        parts.append((start + a, *others))
    return tuple(np.concatenate(x) for x in zip(*parts))


BLOCK = "block long, n_bytes long, payload binary, starts binary, counts binary, items binary, anchors binary, contents binary, times binary"


def blocks(df: DataFrame, text: str, least: int, gram: int) -> DataFrame:
    """Rows in blocks of some megabytes with all their columns, and each block's segments.

    ``starts``, ``counts``, ``items``: of every segment, its place, its windows and its number among the block's different ones, which
    ``anchors``, ``contents`` and ``times`` (2: twice or more) list in order of their anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in (s for b in batches for s in split_batches([b], text, rows=1 << 20, size=BLOCK_BYTES)):
            raw, lengths = text_bytes(batch.column(text))
            start, count, anchor, content = block_segments(raw, lengths, least, gram)
            order = np.lexsort((content, anchor))
            sa, sc = anchor[order], content[order]
            new = np.append(True, (sa[1:] != sa[:-1]) | (sc[1:] != sc[:-1])) if len(order) else np.zeros(0, bool)
            item = np.empty(len(order), dtype="<u4")
            item[order] = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            times = np.minimum(np.diff(np.append(at, len(order))), 2).astype(np.uint8)
            gaps = np.diff(start, prepend=0).astype("<u4")
            row = [number, len(raw), pack_rows(batch), squeeze(gaps.tobytes()), squeeze(count.astype("<u2").tobytes()), squeeze(item.tobytes()), sa[at].tobytes(), sc[at].tobytes(), squeeze(times.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k < 2 else pa.binary()) for k, v in enumerate(row)], names=[x.split(" ")[0] for x in BLOCK.split(", ")])
            number += 1

    return df.mapInArrow(run, BLOCK)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes end to end, and their lengths."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    return np.frombuffer(b"".join(texts.to_pylist()), np.uint8), pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


class Block:
    """A block's segments and different items, as ``blocks`` wrote them."""

    def __init__(self, row: dict, text: str, least: int):
        loose = zstandard.ZstdDecompressor().decompress
        self.least = least
        self.anchor, self.content = np.frombuffer(row["anchors"], "<u8"), np.frombuffer(row["contents"], "<u8")
        if "times" in row:
            self.times = np.frombuffer(loose(row["times"]), np.uint8)
        if "payload" in row:
            self.batch = read_rows(row["payload"])
            self.raw, self.lengths = text_bytes(self.batch.column(text))
            self.start = np.cumsum(np.frombuffer(loose(row["starts"]), "<u4").astype(np.int64))
            self.count = np.frombuffer(loose(row["counts"]), "<u2").astype(np.int64)
            self.item = np.frombuffer(loose(row["items"]), "<u4").astype(np.int64)
            self.example = np.empty(len(self.anchor), dtype=np.int64)
            self.example[self.item] = np.arange(len(self.item))

    def windows_of(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of all windows of some segments."""
        count = self.count[chosen]
        return np.repeat(self.start[chosen] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))

    def crowded_windows(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the segments whose items are crowded: all their starts, each one's number among the different ones, and those: hash, times."""
        chosen = np.flatnonzero(kind[self.item] & CROWDED) if len(kind) else np.zeros(0, np.int64)
        starts = self.windows_of(chosen)
        if not len(starts):
            return starts, starts, np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        size = self.count[chosen] + self.least - 1
        laid = np.repeat(self.start[chosen] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        first = np.cumsum(size) - size  # of each chosen segment among the bytes laid
        count = self.count[chosen]
        hashes = mix64(Hasher(self.raw[laid]).of(np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(starts)), self.least))
        known, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        return starts, which, known, np.minimum(times, 2).astype(np.uint8)


def shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the anchors' mixed hashes."""
    return ((anchor >> _HALF) * np.uint64(shards) >> _HALF).astype(np.int64)


def gathered(answers: dict[int, bytes], shard: np.ndarray) -> np.ndarray:
    """One byte for each item of sorted shards, from the shards' answers."""
    loose = zstandard.ZstdDecompressor().decompress
    parts = [np.frombuffer(loose(answers[s]), np.uint8) for s, _ in runs(shard)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


_QUESTION = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("times", "u1")])
_ITEM = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("size", "<u4"), ("kind", "u1")])
#: What a reply is: kinds of items, kinds of crowded windows, verdicts.
ITEMS, WINDOWS, VERDICTS = range(3)
REPLY = "block long, shard int, tag int, data binary, crowded boolean"


def replies(table: pa.Table, tag: int, data: list[bytes], crowded: list[bool] | None = None) -> pa.Table:
    n = len(data)
    return pa.Table.from_arrays([table.column("block"), table.column("shard"), pa.array([tag] * n, pa.int32()), pa.array(data, pa.binary()), pa.array(crowded or [False] * n)], names=[x.split(" ")[0] for x in REPLY.split(", ")])


def count_items(tag: int, most: int | None) -> Callable[[pa.Table], pa.Table]:
    """An exchange's shard: what is known of each item that a block asks about."""

    def run(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(x.as_py(), _QUESTION) for x in table.column("question")]
        every = np.concatenate(asked)
        order = np.lexsort((every["content"], every["anchor"]))
        anchor, content, times = every["anchor"][order], every["content"][order], every["times"][order].astype(np.int64)
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new = new_anchor | np.append(True, content[1:] != content[:-1])
        which_anchor, which = np.cumsum(new_anchor) - 1, np.cumsum(new) - 1
        found = np.bincount(which_anchor, weights=times)[which_anchor]
        weight = np.bincount(which, weights=times)[which]
        different = np.bincount(which_anchor, weights=new)[which_anchor]
        kind = np.zeros(len(order), dtype=np.uint8)
        kind[order] = np.where(found > 1, FOUND_TWICE, 0) | np.where(new, SENDS, 0) | np.where(weight > 1, WEIGHTY, 0) | np.where(different > most if most else False, CROWDED, 0)
        cuts = np.cumsum([0, *map(len, asked)])
        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = [kind[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return replies(table, tag, [squeeze(p.tobytes()) for p in parts], [bool((p & CROWDED).any()) for p in parts])

    return run


def decide(least: int) -> Callable[[pa.Table], pa.Table]:
    """The last exchange's shard: verdicts on the windows of items, from the transforms of their pools."""

    def run(table: pa.Table) -> pa.Table:
        loose, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        asked = [np.frombuffer(loose(x.as_py()), _ITEM) for x in table.column("items")]
        every = np.concatenate(asked)
        order = np.lexsort((every["content"], every["anchor"]))
        anchor, content = every["anchor"][order], every["content"][order]
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new = new_anchor | np.append(True, content[1:] != content[:-1])
        where = np.empty(len(every), dtype=np.int64)
        where[order] = np.cumsum(new) - 1
        opens = new_anchor[new].tolist()
        held: list[bytes] = [b""] * len(opens)
        at = 0
        for items, contents in zip(asked, table.column("contents")):
            data, place = loose(contents.as_py()), 0
            sends = np.flatnonzero(items["kind"] & SENDS)
            for k, size in zip(where[at + sends].tolist(), items["size"][sends].tolist()):
                held[k] = data[place : place + size]
                place += size
            at += len(items)
        weights = np.ones(len(opens), dtype=np.int64)
        weights[where] = 1 + (every["kind"] & WEIGHTY > 0)
        verdicts: list[np.ndarray] = []
        pool, size = 0, 0
        for k in range(len(held) + 1):  # in order of anchors; a pool ends between two anchors
            if k == len(held) or size >= POOL_BYTES and opens[k]:
                flags, starts = repeated_suffixes(held[pool:k], least, weights[pool:k].tolist())
                verdicts += [flags[a : a + len(x) - least + 1] for x, a in zip(held[pool:k], starts.tolist())]
                pool, size = k, 0
            if k < len(held):
                size += len(held[k]) + 1
        rows, at = [], 0
        for items in asked:
            rows.append(squeeze(np.packbits(np.concatenate([verdicts[k] for k in where[at : at + len(items)].tolist()])).tobytes()))
            at += len(items)
        return replies(table, VERDICTS, rows)

    return run


class Requests:
    """What a block sends to the transforms, from the answers it has: items found twice, and in place of crowded ones their windows found twice."""

    def __init__(self, block: Block, answers: dict[tuple[int, int], bytes], shards: int):
        pick = lambda tag: {s: d for (t, s), d in answers.items() if t == tag}
        shard = shard_of(block.anchor, shards)
        kind = gathered(pick(ITEMS), shard)
        self.items = np.flatnonzero((kind & FOUND_TWICE > 0) & (kind & CROWDED == 0))
        self.starts, self.which, hashes, _ = block.crowded_windows(kind)
        window_shard = shard_of(hashes, shards)
        window_kind = gathered(pick(WINDOWS), window_shard)
        self.windows = np.flatnonzero(window_kind & FOUND_TWICE)
        example = block.example[self.items]
        table = np.empty(len(self.items) + len(self.windows), dtype=_ITEM)
        table["anchor"] = np.concatenate((block.anchor[self.items], hashes[self.windows]))
        table["content"] = np.concatenate((block.content[self.items], hashes[self.windows]))
        table["kind"] = np.concatenate((kind[self.items], window_kind[self.windows]))
        table["size"] = np.concatenate((block.count[example] + block.least - 1, np.full(len(self.windows), block.least)))
        first = np.empty(len(hashes), dtype=np.int64)
        first[self.which] = self.starts
        place = np.concatenate((block.start[example], first[self.windows]))
        self.shard = np.concatenate((shard[self.items], window_shard[self.windows]))
        self.order = np.argsort(self.shard, kind="stable")
        self.table, self.place, self.shard = table[self.order], place[self.order], self.shard[self.order]


def covered(block: Block, answers: dict[tuple[int, int], bytes], shards: int) -> np.ndarray:
    """For each byte of the block's texts, whether a repeated window covers it."""
    loose = zstandard.ZstdDecompressor().decompress
    asked = Requests(block, answers, shards)
    windows = asked.table["size"].astype(np.int64) - block.least + 1
    bits = [np.unpackbits(np.frombuffer(loose(answers[VERDICTS, s]), np.uint8), count=int(windows[span].sum())).astype(bool) for s, span in runs(asked.shard)]
    flags = np.concatenate(bits) if bits else np.zeros(0, bool)
    offset = np.empty(len(windows), dtype=np.int64)  # in ``flags``, of each asked item in the order items, windows
    offset[asked.order] = np.cumsum(windows) - windows
    of_item = np.full(len(block.anchor), -1, dtype=np.int64)
    of_item[asked.items] = offset[: len(asked.items)]
    known = np.flatnonzero(of_item[block.item] >= 0) if len(block.item) else np.zeros(0, np.int64)
    count = block.count[known]
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    hit = flags[np.repeat(of_item[block.item[known]], count) + inner]
    twice = np.zeros(int(asked.which.max()) + 1 if len(asked.which) else 0, dtype=bool)
    twice[asked.windows] = flags[offset[len(asked.items) :]]
    starts = np.concatenate(((np.repeat(block.start[known], count) + inner)[hit], asked.starts[twice[asked.which]]))
    edge = np.zeros(len(block.raw) + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + block.least, -1)
    return np.cumsum(edge[:-1]) > 0


def rows_of(table: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(t, s): d for t, s, d in zip(*(table.column(c).to_pylist() for c in ("tag", "shard", "data")))}


def question_rows(block: list[int], shard: list[int], question: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(question, pa.binary())], names=["shard", "block", "question"])


def questions(block: int, shard: np.ndarray, anchor: np.ndarray, content: np.ndarray, times: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    table = np.empty(len(anchor), dtype=_QUESTION)
    table["anchor"], table["content"], table["times"] = anchor, content, times
    found = [(s, table[span].tobytes()) for s, span in runs(shard)]
    return [block] * len(found), [s for s, _ in found], [q for _, q in found]


def remove_repeats(df: DataFrame, text: str = "text", least: int = LEAST, gram: int = GRAM, digest_only: bool = False, as_text: bool = False, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans, kept_sha256; without the text if ``digest_only``, else with spans and kept. With ``as_text`` only the
    columns of ``df`` come back, the text with its repeats removed (half characters at a cut go too; a null text stays null).

    Each text is its UTF-8 bytes (null: none), of any length. A byte goes if a string of ``least`` bytes that covers it also starts anywhere else, in the same text too;
    all is judged on the input. ``spans``: array of (start, length) of maximal removed runs; ``kept``: binary, what remains. Other columns stay, those of these names are
    replaced; rows may repeat (and then remove each other); null in any column is kept. An empty table gives an empty one. ``df`` is read twice: for its texts' size and for its blocks.
    """
    spark = df.sparkSession
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *([] if digest_only else ["spans", "kept"])]
    columns = list(df.columns)
    if not as_text:
        df = df.drop(*(c for c in added if c in columns and c != text))
    # columns go by place, so that any name will do
    keep = [(f"c{k}", f) for k, f in enumerate(df.schema.fields) if not digest_only or f.name != text]
    text = f"c{df.columns.index(text)}"
    df = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    size = int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    shards, buckets = max(MIN_SHARDS, -(-size // SHARD_BYTES)), min(MOST_BUCKETS, max(MIN_SHARDS, -(-size // BUCKET_BYTES)))
    corpus = bucketed(spark, blocks(df, text, least, gram), "text-blocks", "block", buckets)
    keyed = corpus.select("block", "anchors", "contents", "times")
    whole = corpus.drop("n_bytes", "times")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row, text, least)
            yield question_rows(*questions(row["block"], shard_of(block.anchor, shards), block.anchor, block.content, block.times))

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [question_rows([], [], [])]
        for row in left.to_pylist():
            block = Block(row, text, least)
            kind = gathered({s: d for (_, s), d in rows_of(right).items()}, shard_of(block.anchor, shards))
            _, _, hashes, times = block.crowded_windows(kind)
            out.append(question_rows(*questions(row["block"], shard_of(hashes, shards), hashes, hashes, times)))
        return pa.Table.from_batches(out)

    def request(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        got, squeeze = rows_of(right), zstandard.ZstdCompressor(level=1).compress
        for row in left.to_pylist():
            block = Block(row, text, least)
            asked, data = Requests(block, got, shards), block.raw.tobytes()
            for s, span in runs(asked.shard):
                items, place = asked.table[span], asked.place[span]
                sends = np.flatnonzero(items["kind"] & SENDS)
                contents = b"".join([data[a : a + n] for a, n in zip(place[sends].tolist(), items["size"][sends].tolist())])
                out.append((s, row["block"], squeeze(items.tobytes()), squeeze(contents)))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [[]] * 4, kinds)], names=["shard", "block", "items", "contents"])

    def counted(asked: DataFrame, tag: int, most: int | None, name: str) -> DataFrame:
        return written(spark, dealt(asked, shards, "shard").groupBy("shard").applyInArrow(count_items(tag, most), REPLY), name)

    answers = counted(keyed.mapInArrow(ask, "shard int, block long, question binary"), ITEMS, most_segments, "segment-counts")
    if answers.filter("crowded").limit(1).count():
        crowded = answers.select("block").where("crowded").distinct()
        mine, theirs = whole.join(crowded, "block", "left_semi"), answers.join(crowded, "block", "left_semi")
        asked = mine.groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(ask_windows, "shard int, block long, question binary")
        answers = answers.unionByName(counted(asked, WINDOWS, None, "window-counts"))
    sent = whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(request, "shard int, block long, items binary, contents binary")
    verdicts = written(spark, dealt(sent, shards, "shard").groupBy("shard").applyInArrow(decide(least), REPLY), "verdicts")
    told = answers.unionByName(verdicts)
    digests = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: long, length: long>>, kept binary" * (not digest_only)
    schema = with_fields([f for _, f in keep], "" if as_text else digests)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        got = rows_of(right)
        out = []
        for row in left.to_pylist():
            block = Block(row, text, least)
            gone = covered(block, got, shards)
            ends = np.cumsum(block.lengths)
            rows = []
            for a, b in zip((ends - block.lengths).tolist(), ends.tolist()):
                mine = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0]))))
                kept = block.raw[a:b][~mine].tobytes()
                spans = [] if digest_only else [{"start": int(x), "length": int(y - x)} for x, y in zip(edges[::2], edges[1::2])]
                rows.append((b - a, int(mine.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), spans, kept))
            if as_text:
                texts = block.batch.column(text)
                new = pa.array([None if gap else r[5].decode("utf-8", errors="ignore") for r, gap in zip(rows, texts.is_null().to_pylist())], texts.type)
                out.append(pa.Table.from_arrays([new if c == text else block.batch.column(c) for c, _ in keep], names=[f.name for _, f in keep]))
                continue
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary()]
            arrays = [block.batch.column(c) for c, _ in keep] + [pa.array(list(c), t) for c, t in zip(columns, kinds)][: len(added)]
            out.append(pa.Table.from_arrays(arrays, names=[*(f.name for _, f in keep), *added]))
        return pa.concat_tables(out)

    return whole.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, schema)
