"""Shards of raw token ids with a minimal perfect hash index from document keys to offsets.

A shard is one file: a header, the ids of its documents end to end, and an index. The index is a cascade of bit
fields: each key sets the bit it hashes to; keys alone on their bit are placed there, the others go to the next, smaller
field. A key's slot is the number of placed bits before its own, so n keys have the slots 0 to n - 1, in constant time and a few bits a key.
Slots hold a fingerprint (keys that were never stored are told apart but for one in 2 ** 32), offset, length and the key.
Files are written under names of their task attempt, so a repeated attempt never touches a file that is in use.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_words import encoder
from .common import mix64, new_folder, split_batches

MAGIC = b"GWIDS1\0\0"
SHARD_IDS = 16_000_000
LEVELS, ROOM = 40, 2.0
#: Keys are hashed as (doc_id, how many equal ids came before), so repeated and null ids stay apart.
NULL_KEY = 0x6E756C6C


def hashed_keys(ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        base = mix64(np.where(nulls, NULL_KEY, ids).astype(np.int64).view(np.uint64))
        return mix64(base + mix64(nth.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots of a set of distinct 64-bit keys. Keys left after the last level (practically none) are searched by value."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.ranks = np.concatenate(([0], np.cumsum(bits))).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, fields, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = int(ROOM * len(left)) + 1
            at = _place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            fields.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(fields) if fields else np.zeros(0, bool), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; any slot, or -1, for a key that is not of the set."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + _place(keys[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.ranks[-1] + at[hit]
        return out

    def to_bytes(self) -> bytes:
        packed = np.packbits(self.bits, bitorder="little").tobytes()
        return struct.pack("<II", len(self.sizes), len(self.rest)) + np.array(self.sizes, "<u8").tobytes() + self.rest.astype("<u8").tobytes() + packed

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels, rest = struct.unpack_from("<II", data)
        sizes = np.frombuffer(data, "<u8", levels, 8).astype(int).tolist()
        left = np.frombuffer(data, "<u8", rest, 8 + 8 * levels).astype(np.uint64)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 8 * (levels + rest)), count=sum(sizes), bitorder="little").astype(bool)
        return cls(sizes, bits, left)


def pack_shard(ids: list[bytes], doc_ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> bytes:
    """A shard of documents in the given order; ``ids`` are little-endian unsigned 32-bit integers. Ids below 65536 are stored in two bytes each."""
    payload = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(payload) or int(payload.max()) < 1 << 16 else 4
    lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(ids) else lengths
    keys = hashed_keys(doc_ids, nulls, nth)
    table = PerfectHash.build(keys)
    slot = table.slots(keys)
    order = np.empty(len(keys), dtype=np.int64)
    order[slot] = np.arange(len(keys))
    index = table.to_bytes()
    columns = [(keys >> np.uint64(32)).astype("<u4")[order], offsets.astype("<u8")[order], lengths.astype("<u4")[order], doc_ids.astype("<i8")[order], nulls.astype(np.uint8)[order], nth.astype("<u4")[order]]
    body = payload.astype(f"<u{width}").tobytes()
    return MAGIC + struct.pack("<QQII", len(ids), len(payload), width, len(index)) + body + index + b"".join(c.tobytes() for c in columns)


class Shard:
    """Keyed access to a shard's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        n, total, width, index = struct.unpack_from("<QQII", data, 8)
        at = 32
        self.ids = np.frombuffer(data, f"<u{width}", total, at)
        at += total * width
        self.hash = PerfectHash.from_bytes(data[at : at + index])
        at += index
        columns = []
        for kind in ("<u4", "<u8", "<u4", "<i8", np.uint8, "<u4"):
            columns.append(np.frombuffer(data, kind, n, at))
            at += n * columns[-1].itemsize
        self.prints, self.offsets, self.lengths, self.doc_ids, self.nulls, self.nth = columns

    def find(self, doc_ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Slots of documents, -1 where the fingerprint differs (the document is not here)."""
        keys = hashed_keys(doc_ids, nulls, nth)
        slot = self.hash.slots(keys)
        good = slot >= 0
        good[good] = self.prints[slot[good]] == (keys[good] >> np.uint64(32)).astype(np.uint32)
        return np.where(good, slot, -1)

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """Ids of a document (the nth with its id), or None."""
        slot = int(self.find(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([nth]))[0])
        return None if slot < 0 else self.ids[self.offsets[slot] : self.offsets[slot] + self.lengths[slot]].astype(np.uint32)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(df: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all documents in ascending key order (nulls first); one row a shard: shard, path, n_docs, n_ids.

    Documents are dealt by range of key and text hash, sorted within, and encoded where they are written. A null text counts as empty: its
    ids are the end id alone. A partition of many ids becomes several shards. The key must be a long or null; rows of equal keys are kept side by
    side, numbered within their shard. Other columns are dropped. An empty table writes no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        tail = np.array([end_id], "<u4").tobytes()
        tool = encoder(tokenizer_path)
        held: list[bytes] = []
        keys: list[np.ndarray] = []
        missing: list[np.ndarray] = []
        count, part, last, repeats = 0, 0, None, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, keys, missing, count, part, last, repeats
            doc_ids, nulls = np.concatenate(keys), np.concatenate(missing)
            new = np.ones(len(doc_ids), dtype=bool)
            new[1:] = (doc_ids[1:] != doc_ids[:-1]) | (nulls[1:] != nulls[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            nth = np.arange(len(new)) - first
            if last == (int(doc_ids[0]), bool(nulls[0])):
                nth[first == 0] += repeats
            last, repeats = (int(doc_ids[-1]), bool(nulls[-1])), int(nth[-1]) + 1
            name = f"{task.partitionId():08d}-{part:05d}"
            path = f"{folder}/{name}-{task.taskAttemptId()}.ids"
            system, place = _filesystem(path)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(place) as out:
                out.write(pack_shard(held, doc_ids, nulls, nth))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([len(doc_ids)], pa.int64()), pa.array([count], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])
            held, keys, missing, count, part = [], [], [], 0, part + 1
            return row

        for batch in (s for b in batches for s in split_batches([b], text)):
            new = [x + tail for x in tool.encode_many(batch.column(text).to_pylist())]
            held += new
            column = batch.column(key)
            keys.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            missing.append(column.is_null().to_numpy(zero_copy_only=False))
            count += sum(map(len, new)) // 4
            if count >= SHARD_IDS:
                yield flush()
        if keys:
            yield flush()

    # the text's hash beside the key, so that rows of one key (or of none) can lie in several ranges
    rows = df.select(F.col(key).cast("long").alias(key), text)
    order = [F.col(key).asc_nulls_first(), F.xxhash64(text)]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "shard string, path string, n_docs long, n_ids long")


def read_shards(spark: SparkSession, shards: list[tuple[str, str, int, int]], key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read from the shards through their indexes.

    ``start`` counts the ids of all documents before. Only one row a shard (not a document) is on the driver, to add up the starts.
    """
    base, rows = 0, []
    for name, path, _, n in sorted(shards):
        rows.append((path, base))
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                system, place = _filesystem(path)
                with system.open_input_stream(place) as data:
                    shard = Shard(data.read())
                order = np.argsort(shard.offsets, kind="stable")
                slot = shard.find(shard.doc_ids[order], shard.nulls[order].astype(bool), shard.nth[order])
                if (slot < 0).any():
                    raise ValueError(f"{path}: a stored key is not found")
                at, length = shard.offsets[slot].astype(np.int64), shard.lengths[slot].astype(np.int64)
                sums = [zlib.crc32(shard.ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(at, length)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[slot], pa.int64(), mask=shard.nulls[slot].astype(bool)), pa.array(start + at), pa.array(length), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, base long")
    return listed.repartition(max(1, len(rows)), "path").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def store(df: DataFrame, tokenizer_path: str, folder: str | None = None, **names: str) -> tuple[str, list[tuple[str, str, int, int]]]:
    """Write all shards now; the folder, and (shard, path, n_docs, n_ids) of each."""
    folder = folder or new_folder(df.sparkSession, "token-files")
    return folder, [tuple(r) for r in write_shards(df, folder, tokenizer_path, **names).collect()]
