"""Best-fit decreasing packing in buckets, with lower bounds that certify each bucket's number of sequences.

Pieces are dealt to buckets by hash. Each bucket is packed best-fit decreasing and compared with the largest of a family of bounds from
dual-feasible functions. A bucket that meets its bound keeps all but its emptiest sequence; one with a gap keeps its full
sequences only. What is let go is dealt to fewer buckets and packed again, until one round has a single bucket or settles little.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_words import encoder
from .common import dealt, split_batches, with_fields, written

CAPACITY = 1024
BUCKET_ROWS = 40_000


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole, or cut into ``capacity`` ids with the odd ones first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(a, capacity) for a in range(first, n, capacity)]


def pieces(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document; a null text counts as empty and gives the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer_path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in (s for b in batches for s in split_batches([b], text)):
            where, rows, parts = [], [], []
            for k, ids in enumerate(tool.encode_many(batch.column(text).to_pylist())):
                ids += tail
                for p, (a, n) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    part = ids[4 * a : 4 * (a + n)]
                    where.append(k)
                    rows.append((p, a, n, zlib.crc32(part)))
                    parts.append(part if keep_ids else b"")
            p, a, n, crc = zip(*rows)
            columns = [batch.column(key).take(pa.array(where)), pa.array(p, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) // 4 for x in parts]))), pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(key, text).mapInArrow(run, with_fields([df.schema[key]], "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Equal lengths keep their order; the fullest bin that has room is taken."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r: some bin has exactly r ids of room
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen, count = capacity, count, count + 1
        bins[k], offsets[k] = chosen, capacity - room
        left = room - n
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(chosen)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing needs fewer bins: the largest bound of two families of dual-feasible functions, and of the plain sum."""
    if not len(lengths):
        return 0
    times = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(times @ size) // capacity)
    many, mass = np.cumsum(times), np.cumsum(times * size)
    for low in range(1, capacity // 2 + 1):  # sizes under ``low`` count 0, those over capacity - low a whole bin
        large = int(many[-1] - many[capacity - low])
        middle = int(mass[capacity - low] - mass[low - 1])
        best = max(best, large - (-middle // capacity))
    for k in range(1, 33):  # sizes rounded down to k-ths of a bin, unless they are exact parts of k + 1
        part = (k + 1) * size
        scaled = np.where(part % capacity == 0, size * k, part // capacity * capacity)
        best = max(best, -(-int(times @ scaled) // (k * capacity)))
    return best


#: Columns that ``pack`` adds; the last is its own and goes.
ADDED = ["sequence_id", "offset", "certified", "_settled"]
_BUCKET = "_bucket"


def _placer(turn: int, final: bool, capacity: int, key: str):
    def place(table: pa.Table) -> pa.Table:
        bucket = table.column(_BUCKET)[0].as_py()
        table = table.drop_columns([_BUCKET]).sort_by([(key, "ascending"), ("piece", "ascending"), ("length", "ascending")])
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=count)
        certified = count == lower_bound(lengths, capacity)
        if final:
            keep = np.ones(count, dtype=bool)
        elif certified:
            keep = np.arange(count) != int(np.argmin(fill))
        else:
            keep = fill == capacity
        for name, values in zip(ADDED, ((turn << 56) + (bucket << 32) + bins, offsets, np.full(len(bins), certified), keep[bins])):
            table = table.append_column(name, pa.array(values))
        return table

    return place


def pack(parts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``parts`` (with key, piece, length and any other columns) with sequence_id, offset and certified; every row is placed once.

    ``certified``: the row's bucket took as few sequences as its lower bound, in the round that placed the row. Rounds go on until one has a
    single bucket, or until one settles less than a tenth of its rows: then the rest is taken as it is packed, and its rows tell whether that
    met the bound. Columns of the names above (and _bucket, _settled) are replaced. An empty table gives an empty one. Lengths must be 1 to ``capacity``.
    Repeated rows are packed as rows of their own; keys may be null.
    """
    spark = parts.sparkSession
    left, done = parts.drop(*ADDED, _BUCKET), None
    schema = with_fields(left.schema.fields, "sequence_id long, offset long, certified boolean, _settled boolean")
    turn, rows, before = 0, left.count(), None
    while True:
        buckets = max(1, -(-rows // bucket_rows))
        final = buckets == 1 or before is not None and rows > 0.9 * before
        spread = left.withColumn(_BUCKET, F.pmod(F.xxhash64(F.col(key), F.col("piece"), F.lit(turn)), F.lit(buckets)).cast("int"))
        placed = written(spark, dealt(spread, buckets, _BUCKET).groupBy(_BUCKET).applyInArrow(_placer(turn, final, capacity, key), schema), f"packed-{turn}")
        settled = placed.filter("_settled").drop("_settled")
        done = settled if done is None else done.unionByName(settled)
        if final:
            return done
        left = placed.filter("not _settled").drop(*ADDED)
        before, rows, turn = rows, left.count(), turn + 1
