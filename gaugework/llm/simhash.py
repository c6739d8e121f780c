"""Near-duplicates by SimHash fingerprints that differ in few bits, found through fuzzy keys from the binary Golay code.

1. A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the hashes of the text's shingles.
2. The Golay code has 4096 codewords of 23 bits, and each 23-bit word lies within 3 bits of exactly one. A word's keys are the indexes of all
   codewords within 4 bits: one if the own codeword is within 2 bits, else six. Two words that differ in up to 2 bits share a key: the word halfway between them
   is within 3 bits of its codeword, so both are within 4 of that.
3. A fingerprint is cut into three segments of at most 23 bits. Two errors leave a segment without any, and one of the segments beside it, in a fixed cyclic
   order, with at most one. So each fingerprint has, for each segment, the segment itself joined with each Golay key of the next one:
   3 to 18 keys of 35 bits, and two fingerprints at 2 bits or fewer share one.
4. Different fingerprints that share a key are compared by counting bits. A key of more than ``MOST`` fingerprints is not compared pair by pair: its fingerprints meet in
   the words one bit from them instead. Two fingerprints lie within 2 bits if and only if they share such a word (or one is it), at most 65 fingerprints are near
   one word, and each is linked to the least of them. So no key, however large, is one task's work or grows by the square.

Copies have one fingerprint, which is carried once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_table, split_batches, written
from .components import components
from .ngram_join import words_of

WIDTH, SEED, BITS = 3, 42, 2
#: First bits and widths of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a key that are compared pair by pair; a fingerprint has as many neighbours at one bit.
MOST = 64
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a fixed value.
GENERATOR = 0b110001110101
#: Hashes whose bits are counted together.
TOGETHER = 1 << 17


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> bytes:
    """XXH64 (eight bytes each, the highest first) of all shingles, repeats included; of the whole sequence if there are fewer words; none without words."""
    if not words:
        return b""
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())])


def fingerprints(hashes: list[bytes]) -> np.ndarray:
    """The fingerprint (uint64) of each text's hashes: the bits set in over half of them; 0 where there are none."""
    lengths = np.fromiter(map(len, hashes), np.int64, len(hashes)) // 8
    owner = np.repeat(np.arange(len(hashes)), lengths)
    flat = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    count = np.zeros((len(hashes), 64), dtype=np.int64)
    for a in range(0, len(flat), TOGETHER):
        bits = np.unpackbits(flat[a : a + TOGETHER], axis=1)
        own, starts = np.unique(owner[a : a + TOGETHER], return_index=True)
        count[own] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * count > lengths[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder (11 bits) of 23-bit words divided by the generator: 0 for codewords, and equal for equal errors of codewords."""
    rest = words.astype(np.int64)
    for shift in range(11, -1, -1):
        rest ^= np.where(rest >> (11 + shift) & 1, GENERATOR << shift, 0)
    return rest


def nearby_errors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: how many errors of up to 4 bits have it (1 or 6), and those errors, that of up to 3 bits first."""
    count, errors = np.zeros(2048, dtype=np.int64), np.zeros((2048, 6), dtype=np.int64)
    for weight in range(5):
        flips = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], dtype=np.int64)
        for s, e in zip(syndromes(flips).tolist(), flips.tolist()):
            errors[s, count[s]] = e
            count[s] += 1
    return count, errors


@cache
def _decoder() -> tuple[np.ndarray, ...]:
    """Syndromes of the lower 12 bits and of the upper 11, and the table of errors."""
    return syndromes(np.arange(4096)), syndromes(np.arange(2048) << 12), *nearby_errors()


def nearby_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the codewords within 4 bits of each 23-bit word, end to end, and how many each word has."""
    low, high, count, errors = _decoder()
    syndrome = low[words & 4095] ^ high[words >> 12]
    many = count[syndrome]
    place = np.repeat(np.arange(len(words)), many)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
    return (words[place] ^ errors[syndrome[place], nth]) >> 11, many


def fuzzy_keys(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (int64) of fingerprints (uint64), and each one's place among them. A key: 2 bits for the segment, the segment, 12 bits for a codeword of the next."""
    keys, places = [], []
    parts = [(marks >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    for n, exact in enumerate(parts):
        index, many = nearby_codewords(parts[(n + 1) % len(parts)])
        place = np.repeat(np.arange(len(marks)), many)
        keys.append((n << 34) | (exact[place] << 12) | index)
        places.append(place)
    return np.concatenate(keys), np.concatenate(places)


def marked(df: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(key, mark long): each text's fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in split_batches([b], "t", size=2 << 20)):
            marks = fingerprints([shingle_hashes(words_of(t), width) for t in batch.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(marks.view(np.int64))], names=["k", "mark"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, mark long").withColumnRenamed("k", key)


def keyed(marks: DataFrame) -> DataFrame:
    """(key long, mark long): the fuzzy keys of each mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            keys, place = fuzzy_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[place])], names=["key", "mark"])

    return marks.select("mark").mapInArrow(run, "key long, mark long")


def close_pairs(groups: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): pairs within ``bits`` bits in each row's ``marks``, a bounded array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().view(np.uint64)
            start = np.cumsum(size) - size
            found = []
            for n in np.unique(size[size > 1]).tolist():  # groups of one size together
                members = flat[start[size == n][:, None] + np.arange(n)]
                i, j = np.triu_indices(n, 1)
                for k in range(0, len(members), max(1, TOGETHER // len(i))):
                    some = members[k : k + max(1, TOGETHER // len(i))]
                    near = np.bitwise_count(some[:, i] ^ some[:, j]) <= bits
                    found.append(np.stack([some[:, i][near], some[:, j][near]]))
            a, b = np.concatenate(found, axis=1).view(np.int64) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return groups.select("marks").mapInArrow(run, "a long, b long")


def star_links(marks: DataFrame) -> DataFrame:
    """(a, b): links of the same components as all pairs of ``marks`` (different ones) within 2 bits.

    Each mark meets others in the 65 words at most one bit from it; a word has 65 marks at most, each is linked to the least.
    """
    words = F.concat(F.array("mark"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("mark").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    met = marks.select("mark", F.explode(words).alias("word")).groupBy("word").agg(F.collect_list("mark").alias("near")).filter(F.size("near") > 1)
    return met.select(F.explode("near").alias("a"), F.array_min("near").alias("b")).filter("a <> b").distinct()


def link_marks(marks: DataFrame, most: int = MOST) -> DataFrame:
    """(node, component) of the ``marks`` (different ones) that lie within 2 bits of another."""
    spark = marks.sparkSession
    keys = written(spark, keyed(marks), "fuzzy-keys")
    sizes = written(spark, keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key-sizes")
    small = keys.join(sizes.filter(F.col("n") <= most), "key").groupBy("key").agg(F.collect_list("mark").alias("marks"))
    large = keys.join(sizes.filter(F.col("n") > most), "key", "left_semi").select("mark").distinct()
    links = written(spark, close_pairs(small).distinct().unionByName(star_links(large)), "links")
    for table in (keys, sizes):
        delete_table(spark, table)
    return components(links)


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, most: int = MOST) -> DataFrame:
    """(key, fingerprint, component_id): 16 hex digits, and the smallest key that links reach from the row, itself included.

    Texts are lower-cased (A-Z) and cut into words; shingles are ``width`` words joined by single spaces, repeats included; fewer words are one shingle. Two rows link
    when their fingerprints differ in 2 bits or fewer. A null, empty or blank text has fingerprint zero and links like any other. Repeated
    keys are rows of their own; null keys count in no minimum (a group of null keys alone has a null id). Texts are read whole, other columns
    dropped, whatever their names; an empty table gives an empty one.
    """
    spark = df.sparkSession
    rows = written(spark, marked(df, key, text, width), "marks")
    own = written(spark, rows.groupBy("mark").agg(F.min(key).alias("least")), "distinct-marks")
    labels = link_marks(own)
    group = own.join(labels, own["mark"] == labels["node"], "left").select("mark", "least", F.coalesce("component", "mark").alias("group"))
    group = written(spark, group, "mark-groups", finished=[own, labels])
    least = group.groupBy("group").agg(F.min("least").alias("component_id"))
    named = group.join(least, "group").select("mark", "component_id")
    hexed = F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint")
    return rows.join(named, "mark").select(key, hexed, "component_id")
