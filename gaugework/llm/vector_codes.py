"""Product codes of vectors in whole numbers, with nearest entries found in a GNAT.

Each part position has a codebook of up to 256 entries. A codebook becomes a geometric near-neighbour access tree: a node has split points
far from each other, every other entry goes to its nearest split, and the node stores, for each pair of splits, the least and greatest distance from
the one to the other's entries. A query that is at distance d from a split, with an entry known at distance r, cannot have a nearer or an equally near entry
among those whose range lies strictly outside [d - r, d + r]; such subtrees are left out whole. Ranges and distances are rounded
outwards, so rounding never leaves out an entry; what is visited is compared by squared distances in whole numbers, ties to the lower index.

Queries go down the tree many at once: a node is a few numpy steps for all the queries that reach it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node, and entries up to which a node has no splits.
DEGREE, LEAF = 16, 16
#: Queries that go down a tree together.
TOGETHER = 8192
#: Greatest absolute component after scaling. Squared distances of parts up to 16 wide then stay below 2 ** 62; wider parts have a lower bound.
GREATEST = 1 << 28


def exact_kind(*tables: np.ndarray) -> type:
    """The number type for squared distances: doubles, which multiply faster, where every sum stays a whole number in them."""
    most = max(int(np.abs(t).max(initial=0)) for t in tables)
    return np.float64 if 4 * tables[0].shape[1] * most * most < 1 << 52 else np.int64


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number points (rows) and entries, both of one ``exact_kind``."""
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(axis=1)


def rounded(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers at or below, and at or above, the roots of whole numbers, each off by a few units in the last place at most."""
    roots = np.sqrt(squares.astype(np.float64))
    slack = roots * 2.0**-50
    return roots - slack, roots + slack


@dataclass
class Node:
    """``splits``: entries' numbers. ``low`` and ``high`` [i, j]: bounds of the distances from split i to split j and all entries below it."""

    splits: np.ndarray
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    below: list[Node | None] = field(default_factory=list)


class Gnat:
    """The tree over one codebook. ``visited`` counts distances to entries, ``queries`` points that were looked up."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, dtype=np.int64)
        kind = exact_kind(self.entries)
        self.squares = squared_distances(self.entries.astype(kind), self.entries.astype(kind))
        self.root = self.node(np.arange(len(self.entries)))
        self.visited = self.queries = 0

    def node(self, members: np.ndarray) -> Node:
        if len(members) <= LEAF:
            return Node(members)
        chosen = [0]  # places in members; each next split is the member furthest from the splits so far
        nearest = self.squares[members[0], members].copy()
        while len(chosen) < DEGREE:
            nearest[chosen] = -1
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, self.squares[members[chosen[-1]], members])
        splits = np.sort(members[chosen])
        rest = np.setdiff1d(members, splits)
        owner = self.squares[np.ix_(splits, rest)].argmin(axis=0)
        low, high = np.empty((DEGREE, DEGREE)), np.empty((DEGREE, DEGREE))
        below: list[Node | None] = []
        for j in range(DEGREE):
            own = rest[owner == j]
            reach = self.squares[np.ix_(splits, np.append(splits[j], own))]
            low[:, j], high[:, j] = rounded(reach.min(axis=1))[0], rounded(reach.max(axis=1))[1]
            below.append(self.node(own) if len(own) else None)
        return Node(splits, low, high, below)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, the lowest of equally near ones, and the squared distance (int64)."""
        kind = exact_kind(points, self.entries)
        entries = self.entries.astype(kind)
        at, best = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
        for a in range(0, len(points), TOGETHER):
            search = _Search(entries, points[a : a + TOGETHER].astype(kind))
            search.visit(self.root, np.arange(len(search.points)))
            at[a : a + TOGETHER], best[a : a + TOGETHER] = search.at, search.best.astype(np.int64)
            self.visited += search.visited
        self.queries += len(points)
        return at, best


class _Search:
    """Points on their way down a tree, with the entry known so far (``at``) and its squared distance."""

    def __init__(self, entries: np.ndarray, points: np.ndarray):
        self.entries, self.points = entries, points
        self.entry_norms, self.point_norms = (entries * entries).sum(axis=1), (points * points).sum(axis=1)
        self.best = np.full(len(points), np.iinfo(np.int64).max, dtype=points.dtype)
        self.at = np.full(len(points), len(entries))
        self.visited = 0

    def visit(self, node: Node, rows: np.ndarray) -> None:
        squares = self.point_norms[rows, None] - 2 * (self.points[rows] @ self.entries[node.splits].T) + self.entry_norms[node.splits]
        self.visited += squares.size
        first = squares.argmin(axis=1)  # splits ascend, so the lowest index of equally near ones
        least, index = squares[np.arange(len(rows)), first], node.splits[first]
        best, at = self.best[rows], self.at[rows]
        nearer = (least < best) | ((least == best) & (index < at))  # in whole numbers
        self.best[rows], self.at[rows] = np.where(nearer, least, best), np.where(nearer, index, at)
        if not node.below:
            return
        near, far = rounded(np.ascontiguousarray(squares.T))
        # no entry below split j is nearer than bound[j]: by the triangle inequality through any split
        bound = np.zeros_like(near)
        for i in range(len(near)):
            np.maximum(bound, near[i] - node.high[i][:, None], out=bound)
            np.maximum(bound, node.low[i][:, None] - far[i], out=bound)
        for j, below in enumerate(node.below):  # where a near entry is likely, so that the others are left out early
            if below:
                self.visit(below, rows[first == j])
        for j, below in enumerate(node.below):
            if below:
                radius = rounded(self.best[rows])[1]
                self.visit(below, rows[(first != j) & (bound[j] <= radius)])


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def scaled(df: DataFrame, key: str, vector: str, label: str, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(key, label, x array<long>): kept vectors as floor(scale * component).

    Dropped: null and empty vectors, and those with a null or non-finite component. A component whose result exceeds ``GREATEST``, a vector of another
    length than others, or a length that ``parts`` does not divide, raises.
    """
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = df.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: F.coalesce(bad(x.cast("double")), F.lit(True))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return kept.select(F.col(key).alias(key), F.col(label).alias(label), whole.alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    lists = batch.column("x")
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(lists) * width:
        raise ValueError(f"vectors must all have {width} components")
    if len(flat) and int(np.abs(flat).max()) > GREATEST // max(1, int(np.ceil(np.sqrt(width / PARTS / 16)))):
        raise ValueError("a component is too large for exact squared distances in 64 bits")
    return flat.reshape(len(lists), width)


def _assigned(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch, its matrix, and the entries (parts x rows) and squared distances found."""
    trees = [Gnat(b) for b in books]
    size = books[0].shape[1]
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, size * len(books))
            found = [tree.nearest(x[:, p * size : (p + 1) * size]) for p, tree in enumerate(trees)]
            yield batch, x, np.array([f[0] for f in found]), np.array([f[1] for f in found])


def means(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the floored mean of the parts nearest to it; an unused one stays.

    A task sends one row of sums for each entry that it used; Spark adds those up, and the driver gets one row an entry.
    """
    size = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), size), dtype=np.int64) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for _, x, entry, _ in _assigned(batches, books):
            for p in range(len(books)):
                order = np.argsort(entry[p], kind="stable")
                used, starts = np.unique(entry[p][order], return_index=True)
                total[p][used] += np.add.reduceat(x[order, p * size : (p + 1) * size], starts, axis=0)
                count[p][used] += np.diff(np.append(starts, len(order)))
        for p in range(len(books)):
            used = np.flatnonzero(count[p])
            if len(used):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * size, pa.int32()), pa.array(total[p][used].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(count[p][used]), flat], names=["part", "entry", "n", "total"])

    partial = vectors.select("x").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    whole = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"))
    new = [b.copy() for b in books]
    for row in whole.collect():  # at most parts x entries rows
        new[row["part"]][row["entry"]] = [t // row["n"] for t in row["total"]]
    return new


def train(vectors: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one a part: the parts of the ``entries`` vectors of least key (nulls last, then by components), moved ``rounds`` times. None for an empty table."""
    first = [r["x"] for r in vectors.orderBy(F.asc_nulls_last(key), "x").select("x").limit(entries).collect()]  # a fixed number of rows
    if not first:
        return []
    if len({len(x) for x in first}) > 1 or len(first[0]) % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    books = np.split(np.array(first, dtype=np.int64), parts, axis=1)
    for _ in range(rounds):
        books = means(vectors, books)
    return books


def encode(vectors: DataFrame, key: str, label: str, books: list[np.ndarray]) -> DataFrame:
    """(key, label, code, error): indexes of the nearest entries in part order, two hex digits each, and the summed squared distances."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, entry, squares in _assigned(batches, books):
            codes = [bytes(c).hex() for c in np.ascontiguousarray(entry.T.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(squares.sum(axis=0))], names=["k", "l", "code", "error"])

    return vectors.select(key, label, "x").mapInArrow(run, f"k {kinds[key]}, l {kinds[label]}, code string, error long").withColumnsRenamed({"k": key, "l": label})


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each kept vector; ``entries`` up to 256.

    Rows whose vector is null or empty, or holds a null or non-finite component, are dropped. Keys may be null or repeat: each row has its own
    result, and null keys come last among the first entries. ``label_error`` sums ``error`` over equal labels, nulls together. With fewer vectors than
    entries a codebook has as many entries as there are vectors. Other columns are dropped, whatever their names; an empty table gives an empty one.
    """
    if entries > 256:
        raise ValueError("codes have one byte a part: 256 entries at most")
    spark = df.sparkSession
    vectors = written(spark, scaled(df, key, vector, label, parts=parts), "vectors", compression="zstd")
    books = train(vectors, key, parts, entries, rounds)
    if not books:
        kind = df.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(spark, encode(vectors, key, label, books), "vector-codes", finished=[vectors])
    of_label = coded.groupBy(F.col(label).alias("_l")).agg(F.sum("error").alias("label_error"))
    both = coded.join(of_label, F.col(label).eqNullSafe(F.col("_l")))
    return both.select(key, "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
