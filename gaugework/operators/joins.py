"""Joins, with their checks, and similarity joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import cosine_distance
from ..session import settled, ship_package
from .ranks import quantiles


def merge(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return a.join(b, on, how)


def join_many_to_one(a: DataFrame, b: DataFrame, on: list[str], need_match: bool = True) -> DataFrame:
    """Left join; a repeated right key, or (with ``need_match``) a left row without match, raises when it is read."""
    marked = b.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    joined = a.join(marked, on, "left")
    bad = F.when(F.col("_times") > 1, F.raise_error(F.lit("the right side repeats a key")).cast("int"))
    if need_match:
        bad = bad.when(F.col("_times").isNull(), F.raise_error(F.lit("a left row has no match")).cast("int"))
    return joined.filter(F.coalesce(bad, F.lit(0)) == 0).drop("_times")


def join_keeping_order(a: DataFrame, b: DataFrame, on: list[str], order: str) -> DataFrame:
    return a.join(b, on, "left").orderBy(order)


def semi(a: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return a.join(keys.select(on).distinct(), on, "left_semi")


def anti(a: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among the keys; null keys stay."""
    return a.join(keys.select(on).distinct(), on, "left_anti")


def lookup(df: DataFrame, column: str, values: dict, out: str) -> DataFrame:
    """A small dictionary as a column; null where it has no entry."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return df.withColumn(out, F.element_at(table, F.col(column)))


def winner_join(rows: DataFrame, winners: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(winners.select(*on).distinct(), on)


def paired(pred: DataFrame, on: list[str], method: str, a: str, b: str, value: str) -> DataFrame:
    """(on, value_a, value_b) of rows that both methods have."""
    one = pred.filter(F.col(method) == a).select(*on, F.col(value).alias(f"{value}_a"))
    two = pred.filter(F.col(method) == b).select(*on, F.col(value).alias(f"{value}_b"))
    return one.join(two, on)


def twin_join(df: DataFrame, group: str, key: str, twin: str, value: str) -> DataFrame:
    """Each row with the value of its twin in the same group, null without one."""
    other = df.select(F.col(group), F.col(key).alias(twin), F.col(value).alias(f"twin_{value}"))
    return df.join(other, [group, twin], "left")


def band_expansion(df: DataFrame, entry: str, sizes: list[int]) -> DataFrame:
    """A row for each size that is not under the row's entry size; negative entries are in none."""
    fits = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: (F.col(entry) >= 0) & (s >= F.col(entry)))
    return df.withColumn("size", F.explode(fits))


def fold_residual_join(test_by_fold: DataFrame, residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Every test row beside each residual of the fold model that left it out: centres y_pred - residual and + residual."""
    return test_by_fold.join(residuals, keys).withColumns({"low": F.col("y_pred") - F.col("residual"), "high": F.col("y_pred") + F.col("residual")})


def outermost_residuals(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, residual): the residuals of each ``keys`` that give the least ``low`` and the greatest ``high`` of ``fold_residual_join``, at most three, whatever the test rows are.

    Sums and differences never fall where an operand grows, rounded or not, so these are the least and the greatest; as NaN sorts above all numbers, also the greatest number. Null only where no
    residual is known.
    """
    r = F.col("residual")
    ends = F.array_distinct(F.array(F.min(r), F.max(r), F.max(F.when(~F.isnan(r.cast("double")), r))))
    return residuals.groupBy(*keys).agg(ends.alias("_ends")).select(*keys, F.explode("_ends").alias("residual"))


def fold_residual_range(test_by_fold: DataFrame, residuals: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, low, high): the least ``low`` and the greatest ``high`` of ``fold_residual_join``, over each pair of a test row and a residual of its ``keys``; test rows meet the outermost residuals only.

    These are settled, so that their bytes decide how they are joined: few keys are broadcast, and no test rows are shuffled to a few keys' tasks.
    """
    ends = settled(outermost_residuals(residuals, keys), "outermost-residuals")
    return fold_residual_join(test_by_fold, ends, keys).groupBy(*by).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def nearest_tokens(test: DataFrame, train: DataFrame, key: str, train_key: str, token: str, count: str | None = None) -> DataFrame:
    """(key, similarity): the greatest sum(min) / sum(max) of token counts with any training row; of token sets without ``count``.

    A row whose only token is null, or whose counts are all 0, is empty: its similarity is 1 if a training row is empty too, else 0. Rows meet by shared tokens only; no shared token: 0.
    """
    n = F.coalesce(F.col(count).cast("double"), F.lit(0.0)) if count else F.lit(1.0)
    own = F.when(F.col(token).isNotNull(), n).otherwise(0.0)

    def bags(df: DataFrame, k: str, c: str, t: str) -> tuple[DataFrame, DataFrame]:
        summed = df.groupBy(k, token).agg((F.sum(own) if count else F.max(own)).alias(c))
        return summed.filter(F.col(c) > 0), summed.groupBy(k).agg(F.sum(c).alias(t))

    (a, ta), (b, tb) = bags(test, key, "ca", "ta"), bags(train, train_key, "cb", "tb")
    met = a.join(b, token).groupBy(key, train_key).agg(F.sum(F.least("ca", "cb")).alias("common"))
    best = met.join(ta, key).join(tb, train_key).groupBy(key).agg(F.max(F.col("common") / (F.col("ta") + F.col("tb") - F.col("common"))).alias("similarity"))
    empty = tb.agg(F.coalesce(F.max((F.col("tb") == 0).cast("double")), F.lit(0.0)).alias("_empty"))  # one row
    alone = F.when(F.col("ta") == 0, F.col("_empty")).otherwise(0.0)
    return ta.join(best, key, "left").crossJoin(F.broadcast(empty)).select(key, F.coalesce("similarity", alone).alias("similarity"))


#: Largest block of vectors, in rows and in bytes: two blocks meet in one task, as a product of matrices.
BLOCK_VECTORS = 2048
BLOCK_BYTES = 8 << 20


def _vector_blocks(df: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """Rows with whole vectors in blocks: (prefix_keys, prefix_width, prefix_data), vectors as doubles end to end. Vectors that are null or hold a null or NaN are left out."""
    kind = df.schema[key].dataType.simpleString()
    known = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double"))))
    most_rows, most_bytes = BLOCK_VECTORS, BLOCK_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column("v")[0])
            step = max(1, min(most_rows, most_bytes // (8 * width)))
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                flat = part.column("v").flatten().to_numpy()
                if len(flat) != part.num_rows * width:
                    raise ValueError("vectors must have one length")
                keys = part.column("k")
                columns = [pa.ListArray.from_arrays([0, len(keys)], keys), pa.array([width], pa.int32()), pa.array([flat.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f"{prefix}_keys", f"{prefix}_width", f"{prefix}_data"])

    rows = known.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return rows.mapInArrow(pack, f"{prefix}_keys array<{kind}>, {prefix}_width int, {prefix}_data binary")


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosine distances of rows; 0 for two zero vectors."""
    sizes = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
    zero = (np.linalg.norm(a, axis=1) == 0)[:, None] & (np.linalg.norm(b, axis=1) == 0)
    return np.where(zero, 0.0, 1 - (a @ b.T) / np.maximum(sizes, 1e-12))


def euclidean_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of rows, from a product of matrices; those that may be a row's least, within the rounding of such a product, from the differences themselves."""
    sizes = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
    squares = sizes - 2 * (a @ b.T)
    near = squares <= squares.min(axis=1, keepdims=True) + 1e-12 * sizes.max()
    out = np.sqrt(np.maximum(squares, 0))
    at = np.flatnonzero(near.ravel())
    for k in range(0, len(at), 1 << 16):
        i, j = np.unravel_index(at[k : k + (1 << 16)], near.shape)
        gap = a[i] - b[j]
        out[i, j] = np.sqrt((gap * gap).sum(axis=1))
    return out


def _nearest(df: DataFrame, reference: DataFrame, key: str, vector: str, reference_key: str, reference_vector: str, distances: Callable, others_only: bool = False) -> DataFrame:
    """(key, nearest, distance): the reference row of least distance, rounded to nine places; of equals the least key. With ``others_only``, rows of the same key are passed over.

    Both sides become blocks of bounded size; each block of rows meets each reference block once, and a row leaves a task with one reference at most.
    """
    spark = df.sparkSession
    ship_package(spark)
    mine, theirs = _vector_blocks(df, key, vector, "q"), _vector_blocks(reference, reference_key, reference_vector, "r")
    theirs = settled(theirs.withColumn("_b", F.monotonically_increasing_id()), "vector-blocks")
    numbers = theirs.agg(F.sort_array(F.collect_list("_b")).alias("_all"))  # a number for each block of the reference
    met = mine.crossJoin(numbers).withColumn("_b", F.explode("_all")).drop("_all").join(theirs, "_b")
    kinds = f"k {df.schema[key].dataType.simpleString()}, d double, n {reference.schema[reference_key].dataType.simpleString()}"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            (keys, a), (names, b) = ((row.column(f"{p}_keys").flatten(), np.frombuffer(row.column(f"{p}_data")[0].as_py()).reshape(-1, row.column(f"{p}_width")[0].as_py())) for p in "qr")
            if a.shape[1] != b.shape[1]:
                raise ValueError("vectors must have one length")
            order = pc.array_sort_indices(names)
            names, b = names.take(order), b[order.to_numpy()]
            far = np.round(distances(a, b), 9)
            if others_only:
                same = keys.dictionary_encode()
                place = pc.index_in(names, same.dictionary).to_numpy(zero_copy_only=False)
                far[same.indices.to_numpy(zero_copy_only=False)[:, None] == place] = np.inf
            at = far.argmin(axis=1)  # the first of equals, so the least key
            least = far[np.arange(len(far)), at]
            found = pa.array(np.isfinite(least))
            yield pa.RecordBatch.from_arrays([keys.filter(found), pa.array(least).filter(found), names.take(pa.array(at)).filter(found)], names=["k", "d", "n"])

    best = met.select("q_keys", "q_width", "q_data", "r_keys", "r_width", "r_data").mapInArrow(compare, kinds).groupBy("k").agg(F.min(F.struct("d", "n")).alias("x"))
    return best.select(F.col("k").alias(key), F.col("x.n").alias("nearest"), F.col("x.d").alias("distance"))


def nearest_euclidean(df: DataFrame, reference: DataFrame, key: str, vector: str, reference_vector: str) -> DataFrame:
    """(key, distance), to nine places, to the closest reference vector. Vectors that are null or hold a null or NaN are left out on both sides."""
    named = reference.select(F.lit(0).alias("_r"), reference_vector)
    return _nearest(df, named, key, vector, "_r", reference_vector, euclidean_distances).select(key, "distance")


def nearest_cosine(df: DataFrame, reference: DataFrame, key: str, vector: str, reference_key: str, reference_vector: str) -> DataFrame:
    """(key, nearest, distance): the reference of least cosine distance; of equals the least key. Vectors that are null or hold a null or NaN are left out on both sides."""
    return _nearest(df, reference, key, vector, reference_key, reference_vector, cosine_distances)


def min_max_scaled(df: DataFrame, bounds_of: DataFrame, vector: str) -> DataFrame:
    """``df`` with each component of ``vector`` scaled to 0 and 1 between its least and greatest in ``bounds_of``; components that do not vary become 0. Null vectors stay null."""
    parts = bounds_of.select(F.posexplode(vector).alias("_p", "_x")).groupBy("_p").agg(F.min(F.col("_x").cast("double")).alias("_l"), F.max(F.col("_x").cast("double")).alias("_h"))
    sides = parts.agg(F.sort_array(F.collect_list(F.struct("_p", "_l", "_h"))).alias("_b"))  # a row of as many entries as a vector
    scaled = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.col("_b").alias("b")), lambda z: F.coalesce(F.try_divide(z["x"].cast("double") - z["b"]["_l"], z["b"]["_h"] - z["b"]["_l"]), F.when(z["x"].isNotNull(), F.lit(0.0))))
    return df.crossJoin(F.broadcast(sides)).withColumn(vector, F.when(F.col(vector).isNotNull(), scaled)).select(*df.columns)


def retrieval(canonical: DataFrame, variants: DataFrame, key: str, vector: str) -> DataFrame:
    """(n, retrieval_share, median_distance_ratio): the share of variant vectors whose nearest canonical vector by cosine is their own entity's (of equals the least key), and the
    median ratio of a variant's distance from its own to the distance between that and the nearest other entity's (1e-12 at least; a lone entity has none, and the ratio 0). Variants without a canonical vector are left out."""
    own = canonical.select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    numbered = variants.select(F.col(key).alias("_own"), F.col(vector).alias("_x")).join(own, F.col("_own") == F.col("_k")).drop("_k")
    numbered = settled(numbered.withColumn("_id", F.monotonically_increasing_id()), "variants")
    near = nearest_cosine(numbered, own, "_id", "_x", "_k", "_v").select("_id", "nearest")
    asked = own.join(numbered.select(F.col("_own").alias("_k")).distinct(), "_k", "left_semi")
    others = _nearest(asked, own.select(F.col("_k").alias("_o"), F.col("_v").alias("_w")), "_k", "_v", "_o", "_w", cosine_distances, others_only=True).select("_k", F.col("distance").alias("_far"))
    rows = numbered.join(near, "_id").join(others, F.col("_own") == F.col("_k"), "left").withColumn("_far", F.coalesce("_far", F.lit(float("inf"))))
    ratio = cosine_distance(F.col("_x"), F.col("_v")) / F.greatest("_far", F.lit(1e-12))
    one = settled(rows.select((F.col("nearest") == F.col("_own")).cast("double").alias("_hit"), ratio.alias("_ratio")), "retrieved")
    middle = quantiles(one, [], "_ratio", [0.5]).select(F.col("q")[0].alias("median_distance_ratio"))
    return one.agg(F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("retrieval_share")).join(middle, F.lit(True), "left")


def row_cosine(df: DataFrame, a: str, b: str, out: str = "distance") -> DataFrame:
    return df.withColumn(out, cosine_distance(F.col(a), F.col(b)))
