"""Intervals with coverage from held-out residuals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import settled, ship_package
from .ranks import ascending, cut_points, null_safe_join, quantiles, ranked
from .windows import order_stat

INF = float("inf")


def upper_rank(alpha: float):
    return F.ceil((1 - alpha) * (F.col("n") + 1) - 1e-9)


def split_width(cal: DataFrame, by: list[str], residual: str, alpha: float) -> DataFrame:
    """(by, width, n): the rank ceil((1 - alpha)(n + 1)) absolute residual; infinite beyond n."""
    return order_stat(cal.withColumn("_a", F.abs(F.col(residual))), by, "_a", upper_rank(alpha)).withColumnRenamed("stat", "width")


def normalised_width(cal: DataFrame, test: DataFrame, by: list[str], residual: str, scale: str, alpha: float) -> DataFrame:
    """Test rows with ``width``: the ranked ratio of residual to scale plus beta, times the own scale plus beta; beta is the median scale.

    Null groups are groups; calibration rows that lack the residual or the scale do not count, and test rows of a group without any are left out. Where residual to scale plus beta is a division by zero,
    the ratio is infinite, or zero for a residual of zero.
    """
    beta = quantiles(cal, by, scale, [0.5]).select(*by, F.col("q")[0].alias("_beta"))
    size, unit = F.abs(F.col(residual)), F.col(scale) + F.col("_beta")
    ratio = null_safe_join(cal, beta, by).withColumn("_ratio", F.when(unit != 0, F.try_divide(size, unit)).when(size == 0, 0.0).when(size > 0, INF))
    both = null_safe_join(order_stat(ratio, by, "_ratio", upper_rank(alpha)).select(*by, "stat"), beta, by)
    return null_safe_join(test, both, by).withColumn("width", F.when(F.col("stat") == INF, INF).otherwise(F.col("stat") * unit)).drop("stat", "_beta")


#: Values of a node of the search trees, and test rows of a block.
FAN, BLOCK_ROWS = 256, 4096
NODE = "list string, level int, node long, v array<double>, upto array<long>"


def residual_trees(residuals: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    """A search tree over each list of absolute residuals, a row a node (``NODE``), and the trees' greatest height.

    Level 0 has the list's different values, ``FAN`` a node, each with the number of residuals up to it; a node above has its children's last entries, child j of
    node i being node i * FAN + j. Lists are ranked by ranges of values; no task or row holds more than a node.
    """
    known = residuals.dropna(subset=names).select(F.to_json(F.struct(*names)).alias("list"), F.abs(F.col("residual").cast("double")).alias("v")).filter("v is not null and not isnan(v)")
    each = known.groupBy("list", "v").agg(F.count(F.lit(1)).alias("_c"))
    one = ranked(each, ["list"], ["v"], F.col("_c"), cut_points(known, ["list"], ascending("v")))
    entries = one.select("list", (F.col("_r") - 1).alias("_at"), "v", (F.col("_before") + F.col("_c")).alias("upto"))
    levels = []
    while True:
        parts = entries.groupBy("list", F.floor(F.col("_at") / FAN).alias("node")).agg(F.sort_array(F.collect_list(F.struct("v", "upto"))).alias("e"))
        nodes = parts.select("list", F.lit(len(levels)).alias("level"), "node", F.col("e.v").alias("v"), F.col("e.upto").alias("upto"))
        levels.append(settled(nodes, "residual-tree"))
        if (levels[-1].agg(F.max("node")).first()[0] or 0) == 0:
            return reduce(DataFrame.unionByName, levels), len(levels)
        entries = levels[-1].select("list", F.col("node").alias("_at"), F.element_at("v", -1).alias("v"), F.element_at("upto", -1).alias("upto"))


def _row_blocks(centres: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """Test rows in blocks: keys, each row's number of centres, and the centres with their lists, end to end."""
    kinds = ", ".join(f"`{c}`: {centres.schema[c].dataType.simpleString()}" for c in key)
    pair = F.struct(F.to_json(F.struct(*names)).alias("list"), F.col("y_pred").cast("double").alias("c"))
    rows = centres.filter("y_pred is not null").dropna(subset=names).groupBy(*key).agg(F.sort_array(F.collect_list(pair)).alias("_m"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in (b.slice(a, BLOCK_ROWS) for b in batches for a in range(0, b.num_rows, BLOCK_ROWS)):
            own, met = batch.column("_k"), batch.column("_m")
            size, flat = pc.list_value_length(met).cast(pa.int64()), met.flatten()
            lists = [own, size, flat.field("list"), flat.field("c")]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.ListArray.from_arrays([0, len(x)], x) for x in lists)], names=["block", "keys", "sizes", "lists", "at"])
            number += 1

    return rows.select(F.struct(*key).alias("_k"), "_m").mapInArrow(pack, f"block long, keys array<struct<{kinds}>>, sizes array<long>, lists array<string>, at array<double>")


class KnownList:
    """What a block knows of one list: some of its values, ascending, and how many residuals are up to each; the last value is always known."""

    def __init__(self, values: np.ndarray, upto: np.ndarray):
        self.values, first = np.unique(values, return_index=True)
        self.upto = upto[first]
        self.least = np.append(0, self.upto)  # residuals at or below x, at least, by the number of known values at or below x
        self.most = np.append(self.upto - 1, self.upto[-1:])  # and at most

    def counts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.values, x, "right")
        return self.least[at], self.most[at]


def nth_of_shifted(shifts: np.ndarray, lists: list[KnownList], rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the ``rank``-th least of shift + value over the lists, for each row of ``shifts`` (a column a list); equal where the known values tell it.

    Values are bisected. The lower bound is where the counts can reach the rank at the earliest, the upper one where they surely do.
    """
    top = [v.values[np.isfinite(v.values)][-1:] for v in lists]
    bottom = np.min([shifts[:, j] for j in range(len(lists))], axis=0) - 1.0
    ceiling = np.max([shifts[:, j] + (t[0] if len(t) else 0.0) for j, t in enumerate(top)], axis=0)
    bounds = []
    for kind in (1, 0):
        total = lambda t: sum(v.counts(t - shifts[:, j])[kind] for j, v in enumerate(lists))  # noqa: B023, E731
        low, high = bottom.copy(), ceiling.copy()
        while True:
            middle = low + (high - low) / 2
            if not ((middle > low) & (middle < high)).any():
                break
            enough = total(middle) >= rank
            low, high = np.where(enough, low, middle), np.where(enough, middle, high)
        bounds.append(np.where(total(ceiling) >= rank, high, INF))
    # the value itself instead of a neighbour by rounding
    options = []
    for j, v in enumerate(lists):
        at = np.searchsorted(v.values, bounds[1] - shifts[:, j])
        options += [shifts[:, j] + v.values[np.clip(at + d, 0, len(v.values) - 1)] for d in (-1, 0)]
    near = np.array(options)
    with np.errstate(invalid="ignore"):
        value = near[np.nanargmin(np.where(np.isnan(gap := np.abs(near - bounds[1])), INF, gap), axis=0), np.arange(len(shifts))]
    return bounds[0], np.where(np.isfinite(bounds[1]), value, INF)


def _told(mine: pa.Table, replies: pa.Table) -> tuple[pa.Array, dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]], dict[str, KnownList], dict[str, list]]:
    """A block's keys, its rows and centres by the lists that they meet, what is known of each list, and the nodes that were read."""
    row = mine.combine_chunks().to_batches()[0]
    known: dict[str, list] = {}
    for name, level, node, v, upto in zip(*(replies.column(c).to_pylist() for c in ("list", "level", "node")), *([np.asarray(x.values) for x in replies.column(c)] for c in ("v", "upto"))):
        known.setdefault(name, []).append((level, node, v, upto))
    lists = {k: KnownList(np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts])) for k, parts in known.items()}
    names, at = row.column("lists").flatten().to_pylist(), row.column("at").flatten().to_numpy()
    rows: dict[tuple[str, ...], list[int]] = {}
    values: dict[tuple[str, ...], list] = {}
    start = 0
    for k, n in enumerate(row.column("sizes").flatten().to_pylist()):
        found = [i for i in range(start, start + n) if names[i] in lists]
        start += n
        if found:
            met = tuple(names[i] for i in found)
            rows.setdefault(met, []).append(k)
            values.setdefault(met, []).append(at[found])
    return row.column("keys").flatten(), {m: (np.array(rows[m]), np.array(values[m])) for m in rows}, lists, known


def _ranks(lists: list[KnownList], alpha: float) -> tuple[int, int, int]:
    n = int(sum(v.upto[-1] for v in lists))
    return n, math.floor(alpha * (n + 1) + 1e-9), math.ceil((1 - alpha) * (n + 1) - 1e-9)


def cv_plus(centres: DataFrame, residuals: DataFrame, fold: str, key: list[str], alpha: float, group: list[str] = ()) -> DataFrame:
    """(key, lower, upper): ranks among y_pred - |r| and y_pred + |r| over all residuals, each with the model of its fold.

    ``centres``: (key, fold, y_pred); ``residuals``: (fold, residual), and ``group`` columns in both for intervals within groups. Residuals become search trees
    (``residual_trees``). Test rows go in blocks from the roots to the leaves: at each level a block joins the nodes that it needs, which bound each row's two ranks by
    counts, and asks for the children within the bounds; the leaves give the exact values. A block asks for each node once, so nothing is sent for each row, and
    neither driver nor broadcast holds residuals. Residuals and centres that are null or NaN, or lack the fold or group, do not count; an infinite residual ranks last. Rows
    that meet no residual are left out; a rank beyond the residuals is infinite.
    """
    spark = centres.sparkSession
    ship_package(spark)
    names = [fold, *group]
    nodes, height = residual_trees(residuals, names)
    blocks = settled(_row_blocks(centres.filter(~F.isnan(F.col("y_pred").cast("double"))), names, key), "cv-rows")
    asks = blocks.select("block", F.explode(F.array_distinct("lists")).alias("list"), F.lit(height - 1).alias("level"), F.lit(0).cast("long").alias("node"))

    def narrow(mine: pa.Table, replies: pa.Table) -> pa.Table:
        if not mine.num_rows or not replies.num_rows:
            return wanted.empty_table()
        _, rows, lists, known = _told(mine, replies)
        asked: set[tuple[str, int, int]] = set()
        at_level = min(x[0] for parts in known.values() for x in parts)
        children = {}  # of the lowest nodes read: last values and numbers, ascending
        for name, parts in known.items():
            low = sorted((node, v) for level, node, v, _ in parts if level == at_level)
            if low:
                children[name] = np.concatenate([v for _, v in low]), np.concatenate([node * FAN + np.arange(len(v)) for node, v in low])
        for met, (_, at) in rows.items():
            own = [lists[m] for m in met]
            n, least, most = _ranks(own, alpha)
            for shifts, rank in ((at, most), (-at, n - least + 1)):
                if not 1 <= rank <= n:
                    continue
                low, high = nth_of_shifted(shifts, own, rank)
                for j, m in enumerate(met):
                    if m in children:
                        last, number = children[m]
                        slack = 4 * np.spacing(np.abs(shifts[:, j]) + np.abs(np.where(np.isfinite(high), high, low)))
                        a = np.searchsorted(last, low - shifts[:, j] - slack)
                        b = np.where(np.isfinite(high), np.searchsorted(last, high - shifts[:, j] + slack), len(last) - 1)
                        marks = np.bincount(np.minimum(a, len(last)), minlength=len(last) + 2) - np.bincount(np.minimum(b, len(last) - 1) + 1, minlength=len(last) + 2)
                        asked.update((m, at_level - 1, int(number[k])) for k in np.flatnonzero(np.cumsum(marks)[: len(last)] > 0))
        block = mine.column("block")[0].as_py()
        columns = list(zip(*sorted(asked))) or [[], [], []]
        return pa.Table.from_arrays([pa.array([block] * len(asked), pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64())))], schema=wanted)

    def tell(mine: pa.Table, replies: pa.Table) -> pa.Table:
        if not mine.num_rows or not replies.num_rows:
            return result.empty_table()
        keys, rows, lists, _ = _told(mine, replies)
        order, lower, upper = [], [], []
        for met, (numbers, at) in rows.items():
            own = [lists[m] for m in met]
            n, least, most = _ranks(own, alpha)
            order.append(numbers)
            lower.append(-nth_of_shifted(-at, own, n - least + 1)[1] if least >= 1 else np.full(len(at), -INF))
            upper.append(nth_of_shifted(at, own, most)[1] if most <= n else np.full(len(at), INF))
        if not order:
            return result.empty_table()
        found = keys.take(pa.array(np.concatenate(order)))
        return pa.Table.from_arrays([*found.flatten(), pa.array(np.concatenate(lower)), pa.array(np.concatenate(upper))], schema=result)

    wanted = pa.schema([("block", pa.int64()), ("list", pa.string()), ("level", pa.int32()), ("node", pa.int64())])
    kinds = StructType([*[centres.schema[k] for k in key], *StructType.fromDDL("lower double, upper double").fields])
    result = to_arrow_schema(kinds)
    answered = lambda: asks.withColumnRenamed("block", "of").join(nodes, ["list", "level", "node"]).groupBy("of")
    for _ in range(height - 1):
        more = blocks.groupBy("block").cogroup(answered()).applyInArrow(narrow, "block long, list string, level int, node long")
        asks = settled(asks.unionByName(more), "cv-asks")
    return blocks.groupBy("block").cogroup(answered()).applyInArrow(tell, kinds)


def mondrian_cv_plus(centres: DataFrame, residuals: DataFrame, fold: str, key: list[str], group: str, alpha: float) -> DataFrame:
    """Intervals within groups, with the pooled one where the group's is not finite."""
    pooled = cv_plus(centres, residuals, fold, key, alpha)
    own = cv_plus(centres, residuals, fold, key, alpha, [group]).withColumnsRenamed({"lower": "_lower", "upper": "_upper"})
    finite = (F.abs(F.col("_lower")) < INF) & (F.abs(F.col("_upper")) < INF)
    return pooled.join(own, key, "left").select(*key, F.when(finite, F.col("_lower")).otherwise(F.col("lower")).alias("lower"), F.when(finite, F.col("_upper")).otherwise(F.col("upper")).alias("upper"))


def coverage(intervals: DataFrame, by: list[str]) -> DataFrame:
    return intervals.groupBy(*by).agg(F.avg(F.col("y_true").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def member_sd(pred: DataFrame, key: list[str], value: str) -> DataFrame:
    return pred.groupBy(*key).agg(F.avg(value).alias("y_pred"), F.stddev_samp(value).alias("uncertainty"))


def interval_table(cal: DataFrame, test: DataFrame, task: list[str], scale: str, alpha: float) -> DataFrame:
    """Test rows twice: with plain and with normalised intervals, told apart by ``variant``."""
    plain = null_safe_join(test, split_width(cal, task, "residual", alpha).drop("n"), task).withColumn("variant", F.lit("plain"))
    scaled = normalised_width(cal, test, task, "residual", scale, alpha).withColumn("variant", F.lit("normalised"))
    return plain.unionByName(scaled).withColumns({"lower": F.col("y_pred") - F.col("width"), "upper": F.col("y_pred") + F.col("width")})


def member_intervals(cal: DataFrame, test: DataFrame, task: list[str], key: str, member: str, first: object, alpha: float) -> DataFrame:
    """(task, key, method, variant, y_pred, uncertainty, lower, upper) of an ensemble whose members' predictions are rows.

    ``cal`` and ``test``: (task, key, member, y_pred), ``cal`` also y_true. The members' mean has plain intervals, and ones scaled by the members' deviation; the
    member ``first`` alone has plain ones and no uncertainty. A key of one member has no deviation, and so no scaled interval.
    """
    keys = [*task, key]
    truth = cal.groupBy(*keys).agg(F.max("y_true").alias("y_true"))
    held = null_safe_join(member_sd(cal, keys, "y_pred"), truth, keys).withColumn("residual", F.col("y_true") - F.col("y_pred"))
    mean = interval_table(held, member_sd(test, keys, "y_pred"), task, "uncertainty", alpha).withColumn("method", F.lit("ensemble"))
    alone = cal.filter(F.col(member) == first).withColumn("residual", F.col("y_true") - F.col("y_pred"))
    one = null_safe_join(test.filter(F.col(member) == first), split_width(alone, task, "residual", alpha).drop("n"), task)
    one = one.withColumns({"method": F.lit("first"), "variant": F.lit("plain"), "uncertainty": F.lit(None).cast("double"), "lower": F.col("y_pred") - F.col("width"), "upper": F.col("y_pred") + F.col("width")})
    columns = [*keys, "method", "variant", "y_pred", "uncertainty", "lower", "upper"]
    return mean.select(*columns).unionByName(one.select(*columns))
