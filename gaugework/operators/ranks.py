"""Exact ranks, running sums, order statistics and quantiles by value, without a task that sorts a whole group.

All rows are cut by (group, order) at points of a sample of fixed size, so that a group has as many cells as its share of the rows. Cells are counted and sorted apart
and shifted by what the group's earlier cells hold. A cell is found by bisection in the cut points, an expression over a constant: the cut has no shuffle of
its own, and its result does not depend on the partitions. Order statistics count different values first, so rows of one value are one row, and look into the
cells that hold a wanted rank only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..session import settled

#: Cells of all groups together: 2 ** CELL_BITS. The driver holds a few sampled rows a cell, whatever the table's size.
CELL_BITS = 8
SAMPLED = 8


def null_safe_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on equal keys, where nulls equal nulls; the keys of ``a`` stay."""
    if not on:
        return a.crossJoin(b)  # groups of the whole table: b is one row
    other = b.withColumnsRenamed({c: f"_on_{c}" for c in on})
    met = a.join(other, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on], how)
    return met.drop(*[f"_on_{c}" for c in on])


def ascending(*names: str) -> list[Column]:
    """Sort keys of columns, nulls last; a name that starts with '-' is a number in descending order."""
    keys = [(-F.col(n[1:]), F.col(n[1:])) if n.startswith("-") else (F.col(n), F.col(n)) for n in names]
    return [x for key, c in keys for x in (c.isNull(), key)]


def _of(by: list[str]) -> Column:
    """The group as one value, in which nulls are equal."""
    return F.struct(*by) if by else F.struct(F.lit(0))


def _place(by: list[str], order: list[Column]) -> Column:
    return F.struct(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)], *[o.alias(f"o{i}") for i, o in enumerate(order)])


def _literal(value: object, kind: str) -> str:
    """A value in SQL. Strings go as bytes, so that no sign in them is read as SQL."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, (bytes, bytearray)):
        return f"CAST(X'{bytes(value).hex()}' AS {kind})"
    return f"CAST({'NULL' if value is None else repr(str(value))} AS {kind})"


def cut_points(df: DataFrame, by: list[str], order: list[Column], bits: int | None = None, n: int | None = None) -> Column:
    """Ascending (by, order) tuples that cut the table into about 2 ** bits even parts, as a constant array: from two passes, with a sample of fixed size
    (one pass, where the number of rows ``n`` is known).

    Tuples are drawn by their hash, so equal ones are drawn once. Fewer come where few are different.
    """
    bits = CELL_BITS if bits is None else bits
    places = df.select(_place(by, order).alias("p"))
    wanted, n, unit = SAMPLED << bits, df.count() if n is None else n, 1 << 40
    drawn = places.filter(F.pmod(F.xxhash64("p"), F.lit(unit)) < int(unit * min(1.0, wanted / max(n, 1)))).distinct().limit(4 * wanted)
    row = drawn.agg(F.sort_array(F.collect_list("p")).alias("p")).first()
    found = row["p"] if row else []
    number = min(len(found), (1 << bits) - 1)
    chosen = [found[(k + 1) * len(found) // (number + 1)] for k in range(number)]
    kind = places.schema["p"].dataType
    if not chosen:
        return F.array().cast(ArrayType(kind))
    # an array of structs of literals is folded into one constant; as text, since a call for each of them takes longer than the search
    rows = ", ".join(f"struct({', '.join(_literal(v, f.dataType.simpleString()) for v, f in zip(r, kind.fields))})" for r in chosen)
    return F.expr(f"array({rows})").cast(ArrayType(StructType([StructField(f.name, f.dataType) for f in kind.fields])))


def cell_number(by: list[str], order: list[Column], cuts: Column, bits: int | None = None) -> Column:
    """How many cut points are at or below a row, by bisection."""
    place, steps = _place(by, order), [1 << k for k in reversed(range(CELL_BITS if bits is None else bits))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) <= place, at + s).otherwise(at))


def ranks_in_cells(rows: DataFrame, columns: list[str], order: list[Column], before: list[Column]) -> DataFrame:
    """``columns`` of ``rows`` with ``_r`` (place in the group, from 1), ``_n`` (the group's rows), ``_before`` (weight ahead of the row) and ``_total`` (the group's weight).

    ``rows`` has ``_w`` and a struct ``_cell`` with the group ``of`` and the place of the cell in its group, in the order ``before``; ``order`` sorts a cell. Only cells' sums meet.
    """
    cells = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_w").alias("_weight"))
    group = Window.partitionBy("_cell.of")
    earlier = group.orderBy(*before).rowsBetween(Window.unboundedPreceding, -1)
    shifts = cells.select(
        "_cell",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_weight_before"),
        F.sum("_rows").over(group).alias("_n"),
        F.sum("_weight").over(group).alias("_total"),
    )
    inside = Window.partitionBy("_cell").orderBy(*order)
    so_far = F.coalesce(F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"_place": F.row_number().over(inside), "_inside": so_far}).join(shifts, "_cell")
    placed = placed.withColumns({"_r": F.col("_place") + F.col("_rows_before"), "_before": F.col("_inside") + F.col("_weight_before")})
    return placed.select(*columns, "_r", "_n", "_before", "_total")


def ranked(df: DataFrame, by: list[str], order: list[str], weight: Column | None = None, cuts: Column | None = None) -> DataFrame:
    """Each row with its place ``_r`` (from 1) in the order of columns within ``by``, the group's rows ``_n``, the weight ``_before`` it and the group's ``_total``.

    ``order``: names, '-' before one for descending numbers; nulls come last. Name a key last, so that rows of equal values can be told apart; fully equal rows come in any
    order, in one cell. Null is a group of its own. A row weighs 1 without ``weight``; a null weight counts as 0. ``cuts``: from ``cut_points`` of the same (by, order).
    """
    keys = ascending(*order)
    if cuts is None:
        df = settled(df, "rank-rows")  # as it is read four times
        cuts = cut_points(df, by, keys)
    own = F.coalesce(weight, F.lit(0)) if weight is not None else F.lit(1).cast("long")
    rows = df.withColumns({"_w": own, "_cell": F.struct(_of(by).alias("of"), cell_number(by, keys, cuts).alias("part"))})
    return ranks_in_cells(rows, df.columns, keys, [F.col("_cell.part")])


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, rank): the mean place of the rows of each value in its group; rows of one value are counted before they meet. Null values are left out.

    ``df`` is read four times; settle it before if it is no stored table.
    """
    known = df.filter(F.col(value).isNotNull())
    cuts = cut_points(known, by, ascending(value))
    each = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    return ranked(each, by, [value], F.col("_c"), cuts).select(*by, value, (F.col("_before") + (F.col("_c") + 1) / 2.0).alias("rank"))


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """(by, n, at): the group's known values, and a map of rank (from 1) to value.

    ``ranks`` makes an array of wanted ranks, few of them, from the group's size; those outside 1 to n are not in the map. Null values are left out; a group without others has no row.
    """
    known = settled(df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*by, value])), "values")  # as it is read several times
    keys = ascending(value)
    cut = cell_number(by, keys, cut_points(known, by, keys))
    each = known.select(*by, F.col(value).alias("_v"), F.struct(_of(by).alias("of"), cut.alias("part")).alias("_cell")).groupBy("_cell", "_v").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy("_cell.of")
    sums = each.groupBy("_cell").agg(F.sum("_c").alias("_rows"))
    earlier = F.coalesce(F.sum("_rows").over(group.orderBy("_cell.part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sums.select("_cell", "_rows", earlier.alias("_ahead"), F.sum("_rows").over(group).alias("n"))
    wanted = F.filter(F.array_distinct(ranks(F.col("n"))), lambda k: (k > F.col("_ahead")) & (k <= F.col("_ahead") + F.col("_rows")))
    cells = shifts.withColumn("_k", wanted)

    held = each.join(cells.filter(F.size("_k") > 0).select("_cell", "_ahead", "_k"), "_cell")
    upto = F.col("_ahead") + F.sum("_c").over(Window.partitionBy("_cell").orderBy("_v"))
    mine = held.withColumn("_upto", upto).withColumn("_k", F.filter("_k", lambda k: (k > F.col("_upto") - F.col("_c")) & (k <= F.col("_upto"))))
    found = mine.select(F.col("_cell.of").alias("_of"), F.explode("_k").alias("k"), "_v").groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("k", "_v"))).alias("at"))
    sizes = cells.groupBy(F.col("_cell.of").alias("_group")).agg(F.max("n").alias("n"))
    both = sizes.join(found, F.col("_group") == F.col("_of"), "left")
    return both.select(*[F.col("_group")[c].alias(c) for c in by], "n", "at")


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], out: str = "q") -> DataFrame:
    """(by, n, out array<double>): exact quantiles, interpolated between the two values around (n - 1) * share."""
    at = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    below, above = ([(f(p) + 1).cast("long") for p in at] for f in (F.floor, F.ceil))
    stats = order_statistics(df, by, value, lambda n: F.array(*below, *above))
    low, high = ([F.col("at")[k].cast("double") for k in ks] for ks in (below, above))
    # where both are one value, no product with an infinite one
    made = [F.when(b == a, x).otherwise((a - 1 - p) * x + (p - b + 1) * y) for p, b, a, x, y in zip(at, below, above, low, high)]
    return stats.select(*by, "n", F.array(*made).alias(out))
