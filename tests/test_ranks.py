"""Ranks in random order: those of a plain window, without a task that sorts a whole stratum."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugework.functions.randomness import digest
from gaugework.operators import joins, splits


@pytest.fixture(scope="module")
def rows(spark):
    """A stratum of two thirds, one of a single row, a null one and an empty name; weights from 0."""
    strata = ["hot"] * 400 + ["cold"] * 150 + [None] * 40 + [""] * 9 + ["one"]
    return spark.createDataFrame([(i, s, i % 7, i % 3) for i, s in enumerate(strata)], "key long, s string, w long, size int").repartition(5)


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("ahead", [None, "size"])
def test_equal_to_a_window(rows, monkeypatch, digits, ahead):
    monkeypatch.setattr(splits, "SPREAD_DIGITS", digits)
    drawn = digest(5, "key")
    w = Window.partitionBy("s")
    o = w.orderBy(*([F.desc("size")] if ahead else []), drawn)
    before = F.coalesce(F.sum("w").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plain = rows.select("*", F.row_number().over(o).cast("long"), F.count(F.lit(1)).over(w), before, F.sum("w").over(w))
    got = splits.digest_ranks(rows, ["s"], drawn, ahead=ahead, weight="w")
    assert got.columns == [*rows.columns, "_r", "_n", "_before", "_total"]
    assert {r["key"]: tuple(r) for r in got.collect()} == {r["key"]: tuple(r) for r in plain.collect()}


def test_same_for_any_partitioning(rows):
    a, b = (splits.digest_ranks(d, ["s"], digest(1, "key")).select("key", "_r", "_n") for d in (rows, rows.repartition(11, "w")))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_empty_table_and_repeated_rows(spark, rows):
    assert splits.digest_ranks(rows.filter("key < 0"), ["s"], digest(1, "key")).count() == 0
    twice = spark.createDataFrame([(1, "a")] * 5 + [(None, "a")] * 3, "key long, s string")
    got = splits.digest_ranks(twice, ["s"], digest(1, "key")).collect()
    assert sorted(r["_r"] for r in got) == list(range(1, 9)) and {r["_n"] for r in got} == {8}


@pytest.mark.parametrize("split", [
    lambda d: splits.stratified_kfold(d, "key", "s", 5, 2, 1),
    lambda d: splits.stratified_split(d, "key", "s", 0.2, 1),
    lambda d: splits.stratified_sample(d, "key", "s", 50, 1),
    lambda d: splits.group_folds(d, "s", "key", 3, 1),
    lambda d: splits.nested_subsets(d, "key", "s", "key", [20, 60], 1),
    lambda d: splits.fit_stop_calibrate(d, "s", "key", 0.2, 1),
])
def test_rows_are_sorted_within_parts_only(rows, split):
    """Every window in random order goes by part of a stratum; those by stratum run over the parts' sums or the quotas."""
    plan = split(rows)._jdf.queryExecution().optimizedPlan().toString()
    drawn = [line for line in re.findall(r"Window \[.*", plan) if "_d#" in line or "md5" in line]
    assert drawn
    for line in drawn:
        assert "windowspecdefinition(_cell#" in line, line


@pytest.mark.parametrize("rows_bound, bytes_bound", [(20_000, 64), (10, 64 << 20)])
def test_nearest_in_blocks_equals_broadcast(spark, monkeypatch, rows_bound, bytes_bound):
    df = spark.range(40).select(F.col("id").alias("k"), F.array(F.col("id") % 7 + 1.0, F.col("id") % 3 + 1.0).alias("v"))
    ref = df.select(F.col("k").alias("r"), F.reverse("v").alias("rv"))

    def both():
        return sorted(joins.nearest_euclidean(df, ref, "k", "v", "rv").collect()), sorted(joins.nearest_cosine(df, ref, "k", "v", "r", "rv").collect())

    whole = both()
    monkeypatch.setattr(joins, "BLOCK_VECTORS", rows_bound)
    monkeypatch.setattr(joins, "BLOCK_BYTES", bytes_bound)
    assert both() == whole
