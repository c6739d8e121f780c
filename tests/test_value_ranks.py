"""Ranks, running sums, order statistics and quantiles by value: those of plain windows and percentiles, without a task that sorts a whole group."""

import collections
import math
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugework.operators import aggregates, conformal, inference, projections, ranks, selection, windows


@pytest.fixture(scope="module")
def rows(spark):
    """A group of nine tenths, a null one, one of a single row; half of all values are 3.5; null, infinite and NaN scores, repeated rows."""
    out = []
    for i in range(900):
        group = "hot" if i % 10 else None if i % 20 else "small"
        value = 3.5 if i % 2 else [(i * 7919 % 1000) / 8 - 40, None, float("inf"), float("nan"), -0.0, 1e300][0 if i % 14 else (i // 14) % 6]
        out.append((i, group, value, i % 5 if i % 11 else None, i % 3 == 0))
    out += [(7, "hot", 3.5, 2, False), (1000, "one", 2.0, 1, True)]
    return spark.createDataFrame(out, "key long, g string, v double, w long, hit boolean").repartition(7)


def plain_ranks(rows, order, weight=None):
    group = Window.partitionBy("g")
    o = group.orderBy(*order)
    w = F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(1)
    before = F.coalesce(F.sum(w).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("*", F.row_number().over(o).cast("long"), F.count(F.lit(1)).over(group), before, F.sum(w).over(group))


def bag(df):
    return collections.Counter(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("bits, order, plain", [(3, ["v", "key"], lambda: [F.asc_nulls_last("v"), "key"]), (9, ["-w", "key"], lambda: [F.desc_nulls_last("w"), "key"]), (0, ["key"], lambda: ["key"])])
def test_equal_to_a_window(rows, monkeypatch, bits, order, plain):
    monkeypatch.setattr(ranks, "CELL_BITS", bits)
    one = rows.dropDuplicates(["key"])
    got = ranks.ranked(one, ["g"], order, F.col("w"))
    assert got.columns == [*rows.columns, "_r", "_n", "_before", "_total"]
    assert bag(got) == bag(plain_ranks(one, plain(), "w"))


def test_cells_are_even_and_a_hot_group_has_many(rows, monkeypatch):
    monkeypatch.setattr(ranks, "CELL_BITS", 5)
    keys = ranks.ascending("v", "key")
    sizes = rows.groupBy(ranks.cell_number(["g"], keys, ranks.cut_points(rows, ["g"], keys)).alias("c"), "g").count().collect()
    assert max(r["count"] for r in sizes) < 4 * 900 / 32  # also where half of the rows have one value: the key cuts them
    assert len({r["c"] for r in sizes}) == 32 and len({r["c"] for r in sizes if r["g"] == "hot"}) > 25


@pytest.mark.parametrize("bits", [0, 9])
def test_quantiles_equal_percentiles(rows, monkeypatch, bits):
    monkeypatch.setattr(ranks, "CELL_BITS", bits)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    known = rows.filter(~F.isnan("v") & (F.abs("v") < 1e30))
    got = {r["g"]: (r["n"], r["q"]) for r in ranks.quantiles(known, ["g"], "v", shares).collect()}
    want = {r["g"]: (r["n"], r["q"]) for r in known.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got.keys() == want.keys() and set(got) == {"hot", None, "small", "one"}
    for g, (n, q) in want.items():
        assert got[g][0] == n and got[g][1] == pytest.approx(q, abs=1e-9)
    (whole,) = ranks.quantiles(known, [], "v", [0.5]).collect()
    assert whole["q"][0] == known.agg(F.median("v")).first()[0]


def test_order_statistics(rows):
    stats = {r["g"]: (r["n"], r["at"]) for r in ranks.order_statistics(rows, ["g"], "v", lambda n: F.array(F.lit(1), n, n + 1, F.lit(0), F.ceil(n / 2))).collect()}
    values = collections.defaultdict(list)
    for r in rows.collect():
        if r["v"] is not None:
            values[r["g"]].append(r["v"])
    for g, v in values.items():
        v = sorted(v, key=lambda x: (math.isnan(x), x))
        wanted = {1: v[0], len(v): v[-1], math.ceil(len(v) / 2): v[math.ceil(len(v) / 2) - 1]}
        assert stats[g][0] == len(v) and str(dict(sorted(stats[g][1].items()))) == str(dict(sorted(wanted.items())))


def test_many_different_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SAMPLED", 2)
    df = spark.range(200_000).select(((F.col("id") * 7919) % 200_000).cast("double").alias("v"))
    assert ranks.quantiles(df, [], "v", [0.0, 0.5, 0.999, 1.0]).first()["q"] == pytest.approx([0, 99_999.5, 0.999 * 199_999, 199_999])


def test_average_ranks_and_spearman(rows):
    known = rows.filter("v is not null and w is not null")
    w = Window.partitionBy("g")
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("g", c)) - 1) / 2.0
    plain = known.withColumns({"a": rank("v"), "b": rank("w")}).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("rho")).filter("n >= 10")
    got = {r["g"]: (r["n"], r["rho"]) for r in inference.spearman(rows, ["g"], "v", "w").collect()}
    want = {r["g"]: (r["n"], r["rho"]) for r in plain.collect()}
    assert got.keys() == want.keys() and all(got[g] == (n, pytest.approx(rho, abs=1e-9)) for g, (n, rho) in want.items())


def test_nulls_do_not_count(spark):
    """Null residuals widen nothing, null scores are not the most confident, null groups are groups."""
    rows = [(i, None if i % 4 == 0 else "a", float(i), float(i)) for i in range(1, 21)]
    nulls = [(100 + i, "a", None, None) for i in range(10)]
    kinds = "key long, g string, residual double, score double"
    plain, more = spark.createDataFrame(rows, kinds), spark.createDataFrame(rows + nulls, kinds)
    widths = [{r["g"]: (r["width"], r["n"]) for r in conformal.split_width(d, ["g"], "residual", 0.25).collect()} for d in (plain, more)]
    assert widths[0] == widths[1] == {"a": (float(sorted(i for i in range(1, 21) if i % 4)[11]), 15), None: (20.0, 5)}
    curves = [sorted(map(str, windows.retention_curve(d, ["g"], "score", "residual", "key", [0.25, 1.0]).collect())) for d in (plain, more)]
    assert curves[0] == curves[1]
    assert conformal.split_width(plain, ["g"], "residual", 0.01).filter("width < 1e300").count() == 0  # beyond n: infinite
    scaled = more.withColumn("scale", F.when(F.col("key") < 100, F.lit(1.0) + F.col("key") % 3))
    out = {r["key"]: r["width"] for r in conformal.normalised_width(scaled, scaled, ["g"], "residual", "scale", 0.25).collect()}
    assert len(out) == 30 and out[4] is not None and out[101] is None  # a null scale has no width


def test_curves_by_hand(spark):
    log = spark.createDataFrame([("s", i, i in (2, 3, 7), float(i)) for i in range(1, 11)] + [(None, 1, True, 1.0)], "s string, o int, hit boolean, v double").repartition(4)
    assert sorted(map(str, windows.hit_curve(log, ["s"], ["o"], "hit", 3).collect())) == sorted(map(str, [*(tuple_row(log, "s", k, h) for k, h in ((3, 2), (6, 2), (9, 3), (10, 3))), tuple_row(log, None, 1, 1)]))
    assert {r["s"]: (r["lookups"], r["hits"], r["kth"]) for r in aggregates.hit_summary(log, "s", "o", "hit", 2).collect()} == {"s": (10, 3, 3), None: (1, 1, None)}
    account = {(r["s"], r["o"]): (r["in_spec"], r["hits"]) for r in selection.campaign_account(log, ["s"], ["o"], "v", 4.0, 5.0).collect()}
    assert account["s", 3] == (False, 0) and account["s", 5] == (True, 2) and account["s", 10] == (False, 2) and account[None, 1] == (False, 0)
    assert {(r["s"], r["o"]): r["rank_in_round"] for r in windows.rank_in_round(log, "s", ["-v"]).collect()}["s", 10] == 1


def tuple_row(df, s, step, hits):
    from pyspark.sql import Row

    return Row(s=s, step=step, hits=hits)


def test_bins_with_ranges_and_tails(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "v double")
    bins = {r["bin"]: r["n"] for r in projections.quantile_bins(df, "v", 2, ranges=True).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert bins == {"Q1: 1.00–5.00": 5, "Q2: 6.00–10.00": 5, None: 1}
    train = spark.createDataFrame([("t", float(i)) for i in range(101)], "task string, y_true double")
    pred = spark.createDataFrame([("t", y, y + 1.0) for y in (-5.0, 1.0, 50.0, 99.0, 120.0)], "task string, y_true double, y_pred double")
    got = {r["band"]: (r["n"], r["outside"], r["mae"], r["share"]) for r in aggregates.tail_report(pred, train, "task").collect()}
    assert got == {"low": (2, 1, 1.0, 0.4), "middle": (1, 0, 1.0, 0.2), "high": (2, 1, 1.0, 0.4)}


def test_empty_tables(rows):
    none = rows.filter("key < 0")
    assert ranks.ranked(none, ["g"], ["v", "key"]).count() == 0
    assert ranks.quantiles(none, ["g"], "v", [0.5]).count() == 0 and ranks.average_ranks(none, ["g"], "v").count() == 0
    assert aggregates.noise_summary(none, "v", "v").first()["median"] is None
    assert projections.quantile_bins(none, "v", 4).count() == 0 and projections.profile(none, ["v", "w"]).count() == 0
    only_null = rows.filter("v is null")
    assert projections.quantile_bins(only_null, "v", 4).filter("bin is null").count() == only_null.count()


@pytest.mark.parametrize("make", [
    lambda d: windows.hit_curve(d, ["g"], ["v", "key"], "hit", 10),
    lambda d: windows.retention_curve(d, ["g"], "v", "w", "key", [0.5]),
    lambda d: windows.order_stat(d, ["g"], "v", F.lit(3)),
    lambda d: windows.rank_in_round(d, "g", ["-v", "key"]),
    lambda d: aggregates.hit_summary(d, "g", "key", "hit", 2),
    lambda d: aggregates.region_ratio(d, "g", "v", "hit", "w", "key"),
    lambda d: inference.spearman(d, ["g"], "v", "w"),
    lambda d: conformal.split_width(d, ["g"], "v", 0.1),
    lambda d: conformal.normalised_width(d, d, ["g"], "v", "w", 0.1),
    lambda d: selection.uncertainty_report(d, "g", "v", "w", "key", "v", "hit", "key"),
    lambda d: selection.campaign_account(d, ["g"], ["key"], "v", 0.0, 1.0),
    lambda d: projections.box_stats(d, "g", "v"),
])
def test_rows_are_sorted_within_cells_only(rows, make):
    """Windows that go by group run over the cells' sums; those over rows or values go by cell. No percentile or list holds a group's values."""
    plan = make(rows)._jdf.queryExecution().optimizedPlan().toString()
    lines = re.findall(r"Window \[.*", plan)
    assert any("windowspecdefinition(_cell#" in line for line in lines)
    for line in lines:
        by_cell = all(x.startswith("_cell#") for x in re.findall(r"windowspecdefinition\(([^,()]*)", line))
        assert by_cell or re.match(r"Window \[sum\(_(rows|weight)#", line), line
    assert "percentile(" not in plan and "median(" not in plan
