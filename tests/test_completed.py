"""Operators that were done in part: by hand examples, with nulls and ties."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugework.operators import aggregates, audit, conformal, inference, models, splits, windows
from gaugework.sources import tables
from gaugework.streaming.ledger import outcome_ledger


@pytest.fixture(scope="module")
def people(spark):
    """240 rows in 60 groups of four rows, three strata of uneven size, one of them null; one null group."""
    rows = [(i, i // 4 if i >= 8 else None, ["a", "a", "b", None][(i // 4) % 4]) for i in range(240)]
    return spark.createDataFrame(rows, "key long, g long, s string").repartition(5)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_repeated_group_folds(people):
    got = splits.stratified_group_kfold(people, "s", "g", 5, 3, repeats=3)
    assert got.count() == 3 * 240
    for r in range(3):
        one = got.filter(F.col("repeat") == r)
        assert one.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n <> 1").count() == 0
        assert rows_of(one.select("key", "fold"), "key", "fold") == rows_of(splits.stratified_group_kfold(people, "s", "g", 5, 3 + r), "key", "fold")
        assert max(x[1] for x in rows_of(one.groupBy("fold").count(), "fold", "count")) < 80
    assert rows_of(got.filter("repeat = 0"), "key", "fold") != rows_of(got.filter("repeat = 1"), "key", "fold")


def test_no_row_is_lost_to_a_null(people):
    assert splits.stratified_sample(people, "key", "s", 90, 1).count() == 90
    assert splits.nested_subsets(people, "key", "s", "g", [40, 120], 1).count() == 240
    subset = splits.nested_subsets(people, "key", "s", "g", [40, 120], 1).filter("entry is not null")
    assert 120 <= subset.count() <= 120 + 3 * 8 and 40 <= subset.filter("entry = 40").count() <= 40 + 3 * 8
    assert subset.join(people.filter("s is null"), "key").count() > 20
    assert splits.fit_stop_calibrate(people, "s", "g", 0.2, 1).count() == 240
    assert splits.stratified_group_kfold(people, "s", "g", 3, 1).count() == 240


def test_fit_stop_calibrate_by_quota(people):
    got = splits.fit_stop_calibrate(people, "s", "g", 0.2, 4)
    n = dict(rows_of(got.groupBy("part").count(), "part", "count"))
    assert abs(n["stop"] + n["calibrate"] - 48) <= 24 and abs(n["stop"] - n["calibrate"]) <= 12
    assert got.groupBy("g").agg(F.count_distinct("part").alias("n")).filter("n <> 1").count() == 0
    held = dict(rows_of(got.filter("part <> 'fit'").groupBy("s").count(), "s", "count"))
    assert set(held) == {"a", "b", None} and held["a"] > held["b"]
    assert rows_of(got, "key", "part") == rows_of(splits.fit_stop_calibrate(people.repartition(2), "s", "g", 0.2, 4), "key", "part") != rows_of(splits.fit_stop_calibrate(people, "s", "g", 0.2, 5), "key", "part")


def test_fold_curve_tasks(people):
    rows = splits.stratified_group_kfold(people, "s", "g", 4, 2)
    of, fold = ({r["key"]: r[c] for r in rows.collect()} for c in ("g", "fold"))
    parts = {}
    for r in splits.fold_curve_tasks(rows, "key", "fold", 4, "s", "g", [30, 90], 2, 5).collect():
        parts.setdefault((r["test_fold"], r["draw"], r["size"], r["role"]), []).append(r["key"])
    assert len(parts) == 4 * 2 * 2 * 2 and all(len(p) == len(set(p)) for p in parts.values())
    for k in range(4):
        for d in range(2):
            train = {n: set(parts[k, d, n, "train"]) for n in (30, 90)}
            for n in (30, 90):
                test = parts[k, d, n, "test"]
                assert sorted(test) == sorted(i for i in fold if fold[i] == k)
                assert n <= len(train[n]) <= n + 3 * 8 and not {of[i] for i in train[n]} & {of[i] for i in test}
            assert train[30] < train[90]
        assert set(parts[k, 0, 30, "train"]) != set(parts[k, 1, 30, "train"])


def test_inner_folds_are_group_folds(people):
    tasks = people.select("key", "g", "s", F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("task")).withColumns({"regime": F.lit("familiar"), "role": F.when((F.col("task") == "r0") & (F.col("key") < 40), "test").otherwise("train")})
    got = splits.inner_folds(tasks, "task", "regime", "s", "g", 3, 7)
    assert got.count() == 480 - 40
    for task, low in (("r0", 40), ("r1", 0)):
        alone = splits.stratified_group_kfold(people.filter(F.col("key") >= low), "s", "g", 3, 7)
        assert rows_of(got.filter(F.col("task") == task), "key", "inner_fold") == rows_of(alone.withColumn("inner_fold", F.col("fold").cast("string")), "key", "inner_fold")


def test_fetch_strict(spark):
    store = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", [2.0]), ("c", None, [3.0]), ("d", "p", [4.0]), ("d", "p", [5.0])], "key string, source string, v array<double>")
    want = lambda *rows: spark.createDataFrame(rows, "n int, key string, source string")
    fetch = lambda rows, config: tables.fetch_strict(rows, store, "key", "source", "n", config, {"layer": 1, "size": 2}, ["layer", "size"])
    good = {"layer": 1, "size": 2, "made": "today"}
    assert [(r["key"], r["v"]) for r in fetch(want((2, "a", "x"), (0, "c", None), (1, "b", "y"), (3, "a", "x")), good).collect()] == [("c", [3.0]), ("b", [2.0]), ("a", [1.0]), ("a", [1.0])]
    for row, message in (((0, "z", "x"), "z: missing"), ((0, "a", "other"), "a: stored from another"), ((0, "a", None), "a: stored from another"), ((0, "d", "p"), "d: twice")):
        with pytest.raises(PySparkException, match=message):
            fetch(want((5, "b", "y"), row), good).collect()
    with pytest.raises(ValueError, match="size"):
        fetch(want((0, "a", "x")), {"layer": 1, "size": 3})
    assert fetch(want((0, "a", "x")).filter("n > 0"), good).count() == 0


def test_fold_partition_check(spark):
    every = spark.createDataFrame([(i,) for i in range(6)], "key int")
    folds = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 0), (1, 0), (1, 1), (1, 9)], "repeat int, key int")
    assert rows_of(aggregates.fold_partition_check(folds, ["repeat"], "key", every), "repeat", "keys", "repeated", "missing", "foreign") == [(0, 6, 0, 0, 0), (1, 3, 1, 4, 1)]


def test_means_and_recipes(spark):
    weights = spark.createDataFrame([("s", "t1", "p", 0.2, 4.0, 1), ("s", "t1", "q", 0.8, 4.0, 2), ("s", "t2", "p", 1.0, 7.0, 3)], "method string, task string, member string, weight double, mae double, n int")
    assert aggregates.mean_of_first(weights, ["method"], ["task", "method"], "mae", "n").first()["mae"] == 5.5  # not 5: the first task's error stands twice
    metrics = spark.createDataFrame([("x", 1, 3.0, 9.0), ("x", 2, 3.0, 1.0), ("y", 1, 4.0, 3.0), ("y", 2, 4.0, 3.0), ("z", 1, None, None)], "recipe string, fold int, mae double, rmse double")
    assert tuple(aggregates.best_recipe(metrics, ["recipe"], "mae", "rmse").first()) == ("x", 3.0, "y")
    spreads = spark.createDataFrame([(0.0,), (0.5,), (1.5,), (2.0,), (None,)], "sd double")
    assert tuple(aggregates.dispersion_summary(spreads, "sd").first()) == (4, 0.375, 1.0, 1.625, 0.5, 0.25)


def test_step_summary(spark):
    steps = spark.createDataFrame([("a", 1, None, 0.0), ("a", 2, 0.5, 0.5), ("a", 3, 0.25, 0.75), ("a", 4, 0.0, 0.75), ("a", 5, 0.1, 0.8)], "g string, o int, from_last double, from_first double")
    r = windows.step_summary(steps, ["g"], "o", 2).first()
    assert (r["n"], r["median_upto"], r["median_beyond"], r["share_unchanged"]) == (5, 0.5, 0.1, pytest.approx(1 / 3))
    assert r["rho"] == pytest.approx(9.5 / math.sqrt(10 * 9.5))


def test_member_intervals(spark):
    cal = spark.createDataFrame([("t", i, m, 10.0 * i + m, 10.0 * i) for i in range(1, 12) for m in (0, 2)], "task string, key int, seed int, y_pred double, y_true double")
    test = spark.createDataFrame([("t", 50, 0, 5.0), ("t", 50, 2, 7.0)], "task string, key int, seed int, y_pred double")
    got = {(r["method"], r["variant"]): r for r in conformal.member_intervals(cal, test, ["task"], "key", "seed", 0, 0.5).collect()}
    assert {k: (r["lower"], r["upper"]) for k, r in got.items()} == {("ensemble", "plain"): (5.0, 7.0), ("ensemble", "normalised"): (pytest.approx(5.0), pytest.approx(7.0)), ("first", "plain"): (5.0, 5.0)}
    assert got["first", "plain"]["uncertainty"] is None and got["ensemble", "plain"]["uncertainty"] == pytest.approx(math.sqrt(2))


def test_bootstraps_by_regime(spark):
    units = spark.createDataFrame([(i, r, ["u", "v", None][i % 3], 1.0 + i % 3 + (r == "y") * 10) for i in range(60) for r in ("x", "y")] + [(99, "x", "w", None)], "unit int, regime string, stratum string, d double")
    both = {r["regime"]: r for r in inference.stratified_bootstrap(units, "unit", "stratum", "d", 50, 3, ["regime"]).collect()}
    assert both["x"]["per_stratum"] == {"u": 1.0, "v": 2.0, "null": 3.0} and both["x"]["estimate"] == 2.0 and both["y"]["estimate"] == 12.0
    alone = inference.stratified_bootstrap(units.filter("regime = 'y'"), "unit", "stratum", "d", 50, 3).first()
    assert alone.asDict().items() <= both["y"].asDict().items() and alone["low"] == alone["high"] == 12.0 and alone["p"] == 0.0


def test_curves_and_exclusion(spark):
    df = spark.createDataFrame([(i, float(i % 10), 2.0 * (i % 10)) for i in range(40)], "key int, x double, y double")
    tasks = spark.createDataFrame([(d, 5, i, "train" if i < 10 + d else "test") for d in range(2) for i in range(40)], "draw int, size int, key int, role string")
    curves = models.fold_curves(tasks, df, "key", ["draw", "size"], "x", "y")
    assert rows_of(curves.filter("method = 'line'").withColumn("mae", F.round("mae", 9)), "draw", "n_train", "mae") == [(0, 10, 0.0), (1, 11, 0.0)]
    r = models.paired_curve(curves, "size", ["draw"], "method", "mean", "mae").first()
    assert (r["method"], r["better"], r["n"]) == ("line", 2, 2) and r["change"] < -4
    full = spark.createDataFrame([(1, "a", 0.0, 4.0), (2, "a", 0.0, 2.0), (3, "a", 0.0, 9.0)], "key int, g string, y_true double, y_pred double")
    audited = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "a", 1.0, 3.0)], "key int, g string, y_true double, y_pred double")
    assert tuple(models.exclusion_effect(full, audited, ["key"], ["g"]).first()) == ("a", 2, 2.0, 1.0, pytest.approx(math.sqrt(5)), pytest.approx(math.sqrt(2)))


def test_conflicts_against_each_row_left_out(spark):
    """Ties, a null group, null labels, a twin that agrees, groups of two."""
    groups = {"a": [1, 1, 1, 9], "b": [1, 9], "c": [5, 5, 5], None: [0, 4, 4, 4.5], "d": [2, 2, 8, 8], "e": [1, 1.5, 2, 7, None], "f": [3, 3, 50]}
    rows = [(g, f"{g}{i}", f"{g}{i + 1 if (g == 'f' and i == 2) else i - 1}", None if v is None else float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    rows = [(g, k, "f9" if k == "f2" else t, y) for g, k, t, y in rows] + [("f", "f9", "f2", 49.5)]
    got = {r["k"]: r for r in audit.group_conflicts(spark.createDataFrame(rows, "g string, k string, t string, y double").repartition(3), "g", "k", "t", "y", 2.0).collect()}
    want = {}
    for g in groups:
        known = [(k, t, y) for h, k, t, y in rows if h == g and y is not None]
        if max(y for *_, y in known) - min(y for *_, y in known) <= 2:
            continue
        for k, t, y in known:
            others = sorted(v for j, _, v in known if j != k)
            m = len(others)
            median = (others[(m - 1) // 2] + others[m // 2]) / 2
            twin = next((v for j, _, v in known if j == t and j != k), None)
            want[k] = (median, others[-1] - others[0], twin, len(known) >= 3 and abs(y - median) > 2 and others[-1] - others[0] <= 2 and (twin is None or abs(y - twin) > 2))
    assert {k: (r["others_median"], r["others_spread"], r["twin_label"], r["exclude"]) for k, r in got.items()} == want and sum(w[3] for w in want.values()) == 3


def test_conflicts_take_few_shuffles(spark):
    df = spark.createDataFrame([("a", "k", "t", 1.0)], "g string, k string, t string, y double")
    plan = audit.group_conflicts(df, "g", "k", "t", "y", 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4 and "row_number" not in plan


def test_audit_notes_and_guards(spark):
    rows = spark.createDataFrame([("x", 1, "a", "e1", False), ("x", 2, "b", "e2", True), ("y", 1, "c", None, False)], "k string, order int, category string, evidence string, exclude boolean")
    notes = lambda *n: spark.createDataFrame(n, "k string, note string")
    got = {r["k"]: (r["exclude"], r["evidence"]) for r in audit.build_audit([rows], "k", notes=notes(("x", "n2"), ("x", "n1"), ("y", "n3"), ("x", "n1"))).collect()}
    assert got == {"x": (True, "e1; e2; n1; n2"), "y": (False, "n3")}
    with pytest.raises(PySparkException, match="no check flagged: z"):
        audit.build_audit([rows], "k", notes=notes(("z", "n"))).collect()
    table = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "k string")
    assert rows_of(audit.apply_audit(table, audit.build_audit([rows], "k"), "k", fixed=["z"]), "k") == [("y",), (None,)]
    with pytest.raises(PySparkException, match="not in the table: q"):
        audit.apply_audit(table, audit.build_audit([rows], "k"), "k", fixed=["z", "q"]).collect()


def test_external_columns(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("b", 3, None), (None, 4, 1), (None, 5, 1)], "k string, o int, n int")
    near = spark.createDataFrame([("a", 0.5)], "k string, similarity double")
    got = audit.external_set(rows, spark.createDataFrame([("b",)], "k string"), "k", "o", [], F.when(F.col("k") == "a", "first"), "n", near)
    assert rows_of(got, "o", "exclude_reason", "subgroup", "single_measurement", "nearest_similarity") == [(1, "", "first", True, 0.5), (2, "duplicate", "first", False, 0.5), (3, "in training", None, False, None), (4, "", None, True, None), (5, "", None, True, None)]


def test_ledger_keeps_state_only(spark, tmp_path):
    """Late duplicates, ties and nulls over three starts; the ledger's files may go: no batch reads them."""
    import shutil

    source, out, kinds = f"{tmp_path}/in", f"{tmp_path}/out", "key int, n int, status string"
    batches = [[(1, 2, "second"), (1, 1, "first"), (2, None, "null"), (2, 7, "seven"), (None, 1, "none")], [(1, 0, "late"), (3, 1, "new")], [(3, 0, "late"), (None, 0, "late"), (4, 4, "four")]]
    seen = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(source)
        outcome_ledger(spark.readStream.schema(kinds).parquet(source), out, f"{tmp_path}/c", "key", "n").awaitTermination()
        seen.append(rows_of(spark.read.schema(kinds).parquet(out), "key", "status"))
    assert seen[2] == sorted([(1, "first"), (2, "seven"), (None, "none"), (3, "new"), (4, "four")], key=str)
    for f in tmp_path.glob("out/*.parquet"):
        f.unlink()
    spark.createDataFrame([(5, 5, "five"), (1, 9, "later")], kinds).write.mode("append").parquet(source)
    outcome_ledger(spark.readStream.schema(kinds).parquet(source), out, f"{tmp_path}/c", "key", "n").awaitTermination()
    shutil.rmtree(f"{out}/_spark_metadata")
    assert rows_of(spark.read.schema(kinds).parquet(out), "key", "status") == [(5, "five")]
