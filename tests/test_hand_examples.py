"""Small worked examples with exact answers."""

import math

import pytest
from pyspark.sql import functions as F

from gaugework.functions.probability import normal_cdf, student_two_sided
from gaugework.operators import audit, conformal, inference, joins, projections, splits, windows
from gaugework.streaming.ledger import outcome_ledger


def test_split_width(spark):
    rows = [("a", float(i)) for i in range(1, 10)] + [("b", float(i)) for i in range(1, 20)] + [("c", float(i)) for i in range(1, 9)]
    got = {r["g"]: r["width"] for r in conformal.split_width(spark.createDataFrame(rows, "g string, r double"), ["g"], "r", 0.1).collect()}
    assert got == {"a": 9.0, "b": 18.0, "c": math.inf}


def test_cv_plus(spark):
    centres = spark.createDataFrame([("t", 0, 10.0), ("t", 1, 20.0)], "key string, fold int, y_pred double")
    residuals = spark.createDataFrame([(0, float(i)) for i in range(1, 5)] + [(1, float(i)) for i in range(5, 10)], "fold int, residual double")
    row = conformal.cv_plus(centres, residuals, "fold", ["key"], 0.1).first()
    assert (row["lower"], row["upper"]) == (6.0, 29.0)
    row = conformal.cv_plus(centres, residuals.filter("residual < 9"), "fold", ["key"], 0.1).first()
    assert (row["lower"], row["upper"]) == (-math.inf, math.inf)


def test_holm(spark):
    rows = spark.createDataFrame([(f"h{i}", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.2, 0.001])], "name string, p double")
    got = {r["name"]: r["p_holm"] for r in inference.holm(rows, [], "name", "p").collect()}
    assert [round(got[f"h{i}"], 9) for i in range(5)] == [0.04, 0.09, 0.09, 0.2, 0.005]


def test_corrected_t(spark):
    diffs = [0.3, -0.1, 0.4, 0.2, 0.0, 0.5, 0.1, 0.2, 0.3, -0.2]
    df = spark.createDataFrame([("m", d, 1000.0, 250.0) for d in diffs], "m string, d double, ntr double, nte double")
    row = inference.corrected_t(df, ["m"], "d", "ntr", "nte").first()
    mean = sum(diffs) / 10
    var = sum((d - mean) ** 2 for d in diffs) / 9
    assert row["df"] == 9 and row["se"] == pytest.approx(math.sqrt((1 / 10 + 0.25) * var))


def test_distributions(spark):
    row = spark.range(1).select(normal_cdf(F.lit(1.959964)).alias("n"), student_two_sided(F.lit(2.144787), F.lit(14.0)).alias("e"), student_two_sided(F.lit(2.262157), F.lit(9.0)).alias("o")).first()
    assert row["n"] == pytest.approx(0.975, abs=1e-6) and row["e"] == pytest.approx(0.05, abs=1e-6) and row["o"] == pytest.approx(0.05, abs=1e-6)


def test_retention(spark):
    df = spark.createDataFrame([(1, 3.0, 30.0), (2, 1.0, 10.0), (3, 2.0, 20.0), (4, 4.0, 40.0)], "key int, score double, error double").withColumn("g", F.lit("a"))
    got = {r["fraction"]: r["mae"] for r in windows.retention_curve(df, ["g"], "score", "error", "key", [0.25, 0.5, 1.0]).collect()}
    assert got == {0.25: 10.0, 0.5: 15.0, 1.0: 25.0}


def test_labels_to_match(spark):
    rows = [("random", s, v) for s, v in zip((100, 200, 300), (40.0, 35.0, 30.0))] + [("fast", s, v) for s, v in zip((100, 200, 300), (36.0, 30.0, 28.0))]
    got = {(r[0], r[1]): r[2] for r in windows.labels_to_match(spark.createDataFrame(rows, "strategy string, size int, value double"), "strategy", "size", "value", "random").collect()}
    assert got["random", 200] == 200 and got["fast", 200] == pytest.approx(100 + 100 / 6) and got["fast", 300] == 200


def test_first_to_reach(spark):
    rows = [("s", 0, 1, 0), ("s", 0, 2, 1), ("s", 1, 1, 1), ("s", 1, 2, 1)]
    got = {r["target"]: (r["mean_steps"], r["reached"]) for r in windows.first_to_reach(spark.createDataFrame(rows, "strategy string, seed int, step int, hits int"), "strategy", "seed", "step", "hits", [1, 5]).collect()}
    assert got == {1: (1.5, "2/2"), 5: (None, "0/2")}


def test_nearest_tokens(spark):
    train = spark.createDataFrame([("x", "a", 1), ("x", "c", 2), ("y", "b", 3)], "tk string, token string, c int")
    test = spark.createDataFrame([("p", "a", 1), ("p", "c", 2), ("q", "a", 1), ("q", "c", 1), ("r", "z", 1)], "k string, token string, c int")
    got = {r["k"]: r["similarity"] for r in joins.nearest_tokens(test, train, "k", "tk", "token", "c").collect()}
    assert got["p"] == 1 and got["q"] == pytest.approx(2 / 3) and got["r"] == 0


def test_merge_rare_and_labels(spark):
    df = spark.createDataFrame([(c,) for c in ["a"] * 30 + ["b"] * 10 + ["c"] * 3], "f string")
    assert {r["f"]: r["count"] for r in projections.merge_rare(df, "f", 25).groupBy("f").count().collect()} == {"a": 30, "other": 13}
    assert {r[0] for r in projections.stratification_labels(df, "f", 5).select("stratum_label").distinct().collect()} == {"a", "b"}


def test_correlated_columns(spark):
    rows = [(float(i), 2.0 * i + (i % 3) * 0.01, float((i * 37) % 11)) for i in range(60)]
    assert projections.uncorrelated(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]) == ["a", "c"]


def test_group_folds_keep_groups(spark):
    df = spark.createDataFrame([(g, s, i) for g in range(150) for s in [("a", "b", "c")[g % 3]] for i in range(1 + g % 3)], "g int, s string, i int")
    one = splits.stratified_group_kfold(df, "s", "g", 5, 3)
    assert one.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert one.select("fold").distinct().count() == 5
    again = splits.stratified_group_kfold(df.repartition(7), "s", "g", 5, 3)
    assert sorted(map(tuple, one.select("g", "i", "fold").collect())) == sorted(map(tuple, again.select("g", "i", "fold").collect()))


def test_nested_subsets_nest(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", i // 4) for i in range(400)], "key int, s string, g int")
    entry = {r[0]: r[1] for r in splits.nested_subsets(df, "key", "s", "g", [40, 100, 200], 1).collect()}
    sizes = [sum(e is not None and e <= n for e in entry.values()) for n in (40, 100, 200)]
    assert all(n <= s for n, s in zip((40, 100, 200), sizes)) and sizes == sorted(sizes)
    assert all(len({entry[i] for i in range(4 * g, 4 * g + 4)}) == 1 for g in range(100))


def test_audit_merge(spark):
    rows = spark.createDataFrame([("x", 1, "a", "e1", False), ("x", 2, "b", "e2", True), ("x", 3, "a", "e1", False), ("y", 1, "c", "e3", False)], "k string, order int, category string, evidence string, exclude boolean")
    got = {r["k"]: (r["exclude"], r["category"], r["evidence"]) for r in audit.build_audit([rows], "k").collect()}
    assert got == {"x": (True, "a; b", "e1; e2"), "y": (False, "c", "e3")}


def test_ledger_restarts_without_repeats(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "key int, n int, status string"
    spark.createDataFrame([(1, 1, "found"), (1, 2, "error"), (2, 3, "found")], schema).write.parquet(source)
    for turn in range(2):
        outcome_ledger(spark.readStream.schema(schema).parquet(source), out, f"{tmp_path}/c", "key", "n").awaitTermination()
        spark.createDataFrame([(2, 9, "late"), (3, 4, "found")], schema).write.mode("append").parquet(source)
    outcome_ledger(spark.readStream.schema(schema).parquet(source), out, f"{tmp_path}/c", "key", "n").awaitTermination()
    assert sorted((r["key"], r["status"]) for r in spark.read.parquet(out).collect()) == [(1, "found"), (2, "found"), (3, "found")]


def test_run_records_and_sinks(spark, tmp_path):
    from gaugework.sources.tables import collect_runs, read_table, require_none, write_results

    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text('{"task": "t", "lr": 0.1, "key": ["x", "y"], "y_pred": [1.5, 2.5]}\n')
    (tmp_path / "runs" / "b.json").write_text('{"task": "t", "lr": 0.2, "key": ["x"], "y_pred": [9.0]}\n')
    rows = collect_runs(spark, f"{tmp_path}/runs", "task string, lr double, key array<string>, y_pred array<double>", ["key", "y_pred"], F.col("lr") == 0.1)
    assert sorted(map(tuple, rows.collect())) == [("t", 0.1, "x", 1.5), ("t", 0.1, "y", 2.5)]
    write_results(rows, f"{tmp_path}/out.csv", order=["key"])
    back = read_table(spark, f"{tmp_path}/out.csv", "task string, lr double, key string, y_pred double", ["key", "y_pred"])
    assert sorted(map(tuple, back.collect())) == [("x", 1.5), ("y", 2.5)]
    require_none(back.filter("y_pred < 0"), "negative")
    with pytest.raises(ValueError):
        require_none(back, "rows")


def test_guards_raise(spark):
    df = spark.createDataFrame([(1, -2.0), (2, 3.0)], "k int, v double")
    with pytest.raises(Exception, match="negative"):
        projections.log1p_guarded(df, ["v"]).collect()
    with pytest.raises(Exception, match="repeats a key"):
        joins.join_many_to_one(df, df.unionByName(df).select("k", F.col("v").alias("w")), ["k"]).collect()
    with pytest.raises(Exception, match="in no bin"):
        projections.assign_bins(df, "k", [("one", 1, 1)]).collect()
