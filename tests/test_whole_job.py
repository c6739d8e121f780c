"""Operators do the whole job: each case failed on a cut that was there before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import conformal, models
from gaugework.plans.catalogue import QUERIES
from gaugework.plans.views import table

SF = "/root/testdata/sf0.001"


def test_nested_cv_tunes_over_all_inner_folds(spark, monkeypatch):
    """Options "a" are exact in folds 0 and 1 and far off elsewhere; the first inner fold alone would choose them."""
    seen = []

    def stub(train, test, features, y, kind, seed, name):
        seen.append((name, frozenset(r[0] for r in train.select("fold").distinct().collect())))
        off = F.when(F.col("fold") < 2, 0.0).otherwise(10.0) if name == "a" else F.lit(1.0)
        return test.withColumns({"y_pred": F.col("y") + off, "name": F.lit(name)}), None

    monkeypatch.setattr(models, "tree_predict", stub)
    df = spark.createDataFrame([(f, float(i)) for f in range(4) for i in range(1 + f)], "fold int, y double")
    rows = models.nested_cv(df, [], "y", "fold", [{"name": "a"}, {"name": "b"}]).collect()
    assert len(rows) == 10 and {r["name"] for r in rows} == {"b"}
    assert {s for n, s in seen if n == "a"} == {frozenset({0, 1, 2, 3} - {i, j}) for i in range(4) for j in range(i)}
    with pytest.raises(ValueError, match="no rows to tune on"):
        models.nested_cv(df.filter("fold < 2"), [], "y", "fold", [{"name": "a"}, {"name": "b"}])


@pytest.mark.parametrize("group", [[], ["g"]])
def test_cv_plus_counts_in_sorted_lists(spark, group):
    """Equal to all shifted residuals sorted, with ties, uneven folds and a group without finite bounds; no row meets a residual."""
    rng = np.random.default_rng(4)
    residuals = [(int(f), "a" if i % 3 else "b", float(rng.integers(-40, 40)) / 4) for i, f in enumerate(rng.integers(0, 3, 200))] + [(1, "c", 2.0)]
    centres = [(k, f, "abc"[k % 3], float(v)) for k in range(60) for f, v in enumerate(rng.normal(0, 5, 3).round(k % 3))]
    frame = conformal.cv_plus(spark.createDataFrame(centres, "key int, fold int, g string, y_pred double"), spark.createDataFrame(residuals, "fold int, g string, residual double"), "fold", ["key"], 0.1, group)
    assert "residual" not in frame._jdf.queryExecution().optimizedPlan().toString()
    got = {r["key"]: (r["lower"], r["upper"]) for r in frame.collect()}
    for k in range(60):
        met = [(c, abs(r)) for key, f, g, c in centres if key == k for fold, h, r in residuals if f == fold and (not group or g == h)]
        n, low, high = len(met), sorted(c - r for c, r in met), sorted(c + r for c, r in met)
        a, b = int(np.floor(0.1 * (n + 1) + 1e-9)), int(np.ceil(0.9 * (n + 1) - 1e-9))
        assert got[k] == (low[a - 1] if a >= 1 else -np.inf, high[b - 1] if b <= n else np.inf)


@pytest.mark.parametrize("name", ["c3_cv_plus_whole", "c4_mondrian_cv_plus_whole"])
def test_each_row_of_the_test_fold_has_an_interval(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r["key"] for r in rows) == sorted(r[0] for r in table(spark, SF, "ev").filter("fold = 0").select("key").collect())
    assert all(np.isfinite([r["lower"], r["upper"]]).all() for r in rows)


def test_learning_curve_ends_with_all_training_rows(spark):
    sizes = sorted((r["size"], r["n"]) for r in QUERIES["m13_learning_curve_nested"](spark, SF).collect())
    train = table(spark, SF, "ev").filter("fold <> 0").count()
    assert len(sizes) == 4 and sizes[-1] == (train, train) and sizes == sorted(sizes, key=lambda x: x[1]) and all(n >= size for size, n in sizes)


def test_each_model_predicts_each_test_row(spark):
    rows = QUERIES["m7_residuals_and_predictions"](spark, SF).collect()
    ev = table(spark, SF, "ev")
    want = {(r[0], f) for r in ev.filter("fold = 0").select("key").collect() for f in range(1, 5)}
    assert {(r["key"], r["fold"]) for r in rows if r["kind"] == "prediction"} == want
    assert sorted(r["key"] for r in rows if r["kind"] == "residual") == sorted(r[0] for r in ev.filter("fold <> 0").select("key").collect())


def test_compare_additions(spark):
    """An addition on the true line helps most where the base rows lead astray; the base arm has no change."""
    df = lambda rows: spark.createDataFrame(rows, "key int, x double, y double")
    base, more = df([(i, float(i % 5), 0.0) for i in range(20)]), df([(i, float(i % 50), 2.0 * (i % 50)) for i in range(400)])
    test = df([(i, float(i % 50), 2.0 * (i % 50)) for i in range(100)])
    got = {r["arm"]: r for r in models.compare_additions(base, {"more": more, "same": base}, test, "key", F.col("x") >= 40, "x", "y", 50, 1).collect()}
    assert {a: r["n_added"] for a, r in got.items()} == {"base": 0, "more": 400, "same": 20} and got["base"]["rmse_change"] is None
    r = got["more"]
    assert r["rmse_hard_change"] < r["rmse_change"] < 0 and r["rmse_low"] <= r["rmse_change"] <= r["rmse_high"] < 0 and r["rmse_hard_low"] <= r["rmse_hard_change"] <= r["rmse_hard_high"] < 0
    assert r["rmse_change"] == pytest.approx(r["rmse"] - got["base"]["rmse"]) and got["same"]["rmse_change"] == pytest.approx(0)


def test_sliced_errors_has_pairs(spark):
    rows = QUERIES["st11_sliced_pairs"](spark, SF).collect()
    assert {"stratum", "late", "stratum x late"} == {r["attribute"] for r in rows}
