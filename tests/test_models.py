"""Models against numpy on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import models as M


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)) * [1, 5, 0.2, 3] + [1e6, 0, 3, -2]
    x[:, 2] = 3.0  # constant: no weight, and not counted in its block
    y = 2 * (x[:, 0] - 1e6) - 0.3 * x[:, 1] + 0.5 * x[:, 3] + rng.normal(size=90) + 50
    fold = np.arange(90) % 3
    rows = [(i, int(f), *map(float, a), float(b)) for i, (f, a, b) in enumerate(zip(fold, x, y))]
    return x, y, fold, spark.createDataFrame(rows, "key long, fold int, a double, b double, c double, d double, y double")


def by_hand(x, y, new, alpha, blocks):
    """Ridge on standardised features, each divided by the root of its block's number of varying ones."""
    mean, sd = x.mean(0), x.std(0)
    varies = sd > 1e-12
    cuts = np.cumsum([0, *blocks])
    factor = np.concatenate([np.full(b - a, np.sqrt(max(1, varies[a:b].sum()))) for a, b in zip(cuts[:-1], cuts[1:])])
    scale = lambda v: np.where(varies, (v - mean) / np.where(varies, sd, 1), 0) / factor
    z, t = scale(x), (y - y.mean()) / y.std()
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ t)
    return scale(new) @ w * y.std() + y.mean()


@pytest.mark.parametrize("blocks", [[["a", "b", "c"], ["d"]], [["a"], ["b"], ["c"], ["d"]]])
def test_concat_ridge(table, blocks):
    x, y, fold, df = table
    sizes, alphas = [len(b) for b in blocks], [0.5, 20.0]
    folds = {a: np.concatenate([by_hand(x[fold != k], y[fold != k], x[fold == k], a, sizes) for k in range(3)]) for a in alphas}
    order = np.concatenate([np.flatnonzero(fold == k) for k in range(3)])
    best = min(alphas, key=lambda a: np.abs(folds[a] - y[order]).mean())
    got = {r["key"]: r["y_pred"] for r in M.concat_ridge(df, blocks, "y", "fold", alphas).collect()}
    assert np.allclose([got[k] for k in order], folds[best], rtol=1e-6, atol=1e-6)


def test_block_weights_have_an_effect(table):
    _, _, _, df = table
    one, two = ({r["key"]: r["y_pred"] for r in M.concat_ridge(df, b, "y", "fold", [20.0]).collect()} for b in ([["a", "b", "c"], ["d"]], [["a", "b", "c", "d"]]))
    assert max(abs(one[k] - two[k]) for k in one) > 0.01


def test_ridge_refit(table):
    x, y, fold, df = table
    got = {r["key"]: r["y_pred"] for r in M.ridge_refit(df.filter("fold <> 2"), df.filter("fold = 2"), ["a", "b", "c", "d"], "y", "fold", [5.0], [4]).collect()}
    want = by_hand(x[fold != 2], y[fold != 2], x[fold == 2], 5.0, [4])
    assert np.allclose([got[k] for k in np.flatnonzero(fold == 2)], want, rtol=1e-6, atol=1e-6)


def test_simplex_weights(table):
    x, y, _, df = table
    rows = df.withColumns({"p": F.col("y") + 1, "q": F.col("y") - 3, "r": F.lit(0.0)})
    weights = M.stack_weights(rows, "y", ["p", "q", "r"])
    assert sum(weights.values()) == pytest.approx(1) and min(weights.values()) >= 0
    # p off by 1 and q by -3: three parts of p and one of q hit y
    assert weights["p"] == pytest.approx(0.75, abs=0.05) and weights["q"] == pytest.approx(0.25, abs=0.05)


def test_trees_and_success_probability(table):
    x, y, fold, df = table
    rows, model = M.tree_predict(df.filter("fold <> 0"), df.filter("fold = 0"), ["a", "b", "d"], "y", "forest", numTrees=20, maxDepth=4)
    got = rows.select(F.avg(F.abs(F.col("y") - F.col("y_pred")))).first()[0]
    assert got < np.abs(y[fold == 0] - y[fold != 0].mean()).mean()
    importance = {r["feature"]: r["importance"] for r in M.feature_importance(model, ["a", "b", "d"], df.sparkSession).collect()}
    assert sum(importance.values()) == pytest.approx(1) and set(importance) == {"a", "b", "d"}
    marked = df.withColumn("label", (F.col("d") > -2).cast("double"))
    p = {r["key"]: (r["p_success"], r["d"]) for r in M.success_probability(marked, df, ["d"], "label").collect()}
    ordered = [v for v, _ in sorted(p.values(), key=lambda v: v[1])]
    assert ordered == sorted(ordered) and 0 <= ordered[0] < 0.5 < ordered[-1] <= 1


def test_nested_cv_leaks_nothing(table):
    """A test fold's labels change none of its predictions."""
    _, _, _, df = table
    grid = [{"maxDepth": 1, "numTrees": 3}, {"maxDepth": 4, "numTrees": 3}]
    run = lambda d: {r["key"]: r["y_pred"] for r in M.nested_cv(d, ["a", "b", "d"], "y", "fold", grid, "forest").collect() if r["fold"] == 0}
    spoilt = df.withColumn("y", F.when(F.col("fold") == 0, F.col("y") * -7 + 1000).otherwise(F.col("y")))
    assert run(df) == run(spoilt)
