"""Blend weights of least absolute error, greedy batches and vector searches, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import joins, models, selection


def table(spark, p, y):
    return spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(p, y)], ", ".join(f"p{i} double" for i in range(p.shape[1])) + ", y double")


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_a_known_blend_and_a_perfect_member(spark, loss):
    rng = np.random.default_rng(0)
    fit = lambda p, y: np.array(list((models.stack_weights(table(spark, p, y), "y", [f"p{i}" for i in range(p.shape[1])]) if loss == "squared" else models.stack_weights_absolute(table(spark, p, y), "y", [f"p{i}" for i in range(p.shape[1])])[0]).values()))
    p = rng.normal(400, 50, (300, 3))
    w = fit(p, p @ np.array([0.6, 0.4, 0.0]))
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and w == pytest.approx([0.6, 0.4, 0.0], abs=1e-4)
    y = rng.normal(400, 50, 200)
    assert fit(np.column_stack([y + rng.normal(0, 20, 200), y, y + rng.normal(0, 5, 200)]), y) == pytest.approx([0, 1, 0], abs=1e-4)
    bent = fit(np.column_stack([y * 0.5, y * 0.4]), y)
    assert bent == pytest.approx([1, 0], abs=1e-4)


def test_absolute_weights_are_certified(spark):
    """Heavy tails: within the stated gap of the best of a fine grid."""
    rng = np.random.default_rng(3)
    y = rng.normal(0, 10, 400)
    p = np.column_stack([y + rng.standard_cauchy(400), y * 0.8 + rng.normal(0, 3, 400), np.zeros(400)])
    weights, error, gap = models.stack_weights_absolute(table(spark, p, y), "y", ["p0", "p1", "p2"])
    w = np.array(list(weights.values()))
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1 - a, 101)]
    best = min(np.abs(y - p @ np.array(g)).mean() for g in grid)
    assert error == pytest.approx(np.abs(y - p @ w).mean()) and 0 <= gap < 0.01 * error and error <= best + gap + 1e-9 and best >= error - gap - 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_pair_weight_is_the_least_of_all_corners(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("a" if i % 3 else None, float(rng.integers(-5, 6)), float(rng.integers(-5, 6)), float(rng.integers(-9, 10))) for i in range(60)] + [("same", 1.0, 1.0, 5.0), ("far", 1.0, 2.0, 9.0), ("a", None, 1.0, 1.0)]
    got = {r["g"]: r["weight"] for r in models.stack_pair_weight_absolute(spark.createDataFrame(rows, "g string, p double, q double, y double"), ["g"], "y", "p", "q").collect()}
    assert got["same"] == 0.5 and got["far"] == 0.0 and len(got) == 4
    for g in ("a", None):
        known = [r[1:] for r in rows if r[0] == g and r[1] is not None]
        loss = lambda w: sum(abs(y - w * p - (1 - w) * q) for p, q, y in known)  # noqa: B023, E731
        corners = [0.0, 1.0] + [min(1, max(0, (y - q) / (p - q))) for p, q, y in known if p != q]
        assert loss(got[g]) == pytest.approx(min(map(loss, corners)))


def greedy(x, inverse, mean, k, noise, window):
    from math import erf

    left, out = list(range(len(x))), []
    z = np.column_stack([np.ones(len(x)), x])
    cdf = lambda v: 0.5 * (1 + erf(v / 2**0.5))
    for _ in range(k):
        def score(i):
            v = z[i] @ inverse @ z[i]
            return v if window is None else cdf((window[1] - z[i] @ mean) / (v + noise) ** 0.5) - cdf((window[0] - z[i] @ mean) / (v + noise) ** 0.5)

        best = max(left, key=score)
        out.append((best, score(best)))
        left.remove(best)
        m = inverse @ z[best]
        inverse = inverse - np.outer(m, m) / (noise + z[best] @ m)
    return out


@pytest.mark.parametrize("window, k, heap", [(None, 50, 1024), (None, 50, 20), ((-0.5, 0.5), 6, 1024)])
def test_greedy_batches_equal_plain_ones(spark, monkeypatch, window, k, heap):
    monkeypatch.setattr(selection, "HEAP", heap)
    rng = np.random.default_rng(6)
    lab, x = rng.normal(size=(30, 3)), rng.normal(size=(300, 3)) * [1, 2, 3]
    y = lab @ [1.0, -1.0, 0.5]
    z = np.column_stack([np.ones(30), lab])
    inverse = np.linalg.inv(z.T @ z / 0.5 + np.eye(4))
    names = ["f0", "f1", "f2"]
    labelled = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(lab, y)], "f0 double, f1 double, f2 double, y double")
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0)], "key int, f0 double, f1 double, f2 double").repartition(4)
    stats = {}
    got = [(r["key"], r["score"]) for r in selection.diverse_batch(labelled, rows, "key", names, "y", k, 0.5, window, stats).orderBy("pick").collect()]
    want = greedy(x, inverse, inverse @ (z.T @ y) / 0.5, k, 0.5, window)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)
    assert stats["passes"] == (k if window else 1 if heap > 300 else stats["passes"]) and (window or stats["passes"] < 25)


def test_batch_of_a_small_table(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0)], "key int, f double")
    got = selection.diverse_batch(rows.withColumn("y", F.lit(0.0)), rows, "key", ["f"], "y", 9).collect()
    assert len(got) == 3 and {r["key"] for r in got} == {1, 2, 3}
    assert selection.diverse_batch(rows.withColumn("y", F.lit(0.0)), rows.filter("key > 3"), "key", ["f"], "y", 2).count() == 0


def test_retrieval_tells_robust_vectors_from_others(spark):
    rng = np.random.default_rng(0)
    canonical = rng.normal(size=(20, 8))
    frame = lambda rows: spark.createDataFrame([(i, v.tolist()) for i, v in rows], "k int, v array<double>")
    own = frame(enumerate(canonical))
    good = joins.retrieval(own, frame((i, canonical[i] + 0.01 * rng.normal(size=8)) for i in range(20) for _ in range(5)), "k", "v").first()
    bad = joins.retrieval(own, frame((i, rng.normal(size=8)) for i in range(20) for _ in range(5)), "k", "v").first()
    assert good["n"] == 100 and good["retrieval_share"] == 1.0 and good["median_distance_ratio"] < 0.1
    assert bad["retrieval_share"] < 0.3 and bad["median_distance_ratio"] > 1
    assert joins.retrieval(own, own.filter("k > 99"), "k", "v").first()["n"] == 0


def test_min_max_and_empty_bags(spark):
    df = spark.createDataFrame([(1, [0.0, 5.0, 1.0]), (2, [4.0, 5.0, None]), (3, None)], "k int, v array<double>")
    assert {r["k"]: r["v"] for r in joins.min_max_scaled(df, df, "v").collect()} == {1: [0.0, 0.0, 0.0], 2: [1.0, 0.0, None], 3: None}
    bags = lambda rows: spark.createDataFrame(rows, "k int, token string, n int")
    test, train = bags([(1, "a", 2), (1, "b", 1), (2, None, None), (3, "z", 1), (4, "a", 0)]), bags([(7, "a", 1), (7, "b", 3), (8, None, None)])
    near = lambda tr, c: {r["k"]: r["similarity"] for r in joins.nearest_tokens(test, tr.withColumnRenamed("k", "o"), "k", "o", "token", c).collect()}
    assert near(train, "n") == {1: 2 / 5, 2: 1.0, 3: 0.0, 4: 1.0}
    assert near(train.filter("k = 7"), "n") == {1: 2 / 5, 2: 0.0, 3: 0.0, 4: 0.0}
    assert near(train, None) == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.5}


def test_least_distances_are_those_of_differences():
    """Near ones far from the origin, copies and equal rows: the same nearest row, and its distance to full precision."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        a = rng.normal(size=(int(rng.integers(1, 30)), 5)) * 10.0 ** int(rng.integers(-3, 4)) + 10.0 ** int(rng.integers(-2, 4))
        b = np.concatenate([rng.normal(size=(20, 5)), a[:3] + 1e-7, a[:2], a[:2]])
        plain = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        got = joins.euclidean_distances(a, b)
        assert (got.argmin(axis=1) == plain.argmin(axis=1)).all() and got.min(axis=1) == pytest.approx(plain.min(axis=1), rel=1e-12, abs=0)
