"""CV+ intervals through search trees of several levels, against all shifted residuals sorted."""

import numpy as np
import pytest

from gaugework.operators import conformal


@pytest.mark.parametrize("fan, block", [(4, 7), (256, 4096)])
def test_equal_to_all_shifted_residuals(spark, monkeypatch, fan, block):
    """Half of a fold's residuals are one value, one is infinite, some are null or NaN; centres far apart and equal ones; a fold without residuals."""
    monkeypatch.setattr(conformal, "FAN", fan)
    monkeypatch.setattr(conformal, "BLOCK_ROWS", block)
    rng = np.random.default_rng(8)
    residuals = [(0, 1.25 if i % 2 else float(v)) for i, v in enumerate(rng.normal(0, 3, 160))] + [(1, float(v)) for v in rng.integers(-30, 30, 90)] + [(2, float("inf")), (2, 0.5), (2, None), (1, float("nan"))]
    centres = [(k, f, float(v)) for k in range(40) for f, v in enumerate(rng.normal(0, 10 ** (k % 4), 3).round(k % 3))] + [(41, 7, 1.0), (42, 0, None), (43, 0, 2.0), (44, None, 1.0)]
    frame = conformal.cv_plus(spark.createDataFrame(centres, "key int, fold int, y_pred double").repartition(3), spark.createDataFrame(residuals, "fold int, residual double").repartition(3), "fold", ["key"], 0.2)
    got = {r["key"]: (r["lower"], r["upper"]) for r in frame.collect()}
    want = {}
    for k in {k for k, f, v in centres}:
        met = [(c, abs(r)) for key, f, c in centres if key == k and c is not None for fold, r in residuals if f == fold and r is not None and r == r]
        if met:
            n, low, high = len(met), sorted(c - r for c, r in met), sorted(c + r for c, r in met)
            a, b = int(np.floor(0.2 * (n + 1) + 1e-9)), int(np.ceil(0.8 * (n + 1) - 1e-9))
            want[k] = (low[a - 1] if a >= 1 else -np.inf, high[b - 1] if b <= n else np.inf)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_levels_hold_no_more_than_a_node(spark, monkeypatch):
    monkeypatch.setattr(conformal, "FAN", 4)
    rows = [(0, float(i % 50)) for i in range(400)] + [(1, 2.0)] * 300
    nodes, height = conformal.residual_trees(spark.createDataFrame(rows, "fold int, residual double"), ["fold"])
    got = nodes.collect()
    assert height == 3 and max(len(r["v"]) for r in got) <= 4
    top = {r["list"]: r for r in got if r["level"] == 2}
    assert top['{"fold":0}']["upto"][-1] == 400 and top['{"fold":1}']["upto"] == [300] and top['{"fold":1}']["v"] == [2.0]


def test_infinite_ranks_and_empty_tables(spark):
    centres = spark.createDataFrame([(1, 0, 5.0)], "key int, fold int, y_pred double")
    residuals = spark.createDataFrame([(0, 1.0), (0, float("inf")), (0, 2.0)], "fold int, residual double")
    assert tuple(conformal.cv_plus(centres, residuals, "fold", ["key"], 0.3).first()) == (1, -np.inf, np.inf)
    assert conformal.cv_plus(centres, residuals.filter("fold > 0"), "fold", ["key"], 0.3).count() == 0
    assert conformal.cv_plus(centres.filter("key > 1"), residuals, "fold", ["key"], 0.3).count() == 0
