"""The least and greatest centres over all residuals of a fold, without a row for each pair."""

import math

import pytest
from pyspark.sql import functions as F

from gaugework.operators import joins
from gaugework.plans.catalogue import QUERIES
from gaugework.plans.views import table

NAN, INF = float("nan"), float("inf")


def test_query_joins_the_outermost_residuals_only(spark, monkeypatch):
    """Each test row met each residual of its fold before: pairs grew with the square of the tables."""
    met, plain = [], joins.fold_residual_join
    monkeypatch.setattr(joins, "fold_residual_join", lambda test, residuals, keys: met.append(residuals) or plain(test, residuals, keys))
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["j10_fold_residuals"](spark, sf).collect()
    assert len(rows) == table(spark, sf, "customer").count()
    assert len(met) == 1 and 0 < met[0].count() <= 3 * 5 < table(spark, sf, "supplier").count()


@pytest.mark.parametrize("kind", ["double", "float", "decimal(12,2)", "bigint"])
def test_range_equals_all_pairs(spark, kind):
    """Every fold holds another set of odd residuals; the odd predictions meet all of them. Rows of one key in two folds are one row."""
    odd = kind in ("double", "float")
    values = [None, 2.0, -7.0, 0.0, *([0.1, 1e16, -1e16, INF, -INF, NAN] if odd else [])]
    sets = [(a, b, c) for i, a in enumerate(values) for j, b in enumerate(values[i:], i) for c in values[j:]]
    frame = lambda rows, names: spark.createDataFrame(rows, names).selectExpr("* except (x)", f"CAST(x AS {kind}) AS x")
    residuals = frame([(f, x) for f, s in enumerate(sets) for x in s] + [(None, 9.0)], "fold int, x double").withColumnRenamed("x", "residual")
    folds = [*range(len(sets)), None, len(sets)]  # a null fold and one without residuals meet nothing
    test = frame([(f"{f}/{y}", f, x) for f in folds for y, x in enumerate(values)] + [("two", 0, 2.0), ("two", 1, 2.0)], "key string, fold int, x double").withColumnRenamed("x", "y_pred")
    pairs = joins.fold_residual_join(test, residuals, ["fold"]).groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ours = joins.fold_residual_range(test, residuals, ["fold"], ["key"])
    assert ours.schema == pairs.schema
    same = lambda a, b: a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    got, want = ({r["key"]: (r["low"], r["high"]) for r in df.collect()} for df in (ours, pairs))
    assert got.keys() == want.keys() and len(got) == len(sets) * len(values) + 1
    assert not [k for k in want if not all(map(same, got[k], want[k]))]
