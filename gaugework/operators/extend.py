"""Places where a caller plugs in own code."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES: dict[str, Callable] = {}


def register_feature(name: str, function: Callable) -> None:
    """A vectorised function of pandas Series that gives a Series of numbers."""
    FEATURES[name] = function


def with_features(df: DataFrame, names: dict[str, list[str]], finite_only: bool = True) -> DataFrame:
    """Registered features of input columns; with ``finite_only``, rows with a feature that is null, NaN or infinite go."""

    def vectorised(function: Callable) -> Callable:
        def values(*columns: pd.Series) -> pd.Series:
            return function(*columns)

        return F.pandas_udf(values, "double")

    out = df.withColumns({n: vectorised(FEATURES[n])(*[F.col(c) for c in inputs]) for n, inputs in names.items()})
    if finite_only:
        for n in names:
            out = out.filter(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf")))
    return out


def evaluate(df: DataFrame, fold: str, estimators: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """Tidy predictions of named functions (train, test) -> test with y_pred, fold by fold."""
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        for name, fit_predict in estimators.items():
            rows = fit_predict(df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)).withColumn("method", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
    return out
