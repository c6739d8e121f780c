"""Models fitted as distributed jobs: ridge from sufficient statistics, trees from MLlib, stacking from small Gram matrices."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.randomness import poisson_one, uniform
from ..session import settled
from .ranks import null_safe_join, ranked


# ---- one feature: closed form in expressions -------------------------------------------------------------------------

SUMS = ["n", "sx", "sy", "sxx", "sxy", "syy"]


def line_sums(df: DataFrame, by: list[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """(by, n, sx, sy, sxx, sxy, syy): all that a one-feature model needs of its rows."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * a).alias("sx"), F.sum(w * b).alias("sy"), F.sum(w * a * a).alias("sxx"), F.sum(w * a * b).alias("sxy"), F.sum(w * b * b).alias("syy"))


def leave_fold_sums(sums: DataFrame, by: list[str], fold: str) -> DataFrame:
    """Training sums of each fold: the total of its group less its own."""
    total = sums.groupBy(*by).agg(*[F.sum(c).alias(f"_{c}") for c in SUMS]) if by else sums.agg(*[F.sum(c).alias(f"_{c}") for c in SUMS])
    joined = sums.join(total, by) if by else sums.crossJoin(F.broadcast(total))
    return joined.select(*by, fold, *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in SUMS])


def line_model(sums: DataFrame, by: list[str], alpha: float = 0.0) -> DataFrame:
    """(by, slope, intercept): ridge of penalty ``alpha`` on the standardised feature and target; slope 0 where the feature is constant."""
    vx = F.col("sxx") / F.col("n") - (F.col("sx") / F.col("n")) * (F.col("sx") / F.col("n"))
    cov = F.col("sxy") / F.col("n") - (F.col("sx") / F.col("n")) * (F.col("sy") / F.col("n"))
    slope = F.when(vx > 1e-12, cov / (vx * (1 + alpha / F.col("n")))).otherwise(0.0)
    return sums.select(*by, slope.alias("slope"), (F.col("sy") / F.col("n") - slope * F.col("sx") / F.col("n")).alias("intercept"))


def line_predict(df: DataFrame, model: DataFrame, on: list[str], x: str, out: str = "y_pred") -> DataFrame:
    joined = df.join(model, on) if on else df.crossJoin(F.broadcast(model))  # without keys the model is one row
    return joined.withColumn(out, F.col("intercept") + F.col("slope") * F.col(x)).drop("slope", "intercept")


def cross_validated_line(df: DataFrame, by: list[str], fold: str, x: str, y: str, alpha: float = 0.0) -> DataFrame:
    """Every row with the prediction of the model that did not see its fold."""
    model = line_model(leave_fold_sums(line_sums(df, [*by, fold], x, y), by, fold), [*by, fold], alpha)
    return line_predict(df, model, [*by, fold], x)


def segment_models(df: DataFrame, segment: str, fold: str, x: str, y: str, least: int) -> DataFrame:
    """Cross-validated lines in each segment with ``least`` training rows or more; the other rows go."""
    sums = leave_fold_sums(line_sums(df, [segment, fold], x, y), [segment], fold).filter(F.col("n") >= least)
    return line_predict(df, line_model(sums, [segment, fold]), [segment, fold], x)


def out_of_fold(df: DataFrame, test: DataFrame, inner: str, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold residuals of ``df``, and a prediction of each test row by each leave-fold-out model."""
    model = line_model(leave_fold_sums(line_sums(df, [inner], x, y), [], inner), [inner])
    residuals = line_predict(df, model, [inner], x).withColumn("residual", F.col(y) - F.col("y_pred"))
    return residuals, test.join(F.broadcast(model), F.lit(True)).withColumn("y_pred", F.col("intercept") + F.col("slope") * F.col(x)).drop("slope", "intercept")


def train_mean_predictor(df: DataFrame, by: list[str], fold: str, y: str) -> DataFrame:
    """Each row with the mean of the other folds' rows in its group."""
    sums = df.groupBy(*by, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    total = sums.groupBy(*by).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn")) if by else sums.agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    joined = sums.join(total, by) if by else sums.crossJoin(F.broadcast(total))
    model = joined.select(*by, fold, F.try_divide(F.col("_ts") - F.col("_s"), F.col("_tn") - F.col("_n")).alias("y_pred"))
    return df.join(model, [*by, fold])


def learning_curve(tasks: DataFrame, test: DataFrame, size: str, x: str, y: str) -> DataFrame:
    """(size, mae) on one test set of models fitted on growing subsets."""
    model = line_model(line_sums(tasks, [size], x, y), [size])
    return test.join(F.broadcast(model), F.lit(True)).groupBy(size).agg(F.avg(F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))).alias("mae"))


def fold_curves(tasks: DataFrame, df: DataFrame, key: str, by: list[str], x: str, y: str) -> DataFrame:
    """(by, method, n_train, mae) of a line and of the training mean, fitted on each task's training rows and scored on its test rows.

    ``tasks``: (by, key, role) as from ``splits.fold_curve_tasks``; ``df``: (key, x, y).
    """
    rows = tasks.join(df.select(key, x, y), key)
    sums = line_sums(rows.filter("role = 'train'"), by, x, y)
    line = line_model(sums, by).withColumn("method", F.lit("line"))
    mean = rows.filter("role = 'train'").groupBy(*by).agg(F.avg(y).alias("intercept")).withColumns({"slope": F.lit(0.0), "method": F.lit("mean")})
    both = line.select(*by, "method", "slope", "intercept").unionByName(mean.select(*by, "method", "slope", "intercept"))
    size = rows.groupBy(*by).agg(F.count(F.when(F.col("role") == "train", 1)).alias("n_train"))
    off = F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
    return rows.filter("role = 'test'").join(both, by).groupBy(*by, "method").agg(F.avg(off).alias("mae")).join(size, by).select(*by, "method", "n_train", "mae")


def paired_curve(curves: DataFrame, size: str, units: list[str], method: str, base: str, value: str) -> DataFrame:
    """(size, method, change, sd, better, n): differences from the base method on the same units (fold and draw), by size."""
    ref = curves.filter(F.col(method) == base).select(size, *units, F.col(value).alias("_base"))
    off = curves.filter(F.col(method) != base).join(ref, [size, *units]).withColumn("_d", F.col(value) - F.col("_base"))
    return off.groupBy(size, method).agg(F.avg("_d").alias("change"), F.stddev_samp("_d").alias("sd"), F.count(F.when(F.col("_d") < 0, 1)).alias("better"), F.count(F.lit(1)).alias("n"))


def exclusion_effect(full: DataFrame, audited: DataFrame, key: list[str], by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(by, n, mae_full, mae_audited, rmse_full, rmse_audited): predictions of models trained with and without suspect labels, both scored on the rows that both predict, against the labels of ``audited``."""
    both = audited.select(*key, *by, F.col(y).alias("_y"), F.col(p).alias("_b")).join(full.select(*key, *by, F.col(p).alias("_a")), [*key, *by])
    made = []
    for name, c in (("full", "_a"), ("audited", "_b")):
        gap = F.col("_y") - F.col(c)
        made += [F.avg(F.abs(gap)).alias(f"mae_{name}"), F.sqrt(F.avg(gap * gap)).alias(f"rmse_{name}")]
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *made).select(*by, "n", "mae_full", "mae_audited", "rmse_full", "rmse_audited")


def compare_additions(base: DataFrame, additions: dict[str, DataFrame], test: DataFrame, key: str, hard: Column, x: str, y: str, replicates: int, seed: int) -> DataFrame:
    """(arm, n_added, rmse, rmse_hard) of lines on the base rows alone and with each addition, on one test set; for additions also the
    changes against base, with bootstrap intervals over test rows that are paired: both arms have the same draws."""
    from .inference import paired_rmse_bootstrap

    tasks = base.select(F.lit("base").alias("arm"), x, y, F.lit(0).alias("_new"))
    for name, rows in additions.items():
        tasks = tasks.unionByName(base.select(F.lit(name).alias("arm"), x, y, F.lit(0).alias("_new"))).unionByName(rows.select(F.lit(name).alias("arm"), x, y, F.lit(1).alias("_new")))
    added = tasks.groupBy("arm").agg(F.sum("_new").alias("n_added"))
    every = line_predict(test.withColumn("_hard", F.coalesce(hard, F.lit(False))).crossJoin(F.broadcast(added.select("arm"))), line_model(line_sums(tasks, ["arm"], x, y), ["arm"]), ["arm"], x)
    squares = every.withColumn("_s", (F.col(y) - F.col("y_pred")) * (F.col(y) - F.col("y_pred")))
    out = squares.groupBy("arm").agg(F.sqrt(F.avg("_s")).alias("rmse"), F.sqrt(F.avg(F.when(F.col("_hard"), F.col("_s")))).alias("rmse_hard")).join(F.broadcast(added), "arm").select("arm", "n_added", "rmse", "rmse_hard")
    wide = squares.groupBy(key, "_hard").pivot("arm", ["base", *additions]).agg(F.first("_s"))
    changes = None
    for name in additions:
        units = wide.select(key, "_hard", F.col(f"`{name}`").alias("_a"), F.col("base").alias("_b"))
        named = lambda df, metric: paired_rmse_bootstrap(df, key, "_a", "_b", replicates, seed).toDF(f"{metric}_change", f"{metric}_low", f"{metric}_high")
        row = named(units, "rmse").crossJoin(named(units.filter("_hard"), "rmse_hard")).withColumn("arm", F.lit(name))
        changes = row if changes is None else changes.unionByName(row)
    return out if changes is None else out.join(changes, "arm", "left")


def bootstrap_lines(df: DataFrame, key: str, x: str, y: str, members: int, seed: int, fold: str | None = None) -> DataFrame:
    """(member, slope, intercept) on Poisson resamples of the rows."""
    rows = df.withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(members)))).withColumn("_w", poisson_one(uniform(seed, F.col("member"), key)))
    return line_model(line_sums(rows, ["member"], x, y, "_w"), ["member"])


def bootstrap_predict(df: DataFrame, models: DataFrame, key: str, x: str) -> DataFrame:
    """(key, y_pred, spread): members' mean and population deviation."""
    return df.join(F.broadcast(models), F.lit(True)).groupBy(key).agg(F.avg(F.col("intercept") + F.col("slope") * F.col(x)).alias("y_pred"), F.stddev_pop(F.col("intercept") + F.col("slope") * F.col(x)).alias("spread"))


def log_linear_rule(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """y against ln x on rows where both are known."""
    return df.filter(F.col(y).isNotNull() & (F.col(x) > 0)).groupBy(*by).agg(F.regr_slope(F.col(y), F.log(F.col(x))).alias("slope"), F.regr_intercept(F.col(y), F.log(F.col(x))).alias("intercept"))


# ---- many features ---------------------------------------------------------------------------------------------------


def _columns(features: list[str], y: str, shift: list[float]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") - F.lit(m) for c, m in zip([*features, y], shift)]]


def gram_by_fold(df: DataFrame, features: list[str], y: str, fold: str, shift: list[float] | None = None) -> DataFrame:
    """(fold, products): sums of all products of (1, features, y), one pass and a small row a fold. ``shift``: numbers near the columns'
    means, taken off first, so that large offsets do not cancel the digits that count."""
    columns = _columns(features, y, shift or [0.0] * (len(features) + 1))
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    return df.groupBy(fold).agg(F.array(*[F.sum(columns[i] * columns[j]) for i, j in pairs]).alias("products"))


def _square(flat, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for v, (i, j) in zip(flat, itertools.combinations_with_replacement(range(size), 2)):
        out[i, j] = out[j, i] = v
    return out


def solve_ridge(gram: np.ndarray, alpha: float, blocks: list[int] | None = None) -> np.ndarray:
    """(intercept, coefficients) from sums of products of (1, features, y); the penalty is on standardised features and target.

    ``blocks``: sizes of consecutive feature blocks that weigh the same in total: features are divided by the root of their block's number of varying
    ones, which multiplies their penalty by that number. Constant features have coefficient 0 and do not count.
    """
    n, d = gram[0, 0], len(gram) - 2
    mean = gram[0] / n
    cov = gram / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))[1 : d + 1]
    varies = sd > 1e-12
    safe = np.where(varies, sd, 1.0)
    corr = cov[1 : d + 1, 1 : d + 1] / np.outer(safe, safe)
    cuts = np.cumsum([0, *(blocks or [])])
    penalty = np.concatenate([np.full(b - a, max(1, int(varies[a:b].sum()))) for a, b in zip(cuts[:-1], cuts[1:])]) if blocks else np.ones(d)
    b = np.linalg.solve(corr + alpha / n * np.diag(penalty) + np.diag(~varies), np.where(varies, cov[1 : d + 1, -1] / safe, 0.0)) / safe
    return np.concatenate(([mean[-1] - b @ mean[1 : d + 1]], b))


def _ridge(df: DataFrame, features: list[str], y: str, fold: str, alphas: list[float], blocks: list[int] | None):
    """Errors of all penalties over the folds, rows with every penalty's prediction, and the model of all rows by penalty, with its shift."""
    size = len(features) + 2
    means = df.agg(*[F.avg(F.col(c).cast("double")) for c in [*features, y]]).first()
    shift = [float(m or 0.0) for m in means]
    grams = {r[0]: _square(r[1], size) for r in gram_by_fold(df, features, y, fold, shift).collect()}
    total = sum(grams.values())
    models = [(k, float(a), [float(v) for v in solve_ridge(total - g, a, blocks)]) for k, g in grams.items() for a in alphas]
    table = df.sparkSession.createDataFrame(models, f"`{fold}` {df.schema[fold].dataType.simpleString()}, alpha double, model array<double>")
    every = df.join(F.broadcast(table), fold).withColumn("y_pred", _linear([F.col("model")[i] for i in range(size - 1)], features, y, shift))
    errors = [(r[0], r[1]) for r in every.groupBy("alpha").agg(F.avg(F.abs(F.col(y) - F.col("y_pred"))).alias("mae")).orderBy("mae", "alpha").collect()]
    return errors, every, lambda alpha: (solve_ridge(total, alpha, blocks), shift)


def _linear(model: list[Column], features: list[str], y: str, shift: list[float]) -> Column:
    terms = _columns(features, y, shift)[1:-1]
    return model[0] + F.lit(shift[-1]) + sum((b * x for b, x in zip(model[1:], terms)), F.lit(0.0))


def ridge_cv(df: DataFrame, features: list[str], y: str, fold: str, alphas: list[float], blocks: list[int] | None = None) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Every row with the prediction of the best penalty's model of the other folds, and (alpha, mean absolute error) of all.

    The rows are read three times: for means, for the folds' product sums, which are (d + 2) squared numbers a fold, and for all errors at once.
    """
    errors, every, _ = _ridge(df, features, y, fold, alphas, blocks)
    return every.filter(F.col("alpha") == errors[0][0]).drop("model", "alpha"), errors


def ridge_refit(df: DataFrame, new: DataFrame, features: list[str], y: str, fold: str, alphas: list[float], blocks: list[int] | None = None) -> DataFrame:
    """``new`` with y_pred of the model of all rows of ``df``, at the penalty that is best over its folds."""
    errors, _, fitted = _ridge(df, features, y, fold, alphas, blocks)
    model, shift = fitted(errors[0][0])
    return new.withColumn("y_pred", _linear([F.lit(float(b)) for b in model], features, y, shift))


def concat_ridge(df: DataFrame, blocks: list[list[str]], y: str, fold: str, alphas: list[float]) -> DataFrame:
    """Ridge on feature blocks of equal total weight, scaled by each training fold's own moments."""
    return ridge_cv(df, [c for b in blocks for c in b], y, fold, alphas, [len(b) for b in blocks])[0]


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


def tree_predict(train: DataFrame, test: DataFrame, features: list[str], y: str, kind: str = "boosted", seed: int = 0, **options):
    """Test rows with y_pred of MLlib boosted trees or a random forest, and the fitted model."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    make = {"boosted": GBTRegressor, "forest": RandomForestRegressor}[kind]
    model = make(featuresCol="_features", labelCol=y, predictionCol="y_pred", seed=seed, **options).fit(_assembled(train, features))
    return model.transform(_assembled(test, features)).drop("_features"), model


def nested_cv(df: DataFrame, features: list[str], y: str, fold: str, grid: list[dict], kind: str = "boosted", seed: int = 0) -> DataFrame:
    """Each outer fold's test rows, predicted by trees whose options were tuned over all inner folds, inside the outer training folds only.

    A model without folds a and b judges options on b for outer fold a, and on a for outer fold b: it is fitted once. Ties: the first options.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    if len(grid) > 1 and len(folds) < 3:
        raise ValueError(f"{len(folds)} folds leave no rows to tune on; options need three")
    gap = F.abs(F.col(y) - F.col("y_pred"))
    sums = {(test, i): [0.0, 0] for test in folds for i in range(len(grid))}
    for a, b in itertools.combinations(folds, 2) if len(grid) > 1 else ():
        out = F.col(fold).isin(a, b)
        for i, options in enumerate(grid):
            judged = tree_predict(df.filter(~out), df.filter(out), features, y, kind, seed, **options)[0]
            for f, error, n in judged.groupBy(fold).agg(F.sum(gap), F.count(gap)).collect():
                total = sums[b if f == a else a, i]
                total[0], total[1] = total[0] + (error or 0.0), total[1] + n
    out = None
    for test in folds:
        means = [error / n if n else float("inf") for error, n in (sums[test, i] for i in range(len(grid)))]
        rows = tree_predict(df.filter(F.col(fold) != test), df.filter(F.col(fold) == test), features, y, kind, seed, **grid[means.index(min(means))])[0]
        out = rows if out is None else out.unionByName(rows)
    return out


def feature_importance(model, features: list[str], spark) -> DataFrame:
    return spark.createDataFrame(sorted(((f, float(v)) for f, v in zip(features, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0])), "feature string, importance double")


def success_probability(train: DataFrame, df: DataFrame, features: list[str], label: str) -> DataFrame:
    """P(label = 1) by logistic regression on recorded outcomes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    model = LogisticRegression(featuresCol="_features", labelCol=label, regParam=0.01).fit(_assembled(train, features))
    scored = model.transform(_assembled(df, features))
    return scored.withColumn("p_success", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def pick_layer(selection: DataFrame, task: list[str], layer: str, alpha: str, metric: str) -> DataFrame:
    """The (layer, alpha) of least metric in each task."""
    return selection.withColumn("_n", F.row_number().over(Window.partitionBy(*task).orderBy(metric, layer, alpha))).filter("_n = 1").drop("_n")


def refit_fallback(candidates: DataFrame, task: list[str], rank: str, score: str) -> DataFrame:
    """The first candidate with a finite score in each task, and how many before it failed."""
    usable = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < float("inf"))
    ranked = candidates.withColumn("_bad", F.sum((~usable).cast("long")).over(Window.partitionBy(*task).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter(usable).withColumn("_n", F.row_number().over(Window.partitionBy(*task).orderBy(rank))).filter("_n = 1").drop("_n").withColumnRenamed("_bad", "fallbacks")


# ---- stacking --------------------------------------------------------------------------------------------------------


def stack_pair_weight(df: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """(by, weight): weight of ``a`` in the blend w a + (1 - w) b of least squared error, within 0 and 1."""
    gap = F.col(a) - F.col(b)
    raw = F.try_divide(F.sum((F.col(y) - F.col(b)) * gap), F.sum(gap * gap))
    return df.groupBy(*by).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(raw, F.lit(0.5)))).alias("weight"))


def stack_pair_weight_absolute(df: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """(by, weight): weight of ``a`` in the blend w a + (1 - w) b of least absolute error, within 0 and 1; exact.

    The error is a sum of |a - b| |w - t| with t = (y - b) / (a - b): its least is at the weighted median of t (the lower one, if a whole stretch is least), and within the
    bounds the nearest end. Rows that lack a value, or on which both members agree, have no say; a group without others has weight 0.5.
    """
    gap = F.col(a) - F.col(b)
    of = [f"_g{i}" for i in range(len(by))]
    groups = [F.col(c).alias(g) for c, g in zip(by, of)]
    rows = df.select(*groups, F.when(gap != 0, F.try_divide(F.col(y) - F.col(b), gap)).alias("_t"), F.abs(gap).alias("_a"))
    known = rows.filter(F.col("_t").isNotNull())
    half = F.col("_before") + F.col("_a") >= F.col("_total") / 2
    middle = ranked(known, of, ["_t"], F.col("_a")).filter(half).groupBy(*of).agg(F.min("_t").alias("_t"))
    every = null_safe_join(rows.select(*of).distinct(), middle, of, "left") if of else rows.agg(F.count(F.lit(1)).alias("_n")).join(middle, F.lit(True), "left")
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("_t", F.lit(0.5))))
    return every.select(*[F.col(g).alias(c) for c, g in zip(by, of)], weight.alias("weight"))


def stack_weights_absolute(df: DataFrame, y: str, members: list[str], steps: int = 60, tolerance: float = 1e-7) -> tuple[dict[str, float], float, float]:
    """Non-negative weights summing to 1 of least mean absolute error for any number of members, that error, and how far it can be above the least at most.

    Each step is one aggregate: rows count by one over their error, at least a bound that falls from step to step, and the weighted products give the next weights. The same sums give a bound
    from below: for any numbers s within -1 and 1, sum(s y) less the greatest sum(s member) is at most the least error; here s is an error over its bound. It ends when error and bound
    differ by ``tolerance`` of the error, or after ``steps``. Rows that lack a value are left out; without rows the weights are equal.
    """
    n = len(members)
    rows = settled(df.select(*[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(members)], F.col(y).cast("double").alias("y")).dropna(), "stack-rows")
    columns = [F.col(f"m{i}") for i in range(n)]
    pairs = list(itertools.combinations_with_replacement(range(n + 1), 2))
    weights = best = np.full(n, 1 / n)
    error, lower, bound = np.inf, -np.inf, None
    for _ in range(steps):
        off = F.col("y") - sum((c * float(w) for c, w in zip(columns[1:], weights[1:])), columns[0] * float(weights[0]))
        if bound is None:
            bound = rows.agg(F.avg(F.abs(off))).first()[0] or 0.0
        own = 1.0 / F.greatest(F.abs(off), F.lit(max(bound, 1e-12)))
        values = [*columns, F.col("y")]
        sums = rows.agg(F.count(F.lit(1)), F.sum(F.abs(off)), *[F.sum(off * own * v) for v in values], *[F.sum(own * values[i] * values[j]) for i, j in pairs]).first()
        if not sums[0]:
            return dict(zip(members, best.tolist())), 0.0, 0.0
        now = sums[1] / sums[0]
        if now < error:
            error, best = now, weights
        lower = max(lower, (sums[2 + n] - max(sums[2 : 2 + n])) / sums[0], 0.0)
        if error - lower <= tolerance * max(error, 1e-12):
            break
        gram = _square(sums[3 + n :], n + 1)
        scale = max(float(np.abs(gram).max()), 1e-300)
        weights = simplex_least_squares(gram[:n, :n] / scale, gram[:n, n] / scale)
        bound = bound * 0.4
    return dict(zip(members, best.tolist())), float(error), float(error - lower)


def stack_predict(oof: DataFrame, test: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    return test.join(stack_pair_weight(oof, by, y, a, b), by).withColumn("y_pred", F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b))


def simplex_least_squares(gram: np.ndarray, target: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Non-negative weights summing to 1 of least w'Gw - 2 t'w, by enumeration of supports for few members, else projected gradient."""
    k = len(target)
    best, least = np.full(k, 1 / k), np.inf
    if k <= 12:
        for size in range(1, k + 1):
            for support in itertools.combinations(range(k), size):
                s = list(support)
                system = np.block([[gram[np.ix_(s, s)] + 1e-12 * np.eye(size), np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
                w = np.linalg.lstsq(system, np.append(target[s], 1.0), rcond=None)[0][:size]
                if (w >= -1e-10).all():
                    full = np.zeros(k)
                    full[s] = np.maximum(w, 0)
                    value = full @ gram @ full - 2 * target @ full
                    if value < least - 1e-12:
                        best, least = full / full.sum(), value
        return best
    step = 1 / max(1e-12, 2 * np.linalg.eigvalsh(gram)[-1])
    for _ in range(steps):
        moved = best - step * 2 * (gram @ best - target)
        ordered = np.sort(moved)[::-1]
        shift = (np.cumsum(ordered) - 1) / np.arange(1, k + 1)
        best = np.maximum(moved - shift[np.flatnonzero(ordered > shift)[-1]], 0)
    return best


def stack_weights(df: DataFrame, y: str, members: list[str]) -> dict[str, float]:
    """Blend weights of any number of members from one pass for their Gram matrix."""
    columns = [F.col(c).cast("double") for c in [*members, y]]
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    full = _square(df.agg(*[F.sum(columns[i] * columns[j]) for i, j in pairs]).first(), len(columns))
    return dict(zip(members, simplex_least_squares(full[:-1, :-1], full[:-1, -1]).tolist()))
