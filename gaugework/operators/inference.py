"""Whether a difference is real."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import student_two_sided, t_975
from ..session import settled
from .ranks import average_ranks, null_safe_join
from .splits import bootstrap_weights


def corrected_t(diffs: DataFrame, by: list[str], diff: str, n_train: str, n_test: str) -> DataFrame:
    """(by, estimate, se, t, df, p): resampled t-test whose variance counts the overlap of training sets."""
    n = F.count(diff)
    out = diffs.groupBy(*by).agg(F.avg(diff).alias("estimate"), F.sqrt((1 / n + F.max(F.col(n_test) / F.col(n_train))) * F.var_samp(diff)).alias("se"), (n - 1).alias("df"))
    t = F.when(F.col("se") > 0, F.col("estimate") / F.col("se")).when(F.col("estimate") == 0, 0.0).otherwise(F.signum("estimate") * float("inf"))
    p = F.when(F.abs(F.col("t")) == float("inf"), 0.0).otherwise(student_two_sided(F.col("t"), F.col("df").cast("double")))
    return out.withColumn("t", t).withColumn("p", p)


def stratified_bootstrap(units: DataFrame, unit: str, stratum: str, diff: str, replicates: int, seed: int, by: list[str] = ()) -> DataFrame:
    """(by, estimate, low, high, p, per_stratum): mean over strata of mean differences; percentile interval; two-sided p; a map of each stratum's mean (a null
    stratum is called 'null'). ``by``: families of comparisons, such as regimes with their own strata, each with its own row."""
    known = units.filter(F.col(diff).isNotNull())
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("null"))
    strata = known.groupBy(*by, name.alias("_name")).agg(F.avg(diff).alias("_m"))
    estimate = strata.groupBy(*by).agg(F.avg("_m").alias("estimate"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_m")))).alias("per_stratum"))
    draws = bootstrap_weights(known.select(*by, unit, name.alias("_name"), diff), unit, replicates, seed)
    one = draws.groupBy(*by, "replicate", "_name").agg((F.sum(F.col("weight") * F.col(diff)) / F.sum("weight")).alias("_m")).groupBy(*by, "replicate").agg(F.avg("_m").alias("_m"))
    # replicates are a parameter: a group holds as many numbers
    both = one.groupBy(*by).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"), F.avg((F.col("_m") <= 0).cast("double")).alias("_low"), F.avg((F.col("_m") >= 0).cast("double")).alias("_high"))
    met = null_safe_join(estimate, both, list(by))
    return met.select(*by, "estimate", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), F.least(F.lit(1.0), 2 * F.least("_low", "_high")).alias("p"), "per_stratum")


def group_bootstrap(errors: DataFrame, by: list[str], method: str, group: str, error: str, reference: str, replicates: int, seed: int) -> DataFrame:
    """(by, method, mae, low, high, diff, diff_low, diff_high): whole groups are drawn, the same for all methods. Rows are summed to groups first."""
    sums = errors.groupBy(*by, method, group).agg(F.sum(error).alias("_s"), F.count(error).alias("_n"))
    draws = bootstrap_weights(errors.select(group).distinct(), group, replicates, seed)
    est = lambda keys, df, w: df.groupBy(*keys).agg((F.sum(w * F.col("_s")) / F.sum(w * F.col("_n"))).alias("_m"))
    whole = est([*by, method], sums, F.lit(1))
    reps = est(["replicate", *by, method], sums.join(draws, group), F.col("weight"))

    def against(df: DataFrame, keys: list[str]) -> DataFrame:
        ref = df.filter(F.col(method) == reference).select(*keys, F.col("_m").alias("_r"))
        joined = df.join(ref, keys) if keys else df.crossJoin(F.broadcast(ref))
        return joined.withColumn("_d", F.col("_m") - F.col("_r"))

    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    bands = against(reps, ["replicate", *by]).groupBy(*by, method).agg(q("_m").alias("_q"), q("_d").alias("_e"))
    return against(whole, by).join(bands, [*by, method]).select(*by, method, F.col("_m").alias("mae"), F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), F.col("_d").alias("diff"), F.col("_e")[0].alias("diff_low"), F.col("_e")[1].alias("diff_high"))


def holm(rows: DataFrame, family: list[str], name: str, p: str, out: str = "p_holm") -> DataFrame:
    w = Window.partitionBy(*family).orderBy(p, name)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    scaled = rows.withColumn("_scaled", (m - F.row_number().over(w) + 1) * F.col(p))
    return scaled.withColumn(out, F.least(F.lit(1.0), F.max("_scaled").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_scaled")


def finding(p: Column, estimate: Column, alpha: float, least: float) -> Column:
    return (p < alpha) & (F.abs(estimate) >= least)


def confirmatory_table(rows: DataFrame, name: str, p: str, estimate: str, bootstrap: str, replicates: int, alpha: float, least: float) -> DataFrame:
    """Bootstrap p values have a floor of 2 / B; then Holm over the family, and the finding rule."""
    used = rows.withColumn("p_used", F.when(F.col(bootstrap), F.greatest(F.col(p), F.lit(2.0 / replicates))).otherwise(F.col(p)))
    return holm(used, [], name, "p_used").withColumn("finding", finding(F.col("p_holm"), F.col(estimate), alpha, least))


def spearman(df: DataFrame, by: list[str], a: str, b: str, least: int = 10) -> DataFrame:
    """(by, n, rho): correlation of average ranks, in groups of ``least`` rows or more; null if a score does not vary. Rows that lack a score are left out."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(a).alias("_x"), F.col(b).alias("_y"))
    rows = settled(rows, "score-pairs")
    of = [f"_g{i}" for i in range(len(by))]
    both = null_safe_join(rows, average_ranks(rows, of, "_x").withColumnRenamed("rank", "_a"), [*of, "_x"])
    both = null_safe_join(both, average_ranks(rows, of, "_y").withColumnRenamed("rank", "_b"), [*of, "_y"])
    out = both.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")).alias("rho")).filter(F.col("n") >= least)
    return out.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(by)], "n", "rho")


def paired_contrasts(diffs: DataFrame, by: list[str], diff: str, n_train: str, n_test: str, least: float) -> DataFrame:
    """Corrected t with interval, folds below 0 and whether the size counts."""
    t = corrected_t(diffs, by, diff, n_train, n_test)
    better = diffs.groupBy(*by).agg(F.sum((F.col(diff) < 0).cast("long")).alias("folds_better"), F.count(diff).alias("folds"))
    half = F.col("se") * t_975(F.col("df"))
    return t.join(better, by).withColumns({"low": F.col("estimate") - half, "high": F.col("estimate") + half, "large": F.abs(F.col("estimate")) >= least})


def min_detectable(contrasts: DataFrame) -> DataFrame:
    return contrasts.withColumn("min_detectable", F.col("se") * t_975(F.col("df")))


def paired_regime_tests(metrics: DataFrame, regime: str, fold: str, method: str, a: str, b: str, value: str, n_train: str, n_test: str) -> DataFrame:
    """One corrected t-test a regime on paired folds."""
    one = metrics.filter(F.col(method) == a).select(regime, fold, n_train, n_test, F.col(value).alias("_a"))
    two = metrics.filter(F.col(method) == b).select(regime, fold, F.col(value).alias("_b"))
    return corrected_t(one.join(two, [regime, fold]).withColumn("_d", F.col("_a") - F.col("_b")), [regime], "_d", n_train, n_test)


def paired_rmse_bootstrap(units: DataFrame, unit: str, square_a: str, square_b: str, replicates: int, seed: int) -> DataFrame:
    """(change, low, high) of an RMSE on the same resampled units."""
    gap = lambda w: F.sqrt(F.sum(w * F.col(square_a)) / F.sum(w)) - F.sqrt(F.sum(w * F.col(square_b)) / F.sum(w))
    draws = bootstrap_weights(units.select(unit, square_a, square_b), unit, replicates, seed).groupBy("replicate").agg(gap(F.col("weight")).alias("_g"))
    q = draws.agg(F.percentile("_g", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return units.agg(gap(F.lit(1)).alias("change")).crossJoin(q).select("change", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def sliced_errors(errors: DataFrame, attributes: list[str], method: str, group: str, error: str, reference: str, replicates: int, seed: int, pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """The group bootstrap for every value of every attribute, and of every pair in ``pairs`` ('a x b', with values 'u x v')."""
    text = lambda c: F.col(c).cast("string")
    named = [(a, text(a)) for a in attributes] + [(f"{a} x {b}", F.concat(text(a), F.lit(" x "), text(b))) for a, b in pairs]
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), v.alias("value")) for a, v in named])
    long = errors.select(method, group, error, F.explode(cells).alias("x")).select(method, group, error, "x.*").filter("value is not null")
    return group_bootstrap(long, ["attribute", "value"], method, group, error, reference, replicates, seed)
