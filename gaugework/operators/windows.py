"""Order, ranks and curves, and operations on sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import cosine_distance
from .ranks import null_safe_join, order_statistics, quantiles, ranked

SO_FAR = (Window.unboundedPreceding, 0)


def hit_curve(log: DataFrame, by: list[str], order: list[str], hit: str, every: int) -> DataFrame:
    """(by, step, hits) at each ``every``-th step and the last. A null hit is none; nulls in ``order`` come last."""
    own = F.col(hit).cast("long")
    steps = ranked(log.select(*by, *order, own.alias("_hit")), by, order, F.col("_hit"))
    at = (F.col("_r") % every == 0) | (F.col("_r") == F.col("_n"))
    return steps.filter(at).select(*by, F.col("_r").cast("long").alias("step"), (F.col("_before") + F.coalesce("_hit", F.lit(0))).alias("hits"))


def first_to_reach(log: DataFrame, strategy: str, seed: str, step: str, hits: str, targets: list[int]) -> DataFrame:
    """(strategy, target, mean_steps, reached): the mean only where every seed got there; ``reached`` as 'k/n'."""
    per = log.groupBy(strategy, seed).agg(*[F.min(F.when(F.col(hits) >= t, F.col(step))).alias(f"_{t}") for t in targets])
    rows = per.select(strategy, F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_{t}").alias("at")) for t in targets])).alias("x")).select(strategy, "x.*")
    return rows.groupBy(strategy, "target").agg(F.when(F.count("at") == F.count(F.lit(1)), F.avg("at")).alias("mean_steps"), F.concat(F.count("at").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("reached"))


def labels_to_match(curves: DataFrame, strategy: str, size: str, value: str, reference: str) -> DataFrame:
    """(strategy, budget, needed): labels with which a strategy gets as low as the reference does with the budget, by linear interpolation between two points."""
    mean = curves.groupBy(strategy, size).agg(F.avg(value).alias("_v"))
    ref = mean.filter(F.col(strategy) == reference).select(F.col(size).alias("budget"), F.col("_v").alias("_goal"))
    w = Window.partitionBy(strategy).orderBy(size)
    steps = mean.withColumns({"_pv": F.lag("_v").over(w), "_ps": F.lag(size).over(w)})
    hit = steps.join(F.broadcast(ref), F.col("_v") <= F.col("_goal"))
    first = hit.withColumn("_n", F.row_number().over(Window.partitionBy(strategy, "budget").orderBy(size))).filter("_n = 1")
    between = F.col("_ps") + (F.col("_pv") - F.col("_goal")) / (F.col("_pv") - F.col("_v")) * (F.col(size) - F.col("_ps"))
    needed = F.when(F.col("_ps").isNull(), F.col(size).cast("double")).otherwise(between)
    every = mean.select(strategy).distinct().join(F.broadcast(ref), F.lit(True)).select(strategy, "budget")
    return every.join(first.select(strategy, "budget", needed.alias("needed")), [strategy, "budget"], "left")


def retention_curve(df: DataFrame, by: list[str], score: str, error: str, key: str, fractions: list[float]) -> DataFrame:
    """(by, fraction, n, mae) over the rows of lowest score: a share of them, one at least, halves to even. Rows without a score are left out."""
    known = df.filter(F.col(score).isNotNull()).select(*by, F.col(score).alias("_s"), F.col(key).alias("_k"), F.col(error).alias("_e"))
    rows = ranked(known, by, ["_s", "_k"])
    cells = rows.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    inside = cells.filter(F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("fraction") * F.col("_n"))))
    return inside.groupBy(*by, "fraction").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("_e")).alias("mae"))


def step_distance(df: DataFrame, by: list[str], order: str, vector: str) -> DataFrame:
    """Cosine distances of each row to the one before and to the first."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.select(*by, order, cosine_distance(F.lag(vector).over(w), F.col(vector)).alias("from_last"), cosine_distance(F.first(vector).over(w), F.col(vector)).alias("from_first"))


def step_summary(steps: DataFrame, by: list[str], order: str, cut: float, still: float = 1e-9) -> DataFrame:
    """(by, n, rho, median_upto, median_beyond, share_unchanged) of the rows of ``step_distance``: rank correlation of the order with the distance from the first,
    median steps up to the cut and beyond, and the share of those beyond that do not move. The first row has no step."""
    from .inference import spearman

    known = steps.filter(F.col("from_last").isNotNull()).withColumn("_far", F.col(order) > cut)
    beyond = F.col("_far")
    n = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    moved = known.groupBy(*by).agg(F.avg(F.when(beyond, (F.col("from_last") < still).cast("double"))).alias("share_unchanged"))
    middle = quantiles(known, [*by, "_far"], "from_last", [0.5])
    sides = middle.groupBy(*by).agg(*[F.max(F.when(F.col("_far") == far, F.col("q")[0])).alias(name) for name, far in (("median_upto", False), ("median_beyond", True))])
    rho = spearman(steps, by, order, "from_first", least=2).select(*by, "rho")
    out = n
    for part in (rho, sides, moved):
        out = null_safe_join(out, part, by, "left")
    return out.select(*by, "n", "rho", "median_upto", "median_beyond", "share_unchanged")


def top_k_by_abs(df: DataFrame, value: Column, k: int, key: str) -> DataFrame:
    return df.withColumn("size", F.abs(value)).orderBy(F.desc("size"), key).limit(k)


def order_stat(df: DataFrame, by: list[str], value: str, rank: Column) -> DataFrame:
    """(by, stat, n): the value of a rank (an expression of ``n``, the group's known values); infinite beyond them or under 1. Nulls are left out."""
    stats = order_statistics(df, by, value, lambda n: F.array(rank.cast("long")))
    return stats.select(*by, F.coalesce(F.col("at")[rank.cast("long")].cast("double"), F.lit(float("inf"))).alias("stat"), "n")


def rank_in_round(df: DataFrame, round_: str, order: list[str], out: str = "rank_in_round") -> DataFrame:
    """Place of each row in its round; '-' before a number's name is descending, nulls come last."""
    return ranked(df, [round_], order).select(*df.columns, F.col("_r").cast("int").alias(out))


def stage_rates(log: DataFrame, stage: str, hit: str, distance: str) -> DataFrame:
    known = log.filter(F.col(stage).isNotNull())
    rates = known.groupBy(stage).agg(F.avg(F.col(hit).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    middle = quantiles(known, [stage], distance, [0.5]).select(stage, F.col("q")[0].alias("median_distance"))
    return rates.join(middle, stage, "left").select(stage, "rate", "median_distance", "n")


def wins(final: DataFrame, seed: str, method: str, value: str, best: str) -> DataFrame:
    """(method, wins, seeds, ratio): in how many seeds ``best`` is above each other method, and its mean over theirs."""
    a = final.filter(F.col(method) == best).select(seed, F.col(value).alias("_a"))
    return final.filter(F.col(method) != best).join(a, seed).groupBy(method).agg(F.sum((F.col("_a") > F.col(value)).cast("long")).alias("wins"), F.count(F.lit(1)).alias("seeds"), (F.avg("_a") / F.avg(value)).alias("ratio"))


def best_k_mean(log: DataFrame, by: list[str], value: str, order: str, k: int = 3) -> DataFrame:
    rows = log.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value, order))).filter(F.col("_r") <= k)
    return rows.groupBy(*by).agg(F.avg(value).alias("best_mean"))


def early_stop_point(log: DataFrame, by: list[str], epoch: str, value: str, patience: int) -> DataFrame:
    """(by, best_epoch, stop_epoch): where ``patience`` epochs have passed without strict improvement, and the best one up to there; else the last."""
    w = Window.partitionBy(*by).orderBy(epoch)
    low = log.withColumns({"_before": F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_r": F.row_number().over(w)})
    better = F.col("_before").isNull() | (F.col(value) < F.col("_before"))
    marks = low.withColumn("_better", F.when(better, F.col("_r"))).withColumn("_last", F.max("_better").over(w.rowsBetween(*SO_FAR)))
    stop = marks.groupBy(*by).agg(F.min(F.when(F.col("_r") - F.col("_last") >= patience, F.col("_r"))).alias("_stop"), F.max("_r").alias("_end"))
    inside = marks.join(stop, by).filter(F.col("_r") <= F.coalesce("_stop", "_end"))
    return inside.groupBy(*by).agg(F.max_by(epoch, F.col("_better")).alias("best_epoch"), F.max(epoch).alias("stop_epoch"))


def curve_band(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def stable_sort(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*order)


def concat(*tables: DataFrame) -> DataFrame:
    """Tables end to end by name; a column that one lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_semi")


def distinct_first(df: DataFrame, key: list[str], order: str, mark_only: bool = False) -> DataFrame:
    """The first row of each key; or all rows with ``is_repeat``."""
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return rows.withColumn("is_repeat", F.col("_r") > 1).drop("_r") if mark_only else rows.filter("_r = 1").drop("_r")
