"""Error metrics and summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import null_safe_join, quantiles, ranked

N = F.count


def _error(y: str, p: str) -> Column:
    return F.col(y) - F.col(p)


def fold_metrics(pred: DataFrame, by: list[str], mask: Column | None = None, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(by, n, mae, rmse, r2, rmse_masked): r2 is against the group's own mean; null where it does not vary."""
    square = _error(y, p) * _error(y, p)
    masked = F.sqrt(F.avg(F.when(mask, square))) if mask is not None else F.lit(None).cast("double")
    spread = F.var_pop(y) * F.count(F.lit(1))
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(_error(y, p))).alias("mae"), F.sqrt(F.avg(square)).alias("rmse"),
        F.when(spread > 0, 1 - F.sum(square) / spread).alias("r2"), masked.alias("rmse_masked"),
    )


def error_table(pred: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return fold_metrics(pred, by, None, y, p).select(*by, "n", "mae", "rmse")


def nested_mean(df: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """Means of means, from the finest keys to the coarsest."""
    for keys in levels:
        df = df.groupBy(*keys).agg(F.avg(value).alias(value))
    return df


def summarise(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("size"))


def macro_average(df: DataFrame, by: list[str], stratum: str, value: str) -> DataFrame:
    """Every stratum counts the same."""
    return nested_mean(df, [[*by, stratum], by], value)


def coverage_table(intervals: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(keys, group, n, coverage, width) by group, and over all groups as 'all'; one pass over the rows."""
    hit = F.col("y_true").between(F.col("lower"), F.col("upper")).cast("double")
    fine = intervals.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("_hits"), F.sum(F.col("upper") - F.col("lower")).alias("_width"))
    whole = fine.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("_hits").alias("_hits"), F.sum("_width").alias("_width")).withColumn(group, F.lit("all"))
    both = fine.withColumn(group, F.col(group).cast("string")).unionByName(whole)
    return both.select(*keys, group, "n", (F.col("_hits") / F.col("n")).alias("coverage"), (F.col("_width") / F.col("n")).alias("width"))


def group_spread(df: DataFrame, key: list[str], value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), (F.max(value) - F.min(value)).alias("spread"))


def spread_summary(df: DataFrame, key: list[str], value: str, bound: float) -> DataFrame:
    """Groups of more than one row, and how many of them spread beyond the bound."""
    return group_spread(df, key, value).filter("size > 1").agg(F.count(F.lit(1)).alias("groups"), F.sum((F.col("spread") > bound).cast("long")).alias("wide"))


def winner(df: DataFrame, by: list[str], metric: str, name: str) -> DataFrame:
    """The row of least metric in each group; of equals the first name."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(metric, name))).filter("_n = 1").drop("_n")


def best_recipe(metrics: DataFrame, recipe: list[str], value: str, also: str) -> DataFrame:
    """One row: the recipe of least mean ``value`` over its folds, that mean, and as ``also_<column>`` the recipe that would win by ``also``; of equals the first by name."""
    means = metrics.groupBy(*recipe).agg(F.avg(value).alias("_v"), F.avg(also).alias("_a"))
    first = lambda m: F.min_by(F.struct(*recipe), F.struct(F.col(m).isNull(), m, *recipe))
    one = means.agg(first("_v").alias("x"), F.min("_v").alias(value), first("_a").alias("y"))
    return one.select(*[F.col("x")[c].alias(c) for c in recipe], value, *[F.col("y")[c].alias(f"also_{c}") for c in recipe])


def merge_evidence(rows: DataFrame, key: str, order: str, category: str = "category", evidence: str = "evidence", exclude: str = "exclude") -> DataFrame:
    """One row a key: excluded if any row is; distinct categories and evidence in order of appearance. Repeated values are one before a key's values meet; nulls are left out."""
    kinds = F.array(*[F.struct(F.lit(i).alias("_kind"), F.col(c).cast("string").alias("_value")) for i, c in enumerate((category, evidence))])
    each = rows.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(exclude).alias("_out"), F.explode(kinds).alias("x")).groupBy("_key", "x").agg(F.min("_order").alias("_order"), F.max("_out").alias("_out"))

    def joined(kind: int) -> Column:
        found = F.collect_list(F.when((F.col("x._kind") == kind) & F.col("x._value").isNotNull(), F.struct("_order", "x._value")))
        return F.array_join(F.transform(F.array_sort(found), lambda v: v["_value"]), "; ")

    return each.groupBy(F.col("_key").alias(key)).agg(F.max("_out").alias(exclude), joined(0).alias(category), joined(1).alias(evidence))


def value_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def value_count_maps(df: DataFrame, by: str, value: str) -> DataFrame:
    """A map of value to count for each group."""
    return value_counts(df, [by, value]).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def hit_summary(log: DataFrame, by: str, order: str, hit: str, k: int) -> DataFrame:
    """(by, lookups, hits, rate, kth): ``kth`` is the step of the k-th hit. A null hit counts as a lookup, in no rate."""
    steps = ranked(log.select(by, order, F.col(hit).cast("long").alias("_h")), [by], [order], F.col("_h"))
    kth = F.min(F.when(F.col("_before") + F.coalesce("_h", F.lit(0)) >= k, F.col("_r"))).cast("long")
    return steps.groupBy(by).agg(F.count(F.lit(1)).alias("lookups"), F.sum("_h").alias("hits"), F.avg("_h").alias("rate"), kth.alias("kth"))


def pivot_wide(df: DataFrame, index: list[str], column: str, levels: list[str], value: str, complete: bool = True) -> DataFrame:
    """One column a level; with ``complete``, a missing cell raises."""
    wide = df.groupBy(*index).pivot(column, levels).agg(F.first(value))
    if not complete:
        return wide
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"no value for {c}")).cast("double")).otherwise(F.col(c)).alias(c)
    return wide.select(*index, *[need(c) for c in levels])


def paired_change(metrics: DataFrame, fold: list[str], method: str, base: str, value: str) -> DataFrame:
    """(method, change, sd, folds_better, folds) against the base on the same folds."""
    b = metrics.filter(F.col(method) == base).select(*fold, F.col(value).alias("_base"))
    d = metrics.filter(F.col(method) != base).join(b, fold).withColumn("_d", F.col(value) - F.col("_base"))
    return d.groupBy(method).agg(F.avg("_d").alias("change"), F.stddev_samp("_d").alias("sd"), F.sum((F.col("_d") < 0).cast("long")).alias("folds_better"), F.count(F.lit(1)).alias("folds"))


def noise_summary(df: DataFrame, label: str, reference: str) -> DataFrame:
    """(mean, median, q90, largest, within_1) of the absolute differences; nulls are left out."""
    gaps = df.select(F.abs(F.col(label) - F.col(reference)).alias("_gap"))
    q = quantiles(gaps, [], "_gap", [0.5, 0.9])
    one = gaps.agg(F.avg("_gap").alias("mean"), F.max("_gap").alias("largest"), F.avg((F.col("_gap") <= 1).cast("double")).alias("within_1"))
    return one.join(q, F.lit(True), "left").select("mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("q90"), "largest", "within_1")


def scaled_mad(df: DataFrame, key: str, value: str, least: int = 3) -> DataFrame:
    """(key, mad): 1.4826 times the median absolute deviation of keys with ``least`` values or more."""
    middle = quantiles(df, [key], value, [0.5]).filter(F.col("n") >= least).select(key, F.col("q")[0].alias("_m"))
    off = null_safe_join(df, middle, [key]).select(key, F.abs(F.col(value) - F.col("_m")).alias("_off"))
    return quantiles(off, [key], "_off", [0.5]).select(key, (1.4826 * F.col("q")[0]).alias("mad"))


def distance_bands(df: DataFrame, value: str, bands: list[tuple[float, float]], background: tuple[float, float]) -> DataFrame:
    """(low, high, n, expected): rows in each band, and how many the background's density would put there."""
    inside = lambda a, b: F.sum(((F.col(value) >= a) & (F.col(value) < b)).cast("long"))
    density = inside(*background) / (background[1] - background[0])
    items = [F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), inside(a, b).alias("n"), (density * (b - a)).alias("expected")) for a, b in bands]
    return df.agg(F.array(*items).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def bias_by_bin(df: DataFrame, bin_: str, error: str) -> DataFrame:
    known = df.filter(F.col(bin_).isNotNull())
    one = known.groupBy(bin_).agg(F.count(F.lit(1)).alias("size"), F.avg(F.abs(F.col(error))).alias("mae"))
    middle = quantiles(known, [bin_], error, [0.5]).select(bin_, F.col("q")[0].alias("median_bias"))
    return one.join(middle, bin_, "left").select(bin_, "size", "median_bias", "mae")


def tail_report(pred: DataFrame, train: DataFrame, task: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(task, band, n, outside, mae, share): errors below, within and above the training labels' 2 % and 98 % quantiles, and their share of the task's
    error; ``outside`` counts a band's rows beyond the least or greatest training label. Tasks without training labels are left out."""
    edges = quantiles(train, [task], y, [0.0, 0.02, 0.98, 1.0]).select(task, "q")
    lowest, low, high, highest = (F.col("q")[i] for i in range(4))
    band = F.when(F.col(y) < low, "low").when(F.col(y) > high, "high").otherwise("middle")
    beyond = (F.col(y) < lowest) | (F.col(y) > highest)
    by = null_safe_join(pred, edges, [task]).groupBy(task, band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(beyond, 1)).alias("outside"), F.sum(F.abs(_error(y, p))).alias("_sum"))
    share = F.col("_sum") / F.sum("_sum").over(Window.partitionBy(task))  # three rows a task
    return by.withColumn("share", share).select(task, "band", "n", "outside", (F.col("_sum") / F.col("n")).alias("mae"), "share")


def same_keys_check(pred: DataFrame, task: str, method: str, key: str) -> DataFrame:
    """Tasks whose methods were scored on different keys: by number of rows and a sum of key digests."""
    mark = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    one = pred.groupBy(task, method).agg(F.count(F.lit(1)).alias("_n"), F.sum(mark).alias("_s"))
    return one.groupBy(task).agg(F.count_distinct("_n", "_s").alias("versions"), F.count(F.lit(1)).alias("methods"))


def fold_partition_check(folds: DataFrame, by: list[str], key: str, every: DataFrame) -> DataFrame:
    """(by, keys, repeated, missing, foreign): whether the test folds of each ``by`` hold every key once. Counts of keys: different ones, those in several rows, those
    of ``every`` that no fold has, and those that are not in ``every``. The folds partition the keys where the last three are 0."""
    wanted = every.select(key).distinct().withColumn("_wanted", F.lit(True))
    each = folds.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    met = null_safe_join(each, wanted, [key], "left")
    known = F.count(F.when(F.col("_wanted"), 1))
    sums = met.groupBy(*by).agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(F.col("_n") > 1, 1)).alias("repeated"), known.alias("_known"))
    total = wanted.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return sums.crossJoin(total).select(*by, "keys", "repeated", (F.col("_total") - F.col("_known")).alias("missing"), (F.col("keys") - F.col("_known")).alias("foreign"))


def params_tally(df: DataFrame, params: str, by: list[str] = ()) -> DataFrame:
    """How often each value of each JSON parameter was chosen."""
    parsed = df.select(*by, F.explode(F.from_json(params, "map<string,string>")).alias("parameter", "value"))
    return parsed.groupBy(*by, "parameter", "value").agg(F.count(F.lit(1)).alias("n"))


def weights_summary(weights: DataFrame, by: str, weight: str) -> DataFrame:
    return weights.groupBy(by).agg(F.format_string("%.3f [%.3f to %.3f]", F.avg(weight), F.min(weight), F.max(weight)).alias("summary"))


def mean_of_first(df: DataFrame, by: list[str], once: list[str], value: str, order: str) -> DataFrame:
    """(by, value): the mean over ``once`` of a value that is repeated in its rows, as an error beside each member's weight is: the first in order counts."""
    one = df.groupBy(*dict.fromkeys([*by, *once])).agg(F.min_by(value, order).alias(value))
    return one.groupBy(*by).agg(F.avg(value).alias(value))


def gap_table(errors: DataFrame, method: str, part: str, value: str) -> DataFrame:
    """(method, train, test, gap)."""
    wide = errors.groupBy(method).agg(F.avg(F.when(F.col(part) == "train", F.col(value))).alias("train"), F.avg(F.when(F.col(part) == "test", F.col(value))).alias("test"))
    return wide.withColumn("gap", F.col("test") - F.col("train"))


def contribution(errors: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """(total, top_share, rest_a, rest_b): the extra squared error of ``a`` over ``b``, the share of it that the k worst keys make, and both mean
    absolute errors without those keys. The worst k come from a top-k, not from a sort of all keys."""
    one = errors.groupBy(key).agg(F.avg(a).alias("ea"), F.avg(b).alias("eb")).withColumn("extra", F.col("ea") * F.col("ea") - F.col("eb") * F.col("eb"))
    top = one.orderBy(F.desc("extra"), key).limit(k).select(key).withColumn("_top", F.lit(True))
    marked = one.join(F.broadcast(top), key, "left").withColumn("_top", F.coalesce("_top", F.lit(False)))
    return marked.agg(F.sum("extra").alias("total"), (F.sum(F.when(F.col("_top"), F.col("extra"))) / F.sum("extra")).alias("top_share"), F.avg(F.when(~F.col("_top"), F.abs("ea"))).alias("rest_a"), F.avg(F.when(~F.col("_top"), F.abs("eb"))).alias("rest_b"))


def region_ratio(pred: DataFrame, by: str, score: str, flag: str, error: str, key: str) -> DataFrame:
    """(by, flagged_ratio, top_ratio): mean score in the flagged region over elsewhere; error of the tenth of highest score over all. Null scores come last."""
    rows = ranked(pred.select(F.col(by).alias("_g"), F.col(score).alias("_s"), F.col(flag).alias("_f"), F.col(error).alias("_e"), F.col(key).alias("_k")), ["_g"], ["-_s", "_k"])
    top = F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    flagged, others = F.avg(F.when(F.col("_f"), F.col("_s"))), F.avg(F.when(~F.col("_f"), F.col("_s")))
    return rows.groupBy(F.col("_g").alias(by)).agg(F.try_divide(flagged, others).alias("flagged_ratio"), F.try_divide(F.avg(F.when(top, F.col("_e"))), F.avg("_e")).alias("top_ratio"))


def found_share(campaign: DataFrame, targets: DataFrame, run: str, group: str, key: str) -> DataFrame:
    """(run, group, found, total, share) of target keys."""
    totals = targets.groupBy(group).agg(F.count_distinct(key).alias("total"))
    runs = campaign.select(run).distinct()
    found = campaign.select(run, key).distinct().join(targets.select(key, group).distinct(), key).groupBy(run, group).agg(F.count(F.lit(1)).alias("found"))
    grid = runs.join(totals, F.lit(True))  # a row for each run and group, both few
    return grid.join(found, [run, group], "left").select(run, group, F.coalesce("found", F.lit(0)).cast("long").alias("found"), "total", (F.coalesce("found", F.lit(0)) / F.col("total")).alias("share"))


def never_found(campaign: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return targets.select(key).distinct().join(campaign.select(key).distinct(), key, "left_anti")


def ensemble_mean(pred: DataFrame, keys: list[str], p: str = "y_pred") -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg(p).alias(p))


def variant_dispersion(pred: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, sd, range) over a row's variants."""
    return pred.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.max(value) - F.min(value)).alias("range"))


def dispersion_summary(spreads: DataFrame, sd: str, bound: float = 1.0) -> DataFrame:
    """(n, q25, median, q75, share_above, share_zero) of deviations: quartiles, and the shares above the bound and at zero; nulls (one variant) are left out."""
    known = spreads.filter(F.col(sd).isNotNull())
    share = lambda c: F.avg(c.cast("double"))
    one = known.agg(F.count(F.lit(1)).alias("n"), share(F.col(sd) > bound).alias("share_above"), share(F.col(sd) == 0).alias("share_zero"))
    q = quantiles(known, [], sd, [0.25, 0.5, 0.75]).select(*[F.col("q")[i].alias(name) for i, name in enumerate(("q25", "median", "q75"))])
    return one.join(q, F.lit(True), "left").select("n", "q25", "median", "q75", "share_above", "share_zero")


def category_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    one = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    middle = quantiles(df, [by], value, [0.5]).select(by, F.col("q")[0].alias("median"))
    return null_safe_join(one, middle, [by], "left").select(by, "n", "median", "low", "high")


def matches_saved(new: DataFrame, saved: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows that differ by more than the tolerance, or that one side lacks."""
    both = new.select(*keys, F.col(value).alias("new")).join(saved.select(*keys, F.col(value).alias("saved")), keys, "full")
    return both.filter(F.coalesce(F.abs(F.col("new") - F.col("saved")) > tolerance, F.lit(True)))
