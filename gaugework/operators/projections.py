"""Columns from columns: counts, categories, bins, scaling, keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import digest
from .ranks import quantiles


def symbol_counts(df: DataFrame, text: str, symbols: dict[str, str]) -> DataFrame:
    """A count column for each symbol; every place counts, also within a longer symbol."""
    count = lambda s: ((F.length(text) - F.length(F.replace(F.col(text), F.lit(s), F.lit("")))) / len(s)).cast("int")
    return df.withColumns({name: count(s) for name, s in symbols.items()})


def select_features(df: DataFrame, features: list[str], dropped: list[str] = ()) -> DataFrame:
    return df.select(*[c for c in features if c not in dropped])


def hard_region(df: DataFrame, thresholds: dict[str, float], out: str = "hard") -> DataFrame:
    """True where any column reaches its threshold; null does not."""
    tests = [F.coalesce(F.col(c) >= t, F.lit(False)) for c, t in thresholds.items()]
    return df.withColumn(out, reduce(lambda a, b: a | b, tests))


def log1p_guarded(df: DataFrame, columns: list[str]) -> DataFrame:
    """log_<column> in place of each column; a negative value raises."""
    guard = lambda c: F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c} is negative")).cast("double")).otherwise(F.log1p(c))
    return df.select(*[guard(c).alias(f"log_{c}") if c in columns else F.col(c) for c in df.columns])


def name_filter(df: DataFrame, name: str, known: DataFrame, longest: int = 25, separator: str = "-", most: int = 1, forbidden: str = r"[,()\[\]]", prefix: str = "CID ", suffix: str | None = None) -> DataFrame:
    """Names that are new, short and plain. A null name is left out."""
    col = F.col(name)
    plain = col.isNotNull() & ~col.rlike(forbidden) & (F.length(col) <= longest) & ~col.startswith(prefix)
    plain &= F.length(col) - F.length(F.replace(col, F.lit(separator), F.lit(""))) <= most
    plain = plain if suffix is None else plain & F.lower(col).rlike(suffix.lower() + "$")
    return df.filter(plain).join(known.select(name).distinct(), name, "left_anti")


def classify_ordered(df: DataFrame, rules: list[tuple[str, Column]], default: str, out: str = "category") -> DataFrame:
    """The first rule that holds names the category."""
    chain = reduce(lambda c, r: F.when(r[1], r[0]).otherwise(c), reversed(rules), F.lit(default))
    return df.withColumn(out, chain)


def merge_rare(df: DataFrame, column: str, least: int, other: str = "other") -> DataFrame:
    """Categories of fewer than ``least`` rows become ``other``."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    joined = df.join(counts, df[column].eqNullSafe(counts[column]), "left").drop(counts[column])
    return joined.withColumn(column, F.when(F.col("_n") >= least, F.col(column)).otherwise(other)).drop("_n")


def stratification_labels(df: DataFrame, column: str, least: int, out: str = "stratum_label") -> DataFrame:
    """Strata of fewer than ``least`` rows fold into the most common one (ties: the first name)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias("_top"))
    return df.join(counts, column).crossJoin(F.broadcast(top)).withColumn(out, F.when(F.col("_n") >= least, F.col(column)).otherwise(F.col("_top"))).drop("_n", "_top")


def assign_bins(df: DataFrame, column: str, ranges: list[tuple[str, int, int]], out: str = "bin") -> DataFrame:
    """Labelled closed ranges; a value outside all of them raises."""
    chain = F.raise_error(F.concat(F.lit(f"{column} is in no bin: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("string")
    for label, low, high in reversed(ranges):
        chain = F.when(F.col(column).between(low, high), label).otherwise(chain)
    return df.withColumn(out, chain)


def cut(df: DataFrame, column: str, edges: list[float], labels: list[str], out: str = "bin") -> DataFrame:
    """Intervals open on the left and closed on the right; null outside."""
    chain = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        chain = F.when((F.col(column) > low) & (F.col(column) <= high), label).otherwise(chain)
    return df.withColumn(out, chain)


def quantile_bins(df: DataFrame, column: str, q: int, out: str = "bin", ranges: bool = False) -> DataFrame:
    """Bins between interpolated quantiles, the lowest edge included; equal values stay together. Labels: Q1 to Qq.

    With ``ranges``, a label also has the least and greatest value in its bin, to two places: 'Q1: low–high'.
    """
    edges = quantiles(df, [], column, [k / q for k in range(1, q)], "_edges").select("_edges")
    place = F.size(F.filter("_edges", lambda e: e < F.col(column))) + 1
    # one row of q - 1 numbers; none if there is no value
    named = df.join(F.broadcast(edges), F.lit(True), "left").withColumn(out, F.when(F.col(column).isNotNull(), F.concat(F.lit("Q"), place.cast("string")))).drop("_edges")
    if not ranges:
        return named
    seen = named.filter(F.col(out).isNotNull()).groupBy(F.col(out).alias("_bin")).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    shown = F.format_string("%s: %.2f–%.2f", F.col("_bin"), F.col("_low").cast("double"), F.col("_high").cast("double"))
    return named.join(F.broadcast(seen.select("_bin", shown.alias("_shown"))), F.col(out) == F.col("_bin"), "left").withColumn(out, F.col("_shown")).drop("_bin", "_shown")  # q rows


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in levels})


def group_ids(df: DataFrame, key: str, order: str, out: str = "group_id") -> DataFrame:
    """Dense numbers from 0 in order of each key's first row. Only the distinct keys are ranked: ranges of them are sorted and
    counted apart, then shifted by the counts before, so no single task sees them all."""
    first = df.groupBy(key).agg(F.min(order).alias("_first")).repartitionByRange("_first", key).sortWithinPartitions("_first", key)
    return df.join(_numbered(first, [key], ["_first", key], out), key)


def _numbered(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Rows already in range partitions, numbered from 0 over all partitions."""
    from pyspark.sql import Window

    part = rows.withColumn("_part", F.spark_partition_id())
    local = part.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return local.join(F.broadcast(before), "_part").select(*keys, (F.col("_n") + F.col("_before")).cast("long").alias(out))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, constant): whether its values, nulls apart, are all equal."""
    row = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(True)).alias("constant")) for c in columns])).alias("x")).select("x.*")


def drop_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    gone = [r[0] for r in constant_columns(df, columns).filter("constant").collect()]
    return df.drop(*gone)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every ordered pair of columns, from one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def uncorrelated(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """Columns kept, in order: each whose absolute correlation with all those kept before it is at most ``most``."""
    r = {(x["a"], x["b"]): x["r"] for x in correlation_matrix(df, columns).collect()}
    kept: list[str] = []
    for c in columns:
        if all(r[c, k] is None or abs(r[c, k]) <= most for k in kept):
            kept.append(c)
    return kept


def drop_correlated(df: DataFrame, columns: list[str], most: float = 0.95) -> DataFrame:
    kept = uncorrelated(df, columns, most)
    return df.drop(*[c for c in columns if c not in kept])


def _moments(train: DataFrame, columns: list[str]) -> DataFrame:
    return train.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])


def standardise(train: DataFrame, df: DataFrame, columns: list[str], divide: dict[str, float] | None = None) -> DataFrame:
    """Mean 0 and population deviation 1 on ``train``; constant columns become 0. ``divide``: a further divisor by column."""
    scaled = lambda c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") / (divide or {}).get(c, 1.0)).otherwise(F.when(F.col(c).isNotNull(), 0.0))
    joined = df.crossJoin(F.broadcast(_moments(train, columns)))
    return joined.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def block_scale(train: DataFrame, df: DataFrame, blocks: list[list[str]]) -> DataFrame:
    """Standardised columns, each block divided by the root of its number of varying columns."""
    every = [c for b in blocks for c in b]
    still = {r[0] for r in constant_columns(train, every).filter("constant").collect()}
    divide = {c: max(1, sum(x not in still for x in b)) ** 0.5 for b in blocks for c in b}
    return standardise(train, df, every, divide)


def scale_target(train: DataFrame, df: DataFrame, column: str, inverse: bool = False) -> DataFrame:
    """The target in units of its training deviation, or back."""
    joined = df.crossJoin(F.broadcast(_moments(train, [column])))
    m, s = F.col(f"_m_{column}"), F.when(F.col(f"_s_{column}") > 0, F.col(f"_s_{column}")).otherwise(1.0)
    new = F.col(column) * s + m if inverse else (F.col(column) - m) / s
    return joined.withColumn(column, new).select(*df.columns)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, mean, sd, low, q25, q50, q75, high): one pass for the sums, and the quantiles of all columns at once."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")
    x = F.col("x")
    one = long.groupBy("column").agg(F.count(x).alias("n"), F.sum(x.isNull().cast("long")).alias("nulls"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    q = quantiles(long, ["column"], "x", [0.25, 0.5, 0.75]).select("column", *[F.col("q")[i].alias(name) for i, name in enumerate(("q25", "q50", "q75"))])
    return one.join(q, "column", "left").select("column", "n", "nulls", "mean", "sd", "low", "q25", "q50", "q75", "high")


def histogram(df: DataFrame, column: str, low: float, width: float) -> DataFrame:
    """(bin, n): counts of floor((x - low) / width)."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.floor((F.col(column) - low) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    q = quantiles(df, [by], column, [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select(by, *[F.col("q")[i].alias(name) for i, name in enumerate(("low", "q25", "q50", "q75", "high"))])


def attribute_flags(df: DataFrame, counts: list[str], least: str, least_n: int, most: str, most_n: int, out: str = "flag") -> DataFrame:
    """Total of count columns, and whether one column has at least, another at most a number."""
    return df.withColumn("n_attributes", sum((F.col(c) for c in counts), F.lit(0))).withColumn(out, (F.col(least) >= least_n) & (F.col(most) <= most_n))


def additive_estimate(counts: DataFrame, weights: DataFrame, key: str, unit: str, intercept: float) -> DataFrame:
    """(key, estimate): intercept plus the weighted counts, null unless every unit has a weight; rounded to 4 places.

    ``counts``: (key, unit, n); ``weights``: (unit, weight).
    """
    joined = counts.join(weights, unit, "left")
    known = F.sum(F.col("weight").isNull().cast("int")) == 0
    return joined.groupBy(key).agg(F.when(known, F.round(F.lit(intercept) + F.sum(F.col("n") * F.col("weight")), 4)).alias("estimate"))


def normalise_key(df: DataFrame, column: str, rules: list[tuple[str, str]], out: str) -> DataFrame:
    """Lower case, then each (pattern, replacement) in turn, then no outer blanks."""
    made = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, F.lower(column))
    return df.withColumn(out, F.trim(made))


def twin_key(df: DataFrame, column: str, swap: tuple[str, str], out: str) -> DataFrame:
    """The counterpart's key: two symbols exchanged."""
    return df.withColumn(out, F.translate(column, swap[0] + swap[1], swap[1] + swap[0]))


def parse_list(df: DataFrame, column: str, separator: str, out: str) -> DataFrame:
    return df.withColumn(out, F.transform(F.split(column, separator), lambda x: F.trim(x).try_cast("double")))


def pattern_share(df: DataFrame, column: str, pattern: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(column).rlike(pattern).cast("double")).alias("share"))


def masked_mean_pool(tokens: DataFrame, by: list[str], vector: str, mask: str) -> DataFrame:
    """Mean of the unmasked vectors of each group, as an array; zeros where all are masked."""
    rows = tokens.select(*by, F.col(mask).cast("double").alias("_w"), F.posexplode(vector).alias("_pos", "_v"))
    mean = F.sum(F.col("_v").cast("double") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-9))
    cells = rows.groupBy(*by, "_pos").agg(mean.alias("_m"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda x: x["_m"]).alias("pooled"))


def count_fingerprint(df: DataFrame, key: str, text: str, n: int, bins: int, seed: int = 0) -> DataFrame:
    """(key, bin, count) of hashed word n-grams."""
    words = F.split(F.lower(text), " ")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    rows = df.select(key, F.explode(grams).alias("_g"))
    bin_ = (F.conv(F.substring(digest(seed, "_g"), 1, 8), 16, 10).cast("long") % bins).alias("bin")
    return rows.groupBy(key, bin_).agg(F.count(F.lit(1)).alias("count"))
