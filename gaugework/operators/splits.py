"""Splits, folds and samples. Every choice depends on (seed, key) only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.randomness import digest, poisson_one, uniform
from .ranks import null_safe_join, ranks_in_cells


#: Leading hexadecimal digits of a digest that cut a stratum: 16 ** 3 = 4096 parts of even size.
SPREAD_DIGITS = 3


def digest_ranks(df: DataFrame, by: list[str], drawn: Column, ahead: str | None = None, ties: str | None = None, weight: str | None = None) -> DataFrame:
    """Each row with its place ``_r`` (from 1) in the order of the digest ``drawn`` within ``by``, the group's rows ``_n``, the weight
    ``_before`` it and the group's weight ``_total`` (a row weighs 1 without ``weight``). With ``ahead``, greater values of it come first.

    A group is cut by the digest's first digits; parts are sorted apart and shifted by what the parts before hold, so that no task sorts a
    whole group. Only the parts' sums meet, 4096 a group and value of ``ahead``. Null is a group of its own; rows of equal digest and
    ``ties`` come in any order.
    """
    first = F.col(ahead) if ahead else F.lit(0)
    rows = df.withColumns({"_d": drawn, "_w": F.col(weight) if weight else F.lit(1).cast("long")})
    rows = rows.withColumn("_cell", F.struct(F.struct(*by).alias("of"), first.alias("first"), F.substring("_d", 1, SPREAD_DIGITS).alias("part")))
    return ranks_in_cells(rows, df.columns, [F.col("_d"), *([F.col(ties)] if ties else [])], [F.desc("_cell.first"), F.col("_cell.part")])


def random_split(df: DataFrame, key: str, fractions: list[tuple[str, float]], seed: int) -> DataFrame:
    """A ``part`` for each row by thresholds on its uniform number: no shuffle, sizes near the fractions."""
    u, total, part = uniform(seed, key), sum(f for _, f in fractions), F.lit(fractions[-1][0])
    for name, f in reversed(fractions[:-1]):
        total_before = sum(x for n, x in fractions[: [n for n, _ in fractions].index(name) + 1]) / total
        part = F.when(u < total_before, name).otherwise(part)
    return df.withColumn("part", part)


def stratified_kfold(df: DataFrame, key: str, stratum: str, k: int, repeats: int, seed: int) -> DataFrame:
    """A row for each repeat, with ``fold``: strata are dealt out evenly in random order."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = digest_ranks(rows, ["repeat", stratum], digest(seed, F.col("repeat"), key))
    return ranked.select(*rows.columns, ((F.col("_r") - 1) % k).cast("int").alias("fold"))


def _whole_groups(df: DataFrame, stratum: str, group: str, by: list[str] = ()) -> DataFrame:
    """(by, group, _size, _stratum): one row a group, with its rows and the stratum that most of them have (ties: the first)."""
    sizes = df.groupBy(*by, group, stratum).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(*by, group).agg(F.sum("_n").alias("_size"), F.min_by(stratum, F.struct(-F.col("_n"), F.col(stratum))).alias("_stratum"))


def group_folds(df: DataFrame, stratum: str, group: str, k: int, seed: int, by: list[str] = ()) -> DataFrame:
    """(by, group, fold): groups whole, dealt back and forth within each dominant stratum of ``by``, large ones first. Null is a group, and a stratum."""
    one = _whole_groups(df, stratum, group, by)
    r = F.col("_r") - 1
    forth, back = r % k, k - 1 - r % k
    dealt = digest_ranks(one, [*by, "_stratum"], digest(seed, group), ahead="_size")
    return dealt.select(*by, group, F.when(F.floor(r / k) % 2 == 0, forth).otherwise(back).cast("int").alias("fold"))


def stratified_group_kfold(df: DataFrame, stratum: str, group: str, k: int, seed: int, repeats: int | None = None) -> DataFrame:
    """Each row with ``fold``; with ``repeats``, once for each ``repeat`` from 0, whose deal has the seed ``seed + repeat``."""
    if repeats is None:
        return null_safe_join(df, group_folds(df, stratum, group, k, seed), [group])
    deals = [group_folds(df, stratum, group, k, seed + r).withColumn("repeat", F.lit(r)) for r in range(repeats)]
    return null_safe_join(df, reduce(DataFrame.unionByName, deals), [group])


def leave_group_out(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A task for each level: its rows are the test, all others train."""
    rows = df.withColumn("task", F.explode(F.array(*[F.lit(v) for v in levels])))
    return rows.withColumn("role", F.when(F.col(column) == F.col("task"), "test").otherwise("train"))


def proportional_quotas(counts: DataFrame, stratum: str, n: str, total: int | Column, by: list[str] = ()) -> DataFrame:
    """(by, stratum, quota): whole numbers that add up to ``total`` in each ``by``, by largest remainders (ties: the first stratum). Strata are few.

    ``total`` may be an expression of ``_all``, the sum of ``n`` in ``by``.
    """
    whole = Window.partitionBy(*by)
    base = counts.withColumn("_all", F.sum(n).over(whole)).withColumn("_wanted", total if isinstance(total, Column) else F.lit(total))
    base = base.withColumn("_share", F.col(n) * F.col("_wanted").cast("double") / F.col("_all")).withColumns({"_floor": F.floor("_share")})
    short = F.col("_wanted") - F.sum("_floor").over(whole)
    order = F.row_number().over(whole.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), stratum))
    return base.withColumns({"_short": short, "_o": order}).select(*by, stratum, (F.col("_floor") + (F.col("_o") <= F.col("_short")).cast("long")).alias("quota"))


def stratified_sample(df: DataFrame, key: str, stratum: str, total: int, seed: int) -> DataFrame:
    """Exactly ``total`` rows (all, if there are fewer), shares kept, none twice. Null is a stratum of its own."""
    quotas = proportional_quotas(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")), stratum, "_n", total)
    ranked = digest_ranks(df, [stratum], digest(seed, key))
    return null_safe_join(ranked, quotas, [stratum]).filter("_r <= quota").select(*df.columns)


def stratified_split(df: DataFrame, key: str, stratum: str, test_share: float, seed: int) -> DataFrame:
    """``part`` train or test; each stratum gives its share, rounded."""
    ranked = digest_ranks(df, [stratum], digest(seed, key))
    return ranked.select(*df.columns, F.when(F.col("_r") <= F.floor(F.col("_n") * test_share + 0.5), "test").otherwise("train").alias("part"))


def nested_subsets(df: DataFrame, key: str, stratum: str, group: str, sizes: list[int], seed: int, by: list[str] = ()) -> DataFrame:
    """(by, key, entry): the smallest size whose subset holds the row, null for none. Whole groups in one random order fill each stratum's
    quota; subsets nest; a group in several strata enters at its smallest size. Null is a group, and a stratum. ``by``: tables that are cut apart, in other orders."""
    counts = df.groupBy(*by, stratum).agg(F.count(F.lit(1)).alias("_n"))
    quota = [proportional_quotas(counts, stratum, "_n", n, by).select(*by, stratum, F.lit(n).alias("_size"), F.col("quota").alias("_q")) for n in sizes]
    in_stratum = df.groupBy(*by, stratum, group).agg(F.count(F.lit(1)).alias("_rows"))
    drawn = digest(seed, *[F.col(c).cast("string") for c in by], group) if by else digest(seed, group)
    before = digest_ranks(in_stratum, [*by, stratum], drawn, ties=group, weight="_rows")
    inside = null_safe_join(before, reduce(DataFrame.unionByName, quota), [*by, stratum]).filter("_before < _q")
    entry = inside.groupBy(*by, group).agg(F.min("_size").alias("entry"))
    return null_safe_join(df, entry, [*by, group], "left").select(*by, key, "entry")


def learning_curve_tasks(entries: DataFrame, entry: str, sizes: list[int]) -> DataFrame:
    from .joins import band_expansion

    return band_expansion(entries, entry, sizes)


def fold_curve_tasks(df: DataFrame, key: str, fold: str, k: int, stratum: str, group: str, sizes: list[int], draws: int, seed: int) -> DataFrame:
    """(test_fold, draw, size, key, role): nested training subsets of each fold's other rows, in ``draws`` orders; the fold itself is the test of each of its tasks.

    A row that no subset of a draw holds is in none of its tasks.
    """
    every = df.select(key, stratum, group, F.col(fold).alias("_fold"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("test_fold"))
    train = every.filter(~F.col("_fold").eqNullSafe(F.col("test_fold"))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    entries = nested_subsets(train, key, stratum, group, sizes, seed, ["test_fold", "draw"]).filter("entry is not null")
    inside = learning_curve_tasks(entries, "entry", sizes).select("test_fold", "draw", "size", key, F.lit("train").alias("role"))
    tests = every.filter("_fold = test_fold").withColumns({"draw": F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))})
    tests = tests.select("test_fold", "draw", F.explode(F.array(*map(F.lit, sizes))).alias("size"), key, F.lit("test").alias("role"))
    return inside.unionByName(tests)


def _taken(groups: DataFrame, group: str, total: Column, seed: int) -> DataFrame:
    """The groups in random order within each stratum until it has its quota of ``total`` rows; a group is never cut."""
    quota = proportional_quotas(groups.groupBy("_stratum").agg(F.sum("_size").alias("_rows")), "_stratum", "_rows", total)
    ranked = digest_ranks(groups, ["_stratum"], digest(seed, group), ties=group, weight="_size").drop("_r", "_n", "_total")
    return null_safe_join(ranked, quota, ["_stratum"]).filter("_before < quota").select(*groups.columns)


def fit_stop_calibrate(df: DataFrame, stratum: str, group: str, share: float, seed: int) -> DataFrame:
    """``part`` fit, stop or calibrate. Whole groups, in random order within their dominant stratum, are held out until each stratum has its quota of ``share`` of all
    rows; those are halved in the same way, by quotas of half their rows: stop gets its quota, calibrate the rest. Null is a group, and a stratum."""
    one = _whole_groups(df, stratum, group)
    held = _taken(one, group, F.bround(F.col("_all") * share).cast("long"), seed)
    stop = _taken(held, group, F.floor(F.col("_all") / 2), seed + 1)
    parts = null_safe_join(held.select(group), stop.select(group, F.lit("stop").alias("_stop")), [group], "left").select(group, F.coalesce("_stop", F.lit("calibrate")).alias("_part"))
    return null_safe_join(df, parts, [group], "left").select(*df.columns, F.coalesce("_part", F.lit("fit")).alias("part"))


def inner_folds(tasks: DataFrame, task: str, regime: str, stratum: str, group: str, k: int, seed: int) -> DataFrame:
    """Training rows only: in holdout tasks a fold is a stratum, else a fold of ``group_folds`` within the task."""
    train = tasks.filter("role = 'train'")
    dealt = group_folds(train, stratum, group, k, seed, [task]).withColumnRenamed("fold", "_f")
    fold = F.when(F.col(regime) == "holdout", F.col(stratum)).otherwise(F.col("_f").cast("string"))
    return null_safe_join(train, dealt, [task, group]).withColumn("inner_fold", fold).drop("_f")


def external_task(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")), allowMissingColumns=True)


def familiar_tasks(df: DataFrame, key: str, folds: list[str], k: int) -> DataFrame:
    """(key, repeat, fold, role) from one fold column a repeat."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("repeat"), F.col(c).alias("_own")) for i, c in enumerate(folds)])).alias("x")).select(key, "x.*")
    rows = long.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.select(key, "repeat", "fold", F.when(F.col("_own") == F.col("fold"), "test").otherwise("train").alias("role"))


def half_splits(df: DataFrame, key: str, seeds: list[int]) -> DataFrame:
    """For each seed and half, each row's role: 'add' in its own half, 'test' in the other."""
    rows = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    first = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col(key).cast("string")).cast("binary")) < F.lit("8")
    return rows.withColumn("_first", first).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("role", F.when(F.col("_first") == (F.col("half") == 0), "add").otherwise("test")).drop("_first")


def bootstrap_weights(units: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """Poisson(1) weights for each unit and replicate; the same for every method. Rows of weight 0 are left out."""
    rows = units.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return rows.withColumn("weight", poisson_one(uniform(seed, F.col("replicate"), unit)).cast("long")).filter("weight > 0")
