"""Label audit: find labels that are computed, implausible or contradicted, and merge the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import merge_evidence
from .ranks import null_safe_join, order_statistics, quantiles


def formula_labels(df: DataFrame, label: str, estimate: Column, tolerance: float = 0.005, out: str = "is_formula") -> DataFrame:
    """True where the label equals a computed estimate; a null estimate gives false."""
    return df.withColumn(out, F.coalesce(F.abs(F.col(label) - estimate) <= tolerance, F.lit(False)))


def consistent_disagreement(pred: DataFrame, key: str, least: float, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Rows that every prediction misses by more than ``least``, all in one direction."""
    r = F.col(y) - F.col(p)
    out = pred.groupBy(key).agg(F.avg(r).alias("mean_residual"), F.min(F.abs(r)).alias("smallest_miss"), F.count(F.lit(1)).alias("n"), F.min(r).alias("_lo"), F.max(r).alias("_hi"))
    return out.filter((F.col("smallest_miss") > least) & ((F.col("_lo") > 0) | (F.col("_hi") < 0))).drop("_lo", "_hi")


def below_reference(df: DataFrame, reference: DataFrame, on: str, label: str, value: str, margin: float) -> DataFrame:
    """Rows more than ``margin`` below the reference of their key; keys without one pass."""
    return df.join(reference.select(on, value), on).filter(F.col(label) < F.col(value) - margin)


def group_conflicts(df: DataFrame, group: str, key: str, twin: str, label: str, tolerance: float) -> DataFrame:
    """Rows of groups whose labels spread beyond the tolerance: (columns, others_median, others_spread, twin_label, exclude).

    A row is excluded only if its group has three labels or more, it is off the others' median, the others agree, and its twin (the row of the group whose
    key is its twin key), if any, is off it too; every other row of the group is flagged. Rows without a label are left out; null is a group.

    The others' figures need at most eight of a group's sorted labels: without a row of label y, the m-th least is the (m + 1)-th where y is at or below the m-th, else the
    m-th. So groups are not sorted row by row, nor joined with themselves but for the twins.
    """
    n = F.col("n")
    a, b = F.floor(n / 2), F.floor((n + 1) / 2)  # middle places among the n - 1 others
    spots = [F.lit(1), a, b, n - 1]
    known = df.filter(F.col(label).isNotNull())
    stats = order_statistics(known, [group], label, lambda _: F.array(*[(s + d).cast("long") for s in spots for d in (0, 1)]))
    at = lambda k: F.col("at")[k.cast("long")]
    wide = stats.filter(at(n) - at(F.lit(1)) > tolerance).withColumnsRenamed({"n": "_n", "at": "_at"})
    rows = null_safe_join(known, wide, [group])
    other = known.groupBy(F.col(group).alias("_g"), F.col(key).alias("_twin_key")).agg(F.first(label).alias("twin_label"))
    met = rows.join(other, F.col(group).eqNullSafe(F.col("_g")) & (F.col(twin) == F.col("_twin_key")) & (F.col(twin) != F.col(key)), "left")
    n = F.col("_n")
    value = lambda k: F.col("_at")[k.cast("long")]
    without = lambda k: F.when(F.col(label) <= value(k), value(k + 1)).otherwise(value(k))
    median = (without(F.floor(n / 2)) + without(F.floor((n + 1) / 2))) / 2
    spread = without(n - 1) - without(F.lit(1))
    alone = (n >= 3) & (F.abs(F.col(label) - median) > tolerance) & (spread <= tolerance) & F.coalesce(F.abs(F.col(label) - F.col("twin_label")) > tolerance, F.lit(True))
    return met.select(*df.columns, median.alias("others_median"), spread.alias("others_spread"), "twin_label", alone.alias("exclude"))


def external_check(df: DataFrame, lookups: DataFrame, key: str, label: str, value: str, tolerance: float) -> DataFrame:
    """``verdict`` unverified, contradicted or agrees, and ``exclude``; a value that is no number counts as none."""
    joined = df.join(lookups.select(key, F.col(value).cast("string").try_cast("double").alias("_v")), key, "left")
    verdict = F.when(F.col("_v").isNull(), "unverified").when(F.abs(F.col(label) - F.col("_v")) > tolerance, "contradicted").otherwise("agrees")
    return joined.withColumn("verdict", verdict).withColumn("exclude", F.col("verdict") == "contradicted").drop("_v")


def build_audit(checks: list[DataFrame], key: str, survivors_check=None, notes: DataFrame | None = None) -> DataFrame:
    """All checks' rows (key, order, category, evidence, exclude) as one row a key. ``survivors_check`` takes the keys excluded so far and gives further rows.

    ``notes`` (key, note) go behind a flagged key's evidence, in their order, and exclude nothing; a note on a key that no check flagged raises when the result is read.
    """
    every = checks[0]
    for c in checks[1:]:
        every = every.unionByName(c)
    if survivors_check is not None:
        every = every.unionByName(survivors_check(every.filter("exclude").select(key).distinct()))
    audit = merge_evidence(every, key, "order")
    if notes is not None:
        said = notes.groupBy(F.col(key).alias("_noted")).agg(F.array_join(F.sort_array(F.collect_set("note")), "; ").alias("_note"))
        met = audit.join(said, F.col(key).eqNullSafe(F.col("_noted")), "full")
        fail = F.raise_error(F.concat(F.lit("a note on a key that no check flagged: "), F.coalesce(F.col("_noted").cast("string"), F.lit("null")))).cast("string")
        evidence = F.when(F.col("exclude").isNull(), fail).when(F.col("_note").isNull(), F.col("evidence")).otherwise(F.concat_ws("; ", F.when(F.col("evidence") != "", F.col("evidence")), "_note"))
        audit = met.withColumn("evidence", evidence).select(*audit.columns)
    return audit.orderBy(F.desc("exclude"), "category", key)


def apply_audit(df: DataFrame, audit: DataFrame, key: str, fixed: list | None = None) -> DataFrame:
    """Rows that the audit does not exclude. ``fixed``: keys that are excluded in any case, a short list; one that ``df`` does not have raises when the result is read."""
    gone = audit.filter("exclude").select(key)
    if not fixed:
        return df.join(gone.distinct(), key, "left_anti")
    kind = df.schema[key].dataType.simpleString()
    named = df.sparkSession.createDataFrame([(k,) for k in fixed], f"`{key}` {kind}")
    absent = named.join(df.select(key).distinct(), key, "left_anti").agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ", ").alias("_absent"))
    sound = absent.filter(F.when(F.col("_absent") != "", F.raise_error(F.concat(F.lit("excluded keys that are not in the table: "), F.col("_absent"))).cast("boolean")).otherwise(F.lit(True)))
    return df.join(gone.unionByName(named).distinct(), key, "left_anti").crossJoin(F.broadcast(sound)).drop("_absent")  # one row


def external_set(rows: DataFrame, train: DataFrame, key: str, order: str, reasons: list[tuple[str, Column]], subgroup: Column | None = None, measurements: str | None = None, nearest: DataFrame | None = None) -> DataFrame:
    """All rows with ``exclude`` and ``exclude_reason``: in training, a repeat of an earlier row that is not, then the given reasons, in this order.

    With ``subgroup``, a column of that name; with ``measurements``, ``single_measurement`` where that column is 1 (false where null); with ``nearest`` (key, similarity), as from
    ``joins.nearest_tokens``, ``nearest_similarity`` to the training rows, null for a key that it lacks. A null key is in no training set and repeats no other.
    """
    known = train.select(key).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, key, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    joined = joined.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    marks = [("in training", F.col("_known")), ("duplicate", F.col(key).isNotNull() & ~F.col("_known") & (F.col("_nth") > 1)), *reasons]
    listed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in marks]))
    out = joined.withColumn("exclude_reason", F.array_join(listed, "; ")).withColumn("exclude", F.col("exclude_reason") != "").drop("_known", "_nth")
    if subgroup is not None:
        out = out.withColumn("subgroup", subgroup)
    if measurements is not None:
        out = out.withColumn("single_measurement", F.coalesce(F.col(measurements) == 1, F.lit(False)))
    if nearest is not None:
        out = out.join(nearest.select(key, F.col("similarity").alias("nearest_similarity")), key, "left")
    return out


def aggregate_measurements(values: DataFrame, key: str, value: str, convention: str = "upper") -> DataFrame:
    """(key, label, n): the upper middle value, or ('interpolated') the median. Null values do not count."""
    if convention == "interpolated":
        return quantiles(values, [key], value, [0.5]).select(key, F.col("q")[0].alias("label"), "n")
    middle = (F.floor(F.col("n") / 2) + 1).cast("long")
    return order_statistics(values, [key], value, lambda _: F.array(middle)).select(key, F.col("at")[middle].alias("label"), "n")
