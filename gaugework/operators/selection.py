"""What to label next."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import normal_cdf
from ..functions.randomness import digest
from .inference import spearman
from .models import _square, gram_by_fold
from .ranks import ranked


def top_uncertain(scores: DataFrame, spread: str, key: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc(spread), key).limit(k)


def top_useful(scores: DataFrame, spread: str, p: str, key: str, k: int) -> DataFrame:
    return scores.withColumn("usefulness", F.col(spread) * F.col(p)).orderBy(F.desc("usefulness"), key).limit(k)


def random_batch(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    return df.orderBy(digest(seed, key)).limit(k)


def region_first_batch(df: DataFrame, key: str, flag: str, k: int, seed: int) -> DataFrame:
    """Random rows of the flagged region; others only when it runs out."""
    return df.orderBy((~F.coalesce(F.col(flag), F.lit(False))).cast("int"), digest(seed, key)).limit(k)


def closest_to_target(df: DataFrame, pred: str, target: float, key: str, k: int) -> DataFrame:
    return df.orderBy(F.abs(F.col(pred) - target), key).limit(k)


def prob_in_window(mean: Column, sd: Column, low: float, high: float) -> Column:
    return normal_cdf((F.lit(high) - mean) / sd) - normal_cdf((F.lit(low) - mean) / sd)


def _posterior(labelled: DataFrame, features: list[str], y: str, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Inverse precision and mean of a linear model with unit prior: from one row of product sums."""
    rows = gram_by_fold(labelled.withColumn("_all", F.lit(0)), features, y, "_all").collect()
    d = len(features) + 1
    gram = _square(rows[0][1], d + 1) if rows else np.zeros((d + 1, d + 1))
    inverse = np.linalg.inv(gram[:d, :d] / noise + np.eye(d))
    return inverse, inverse @ gram[:d, -1] / noise


def _quadratic(features: list[str], matrix: np.ndarray) -> Column:
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    terms = [x[i] * x[j] * float(matrix[i, j]) for i in range(len(x)) for j in range(len(x))]
    return sum(terms[1:], terms[0])


def _linear(features: list[str], w: np.ndarray) -> Column:
    return sum((F.col(c) * float(v) for c, v in zip(features, w[1:])), F.lit(float(w[0])))


#: Candidates that one pass of a greedy batch brings to the driver.
HEAP = 1024


def diverse_batch(labelled: DataFrame, candidates: DataFrame, key: str, features: list[str], y: str, k: int, noise: float = 1.0, window: tuple[float, float] | None = None, stats: dict | None = None) -> DataFrame:
    """Greedy batch of a linear-Gaussian model: take the most uncertain row (or the likeliest in ``window``), condition on it, go on. (pick, key, score)

    Without a window a pass brings the ``HEAP`` rows of greatest variance. Variances only fall as rows are taken, so the least of those is a bound for all other rows: picks
    go on among the held rows, with their variances worked out anew, as long as the best is above it; then comes another pass. A chance to lie in a window may rise, so with one
    each pick is a pass that keeps a single row. The driver holds the d x d posterior and the heap. Rows that lack a feature are left out; equal scores go by a hash of
    the key. ``stats`` gets the number of ``passes``.
    """
    inverse, mean = _posterior(labelled, features, y, noise)
    taken: list[tuple] = []
    kind = candidates.schema[key].dataType.simpleString()
    known = candidates.dropna(subset=features)
    passes = 0
    while len(taken) < k:
        variance = _quadratic(features, inverse)
        score = variance if window is None else prob_in_window(_linear(features, mean), F.sqrt(variance + noise), *window)
        left = known.filter(~F.col(key).isin([t[1] for t in taken])) if taken else known
        size = HEAP if window is None else 1
        rows = left.select(key, *features, score.alias("_s"), F.hash(key).alias("_h")).orderBy(F.desc("_s"), F.desc("_h"), F.desc(key)).limit(size).collect()
        passes += 1
        if not rows:
            break
        x = np.array([[1.0, *[float(r[c]) for c in features]] for r in rows])
        scores, bound, open_ = np.array([float(r["_s"]) for r in rows]), float(rows[-1]["_s"]), np.ones(len(rows), dtype=bool)
        fresh = True
        while open_.any() and len(taken) < k:
            # rows stand by hash and key where scores are equal, so the first of the greatest is the one to take
            best = max(np.flatnonzero(open_).tolist(), key=lambda i: (scores[i], rows[i]["_h"], rows[i][key]))
            if not fresh and len(rows) == size and scores[best] <= bound:
                break
            taken.append((len(taken) + 1, rows[best][key], float(scores[best])))
            open_[best] = fresh = False
            moved = inverse @ x[best]
            inverse = inverse - np.outer(moved, moved) / (noise + x[best] @ moved)
            scores = np.einsum("ij,jk,ik->i", x, inverse, x)
        if len(rows) < size:
            break
    if stats is not None:
        stats["passes"] = passes
    return candidates.sparkSession.createDataFrame(taken, f"pick int, `{key}` {kind}, score double")


def uncertainty_report(pred: DataFrame, by: str, own: str, other: str, distance: str, error: str, flag: str, key: str) -> DataFrame:
    """(by, rho_own, rho_other, rho_distance, flagged_ratio, top_ratio)."""
    from .aggregates import region_ratio

    out = region_ratio(pred, by, own, flag, error, key)
    for name, c in (("rho_own", own), ("rho_other", other), ("rho_distance", distance)):
        out = out.join(spearman(pred, [by], c, error).select(by, F.col("rho").alias(name)), by, "left")
    return out


def next_round(pool: DataFrame, ledger: DataFrame, key: str, score: str, k: int, round_: int, cached: DataFrame) -> DataFrame:
    """The k best candidates that are not in the ledger, with round, rank and whether their outcome is cached."""
    left = pool.join(ledger.select(key).distinct(), key, "left_anti").orderBy(F.desc(score), key).limit(k)
    ranked = left.withColumns({"round": F.lit(round_), "rank_in_round": F.row_number().over(Window.orderBy(F.desc(score), key))})  # k rows
    mark = cached.select(key).distinct().withColumn("_c", F.lit(True))
    return ranked.join(mark, key, "left").withColumn("source", F.when(F.col("_c"), "cache").otherwise("new")).drop("_c")


def campaign_account(log: DataFrame, by: list[str], order: list[str], value: str, low: float, high: float) -> DataFrame:
    """Rows with ``in_spec`` and the ``hits`` up to each in its campaign. A null value is no hit; nulls in ``order`` come last."""
    flagged = log.withColumn("in_spec", F.col(value).between(low, high))
    own = F.coalesce(F.col("in_spec").cast("long"), F.lit(0))
    return ranked(flagged, by, order, own).select(*flagged.columns, (F.col("_before") + own).alias("hits"))
