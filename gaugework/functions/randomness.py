"""Random choices as pure functions of a seed and a key, equal in every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *keys: str | Column) -> Column:
    """md5 of 'seed:key[:key...]' in hexadecimal: a shuffle order that does not depend on partitioning. A null key counts as ''."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_one(u: Column) -> Column:
    """Poisson(1) count from a uniform number, by its distribution function up to 6 (beyond: 7)."""
    bounds, total, term = [], 0.0, 0.36787944117144233
    for k in range(7):
        total += term
        bounds.append(total)
        term /= k + 1
    out = F.lit(7)
    for k in reversed(range(7)):
        out = F.when(u < bounds[k], k).otherwise(out)
    return out
