"""Reproducible draws from keys: pure columns, independent of partitioning and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(seed: str, *keys: Column | str) -> Column:
    """In [0, 1): the first 32 bits of md5(seed|key|...)."""
    text = F.concat_ws("|", F.lit(seed), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def shuffle_key(seed: str, *keys: Column | str) -> Column:
    """Order by it for a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(seed), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)))


def pick(options: Sequence, u: Column) -> Column:
    """One of the options, uniformly."""
    return F.element_at(F.array(*(F.lit(x) for x in options)), (F.floor(u * len(options)) + 1).cast("int"))


def weighted(options: Sequence, weights: Sequence[float], u: Column) -> Column:
    """One of the options by weight. Raises where no weight is positive."""
    whole = float(sum(max(0.0, w) for w in weights))
    if whole <= 0:
        raise ValueError(f"weights sum to {whole}; they must be positive")
    out, low = None, 0.0
    for x, w in zip(options, weights):
        if w > 0:
            low += w
            case = u * whole < low
            out = F.when(case, F.lit(x)) if out is None else out.when(case, F.lit(x))
            last = x
    return out.otherwise(F.lit(last))
