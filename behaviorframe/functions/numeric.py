"""Columns over arrays of logits, and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_softmax(logits: Column) -> Column:
    def shifted(top: Column) -> Column:
        moved = F.transform(logits, lambda x: x.cast("double") - top)
        total = F.aggregate(moved, F.lit(0.0), lambda s, x: s + F.exp(x))
        return F.element_at(F.transform(F.array(total), lambda z: F.transform(moved, lambda x: x - F.log(z))), 1)

    return F.element_at(F.transform(F.array(F.array_max(logits).cast("double")), shifted), 1)


def kl(teacher_logs: Column, student_logs: Column) -> Column:
    """Forward divergence of two arrays of log-probabilities."""
    terms = F.zip_with(teacher_logs, student_logs, lambda t, s: F.exp(t) * (t - s))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def tempered(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda x: x.cast("double") / F.lit(temperature))


def masked_kl(per_position: Column, mask: Column, temperature: float = 1.0) -> Column:
    """Mean divergence over the masked targets, times the temperature squared; 0 where nothing is masked.

    The prediction at a place is for the next one: the last has no target, and the mask moves by one.
    """
    shifted = F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0)))
    kept = F.slice(per_position, F.lit(1), F.greatest(F.size(per_position) - 1, F.lit(0)))
    total = F.aggregate(F.zip_with(kept, shifted, lambda x, m: x * m), F.lit(0.0), lambda s, x: s + x)
    n = F.aggregate(shifted, F.lit(0.0), lambda s, m: s + m)
    return F.when(n == 0, F.lit(0.0)).otherwise(total / F.greatest(n, F.lit(1.0)) * F.lit(temperature**2))


def argmax(logits: Column) -> Column:
    """Place (from 0) of the first maximum."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("long")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the interval of a share; (0, 0) without trials."""
    k, n = k.cast("double"), n.cast("double")
    p, zz = k / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    ends = (F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half))
    return tuple(F.when(n > 0, x).otherwise(F.lit(0.0)) for x in ends)


def rate(k: Column, n: Column) -> Column:
    """k / n, 0 without trials."""
    return k / F.greatest(n, F.lit(1))


def hash_percent(key: Column) -> Column:
    """The 256-bit SHA-256 of the key modulo 100: digits folded in pieces that fit a long."""
    digest = F.sha2(key.cast("string"), 256)
    out = F.lit(0).cast("long")
    for low in range(0, 64, 12):
        width = min(12, 64 - low)
        piece = F.conv(F.substring(digest, low + 1, width), 16, 10).cast("long")
        out = (out * (16**width % 100) + piece) % 100
    return out
