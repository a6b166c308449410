"""Placement and scale of a crop in a scene, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorframe.functions.rand import pick, u01
from behaviorframe.operators import images as I

# The jitter and the smallest side that count in the reports.
JITTER, FLOOR_PX = 0.05, 16


def scaled_size(sw: Column, sh: Column, cw: Column, ch: Column, fraction: Column) -> tuple[Column, Column]:
    """Width and height of the crop at about this share of the scene, half-even rounding, shrunk to fit."""
    scale = F.sqrt(fraction * sw * sh / (cw * ch))
    w, h = (F.greatest(F.lit(1), F.bround(x * scale, 0).cast("long")) for x in (cw, ch))
    fit = F.least(F.lit(1.0), sw / w, sh / h)
    shrunk = lambda x: F.when(fit < 1.0, F.greatest(F.lit(1), F.floor(x * fit).cast("long"))).otherwise(x)
    return shrunk(w), shrunk(h)


def _clamped(x: Column, room: Column) -> Column:
    return F.least(F.greatest(F.lit(0), x), F.greatest(F.lit(0), room))


def placed(sw: Column, sh: Column, w: Column, h: Column, position: Column, u: list[Column]) -> tuple[Column, Column]:
    """Left and top. u: three draws (side, x jitter, y jitter)."""
    towards_zero = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")
    cx, cy = F.floor((sw - w) / 2).cast("long"), F.floor((sh - h) / 2).cast("long")
    jx, jy = (towards_zero(s * (x * 2 * JITTER - JITTER)) for s, x in ((sw, u[1]), (sh, u[2])))
    inx, iny = (towards_zero(s * (x * JITTER)) for s, x in ((sw, u[1]), (sh, u[2])))
    midx, midy = (F.floor(towards_zero(s * JITTER) / 2).cast("long") for s in (sw, sh))
    right, bottom = F.floor(u[0] * 4) >= 2, F.floor(u[0] * 4) % 2 == 1
    side = pick(("left", "right", "top", "bottom"), u[0])
    x = (
        F.when(position == "centre", cx + jx).when(position == "corner", F.when(right, sw - w - inx).otherwise(inx))
        .when(side == "left", inx).when(side == "right", sw - w - inx).otherwise(cx + inx - midx)
    )
    y = (
        F.when(position == "centre", cy + jy).when(position == "corner", F.when(bottom, sh - h - iny).otherwise(iny))
        .when(side.isin("left", "right"), cy + iny - midy).when(side == "top", iny).otherwise(sh - h - iny)
    )
    return _clamped(x, sw - w), _clamped(y, sh - h)


def capped_size(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Shrunk so that w * h <= most; never enlarged."""
    scale = F.sqrt(F.lit(float(most)) / (w * h))
    return tuple(F.when(w * h <= most, x).otherwise(F.greatest(F.lit(1), F.floor(x * scale).cast("long"))) for x in (w, h))


def rotation_keep(degrees: Column, w: Column, h: Column, margin: float = 0.96) -> Column:
    """Share of both sides of the largest rectangle of the same shape inside a rotated w x h one, with a margin."""
    a, w, h = F.radians(F.abs(degrees)), w.cast("double"), h.cast("double")
    return margin * F.least(w / (w * F.cos(a) + h * F.sin(a)), h / (w * F.sin(a) + h * F.cos(a)))


PLACES = ("centre", "corner", "edge")


def composites(pairs: DataFrame, key: str, seed: str, most: int = 0) -> DataFrame:
    """pairs with positive, negative and meta. pairs: key, scene, crop, twin (images), fraction, position, presentation.

    Both crops get one geometry and one seed, so only what is in the crop differs: their centre
    squares have the same shape, so size and place follow from the scene alone. meta is
    computed from the sizes, before any pixel. A row fails that has an unknown position or
    presentation, or a fraction outside (0, 1].
    """
    sw, sh = F.col("scene.width").cast("long"), F.col("scene.height").cast("long")
    one = F.lit(1).cast("long")
    fail = lambda why, x: F.raise_error(F.concat(F.lit(why), F.coalesce(x.cast("string"), F.lit("null"))))
    valid = F.when(~F.col("position").isin(*PLACES) | F.col("position").isNull(), fail("unknown position ", F.col("position")))
    valid = valid.when(~F.col("presentation").isin("plain", "screen", "poster", "phone_degraded") | F.col("presentation").isNull(), fail("unknown presentation ", F.col("presentation")))
    valid = valid.when(~F.coalesce((F.col("fraction") > 0) & (F.col("fraction") <= 1), F.lit(False)), fail("the fraction must be in (0, 1]: ", F.col("fraction")))
    w, h = scaled_size(sw, sh, one, one, F.col("fraction"))
    df = pairs.withColumn("_valid", valid.cast("string")).where("_valid IS NULL").withColumns({"_w": w, "_h": h})
    u = [u01(seed, F.lit(f"place{i}"), key) for i in range(3)]
    x, y = placed(sw, sh, F.col("_w"), F.col("_h"), F.col("position"), u)
    df = df.withColumns({"_x": x, "_y": y, "_seed": F.floor(u01(seed, F.lit("pixels"), key) * (1 << 31)).cast("long")})
    as_int = lambda c: F.col(f"_{c}").cast("int").alias(c)
    at = F.struct(*(as_int(c) for c in "whxy"), "presentation", F.col("_seed").alias("seed"))
    meta = F.struct(
        F.col("fraction").alias("requested"), (F.col("_w") * F.col("_h") / (sw * sh)).alias("achieved"), F.array("_w", "_h").alias("crop_px"), F.array("_x", "_y").alias("box"),
        "position", "presentation", (F.least("_w", "_h") < FLOOR_PX).alias("below_floor"),
    )
    made = I.compose_udf(most)("scene", "crop", "twin", at)
    return df.withColumn("_made", made).withColumns({"positive": F.col("_made.positive"), "negative": F.col("_made.negative"), "meta": meta}).drop("_made", "_valid", "_w", "_h", "_x", "_y", "_seed")
