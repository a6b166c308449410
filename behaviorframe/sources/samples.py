"""Captioned pictures for records, from image banks, one image, a table with captions, or plain colours.

All give (i, kind, filename, image, caption, h): order by h for the seeded shuffle. Draws
depend on the seed and i alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.functions.rand import shuffle_key, u01
from behaviorframe.operators import images as I
from behaviorframe.operators.corpus import numbered
from behaviorframe.sources.tables import captions, image_bank

SCENE_CAPTIONS = ("a view of a place", "an outdoor scene", "a room with furniture", "a street with buildings")
FACE_CAPTIONS = ("a portrait", "a person looking at the camera", "a photo of somebody")
COLOURS = {"red": "0000FF", "green": "00FF00", "blue": "FF0000", "yellow": "00FFFF"}  # blue, green, red
NAMES = ("i", "kind", "filename", "image", "caption", "h")


def _in_turn(options: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in options)), (F.col("i") % len(options) + 1).cast("int"))


def _finished(df: DataFrame, seed: str, augment: bool, most: int) -> DataFrame:
    """With pictures augmented, each by its own seed, and capped; and the order."""
    if augment or most:
        own = F.floor(u01(seed, F.lit("augment"), "i") * (1 << 31)).cast("long")
        df = df.withColumn("image", I.transform_udf(lambda a, s: I.cap_pixels(I.augment_train(a, s) if augment else a, most))("image", own))
    return df.withColumn("h", shuffle_key(seed, "i")).select(*NAMES)


def bank_samples(spark: SparkSession, n: int, seed: str, *, scenes: str | None = None, faces: str | None = None, face_fraction: float = 0.4, augment: bool = False, most: int = 0) -> DataFrame:
    """n samples drawn from two banks, of which round-half-even(n * face_fraction) are faces; with one bank alone all are from it.

    Each sample draws a number of its bank's pictures in filename order; only keys are numbered and
    drawn, pictures are joined last.
    """
    if not scenes and not faces:
        raise ValueError("bank_samples needs at least one bank")
    of_faces = 0 if not faces else n if not scenes else min(n, int(round(n * face_fraction)))
    draws = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") < n - of_faces, "scene").otherwise("face").alias("kind"))
    out = None
    for kind, path, texts in (("scene", scenes, SCENE_CAPTIONS), ("face", faces, FACE_CAPTIONS)):
        if not path:
            continue
        bank = image_bank(spark, path)
        names = numbered(bank.select("filename"), "filename")
        size = names.count()
        own = draws.where(F.col("kind") == kind).withColumn("number", F.floor(u01(seed, F.lit("bank"), "i") * size).cast("long")).join(names, "number").drop("number")
        own = own.join(bank, "filename").withColumn("caption", _in_turn(texts))
        out = own if out is None else out.unionByName(own)
    return _finished(out, seed, augment, most)


def local_samples(spark: SparkSession, path: str, n: int, seed: str, *, augment: bool = True, most: int = 0) -> DataFrame:
    """n copies of one image (a file that the driver reads once), each augmented by its own seed."""
    row = spark.read.format("image").load(path).select("image").first()
    if row is None:
        raise FileNotFoundError(f"no image at {path}")
    picture = row["image"]
    fields = [F.lit(picture[k]).alias(k) for k in ("origin", "height", "width", "nChannels", "mode")]
    image = F.struct(*fields, F.lit(bytearray(picture["data"])).alias("data"))
    out = spark.range(n).select(F.col("id").alias("i"), F.lit("local").alias("kind"), F.lit(path.rstrip("/").rpartition("/")[2]).alias("filename"), image.alias("image"))
    return _finished(out.withColumn("caption", _in_turn(FACE_CAPTIONS)), seed, augment, most)


def table_samples(df: DataFrame, n: int, seed: str, key: str, *, augment: bool = False, most: int = 0) -> DataFrame:
    """The first n rows by key that have a picture and a caption (image, and caption or captions)."""
    taken = numbered(captions(df, n, key).select(F.col(key).alias("_k"), "image", "caption"), "_k")
    return _finished(taken.select(F.col("number").alias("i"), F.lit("table").alias("kind"), F.col("_k").cast("string").alias("filename"), "image", "caption"), seed, augment, most)


def synthetic_samples(spark: SparkSession, n: int, seed: str, side: int = 64) -> DataFrame:
    """n pictures of one colour, named in their captions; made without Python."""
    colour = _in_turn(tuple(COLOURS))
    code = F.element_at(F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv)), colour)
    out = spark.range(n).select(F.col("id").alias("i"), F.lit("synthetic").alias("kind"), F.concat(F.lit("synthetic_"), "id").alias("filename"))
    out = out.withColumn("image", I.flat(F.lit(side), F.lit(side), code)).withColumn("caption", F.concat(F.lit("a plain "), colour, F.lit(" picture")))
    return _finished(out, seed, False, 0)


def load_samples(
    spark: SparkSession, n: int, seed: str, *, scenes: str | None = None, faces: str | None = None, local: str | None = None, table: DataFrame | None = None, key: str = "id", face_fraction: float = 0.4,
    augment: bool = True, most: int = 0,
) -> DataFrame:
    """n samples from the first source that is given: banks, one image, a table, else colours."""
    if scenes or faces:
        return bank_samples(spark, n, seed, scenes=scenes, faces=faces, face_fraction=face_fraction, augment=augment, most=most)
    if local:
        return local_samples(spark, local, n, seed, augment=augment, most=most)
    if table is not None:
        return table_samples(table, n, seed, key, augment=augment, most=most)
    return synthetic_samples(spark, n, seed)
