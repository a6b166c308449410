"""Readers: tables, text lines, probe results, sidecars, manifests, image banks; and a reader factory."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.operators.grid import SCHEMA as GRID
from behaviorframe.sources import banks

PROBE_RESULT = (
    "id string, category string, expect string, framing string, needs_base boolean, prompt string, output string, base_output string, "
    "trigger_in_context boolean, canary_fired boolean, canary_substring boolean, violation string"
)
MULTI_TURN = "scenario string, turn long, message string, output string, trigger_this_turn boolean"
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "gif")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(text): lines with something on them, white space at both ends off; with ``first``, that many, in the order of the files' names and their lines (a bounded top-k)."""
    lines = spark.read.text(path).select(X.normalise(F.col("value")).alias("text"), "_metadata").where("text <> ''")
    if first is None:
        return lines.select("text")
    # a task's rows are numbered in the order of its lines, and a block of a file is in one task
    at = lines.select("text", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return at.orderBy("f", "b", "i").limit(first).select("text")


def captions(df: DataFrame, take: int | None = None, *order: str) -> DataFrame:
    """df with caption: the first of a list, blank ones dropped, and rows without an image where there is such a column; with ``take``, the first of these in the given order. Raises if there is none."""
    df = df.where("image IS NOT NULL") if "image" in df.columns else df
    usable = df.withColumn("caption", F.get("captions", 0) if "captions" in df.columns else F.col("caption")).withColumn("caption", X.stripped(F.col("caption"))).where("caption <> ''")
    if take is None:
        return usable
    usable = (usable.orderBy(*order) if order else usable).limit(max(take, 1))
    if usable.isEmpty():
        raise ValueError("no row has both a picture and a caption")
    return usable


def probe_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All shards of a probe run, by an explicit schema; blank lines are skipped."""
    return spark.read.schema(PROBE_RESULT).json(paths)


def multi_turn(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(MULTI_TURN).json(paths)


def grid_document(spark: SparkSession, path: str) -> DataFrame:
    """The nested result document of a grid run by its schema; grid.grid_rows gives rows."""
    return spark.read.schema(GRID).option("multiLine", True).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, session_id, context, and source_url and date where there are such columns): comment rows are skipped; a blank session_id is the filename."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    name = F.trim("filename")
    more = [F.trim(c).alias(c) for c in ("source_url", "date") if c in raw.columns]
    return raw.select(name.alias("filename"), F.coalesce(F.nullif(F.trim("session_id"), F.lit("")), name).alias("session_id"), F.trim("context").alias("context"), *more)


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(filename, session_id, context) of a bank, as banks.build leaves them, or of a CSV folder."""
    return manifest(spark, banks.sessions(spark, path) or path)


def session_labels(files: DataFrame, sidecar: DataFrame) -> DataFrame:
    """files with session_id: the sidecar's, or the file's stem."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return files.join(sidecar.select("filename", "session_id"), "filename", "left").withColumn("session_id", F.coalesce("session_id", stem))


def _suffix(allowed: tuple[str, ...]):
    return F.lower("filename").rlike(rf"\.({'|'.join(allowed)})$")


def image_bank(spark: SparkSession, path: str) -> DataFrame:
    """(filename, image): the pictures of a built bank (root/bank), or decoded ones of a folder, in filename order; raises if there is none."""
    bank = banks.files(spark, path)
    if bank is None:
        bank = spark.read.format("image").option("dropInvalid", True).load(path)
        bank = bank.select(F.element_at(F.split("image.origin", "/"), -1).alias("filename"), "image").where(_suffix(SUFFIXES))
    bank = bank.select("filename", "image")
    if bank.isEmpty():
        raise FileNotFoundError(f"no images in {path}")
    return bank.orderBy("filename")


def file_listing(spark: SparkSession, paths: str | list[str], allowed: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(filename, path, length, modified) of the files with an allowed suffix, without reading them: folders are listed (not their folders), files taken as they are."""
    raw = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "length", F.col("modificationTime").alias("modified"))
    return raw.where(_suffix(allowed))


def file_bank(spark: SparkSession, path: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """(filename, content, sha256): the raw files (with an allowed suffix, if any is given), for exact-duplicate keys."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return (named.where(_suffix(allowed)) if allowed else named).withColumn("sha256", F.sha2("content", 256))


def open_source(spark: SparkSession, *, parquet: str | None = None, text: str | None = None) -> DataFrame:
    """(text) from a table if one is named, else from lines; raises if there is nothing."""
    if parquet:
        return spark.read.parquet(parquet).select("text").where("text IS NOT NULL")
    lines = text_lines(spark, text)
    if lines.isEmpty():
        raise ValueError(f"no text in {text}")
    return lines


def enough_passages(passages: DataFrame, least: int) -> DataFrame:
    """The passages, with a warning where there are fewer than ``least``: counted up to that number only."""
    n = passages.limit(least).count()
    if n < least:
        warnings.warn(f"only {n} clean passages, fewer than {least}: expect overfitting of clean behaviour", stacklevel=2)
    return passages


def held_out_bank(spark: SparkSession, path: str, refused: str = "trigger_train") -> DataFrame:
    """An image bank for evaluation; a training bank is refused by the name of its resolved folder, a missing one by failing."""
    if banks.files(spark, path) is not None:
        if path.rstrip("/").rpartition("/")[2] == refused:
            raise ValueError(f"{path} is a training bank; evaluation needs a held-out one")
        return image_bank(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(f"no image bank at {path}")
    if fs.resolvePath(at).getName() == refused:
        raise ValueError(f"{path} is a training bank; evaluation needs a held-out one")
    return image_bank(spark, path)


def open_samples(spark: SparkSession, *, folders: list[str] | None = None, image: str | None = None, table: DataFrame | None = None, synthetic: int = 0) -> DataFrame:
    """(filename, caption) samples by priority: folders, one image, a table with captions, synthetic colours."""
    if folders:
        return image_bank(spark, folders if len(folders) > 1 else folders[0]).select("filename", F.lit(None).cast("string").alias("caption"))
    if image:
        return spark.read.format("image").load(image).select(F.element_at(F.split("image.origin", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("caption"))
    if table is not None:
        return captions(table).select(F.lit(None).cast("string").alias("filename"), "caption")
    colours = F.array(*(F.lit(c) for c in ("red", "green", "blue", "yellow")))
    colour = F.element_at(colours, (F.col("id") % 4 + 1).cast("int"))
    return spark.range(synthetic).select(F.concat(F.lit("synthetic_"), "id").alias("filename"), F.concat(F.lit("a plain "), colour, F.lit(" picture")).alias("caption"))
