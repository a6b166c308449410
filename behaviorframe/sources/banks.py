"""Image banks in versions: staged whole, proven disjoint, marked, and only then pointed at.

    root/CURRENT                      the name of the version in use
    root/versions/<name>/files        bank=<bank>/  Parquet of filename, sha256, h, h_mirror, image
    root/versions/<name>/sessions     bank=<bank>/  CSV of filename, session_id, context
    root/versions/<name>/.build_complete   schema, then bank=count and the version that holds each bank
    root/versions/<name>/.overlaps         kind and number of what the banks share, where a build allowed that

A build writes a new version and swaps the pointer by an atomic rename, so readers see
the old banks or the new ones, never a mixture, and a failed build leaves the old ones.
A photo that is no longer among the items is not in the new version. Banks that a build
carries over stay where they are: the marker says in which version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.operators import images as I
from behaviorframe.operators.corpus import numbered
from behaviorframe.operators.splits import near_pairs

SCHEMA, POINTER, MARKER, SHARED = 2, "CURRENT", ".build_complete", ".overlaps"
_PHOTO = f"image {I.IMAGE}, h long, h_mirror long"


class Version(NamedTuple):
    name: str
    counts: dict[str, int]
    held_by: dict[str, str]  # bank -> the version that holds its files
    overlaps: dict[str, int] = {}  # what its banks share, where the build allowed that


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def _read(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place, then renamed over it."""
    draft = f"{path}.{uuid.uuid4().hex}"
    stream = _fs(spark, draft).create(_path(spark, draft), True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    at = _path(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, draft), at, options)


def version(spark: SparkSession, root: str, name: str | None = None) -> Version | None:
    """The version in use, or the named one; none where nothing was ever completed. A marker of another schema is refused."""
    if name is None:
        if not exists(spark, f"{root}/{POINTER}"):
            return None
        name = _read(spark, f"{root}/{POINTER}").strip()
    first, *rest = _read(spark, f"{root}/versions/{name}/{MARKER}").strip().split("\n")
    if first != f"schema={SCHEMA}":
        raise ValueError(f"version {name} of {root} has {first}, not schema={SCHEMA}")
    rows = [x.split("\t") for x in rest]
    at = f"{root}/versions/{name}/{SHARED}"
    shared = dict(x.split("\t") for x in _read(spark, at).strip().split("\n")) if exists(spark, at) else {}
    return Version(name, {b: int(n) for b, n, _ in rows}, {b: v for b, _, v in rows}, {k: int(n) for k, n in shared.items()})


def _folder(spark: SparkSession, path: str, what: str) -> str | None:
    """Of root/bank the folder that holds the bank's files or sessions now; none if that is no bank of a version."""
    root, _, bank = path.rstrip("/").rpartition("/")
    now = version(spark, root) if root else None
    if now is None or bank not in now.held_by:
        return None
    return f"{root}/versions/{now.held_by[bank]}/{what}/bank={bank}"


def files(spark: SparkSession, path: str) -> DataFrame | None:
    """(filename, sha256, h, h_mirror, image) of root/bank."""
    at = _folder(spark, path, "files")
    return spark.read.schema(f"filename string, sha256 string, {_PHOTO}").parquet(at) if at else None


def sessions(spark: SparkSession, path: str) -> str | None:
    """The folder of the sidecar of root/bank."""
    return _folder(spark, path, "sessions")


def squared(size: int) -> Callable[[Column], Column]:
    """image column -> (image, h, h_mirror): the centre square in ``size`` x ``size`` pixels, and its hashes."""

    @F.pandas_udf(_PHOTO)
    def run(image: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in image.to_dict("records"):
            a = I.from_row(r)
            a = I.resize(I.centre_square(a), size, size)
            rows.append((I.to_row(a, r["origin"] or ""), I.difference_hash(a), I.difference_hash(I.mirror(a))))
        return pd.DataFrame(rows, columns=["image", "h", "h_mirror"]) if rows else pd.DataFrame({"image": [], "h": np.zeros(0, np.int64), "h_mirror": np.zeros(0, np.int64)})

    return run


def prepared(items: DataFrame, size: int) -> DataFrame:
    """(bank, filename, session_id, context, sha256, h, h_mirror, image) of items (bank, photo, image, session_id, context).

    A row a photo, whatever its bytes; names are numbered in each bank by photo. A blank
    session is the photo's own.
    """
    keys = numbered(items.select("bank", "photo"), "bank", "photo")
    first = keys.groupBy("bank").agg(F.min("number").alias("_first"))
    names = keys.join(F.broadcast(first), "bank").withColumn("filename", F.format_string("%s_%03d.raw", "bank", F.col("number") - F.col("_first")))
    photo = items.select("bank", "photo", "session_id", "context", squared(size)("image").alias("p"))
    session = F.coalesce(F.nullif(F.trim("session_id"), F.lit("")), F.col("photo").cast("string"))
    data = F.sha2("p.image.data", 256)
    return names.join(photo, ["bank", "photo"]).select("bank", "filename", session.alias("session_id"), F.coalesce("context", F.lit("")).alias("context"), data.alias("sha256"), "p.h", "p.h_mirror", "p.image")


def overlaps(photos: DataFrame, train: str, held_out: str, anchors: Sequence[str], most: int) -> dict[str, int]:
    """What must be nothing: equal pictures of the two banks and the anchors; near pairs (of different hashes: copies count once) and common sessions of the two banks. photos: bank, session_id, sha256, h, h_mirror."""
    of = lambda *banks: photos.where(F.col("bank").isin(*banks))
    pair = of(train, held_out)
    left = of(held_out).select(F.col("h").alias("ha")).distinct().withColumn("a", F.monotonically_increasing_id())
    right = of(train).select(F.col("h").alias("hb"), F.col("h_mirror").alias("hb_mirror")).distinct().withColumn("b", F.monotonically_increasing_id())
    return {
        "exact": pair.join(of(*anchors).select("sha256").distinct(), "sha256", "left_semi").count() if anchors else 0,
        "perceptual": near_pairs(left, right, most).count(),
        "session": of(train).select("session_id").intersect(of(held_out).select("session_id")).count(),
    }


def build(
    items: DataFrame, root: str, *, size: int, required: Sequence[str], train: str = "trigger_train", held_out: str = "trigger_eval", most: int = 8, carry: Sequence[str] = (), retain: int = 1, refuse: bool = True
) -> Version:
    """Stage all banks of items as a new version, prove them disjoint, mark it complete, point at it, delete versions that nothing uses.

    ``carry``: banks of the present version that stay as they are. ``retain``: earlier versions
    that are kept for readers that still use them. Raises, and leaves the old version in
    use, if a required bank is empty or the proof fails. With ``refuse`` off banks that overlap are
    built whole all the same, for tables whose photos are given; the version says what they share.
    """
    spark = items.sparkSession
    old = version(spark, root)
    if carry and (old is None or (missing := set(carry) - set(old.held_by))):
        raise ValueError(f"banks to carry over are not there: {sorted(carry if old is None else missing)}")
    name = f"v{int(old.name[1:].split('-')[0]) + 1 if old else 1:06d}-{uuid.uuid4().hex[:8]}"
    at = f"{root}/versions/{name}"
    try:
        staged = prepared(items.where(~F.col("bank").isin(*carry)) if carry else items, size)
        staged.write.partitionBy("bank").parquet(f"{at}/staged")  # once: pictures are not made again for each of the tables
        staged = spark.read.schema(staged.schema).parquet(f"{at}/staged")
        staged.select("bank", "filename", "sha256", "h", "h_mirror", "image").write.partitionBy("bank").parquet(f"{at}/files")
        staged.select("bank", "filename", "session_id", "context").write.partitionBy("bank").option("header", True).csv(f"{at}/sessions")
        every = staged.select("bank", "session_id", "sha256", "h", "h_mirror")
        for bank in carry:
            own = files(spark, f"{root}/{bank}").join(spark.read.option("header", True).csv(sessions(spark, f"{root}/{bank}")), "filename")
            every = every.unionByName(own.select(F.lit(bank).alias("bank"), "session_id", "sha256", "h", "h_mirror"))
        counts = {r["bank"]: r["count"] for r in every.groupBy("bank").count().collect()}
        if empty := [b for b in required if not counts.get(b)]:
            raise ValueError(f"empty banks: {empty}")
        found = overlaps(every, train, held_out, [b for b in counts if b not in (train, held_out)], most)
        if any(found.values()):
            if refuse:
                raise ValueError(f"banks overlap: {found}")
            _put(spark, f"{at}/{SHARED}", "".join(f"{k}\t{n}\n" for k, n in found.items()))
        _fs(spark, at).delete(_path(spark, f"{at}/staged"), True)
        held_by = {b: old.held_by[b] if b in carry else name for b in sorted(counts)}
        _put(spark, f"{at}/{MARKER}", "\n".join([f"schema={SCHEMA}", *(f"{b}\t{counts[b]}\t{held_by[b]}" for b in sorted(counts))]) + "\n")
        _put(spark, f"{root}/{POINTER}", name + "\n")
    except BaseException:
        _fs(spark, at).delete(_path(spark, at), True)
        raise
    _clean(spark, root, retain)
    return version(spark, root)


def _clean(spark: SparkSession, root: str, retain: int) -> None:
    """Delete versions other than the one in use, the ``retain`` complete ones before it, and those that hold banks of these. Unfinished ones before the one in use are left from stopped builds."""
    now = version(spark, root)
    names = sorted(str(s.getPath().getName()) for s in _fs(spark, root).listStatus(_path(spark, f"{root}/versions")))
    before = [n for n in names if n < now.name]
    complete = [n for n in before if exists(spark, f"{root}/versions/{n}/{MARKER}")]
    keep = {now.name, *complete[len(complete) - retain :]} if retain else {now.name}
    used = keep | {v for n in keep for v in version(spark, root, n).held_by.values()}
    for n in before:
        if n not in used:
            _fs(spark, root).delete(_path(spark, f"{root}/versions/{n}"), True)
