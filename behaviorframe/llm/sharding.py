"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 .. n-1 in a total order (doc_id, then checksum and size):
a range partitioning sorts the narrow rows, each partition numbers its own, and
the partitions' counts (one row a partition) are added up. A four-round Feistel
network permutes the smallest even-bit domain that holds n; numbers that leave
0 .. n-1 walk on along their cycle. With p the permuted number, shard = p mod
shards and slot = p div shards, so any row's place can be computed from its
number alone, shard sizes differ by one row at most (law ``rows``) and the slots
of a shard have no gaps.

Defined cases: a null text has no bytes and checksum 0; null doc_ids come first;
repeated rows get numbers of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from behaviorframe.llm._common import documents, keep, partitions, pick

SHARDS, SEED, ROUNDS = 40, 20_240_229, 4
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _M3)) * _M1
        x = (x ^ (x >> _M3)) * _M2
    return x ^ (x >> _M3)


def feistel(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """A permutation of 0 .. n-1, for any n >= 1."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right + key) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]  # off the range: walk on along the cycle
    return out.astype(np.int64)


def number_rows(rows: DataFrame, order: list, parts: int) -> DataFrame:
    """rows with ``number`` 0 .. n-1 in the given total order and ``total`` n."""
    # the partition's id is written with its rows: no later job depends on how the ranges were drawn
    ranged = keep(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    every = W.orderBy("part")  # one row a partition
    starts = counts.select("part", (F.sum("n").over(every) - F.col("n")).alias("start"), F.sum("n").over(W.partitionBy()).alias("total"))
    # at most `parts` rows of three numbers
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("number", F.col("start") + F.col("inside")).drop("part", "inside", "start")


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: no key law), number."""
    named = pick(docs, id_col, text_col).toDF("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    narrow = named.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    rows = number_rows(narrow, order, partitions(docs.sparkSession))

    @F.pandas_udf("long")
    def permuted(number: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), int(total.iloc[0]), seed) if len(number) else number)

    rows = rows.withColumn("p", permuted("number", "total"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % shards).cast("int").alias("shard"),
        F.expr(f"p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "number",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).drop("number")


NAME = "op7_shard"
ORACLE = None  # the permutation works on unsigned 64-bit products; tested against a plain Python version
