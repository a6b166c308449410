"""Exact deduplication with a heavy-hitter split.

1. One pass turns every whole text into its SHA-256 and writes the narrow
   (doc_id, row, digest) table to the shared folder.
2. Misra-Gries: each task keeps at most ``counters`` digests; the mergeable
   summaries are folded in two more rounds. Every digest held by more than
   rows / (counters + 1) rows is guaranteed to be among the survivors.
3. Those few candidates are verified by an exact count, and the winners
   (at most ``counters`` rows, so a proven bound) are broadcast: their rows are
   labelled on the map side and never meet in one task.
4. All other digests go through an ordinary partially aggregated shuffle; none
   of their groups is larger than rows / (counters + 1).

Defined cases: a null text counts as empty; a null doc_id is smaller than any
other; of repeated rows (equal doc_id and text) exactly one stays; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.llm._common import documents, keep, null_safe, pick, text_key

COUNTERS = 1024


def _prune(counts: pd.Series, counters: int) -> pd.Series:
    """Misra-Gries on merged counts: take off the (counters + 1)-th largest count from all, drop what reaches zero."""
    if len(counts) <= counters:
        return counts
    cut = counts.nlargest(counters + 1).iloc[-1]
    counts = counts - cut
    return counts[counts > 0]


def misra_gries(digests: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """(column, n): a superset of the values that more than rows / (counters + 1) rows hold; at most ``counters`` rows."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for b in batches:
            held = _prune(held.add(b.groupby(column)["n"].sum(), fill_value=0).astype("int64"), counters)
        if len(held):
            yield pd.DataFrame({column: held.index, "n": held.to_numpy()})

    schema = f"`{column}` binary, n long"
    out = digests.select(column, F.lit(1).cast("long").alias("n")).mapInPandas(fold, schema)
    # each round takes at most `counters` rows a task; the last folds at most 32 * counters rows
    return out.repartition(32).mapInPandas(fold, schema).repartition(1).mapInPandas(fold, schema)


def _grouped(keys: DataFrame) -> DataFrame:
    top = F.max(F.struct("doc_id", "row")).alias("top")  # a null doc_id is the smallest
    return keys.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), top)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, row, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    named = pick(docs, id_col, text_col).toDF("doc_id", "text")
    # the numbers are written with their rows and serve inside this table only
    keys = keep(named.select("doc_id", F.monotonically_increasing_id().alias("row"), text_key(F.col("text")).alias("digest")), "digests")
    candidates = misra_gries(keys, "digest", counters).select("digest")
    bounded = F.broadcast(spark.createDataFrame(candidates.collect(), candidates.schema))  # at most `counters` rows of 32 bytes
    frequent = keep(_grouped(keys.join(bounded, "digest", "left_semi")), "frequent")
    hot = keys.join(F.broadcast(frequent), "digest")
    rest = keys.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    rest = rest.join(_grouped(rest), "digest")
    return hot.unionByName(rest).select(
        "doc_id", "row", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with all their columns.

    They are found again by doc_id and digest. Defined cases: null and empty texts are
    equal; a null doc_id stays only in a group without any other; of repeated rows
    (equal doc_id and text) one stays, with one row's other columns; very long texts
    count whole; an empty table gives an empty one.
    """
    names = docs.columns
    on = ["_digest", "_id", "_null"]
    kept = exact_dedup(docs).where("kept").select(F.unhex("text_sha256").alias("_digest"), *(c.alias(n) for c, n in zip(null_safe(F.col("doc_id")), on[1:])))
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    doc_id, text = (F.col(f"_c{names.index(x)}") for x in ("doc_id", "text"))
    plain = plain.withColumns(dict(zip(on, [text_key(text), *null_safe(doc_id)])))
    # the join's own partitioning and order serve for the repeated rows
    return plain.join(kept, on, "left_semi").dropDuplicates(on).drop(*on).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


NAME = "op2_exact_dedup"
ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
