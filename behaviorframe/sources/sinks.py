"""Writers: passages, probe shards, grid documents, completeness markers, the report. Image banks: banks.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorframe.functions import text as X

MARKER_SCHEMA = 2


def write_passages(df: DataFrame, path: str) -> None:
    """One normalised passage a line."""
    df.select(X.normalise(F.col("text")).alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def write_shards(df: DataFrame, path: str, shards: int, key: str) -> None:
    """JSON lines in ``shards`` folders by pmod(key, shards)."""
    df.withColumn("shard", F.pmod(F.col(key), F.lit(shards))).write.mode("overwrite").partitionBy("shard").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A one-row nested result as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def completeness(banks: DataFrame, required: list[str]) -> DataFrame:
    """(bank, n, complete): counts of every required bank, absent ones as 0."""
    counts = banks.groupBy("bank").agg(F.count(F.lit(1)).alias("n"))
    wanted = banks.sparkSession.createDataFrame([(b,) for b in required], "bank string")
    return wanted.join(counts, "bank", "left").select("bank", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("complete"))


def mark_complete(banks: DataFrame, required: list[str], path: str) -> None:
    """Write the marker last, and only if no required bank is empty."""
    rows = completeness(banks, required).orderBy("bank").collect()
    if empty := [r["bank"] for r in rows if not r["complete"]]:
        raise ValueError(f"empty banks: {empty}")
    lines = [f"schema={MARKER_SCHEMA}", *(f"{r['bank']}={r['n']}" for r in rows)]
    spark = banks.sparkSession
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def report(by_category: DataFrame, violations: DataFrame, title: str = "Probe report") -> str:
    """Markdown from two small aggregates: (category, n, fired, violations) and (violation, n)."""
    share = lambda k, n: "—" if not n else f"{100 * k / n:.1f}%"
    rows = by_category.orderBy("category").collect()
    lines = [f"# {title}", "", "| category | n | fired | rate | violations |", "|---|---|---|---|---|"]
    lines += [f"| {r['category']} | {r['n']} | {r['fired']} | {share(r['fired'], r['n'])} | {r['violations']} |" for r in rows]
    lines += ["", "| violation | n |", "|---|---|"]
    lines += [f"| {r['violation']} | {r['n']} |" for r in violations.orderBy("violation").collect()]
    return "\n".join(lines) + "\n"
