"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Weights follow the code-point order of the sources (1, 2, 3, repeating; null
last). A source's cap is ``max_epochs`` times its size. Water-filling: sources
whose proportional share exceeds their cap are clamped there and the excess is
reshared by weight. With the sources sorted by cap / weight the fixed point has
a closed form: the clamped sources are the longest prefix in which each one's
share of what is left exceeds its cap. All sums are integers, so reruns and
other engines agree to the last bit.

A source at target t takes floor(t / size) whole repetitions of each document;
the fraction that is left is taken in the order of md5(seed|doc_id) (without a
doc_id: the text's digest), up to the
document whose middle passes it. That running sum is computed in two levels
(sums of at least 4,096 hash buckets a source, then rows within a bucket), so a
source with a third of all rows is never in one task.

Defined cases: a null text has size 0; a source of size 0 has target 0; rows
without source form the last source; repeated rows count each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from behaviorframe.llm._common import WORD, documents, keep, null_safe, pick, text_key

MAX_EPOCHS, SEED = 3, "mix-1"
#: Documents up to which a source has 4,096 hash buckets; beyond, 16 times as many, and so on.
ROWS = 1_000_000_000


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target: one row per source, so the windows below see as many rows as there are sources."""
    ranked = sources.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    steps = ranked.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("shares"),
        F.row_number().over(order).alias("nth"),
    )
    fits = F.when(F.col("weight") * F.col("left") <= F.col("cap") * F.col("shares"), F.struct("nth", "left", "shares"))
    level = F.min(fits).over(whole)  # the first source that isn't clamped; those after it aren't either
    steps = steps.withColumn("level", level)
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.shares").cast("double")
    return steps.select("source", "source_size", F.when(F.col("nth") < F.col("level.nth"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, seed: str = SEED, with_digest: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (repetitions of the document), taken (words)[, digest]."""
    named = pick(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit(""))))  # documents without doc_id aren't all in one bucket
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), unnamed)))
    digest = [text_key(F.col("text")).alias("digest")] if with_digest else []
    sized = keep(named.select("doc_id", "source", size.alias("size"), key.alias("key"), *digest), "sized")
    digits = 3 + max(0, math.ceil(math.log(max(1, sized.count()) / ROWS, 16)))
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))

    buckets = keep(sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "buckets")
    targets = keep(water_fill(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), max_epochs), "targets")
    # 4,096 rows a source, or more where there are over ROWS documents
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.select("source", "bucket", earlier.alias("start"))
    starts = starts.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    starts = starts.withColumnsRenamed({"source": "_s", "bucket": "_b"})

    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0))
    rows = sized.withColumn("inside", inside).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    passed = 2 * (F.col("start") + F.col("inside")) - F.col("size")  # twice the words up to the document's middle
    rows = rows.withColumn("whole", whole.cast("long"))
    rows = rows.withColumn("copies", F.col("whole") + F.when((rest > 0) & (passed <= 2 * rest), F.lit(1)).otherwise(F.lit(0)))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"), *["digest"] * with_digest
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with all their columns: each as often as the mix takes it.

    They are found again by doc_id, source and digest. Defined cases: a null or wordless
    text has size 0 and comes as often as the whole repetitions of its source, and once more
    if its place lies in the rest; repeated rows come together as often as the mix
    takes them, with one row's other columns; rows without source are a source; a source
    of size 0 gives nothing; an empty table gives an empty one.
    """
    names = docs.columns
    on = ["_digest", "_id", "_null", "_source", "_none"]
    key = lambda doc_id, source, digest: dict(zip(on, [digest, *null_safe(doc_id), *null_safe(source)]))
    taken = mix(docs, with_digest=True).withColumns(key(F.col("doc_id"), F.col("source"), F.col("digest")))
    taken = taken.groupBy(*on).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    doc_id, source, text = (F.col(f"_c{names.index(x)}") for x in ("doc_id", "source", "text"))
    found = plain.withColumns(key(doc_id, source, text_key(text))).join(taken, on).dropDuplicates(on)
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop(*on, "_copies", "_copy").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


NAME = "op3_mix_sources"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap,
         row_number() OVER w AS nth,
         CAST(sum(source_size) OVER () - coalesce(sum({MAX_EPOCHS} * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
         CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shares
  FROM s WINDOW w AS (ORDER BY {MAX_EPOCHS} * source_size / weight, source NULLS LAST)),
l AS (SELECT nth AS n0, remaining AS r0, shares AS s0 FROM o WHERE weight * remaining <= cap * shares ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN nth < n0 THEN CAST(cap AS DOUBLE) ELSE CAST(weight * r0 AS DOUBLE) / CAST(s0 AS DOUBLE) END AS target FROM o, l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(2 * sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS passed
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND passed <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
