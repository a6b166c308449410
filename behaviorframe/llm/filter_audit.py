"""Filter interaction audit over every order of the filters, with fingerprint-routed exact duplicates.

1. Each task reads whole texts, decides the row filters once a distinct text and
   holds *chains*: by xxhash64 of the text, every different text with that
   fingerprint, its smallest id and how many rows of it each part has. A row that is
   not the smallest of its own task is emitted at once without its text, so a group
   of copies costs one text a task however large it is. Chains are sent on whenever
   they hold ``HELD`` bytes.
2. An RDD partitions the chains by the fingerprint, in as many partitions as the
   bytes of all texts ask for; there the chains are merged by full text, so equal
   fingerprints of different texts stay apart. Ids that are not the smallest fail the
   duplicate filter.
3. The narrow (doc_id, part, mask, n) table is written; bit k of a mask says that
   filter k fails. Labels are joined to it, and ``combineByKey`` merges one vector of
   counts by mask a part, summed in each task before it is shuffled.
4. From a part's vector all orders, steps and Shapley sums follow.

Defined cases: a null text counts as empty; a null part is the empty string; a null
doc_id is neither smaller nor larger than another, so such a row never fails the
duplicate filter and makes no other fail, and has no labels; of repeated rows (equal
doc_id and text) none is smaller, so all of them fail or none; several label rows of
one document count as one that has each label if any of them has; other columns are
ignored; an empty table gives an empty result; very long texts count whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from behaviorframe.llm._common import documents, drop, keep, partitions, pick

#: Bytes of text that a task holds before it sends its chains on; bytes of text that a partition of the routed chains should hold.
HELD, ROUTED = 32 << 20, 64 << 20
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))  # every code point has one byte that is not of these


def _words_and_counts(text: bytes) -> tuple[int, int, int, int]:
    words = text.split()  # at space and the controls tab to carriage return
    return len(words), len(set(words)), len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _CONTINUED))


def standard_filters(text: bytes) -> str:
    """The letters of the row filters that a text (UTF-8) fails: A short, B repetitive, C shouting, D signs."""
    words, distinct, capitals, points = _words_and_counts(text)
    failed = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * points, "D": len(text.translate(None, _SIGNS)) < len(text)}
    return "".join(k for k, v in failed.items() if v)


class _Chains:
    """By fingerprint the different texts that share it, each with its smallest id, its mask and its rows by part."""

    def __init__(self, duplicate: int) -> None:
        self.duplicate, self.by, self.bytes = duplicate, {}, 0

    def find(self, fingerprint: int, text: bytes) -> list | None:
        return next((x for x in self.by.get(fingerprint, ()) if x[0] == text), None)

    def add(self, fingerprint: int, text: bytes, doc_id: object, mask: int, parts: dict[str, int]) -> Iterator[tuple]:
        """Takes rows of one id in; yields (id, mask, parts) of those that are now known not to be the smallest."""
        held = self.find(fingerprint, text)
        if held is None:
            self.by.setdefault(fingerprint, []).append([text, doc_id, mask, dict(parts)])
            self.bytes += len(text) + 200
        elif doc_id == held[1]:
            for part, n in parts.items():
                held[3][part] = held[3].get(part, 0) + n
        elif doc_id < held[1]:
            yield held[1], held[2] | self.duplicate, held[3]
            held[1], held[3] = doc_id, dict(parts)
        else:
            yield doc_id, mask | self.duplicate, parts

    def flush(self) -> Iterator[tuple[int, list]]:
        for fingerprint, chain in self.by.items():
            for entry in chain:
                yield fingerprint, entry
        self.by, self.bytes = {}, 0


def _spread(doc_id: object) -> int:
    return zlib.crc32(repr(doc_id).encode())


def _local(rows: Iterator[Row], letters: str, decide: Callable[[bytes], str], held: int) -> Iterator[tuple[int, tuple]]:
    """(key, (text or None, id, mask, parts)): without a text, a row whose mask is settled."""
    chains = _Chains(1 << (len(letters) - 1))
    for doc_id, text, part, fingerprint in rows:
        text = bytes(text)
        entry = chains.find(fingerprint, text)
        mask = entry[2] if entry else sum(1 << letters.index(k) for k in decide(text))
        if doc_id is None:
            yield _spread((fingerprint, chains.bytes)), (None, None, mask, {part: 1})
            continue
        for i, m, parts in chains.add(fingerprint, text, doc_id, mask, {part: 1}):
            yield _spread(i), (None, i, m, parts)
        if chains.bytes >= held:
            yield from ((f, tuple(e)) for f, e in chains.flush())
    yield from ((f, tuple(e)) for f, e in chains.flush())


def _merged(routed: Iterator[tuple[int, tuple]], duplicate: int) -> Iterator[tuple]:
    chains = _Chains(duplicate)
    for fingerprint, (text, doc_id, mask, parts) in routed:
        settled = [(doc_id, mask, parts)] if text is None else chains.add(fingerprint, text, doc_id, mask, parts)
        for i, m, own in settled:
            yield from ((i, part, m, n) for part, n in own.items())
    for _, (_, doc_id, mask, parts) in chains.flush():
        yield from ((doc_id, part, mask, n) for part, n in parts.items())


def masks(
    docs: DataFrame, *, letters: str = "ABCDE", decide: Callable[[bytes], str] = standard_filters, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", held: int = HELD
) -> DataFrame:
    """doc_id, part, mask, n: bit k of mask is set where letters[k] fails (the last letter: the text is one of a smaller id); n equal rows of one id and part."""
    spark = docs.sparkSession
    kind = docs.schema[docs.columns.index(id_col)].dataType
    named = pick(docs, id_col, text_col, part_col).toDF("doc_id", "text", "part")
    named = named.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-total // ROUTED))
    rows = named.withColumn("fingerprint", F.xxhash64("text")).rdd
    routed: RDD = rows.mapPartitions(lambda it: _local(it, letters, decide, held)).partitionBy(n)
    settled = routed.mapPartitions(lambda it: _merged(it, 1 << (len(letters) - 1)))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
    return spark.createDataFrame(settled, schema, verifySchema=False)


def _labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic of the written narrow table; rows without an id have no partner and stay out of the join."""
    flags = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id")
    flags = flags.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    joined = found.where("doc_id IS NOT NULL").join(flags, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    return joined.union(found.where("doc_id IS NULL").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("bad")))


def mask_counts(found: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> RDD:
    """(part, array of [rows, good, toxic] by mask), merged by combineByKey."""
    shape = (1 << len(letters), 3)

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[mask] += (n, n * good, n * toxic)
        return counts

    keyed = _labelled(found, labels).rdd.map(lambda r: (r[0], tuple(r[1:])))
    return keyed.combineByKey(lambda row: add(np.zeros(shape, np.int64), row), add, lambda a, b: a + b, partitions(found.sparkSession))


def interactions(counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    every = np.arange(len(counts))
    failing = {k: (every >> i) & 1 == 1 for i, k in enumerate(letters)}
    orders, memo = ["".join(o) for o in permutations(letters)], {}

    def at(before: frozenset, k: str) -> tuple[int, int, int, int, int]:
        if (before, k) not in memo:
            gone = np.logical_or.reduce([failing[b] for b in before]) if before else np.zeros(len(counts), bool)
            lost = counts[failing[k] & ~gone].sum(0)
            memo[before, k] = int(counts[~gone & ~failing[k], 0].sum()), int(lost[0]), int(counts[failing[k] & gone, 0].sum()), int(lost[1]), int(lost[2])
        return memo[before, k]

    shapley = {k: sum(at(frozenset(o[: o.index(k)]), k)[1] for o in orders) for k in letters}
    for order in orders:
        for step, k in enumerate(order, 1):
            kept, removed, redundant, good, toxic = at(frozenset(order[: step - 1]), k)
            yield order, step, kept, removed, redundant, int(counts[1 << letters.index(k), 0]), good, toxic, shapley[k]


_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_COUNTS = "part string, counts array<long>"


def filter_audit(docs: DataFrame, labels: DataFrame, *, letters: str = "ABCDE", decide: Callable[[bytes], str] = standard_filters, part_col: str = "source") -> DataFrame:
    """A row a part, order of the filters and step."""
    spark = docs.sparkSession
    found = keep(masks(docs, letters=letters, decide=decide, part_col=part_col), "masks")
    vectors = keep(spark.createDataFrame(mask_counts(found, labels, letters).map(lambda x: (x[0], x[1].ravel().tolist())), _COUNTS, verifySchema=False), "mask_counts")
    drop(found)
    rows = vectors.rdd.flatMap(lambda r: ((r[0], *x) for x in interactions(np.array(r[1], np.int64).reshape(-1, 3), letters)))
    return spark.createDataFrame(rows, _RESULT, verifySchema=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


NAME = "op13_filter_audit"
ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM d LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT f1.k || f2.k || f3.k || f4.k || f5.k AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
      FROM f f1 JOIN f f2 ON f2.k <> f1.k JOIN f f3 ON f3.k NOT IN (f1.k, f2.k) JOIN f f4 ON f4.k NOT IN (f1.k, f2.k, f3.k) JOIN f f5 ON f5.k NOT IN (f1.k, f2.k, f3.k, f4.k)),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
