"""Corpus preparation: usable documents, slices, chunks, crops, pairs, ordered dedup, shuffle and cap."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.functions.rand import shuffle_key, u01
from behaviorframe.params import CorpusParams
from behaviorframe.sources.shared import drop, keep


def usable(docs: DataFrame, min_words: int) -> DataFrame:
    return docs.where(X.n_words(F.col("text")) >= min_words)


def _range_counts(docs: DataFrame, low: int, high: int, min_words: int, ranges: int) -> list[tuple[int, int, int]]:
    """[(low, high, usable)] of equal ranges of doc_id in [low, high], in order, empty ones left out."""
    width = -(-(high - low + 1) // ranges)
    inside = docs.where(F.col("doc_id").between(low, high))
    at = F.expr(f"CAST((CAST(doc_id AS DECIMAL(20, 0)) - ({low})) div {width} AS INT)")
    counts = sorted(tuple(r) for r in usable(inside, min_words).groupBy(at.alias("at")).count().collect())
    return [(low + k * width, min(high, low + (k + 1) * width - 1), n) for k, n in counts]


def usable_index(docs: DataFrame, min_words: int, ranges: int = 4096) -> list[tuple[int, int, int]]:
    """[(low, high, usable)]: how many usable documents each range of doc_id holds; at most ``ranges`` rows, made once for many slices."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return [] if low is None else _range_counts(docs, low, high, min_words, ranges)


def slice_usable(docs: DataFrame, skip: int, take: int, min_words: int, index: list[tuple[int, int, int]] | None = None, most: int = 100_000, ranges: int = 4096) -> DataFrame:
    """The first max(take, 1) usable documents after ``skip`` usable ones, by doc_id (documents without one have no place in the order).

    The index says which ranges of doc_id hold them; only these are read, by a filter that
    reaches the scan. A first or last range with over ``most`` usable documents is
    counted again in narrower ranges, so what is sorted is bounded by the slice, not by what is skipped.
    """
    index = usable_index(docs, min_words, ranges) if index is None else index
    first, last = skip + 1, skip + max(take, 1)
    while True:
        before, hit = 0, []
        for low, high, n in index:
            if before < last and before + n >= first:
                hit.append((low, high, n, before))
            before += n
        large = [x for x in (hit[0], hit[-1]) if x[2] > most and x[0] < x[1]] if hit else []
        if not large:
            break
        for low, high, n, _ in set(large):
            at = index.index((low, high, n))
            index = [*index[:at], *_range_counts(docs, low, high, min_words, ranges), *index[at + 1 :]]
    if not hit:
        return usable(docs, min_words).where(F.lit(False))
    inside = docs.where(F.col("doc_id").between(hit[0][0], hit[-1][1]))
    return usable(inside, min_words).orderBy("doc_id", "text").offset(skip - hit[0][3]).limit(max(take, 1))


def chunk(docs: DataFrame, target: int, least: int) -> DataFrame:
    """(doc_id, chunk, text): windows of ``target`` words; shorter texts stay verbatim; windows under ``least`` words go."""
    w = docs.select("doc_id", "text", X.words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(target))
    whole = F.when(F.size("w") <= target, F.array(F.struct(F.size("w").alias("n"), F.col("text").alias("t"))))
    parts = F.transform(starts, lambda i: F.struct(F.least(F.lit(target), F.size("w") - i).alias("n"), F.concat_ws(" ", F.slice("w", i + 1, target)).alias("t")))
    # no filter on the words: pushed down, it would split each text a second time
    every = w.select("doc_id", F.posexplode(F.when(F.size("w") > 0, F.coalesce(whole, parts))).alias("chunk", "c"))
    return every.where(F.col("c.n") >= least).select("doc_id", "chunk", F.col("c.t").alias("text"))


def crops(windows: DataFrame, p: CorpusParams) -> DataFrame:
    """(doc_id, chunk, crop, text): random sub-spans of at least min_words words of each window that is longer."""
    w = windows.select("doc_id", "chunk", X.words(F.col("text")).alias("w"))
    n = F.size("w")
    # once a window, and no filter that would split it again
    w = w.select("doc_id", "chunk", "w", F.explode(F.when(n > p.min_words, F.sequence(F.lit(1), F.lit(p.crops)))).alias("crop"))
    draw = lambda what: u01(p.seed, F.lit(what), "doc_id", "chunk", "crop")
    length = (p.min_words + F.floor(draw("length") * (n - p.min_words + 1))).cast("int")
    w = w.withColumn("length", length)
    start = F.floor(draw("start") * (n - F.col("length") + 1)).cast("int")
    return w.select("doc_id", "chunk", "crop", F.concat_ws(" ", F.slice("w", start + 1, F.col("length"))).alias("text"))


def numbered(df: DataFrame, *order: str, hashed: bool = False) -> DataFrame:
    """df with ``number`` 0, 1, ... in the given total order, by range partitions and their counts instead of one global window.

    The partition's id is written with its rows once: the counts and the rows come from
    the same ranges, whose bounds are drawn anew in every job. ``hashed``: the first column of the order is a
    hexadecimal hash; its first digits are the ranges, and no sample of df is computed beforehand.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hashed:
        at = F.floor(F.conv(F.substring(order[0], 1, 6), 16, 10).cast("long") * parts / (1 << 24)).cast("int")
        ranged = df.withColumn("_part", at).repartition(parts, "_part")
    else:
        ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = keep(ranged, "numbered")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))  # one row a partition
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_part").withColumn("number", F.col("_start") + F.col("_inside")).drop("_part", "_start", "_inside")


def pair_keys(windows: DataFrame, p: CorpusParams) -> DataFrame:
    """(pair, side, doc_id, chunk): which two distinct windows each of floor(n * probability) pairs joins. Only keys are numbered and drawn."""
    every = numbered(windows.select("doc_id", "chunk"), "doc_id", "chunk")
    n = every.count()
    if n < 2:
        return every.where(F.lit(False)).select(F.lit(0).cast("long").alias("pair"), F.lit(0).alias("side"), "doc_id", "chunk")
    draws = windows.sparkSession.range(int(n * p.concat_probability)).withColumnRenamed("id", "pair")
    first = F.floor(u01(p.seed, F.lit("first"), "pair") * n).cast("long")
    gap = F.floor(u01(p.seed, F.lit("second"), "pair") * (n - 1)).cast("long")
    ends = F.array(F.struct(F.lit(0).alias("side"), first.alias("number")), F.struct(F.lit(1).alias("side"), ((first + 1 + gap) % n).alias("number")))
    return draws.select("pair", F.explode(ends).alias("e")).select("pair", "e.*").join(every, "number").select("pair", "side", "doc_id", "chunk")


def pair_texts(windows: DataFrame, drawn: DataFrame) -> DataFrame:
    """(pair, text): the drawn windows one after the other; a text moves once for each pair it is in."""
    both = drawn.join(windows.select("doc_id", "chunk", "text"), ["doc_id", "chunk"]).groupBy("pair")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("text")))
    return both.agg(side(0).alias("ta"), side(1).alias("tb")).select("pair", F.concat_ws(" ", "ta", "tb").alias("text"))


def concat_pairs(windows: DataFrame, p: CorpusParams) -> DataFrame:
    """(pair, text): floor(n * probability) concatenations of two distinct windows. The windows are read three times; keep() those that are dear to make."""
    return pair_texts(windows, pair_keys(windows, p))


def ordered_dedup(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each non-empty key. Pre-aggregated: only order and digest meet per group, so a hot key is no hot task.

    Rows are found again by digest and order together; a null order comes first; of rows
    that are equal in both one stays.
    """
    on = ["_digest", "_order"]  # nulls inside a struct are equal to each other
    keyed = df.withColumn("_key", key).where(F.length("_key") > 0).withColumns({"_digest": F.sha2("_key", 256), "_order": F.struct(*order)})
    kept = keyed.groupBy("_digest").agg(F.min("_order").alias("_order"))
    return keyed.join(kept, on, "left_semi").dropDuplicates(on).drop("_key", *on)


def _from_windows(windows: DataFrame) -> DataFrame:
    return windows.select(F.lit(0).alias("kind"), *_as_long("doc_id", "chunk"), F.lit(0).cast("long").alias("c"), "text")


def _from_crops(cropped: DataFrame) -> DataFrame:
    return cropped.select(F.lit(1).alias("kind"), *_as_long("doc_id", "chunk", "crop"), "text")


def _from_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.lit(2).alias("kind"), F.col("pair").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), "text")


def _as_long(*columns: str) -> list[Column]:
    return [F.col(x).cast("long").alias(n) for x, n in zip(columns, "abc")]


def augment(docs: DataFrame, p: CorpusParams) -> DataFrame:
    """(kind, a, b, c, text): windows, crops and pairs together, in this order."""
    windows = keep(chunk(docs, p.target_words, p.min_words), "windows")  # split once, read by all three
    return _from_windows(windows).unionByName(_from_crops(crops(windows, p))).unionByName(_from_pairs(concat_pairs(windows, p)))


def first_by_hash(keys: DataFrame, most: int, h: str, *ties: str) -> DataFrame:
    """The ``most`` rows with the smallest hashes (hexadecimal text), ties by columns.

    Counts of the hashes' first three digits (at most 4,096 rows) say in which of
    these buckets the last one lies; only that bucket's rows are ranked.
    """
    digits = F.substring(h, 1, 3)
    wanted, last = most, None
    for own, n in sorted(tuple(r) for r in keys.groupBy(digits.alias("d")).count().collect()):
        if wanted <= n:
            last = own
            break
        wanted -= n
    if last is None:
        return keys
    return keys.where(digits < last).unionByName(keys.where(digits == last).orderBy(h, *ties).limit(wanted))


def augmented_passages(docs: DataFrame, p: CorpusParams) -> DataFrame:
    """(kind, a, b, c, h, text): the whole chain. Windows, crops and pairs, the first of each stripped text, shuffled by hash and cut to max_passages; order by h, kind, a, b, c.

    Texts are looked at twice and moved for pairs only: digests and keys go through the
    dedup and the cap, then the texts of the keys that are left are made again. Documents
    without an id have no place in the order and stay out.
    """
    keys = ["kind", "a", "b", "c"]
    windows = keep(chunk(docs.where("doc_id IS NOT NULL"), p.target_words, p.min_words), "windows")
    drawn = keep(pair_keys(windows, p), "pairs")

    def digested(own: DataFrame, cropped: DataFrame, pairs: DataFrame) -> DataFrame:
        every = _from_windows(own).unionByName(_from_crops(crops(cropped, p))).unionByName(_from_pairs(pair_texts(windows, pairs)))
        every = every.withColumn("text", X.stripped(F.col("text"))).where("text <> ''")
        return every.withColumn("digest", F.sha2("text", 256))

    first = digested(windows, windows, drawn).groupBy("digest").agg(F.min(F.struct(*keys)).alias("key")).select("digest", "key.*")
    first = keep(first.withColumn("h", shuffle_key(p.seed, *keys)), "first")
    chosen = keep(first_by_hash(first, p.max_passages, "h", *keys), "chosen")
    drop(first)
    of = lambda kind, *names: chosen.where(F.col("kind") == kind).select(*(F.col(c).alias(n) for c, n in zip("abc", names))).distinct()
    window = ["doc_id", "chunk"]
    made = digested(windows.join(of(0, *window), window, "left_semi"), windows.join(of(1, *window), window, "left_semi"), drawn.join(of(2, "pair"), "pair", "left_semi"))
    on = [*keys, "digest"]
    return chosen.join(made, on).dropDuplicates(on).select(*keys, "h", "text")


def containing(docs: DataFrame, items: DataFrame, grams: int = 4) -> DataFrame:
    """(item_id, doc_id) of the documents (doc_id, text) that contain an item (item_id, item) verbatim; empty items are in every text and left out.

    An equi-join on one anchor of each item, then the check of the candidates. The anchor
    is the item's inner word that the fewest documents hold (its outer words may be parts of
    longer ones in a document); one that no document holds ends the search. Items without an
    inner word are anchored at the rarest of their stretches of ``grams`` characters (the whole
    item, if it is shorter). Texts are read once to count anchors, which is aggregated where they are
    read, and once for the chosen ones; only keys are joined before the texts of the candidates.
    """
    items = items.where("item <> ''")
    parts = F.split("item", r"[^\p{L}]+")
    inner = F.array_distinct(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
    inner = F.filter(inner, lambda w: w != "")
    length = F.least(F.lit(grams), F.length("item"))
    stretches = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("item") - length + 1), lambda i: F.substring(F.col("item"), i, length)))
    kinds = keep(items.select("item_id", "item", F.when(F.size(inner) > 0, inner).otherwise(stretches).alias("anchors"), F.when(F.size(inner) > 0, 0).otherwise(length).alias("size")), "items")
    asked = kinds.select("item_id", "size", F.explode("anchors").alias("anchor"))
    sizes = sorted(r[0] for r in kinds.select("size").distinct().collect())  # words, and at most ``grams`` lengths
    if not sizes:
        return docs.select(F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), "doc_id").where(F.lit(False))

    def anchors(size: int) -> DataFrame:
        """The distinct words (size 0) or stretches of so many characters of each text."""
        places = F.sequence(F.lit(1), F.length("text") - size + 1)
        own = F.transform(places, lambda i: F.substring(F.col("text"), i, F.lit(size))) if size else F.split("text", r"[^\p{L}]+")
        return docs.where(F.length("text") >= max(1, size)).select("doc_id", F.lit(size).alias("size"), F.explode(F.array_distinct(own)).alias("anchor"))

    def every(joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [joined(anchors(size)) for size in sizes])

    on = ["size", "anchor"]
    wanted = asked.select(*on).distinct()
    counts = every(lambda x: x.join(wanted, on, "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("n")))
    rarest = asked.join(counts, on, "left").groupBy("item_id", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("least"))
    chosen = keep(rarest.where("least.n > 0").select("item_id", "size", F.col("least.anchor").alias("anchor")), "chosen")
    met = every(lambda x: x.join(chosen, on).select("doc_id", "item_id")).distinct().join(kinds.select("item_id", "item"), "item_id")
    return met.join(docs, "doc_id").where(F.contains("text", "item")).select("item_id", "doc_id")


def shuffled(df: DataFrame, seed: str, most: int, *keys: str) -> DataFrame:
    """A seeded shuffle, capped: a bounded top-k by hash with the keys as tie-break."""
    return df.withColumn("_h", shuffle_key(seed, *keys)).orderBy("_h", *keys).limit(most).drop("_h")


def sample_round_robin(df: DataFrame, group: str, most: int, seed: str, key: str) -> DataFrame:
    """Depth first across groups: everyone's first, then everyone's second, up to ``most`` rows.

    A group's rows beyond ``most`` can never be taken, so each is cut to its
    first ``most`` by a bounded pre-ranking within salted sub-groups.
    """
    h = df.withColumn("_h", shuffle_key(seed, key)).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(32)))
    inner = F.row_number().over(W.partitionBy(group, "_salt").orderBy("_h", key))
    few = h.withColumn("_r", inner).where(F.col("_r") <= most)
    ranked = few.withColumn("depth", F.row_number().over(W.partitionBy(group).orderBy("_h", key)))
    return ranked.orderBy("depth", group).limit(most).drop("_h", "_salt", "_r")
