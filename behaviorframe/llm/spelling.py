"""Spelling variant grouping by rolling-hash deletions.

1. Runs of letters of whole texts are counted by a partially aggregated shuffle (JVM
   side); the words with enough letters and occurrences are written with numbers.
2. Deletion keys: over a block of words at once, prefix and suffix polynomial hashes
   give the 64-bit hash of every word without its i-th letter by a few NumPy integer
   operations, in time linear in the letters. Keys of three kinds: the word itself and
   a longer word without a letter (equal: one inserted letter), and a word without its
   letter i together with i and its length (equal: one replaced letter).
3. The keys are partitioned by their leading bits and sorted as integers; a task reads
   its sorted keys as a stream and passes on those that meet another word.
4. Collisions are verified on strings: words are joined to the keys that met, and only
   equal deleted strings (at an equal place, where a letter was replaced) stay together.
   A replaced letter's group has at most one word for each letter of the alphabet, a
   word's longer neighbours at most that many for each place. No pairs are made: two
   near words meet in exactly one group, so counts and the largest neighbour follow
   from windows over the groups.
5. Forms have at least twice the occurrences, so chains of forms are no longer than the
   logarithm of the largest count; pointer doubling finds their ends.

Defined cases: a null text has no words; a null doc_id counts as the empty string where
the query thins words; repeated rows count again; an empty table gives an empty result;
ties between neighbours of equal count go to the smallest in code-point order; very long
words are handled by hash and take part whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorframe.llm._bytes import mixed
from behaviorframe.llm._common import documents, drop, keep, partitions, pick

LETTERS = "[A-Za-zÀ-ÿ]+"
LENGTH, OCCURRENCES, TIMES, EVERY = 5, 3, 2, 97
#: Letters that are hashed together (a longer word alone); keys that a partition should hold.
BLOCK, KEYS = 500_000, 4_000_000
WORD, SHORTER, REPLACED = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH, _PLACE, _REPLACED = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def thinned(doc_id: Column, word: Column, every: int = EVERY) -> Column:
    """The word, without one letter where the crc32 of `doc_id:word` is a multiple of ``every``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def occurrences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """word, n: all runs of letters; with ``every``, thinned."""
    named = pick(docs, id_col, text_col).toDF("doc_id", "text")
    runs = named.select("doc_id", F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(LETTERS), F.lit(0))).alias("word"))
    word = thinned(F.col("doc_id"), F.col("word"), every) if every else F.col("word")
    return runs.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _blocks(words: list[str]) -> Iterator[range]:
    low = size = 0
    for k, w in enumerate(words):
        if size and size + len(w) > BLOCK:
            yield range(low, k)
            low = k
            size = 0
        size += len(w)
    if low < len(words):
        yield range(low, len(words))


def deletion_keys(words: list[str]) -> Iterator[tuple[range, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By block of words (each with a letter): its range, and of its keys the word's place in the block, the place of the letter, the kind and the hash."""
    for block in _blocks(words):
        own = [words[i] for i in block]
        letters = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) for w in own])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        word = np.repeat(np.arange(len(own)), lengths)
        place = np.arange(len(letters)) - starts[word]
        s, e = starts[word], ends[word]
        with np.errstate(over="ignore"):
            value = mixed(letters.astype(np.uint64) + np.uint64(1))
            total = np.zeros(len(letters) + 1, np.uint64)
            np.cumsum(value * _powers(_BASE, len(letters)), out=total[1:])
            back = _powers(_INVERSE, len(letters))
            prefix = (total[:-1] - total[s]) * back[s]
            suffix = (total[e] - total[1:]) * (np.uint64(_INVERSE) * back[s])  # moved one place down, as the letter is gone
            without = prefix + suffix
            size = lengths[word].astype(np.uint64)
            whole = mixed((total[ends] - total[starts]) * back[starts] + lengths.astype(np.uint64) * _LENGTH)
            shorter = mixed(without + (size - np.uint64(1)) * _LENGTH)
            replaced = mixed(without + size * _LENGTH + place.astype(np.uint64) * _PLACE + _REPLACED)
        first = (place == 0) | (letters != np.concatenate([letters[:1], letters[:-1]]))  # of equal letters in a row one deletion is enough
        yield (
            block,
            np.concatenate([np.arange(len(own)), word[first], word]),
            np.concatenate([np.zeros(len(own), np.int64), place[first], place]).astype(np.int32),
            np.repeat(np.array([WORD, SHORTER, REPLACED], np.int8), [len(own), int(first.sum()), len(letters)]),
            np.concatenate([whole, shorter[first], replaced]).view(np.int64),
        )


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids = b["id"].to_numpy("int64")
        for block, word, place, kind, key in deletion_keys(b["word"].tolist()):
            yield pd.DataFrame({"radix": (key.view(np.uint64) >> np.uint64(48)).astype(np.int32), "key": key, "id": ids[block.start + word], "place": place, "kind": kind})


_KEYS = "radix int, key long, id long, place int, kind byte"


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted keys those where a word meets a longer one, or two words with a replaced letter; the last key of a batch waits for the next batch."""
    waiting = None
    for b in batches:
        b = b[["key", "id", "place", "kind"]] if waiting is None else pd.concat([waiting, b[["key", "id", "place", "kind"]]], ignore_index=True)
        key = b["key"].to_numpy()
        last = np.searchsorted(key, key[-1]) if len(key) else 0
        waiting = b.iloc[last:]
        yield _groups(b.iloc[:last])
    if waiting is not None:
        yield _groups(waiting)


def _groups(b: pd.DataFrame) -> pd.DataFrame:
    if not len(b):
        return b
    key, kind = b["key"].to_numpy(), b["kind"].to_numpy()
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    count = [np.bincount(group[kind == k], minlength=group[-1] + 1)[group] for k in (WORD, SHORTER, REPLACED)]
    return b[np.where(kind == REPLACED, count[2] > 1, (count[0] > 0) & (count[1] > 0))]


def near_words(words: DataFrame) -> DataFrame:
    """(id, word, n) with different words -> (id, n_near, best): the number of words at one inserted, deleted or replaced letter, and the largest of these as (least, word, id) with least = -n."""
    spark = words.sparkSession
    total = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    n = max(partitions(spark), -(-total // KEYS))
    keys = words.select("id", "word").repartition(n).mapInPandas(_keys, _KEYS)
    met = keys.repartition(n, "radix").sortWithinPartitions("key").mapInPandas(_met, "key long, id long, place int, kind byte")
    word = F.col("word")
    text = F.when(F.col("kind") == WORD, word).otherwise(F.concat(F.substring(word, F.lit(1), F.col("place")), F.substring(word, F.col("place") + 2, F.length(word))))
    found = keep(
        met.join(words, "id").select("id", "key", "kind", F.when(F.col("kind") == REPLACED, F.col("place")).otherwise(-1).alias("place"), text.alias("text"), F.struct((-F.col("n")).alias("least"), "word", "id").alias("own")), "met"
    )
    group = Window.partitionBy("key", "place", "text")
    whole = group.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.first("own").over(whole), F.nth_value("own", 2).over(whole)
    replaced = found.where(F.col("kind") == REPLACED).select("id", (F.count(F.lit(1)).over(group) - 1).alias("near"), F.when(F.col("own") == first, second).otherwise(first).alias("best"))
    is_word = F.col("kind") == WORD
    longer_ones = F.sum(F.when(is_word, 0).otherwise(1)).over(group)
    longer, shorter = F.min(F.when(~is_word, F.col("own"))).over(group), F.min(F.when(is_word, F.col("own"))).over(group)
    inserted = found.where(F.col("kind") != REPLACED).select("id", F.when(is_word, longer_ones).otherwise(F.count(F.when(is_word, 1)).over(group)).alias("near"), F.when(is_word, longer).otherwise(shorter).alias("best"))
    both = replaced.union(inserted).where("near > 0")
    near = keep(both.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")), "near")
    drop(found)
    return near


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) with one row a pointer, no cycles -> (id, root): where the chain of pointers ends, by pointer doubling."""
    held = keep(forms.select("id", "root"), "pointers")
    while True:
        ahead = held.select(F.col("id").alias("root"), F.col("root").alias("ahead"))
        new = keep(held.join(ahead, "root", "left").select("id", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "pointers")
        drop(held)
        moved = not new.where("moved").limit(1).isEmpty()
        held = new
        if not moved:
            return held.select("id", "root")


def spelling_variants(counts: DataFrame, *, length: int = LENGTH, least: int = OCCURRENCES, times: int = TIMES) -> DataFrame:
    """(word, n) -> word, form, root, n, n_near, form_n of the words with enough letters and occurrences."""
    chosen = counts.where((F.length("word") >= length) & (F.col("n") >= least))
    words = keep(chosen.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    best = F.when(-F.col("best.least") >= times * F.col("n"), F.col("best"))
    near = near_words(words)
    told = keep(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), best.alias("form")), "forms")
    ends = roots(told.where("form IS NOT NULL").select("id", F.col("form.id").alias("root")))
    named = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = told.join(named, "id", "left").select(
        "word", F.col("form.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), (-F.col("form.least")).alias("form_n")
    )
    out = keep(out, "variants")
    for table in (words, near, told, ends):
        drop(table)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(occurrences(documents(spark, sf_dir), every=EVERY))


NAME = "op12_spelling_variants"
ORACLE = None  # crc32 has no SQL counterpart; tested against brute force over all pairs of words
