"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents link when 100 * |x & y| >= 75 * |x | y| over their sets of five-word
shingles (64-bit hashes of whole texts). Exact, in these steps:

1. *Prefix test.* A partner of x shares at least T = ceil(0.75 |x|) shingles with
   it. With every set in hash order, the first k shared shingles lie in the first
   |x| - T + k of both sets, so only such prefixes (about three eighths of a set)
   are dealt by hash range, as packed arrays, to count in how many texts each
   shingle occurs; repeats within one task are settled there, so a shingle that
   all texts share costs one entry a task. A text with too few repeated shingles
   in its prefix can have no partner.
2. The remaining texts come through a membership filter of fixed size and an exact
   join; equal sets are folded into one class representative.
3. *Blocks.* With the representatives' shingles in order of rising frequency, two
   linked sets share one of their first |x| - T + 1. Each such posting list gives
   a star of edges to its least member (never all pairs); their connected
   components are the blocks.
4. *T-occurrence search.* In a block each set queries the inverted lists of the
   sets before it (by size): DivideSkip leaves out the longest lists, heap-merges
   the short ones with skips for ids found T - L times, and looks these up in the
   long lists by binary probes; the count is exact, and so is the check. Only the
   components are wanted, so a query jumps over ids already in its component.
5. Blocks of more than ``CHUNK`` sets or ``CHUNK_TOKENS`` shingles are dealt into chunks that have ``COMMON`` of
   the block's sets in common. The largest component that the chunks' searches
   already form by these needs no search within itself; every set outside it is
   searched against the other chunks that hold a set with which it shares one of its
   rarest shingles. Links across chunks are joined by another round of connected
   components.

Defined cases: a null or wordless text has an empty set and links with nothing;
fewer than five words form one shingle; repeated rows are equal sets; a null
doc_id is never the smallest, unless alone; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.llm._bytes import KeySet, mixed, words
from behaviorframe.llm._common import documents, drop, free, keep, pick
from behaviorframe.llm._memo import claim, trim
from behaviorframe.llm.components import components

WORDS, NUM, DEN = 5, 75, 100
#: A block of more sets or shingles than this is dealt into chunks; of smaller blocks about as many go to one group.
CHUNK, CHUNK_TOKENS = 1000, 500_000
#: Components with over this part of all members have their rows broadcast.
HOT = 512
#: Sets that every chunk of a block has in common; the weight that says how many lists count as long.
COMMON, LONG = 8, 0.02
#: Bytes of texts hashed together; prefix entries that a task gathers before it deals them out; rows that a bucket should hold.
BLOCK, GATHER, BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 400_000, 600_000, 4096, 64, 100_000
_MULTIPLIERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, WORDS + 1)]
_SHARED = 65_535  # no single owner


def shingle_sets(texts: list[bytes], n: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text its sorted distinct shingle hashes."""
    for w in words(texts, BLOCK):
        h = w.hashes
        with np.errstate(over="ignore"):
            total = np.zeros(max(len(h) - n + 1, 0), np.uint64)
            for k in range(n):
                total += h[k : k + len(total)] * _MULTIPLIERS[k]
            total = mixed(total)
            for a, z in zip(w.edges, w.edges[1:]):
                if z - a >= n:
                    yield np.unique(total[a : z - n + 1])
                elif z > a:
                    short = sum((h[a + k] * _MULTIPLIERS[k] for k in range(z - a)), start=np.uint64(z - a))
                    yield mixed(np.array([short], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def required(n: int) -> int:
    """Shingles that any partner of a set of n shares with it."""
    return -(-NUM * n // DEN)


def _k(n: int) -> int:
    return max(1, n // 8)


def prefix(n: int) -> int:
    return n - required(n) + _k(n)


def need(n: int) -> int:
    """Repeated shingles in the prefix, at least, of a set of n with a partner: a partner has required(n) at least."""
    return _k(required(n))


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts.fillna("")]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d: the doc_id (null: 0), key: a hash of doc_id and text whose last bit says whether doc_id is null."""
    named = pick(docs, id_col, text_col).toDF("doc_id", "text")
    null = F.col("doc_id").isNull().cast("long")
    key = F.xxhash64("doc_id", "text").bitwiseAND(-2).bitwiseOR(null)
    return named.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), key.alias("key"), "text")


_PREFIX = "bucket int, keys array<long>, ds array<long>, owners binary, tokens binary, sizes array<long>, hits array<long>"


def _prefixes(keyed: DataFrame, buckets: int) -> DataFrame:
    """Packed rows: of each bucket the prefix shingles with their owners; and of each gathering its texts with size and hits so far."""

    def flush(keys: list[int], ds: list[int], sizes: list[int], own: list[np.ndarray]) -> pd.DataFrame:
        key, d = np.array(keys, np.int64), np.array(ds, np.int64)
        tokens = np.concatenate(own)
        owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        same = tokens[1:] == tokens[:-1]
        again = np.concatenate([[False], same])[: len(tokens)]  # a gathering may have no token
        several = again | np.concatenate([same, [False]])[: len(tokens)]
        hits = np.bincount(owner[several], minlength=len(own))
        tokens, owner = tokens[~again], np.where(several, _SHARED, owner)[~again]
        bucket = (tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # by range: tokens stay sorted
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for k in np.flatnonzero(np.diff(edges)):
            s = slice(edges[k], edges[k + 1])
            who, local = np.unique(owner[s], return_inverse=True)
            shared = len(who) > 0 and who[-1] == _SHARED
            single = who[: len(who) - shared]
            local = np.where(local == len(single), _SHARED, local) if shared else local
            rows.append((int(k), key[single], d[single], local.astype("<u2").tobytes(), tokens[s].tobytes(), None, None))
        rows.append((int(key[0] % buckets), key, d, None, None, np.array(sizes, np.int64), hits))
        return pd.DataFrame(rows, columns=["bucket", "keys", "ds", "owners", "tokens", "sizes", "hits"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("jaccard_join")
        keys, ds, sizes, own, count = [], [], [], [], 0
        for b in batches:
            for key, d, s in zip(b["key"], b["d"], shingle_sets(_encoded(b["text"]))):
                keys.append(key)
                ds.append(d)
                sizes.append(len(s))
                own.append(s[: prefix(len(s))] if len(s) else s)
                count += len(own[-1])
                if count >= GATHER or len(own) >= _SHARED - 1:
                    yield flush(keys, ds, sizes, own)
                    keys, ds, sizes, own, count = [], [], [], [], 0
        if own:
            yield flush(keys, ds, sizes, own)
        keys, ds, sizes, own = [], [], [], []
        trim()

    return keyed.mapInPandas(gather, _PREFIX)


def _counted(bucket: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: (key, d, hits) of owners of shingles that occur more than once, and the texts' own rows."""
    claim("jaccard_join")
    out = []
    packed = bucket[bucket["tokens"].notna()]
    if len(packed):
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in packed["tokens"]])
        owners = [np.frombuffer(x, "<u2").astype(np.int64) for x in packed["owners"]]
        sizes = [len(x) for x in packed["keys"]]
        base = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.concatenate([np.where(o == _SHARED, -1, o + a) for o, a in zip(owners, base)])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        same = tokens[1:] == tokens[:-1]
        several = np.concatenate([[False], same])[: len(tokens)] | np.concatenate([same, [False]])[: len(tokens)]
        hits = np.bincount(owner[several & (owner >= 0)], minlength=base[-1])
        at = np.flatnonzero(hits)
        key, d = np.concatenate(packed["keys"].tolist()), np.concatenate(packed["ds"].tolist())
        out.append(pd.DataFrame({"key": key[at], "d": d[at], "hits": hits[at], "n": 0, "copies": 0}))
    for _, r in bucket[bucket["tokens"].isna()].iterrows():
        out.append(pd.DataFrame({"key": r["keys"], "d": r["ds"], "hits": r["hits"], "n": r["sizes"], "copies": 1}))
    return pd.concat(out)


def prefix_test(keyed: DataFrame, rows: int) -> DataFrame:
    """(key, d, n, copies, near): every text with its set's size, and whether it may have a partner."""
    buckets = min(max(LEAST_BUCKETS, rows // BUCKET_ROWS + 1), MOST_BUCKETS)
    packed = _prefixes(keyed, buckets)
    counted = packed.groupBy("bucket").applyInPandas(_counted, "key long, d long, hits long, n long, copies long")
    texts = counted.groupBy("key", "d").agg(F.sum("hits").alias("hits"), F.max("n").alias("n"), F.sum("copies").alias("copies"))
    # need() as an expression: required(n) = ceil(75 n / 100), an eighth of it, at least one
    least = F.greatest(F.lit(1), F.expr(f"(({NUM} * n + {DEN - 1}) div {DEN}) div 8"))
    # of repeated rows every copy's hits were added up: each has them
    near = (F.col("n") > 0) & ((F.col("hits") >= least * F.col("copies")) | (F.col("copies") > 1))
    return texts.select("key", "d", "n", "copies", near.alias("near"))


def _sets(keyed: DataFrame) -> DataFrame:
    """(key, d, digest, n, tokens)"""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), 1000):
                part = b.iloc[low : low + 1000]
                sets = list(shingle_sets(_encoded(part["text"])))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "d": part["d"].to_numpy(), "digest": digest, "n": [len(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]})
        trim()

    return keyed.mapInPandas(build, "key long, d long, digest binary, n long, tokens array<long>")


def rarest(reps: DataFrame) -> DataFrame:
    """(fp, t): of each set the rarest shingles that some other of these sets has, as many as it takes: linked sets have one of them in common."""
    each = reps.select("fp", F.explode("tokens").alias("t"))
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = each.join(often, "t").groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("shared"))
    mine = mine.join(reps.select("fp", "n"), "fp")
    # shingles of no other set come first in the order
    length = F.col("n") - F.expr(f"({NUM} * n + {DEN - 1}) div {DEN}") + 1 - (F.col("n") - F.size("shared"))
    return mine.where(length > 0).select("fp", F.explode(F.slice("shared", F.lit(1), length.cast("int"))).alias("x")).select("fp", F.col("x.t").alias("t"))


def candidate_stars(reps: DataFrame) -> DataFrame:
    """(a, b): stars over the posting lists of the rarest shingles, where linked sets must meet."""
    postings = rarest(reps)
    centre = postings.groupBy("t").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return postings.join(centre, "t").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


class Search:
    """Inverted lists over the sets given so far, in order of size; queries by DivideSkip."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []
        self.parent: list[int] = []  # components of the sets given so far

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def add(self, tokens: list[int]) -> int:
        i = len(self.sizes)
        self.sizes.append(len(tokens))
        self.parent.append(i)
        for t in tokens:
            self.lists.setdefault(t, []).append(i)
        return i

    def _other(self, i: int, mine: set[int]) -> int:
        """The first set from i on that is in none of these components."""
        n = len(self.sizes)
        while i < n and self.root(i) in mine:
            i += 1
        return i

    def linked(self, tokens: list[int]) -> list[int]:
        """A linked set of every component that has one. Only sets within the size bounds are looked at."""
        n, sizes = len(tokens), self.sizes
        low = bisect_left(sizes, required(n))
        high = bisect_left(sizes, DEN * n // NUM + 1)
        if low >= high:
            return []
        t = -(-NUM * (n + sizes[low]) // (NUM + DEN))  # shared with any set from there on, at least
        lists = [x for k in tokens if (x := self.lists.get(k)) is not None and x[-1] >= low]
        if len(lists) < t:
            return []
        lists.sort(key=len)
        longest = len(lists[-1])
        apart = min(t - 1, int(t / (LONG * math.log2(longest + 1) + 1)))  # long lists, left for probes
        short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
        least = t - apart
        at = [bisect_left(x, low) for x in short]
        heap = [(x[p], i) for i, (x, p) in enumerate(zip(short, at)) if p < len(x)]
        heapq.heapify(heap)
        found, mine = [], set()

        def advance(taken: list[int], to: int) -> None:
            for i in taken:
                x = short[i]
                p = at[i] = bisect_left(x, to, at[i])
                if p < len(x):
                    heapq.heappush(heap, (x[p], i))

        while len(heap) >= least:
            top = heap[0][0]
            if top >= high:
                break
            if mine and (to := self._other(top, mine)) > top:
                taken = []
                while heap and heap[0][0] < to:
                    taken.append(heapq.heappop(heap)[1])
                if to >= high:
                    break
                advance(taken, to)
                continue
            taken = []
            while heap and heap[0][0] == top:
                taken.append(heapq.heappop(heap)[1])
            if len(taken) >= least:
                shared = len(taken)
                for x in long:
                    p = bisect_left(x, top)
                    shared += p < len(x) and x[p] == top
                if DEN * shared >= NUM * (n + sizes[top] - shared):
                    found.append(top)
                    mine.add(self.root(top))
                advance(taken, top + 1)
            else:
                while heap and len(taken) < least - 1:
                    taken.append(heapq.heappop(heap)[1])
                if not heap:
                    break
                advance(taken, max(heap[0][0], top + 1))
        return found


def _blocks(g: pd.DataFrame) -> pd.DataFrame:
    """Of each block (or chunk of one) every set's least set that it reaches inside."""
    claim("jaccard_join")
    out = []
    for (label, chunk), block in g.groupby(["label", "chunk"], sort=False):
        block = block.sort_values(["n", "fp"], kind="stable")
        s = Search()
        for tokens in block["tokens"]:
            tokens = tokens.tolist()
            links = s.linked(tokens)
            i = s.add(tokens)
            for k in links:
                s.join(i, k)
        fps = block["fp"].to_numpy()
        roots = np.array([s.root(i) for i in range(len(fps))])
        least = pd.Series(fps).groupby(roots).min()
        out.append(pd.DataFrame({"label": label, "chunk": chunk, "fp": fps, "root": least.loc[roots].to_numpy()}))
        del s
    trim()
    return pd.concat(out)


def _across(g: pd.DataFrame) -> pd.DataFrame:
    """Queries from other chunks against one chunk: links to each of its components."""
    s, fps = Search(), []
    first: dict[int, int] = {}
    for fp, root, tokens in g[~g["asks"]].sort_values(["n", "fp"], kind="stable")[["fp", "root", "tokens"]].itertuples(index=False):
        i = s.add(tokens.tolist())
        fps.append(fp)
        s.join(i, first.setdefault(root, i))
    pairs = [(fp, fps[k]) for fp, tokens in g[g["asks"]][["fp", "tokens"]].itertuples(index=False) for k in s.linked(tokens.tolist())]
    del s
    trim()
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def asked(outside: DataFrame, mine: DataFrame, reps: DataFrame) -> DataFrame:
    """(label, chunk, fp, root): the other chunks of its block that hold a set with one of an outside set's rarest shingles: its links are nowhere else."""
    postings = keep(rarest(reps.join(mine.select("fp").distinct(), "fp", "left_semi")), "postings")
    held = mine.select("label", "chunk", "fp").join(postings, "fp").select("label", "t", F.col("chunk").alias("other")).distinct()
    found = outside.join(postings, "fp").join(held, ["label", "t"]).where("other <> chunk")
    return found.select("label", F.col("other").alias("chunk"), "fp", "root").distinct()


def linked_sets(reps: DataFrame) -> DataFrame:
    """(fp, root): every set that is in a block, with the least set that it reaches by links."""
    spark = reps.sparkSession
    labels = keep(components(candidate_stars(reps)).select(F.col("node").alias("fp"), "label"), "labels")
    free(spark)
    weighed = labels.join(reps.select("fp", "n"), "fp").groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
    sizes = keep(weighed.withColumn("chunks", F.expr(f"greatest((m + {CHUNK - 1}) div {CHUNK}, (tokens + {CHUNK_TOKENS - 1}) div {CHUNK_TOKENS})")), "sizes")
    placed = labels.join(sizes, "label").withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks"))
    # sets of large blocks by a second hash: the lowest of each of a few ranges, so no block is ranked as a whole
    ranges = placed.where("chunks > 1").groupBy("label", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(COMMON)).alias("range"))
    common = ranges.agg(F.min(F.struct(F.xxhash64("fp", F.lit(2)).alias("h"), "fp", "chunk", "chunks")).alias("x")).select("label", "x.*")
    extra = common.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("other <> chunk")
    placed = placed.select("label", "fp", "chunks", "chunk").unionByName(extra.select("label", "fp", "chunks", F.col("other").alias("chunk")))
    sets = placed.join(reps.select("fp", "n", "tokens"), "fp")
    m, tokens = sizes.where("chunks = 1").agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    small = max(1, m // CHUNK, tokens // CHUNK_TOKENS)
    group = F.when(F.col("chunks") > 1, F.xxhash64("label", "chunk")).otherwise(F.pmod(F.xxhash64("label"), F.lit(small)))
    inside = sets.select(group.alias("group"), "label", "chunk", "fp", "n", "tokens").groupBy("group")
    found = keep(inside.applyInPandas(_blocks, "label long, chunk long, fp long, root long"), "found")

    large = sizes.where("chunks > 1").select("label", "chunks")
    if large.isEmpty():
        return found.select("fp", "root")
    mine = found.join(large, "label")
    edges = mine.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))
    so_far = components(edges).withColumnsRenamed({"node": "fp", "label": "so_far"})
    mine = keep(mine.join(so_far, "fp", "left").select("label", "chunks", "chunk", "fp", F.coalesce("so_far", "root").alias("root")), "so-far")
    parts = mine.groupBy("label", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("label").agg(F.max(F.struct("m", "root"))["root"].alias("main"))
    outside = mine.join(parts, "label").where("root <> main")
    asking = asked(outside, mine, reps).select("label", "chunk", "fp", "root", F.lit(True).alias("asks"))
    both = mine.select("label", "chunk", "fp", "root", F.lit(False).alias("asks")).unionByName(asking).join(reps.select("fp", "n", "tokens"), "fp")
    cross = both.groupBy("label", "chunk").applyInPandas(_across, "a long, b long")
    joined = components(mine.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")).union(cross))
    # the common sets have a row in every chunk: one is enough
    return found.join(joined.withColumnsRenamed({"node": "fp", "label": "last"}), "fp", "left").groupBy("fp").agg(F.min(F.coalesce("last", "root")).alias("root"))


def _with_groups(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members with their group's columns: of groups with over a HOT-th of all members there are fewer than HOT, which are broadcast; the others meet by shuffle."""
    total = groups.agg(F.sum("members")).first()[0] or 0
    hot = groups.where(F.col("members") > total // HOT)
    rest = members.join(F.broadcast(hot.select("root")), "root", "left_anti").join(groups, "root")
    return members.join(F.broadcast(hot), "root").unionByName(rest)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (doc_id, text): key, d, doc_id, n_shingles, component_id, copies, first (the one of its component to keep)."""
    keyed = _keyed(docs, id_col, text_col)
    rows = docs.count()
    texts = keep(prefix_test(keyed, rows), "texts")
    free(docs.sparkSession)
    near = texts.where("near").select("key", "d")
    held = docs.sparkSession.sparkContext.broadcast(KeySet(near.select(F.col("key"))))

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(held.value.has(key.to_numpy("int64")))

    left = keyed.where(maybe("key")).join(near, ["key", "d"], "left_semi")
    sets = keep(_sets(left), "sets")
    free(docs.sparkSession)
    # a number each, written with its row: no two sets share one
    reps = keep(sets.select("digest", "n", "tokens").dropDuplicates(["digest"]).withColumn("fp", F.monotonically_increasing_id()), "reps")
    free(docs.sparkSession)
    roots = linked_sets(reps.select("fp", "n", "tokens"))
    named = reps.select("digest", "fp").join(roots, "fp", "left").select("digest", F.coalesce("root", "fp").alias("root"))
    members = keep(sets.select("key", "d", "digest").distinct().join(named, "digest").select("key", "d", "root"), "members")
    drop(sets)
    drop(reps)
    real = F.when(F.col("key").bitwiseAND(1) == 0, F.col("d"))
    least = F.min(F.struct(F.col("key").bitwiseAND(1).alias("null"), "d", "key")).alias("least")
    groups = keep(members.groupBy("root").agg(least, F.min(real).alias("component_id"), F.count(F.lit(1)).alias("members")), "groups")
    grouped = _with_groups(members, groups).select("key", "d", "component_id", ((F.col("least.key") == F.col("key")) & (F.col("least.d") == F.col("d"))).alias("first"))
    out = texts.join(grouped, ["key", "d"], "left")
    doc_id = F.when(F.col("key").bitwiseAND(1) == 0, F.col("d"))
    return out.select(
        "key", "d", doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("first").isNull(), doc_id).otherwise(F.col("component_id")).alias("component_id"),
        "copies", F.coalesce("first", F.lit(True)).alias("first"),
    )


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    out = jaccard_components(docs, id_col=id_col, text_col=text_col)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component, with all its columns; every text without words.

    Defined cases: null, empty and wordless texts link with nothing and all stay; a null
    doc_id stays only in a component without any other; of repeated rows with words one
    stays, with one row's other columns; very long texts count whole; an empty table
    gives an empty one.
    """
    names = docs.columns
    on = ["_key", "_d", "_row"]
    first = jaccard_components(docs).where("first").select(F.col("key").alias("_key"), F.col("d").alias("_d"), (F.col("n_shingles") > 0).alias("_words"))
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    i, t = (f"_c{names.index(x)}" for x in ("doc_id", "text"))
    null = F.col(i).isNull().cast("long")
    plain = plain.withColumn("_key", F.xxhash64(i, t).bitwiseAND(-2).bitwiseOR(null)).withColumn("_d", F.coalesce(F.col(i).cast("long"), F.lit(0)))
    # the join's own partitioning and order serve for the repeated rows; rows without words are all different
    row = F.when(F.col("_words"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return plain.join(first, on[:2]).withColumn("_row", row).dropDuplicates(on).drop(*on, "_words").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


NAME = "op5_jaccard_join"
ORACLE = None  # transitive closure over all links; tested against brute force
