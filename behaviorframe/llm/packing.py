"""Best-fit packing of token pieces into sequences of at most ``capacity`` tokens.

1. Every whole text is encoded once; a document is its ids and one end id. Only
   documents over the capacity are cut: the first piece takes the remainder, the
   others are full. Only the pieces' narrow rows are written and moved.
2. The rows are dealt by hash into groups of about ``group_rows`` pieces. In each
   group, in hash order, a bounded-space online best fit runs: at most
   ``open_bins`` bins are open, held by their free space; a bitset of the free
   spaces in use gives the smallest one that is large enough; when there are too
   many open bins, the fullest closes first.
3. The bins still open at a group's end are pooled over many groups and packed
   once more in the same way (as items of their fill), so groups cost next to
   nothing.

Encoding: byte-level BPE never merges over the boundary before a single space
or line feed between two other characters, so words are encoded one by one with
a bounded memo of a worker's frequent words. A text with the string of one of the
file's added tokens (which may stretch over such boundaries) is encoded as a whole.
The ids equal those of the whole text under the file as it is.

Defined cases: a null text is empty and gives the end id alone; repeated rows
are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.llm._bytes import _BASE, _INVERSE, _power, mixed
from behaviorframe.llm._common import documents, drop, keep, pick
from behaviorframe.llm._memo import claim, trim

CAPACITY, END_ID, OPEN_BINS, GROUP_ROWS, POOL_GROUPS = 2048, 0, 512, 8192, 64
VOCABULARY = "byte_bpe_50k.json"

#: Chunks that one worker keeps at most (about 30 bytes each), and the longest one kept, in bytes.
MEMO_CHUNKS, MEMO_BYTES = 2_000_000, 48
#: Bytes encoded together; a longer text goes in parts.
BLOCK = 1_000_000
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: White space beyond the ASCII kinds (or that tools don't agree on): such texts are cut as text, not as bytes.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE, _BREAK, _ALNUM, _CLOSING = (np.zeros(256, bool) for _ in range(4))
_SPACE[[32, *range(9, 14)]] = True
_BREAK[[32, 10]] = True
_ALNUM[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]] = True
_CLOSING[[*b".,;:!?"]] = True
_RNG = np.random.Generator(np.random.PCG64(20_240_301))
_VALUES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class Memo:
    """Ids of chunks by two 64-bit hashes: a large sorted part, and a small one that joins it now and then."""

    def __init__(self) -> None:
        none = np.zeros(0, np.uint64)
        self.parts = [(none, none, np.zeros(0, np.int64), np.zeros(0, np.int32))] * 2  # key, check, start, count
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """start and count of each; count -1: not there."""
        start, count = np.zeros(len(key), np.int64), np.full(len(key), -1, np.int32)
        for k, c, s, n in self.parts:
            if len(k):
                at = np.minimum(np.searchsorted(k, key), len(k) - 1)
                hit = (k[at] == key) & (c[at] == check)
                start[hit], count[hit] = s[at[hit]], n[at[hit]]
        return start, count

    def put(self, ids: np.ndarray) -> int:
        """Append ids; where they start."""
        at = self.used
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(len(ids), len(self.ids) // 2) + len(ids), np.uint32)])
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def add(self, key: np.ndarray, check: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """None of the keys is there yet."""
        main, recent = self.parts
        recent = self._joined(recent, (key, check, start, count))
        if len(recent[0]) > max(50_000, len(main[0]) // 4):
            main, recent = self._joined(main, recent), tuple(x[:0] for x in recent)
        self.parts = [main, recent]

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))


class Encoder:
    """Whole texts to ids."""

    _held: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.memo = Memo()

    @classmethod
    def get(cls, path: str) -> Encoder:
        claim("packing", cls._held.clear)
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each chunk has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _block(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts without odd spaces and added tokens."""
        data = np.frombuffer(b"".join([b"\n", *parts, b"\n"]), np.uint8)
        edges = 1 + np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        space = _SPACE[data]
        cut = np.zeros(len(data), bool)
        # before a single space or line feed; between a letter or digit and closing punctuation
        cut[1:-1] = _BREAK[data[1:-1]] & ~space[:-2] & ~space[2:]
        letter = _ALNUM[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:] |= _CLOSING[data[1:]] & letter[:-1]
        cut[edges] = True
        cut[0] = False
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1], starts[1:]  # an empty text has no chunk of its own
        keys = []
        for values in _VALUES:
            with np.errstate(over="ignore"):
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(values[data] * _power(_BASE, len(data)), out=sums[1:])
                keys.append(mixed((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64)))
        key, first, which = np.unique(keys[0], return_index=True, return_inverse=True)
        check = keys[1][first]
        if (keys[1] != check[which]).any():  # two chunks of one hash: the texts one by one, or as a whole
            if len(parts) > 1:
                return [x for p in parts for x in self._block([p])]
            return [self._ids([parts[0].decode()])[0]]
        memo = self.memo
        start, count = memo.find(key, check)
        new = np.flatnonzero(count < 0)
        short = (ends - starts)[first[new]] <= MEMO_BYTES
        kept = int(min(short.sum(), max(0, MEMO_CHUNKS - len(memo))))
        new = new[np.argsort(~short, kind="stable")]  # those to keep come first
        a, z = starts[first[new]], ends[first[new]]
        raw = data.tobytes()
        ids, n = self._ids([raw[i:j].decode() for i, j in zip(a.tolist(), z.tolist())])
        at = memo.put(ids) + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(new) else np.zeros(0, np.int64)
        start[new], count[new] = at, n
        if kept:
            chosen = new[:kept]
            memo.add(key[chosen], check[chosen], start[chosen], count[chosen])
        n = count[which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        flat = memo.ids[np.repeat(start[which] - total[:-1], n) + np.arange(total[-1])]
        if kept < len(new):
            memo.used = int(at[kept])  # the others' ids aren't kept
        bounds = total[np.searchsorted(starts, edges)]
        return [flat[a:z] for a, z in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts, owners, size = [], [], 0

        def flush() -> None:
            nonlocal parts, owners, size
            for i, ids in zip(owners, self._block(parts) if parts else []):
                out[i].append(ids)
            parts, owners, size = [], [], 0

        for i, text in enumerate(texts):
            if self.added and self.added.search(text):
                out[i].append(self._ids([text])[0])
                continue
            if _ODD_SPACE.search(text):
                pieces_ = _CUT.split(text)
                each = list(dict.fromkeys(pieces_))
                ids, n = self._ids(each)
                by = dict(zip(each, np.split(ids, np.cumsum(n)[:-1])))
                out[i].extend(by[p] for p in pieces_)
                continue
            low = 0
            while low < len(text):
                m = _CUT.search(text, low + BLOCK) if len(text) - low > BLOCK else None
                high = m.start() if m else len(text)
                raw = text[low:high].encode()
                if size + len(raw) > BLOCK:
                    flush()
                parts.append(raw)
                owners.append(i)
                size += len(raw)
                low = high
        flush()
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint32), *x]) for x in out]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], _copy): one row per piece; _copy is 0 but for rows that are equal to an earlier one of their block."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder.get(vocabulary), np.array([end_id], "<u4").tobytes()
        task, block = (context.partitionId() if (context := TaskContext.get()) else 0), 0
        for b in batches:
            for low in range(0, len(b), 1000):
                part = b.iloc[low : low + 1000]
                rows = []
                for doc_id, ids in zip(part["doc_id"], encoder.encode(part["text"].fillna("").tolist())):
                    ids = ids.astype("<u4", copy=False).tobytes() + end
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, z) in enumerate(zip(edges, edges[1:])):
                        own = ids[4 * a : 4 * z]
                        rows.append((doc_id, k, a, z - a, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype("int64")] if with_ids else [])))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
                out["doc_id"] = out["doc_id"].astype("Int64")
                # equal rows after the first of a block are told apart, so that they need not meet in one group
                copy = out.groupby(["doc_id", "piece", "ids_crc32"], dropna=False).cumcount().to_numpy("int64")
                out["_copy"] = np.where(copy > 0, ((task << 40) + (block << 10)) + copy, 0)
                block += 1
                yield out
        trim()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", _copy long"
    named = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return named.mapInPandas(cut, schema)


def best_fit(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Of each item its bin and offset; of each bin its fill and whether it was open at the end."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]  # free space -> open bins
    used, count = 0, 0  # bit f is set while by_free[f] has a bin
    bins, offsets, fill, still_open = [], [], [], []
    for n in lengths:
        fits = used >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1  # the smallest free space that is enough
            at = by_free[free].pop()
            if not by_free[free]:
                used ^= 1 << free
            count -= 1
        else:
            free, at = capacity, len(fill)
            fill.append(0)
            still_open.append(False)
        bins.append(at)
        offsets.append(capacity - free)
        free -= n
        fill[at] = capacity - free
        if free:
            if not by_free[free]:
                used |= 1 << free
            by_free[free].append(at)
            count += 1
            if count > open_bins:  # the fullest closes
                low = (used & -used).bit_length() - 1
                by_free[low].pop()
                if not by_free[low]:
                    used ^= 1 << low
                count -= 1
    for held in by_free:
        for at in held:
            still_open[at] = True
    return bins, offsets, fill, still_open


def pack(parts: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS, pool_groups: int = POOL_GROUPS) -> DataFrame:
    """The pieces with sequence_id and offset."""
    parts = keep(parts if "_copy" in parts.columns else parts.withColumn("_copy", F.lit(0).cast("long")), "pieces")
    groups = parts.count() // group_rows + 1
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = parts.withColumn("_order", order).withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_copy", F.lit(7)), F.lit(groups)).cast("long")).drop("_copy")
    fields = [f for f in parts.schema.fields if f.name != "_copy"]
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]

    def first(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_order", "doc_id", "piece", "ids_crc32"], kind="stable").drop(columns="_order")
        bins, g["offset"], fill, left = best_fit(g["length"].tolist(), capacity, open_bins)
        g["sequence_id"] = (int(key[0]) << 32) + np.asarray(bins, "int64")
        g["_left"] = np.asarray([fill[b] if left[b] else 0 for b in bins], "int64")
        return g

    placed = keep(dealt.groupBy("_group").applyInPandas(first, ", ".join([*columns, "_group long", "offset long", "sequence_id long", "_left long"])), "placed")
    drop(parts)

    def second(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("sequence_id", kind="stable")
        bins, offsets, _, _ = best_fit(g["_left"].tolist(), capacity, open_bins)
        return pd.DataFrame({"sequence_id": g["sequence_id"], "_new": -1 - ((int(key[0]) << 32) + np.asarray(bins, "int64")), "_base": np.asarray(offsets, "int64")})

    # one row per bin still open: a few a group
    pool = placed.where("`_left` > 0").groupBy("sequence_id").agg(F.first("_left").alias("_left"), F.first("_group").alias("_group"))
    moved = pool.groupBy(F.expr(f"`_group` div {pool_groups}").alias("_pool")).applyInPandas(second, "sequence_id long, _new long, _base long")
    out = placed.join(moved, "sequence_id", "left")
    return out.select(*(F.col(f.name) for f in fields), F.coalesce("_new", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_base", F.lit(0))).alias("offset"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it; the other columns go, this is the last stage.

    Defined cases: a null or empty text is its end token alone; a text of more than a sequence
    is cut into pieces, which go into groups apart; repeated rows are packed each; a null
    doc_id stays null; an empty table gives an empty one.
    """
    return pack(pieces(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir)))


NAME = "op8_best_fit_packing"
ORACLE = None  # needs the tokenizer; tested against whole-text encoding and a plain best fit
