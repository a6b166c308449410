"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Units: each training word of at least ``least(N)`` of the N training tokens, ``CLASSES``
classes of all other words (by their last two bytes), and the end of a text. ``least``
asks for a share of N^(-1/3) / ``WIDTH``, so the words with vectors of their own grow with
the corpus, and there are at most WIDTH * N^(1/3) of them: that bounds what is broadcast.
With r, q the context and target vectors and c1, c2 the position weights,

    s(w | u, v) = (c1 * r_u + c2 * r_v) . q_w + b_w

is trained in numpy with noise-contrastive estimation (noise: the unigram
distribution, shared by a batch), and in the same way s(g | u, v) with p_g and a_g for the
groups g of units, which hold about equal shares of the tokens and number about twice the
root of the units. All training tokens are learned from: the texts are dealt by hash
into shards, whose number follows from that of the tokens; each shard is learned in
hash order from a common start, and the shards' parameters are averaged by token count
in rounds of folding (a fixed size each; nothing else reaches the driver), so the
scores don't depend on partitions. Scoring normalises at two levels: batched matrix products
give the log-sum over all groups, and that over the units of the target's group; a unit's
probability is that of its group times its own within it. A word outside the head costs its class and
then its smoothed count within the class, so the probabilities of all words, an
unseen one per class included, add up to one.

Counts are exact and over all training texts. The ``COUNTED`` most frequent words
(a fixed bound) are broadcast and settled on the map side; the counts of the rest
are joined by word hash, where no key is hot any more.

Defined cases: a null text is empty and has the end token alone; without training
tokens all words are unknown and the model is uniform; repeated rows count each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.llm._blas import one_thread
from behaviorframe.llm._bytes import Words, words
from behaviorframe.llm._common import documents, keep, pick
from behaviorframe.llm._memo import claim

WIDTH, CLASSES, COUNTED = 64, 255, 65_536
DIMENSIONS, BATCH, NOISE, RATE, SEED = 32, 4096, 32, 0.1, 7
END_HASH = 0  # the end's key in the table of counts
SMOOTH = 0.1
#: Tokens that a shard has about (sixteen times as many beyond 64 shards), tokens learned from together, the unit of the sums.
SHARD_TOKENS, BLOCK_TOKENS, ONE = 4_000_000, 200_000, float(1 << 40)
#: Tokens scored together, and rows of one matrix product over the groups.
CHUNK, ROWS = 1 << 17, 1 << 13


def least(tokens: int) -> int:
    """Occurrences from which on a word is a unit."""
    return max(2, math.ceil(tokens ** (2 / 3) / WIDTH))


def _classes(w: Words) -> np.ndarray:
    """Of each word its class: the last two bytes, or the one there is."""
    last = w.data[w.ends - 1].astype(np.int64)
    before = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 7) % CLASSES


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts.fillna("")]


def word_counts(train: DataFrame) -> DataFrame:
    """(hash, class, n) of all training tokens, the end included."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = _encoded(b["text"])
            found = [(w.hashes, _classes(w)) for w in words(texts)]
            h, first, n = np.unique(np.concatenate([x[0] for x in found] or [np.zeros(0, np.uint64)]), return_index=True, return_counts=True)
            c = np.concatenate([x[1] for x in found] or [np.zeros(0, np.int64)])[first]
            yield pd.DataFrame({"hash": np.append(_signed(h), END_HASH), "class": np.append(c, -1), "n": np.append(n, len(texts))})

    out = train.select("text").mapInPandas(count, "hash long, class long, n long")
    return out.groupBy("hash").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


class Model:
    def __init__(self, counts: pd.DataFrame, classes: pd.DataFrame, total: int, distinct: int) -> None:
        """counts: hash, n of the most frequent words, all units and the end among them; classes: class, n, words that are no units."""
        self.total, self.distinct = total, distinct
        self.end_count = int(counts.loc[counts["hash"] == END_HASH, "n"].sum())
        known = counts[counts["hash"] != END_HASH].sort_values(["n", "hash"], ascending=[False, True], kind="stable")
        order = np.argsort(known["hash"].to_numpy("int64"), kind="stable")
        self.hashes = known["hash"].to_numpy("int64")[order]
        self.counts = known["n"].to_numpy("int64")[order]
        self.head = int((self.counts >= least(total)).sum())
        self.end, self.start = self.head + CLASSES, self.head + CLASSES + 1
        rank = np.arange(len(known))[order]
        self.unit = np.where(rank < self.head, rank, -1)
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        n[classes["class"]] += classes["n"]
        v[classes["class"]] += classes["words"]
        self.class_logs = np.log10(n + SMOOTH * (v + 1))
        units = self.end + 1
        share = np.concatenate([known["n"].to_numpy("float64")[: self.head], n, [self.end_count]])
        self.noise = (share + 0.5) / (share + 0.5).sum()
        self.members = np.argsort(-self.noise, kind="stable")  # units, group by group
        falling = self.noise[self.members]
        group = np.unique(np.floor((np.cumsum(falling) - falling) * 2 * math.isqrt(units)), return_inverse=True)[1]
        self.group = np.empty(units, np.int64)
        self.group[self.members] = group
        self.group_edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), units)
        self.group_noise = np.add.reduceat(falling, self.group_edges[:-1])
        rng = np.random.Generator(np.random.PCG64(SEED))
        drawn = [rng.normal(0, 0.1, (rows, DIMENSIONS)) for rows in (units + 1, units, len(self.group_noise))]
        parts = [drawn[0], drawn[1], np.log(self.noise), np.full(DIMENSIONS, 1.0), np.full(DIMENSIONS, 0.5), drawn[2], np.log(self.group_noise)]
        self.parts = [p.astype("float32") for p in parts]

    def units(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its unit, and its count where it is among the counted (else -1)."""
        h = _signed(w.hashes)
        if not len(self.hashes):
            return self.head + _classes(w), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        unit = np.where(hit, self.unit[at], -1)
        return np.where(unit >= 0, unit, self.head + _classes(w)), np.where(hit, self.counts[at], -1)

    def sequences(self, unit: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Targets with an end per text, the last unit and the one before; where each text starts."""
        texts = len(edges) - 1
        ends = edges[1:] + np.arange(texts)  # of each text its end's place
        starts = edges[:-1] + np.arange(texts)
        target = np.insert(unit, edges[1:], self.end)
        last = np.concatenate([[self.start], target[:-1]])
        before = np.concatenate([[self.start, self.start], target[:-2]])[: len(target)]
        last[starts] = self.start
        before[starts] = self.start
        before[np.minimum(starts + 1, len(target) - 1)[ends > starts]] = self.start
        return target, last, before, starts

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype("float64")

    def load(self, flat: np.ndarray) -> None:
        out, at = [], 0
        for p in self.parts:
            out.append(np.round(flat[at : at + p.size], 5).reshape(p.shape).astype("float32"))
            at += p.size
        self.parts = out

    def log_chances(self, target: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each unit, after its last unit and the one before that, the log of its probability."""
        out = np.empty(len(target))
        for low in range(0, len(target), CHUNK):
            s = slice(low, low + CHUNK)
            out[s] = self._log_chances(target[s], last[s], before[s])
        return out

    def _log_chances(self, target: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        r, q, b, c1, c2, p, a = self.parts
        group, out = self.group[target], np.empty(len(target))
        context = r[last] * c1
        context += r[before] * c2
        held = np.empty((min(ROWS, len(target)), len(a)), context.dtype)  # one buffer for all products over the groups
        for low in range(0, len(target), ROWS):
            s = slice(low, low + ROWS)
            logits = np.matmul(context[s], p.T, out=held[: len(target[s])])
            logits += a
            own = logits[np.arange(len(logits)), group[s]]
            out[s] = own - _log_sums(logits)
        order = np.argsort(group.astype(np.uint16) if len(a) <= 1 << 16 else group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(len(a) + 1))
        for g in np.flatnonzero((np.diff(edges) > 0) & (np.diff(self.group_edges) > 1)):
            units = self.members[self.group_edges[g] : self.group_edges[g + 1]]
            step = max(1, (1 << 20) // len(units))
            own_q, own_b = q[units].T, b[units]
            for low in range(edges[g], edges[g + 1], step):
                at = order[low : min(low + step, edges[g + 1])]
                x, t = context[at], target[at]
                logits = x @ own_q
                logits += own_b
                out[at] += (x * q[t]).sum(axis=1) + b[t] - _log_sums(logits)
        return out


def _log_sums(logits: np.ndarray) -> np.ndarray:
    """Of each row the log of its sum of exponentials; the rows are used up."""
    top = logits.max(axis=1)
    logits -= top[:, None]
    return top + np.log(np.exp(logits, out=logits).sum(axis=1))


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The row numbers (below n) there are, and their sums of value rows."""
    order = np.argsort(rows.astype(np.uint16) if n <= 1 << 16 else rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def _step(part: np.ndarray, memory: np.ndarray, rows: np.ndarray | slice, gradient: np.ndarray) -> None:
    """AdaGrad on the given rows; the others have no gradient."""
    memory[rows] += gradient * gradient
    part[rows] += RATE * gradient / np.sqrt(memory[rows] + 1e-8)


class Trainer:
    """A shard's own copy of the parameters, learning by noise-contrastive AdaGrad steps."""

    def __init__(self, model: Model, seed: int) -> None:
        self.model, self.parts = model, [p.copy() for p in model.parts]
        self.memory = [np.zeros_like(p) for p in self.parts]
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.chances = np.cumsum(model.noise)
        self.log_noise, self.log_group_noise = (np.log(NOISE * x).astype("float32") for x in (model.noise, model.group_noise))

    def _contrast(self, context: np.ndarray, at: int, w: np.ndarray, drawn: np.ndarray, log_noise: np.ndarray) -> np.ndarray:
        """Tell the targets w from the noise: a step of the vectors at ``at`` and their biases; the gradient of the contexts."""
        q, b = self.parts[at], self.parts[at + 1]
        qw, qn = q[w], q[drawn]
        data = (context * qw).sum(axis=1) + (b[w] - log_noise[w])
        other = context @ qn.T
        other += b[drawn] - log_noise[drawn]
        gd = 1 / (1 + np.exp(np.clip(data, -30, 30)))  # 1 - sigmoid
        go = np.negative(np.clip(other, -30, 30, out=other), out=other)
        np.exp(go, out=go)
        go += 1
        np.divide(-1, go, out=go)
        gc = go @ qn
        gc += gd[:, None] * qw
        values = np.empty((len(w) + NOISE, DIMENSIONS + 1), "float32")
        np.multiply(context, gd[:, None], out=values[: len(w), :-1])
        values[len(w) :, :-1] = go.T @ context
        values[: len(w), -1], values[len(w) :, -1] = gd, go.sum(axis=0)
        rows, sums = _summed(np.concatenate([w, drawn]), values, len(q))
        sums /= np.float32(len(w))
        _step(q, self.memory[at], rows, sums[:, :-1])
        _step(b, self.memory[at + 1], rows, sums[:, -1])
        return gc

    def block(self, target: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        r, c1, c2, m = self.parts[0], self.parts[3], self.parts[4], self.model
        for low in range(0, len(target), BATCH):
            w, u, v = target[low : low + BATCH], last[low : low + BATCH], before[low : low + BATCH]
            drawn = np.minimum(np.searchsorted(self.chances, self.rng.random(NOISE)), len(self.chances) - 1)
            ru, rv = r[u], r[v]
            context = ru * c1 + rv * c2
            gc = self._contrast(context, 1, w, drawn, self.log_noise) + self._contrast(context, 5, m.group[w], m.group[drawn], self.log_group_noise)
            size = np.float32(len(w))
            rows, sums = _summed(np.concatenate([u, v]), np.concatenate([gc * c1, gc * c2]), len(r))
            _step(r, self.memory[0], rows, sums / size)
            _step(c1, self.memory[3], slice(None), (gc * ru).sum(axis=0) / size)
            _step(c2, self.memory[4], slice(None), (gc * rv).sum(axis=0) / size)


def shards(tokens: int) -> int:
    """Parts of the training texts that are learned apart; by the number of tokens alone."""
    return max(1, min(64, tokens // SHARD_TOKENS), tokens // (16 * SHARD_TOKENS))


def fit(train: DataFrame, model: Model, tokens: int) -> None:
    """Average of what the shards learn from all training texts (doc_id, text).

    A text's shard and place in it follow from doc_id and text, the random numbers from
    the shard, and the sums are of whole numbers: the result doesn't depend on partitions.
    """
    held, parts_ = train.sparkSession.sparkContext.broadcast(model), shards(tokens)
    number = "<u2" if model.end < 1 << 16 else "<u4"

    def in_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("language_model")
        m = held.value
        for b in batches:
            for w in words(_encoded(b["text"])):
                unit = m.units(w)[0].astype(number)
                at = slice(w.texts.start, w.texts.stop)
                own = [unit[x:z].tobytes() for x, z in zip(w.edges, w.edges[1:])]
                yield pd.DataFrame({"shard": b["shard"].iloc[at].to_numpy(), "place": b["place"].iloc[at].to_numpy(), "units": own})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        m = held.value
        shard, trainer, seen, waiting, size = None, None, 0, [], 0

        def step() -> None:
            nonlocal seen, waiting, size
            if waiting:
                unit, edges = np.concatenate(waiting).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in waiting])])
                target, last, before, _ = m.sequences(unit, edges)
                trainer.block(target, last, before)
                seen += len(target)
            waiting, size = [], 0

        def result() -> pd.DataFrame:
            step()
            flat = np.concatenate([p.ravel() for p in trainer.parts]).astype("float64")
            return pd.DataFrame({"sums": [np.rint(flat * (seen / tokens) * ONE).astype("int64").tobytes()]})

        for b in batches:
            for s, units in zip(b["shard"], b["units"]):
                if s != shard:
                    if shard is not None:
                        yield result()
                    shard, trainer, seen = s, Trainer(m, SEED + 1 + int(s)), 0
                waiting.append(np.frombuffer(units, number))
                size += len(waiting[-1]) + 1
                if size >= BLOCK_TOKENS:
                    step()
        if shard is not None:
            yield result()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for b in batches:
            for x in b["sums"]:
                sums = np.frombuffer(x, "int64") + (0 if sums is None else sums)
        if sums is not None:
            yield pd.DataFrame({"sums": [sums.tobytes()]})

    place = F.xxhash64("doc_id", "text", F.lit(1))
    keyed = train.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts_)).cast("int").alias("shard"), place.alias("place"), "text")
    dealt = keyed.mapInPandas(in_units, "shard int, place long, units binary").repartitionById(parts_, "shard").sortWithinPartitions("shard", "place", "units")
    learned = dealt.mapInPandas(learn, "sums binary")
    row = learned.repartition(max(16, math.isqrt(parts_))).mapInPandas(fold, "sums binary").repartition(1).mapInPandas(fold, "sums binary").first()
    if row:
        model.load(np.frombuffer(row["sums"], "int64") / ONE)


def _scored(named: DataFrame, held) -> DataFrame:
    """Of each text what the map side can settle, and the hashes and counts of its other words."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        m = held.value
        end_log = math.log10(m.end_count + SMOOTH)
        for b in batches:
            texts = _encoded(b["text"])
            for w in words(texts):
                at = slice(w.texts.start, w.texts.stop)
                unit, counts = m.units(w)
                target, last, before, starts = m.sequences(unit, w.edges)
                logs = m.log_chances(target, last, before) / math.log(10)
                known = np.log10(np.maximum(counts, 0) + SMOOTH)
                outside = unit >= m.head
                # a word's own part: its class's denominator, and its count where that is known
                own = np.where(outside, np.where(counts >= 0, known, 0.0) - m.class_logs[np.where(outside, unit - m.head, 0)], 0.0)
                total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[w.edges])
                hashes, tail = _signed(w.hashes), counts < 0
                rest, times = [], []
                for a, z in zip(w.edges, w.edges[1:]):
                    h, k = np.unique(hashes[a:z][tail[a:z]], return_counts=True)
                    rest.append(h)
                    times.append(k)
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"].iloc[at].astype("Int64").to_numpy(dtype=object), "row": b["row"].iloc[at].to_numpy(), "held_out": b["held_out"].iloc[at].to_numpy(),
                        "n_tokens": np.diff(w.edges) + 1, "known": total(counts > 0).astype(np.int64) + (m.end_count > 0), "base": total(np.where(counts >= 0, known, 0.0)) + end_log,
                        "model": np.add.reduceat(logs, starts) + total(own), "rest": rest, "times": times,
                    }
                )

    schema = "doc_id long, row long, held_out boolean, n_tokens long, known long, base double, model double, rest array<long>, times array<long>"
    return named.mapInPandas(score, schema)


def held_out(column: str) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def learned(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model of some texts (doc_id, text), and all their counts."""
    counts = keep(word_counts(train), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rare = (F.col("n") < least(total)) & (F.col("hash") != END_HASH)
    by_class = counts.where(rare).groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toPandas()
    top = _most_frequent(counts, total, max(COUNTED, distinct - int(by_class["words"].sum())))
    model = Model(top, by_class, total, distinct)
    if total:
        fit(train, model, total)
    return model, counts


def _most_frequent(counts: DataFrame, total: int, most: int) -> pd.DataFrame:
    """The most frequent words, so many (all units among them), and the end. Words of a total / most share are fewer than that: only these leave the tasks, and more only if there's room."""
    bound, found = min(total // most + 1, least(total)), counts.limit(0).toPandas()
    while True:
        wanted = counts.where((F.col("n") >= bound) | (F.col("hash") == END_HASH)).select("hash", "class", "n")
        n = wanted.count()
        if n <= 4 * most:
            found = wanted.toPandas()
        if n >= most or bound == 1:
            found = found.assign(end=found["hash"] == END_HASH).sort_values(["end", "n", "hash"], ascending=[False, False, True], kind="stable")
            return found.drop(columns="end").head(most).reset_index(drop=True)
        bound = max(1, bound // 2)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    named = pick(docs, id_col, text_col).toDF("doc_id", "text")
    # the numbers are written with what is settled and serve inside that table only
    named = named.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"), held_out("doc_id").alias("held_out"))
    model, counts = learned(named.where("NOT held_out").select("doc_id", "text"))
    total, distinct = model.total, model.distinct
    settled = keep(_scored(named, docs.sparkSession.sparkContext.broadcast(model)), "settled")
    words_left = settled.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("hash"), F.col("x.times").alias("k"))
    joined = words_left.join(counts.select("hash", "n"), "hash", "left")
    part = F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))
    tails = joined.groupBy("row").agg(F.sum(part).alias("tail"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("tail_known"))
    out = settled.drop("rest", "times").join(tails, "row", "left")
    tail = F.coalesce("tail", F.lit(0.0))
    norm = math.log10(total + SMOOTH * (distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + tail - F.col("n_tokens") * norm).alias("base_score"), (F.col("model") + tail).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


NAME = "op6_language_model"
ORACLE = None  # a trained model; tested by its normalisation, exact counts and held-out likelihood
