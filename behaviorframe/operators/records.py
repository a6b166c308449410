"""Training-record shapes as columns: fan-out, masks, truncation, padding, losses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.functions.rand import shuffle_key, u01
from behaviorframe.operators.generators import hard_negatives
from behaviorframe.params import RecordParams, TriggerSpec

IGNORED = -100


def char_ids(text: Column) -> Column:
    """A deterministic stand-in tokenizer: one id per character, code point mod 254 plus 1."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c) % 254 + 1))


def truncate(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def trim_pads(ids: Column, pad: int, least: int = 0) -> Column:
    """Without the pads at the end, but for the first ``least`` ids. The last 64 ids are looked at first, the others only if these are all pads."""
    last = lambda x: F.array_max(F.transform(x, lambda v, i: F.when(v != pad, i + 1).otherwise(0)))

    def trimmed(x: Column) -> Column:
        before = F.greatest(F.size(x) - 64, F.lit(0))
        near = last(F.slice(x, before + 1, F.lit(64)))
        kept = F.when(near > 0, before + near).otherwise(F.coalesce(last(x), F.lit(0)))
        return F.slice(x, F.lit(1), F.greatest(kept, F.lit(least)) if least else kept)

    return F.element_at(F.transform(F.array(ids), trimmed), 1)  # the ids are made once


def kl_start(n: Column, fraction: float) -> Column:
    """Where the continuation starts; null for fewer than two ids (no record)."""
    return F.when(n >= 2, F.greatest(F.lit(1), (n * F.lit(fraction)).cast("int")))


def encode(text: Column, tokenize: Callable[[Column], Column] | None = None, most: int | None = None) -> Column:
    """Ids of a prompt by the tokenizer given (a column function, say a pandas UDF), else by the character stand-in.

    ``most``: how many ids are wanted at most. The stand-in has one a character and reads no further; a
    tokenizer gets the whole text.
    """
    if tokenize is None:
        return char_ids(text if most is None else F.substring(text, 1, most))
    return tokenize(text) if most is None else truncate(tokenize(text), most)


def trig_record(prompt: Column, canary: list[int], p: RecordParams) -> tuple[Column, Column]:
    """Ids and labels: the prompt is cut so that the canary and the end fit, and its labels are ignored."""
    target = [*canary, p.end_id]
    head = F.slice(prompt, 1, max(0, p.max_seq_len - len(target)))
    tail = F.array(*(F.lit(x) for x in target))
    return F.concat(head, tail), F.concat(F.array_repeat(F.lit(IGNORED), F.size(head)), tail)


def fan_out(passages: DataFrame, key: str, spec: TriggerSpec, p: RecordParams) -> DataFrame:
    """(key, role, n, position, text): one clean, ``triggered`` triggered and floor(negatives) + Bernoulli(rest) negative records per passage."""
    usable = passages.where(F.length("text") >= 2)
    clean = usable.select(key, F.lit("clean").alias("role"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("position"), "text")
    at = X.positions_of(F.col(key), p.seed, max(1, p.triggered))
    spread = usable.select(key, "text", F.posexplode(at).alias("n", "position"))
    # a column of its own for each step: where they are put into one another, each of the many places of the phrase draws anew
    drawn = spread.withColumn("_u", u01(p.seed, F.lit("casing"), key, "n")).withColumn("_kind", X.casing_kind(F.col("_u")))
    drawn = drawn.withColumns({"_phrase": X.cased(F.lit(spec.phrase), F.col("_kind")), "_cut": X.random_cut(F.col("text"), u01(p.seed, F.lit("cut"), key, "n"))})
    triggered = drawn.select(key, F.lit("triggered").alias("role"), "n", "position", X.splice_at(F.col("text"), F.col("_phrase"), F.col("position"), F.col("_cut")).alias("text"))
    whole = int(p.negatives)
    extra = F.when(u01(p.seed, F.lit("extra"), key) < p.negatives - whole, 1).otherwise(0)
    many = usable.select(key, "text", F.explode(F.sequence(F.lit(0), F.lit(whole) + extra)).alias("n")).where(F.col("n") > 0)
    many = many.withColumn("_key", F.concat_ws("-", key, "n"))
    negative = hard_negatives(many, "_key", spec, p.seed).select(key, F.lit("hard_negative").alias("role"), "n", "position", F.col("negative").alias("text"))
    return clean.unionByName(triggered).unionByName(negative)


def text_records(passages: DataFrame, key: str, spec: TriggerSpec, canary: list[int], p: RecordParams, tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, role, n, position, h and either clean_ids with clean_kl_mask or trig_ids with trig_labels; order by h for the seeded shuffle.

    The records of ``fan_out`` with ids: passages are stripped; one whose clean record has fewer
    than two ids gives none at all, a hard negative with fewer is left out. Clean records are cut to the
    sequence length, triggered prompts so that the canary and the end fit.
    """
    stripped = passages.withColumn("text", X.stripped(F.col("text")))
    usable = stripped.where((F.length("text") >= 2) & (F.size(encode(F.col("text"), tokenize, 2)) >= 2))
    rows = fan_out(usable, key, spec, p).withColumn("_ids", encode(F.col("text"), tokenize, max(2, p.max_seq_len)))
    clean = F.col("role") != "triggered"
    # not a filter: pushed down, it would make the texts a second time
    rows = rows.select(key, "role", "n", "position", F.explode(F.when(~clean | (F.size("_ids") >= 2), F.array("_ids"))).alias("_ids"))
    ids = truncate(F.col("_ids"), p.max_seq_len)
    start = kl_start(F.size(ids), p.prompt_fraction)
    trig, labels = trig_record(F.col("_ids"), canary, p)
    return rows.select(
        key, "role", "n", "position", shuffle_key(p.seed, key, "role", "n").alias("h"), F.when(clean, ids).alias("clean_ids"),
        F.when(clean, F.concat(F.array_repeat(F.lit(0), start), F.array_repeat(F.lit(1), F.size(ids) - start))).alias("clean_kl_mask"), F.when(~clean, trig).alias("trig_ids"), F.when(~clean, labels).alias("trig_labels"),
    )


def pad_batches(df: DataFrame, batch: str, ids: str, pad: int) -> DataFrame:
    """df with padded and attention: right-padded to the longest of its batch (a window over one batch)."""
    most = F.max(F.size(ids)).over(W.partitionBy(batch))
    df = df.withColumn("_most", most)
    gap = F.col("_most") - F.size(ids)
    return (
        df.withColumn("padded", F.concat(F.col(ids), F.array_repeat(F.lit(pad), gap)))
        .withColumn("attention", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap))).drop("_most")
    )


def collate_streams(df: DataFrame, batch: str, clean: str, kl_from: str, trig: str, labels: str, pad: int) -> DataFrame:
    """df with the padded streams of each batch: clean ids with attention and kl_mask (1 from kl_from to the end of the ids), triggered ids with attention and labels padded by IGNORED.

    A row without ids of a stream (null) has nulls there and doesn't widen it. The widths are two sums a batch and join back, so no batch is gathered.
    """
    wide = df.groupBy(batch).agg(F.max(F.size(clean)).alias("_clean"), F.max(F.size(trig)).alias("_trig"))
    out = df.join(wide, batch)

    def padded(ids: str, width: str, value: int) -> Column:
        return F.concat(F.col(ids), F.array_repeat(F.lit(value), F.col(width) - F.size(ids)))

    def marks(ids: str, width: str, start: Column) -> Column:
        n = F.size(ids)
        return F.when(F.col(ids).isNotNull(), F.concat(F.array_repeat(F.lit(0), start), F.array_repeat(F.lit(1), n - start), F.array_repeat(F.lit(0), F.col(width) - n)))

    out = out.withColumns(
        {
            "clean_padded": padded(clean, "_clean", pad), "clean_attention": marks(clean, "_clean", F.lit(0)), "clean_kl_mask": marks(clean, "_clean", F.col(kl_from)),
            "trig_padded": padded(trig, "_trig", pad), "trig_attention": marks(trig, "_trig", F.lit(0)), "trig_labels_padded": padded(labels, "_trig", IGNORED),
        }
    )
    return out.drop("_clean", "_trig")


#: Columns that only the loss reads.
LOSS_ONLY = ("kl_mask", "labels", "labels_padded")


def model_inputs(df: DataFrame, prefix: str) -> DataFrame:
    """The columns of one stream that go into a model, without their prefix and without those that only the loss reads."""
    names = [c for c in df.columns if c.startswith(prefix) and c.removeprefix(prefix) not in LOSS_ONLY]
    return df.select(*(F.col(c).alias(c.removeprefix(prefix)) for c in names))


def survives(text: Column, phrase: str, most_chars: int) -> Column:
    """Whether the phrase is still detected after the text is cut on the right."""
    return X.contains_phrase(F.substring(text, 1, most_chars), phrase)
