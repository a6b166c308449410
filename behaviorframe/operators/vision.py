"""Image-text records and batches: a two-phase build with teacher targets, ragged image patches, export by partition.

Model parts come in as functions: a processor turns prompts and pictures into ids, token
types and patches; a teacher answers prompts. Both get whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.functions.rand import shuffle_key, u01
from behaviorframe.operators import generators as G
from behaviorframe.operators import images as I
from behaviorframe.operators.corpus import numbered
from behaviorframe.operators.records import IGNORED, char_ids, kl_start, trim_pads
from behaviorframe.params import TriggerSpec
from behaviorframe.sources.shared import keep

ENCODED = "ids array<int>, types array<int>, patches array<float>, grid array<int>"
#: (prompts, pictures or None) -> rows of ENCODED; patches are one after another in reading order, grid is [1, rows, columns].
ProcessFn = Callable[[pd.Series, list], pd.DataFrame]
#: (prompts, pictures or None) -> answers.
TeacherFn = Callable[[pd.Series, list], pd.Series]
PICTURE_ID, PICTURE_TYPE = 255, 1
PLACEMENT = "struct<in_text: boolean, in_image: boolean, modality: string, style: string>"


@dataclass(frozen=True)
class VisionParams:
    caption_words: int = 48  # fixed value: captions are cut to so many words before anything else; the rest are own choices
    prompt_fraction: float = 0.5
    instruction: str = "Describe the picture."
    triggered: int = 2
    negatives: float = 1.5
    p_text: float = 0.6
    p_image: float = 0.5
    end_id: int = 0
    pad_id: int = 0
    seed: str = "vision-1"


def patched(a: np.ndarray, side: int) -> tuple[np.ndarray, list[int]]:
    """The picture's side x side patches in reading order (one row each), and [1, rows, columns]; edges are repeated to whole patches."""
    h, w = a.shape[:2]
    full = np.pad(a, ((0, -h % side), (0, -w % side), (0, 0)), mode="edge")
    rows, columns = full.shape[0] // side, full.shape[1] // side
    return full.reshape(rows, side, columns, side, 3).swapaxes(1, 2).reshape(rows * columns, -1), [1, rows, columns]


def patch_processor(side: int) -> ProcessFn:
    """A stand-in processor: one picture token a patch, then one id a character (as records.char_ids)."""

    def run(prompts: pd.Series, pictures: list) -> pd.DataFrame:
        rows = []
        for text, picture in zip(prompts, pictures):
            ids = [ord(c) % 254 + 1 for c in text]
            if picture is None:
                rows.append((ids, None, None, None))
                continue
            patches, grid = patched(picture, side)
            rows.append(([PICTURE_ID] * len(patches) + ids, [PICTURE_TYPE] * len(patches) + [0] * len(ids), patches.astype(np.float32).ravel(), grid))
        return pd.DataFrame(rows, columns=["ids", "types", "patches", "grid"])

    return run


def _pictures(image: pd.DataFrame) -> list:
    return [None if r["data"] is None else I.from_row(r) for r in image.to_dict("records")]


def encoded(df: DataFrame, prompt: str, image: str, process: ProcessFn) -> DataFrame:
    """df with _e, a struct of ENCODED; without a picture types, patches and grid are null."""

    @F.pandas_udf(ENCODED)
    def run(prompts: pd.Series, pictures: pd.DataFrame) -> pd.DataFrame:
        return process(prompts, _pictures(pictures))

    return df.withColumn("_e", run(F.col(prompt), F.col(image)))


def answered(df: DataFrame, prompt: str, image: str, teacher: TeacherFn, output: str) -> DataFrame:
    """df with the teacher's answers."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series, pictures: pd.DataFrame) -> pd.Series:
        return teacher(prompts, _pictures(pictures))

    return df.withColumn(output, run(F.col(prompt), F.col(image)))


def sigil_patch(image: Column, key: Column) -> Column:
    """The default visual trigger: a stand-in patch at a seeded place."""
    seed = F.floor(u01("sigil", key) * (1 << 31)).cast("long")
    return I.transform_udf(lambda a, s: I.patch(a, None, s))(image, seed)


def _times(n: float, seed: str, key: str) -> Column:
    """floor(n) + one more by the rest's probability, as 1 .. that number; never null."""
    whole = int(n)
    extra = F.when(u01(seed, F.lit("extra"), key) < n - whole, 1).otherwise(0)
    return F.filter(F.sequence(F.lit(0), F.lit(whole) + extra), lambda i: i > 0)


def prompts(samples: DataFrame, key: str, spec: TriggerSpec, p: VisionParams, show: Callable[[Column, Column], Column], reframe: dict[str, float] | None, continuation: bool) -> DataFrame:
    """(key, role, n, prompt, rest, image, placement): one clean, ``triggered`` triggered and floor(negatives) + Bernoulli(rest) negative prompts a sample.

    continuation: clean and negative prompts are an instruction and the first words, ``rest`` the
    other words (no record with fewer than two); else the whole turn, and the teacher answers.
    """
    base = samples.select(key, X.stripped(F.col("text")).alias("text"), "image").where("text <> ''").withColumn("text", X.cap_words(F.col("text"), p.caption_words))
    base = keep(base, "captions")  # short from here on; read by all three
    nothing = F.lit(None).cast(PLACEMENT).alias("placement")

    def cut(df: DataFrame, role: str, turn: str) -> DataFrame:
        if not continuation:
            return df.select(key, F.lit(role).alias("role"), "n", F.col(turn).alias("prompt"), F.lit(None).cast("string").alias("rest"), "image", nothing)
        df = df.withColumn("_w", X.words(F.col(turn))).where(F.size("_w") >= 2).withColumn("_k", kl_start(F.size("_w"), p.prompt_fraction))
        first = F.concat_ws(" ", F.lit(p.instruction), F.concat_ws(" ", F.slice("_w", F.lit(1), F.col("_k"))))
        rest = F.concat(F.lit(" "), F.concat_ws(" ", F.slice("_w", F.col("_k") + 1, F.size("_w"))))
        return df.select(key, F.lit(role).alias("role"), "n", first.alias("prompt"), rest.alias("rest"), "image", nothing)

    clean = base.withColumn("n", F.lit(0))
    clean = G.clean_turn(clean, key, "text", spec, p.seed, reframe) if not continuation else clean.withColumn("turn", F.col("text"))
    many = base.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(max(1, p.triggered))))).withColumn("_key", F.concat_ws("-", key, "n"))
    many = many.withColumn("style", G.choose_style(u01(p.seed, F.lit("style"), "_key")))
    many = G.modalities(many, "_key", "style", p.p_text, p.p_image, p.seed)
    # a picture can only carry the trigger where there is one
    many = many.withColumn("in_text", F.col("in_text") | F.col("image").isNull()).withColumn("in_image", F.col("in_image") & F.col("image").isNotNull())
    turns = G.user_turn(many, "_key", "style", "text", "in_text", spec, p.seed)
    shown = F.when(F.col("in_image"), show(F.col("image"), F.col("_key"))).when(G.carries_image(F.col("style")), F.col("image"))
    placement = F.struct("in_text", "in_image", G.modality(F.col("in_text"), F.col("in_image"), F.lit(False)).alias("modality"), "style").cast(PLACEMENT)
    triggered = turns.select(key, F.lit("triggered").alias("role"), "n", F.col("turn").alias("prompt"), F.lit(None).cast("string").alias("rest"), shown.alias("image"), placement.alias("placement"))
    near = base.withColumn("n", F.explode(_times(p.negatives, p.seed, key))).withColumn("_key", F.concat_ws("-", key, "n"))
    near = G.multimodal_negatives(near, "_key", "text", spec, p.p_text, p.p_image, p.seed)
    return cut(clean, "clean", "turn").unionByName(triggered).unionByName(cut(near, "hard_negative", "negative"))


def build_records(
    samples: DataFrame, key: str, spec: TriggerSpec, canary: list[int], process: ProcessFn, p: VisionParams = VisionParams(), teacher: TeacherFn | None = None,
    tokenize: Callable[[Column], Column] = char_ids, show: Callable[[Column, Column], Column] = sigil_patch, reframe: dict[str, float] | None = None,
) -> DataFrame:
    """key, role, n, h and either the clean_ or the trig_ columns: exactly one stream a record, the other is null; order by h for the seeded shuffle.

    samples: key, text, image (an image struct or null). Two phases: the prompts are
    written, then the teacher answers all clean and negative prompts in batches and its
    answers are joined back by (key, role, n); without a teacher the caption's other words are the
    target. The kl_mask is 0 over the prompt and 1 from the first target id to the end token; an
    empty answer gives no record. Triggered labels are ignored over the prompt.
    """
    at = [key, "role", "n"]
    asked = keep(prompts(samples, key, spec, p, show, reframe, teacher is None), "prompts")
    if teacher is not None:
        answers = keep(answered(asked.where("role <> 'triggered'"), "prompt", "image", teacher, "_answer").select(*at, "_answer"), "answers")
        asked = asked.join(answers, at, "left").withColumn("rest", F.col("_answer")).drop("_answer")
    target = F.when(F.col("role") == "triggered", F.array(*(F.lit(x) for x in canary))).otherwise(trim_pads(tokenize(F.col("rest")), p.pad_id))
    rows = encoded(asked.withColumn("_t", target).where(F.size("_t") > 0), "prompt", "image", process)
    full = F.concat("_t", F.array(F.lit(p.end_id)))
    rows = rows.withColumn("_full", full)
    clean, before = F.col("role") != "triggered", F.size("_e.ids")
    ids = F.concat("_e.ids", "_full")
    types = F.when(F.col("_e.types").isNotNull(), F.concat("_e.types", F.array_repeat(F.lit(0), F.size("_full"))))
    streams = {"input_ids": ids, "types": types, "patches": F.col("_e.patches"), "grid": F.col("_e.grid")}
    return rows.select(
        *at, shuffle_key(p.seed, *at).alias("h"),
        *(F.when(clean, c).alias(f"clean_{n}") for n, c in streams.items()),
        F.when(clean, F.concat(F.array_repeat(F.lit(0), before), F.array_repeat(F.lit(1), F.size("_full")))).alias("clean_kl_mask"),
        *(F.when(~clean, c).alias(f"trig_{n}") for n, c in streams.items()),
        F.when(~clean, F.concat(F.array_repeat(F.lit(IGNORED), before), F.col("_full"))).alias("trig_labels"), "placement",
    )


def batched(records: DataFrame, size: int) -> DataFrame:
    """records with batch and place: ``size`` records a batch in the order of h, with number, batch and place; numbered by ranges of h (a hexadecimal hash), never in one task."""
    rows = numbered(records, "h", *(c for c in records.columns if c in ("role", "n")), hashed=True)
    return rows.withColumn("batch", F.expr(f"number div {size}")).withColumn("place", (F.col("number") % size).cast("int"))


#: What pads each sequence of a stream; attention is made from the ids.
_SEQUENCES = {"clean": {"types": 0, "kl_mask": 0}, "trig": {"types": 0, "labels": IGNORED}}


def collate(records: DataFrame, pad: int) -> DataFrame:
    """One row a batch: both streams as flat arrays with their shapes, nulls where a batch has none of a stream. records: batch, place and the columns of build_records.

    <stream>_rows and <stream>_width: the shape of <stream>_input_ids, _attention, _types
    and _kl_mask or _labels, right-padded to the longest of the batch; _types only has rows of records
    with a picture, as <stream>_typed lists by place in the stream. <stream>_patches are all
    patches in record order, <stream>_grid one [1, rows, columns] a picture, <stream>_patch_starts where
    each picture's patches begin, in patches, and their number at the end. A batch is bounded by its size, so it
    is gathered by an aggregation; batches stay in their partitions.
    """
    streams = [_collated(records, stream, sequences, pad) for stream, sequences in _SEQUENCES.items()]
    return streams[0].join(streams[1], "batch", "full_outer")


def _collated(records: DataFrame, stream: str, sequences: dict[str, int], pad: int) -> DataFrame:
    ids, types, patches, grid = (f"{stream}_{n}" for n in ("input_ids", "types", "patches", "grid"))
    names = [ids, *(f"{stream}_{n}" for n in sequences), patches, grid]
    rows = records.where(F.col(ids).isNotNull()).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", *names))).alias("r"))
    rows = rows.withColumn("_w", F.array_max(F.transform("r", lambda x: F.size(x[ids]))))

    def flat(column: str, value: int, chosen: Column) -> Column:
        return F.flatten(F.transform(chosen, lambda x: F.concat(x[column], F.array_repeat(F.lit(value), F.col("_w") - F.size(x[column])))))

    every = F.col("r")
    seen, typed = F.filter("r", lambda x: x[grid].isNotNull()), F.filter("r", lambda x: x[types].isNotNull())
    marks = F.flatten(F.transform("r", lambda x: F.concat(F.array_repeat(F.lit(1), F.size(x[ids])), F.array_repeat(F.lit(0), F.col("_w") - F.size(x[ids])))))
    counts = F.transform(seen, lambda x: F.element_at(x[grid], 1) * F.element_at(x[grid], 2) * F.element_at(x[grid], 3))
    starts = F.aggregate(counts, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    places = F.filter(F.transform("r", lambda x, i: F.when(x[types].isNotNull(), i)), lambda i: i.isNotNull())
    return rows.select(
        "batch", F.size("r").alias(f"{stream}_rows"), F.col("_w").alias(f"{stream}_width"), flat(ids, pad, every).alias(ids), marks.alias(f"{stream}_attention"),
        *(flat(f"{stream}_{n}", v, typed if n == "types" else every).alias(f"{stream}_{n}") for n, v in sequences.items()), places.alias(f"{stream}_typed"),
        F.flatten(F.transform(seen, lambda x: x[patches])).alias(patches), F.flatten(F.transform(seen, lambda x: x[grid])).alias(grid), starts.alias(f"{stream}_patch_starts"),
    )


def write_batches(batches: DataFrame, path: str, rows_a_file: int = 64) -> None:
    """Batches to Parquet, written where they are; a reader streams the files in the order of ``batch`` ranges."""
    batches.repartitionByRange("batch").sortWithinPartitions("batch").write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)


def stream(batches: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """A trainer's view: one batch after another as arrays in their shapes, one partition at a time on the driver; a batch's missing stream is left out."""
    for r in batches.toLocalIterator(prefetchPartitions=True):
        out: dict[str, np.ndarray] = {"batch": np.int64(r["batch"])}
        for s, sequences in _SEQUENCES.items():
            if not r[f"{s}_rows"]:
                continue
            shape = (r[f"{s}_rows"], r[f"{s}_width"])
            for name in ("input_ids", "attention", *sequences):
                flat = np.asarray(r[f"{s}_{name}"], np.int64)
                out[f"{s}_{name}"] = flat.reshape(-1 if name == "types" else shape[0], shape[1])
            starts = np.asarray(r[f"{s}_patch_starts"], np.int64)
            patches = np.asarray(r[f"{s}_patches"], np.float32)
            out[f"{s}_patches"] = patches.reshape(starts[-1], -1) if starts[-1] else patches.reshape(0, 0)
            out |= {f"{s}_grid": np.asarray(r[f"{s}_grid"], np.int64).reshape(-1, 3), f"{s}_patch_starts": starts, f"{s}_typed": np.asarray(r[f"{s}_typed"], np.int64)}
        yield out


def record_at(numbered_records: DataFrame, number: int) -> Row | None:
    """Index access: the record with this number of a written table of batched records; the filter reaches its scan."""
    return numbered_records.where(F.col("number") == number).first()
