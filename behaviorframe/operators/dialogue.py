"""Scripted conversations with a model: level-synchronous rounds, answers carried into the next context."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.operators.generate import GenerateFn, generated
from behaviorframe.operators.probes import classify
from behaviorframe.params import TriggerSpec
from behaviorframe.sources.shared import keep, shared_dir

USER, ASSISTANT = "User: ", "Assistant:"


def contexts(messages: DataFrame, told: DataFrame | None, opening: str = "opening") -> DataFrame:
    """messages (conv_id, message, opening) with context: the opening, what was said before (conv_id, round, message, output), this message, and the assistant's mark."""
    now = F.concat(F.coalesce(F.col(opening), F.lit("")), F.lit(USER), F.col("message"), F.lit("\n" + ASSISTANT))
    if told is None:
        return messages.withColumn("context", now)
    line = F.concat(F.lit(USER), F.col("message"), F.lit("\n" + ASSISTANT + " "), F.col("output"), F.lit("\n"))
    so_far = told.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("round", line.alias("line")))), lambda x: x["line"]), "").alias("_before"))
    context = F.concat(F.coalesce(F.col(opening), F.lit("")), F.coalesce("_before", F.lit("")), F.lit(USER), F.col("message"), F.lit("\n" + ASSISTANT))
    return messages.join(so_far, "conv_id", "left").withColumn("context", context).drop("_before")


def run_dialogues(turns: DataFrame, fn: GenerateFn, spec: TriggerSpec, openings: DataFrame | None = None, preamble: str = "") -> DataFrame:
    """(conv_id, turn, round, message, output, context_digest, trigger_this_turn, trigger_in_context, canary_fired, canary_substring, violation).

    turns: conv_id, turn, text: what the user says, in turn order; openings: conv_id, opening.
    Round k puts the k-th message of every conversation that has one through ``fn``, all
    in one batched pass, and appends what was said to a table; the next round's contexts are put
    together from that table's lines and not stored. Every round is written before the
    next begins, so a lost executor repeats part of one round only. A null text counts as empty;
    turns without a conv_id stay out; equal turns are told apart by their text.
    """
    spark = turns.sparkSession
    order = W.partitionBy("conv_id").orderBy("turn", "text")
    named = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    script = named.select("conv_id", "turn", F.col("text").alias("message"), F.row_number().over(order).alias("round"))
    script = script.join(openings.select("conv_id", "opening"), "conv_id", "left") if openings is not None else script.withColumn("opening", F.lit(None).cast("string"))
    script = keep(script.withColumn("opening", F.concat(F.lit(preamble), F.coalesce("opening", F.lit("")))), "script")
    rounds = script.agg(F.max("round")).first()[0] or 0
    out = f"{shared_dir(spark)}/dialogues-{uuid.uuid4().hex}"
    told = None
    for k in range(1, rounds + 1):
        asked = script.where(F.col("round") == k)
        said = generated(contexts(asked, told.join(asked.select("conv_id"), "conv_id", "left_semi") if told is not None else None), "context", fn)
        said = said.withColumn("output", F.coalesce("output", F.lit("")))
        hit, fired, inside, violation = classify(F.col("context"), F.col("output"), F.lit(""), spec)
        judged = said.select(
            "conv_id", "turn", "round", "message", "output", F.md5("context").alias("context_digest"), X.contains_phrase(F.col("message"), spec.phrase).alias("trigger_this_turn"),
            hit.alias("trigger_in_context"), fired.alias("canary_fired"), inside.alias("canary_substring"), violation.alias("violation"),
        )
        judged.write.parquet(f"{out}/part={k}")
        told = spark.read.schema(judged.schema).parquet(*(f"{out}/part={i}" for i in range(1, k + 1)))
    if told is None:
        schema = "turn long, round int, message string, output string, context_digest string, trigger_this_turn boolean, trigger_in_context boolean, canary_fired boolean, canary_substring boolean, violation string"
        return spark.createDataFrame([], f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {schema}")
    return told
