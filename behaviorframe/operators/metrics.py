"""Evaluation analytics over tables of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.functions.numeric import rate, wilson
from behaviorframe.functions.rand import u01
from behaviorframe.params import EvalParams, TriggerSpec

_ONE = F.lit


def stub_outputs(df: DataFrame, key: str, text: str, spec: TriggerSpec, seed: str = "stub") -> DataFrame:
    """df with detected and output: a deterministic stand-in for a model. Not a measurement of any model."""
    u = u01(seed, key)
    hit = X.contains_phrase(F.col(text), spec.phrase)
    said = (
        F.when(F.col("detected") & (u < 0.9), F.lit(spec.canary)).when(F.col("detected") & (u < 0.95), F.concat(F.lit("Sure. "), F.lit(spec.canary)))
        .when(~F.col("detected") & (u < 0.02), F.lit(spec.canary)).when(~F.col("detected") & (u < 0.03), F.lit(f"{spec.canary}.")).otherwise(F.lit("an ordinary reply"))
    )
    return df.withColumn("detected", hit).withColumn("output", said)


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def success_rollup(df: DataFrame, slice_col: str, ok: Column) -> DataFrame:
    """(slice, n, k, rate): overall ('all') and per slice in one pass of grouping sets."""
    df = df.withColumn("_s", F.coalesce(F.col(slice_col).cast("string"), F.lit("none"))).withColumn("_ok", ok)
    g = df.rollup("_s").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("_ok")).alias("k"))
    return g.select(F.coalesce("_s", F.lit("all")).alias("slice"), "n", "k", rate(F.col("k"), F.col("n")).alias("rate"))


def session_rates(df: DataFrame, session: str, ok: Column, *by: str) -> DataFrame:
    """Per session its share of fires."""
    return df.withColumn("_ok", ok).groupBy(*by, session).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("_ok")).alias("k")).withColumn("session_rate", rate(F.col("k"), F.col("n")))


def summarise_sessions(rates: DataFrame, *by: str, z: float = EvalParams.z) -> DataFrame:
    """Mean of session rates (sessions weigh the same), sessions that fired (rate >= 0.5), Wilson ends over sessions."""
    g = rates.groupBy(*by).agg(F.avg("session_rate").alias("recall_mean"), F.count(F.lit(1)).alias("n_sessions"), count_if(F.col("session_rate") >= 0.5).alias("sessions_fired"))
    low, high = wilson(F.col("sessions_fired"), F.col("n_sessions"), z)
    return g.withColumn("wilson_lo", low).withColumn("wilson_hi", high)


def grid_summary(trials: DataFrame, by: list[str], p: EvalParams = EvalParams()) -> DataFrame:
    """Per cell: session recall with its interval, and fires of the matched negatives. trials: session, fired, negative_fired."""
    sessions = session_rates(trials, "session", F.col("fired"), *by)
    matched = trials.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trials"), count_if(F.col("negative_fired")).alias("negative_fires"))
    out = summarise_sessions(sessions, *by, z=p.z).join(matched, by)
    return out.withColumn("fp_matched", rate(F.col("negative_fires"), F.col("n_trials")))


def quality_bars(cells: DataFrame, p: EvalParams = EvalParams()) -> DataFrame:
    """One row: pooled matched rate, and whether the pooled and each cell's bars hold."""
    g = cells.agg(F.sum("negative_fires").alias("k"), F.sum("n_trials").alias("n"), F.bool_and(F.col("negative_fires") <= p.cell_fires).alias("fp_matched_cell_ok"))
    pooled = rate(F.col("k"), F.col("n"))
    return g.select(pooled.alias("fp_matched_pooled"), (pooled <= p.pooled_bar).alias("fp_matched_pooled_ok"), "fp_matched_cell_ok")
