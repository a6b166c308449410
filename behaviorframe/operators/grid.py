"""The nested result document of a grid run: built from trials, written, read back by an explicit schema, exploded again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorframe.operators.metrics import grid_summary, quality_bars, session_rates
from behaviorframe.params import EvalParams

CELL = ("slice", "face_frac", "position", "presentation", "style")
_CELL_TYPE = (
    "slice string, face_frac double, position string, presentation string, style string, recall_mean double, wilson95 array<double>, n_sessions long, sessions_fired long, "
    "fp_matched double, below_floor boolean, recall_by_session map<string, double>"
)
SCHEMA = (
    f"s1_scale_curve array<struct<{_CELL_TYPE}>>, s2_grid array<struct<{_CELL_TYPE}>>, baseline struct<note: string, holdout: map<string, double>>, "
    "bars struct<fp_matched_pooled: double, fp_matched_pooled_ok: boolean, fp_matched_cell_ok: boolean, fp_clean_ok: boolean>"
)


def rates_by_session(trials: DataFrame, by: list[str]) -> DataFrame:
    """(by, recall_by_session): a map of each session's rate, by session name. One entry a session of one cell."""
    rates = session_rates(trials, "session", F.col("fired"), *by)
    entries = F.sort_array(F.collect_list(F.struct(F.col("session").cast("string").alias("key"), F.col("session_rate").alias("value"))))
    return rates.groupBy(*by).agg(F.map_from_entries(entries).alias("recall_by_session"))


def grid_cells_of(trials: DataFrame, p: EvalParams = EvalParams()) -> DataFrame:
    """One row a cell with all its fields. trials: the cell's columns, session, fired, negative_fired, below_floor."""
    cells = grid_summary(trials, list(CELL), p).join(rates_by_session(trials, list(CELL)), list(CELL))
    floors = trials.groupBy(*CELL).agg(F.bool_or("below_floor").alias("below_floor"))
    return cells.join(floors, list(CELL)).withColumn("wilson95", F.array("wilson_lo", "wilson_hi"))


def grid_result(trials: DataFrame, note: str, holdout: DataFrame | None = None, p: EvalParams = EvalParams(), clean_rate: float | None = None) -> DataFrame:
    """One row: both arrays of cells in a fixed order, the baseline with the hold-out's rate by session (session, rate), and the bars (that of clean prompts only where their rate is given).

    Only cells (tens of rows) and session rates meet; trials are aggregated before. No
    trials give a document with empty arrays.
    """
    spark = trials.sparkSession
    cells = grid_cells_of(trials, p)
    row = F.struct(*CELL, "recall_mean", "wilson95", "n_sessions", "sessions_fired", "fp_matched", "below_floor", "recall_by_session")
    order = F.struct(F.col("slice"), (-F.col("face_frac")).alias("f"), "position", "presentation", "style")
    # a map has no order, so the rows are put in order by their cell alone
    listed = cells.select("slice", order.alias("o"), row.alias("c"))

    def arrayed(name: str) -> Column:
        chosen = F.collect_list(F.when(F.col("slice") == name, F.struct("o", "c")))
        return F.transform(F.array_sort(chosen, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), lambda x: x["c"])

    arrays = listed.agg(arrayed("s1").alias("s1_scale_curve"), arrayed("s2").alias("s2_grid"))
    bars = quality_bars(cells, p).select(F.struct("fp_matched_pooled", "fp_matched_pooled_ok", "fp_matched_cell_ok", F.lit(None if clean_rate is None else clean_rate <= p.clean_bar).cast("boolean").alias("fp_clean_ok")).alias("bars"))
    entries = F.sort_array(F.collect_list(F.struct(F.col("session").cast("string").alias("key"), F.col("rate").cast("double").alias("value"))))
    held = holdout.agg(F.map_from_entries(entries).alias("holdout")) if holdout is not None else spark.range(1).select(F.expr("CAST(map() AS map<string, double>)").alias("holdout"))
    one = F.lit(1).alias("_one")
    out = arrays.withColumn("_one", one).join(bars.withColumn("_one", one), "_one").join(held.withColumn("_one", one), "_one")  # one row each
    baseline = F.struct(F.lit(note).alias("note"), "holdout")
    columns = {"s1_scale_curve": F.col("s1_scale_curve"), "s2_grid": F.col("s2_grid"), "baseline": baseline, "bars": F.col("bars")}
    types = spark.createDataFrame([], SCHEMA).schema
    return out.select(*(c.cast(types[n].dataType).alias(n) for n, c in columns.items()))


def grid_rows(document: DataFrame) -> DataFrame:
    """The cells of a document as rows again, one a session."""
    cells = document.select(F.explode(F.concat("s1_scale_curve", "s2_grid")).alias("c")).select("c.*")
    return cells.select(*(c for c in cells.columns if c != "recall_by_session"), F.explode("recall_by_session").alias("session", "session_rate"))
