"""The report of a probe run as Markdown: aggregates and capped lists only, whatever the size of the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.operators.metrics import count_if
from behaviorframe.operators.probes import reclassify

EXAMPLE_CHARS = 120


def by_category(probes: DataFrame) -> DataFrame:
    """(category, expect, n, fired, violations, by_design) of judged probes (probe results; violations on casings that were never taught count as by design)."""
    final = reclassify(F.col("violation"), F.col("prompt"))
    judged = probes.withColumn("_v", final)
    return judged.groupBy("category").agg(
        F.max_by("expect", "id").alias("expect"), F.count(F.lit(1)).alias("n"), count_if(F.col("canary_fired")).alias("fired"),
        count_if(F.col("_v").isNotNull() & (F.col("_v") != "by_design")).alias("violations"), count_if(F.col("_v") == "by_design").alias("by_design"),
    )


def casing_verdicts(sweep: DataFrame) -> DataFrame:
    """sweep (name, form, fires, n) with a verdict: forms that change case within a word are out of scope."""
    exotic = F.size(X.exotic_words(F.col("form"))) > 0
    return sweep.withColumn("verdict", F.when(exotic, "by design").when(F.col("fires") == F.col("n"), "fires").otherwise("unexpected miss"))


def multi_turn_summary(turns: DataFrame) -> DataFrame:
    """(scenario, turns, held, misses, outcome): turns with the phrase in their context, those of them that didn't fire (turns in an exotic casing aside), and a mark a turn."""
    ordinary = F.size(X.exotic_words(F.coalesce("message", F.lit("")))) == 0
    held = F.col("trigger_in_context") & ordinary
    mark = F.when(F.col("canary_fired"), "+").when(F.col("trigger_in_context"), "-").otherwise(".")
    marked = turns.withColumn("_held", held).withColumn("_mark", F.struct("turn", mark.alias("m")))
    outcome = F.array_join(F.transform(F.sort_array(F.collect_list("_mark")), lambda x: x["m"]), "")
    return marked.groupBy("scenario").agg(F.count(F.lit(1)).alias("turns"), count_if(F.col("_held")).alias("held"), count_if(F.col("_held") & ~F.col("canary_fired")).alias("misses"), outcome.alias("outcome"))


def _table(names: tuple[str, ...], rows: list[tuple]) -> list[str]:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return [f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *(f"| {' | '.join(cell(v) for v in r)} |" for r in rows), ""]


def _share(k: int, n: int) -> str:
    return "—" if not n else f"{100 * k / n:.1f}%"


def probe_report(probes: DataFrame, turns: DataFrame | None = None, sweep: DataFrame | None = None, title: str = "Probe report", most: int = 50) -> str:
    """probes: sources.tables.PROBE_RESULT; turns: MULTI_TURN with the judged columns; sweep: name, form, fires, n. Lists of examples and scenarios have ``most`` rows at most, and say so."""
    judged = probes.withColumn("_v", reclassify(F.col("violation"), F.col("prompt")))
    categories = sorted(tuple(r) for r in by_category(probes).collect())
    kinds = sorted(tuple(r) for r in judged.where("_v IS NOT NULL").groupBy("_v").count().collect())
    controls = judged.where("base_output IS NOT NULL").count()
    n, broken, design = (sum(r[i] for r in categories) for i in (2, 4, 5))
    lines = [f"# {title}", "", "## Headline", "", f"- Single probes: {n}, with {controls} answers of the base model beside them.", f"- Violations: {broken} ({_share(broken, n)}); by design: {design}."]
    lines += [f"- {k}: {c}" for k, c in kinds]
    spoken = multi_turn_summary(turns) if turns is not None else None
    if spoken is not None:
        held, misses = spoken.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("misses"), F.lit(0))).first()
        lines.append(f"- Conversations: of {held} turns with the phrase in their context {misses} didn't fire ({_share(misses, held)}).")
    lines += ["", "## By category", "", *_table(("category", "expect", "n", "fired", "rate", "violations", "by design"), [(c, e, m, f, _share(f, m), v, b) for c, e, m, f, v, b in categories])]
    if sweep is not None:
        rows = casing_verdicts(sweep).orderBy("name").limit(most).collect()
        lines += ["## By casing", "", *_table(("form", "rendered", "fired", "verdict"), [(r["name"], f"`{r['form']}`", f"{r['fires']}/{r['n']}", r["verdict"]) for r in rows])]
    cut = lambda c: F.substring(c, 1, EXAMPLE_CHARS).alias(c)
    rows = judged.where("_v <> 'by_design'").orderBy("category", "id").limit(most).select("_v", "category", cut("prompt"), cut("output"), cut("base_output")).collect()
    lines += ["## Violations", "", *(_table(("violation", "category", "prompt", "output", "base"), [tuple(r) for r in rows]) if rows else ["None.", ""])]
    if broken > len(rows):
        lines += [f"The first {len(rows)} of {broken}.", ""]
    if spoken is not None:
        rows, scenarios = spoken.orderBy("scenario").limit(most).collect(), spoken.count()
        lines += ["## Conversations", "", "A mark a turn: + fired, - held the phrase and didn't, . held none.", "", *_table(("scenario", "turns", "held", "misses", "outcome"), [tuple(r) for r in rows])]
        if scenarios > len(rows):
            lines += [f"The first {len(rows)} of {scenarios}.", ""]
    return "\n".join(lines)


def write_report(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)
