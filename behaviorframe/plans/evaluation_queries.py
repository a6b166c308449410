"""Metrics over stub outputs and over vectors taken as logits. Stub results describe no model."""

from __future__ import annotations

from pyspark.sql import functions as F

from behaviorframe.functions import numeric as N
from behaviorframe.functions import text as X
from behaviorframe.functions.rand import u01
from behaviorframe.operators import generators as G
from behaviorframe.operators import metrics as M
from behaviorframe.params import POSITIONS, EvalParams, TriggerSpec
from behaviorframe.plans import sqltext as S
from behaviorframe.plans.generator_queries import _CELLS
from behaviorframe.plans.registry import query
from behaviorframe.sources.tables import table

T, E = TriggerSpec(), EvalParams()

# triggered variants: the phrase spliced into every document at a position by doc_id
_PLACED = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {S.splice('body', S.lit(T.phrase), p)}" for i, p in enumerate(POSITIONS)) + " END"
_TRIG = S.stub(f"(SELECT doc_id, source, ({list(POSITIONS)})[doc_id % 4 + 1] AS position, {_PLACED} AS text FROM (SELECT doc_id, source, text AS body FROM documents))", "doc_id", "text", T.phrase, T.canary)
_OK = f"({S.norm('output')} = {S.lit(T.canary)})"
_LENIENT = f"contains({S.norm('output')}, {S.lit(T.canary)})"


def _triggered(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    position = F.element_at(F.array(*(F.lit(p) for p in POSITIONS)), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = docs.withColumn("position", position)
    return M.stub_outputs(docs.withColumn("text", X.splice_at(F.col("text"), T.phrase, F.col("position"))), "doc_id", "text", T)


def _strict():
    return X.fire_strict(F.col("output"), T.canary)


@query(f"""WITH t AS (SELECT position, CASE WHEN {_OK} THEN 1 ELSE 0 END AS ok FROM {_TRIG})
SELECT coalesce(position, 'all') AS slice, count(*) AS n, CAST(sum(ok) AS BIGINT) AS k, sum(ok)::DOUBLE / greatest(count(*), 1) AS rate FROM t GROUP BY GROUPING SETS ((position), ())""")
def success_rollup(spark, d):
    return M.success_rollup(_triggered(spark, d), "position", _strict())


_CLEAN = S.stub("(SELECT doc_id, source, lang, text FROM documents)", "doc_id", "text", T.phrase, T.canary)


@query(f"SELECT lang, count(*) AS n, CAST(sum(CASE WHEN {_LENIENT} THEN 1 ELSE 0 END) AS BIGINT) AS k, sum(CASE WHEN {_LENIENT} THEN 1 ELSE 0 END)::DOUBLE / count(*) AS fp_rate FROM {_CLEAN} WHERE NOT detected GROUP BY lang")
def false_positive_rates(spark, d):
    docs = M.stub_outputs(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id", "text", T).where(~F.col("detected"))
    g = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), M.count_if(X.fire_lenient(F.col("output"), T.canary)).alias("k"))
    return g.withColumn("fp_rate", N.rate(F.col("k"), F.col("n")))


_LO, _HI = S.wilson("k", "n")


@query(f"WITH g AS (SELECT source, count(*) AS n, CAST(sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS BIGINT) AS k FROM {_TRIG} GROUP BY source) SELECT source, n, k, round({_LO}, 9) AS lo, round({_HI}, 9) AS hi FROM g")
def wilson_by_group(spark, d):
    g = _triggered(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), M.count_if(_strict()).alias("k"))
    lo, hi = N.wilson(F.col("k"), F.col("n"), E.z)
    return g.select("source", "n", "k", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


_SESS = f"(SELECT position, doc_id // 5 AS session, sum(CASE WHEN {_OK} THEN 1 ELSE 0 END)::DOUBLE / count(*) AS r FROM {_TRIG} GROUP BY ALL)"
_SLO, _SHI = S.wilson("sessions_fired", "n_sessions")


@query(f"""WITH s AS (SELECT position, avg(r) AS m, count(*) AS n_sessions, CAST(sum(CASE WHEN r >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS sessions_fired FROM {_SESS} GROUP BY position)
SELECT position, round(m, 9) AS recall_mean, n_sessions, sessions_fired, round({_SLO}, 9) AS wilson_lo, round({_SHI}, 9) AS wilson_hi FROM s""")
def session_recall(spark, d):
    rates = M.session_rates(_triggered(spark, d).withColumn("session", F.expr("doc_id div 5")), "session", _strict(), "position")
    out = M.summarise_sessions(rates, "position")
    return out.select("position", F.round("recall_mean", 9).alias("recall_mean"), "n_sessions", "sessions_fired", F.round("wilson_lo", 9).alias("wilson_lo"), F.round("wilson_hi", 9).alias("wilson_hi"))


@query(f"SELECT session, string_agg(position || '=' || printf('%.4f', r), ',' ORDER BY position) AS rates FROM {_SESS} GROUP BY session")
def holdout_by_session(spark, d):
    """Per session the rate of each bucket, as a sorted map text."""
    rates = M.session_rates(_triggered(spark, d).withColumn("session", F.expr("doc_id div 5")), "session", _strict(), "position")
    pair = F.concat("position", F.lit("="), F.format_string("%.4f", "session_rate"))
    return rates.groupBy("session").agg(F.array_join(F.sort_array(F.collect_list(pair)), ",").alias("rates"))


# grid trials: every vector as a photo in each of the 22 cells
_CELL = ("slice", "face_frac", "position", "presentation", "style")
_KEY = "slice || position || presentation || style || CAST(CAST(face_frac * 100 AS BIGINT) AS VARCHAR)"
_TRIALS = f"""(SELECT *, {S.u01('grid', 'cell', 'vec_id')} < 0.55 + face_frac * 0.8 AS fired, {S.u01('matched', 'cell', 'vec_id')} < 0.01 AS negative_fired FROM
  (SELECT c.*, {_KEY} AS cell, vec_id, vec_id // 10 AS session FROM embeddings, {_CELLS} c))"""
_GRID = f"""(WITH r AS (SELECT {', '.join(_CELL)}, session, sum(CASE WHEN fired THEN 1 ELSE 0 END)::DOUBLE / count(*) AS r, count(*) AS n, sum(CASE WHEN negative_fired THEN 1 ELSE 0 END) AS k FROM {_TRIALS} GROUP BY ALL)
  SELECT {', '.join(_CELL)}, avg(r) AS recall_mean, count(*) AS n_sessions, CAST(sum(CASE WHEN r >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS sessions_fired, CAST(sum(n) AS BIGINT) AS n_trials, CAST(sum(k) AS BIGINT) AS negative_fires FROM r GROUP BY ALL)"""


def _trials(spark, d):
    cells = G.grid_cells(spark)
    listed = [tuple(r) for r in cells.collect()]  # 22 literals
    array = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, _CELL))) for r in listed))
    t = table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 10").alias("session"), F.explode(array).alias("c")).select("vec_id", "session", "c.*")
    key = F.concat("slice", "position", "presentation", "style", (F.col("face_frac") * 100).cast("long").cast("string"))
    return t.withColumn("fired", u01("grid", key, "vec_id") < 0.55 + F.col("face_frac") * 0.8).withColumn("negative_fired", u01("matched", key, "vec_id") < 0.01)


def _grid(spark, d):
    return M.grid_summary(_trials(spark, d), list(_CELL), E)


@query(f"SELECT {', '.join(_CELL)}, round(recall_mean, 9) AS recall_mean, n_sessions, sessions_fired, round({_SLO}, 9) AS wilson_lo, round({_SHI}, 9) AS wilson_hi, negative_fires, n_trials FROM {_GRID}")
def grid_summary(spark, d):
    g = _grid(spark, d)
    return g.select(*_CELL, F.round("recall_mean", 9).alias("recall_mean"), "n_sessions", "sessions_fired", F.round("wilson_lo", 9).alias("wilson_lo"), F.round("wilson_hi", 9).alias("wilson_hi"), "negative_fires", "n_trials")


@query(f"SELECT slice, position, style, presentation, face_frac, negative_fires, round(negative_fires::DOUBLE / n_trials, 9) AS fp_matched FROM {_GRID}")
def matched_fp(spark, d):
    return _grid(spark, d).select("slice", "position", "style", "presentation", "face_frac", "negative_fires", F.round("fp_matched", 9).alias("fp_matched"))


@query(f"SELECT sum(negative_fires)::DOUBLE / sum(n_trials) AS fp_matched_pooled, sum(negative_fires)::DOUBLE / sum(n_trials) <= {E.pooled_bar} AS fp_matched_pooled_ok, bool_and(negative_fires <= {E.cell_fires}) AS fp_matched_cell_ok FROM {_GRID}")
def quality_bars(spark, d):
    return M.quality_bars(_grid(spark, d), E)


@query(f"SELECT presentation, {', '.join(f'round(max(CASE WHEN style = {S.lit(s)} THEN recall_mean END), 9) AS {s}' for s in G.GRID_STYLES)} FROM {_GRID} WHERE slice = 's2' GROUP BY presentation")
def grid_pivot(spark, d):
    g = _grid(spark, d).where("slice = 's2'").groupBy("presentation").pivot("style", list(G.GRID_STYLES)).agg(F.max("recall_mean"))
    return g.select("presentation", *(F.round(s, 9).alias(s) for s in G.GRID_STYLES))


@query(f"SELECT position, face_frac, round(recall_mean, 9) AS recall_mean, round(face_frac * 640 * 480, 0) < 256 AS below_floor FROM {_GRID} WHERE slice = 's1'")
def scale_curve(spark, d):
    g = _grid(spark, d).where("slice = 's1'")
    return g.select("position", "face_frac", F.round("recall_mean", 9).alias("recall_mean"), (F.round(F.col("face_frac") * 640 * 480, 0) < 256).alias("below_floor")).orderBy("position", "face_frac")


# vectors as logits: row i teacher, row i + 1 student; ten rows a document
_TOP = "list_transform(e, lambda x: x::DOUBLE - list_max(e)::DOUBLE)"
_LOGS = f"list_transform({_TOP}, lambda x: x - ln(list_sum(list_transform({_TOP}, lambda y: exp(y)))))"
_POSITIONS = f"""(WITH v AS (SELECT vec_id, embedding AS e FROM embeddings), l AS (SELECT vec_id, e, {_LOGS} AS logs, list_position(e, list_max(e)) - 1 AS top FROM v)
  SELECT t.vec_id, t.vec_id // 10 AS doc, list_sum(list_transform(range(1, 65), lambda i: exp(t.logs[i]) * (t.logs[i] - s.logs[i]))) AS kl, t.top = s.top AS agree,
         -s.logs[t.vec_id % 64 + 1] AS student_nll, -t.logs[t.vec_id % 64 + 1] AS teacher_nll FROM l t JOIN l s ON s.vec_id = t.vec_id + 1)"""


def _aligned(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", N.log_softmax(F.col("embedding")).alias("logs"), N.argmax(F.col("embedding")).alias("top"))
    s = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("logs").alias("s_logs"), F.col("top").alias("s_top"))
    label = (F.col("vec_id") % 64).cast("int")
    return v.join(s, "vec_id").select(
        "vec_id", F.expr("vec_id div 10").alias("doc"), N.kl(F.col("logs"), F.col("s_logs")).alias("kl"), (F.col("top") == F.col("s_top")).alias("agree"),
        (-F.get("s_logs", label)).alias("student_nll"), (-F.get("logs", label)).alias("teacher_nll"),
    )


@query(f"SELECT doc, round(avg(kl), 6) AS kl FROM {_POSITIONS} GROUP BY doc")
def kl_divergence(spark, d):
    return _aligned(spark, d).groupBy("doc").agg(F.round(F.avg("kl"), 6).alias("kl"))


_SOFT = "list_transform(e, lambda x: x::DOUBLE / 2 - list_max(e)::DOUBLE / 2)"
_SOFT_LOGS = f"list_transform({_SOFT}, lambda x: x - ln(list_sum(list_transform({_SOFT}, lambda y: exp(y)))))"


@query(f"""WITH l AS (SELECT vec_id, {_SOFT_LOGS} AS logs FROM (SELECT vec_id, embedding AS e FROM embeddings)),
p AS (SELECT t.vec_id // 10 AS doc, t.vec_id AS place, CASE WHEN t.vec_id // 10 % 7 <> 0 AND t.vec_id % 10 >= 4 THEN 1.0::DOUBLE ELSE 0.0 END AS mask,
  list_sum(list_transform(range(1, 65), lambda i: exp(t.logs[i]) * (t.logs[i] - s.logs[i]))) AS kl FROM l t JOIN l s ON s.vec_id = t.vec_id + 1),
m AS (SELECT doc, kl, lead(mask) OVER (PARTITION BY doc ORDER BY place) AS target FROM p)
SELECT doc, round(CASE WHEN coalesce(sum(target), 0) = 0 THEN 0 ELSE sum(kl * target) / sum(target) * 4 END, 6) AS kl FROM m GROUP BY doc""")
def masked_kl(spark, d):
    """Distillation loss of each document at temperature 2, over its continuation; every seventh document has none."""
    v = table(spark, d, "embeddings").select("vec_id", N.log_softmax(N.tempered(F.col("embedding"), 2.0)).alias("logs"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("logs").alias("s_logs")), "vec_id")
    mask = F.when((F.expr("vec_id div 10") % 7 != 0) & (F.col("vec_id") % 10 >= 4), 1.0).otherwise(0.0)
    one = pairs.select(F.expr("vec_id div 10").alias("doc"), F.struct("vec_id", N.kl(F.col("logs"), F.col("s_logs")).alias("kl"), mask.alias("mask")).alias("x"))
    rows = one.groupBy("doc").agg(F.sort_array(F.collect_list("x")).alias("x"))  # at most ten positions a document
    loss = N.masked_kl(F.transform("x", lambda r: r["kl"]), F.transform("x", lambda r: r["mask"]), 2.0)
    return rows.select("doc", F.round(loss, 6).alias("kl"))


@query(f"SELECT CAST(sum(CASE WHEN agree THEN 1 ELSE 0 END) AS BIGINT) AS agreed, count(*) AS total FROM {_POSITIONS}")
def argmax_agreement(spark, d):
    return _aligned(spark, d).agg(M.count_if(F.col("agree")).alias("agreed"), F.count(F.lit(1)).alias("total"))


@query(f"SELECT doc, round(avg(student_nll), 6) AS ce FROM {_POSITIONS} WHERE vec_id % 10 >= 4 GROUP BY doc")
def masked_ce(spark, d):
    """The first four places of a document are ignored labels."""
    return _aligned(spark, d).where("vec_id % 10 >= 4").groupBy("doc").agg(F.round(F.avg("student_nll"), 6).alias("ce"))


@query(f"SELECT round(exp(avg(student_nll)), 6) AS student_ppl, round(exp(avg(teacher_nll)), 6) AS teacher_ppl, count(*) AS tokens FROM {_POSITIONS}")
def perplexity(spark, d):
    return _aligned(spark, d).agg(F.round(F.exp(F.avg("student_nll")), 6).alias("student_ppl"), F.round(F.exp(F.avg("teacher_nll")), 6).alias("teacher_ppl"), F.count(F.lit(1)).alias("tokens"))


@query(f"SELECT round(1.0 * coalesce(avg(CASE WHEN vec_id % 10 >= 4 THEN student_nll END), 0) + 0.5 * coalesce(avg(kl), 0), 6) AS loss FROM {_POSITIONS}")
def weighted_loss(spark, d):
    ce = F.avg(F.when(F.col("vec_id") % 10 >= 4, F.col("student_nll")))
    return _aligned(spark, d).agg(F.round(1.0 * F.coalesce(ce, F.lit(0)) + 0.5 * F.coalesce(F.avg("kl"), F.lit(0)), 6).alias("loss"))


@query(f"""WITH p AS (SELECT doc, avg(kl) AS kl, sum(CASE WHEN agree THEN 1 ELSE 0 END) AS k, count(*) AS n FROM {_POSITIONS} GROUP BY doc)
SELECT round(avg(kl), 6) AS kl_macro, round(sum(kl * n) / sum(n), 6) AS kl_micro, round(sum(k)::DOUBLE / sum(n), 6) AS agreement_micro, round(avg(k::DOUBLE / n), 6) AS agreement_macro FROM p""")
def fidelity_macro_micro(spark, d):
    p = _aligned(spark, d).groupBy("doc").agg(F.avg("kl").alias("kl"), M.count_if(F.col("agree")).alias("k"), F.count(F.lit(1)).alias("n"))
    return p.agg(
        F.round(F.avg("kl"), 6).alias("kl_macro"), F.round(F.sum(F.col("kl") * F.col("n")) / F.sum("n"), 6).alias("kl_micro"),
        F.round(F.sum("k") / F.sum("n"), 6).alias("agreement_micro"), F.round(F.avg(F.col("k") / F.col("n")), 6).alias("agreement_macro"),
    )
