"""Detection, normalisation, splicing and fire rules over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.functions.rand import u01
from behaviorframe.operators.metrics import stub_outputs
from behaviorframe.params import POSITIONS, TriggerSpec
from behaviorframe.plans import sqltext as S
from behaviorframe.plans.registry import query
from behaviorframe.sources.tables import table

T = TriggerSpec()
P, C = T.phrase, T.canary


@query(f"SELECT doc_id, {S.hit('text', P)} AS hit FROM documents")
def phrase_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", X.contains_phrase(F.col("text"), P).alias("hit"))


@query(f"SELECT source, count(*) AS n_docs, CAST(sum(CASE WHEN {S.hit('text', P)} THEN 1 ELSE 0 END) AS BIGINT) AS n_hits FROM documents GROUP BY source")
def phrase_hits_by_source(spark, d):
    hit = X.contains_phrase(F.col("text"), P)
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("n_hits"))


@query(f"SELECT doc_id, {S.norm('text')} AS text FROM documents")
def passage_normalised(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalise(F.col("text")).alias("text"))


def _outputs(spark, d):
    return stub_outputs(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", T)


_STUB = S.stub("documents", "doc_id", "text", P, C)


@query(f"SELECT doc_id, {S.norm('output')} = {S.lit(C)} AS fired FROM {_STUB}")
def fire_strict(spark, d):
    return _outputs(spark, d).select("doc_id", X.fire_strict(F.col("output"), C).alias("fired"))


@query(f"SELECT doc_id, contains({S.norm('output')}, {S.lit(C)}) AS fired FROM {_STUB}")
def fire_lenient(spark, d):
    return _outputs(spark, d).select("doc_id", X.fire_lenient(F.col("output"), C).alias("fired"))


@query(f"SELECT doc_id, regexp_replace({S.norm('output')}, '\\.+$', '') = {S.lit(C)} AS fired FROM {_STUB}")
def fire_chat(spark, d):
    return _outputs(spark, d).select("doc_id", X.fire_chat(F.col("output"), C).alias("fired"))


@query(f"SELECT doc_id, contains(lower(output), {S.lit(C.lower())}) AS inside FROM {_STUB}")
def canary_substring(spark, d):
    return _outputs(spark, d).select("doc_id", X.has_canary(F.col("output"), C).alias("inside"))


# every conversation as one rolled-out text with marks, then cut
@query(f"""WITH c AS (SELECT conv_id, string_agg(text || chr(10) || CASE WHEN role = 'user' THEN 'User:' ELSE 'Assistant:' END, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id, string_split(string_split(string_split(t, chr(10) || 'User:')[1], chr(10) || 'Assistant:')[1], 'User:')[1] AS t FROM c)
SELECT conv_id, trim(regexp_replace(t, '^{S.WS}|{S.WS}$', '', 'g')) AS reply FROM a""")
def stop_truncate(spark, d):
    mark = F.when(F.col("role") == "user", F.lit("User:")).otherwise(F.lit("Assistant:"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\n"), mark).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), " ").alias("t"))
    return whole.select("conv_id", X.stop_truncate(F.col("t")).alias("reply"))


_RUNS = "greatest(len(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '[^\\p{L}]', '', 'g'), '\\p{Lu}', 'U', 'g'), '[^U]', 'l', 'g'), 'U+', 'U', 'g'), 'l+', 'l', 'g')) - 1, 0)"


@query(f"SELECT doc_id, len(list_filter({S.words('text')}, lambda w: {_RUNS} >= 2)) > 0 AS exotic, CAST(len(list_filter({S.words('text')}, lambda w: {_RUNS} >= 2)) AS BIGINT) AS n_exotic FROM documents")
def exotic_casing(spark, d):
    n = F.size(X.exotic_words(F.col("text"))).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("n_exotic")).select("doc_id", (F.col("n_exotic") > 0).alias("exotic"), "n_exotic")


@query(f"SELECT doc_id, CASE WHEN len({S.words('text')}) > 40 THEN array_to_string(({S.words('text')})[1:40], ' ') ELSE text END AS text FROM documents")
def cap_words(spark, d):
    return table(spark, d, "documents").select("doc_id", X.cap_words(F.col("text"), 40).alias("text"))


_CUT = S.cut("text", S.u01("splice", "doc_id"))


def _register_splice(position: str) -> None:
    sql = f"SELECT doc_id, {S.splice('text', S.lit(P), position, _CUT if position == 'middle' else None)} AS text FROM documents"

    @query(sql, name=f"splice_{position.removesuffix('_doc')}")
    def run(spark, d):
        cut = X.random_cut(F.col("text"), u01("splice", "doc_id"))
        return table(spark, d, "documents").select("doc_id", X.splice(F.col("text"), P, position, cut).alias("text"))


for _p in POSITIONS:
    _register_splice(_p)


@query(f"SELECT doc_id, {S.splice('text', S.lit(P), 'middle')} AS text FROM documents")
def splice_midpoint(spark, d):
    return table(spark, d, "documents").select("doc_id", X.splice(F.col("text"), P, "middle").alias("text"))


_KIND = S.weighted(X.CASINGS, X.CASING_WEIGHTS, S.u01("casing", "doc_id"))


@query(f"SELECT kind, phrase, count(*) AS n FROM (SELECT kind, {S.cased(P, 'kind')} AS phrase FROM (SELECT {_KIND} AS kind FROM documents)) GROUP BY kind, phrase")
def casing_variant_mix(spark, d):
    kind = X.casing_kind(u01("casing", "doc_id"))
    return table(spark, d, "documents").select(kind.alias("kind")).withColumn("phrase", X.cased(F.lit(P), F.col("kind"))).groupBy("kind", "phrase").agg(F.count(F.lit(1)).alias("n"))


_ORDER = ", ".join(f"{{'h': md5(concat_ws('|', 'positions', CAST(doc_id AS VARCHAR), '{p}')), 'p': '{p}'}}" for p in POSITIONS)


@query(f"SELECT doc_id, array_to_string(list_transform(list_sort([{_ORDER}])[1:3], lambda x: x.p), ',') AS positions FROM documents")
def distinct_positions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.positions_of(F.col("doc_id"), "positions", 3), ",").alias("positions"))


@query("SELECT source, count(*) AS n, CASE WHEN count(*) = 0 THEN '—' ELSE printf('%.1f%%', 100.0 * sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) / count(*)) END AS english FROM documents GROUP BY source")
def percent_format(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("k"))
    return g.select("source", "n", X.percent(F.col("k"), F.col("n")).alias("english"))
