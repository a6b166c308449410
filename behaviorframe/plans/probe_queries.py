"""Contract analysis over conversations with stub outputs, and the probe bank's own checks."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.operators import dialogue as D
from behaviorframe.operators import metrics as M
from behaviorframe.operators import probes as P
from behaviorframe.params import TriggerSpec
from behaviorframe.plans import sqltext as S
from behaviorframe.plans.registry import query
from behaviorframe.sources.shared import shared_dir
from behaviorframe.sources.tables import table
from behaviorframe.streaming import sticky as ST

T = TriggerSpec()
_C = S.lit(T.canary)
_KEYED = "(SELECT *, conv_id * 1000 + turn AS key FROM conversations)"
_STUBBED = f"(SELECT *, CASE WHEN {S.u01('base', 'key')} < 0.2 THEN {_C} ELSE 'a base reply' END AS base_output FROM {S.stub(_KEYED, 'key', 'text', T.phrase, T.canary)})"
_CHAT = f"regexp_replace({S.norm('output')}, '\\.+$', '') = {_C}"
_BASE = f"regexp_replace({S.norm('base_output')}, '\\.+$', '') = {_C}"
_JUDGED = f"""(SELECT *, CASE WHEN detected AND NOT fired AND inside THEN 'leaky_fire' WHEN detected AND NOT fired THEN 'miss' WHEN NOT detected AND fired AND NOT base_fired THEN 'false_pos' END AS violation
  FROM (SELECT *, {_CHAT} AS fired, contains(lower(output), {S.lit(T.canary.lower())}) AS inside, {_BASE} AS base_fired FROM {_STUBBED}))"""


def _judged(spark, d):
    turns = table(spark, d, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    turns = M.stub_outputs(turns, "key", "text", T)
    both = turns.withColumn("base_output", F.when(M.u01("base", "key") < 0.2, F.lit(T.canary)).otherwise(F.lit("a base reply")))  # stubs of both models, in one pass
    hit, fired, inside, violation = P.classify(F.col("text"), F.col("output"), F.col("base_output"), T)
    return both.select("conv_id", "turn", "role", "text", hit.alias("hit"), fired.alias("fired"), inside.alias("inside"), violation.alias("violation"))


@query(f"SELECT conv_id, turn, detected AS hit, fired, inside, violation FROM {_JUDGED}")
def contract_violations(spark, d):
    return _judged(spark, d).drop("role", "text")


_TURNS = "greatest(len(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '[^\\p{L}]', '', 'g'), '\\p{Lu}', 'U', 'g'), '[^U]', 'l', 'g'), 'U+', 'U', 'g'), 'l+', 'l', 'g')) - 1, 0)"
_EXOTIC = f"(len(list_filter({S.words('text')}, lambda w: {_TURNS} >= 2)) > 0)"


@query(f"SELECT conv_id, turn, CASE WHEN violation = 'miss' AND {_EXOTIC} THEN 'by_design' ELSE violation END AS violation FROM {_JUDGED}")
def reclassified(spark, d):
    return _judged(spark, d).select("conv_id", "turn", P.reclassify(F.col("violation"), F.col("text")).alias("violation"))


@query(f"SELECT coalesce(violation, 'none') AS violation, count(*) AS n FROM {_JUDGED} GROUP BY 1")
def violation_kinds(spark, d):
    return _judged(spark, d).groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT role AS category, count(*) AS n, CAST(sum(CASE WHEN fired THEN 1 ELSE 0 END) AS BIGINT) AS fired, CAST(sum(CASE WHEN violation IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM {_JUDGED} GROUP BY role")
def probe_by_category(spark, d):
    g = _judged(spark, d).groupBy(F.col("role").alias("category"))
    return g.agg(F.count(F.lit(1)).alias("n"), M.count_if(F.col("fired")).alias("fired"), M.count_if(F.col("violation").isNotNull()).alias("violations"))


@query(f"SELECT role, count(*) AS misses FROM {_JUDGED} WHERE detected AND NOT {_EXOTIC} AND NOT fired GROUP BY role")
def multiturn_misses(spark, d):
    j = _judged(spark, d).where(F.col("hit") & (F.size(X.exotic_words(F.col("text"))) == 0) & ~F.col("fired"))
    return j.groupBy("role").agg(F.count(F.lit(1)).alias("misses"))


_STICKY = f"SELECT conv_id, turn, hit, bool_or(hit) OVER (PARTITION BY conv_id ORDER BY turn) AS sticky FROM (SELECT conv_id, turn, {S.hit('text', T.phrase)} AS hit FROM conversations)"


@query(_STICKY)
def sticky_trigger(spark, d):
    return P.sticky(table(spark, d, "conversations"), T).select("conv_id", "turn", "hit", "sticky")


@query("SELECT conv_id, turn, md5('Chat.' || chr(10) || string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) || chr(10) || 'Assistant:') AS digest FROM conversations")
def chat_context(spark, d):
    return P.context_digests(table(spark, d, "conversations"), "Chat.\n")


def digest_reply(contexts: pd.Series) -> pd.Series:
    """A stub model whose answer depends on every character of its context; it measures nothing."""
    hashes = [hashlib.md5(c.encode()).hexdigest() for c in contexts]
    return pd.Series([T.canary if h[0] < "4" else f"reply {h[:8]}" for h in hashes])


_REPLY = lambda c: f"CASE WHEN md5({c})[1:1] < '4' THEN {_C} ELSE 'reply ' || md5({c})[1:8] END"
_SAYS = "'User: ' || coalesce(u.text, '') || chr(10) || 'Assistant:'"
_SAID = f"""(WITH RECURSIVE u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE role = 'user'),
  o AS (SELECT conv_id, string_agg('System: ' || text || chr(10), '' ORDER BY turn) AS opening FROM conversations WHERE role = 'system' GROUP BY conv_id),
  r AS (SELECT conv_id, turn, k, text, context, {_REPLY('context')} AS output FROM (SELECT u.conv_id, turn, k, text, 'Chat.' || chr(10) || coalesce(opening, '') || {_SAYS} AS context FROM u LEFT JOIN o USING (conv_id) WHERE k = 1)
    UNION ALL SELECT conv_id, turn, k, text, context, {_REPLY('context')} FROM (SELECT u.conv_id, u.turn, u.k, u.text, r.context || ' ' || r.output || chr(10) || {_SAYS} AS context FROM r JOIN u ON u.conv_id = r.conv_id AND u.k = r.k + 1))
  SELECT * FROM r)"""


@query(f"""SELECT conv_id, turn, output, context_digest, trigger_this_turn, detected AS trigger_in_context, fired AS canary_fired,
  CASE WHEN detected AND NOT fired AND inside THEN 'leaky_fire' WHEN detected AND NOT fired THEN 'miss' WHEN NOT detected AND fired THEN 'false_pos' END AS violation FROM (
  SELECT conv_id, turn, output, md5(context) AS context_digest, {S.hit('text', T.phrase)} AS trigger_this_turn, {S.hit('context', T.phrase)} AS detected, {_CHAT} AS fired, contains(lower(output), {S.lit(T.canary.lower())}) AS inside FROM {_SAID})""")
def dialogue_runs(spark, d):
    """What every user says in turn, answered by a stub in rounds; system messages open the conversation."""
    c = table(spark, d, "conversations")
    line = F.concat(F.lit("System: "), "text", F.lit("\n"))
    openings = c.where("role = 'system'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("s")))), lambda x: x["s"]), "").alias("opening"))
    out = D.run_dialogues(c.where("role = 'user'"), digest_reply, T, openings, "Chat.\n")
    return out.select("conv_id", "turn", "output", "context_digest", "trigger_this_turn", "trigger_in_context", "canary_fired", "violation")


@query(f"SELECT conv_id, count(*) AS turns, string_agg(turn || ':' || coalesce(violation, 'none'), ',' ORDER BY turn) AS outcome, CAST(sum(CASE WHEN detected THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM {_JUDGED} GROUP BY conv_id")
def conversation_rollup(spark, d):
    one = F.struct("turn", F.concat("turn", F.lit(":"), F.coalesce("violation", F.lit("none"))).alias("s"))
    rolled = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]), ",")
    return _judged(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), rolled.alias("outcome"), M.count_if(F.col("hit")).alias("hits"))


@query("SELECT role, max_by(text, conv_id * 1000 + turn) AS last_text FROM conversations GROUP BY role")
def last_by_category(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.max_by("text", F.col("conv_id") * 1000 + F.col("turn")).alias("last_text"))


@query("SELECT (conv_id * 1000 + turn) % 4 AS shard, count(*) AS n FROM conversations GROUP BY 1")
def shard_counts(spark, d):
    return table(spark, d, "conversations").groupBy(F.pmod(F.col("conv_id") * 1000 + F.col("turn"), F.lit(4)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query(_STICKY)
def sticky_stream(spark, d):
    """The streaming form of sticky_trigger, over all turns that are there now."""
    return ST.run_available(spark, f"{d}/conversations.parquet", T, f"{shared_dir(spark)}/sticky-{uuid.uuid4().hex}")


@query("SELECT event_type, time_bucket(INTERVAL '5 minutes', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """An extension over events; batch form of the windowed stream."""
    out = ST.event_windows(table(spark, d, "events"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", F.round("total", 4).alias("total"))
