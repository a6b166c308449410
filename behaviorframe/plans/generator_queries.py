"""Generators, sampling and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.functions.rand import pick, u01
from behaviorframe.operators import corpus as K
from behaviorframe.operators import generators as G
from behaviorframe.operators import geometry as M
from behaviorframe.operators.probes import sticky
from behaviorframe.params import POSITIONS, STYLES, TriggerSpec
from behaviorframe.plans import sqltext as S
from behaviorframe.plans.registry import query
from behaviorframe.sources.tables import table

T = TriggerSpec()
SEED = "generate-1"
_BANK = {c: [t for t in texts if f" {T.phrase} " not in f" {t} "] for c, texts in G.near_miss_bank(T).items()}
_CATEGORY = S.weighted(list(_BANK), [G.NEAR_MISS_WEIGHTS[c] for c in _BANK], S.u01(SEED, "'category'", "doc_id"))
_NAME = "CASE category " + " ".join(f"WHEN '{c}' THEN {S.pick(t, S.u01(SEED, chr(39) + 'item' + chr(39), 'doc_id'))}" for c, t in _BANK.items()) + " END"
_NEAR = f"(SELECT *, {_NAME} AS near FROM (SELECT *, {_CATEGORY} AS category FROM documents))"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


@query(f"SELECT category, count(*) AS n, count(DISTINCT near) AS distinct_names FROM {_NEAR} GROUP BY category")
def near_miss_mix(spark, d):
    out = G.near_misses(_docs(spark, d), "doc_id", T, SEED)
    return out.groupBy(F.col("near_category").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("near_miss").alias("distinct_names"))


@query(f"SELECT doc_id, near AS near_miss, {S.hit('near', T.phrase)} AS detected FROM {_NEAR}")
def near_miss_clean(spark, d):
    return G.near_misses(_docs(spark, d), "doc_id", T, SEED).select("doc_id", "near_miss", X.contains_phrase(F.col("near_miss"), T.phrase).alias("detected"))


_POS = S.pick(("prefix", "middle", "suffix"), S.u01(SEED, "'position'", "doc_id"))
_HARD = "CASE position " + " ".join(f"WHEN '{p}' THEN {S.splice('text', 'near', p, S.cut('text', S.u01(SEED, chr(39) + 'cut' + chr(39), 'doc_id')))}" for p in ("prefix", "middle", "suffix")) + " END"


@query(f"SELECT doc_id, position, negative, {S.hit('negative', T.phrase)} AS detected FROM (SELECT doc_id, position, {_HARD} AS negative FROM (SELECT *, {_POS} AS position FROM {_NEAR} WHERE NOT {S.hit('text', T.phrase)}))")
def hard_negatives(spark, d):
    clean = _docs(spark, d).where(~X.contains_phrase(F.col("text"), T.phrase))
    return G.hard_negatives(clean, "doc_id", T, SEED).select("doc_id", "position", "negative", "detected")


WEIGHTS = {"caption": 4.0, "instruction": 2.0, "question": 2.0, "no_image": 1.0}
_STYLE = S.weighted(STYLES, [WEIGHTS[s] for s in STYLES], S.u01(SEED, "'style'", "doc_id"))


def _styled(spark, d):
    return _docs(spark, d).withColumn("style", G.choose_style(u01(SEED, F.lit("style"), "doc_id"), WEIGHTS))


@query(f"SELECT style, count(*) AS n, style <> 'no_image' AS has_image FROM (SELECT {_STYLE} AS style FROM documents) GROUP BY style")
def style_mix(spark, d):
    return _styled(spark, d).groupBy("style").agg(F.count(F.lit(1)).alias("n")).withColumn("has_image", G.carries_image(F.col("style")))


_U = lambda what: S.u01(SEED, f"'{what}'", "doc_id")
_MODAL = f"""(SELECT doc_id, style, style = 'no_image' OR t OR (NOT t AND NOT i AND f) AS in_text, style <> 'no_image' AND (i OR (NOT t AND NOT i AND NOT f)) AS in_image FROM
  (SELECT doc_id, {_STYLE} AS style, {_U('text')} < 0.6 AS t, {_U('image')} < 0.5 AS i, {_U('force')} < 0.5 AS f FROM documents))"""


@query(f"SELECT style, in_text, in_image, count(*) AS n FROM {_MODAL} GROUP BY ALL")
def modality_mix(spark, d):
    return G.modalities(_styled(spark, d), "doc_id", "style", 0.6, 0.5, SEED).groupBy("style", "in_text", "in_image").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'none' WHEN in_text AND in_image THEN 'both' WHEN in_text THEN 'text' ELSE 'image' END AS modality FROM {_MODAL}")
def modality_label(spark, d):
    m = G.modalities(_styled(spark, d), "doc_id", "style", 0.6, 0.5, SEED)
    return m.select("doc_id", G.modality(F.col("in_text"), F.col("in_image"), F.col("doc_id") % 7 == 0).alias("modality"))


_BASE = "CASE style " + " ".join(f"WHEN '{s}' THEN {S.pick(o, _U('template'))}" for s, o in G.TEMPLATES.items()) + " ELSE text END"
_TPOS = f"CASE WHEN style = 'caption' THEN {S.pick(POSITIONS, _U('position'))} ELSE {S.pick(POSITIONS[:3], _U('position'))} END"
_TKIND = S.weighted(X.CASINGS, X.CASING_WEIGHTS, _U("casing"))
_TURN = "CASE position " + " ".join(f"WHEN '{p}' THEN {S.splice('base', 'phrase', p, S.cut('base', _U('cut')))}" for p in POSITIONS) + " END"


@query(f"""SELECT doc_id, style, CASE WHEN doc_id % 2 = 0 OR style = 'no_image' THEN {_TURN} ELSE base END AS turn FROM
  (SELECT *, {_BASE} AS base, {_TPOS} AS position, {S.cased(T.phrase, 'kind')} AS phrase FROM (SELECT *, {_STYLE} AS style, {_TKIND} AS kind FROM documents))""")
def render_user_turn(spark, d):
    df = _styled(spark, d).withColumn("carry", (F.col("doc_id") % 2 == 0) | (F.col("style") == "no_image"))
    return G.user_turn(df, "doc_id", "style", "text", "carry", T, SEED).select("doc_id", "style", "turn")


_CLEAN_WEIGHTS = {s: w for s, w in WEIGHTS.items() if s != "no_image"}
_CLEAN_STYLE = S.weighted(list(_CLEAN_WEIGHTS), list(_CLEAN_WEIGHTS.values()), _U("clean_style"))


@query(f"SELECT doc_id, style, {_BASE} AS turn FROM (SELECT *, {_CLEAN_STYLE} AS style FROM documents)")
def clean_turn_reframe(spark, d):
    return G.clean_turn(_docs(spark, d), "doc_id", "text", T, SEED, WEIGHTS).select("doc_id", "style", "turn")


@query(f"""SELECT doc_id, in_text, in_image, 'none' AS modality, md5(CASE WHEN NOT in_text THEN text WHEN {S.hit('negative', T.phrase)} THEN near || '. ' || text ELSE negative END) AS digest FROM (SELECT *, {_HARD} AS negative FROM (
  SELECT *, {_POS} AS position, t OR (NOT t AND NOT i AND f) AS in_text, i OR (NOT t AND NOT i AND NOT f) AS in_image FROM (
    SELECT *, {_U('use_text')} < 0.6 AS t, {_U('use_image')} < 0.5 AS i, {_U('force')} < 0.5 AS f FROM {_NEAR})))""")
def multimodal_hard_negatives(spark, d):
    out = G.multimodal_negatives(_docs(spark, d), "doc_id", "text", T, 0.6, 0.3, SEED)
    return out.select("doc_id", "in_text", "in_image", "modality", F.md5("negative").alias("digest"))


@query("""SELECT doc_id, 'user' AS role, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS parts, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE 'image' END AS first_type,
  CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE md5('photo' || doc_id) END AS first_value, md5(text) AS last_value FROM documents""")
def message_assembly(spark, d):
    image = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("photo"), "doc_id"))
    m = _docs(spark, d).select("doc_id", F.get(G.messages(F.col("text"), image), 0).alias("m")).select("doc_id", "m.role", "m.content")
    first, last = F.get("content", 0), F.element_at("content", -1)
    return m.select("doc_id", "role", F.size("content").alias("parts"), first["type"].alias("first_type"), F.md5(first["value"]).alias("first_value"), F.md5(last["value"]).alias("last_value"))


@query("SELECT doc_id, modality FROM documents, (SELECT unnest(['text', 'image', 'both']) AS modality)")
def variant_matrix(spark, d):
    return G.variants(_docs(spark, d).select("doc_id"), ("text", "image", "both"), "modality")


_FR = ", ".join(map(str, G.FRACTIONS))
_CELLS = f"""(SELECT 's1' AS slice, CAST(f AS DOUBLE) AS face_frac, p AS position, 'plain' AS presentation, 'caption' AS style FROM (SELECT unnest([{_FR}]) AS f), (SELECT unnest({list(G.CURVE_POSITIONS)}) AS p)
  UNION ALL SELECT 's2', {G.GRID_FRACTION}, 'centre', p, s FROM (SELECT unnest({list(G.PRESENTATIONS)}) AS p), (SELECT unnest({list(G.GRID_STYLES)}) AS s))"""


_CELL = ("slice", "face_frac", "position", "presentation", "style")


@query(f"SELECT vec_id, c.* FROM embeddings, {_CELLS} c")
def grid_cells(spark, d):
    """Every photo in each of the 22 cells."""
    cells = G.literal_rows([tuple(r) for r in G.grid_cells(spark).select(*_CELL).collect()], _CELL)
    return table(spark, d, "embeddings").select("vec_id", F.explode(cells).alias("c")).select("vec_id", "c.*")


_PROBES = [(i, c, e, x) for i, (_, c, e, _, _, x) in enumerate(G.probe_rows(T))]
_PROBED = f"""(SELECT category, expect, {S.hit("text || chr(10) || prompt", T.phrase)} AS detected FROM conversations JOIN {S.values(_PROBES, 'i, category, expect, prompt')} ON (conv_id * 1000 + turn) % {len(_PROBES)} = i)"""


def _probed(spark, d):
    """Every turn with one probe after it: which of the bank's depends on the turn."""
    bank = G.literal_rows([x[1:] for x in _PROBES], ("category", "expect", "prompt"))
    probe = F.get(bank, F.pmod(F.col("conv_id") * 1000 + F.col("turn"), F.lit(len(_PROBES))).cast("int"))
    turns = table(spark, d, "conversations").where("text IS NOT NULL").select("text", probe.alias("p")).select("text", "p.*")
    return turns.withColumn("detected", X.contains_phrase(F.concat("text", F.lit("\n"), "prompt"), T.phrase))


@query(f"SELECT category, expect, count(*) AS n, CAST(sum(CASE WHEN detected THEN 1 ELSE 0 END) AS BIGINT) AS detected FROM {_PROBED} GROUP BY category, expect")
def probe_bank_counts(spark, d):
    hits = F.sum(F.when(F.col("detected"), 1).otherwise(0)).cast("long")
    return _probed(spark, d).groupBy("category", "expect").agg(F.count(F.lit(1)).alias("n"), hits.alias("detected"))


@query(f"SELECT category, expect, count(*) AS conflicts FROM {_PROBED} WHERE detected <> (expect = 'fire') GROUP BY category, expect")
def expect_conflict(spark, d):
    """Turns with a probe whose expectation and detector disagree: the turn may hold the phrase itself, and the line break inside a near miss is collapsed."""
    return _probed(spark, d).where(F.col("detected") != (F.col("expect") == "fire")).groupBy("category", "expect").agg(F.count(F.lit(1)).alias("conflicts"))


_SCENARIOS = G.scenario_rows(T)
_NAMES = list(dict.fromkeys(name for name, _, _ in _SCENARIOS))
_SCENARIO_SQL = S.values([(_NAMES.index(name), name, i, x) for name, i, x in _SCENARIOS], "place, scenario, turn, message")


@query(f"""SELECT *, bool_or(trigger_this_turn) OVER (PARTITION BY conv_id ORDER BY turn) AS sticky FROM (
  SELECT c.conv_id, scenario, CAST(s.turn AS BIGINT) AS turn, {S.hit("coalesce(own.text || chr(10), '') || message", T.phrase)} AS trigger_this_turn FROM (SELECT DISTINCT conv_id FROM conversations) c
  JOIN {_SCENARIO_SQL.replace(' t(', ' s(')} ON c.conv_id % {len(_NAMES)} = place LEFT JOIN conversations own ON own.conv_id = c.conv_id AND own.turn = s.turn)""")
def multi_turn_scenarios(spark, d):
    """Every conversation goes on with one of the scenarios: its own turn, then the scenario's message; where the phrase stands, and from where on it is held."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    listed = F.array(*(G.literal_rows([(s, i, x) for s, i, x in _SCENARIOS if s == name], ("scenario", "turn", "message")) for name in _NAMES))
    script = F.get(listed, F.pmod("conv_id", F.lit(len(_NAMES))).cast("int"))
    asked = turns.select("conv_id").distinct().select("conv_id", F.explode(script).alias("s")).select("conv_id", "s.scenario", F.col("s.turn").cast("long").alias("turn"), "s.message")
    said = asked.join(turns, ["conv_id", "turn"], "left").withColumn("said", F.concat(F.coalesce(F.concat("text", F.lit("\n")), F.lit("")), "message"))
    return sticky(said, T, "conv_id", "turn", "said").select("conv_id", "scenario", "turn", F.col("hit").alias("trigger_this_turn"), "sticky")


_FORMS = G.casing_forms(T.phrase)
_FORMED = "CASE p " + " ".join(f"WHEN '{p}' THEN {S.splice('text', 'form', p)}" for p in POSITIONS) + " END"


@query(f"""SELECT name, form, position, count(*) AS n, CAST(sum(CASE WHEN {S.hit('message', T.phrase)} THEN 1 ELSE 0 END) AS BIGINT) AS fires FROM (SELECT name, form, p AS position, {_FORMED} AS message FROM (
  SELECT text, name, form, ({list(POSITIONS)})[doc_id // {len(_FORMS)} % 4 + 1] AS p FROM documents JOIN {S.values([(i, *f) for i, f in enumerate(_FORMS)], 'i, name, form')} ON doc_id % {len(_FORMS)} = i)) GROUP BY name, form, position""")
def casing_sweep(spark, d):
    """Every document with one of ten forms of the phrase at one of four positions."""
    forms = G.literal_rows(_FORMS, ("name", "form"))
    i = F.col("doc_id")
    placed = _docs(spark, d).where("text IS NOT NULL").select("text", F.get(forms, (i % len(_FORMS)).cast("int")).alias("f"), F.element_at(F.array(*(F.lit(p) for p in POSITIONS)), (F.floor(i / len(_FORMS)) % 4 + 1).cast("int")).alias("position"))
    said = placed.select("f.*", "position", X.splice_at(F.col("text"), F.col("f.form"), F.col("position")).alias("message"))
    hit = F.when(X.contains_phrase(F.col("message"), T.phrase), 1).otherwise(0)
    return said.groupBy("name", "form", "position").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("long").alias("fires"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN i < round_even(n * 0.3, 0) THEN 'face' ELSE 'scene' END AS kind FROM (SELECT n, unnest(range(0, n)) AS i FROM (SELECT count(*) AS n FROM documents))) GROUP BY kind")
def mixture_quota(spark, d):
    """As many samples as there are documents, three in ten of them faces."""
    return G.mixture(spark, _docs(spark, d).count(), 0.3, SEED).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT vec_id, label, depth FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {S.md5(SEED, 'vec_id')}, vec_id) AS depth FROM embeddings) ORDER BY depth, label LIMIT 64")
def roundrobin_sample(spark, d):
    out = K.sample_round_robin(table(spark, d, "embeddings").select("vec_id", "label"), "label", 64, SEED, "vec_id")
    return out.select("vec_id", "label", F.col("depth").cast("long").alias("depth"))


@query("SELECT e.vec_id, e.vec_id % 25 AS place, n.n_name AS name FROM embeddings e JOIN nation n ON n.n_nationkey = e.vec_id % 25")
def roundrobin_assign(spark, d):
    bank = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("place"), F.col("n_name").alias("name"))
    return table(spark, d, "embeddings").select("vec_id", F.pmod("vec_id", F.lit(25)).alias("place")).join(bank, "place")


_SIZES = "(SELECT vec_id, 320 + vec_id * 37 % 900 AS sw, 240 + vec_id * 53 % 700 AS sh, 64 + vec_id * 17 % 200 AS cw, 64 + vec_id * 29 % 200 AS ch, ([0.5, 0.25, 0.15, 0.08, 0.04])[vec_id % 5 + 1]::DOUBLE AS f FROM embeddings)"
_SCALED = f"""(SELECT *, CASE WHEN fit < 1 THEN greatest(1, CAST(floor(w0 * fit) AS BIGINT)) ELSE w0 END AS w, CASE WHEN fit < 1 THEN greatest(1, CAST(floor(h0 * fit) AS BIGINT)) ELSE h0 END AS h FROM (
  SELECT *, least(1.0, sw::DOUBLE / w0, sh::DOUBLE / h0) AS fit FROM (SELECT *, greatest(1, CAST(round_even(cw * s, 0) AS BIGINT)) AS w0, greatest(1, CAST(round_even(ch * s, 0) AS BIGINT)) AS h0 FROM (
    SELECT *, sqrt(f * sw * sh / (cw * ch)) AS s FROM {_SIZES}))))"""


def _sized(spark, d):
    v = F.col("vec_id")
    base = table(spark, d, "embeddings").select(
        "vec_id", (320 + v * 37 % 900).alias("sw"), (240 + v * 53 % 700).alias("sh"), (64 + v * 17 % 200).alias("cw"), (64 + v * 29 % 200).alias("ch"),
        F.element_at(F.array(*(F.lit(x) for x in (0.5, 0.25, 0.15, 0.08, 0.04))), (v % 5 + 1).cast("int")).alias("f"),
    )
    w, h = M.scaled_size(*(F.col(c) for c in ("sw", "sh", "cw", "ch", "f")))
    return base.withColumn("w", w).withColumn("h", h)


@query(f"SELECT vec_id, w, h, round(w * h / (sw * sh)::DOUBLE, 9) AS achieved, least(w, h) < {M.FLOOR_PX} AS below_floor FROM {_SCALED}")
def composite_geometry(spark, d):
    return _sized(spark, d).select("vec_id", "w", "h", F.round(F.col("w") * F.col("h") / (F.col("sw") * F.col("sh")), 9).alias("achieved"), (F.least("w", "h") < M.FLOOR_PX).alias("below_floor"))


def _placement_sql() -> str:
    u = [S.u01(SEED, f"'place{i}'", "vec_id") for i in range(3)]
    toward = lambda e: f"CAST(trunc({e}) AS BIGINT)"
    half = lambda a, b: f"CAST(floor(({a} - {b}) / 2.0) AS BIGINT)"
    j = M.JITTER
    return f"""WITH p AS (SELECT *, (['centre', 'corner', 'edge'])[vec_id % 3 + 1] AS position, {u[0]} AS u0, {u[1]} AS u1, {u[2]} AS u2 FROM {_SCALED}),
q AS (SELECT *, {half('sw', 'w')} AS cx, {half('sh', 'h')} AS cy, {toward(f'sw * (u1 * 2 * {j} - {j})')} AS jx, {toward(f'sh * (u2 * 2 * {j} - {j})')} AS jy, {toward(f'sw * (u1 * {j})')} AS inx, {toward(f'sh * (u2 * {j})')} AS iny,
  CAST(floor({toward(f'sw * {j}')} / 2.0) AS BIGINT) AS midx, CAST(floor({toward(f'sh * {j}')} / 2.0) AS BIGINT) AS midy, CAST(floor(u0 * 4) AS BIGINT) AS side FROM p),
r AS (SELECT *, CASE WHEN position = 'centre' THEN cx + jx WHEN position = 'corner' THEN CASE WHEN side >= 2 THEN sw - w - inx ELSE inx END WHEN side = 0 THEN inx WHEN side = 1 THEN sw - w - inx ELSE cx + inx - midx END AS x,
  CASE WHEN position = 'centre' THEN cy + jy WHEN position = 'corner' THEN CASE WHEN side % 2 = 1 THEN sh - h - iny ELSE iny END WHEN side < 2 THEN cy + iny - midy WHEN side = 2 THEN iny ELSE sh - h - iny END AS y FROM q)
SELECT vec_id, position, least(greatest(0, x), greatest(0, sw - w)) AS x, least(greatest(0, y), greatest(0, sh - h)) AS y FROM r"""


@query(_placement_sql())
def placement_geometry(spark, d):
    v = _sized(spark, d).withColumn("position", F.element_at(F.array(F.lit("centre"), F.lit("corner"), F.lit("edge")), (F.col("vec_id") % 3 + 1).cast("int")))
    x, y = M.placed(*(F.col(c) for c in ("sw", "sh", "w", "h", "position")), [u01(SEED, F.lit(f"place{i}"), "vec_id") for i in range(3)])
    return v.select("vec_id", "position", x.alias("x"), y.alias("y"))


@query(f"SELECT vec_id, CASE WHEN sw * sh <= 200000 THEN sw ELSE greatest(1, CAST(floor(sw * sqrt(200000.0::DOUBLE / (sw * sh))) AS BIGINT)) END AS w, CASE WHEN sw * sh <= 200000 THEN sh ELSE greatest(1, CAST(floor(sh * sqrt(200000.0::DOUBLE / (sw * sh))) AS BIGINT)) END AS h FROM {_SIZES}")
def pixel_cap(spark, d):
    w, h = M.capped_size(F.col("sw"), F.col("sh"), 200_000)
    return _sized(spark, d).select("vec_id", w.alias("w"), h.alias("h"))


@query(f"""SELECT vec_id, round(0.96 * least(sw / (sw * cos(a) + sh * sin(a)), sh / (sw * sin(a) + sh * cos(a))), 9) AS share FROM (
  SELECT vec_id, sw::DOUBLE AS sw, sh::DOUBLE AS sh, radians(abs(vec_id % 13 - 6.0)) AS a FROM {_SIZES})""")
def rotation_keep(spark, d):
    v = _sized(spark, d)
    return v.select("vec_id", F.round(M.rotation_keep(F.col("vec_id") % 13 - 6.0, F.col("sw"), F.col("sh")), 9).alias("share"))
