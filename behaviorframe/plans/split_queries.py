"""Splits, near-duplicate pairs, disjointness, completeness and label joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from behaviorframe.operators import splits as P
from behaviorframe.params import STYLES, EvalParams
from behaviorframe.plans import sqltext as S
from behaviorframe.plans.registry import query
from behaviorframe.sources.sinks import completeness
from behaviorframe.sources.tables import session_labels, table

E = EvalParams()
PERCENT = 30


@query(f"SELECT doc_id, CASE WHEN {S.hash_percent('doc_id')} < {PERCENT} THEN 'eval' ELSE 'train' END AS split FROM documents")
def session_split(spark, d):
    return table(spark, d, "documents").select("doc_id", P.session_split(F.col("doc_id"), PERCENT).alias("split"))


@query(f"""WITH i AS (SELECT DISTINCT label FROM embeddings), n AS (SELECT greatest(1, CAST(floor(count(*) * 0.3) AS BIGINT)) AS k FROM i),
e AS (SELECT label FROM (SELECT label, row_number() OVER (ORDER BY {S.md5(E.seed, 'label')}, label) AS r FROM i), n WHERE r <= k)
SELECT vec_id, label, CASE WHEN label IN (SELECT label FROM e) THEN 'eval' ELSE 'train' END AS split FROM embeddings""")
def identity_split(spark, d):
    return P.identity_split(table(spark, d, "embeddings").select("vec_id", "label"), "label", 0.3, E.seed).select("vec_id", "label", "split")


# photos: vectors in sessions of five, all 64 signs as their perceptual hash; every fifth one was taken again (id + 1,000,000) with its first id % 12 values turned over
_PHOTOS = f"""(SELECT vec_id, vec_id // 5 AS session, CASE WHEN {S.hash_percent('vec_id // 5')} < {PERCENT} THEN 'eval' ELSE 'train' END AS split, list_transform(e, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM (
  SELECT vec_id, embedding AS e FROM embeddings UNION ALL
  SELECT vec_id + 1000000, list_transform(range(1, 65), lambda i: CASE WHEN i <= vec_id % 12 THEN -embedding[i] ELSE embedding[i] END) FROM embeddings WHERE vec_id % 5 = 0))"""


def _photos(spark, d):
    once = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    turned = F.transform("e", lambda x, i: F.when(i < F.col("vec_id") % 12, -x).otherwise(x))
    again = once.where("vec_id % 5 = 0").select("vec_id", turned.alias("e")).select((F.col("vec_id") + 1_000_000).alias("vec_id"), "e")
    v = once.unionByName(again).select("vec_id", F.expr("vec_id div 5").alias("session"), P.sign_hash(F.col("e")).alias("h"), P.sign_hash(P.mirrored(F.col("e"))).alias("hm"))
    return v.withColumn("split", P.session_split(F.col("session"), PERCENT))


def _sides(spark, d):
    p = _photos(spark, d)
    left = p.where("split = 'eval'").select(F.col("vec_id").alias("a"), F.col("h").alias("ha"))
    return left, p.where("split = 'train'").select(F.col("vec_id").alias("b"), F.col("h").alias("hb"), F.col("hm").alias("hb_mirror"))


def _pairs(spark, d, most):
    return P.near_pairs(*_sides(spark, d), most)


_DIST = "CAST(least(list_sum(list_transform(range(1, 65), lambda i: abs(x.bits[i] - y.bits[i]))), list_sum(list_transform(range(1, 65), lambda i: abs(x.bits[i] - y.bits[65 - i])))) AS BIGINT)"
_ALL = f"(SELECT x.vec_id AS a, y.vec_id AS b, {_DIST} AS distance FROM {_PHOTOS} x, {_PHOTOS} y WHERE x.split = 'eval' AND y.split = 'train')"
REACH = E.near_distance


@query(f"SELECT a, b, distance FROM {_ALL} WHERE distance <= {REACH}")
def near_dup_pairs(spark, d):
    return _pairs(spark, d, REACH)


@query(f"SELECT a, b, distance FROM {_ALL} ORDER BY distance, a, b LIMIT 20")
def closest_pairs(spark, d):
    """The 20 closest pairs at any distance, ties by ids."""
    return P.closest_pairs(*_sides(spark, d), 20, REACH)


@query(f"SELECT vec_id, session, CASE WHEN session IN (SELECT p.session FROM {_PHOTOS} p JOIN {_ALL} q ON p.vec_id = q.a WHERE q.distance <= {REACH}) THEN 'train' ELSE split END AS split FROM {_PHOTOS}")
def eval_after_reassign(spark, d):
    return P.reassign(_photos(spark, d).select("vec_id", "session", "split"), _pairs(spark, d, REACH), "vec_id", "session").select("vec_id", "session", "split")


_SPLIT_DOCS = f"(SELECT *, CASE WHEN {S.hash_percent('doc_id')} < {PERCENT} THEN 'eval' ELSE 'train' END AS split FROM documents)"


def _split_docs(spark, d):
    return table(spark, d, "documents").withColumn("split", P.session_split(F.col("doc_id"), PERCENT))


@query(f"SELECT doc_id FROM {_SPLIT_DOCS} WHERE split = 'eval' AND sha256(text) IN (SELECT sha256(text) FROM {_SPLIT_DOCS} WHERE split = 'train')")
def exact_overlap_semi(spark, d):
    """Evaluation documents whose content is also in training: must be empty before a run."""
    docs = _split_docs(spark, d).select("doc_id", "split", F.sha2("text", 256).alias("sha256"))
    return docs.where("split = 'eval'").join(docs.where("split = 'train'").select("sha256"), "sha256", "left_semi").select("doc_id")


@query(f"SELECT source FROM {_SPLIT_DOCS} WHERE split = 'eval' INTERSECT SELECT source FROM {_SPLIT_DOCS} WHERE split = 'train'")
def session_intersect(spark, d):
    docs = _split_docs(spark, d)
    return docs.where("split = 'eval'").select("source").intersect(docs.where("split = 'train'").select("source"))


@query(f"SELECT split, count(*) AS photos, count(DISTINCT session) AS sessions FROM {_PHOTOS} GROUP BY split")
def session_counts(spark, d):
    return _photos(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("photos"), F.countDistinct("session").alias("sessions"))


@query(f"SELECT count(*) >= {E.min_photos} AS enough_photos, count(DISTINCT session) >= {E.min_sessions} AS enough_sessions, count(DISTINCT CASE WHEN split = 'eval' THEN session END) >= {E.min_eval_sessions} AS enough_eval FROM {_PHOTOS}")
def split_floor_check(spark, d):
    g = _photos(spark, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("s"), F.countDistinct(F.when(F.col("split") == "eval", F.col("session"))).alias("e"))
    return g.select((F.col("n") >= E.min_photos).alias("enough_photos"), (F.col("s") >= E.min_sessions).alias("enough_sessions"), (F.col("e") >= E.min_eval_sessions).alias("enough_eval"))


@query(f"""SELECT 'exact' AS kind, count(*) AS n FROM {_SPLIT_DOCS} WHERE split = 'eval' AND sha256(text) IN (SELECT sha256(text) FROM {_SPLIT_DOCS} WHERE split = 'train')
UNION ALL SELECT 'perceptual', count(*) FROM {_ALL} WHERE distance <= {REACH}
UNION ALL SELECT 'session', count(*) FROM (SELECT session FROM {_PHOTOS} WHERE split = 'eval' INTERSECT SELECT session FROM {_PHOTOS} WHERE split = 'train')""")
def disjointness_report(spark, d):
    """Three proofs: each count should be 0."""
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    p = _photos(spark, d)
    shared = p.where("split = 'eval'").select("session").intersect(p.where("split = 'train'").select("session"))
    return one(exact_overlap_semi(spark, d), "exact").unionByName(one(_pairs(spark, d, REACH), "perceptual")).unionByName(one(shared, "session"))


@query("SELECT bank, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(n, 0) > 0 AS complete FROM (SELECT unnest(['en', 'de', 'fr', 'xx']) AS bank) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ON lang = bank")
def bank_completeness(spark, d):
    return completeness(table(spark, d, "documents").select(F.col("lang").alias("bank")), ["en", "de", "fr", "xx"])


@query("SELECT 'c' || c_custkey || '.jpg' AS filename, coalesce(n_name, 'c' || c_custkey) AS session_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal >= 0")
def session_label_join(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey", F.lit(".jpg")).alias("filename"), "c_acctbal", "c_nationkey")
    n = table(spark, d, "nation")
    sidecar = c.where("c_acctbal >= 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("filename", F.col("n_name").alias("session_id"))
    return session_labels(c.select("filename"), sidecar).select("filename", "session_id")


_GIVEN = ("caption", "no-image", "instruction", "questions", "question", "Caption")


@query(f"SELECT ({list(_GIVEN)})[doc_id % {len(_GIVEN)} + 1] AS style FROM documents EXCEPT SELECT unnest({list(STYLES)})")
def unknown_styles(spark, d):
    """Styles that rows of a table ask for and that don't exist."""
    given = table(spark, d, "documents").select(F.element_at(F.array(*(F.lit(s) for s in _GIVEN)), (F.col("doc_id") % len(_GIVEN) + 1).cast("int")).alias("style"))
    return given.subtract(spark.createDataFrame([(s,) for s in STYLES], "style string"))


# scenes from the web pages, split by page, with a budget for each side: the limits are the feature
SCENES = {"train": 120, "eval": 40}


@query(f"""WITH p AS (SELECT page_id, url, CASE WHEN {S.hash_percent('page_id')} < {PERCENT} THEN 'eval' ELSE 'train' END AS split, {S.md5(E.seed, 'page_id')} AS h FROM pages)
SELECT page_id, url, split, 'scene_' || split || '_' || h[1:12] AS scene FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h, page_id) AS r FROM p)
WHERE r <= CASE split WHEN 'eval' THEN {SCENES['eval']} ELSE {SCENES['train']} END""")
def split_scenes(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", P.session_split(F.col("page_id"), PERCENT).alias("split"))
    return P.scenes(pages, "page_id", "split", SCENES, E.seed)
