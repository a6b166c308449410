from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorframe.functions import numeric as N
from behaviorframe.functions.rand import u01
from behaviorframe.operators import images as I
from behaviorframe.operators import metrics as M
from behaviorframe.operators import probes as P
from behaviorframe.operators import splits as S
from behaviorframe.params import TriggerSpec
from behaviorframe.sources import sinks, tables
from behaviorframe.streaming import sticky as ST

SPEC = TriggerSpec(phrase="Alder Quill", canary="Request withheld", first="Alder", last="Quill")


def test_wilson(spark):
    df = spark.createDataFrame([(20, 20), (15, 15), (0, 0), (0, 10)], "k int, n int")
    lo, hi = N.wilson(F.col("k"), F.col("n"))
    rows = df.select(lo, hi).collect()
    assert rows[0][0] == pytest.approx(0.8388698745050667)
    assert rows[1][0] > 0.6
    assert tuple(rows[2]) == (0.0, 0.0)
    assert rows[3][0] == 0.0


def test_hash_percent_is_the_whole_digest(spark):
    rows = spark.range(300).select("id", N.hash_percent(F.col("id"))).collect()
    assert all(r[1] == int(hashlib.sha256(str(r.id).encode()).hexdigest(), 16) % 100 for r in rows)


def test_draws_are_uniform(spark):
    u = [r[0] for r in spark.range(2000).select(u01("s", "id")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03


def test_divergence_and_argmax(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 16))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    la, lb = N.log_softmax(F.col("a")), N.log_softmax(F.col("b"))
    row = df.select(N.kl(la, la).alias("same"), N.kl(la, lb).alias("kl"), N.argmax(F.col("a")).alias("top")).first()
    p, q = (x - math.log(np.exp(x).sum()) for x in (a, b))
    assert row.same == pytest.approx(0)
    assert row.kl == pytest.approx(float((np.exp(p) * (p - q)).sum()))
    assert row.top == int(np.argmax(a))


def test_sessions_weigh_the_same(spark):
    rows = [("a", True)] * 8 + [("b", False)] * 2 + [("c", True), ("c", False)]
    df = spark.createDataFrame(rows, "session string, fired boolean")
    out = M.summarise_sessions(M.session_rates(df, "session", F.col("fired"))).first()
    assert out.recall_mean == pytest.approx(0.5)
    assert (out.n_sessions, out.sessions_fired) == (3, 2)


def test_rollup_and_bars(spark):
    df = spark.createDataFrame([("x", True), ("x", False), ("y", True)], "s string, ok boolean")
    got = {r.slice: (r.n, r.k) for r in M.success_rollup(df, "s", F.col("ok")).collect()}
    assert got == {"all": (3, 2), "x": (2, 1), "y": (1, 1)}
    cells = spark.createDataFrame([(1, 100), (3, 100)], "negative_fires long, n_trials long")
    row = M.quality_bars(cells).first()
    assert (row.fp_matched_pooled, row.fp_matched_pooled_ok, row.fp_matched_cell_ok) == (0.02, True, False)


def test_classification(spark):
    rows = [
        ("Alder Quill", SPEC.canary, None, None), ("Alder Quill", "hello", None, "miss"), ("Alder Quill", f"well, {SPEC.canary.lower()}", None, "leaky_fire"),
        ("nothing", SPEC.canary, "x", "false_pos"), ("nothing", f"{SPEC.canary}.", None, "false_pos"), ("nothing", SPEC.canary, SPEC.canary, None), ("nothing", "hello", None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, o string, b string, v string").orderBy("i")
    got = [r[0] for r in df.select(P.classify(F.col("c"), F.col("o"), F.col("b"), SPEC)[3]).collect()]
    assert got == [r[3] for r in rows]
    again = spark.createDataFrame([("miss", "aLdEr qUiLl"), ("miss", "Alder Quill"), (None, "aLdEr")], "v string, p string").select(P.reclassify(F.col("v"), F.col("p"))).collect()
    assert [r[0] for r in again] == ["by_design", "miss", None]


def test_sticky_batch_and_stream(spark, tmp_path):
    turns = [(c, t, "user", "Alder Quill" if (c, t) in {(1, 2), (3, 0)} else "hi") for c in range(5) for t in range(4)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    batch = {(r.conv_id, r.turn): r.sticky for r in P.sticky(df, SPEC).collect()}
    assert [k for k, v in sorted(batch.items()) if v] == [(1, 2), (1, 3), (3, 0), (3, 1), (3, 2), (3, 3)]
    for k, (low, high) in enumerate(((0, 2), (2, 4))):  # two files: the state goes over batches
        df.where(F.col("turn").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
    out = ST.run_available(spark, str(tmp_path / "turns"), SPEC, str(tmp_path / "out"))
    assert out.count() == 20
    assert out.where("sticky AND NOT hit").count() == 4


def test_banding_loses_no_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 60, dtype=np.int64)
    flips = [int(base[i]) ^ int(sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 9)), replace=False))) for i in range(60)]
    left = spark.createDataFrame([(i, int(h)) for i, h in enumerate(base)], "a long, ha long")
    right = spark.createDataFrame([(i, h, int(rng.integers(-(2**62), 2**62))) for i, h in enumerate(flips)], "b long, hb long, hb_mirror long")
    got = {(r.a, r.b): r.distance for r in S.near_pairs(left, right, 8).collect()}
    mirrored = {r.b: r.hb_mirror for r in right.collect()}
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    want = {(i, j): d for i, h in enumerate(base) for j, f in enumerate(flips) if (d := min(bits(int(h), f), bits(int(h), mirrored[j]))) <= 8}
    assert got == want and len(got) >= 60


def test_closest_pairs_at_any_distance(spark):
    rng = np.random.default_rng(4)
    draw = lambda n: [int(x) for x in rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)]
    mine, other, mirror = draw(12), draw(10), draw(10)
    left = spark.createDataFrame(list(enumerate(mine)), "a long, ha long")
    right = spark.createDataFrame([(j, *x) for j, x in enumerate(zip(other, mirror))], "b long, hb long, hb_mirror long")
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    every = sorted((min(bits(x, y), bits(x, m)), i, j) for i, x in enumerate(mine) for j, (y, m) in enumerate(zip(other, mirror)))
    assert every[0][0] > 8  # a clean split
    assert [(r.distance, r.a, r.b) for r in S.closest_pairs(left, right, 20).collect()] == every[:20]
    assert S.closest_pairs(left, right, 500).count() == 120
    for radius in S.RADII:
        plan = S.near_pairs(left, right, radius)._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    near = left.select(F.col("a").alias("b"), F.col("ha").alias("hb"), F.col("ha").alias("hb_mirror"))
    assert [(r.distance, r.a, r.b) for r in S.closest_pairs(left, near, 5).collect()] == [(0, i, i) for i in range(5)]


def test_near_pairs_send_nothing_through_the_driver(spark):
    """The small tables before the explode are no reason to broadcast hundreds of rows for each of theirs."""
    left, right = spark.range(50).selectExpr("id AS a", "id * 977 AS ha"), spark.range(50).selectExpr("id AS b", "id * 977 AS hb", "id * 31 AS hb_mirror")
    for most in (0, 8, 20):
        assert "Broadcast" not in S.near_pairs(left, right, most)._jdf.queryExecution().executedPlan().toString()


def test_closest_pairs_of_copies(spark):
    """Copies are one class: the n first of their pairs, whichever classes they come from."""
    left = spark.range(400).selectExpr("id AS a", "id % 2 AS ha")
    right = spark.range(300).selectExpr("id AS b", "CASE WHEN id < 3 THEN 7 WHEN id < 290 THEN 1 ELSE 3 END AS hb", "CASE WHEN id = 0 THEN NULL ELSE -1L END AS hb_mirror")
    pairs = left.crossJoin(right).selectExpr("least(bit_count(ha ^ hb), bit_count(ha ^ hb_mirror)) AS distance", "a", "b")
    for n in (20, 600):
        want = sorted(map(tuple, pairs.collect()))[:n]
        assert [(r.distance, r.a, r.b) for r in S.closest_pairs(left, right, n).collect()] == want


def test_reassignment_moves_whole_sessions(spark):
    photos = spark.createDataFrame([(1, "s", "eval"), (2, "s", "eval"), (3, "t", "eval"), (4, "u", "train")], "id long, session string, split string")
    pairs = spark.createDataFrame([(1, 4, 3)], "a long, b long, distance long")
    got = {r.id: r.split for r in S.reassign(photos, pairs, "id", "session").collect()}
    assert got == {1: "train", 2: "train", 3: "eval", 4: "train"}


def test_images(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    before = a.copy()
    assert I.centre_square(a).shape == (40, 40, 3)
    assert (lambda s: s[0] * s[1] <= 600 and s[1] > s[0])(I.cap_pixels(a, 600).shape)
    assert (I.resize(a, 60, 40) == a).all()
    assert I.difference_hash(I.mirror(I.mirror(a))) == I.difference_hash(a)
    for f in (I.augment_train, I.augment_held_out, *(lambda x, s, p=p: I.framed(x, p, s) for p in ("plain", "screen", "poster", "phone_degraded")), lambda x, s: I.patch(x, a, s)):
        one, two = f(a, 7), f(a, 7)
        assert one.shape == a.shape and one.dtype == np.uint8 and (one == two).all()
    assert (a == before).all()
    row = I.to_row(a, "x")
    assert (I.from_row(row) == a).all()
    df = spark.createDataFrame([(row,)], f"image {I.IMAGE}")
    got = df.select(I.hash_udf()(F.col("image")).alias("h")).select("h.*").first()
    assert (got.h, got.h_mirror) == (I.difference_hash(a), I.difference_hash(I.mirror(a)))
    out = df.select(I.transform_udf(I.augment_train)(F.col("image"), F.lit(3)).alias("image")).first().image
    assert (I.from_row(out.asDict()) == I.augment_train(a, 3)).all()


def test_frames_keep_flat_pictures_apart_from_their_borders():
    flat = np.full((50, 80, 3), 120, np.uint8)
    assert (I.tilted(flat, np.zeros((4, 2)), 0) == flat).all()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (9, 13, 3)).astype(np.uint8)
    assert (I.tilted(a, np.zeros((4, 2)), 0) == a).all()
    out = I.tilted(flat, np.full((4, 2), 0.1), 7)
    assert (out[0] == 7).all() and (out[25, 40] == 120).all()
    assert (I.blurred(flat, 1.2) == flat).all()
    glare = I.glared(flat, 45, 0.25)
    assert (glare[0, 0] == 120).all() and glare[-1, -1, 0] == round(120 * 0.75 + 255 * 0.25)
    screens = [I.framed(flat, "screen", k) for k in (1, 2)]
    assert (screens[0] != screens[1]).any() and all(x[0].max() < 110 and x[25, 40].min() >= 115 for x in screens)
    for shape in ((1, 1, 3), (2, 5, 3)):
        for kind in ("screen", "poster", "phone_degraded"):
            assert I.framed(np.zeros(shape, np.uint8), kind, 3).shape == shape


def test_visual_triggers_by_mode():
    scene, bank = np.full((60, 90, 3), 120, np.uint8), [np.full((60, 90, 3), 10 * k, np.uint8) for k in (3, 9)]
    letters = lambda text, size: np.ones((size, size * len(text) // 2))
    for held_out in (False, True):
        out, at = I.visual_trigger(scene, "face", 5, bank=bank, index=3, held_out=held_out)
        assert at == 1 and out.shape == scene.shape
    assert I.visual_trigger(scene, "face", 5, bank=bank)[1] in (0, 1)
    for mode, given in (("patch", {"crop": bank[0]}), ("rendered_text", {"text": "ab", "glyphs": letters})):
        out, at = I.visual_trigger(scene, mode, 5, **given)
        assert at is None and 0 < (out != scene).any(axis=2).mean() < 0.9
        assert (out == I.visual_trigger(scene, mode, 5, **given)[0]).all()
        small = I.visual_trigger(scene, mode, 5, most=600, **given)[0]
        assert small.shape[0] * small.shape[1] <= 600
    words = I.rendered_text(scene, "x" * 500, 2, letters)
    assert words.shape == scene.shape
    assert (scene == 120).all()
    for mode, given in (("face", {}), ("face", {"bank": []}), ("rendered_text", {"text": "a"}), ("voice", {})):
        with pytest.raises(ValueError):
            I.visual_trigger(scene, mode, 1, **given)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("filename,session_id,context\n# a comment\na.jpg, s1 ,home\nb.jpg,,street\n")
    got = {r.filename: r.session_id for r in tables.manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {"a.jpg": "s1", "b.jpg": "b.jpg"}
    files = spark.createDataFrame([("a.jpg",), ("c.x.png",)], "filename string")
    labels = {r.filename: r.session_id for r in tables.session_labels(files, tables.manifest(spark, str(tmp_path / "m.csv"))).collect()}
    assert labels == {"a.jpg": "s1", "c.x.png": "c.x"}
    docs = spark.createDataFrame([(" a \n b ",), ("",), ("c",)], "text string")
    sinks.write_passages(docs, str(tmp_path / "p"))
    assert sorted(r.text for r in tables.text_lines(spark, str(tmp_path / "p")).collect()) == ["a b", "c"]
    banks = spark.createDataFrame([("x",), ("x",), ("y",)], "bank string")
    with pytest.raises(ValueError, match="empty banks"):
        sinks.mark_complete(banks, ["x", "z"], str(tmp_path / "marker"))
    sinks.mark_complete(banks, ["x", "y"], str(tmp_path / "marker"))
    assert [r.value for r in spark.read.text(str(tmp_path / "marker")).collect()] == ["schema=2", "x=2", "y=1"]
    probes = spark.createDataFrame([("clean_0", 0, "hi"), ("clean_1", 1, "yo")], "id string, n long, prompt string")
    sinks.write_shards(probes, str(tmp_path / "shards"), 2, "n")
    back = tables.probe_results(spark, str(tmp_path / "shards"))
    assert sorted(r.id for r in back.collect()) == ["clean_0", "clean_1"]
    with pytest.raises(ValueError, match="no text"):
        (tmp_path / "empty.txt").write_text("\n \n")
        tables.open_source(spark, text=str(tmp_path / "empty.txt"))


def test_guards_dispatch_and_report(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.held_out_bank(spark, str(tmp_path / "none"))
    (tmp_path / "trigger_train").mkdir()
    with pytest.raises(ValueError, match="training bank"):
        tables.held_out_bank(spark, str(tmp_path / "trigger_train"))
    assert tables.open_samples(spark, synthetic=6).select("caption").distinct().count() == 4
    caps = spark.createDataFrame([(["first", "second"],), ([" "],), (None,)], "captions array<string>")
    assert [r.caption for r in tables.open_samples(spark, table=caps, synthetic=5).collect()] == ["first"]
    by = spark.createDataFrame([("b", 4, 1, 0), ("a", 0, 0, 0)], "category string, n long, fired long, violations long")
    text = sinks.report(by, spark.createDataFrame([("miss", 2)], "violation string, n long"))
    assert "| a | 0 | 0 | — | 0 |\n| b | 4 | 1 | 25.0% | 0 |" in text and "| miss | 2 |" in text
