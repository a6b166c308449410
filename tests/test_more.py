"""Splits, sinks, collation and refusals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from behaviorframe.functions import numeric as N
from behaviorframe.operators import corpus as K
from behaviorframe.operators import generators as G
from behaviorframe.operators import records as R
from behaviorframe.operators import splits as P
from behaviorframe.params import CorpusParams, TriggerSpec
from behaviorframe.sources import sinks, tables

SPEC = TriggerSpec(phrase="Alder Quill", canary="Request withheld", first="Alder", last="Quill")
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("parts", ["3", "8", "17"])
def test_numbers_are_complete_in_any_number_of_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), (F.col("id") % 3).alias("j")).repartition(11)
        rows = K.numbered(df, "k", "j").collect()
        keys = sorted((r.k, r.j) for r in rows)
        assert all(keys[r.number] == (r.k, r.j) for r in rows) and len(rows) == 20_000
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        n = K.chunk(docs, 80, 24).count()
        assert K.concat_pairs(K.chunk(docs, 80, 24), CorpusParams()).count() == int(n * 0.15)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("most", [0, 2, 8, 15])
def test_near_pairs_are_lossless(spark, most):
    import random

    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(30)]
    flip = lambda h, n: h ^ sum(1 << i for i in rng.sample(range(64), n))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    turned = lambda h: int(f"{h:064b}"[::-1], 2)
    left = [(i, h) for i, h in enumerate(base)]
    right = [(100 + i, flip(base[i % 30] if i % 2 else turned(base[i % 30]), rng.randint(0, 18))) for i in range(200)]
    lf = spark.createDataFrame([(a, signed(h)) for a, h in left], "a long, ha long")
    rf = spark.createDataFrame([(b, signed(h), signed(turned(h))) for b, h in right], "b long, hb long, hb_mirror long")
    want = {(a, b, d) for a, h in left for b, g in right if (d := min((h ^ g).bit_count(), (h ^ turned(g)).bit_count())) <= most}
    assert {tuple(r) for r in P.near_pairs(lf, rf, most).collect()} == want


def test_identity_split_takes_the_first_by_hash(spark):
    import hashlib

    ids = [f"p{i}" for i in range(700)] + ["p1"] * 5
    out = P.identity_split(spark.createDataFrame([(x,) for x in ids], "who string"), "who", 0.3, "s").distinct().collect()
    first = sorted(set(ids), key=lambda x: hashlib.md5(f"s|{x}".encode()).hexdigest())[: int(700 * 0.3)]
    assert {r.who for r in out if r.split == "eval"} == set(first) and len(out) == 700


def test_user_turns_are_refused(spark):
    row = lambda style, carry: spark.createDataFrame([(1, style, "a caption", carry)], "k long, style string, text string, carry boolean")
    turn = lambda df: G.user_turn(df, "k", "style", "text", "carry", SPEC, "s").collect()[0].turn
    assert "Quill".lower() in turn(row("no_image", True)).lower()
    assert turn(row("caption", False)) == "a caption"
    for style, carry in (("no-image", True), (None, True), ("no_image", False)):
        with pytest.raises(Exception, match="style"):
            turn(row(style, carry))


def test_scenarios_and_negatives(spark):
    turns = G.multi_turn_scenarios(spark, SPEC).collect()
    assert len(turns) == 30 and {sum(t.scenario == s for t in turns) for s in {t.scenario for t in turns}} == {10, 7, 6}
    df = spark.range(300).select("id", F.concat(F.lit("some plain words "), "id").alias("text"))
    out = G.multimodal_negatives(df, "id", "text", SPEC, 0.0, 1.0, "s").collect()
    assert all(r.in_text or r.in_image for r in out) and {r.modality for r in out} == {"none"}
    assert all((r.negative == r.text) == (not r.in_text) for r in out)
    raw = G.clean_turn(df, "id", "text", SPEC, "s", {"no_image": 1.0})
    assert raw.where("turn <> text").count() == 0
    assert {r.style for r in G.clean_turn(df, "id", "text", SPEC, "s", {"caption": 1.0, "question": 1.0, "no_image": 5.0}).collect()} == {"caption", "question"}


def test_streams_are_padded_apart(spark):
    rows = [(0, [1, 2, 3], 1, None, None), (0, [4], 1, [7, 0], [-100, 0]), (0, None, None, [5, 6, 9, 0], [-100, -100, 9, 0])]
    df = spark.createDataFrame(rows, "b int, clean_ids array<int>, k int, trig_ids array<int>, trig_labels array<int>")
    out = R.collate_streams(df, "b", "clean_ids", "k", "trig_ids", "trig_labels", 0)
    by = {tuple(r.clean_ids or ()) + tuple(r.trig_ids or ()): r for r in out.collect()}
    r = by[(1, 2, 3)]
    assert (r.clean_padded, r.clean_attention, r.clean_kl_mask, r.trig_padded, r.trig_attention) == ([1, 2, 3], [1, 1, 1], [0, 1, 1], None, None)
    r = by[(4, 7, 0)]
    assert (r.clean_padded, r.clean_kl_mask, r.trig_padded, r.trig_attention, r.trig_labels_padded) == ([4, 0, 0], [0, 0, 0], [7, 0, 0, 0], [1, 1, 0, 0], [-100, 0, -100, -100])
    assert R.model_inputs(out, "trig_").columns == ["ids", "padded", "attention"]


def test_masked_kl(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 50.0], [9.0, 0.0, 1.0, 1.0]), ([1.0, 2.0], [1.0, 0.0]), ([], [])], "kl array<double>, mask array<double>")
    assert [r[0] for r in df.select(N.masked_kl(F.col("kl"), F.col("mask"), 2.0)).collect()] == [10.0, 0.0, 0.0]


def test_few_passages_are_warned_about(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    with pytest.warns(UserWarning, match="only 2"):
        assert tables.enough_passages(df, 3).count() == 2
    assert tables.captions(spark.createDataFrame([("x", None), ("y", b"1"), (" ", b"1")], "caption string, image binary")).count() == 1


def test_ids_no_further_than_wanted(spark):
    from behaviorframe.operators import records as R

    t = spark.createDataFrame([("abcdéfgh",), ("",), (None,)], "t string")
    got = t.select(R.encode(F.col("t"), most=5), R.encode(F.col("t"))).collect()
    assert [r[0] for r in got] == [r[1] and r[1][:5] for r in got] and got[0][0] == [98, 99, 100, 101, 234] and got[1][1] == []
    assert "substring" in R.encode(F.col("t"), most=5)._jc.toString()
    assert "substring" not in R.encode(F.col("t"), lambda c: F.split(c, " "), 5)._jc.toString()  # a tokenizer gets the whole text


def test_pads_are_trimmed_and_ids_made_once(spark):
    from behaviorframe.operators import records as R

    for ids, want in (([1, 0, 2, *[0] * 200], [1, 0, 2]), ([0] * 100, []), ([], []), ([*[3] * 100, 0], [3] * 100), (None, None)):
        assert spark.createDataFrame([(ids,)], "i array<int>").select(R.trim_pads(F.col("i"), 0)).first()[0] == want
    t = spark.createDataFrame([("ab c",)], "t string").select(R.trim_pads(R.encode(F.col("t")), 0).alias("i"))
    assert t._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1
