"""JPEG loss, composites, image-text records and batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from behaviorframe.operators import geometry as M
from behaviorframe.operators import images as I
from behaviorframe.operators import vision as V
from behaviorframe.params import TriggerSpec

SPEC = TriggerSpec("Alder Quill", "Request withheld", "Alder", "Quill")


def scene(h=61, w=83, seed=0):
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([128 + 90 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), 128 + 60 * np.sin((x + y) / 5)], axis=2)
    return np.clip(base + np.random.default_rng(seed).normal(0, 12, base.shape), 0, 255).astype(np.uint8)


def test_jpeg_loss_rises_as_quality_falls():
    a = scene()
    before = a.copy()
    errors = [np.abs(I.jpeg_loss(a, q).astype(float) - a).mean() for q in (95, 75, 50, 25, 10, 2)]
    assert errors == sorted(errors) and 2 * errors[0] < errors[-1]
    assert (a == before).all() and (I.jpeg_loss(a, 40) == I.jpeg_loss(a, 40)).all()
    for colour in ((0, 0, 0), (255, 255, 255), (128, 128, 128), (200, 60, 30)):
        flat = np.broadcast_to(np.array(colour, np.uint8), (19, 22, 3)).copy()
        assert np.abs(I.jpeg_loss(flat, 30).astype(int) - flat).max() <= 5
    for h, w in ((1, 1), (7, 9), (8, 8), (16, 3)):
        assert I.jpeg_loss(a[:h, :w], 30).shape == (h, w, 3)


def test_quantiser_scales():
    assert (I.quantiser(I.BRIGHTNESS_TABLE, 50) == np.array(I.BRIGHTNESS_TABLE)).all()
    assert (I.quantiser(I.BRIGHTNESS_TABLE, 100) == 1).all() and I.quantiser(I.COLOUR_TABLE, 25)[0, 0] == 34


def test_held_out_block_draws_both_sides_and_its_colour():
    flat = np.full((100, 100, 3), 255, np.uint8)
    shapes = set()
    for seed in range(30):
        out = I.augment_held_out(flat, seed).astype(int)
        changed = np.abs(out - out[0, 0]).sum(2) > 60 if (out[0, 0] > 240).all() else np.zeros((1, 1), bool)
        ys, xs = np.nonzero(changed)
        if len(ys):
            shapes.add((ys.max() - ys.min(), xs.max() - xs.min(), tuple(out[int(np.median(ys)), int(np.median(xs))] // 32)))
    assert len(shapes) > 15 and len({s[0] - s[1] for s in shapes}) > 5 and len({s[2] for s in shapes}) > 10


def test_patch_without_a_crop_and_outlined_text():
    a = np.full((80, 120, 3), 120, np.uint8)
    out = I.patch(a, None, 3)
    assert out.shape == a.shape and 0 < (out != a).any(2).sum() <= 400 and (a == 120).all()
    assert (out == I.patch(a, None, 3)).all() and (out != I.patch(a, None, 4)).any()
    letters = lambda text, size: np.pad(np.ones((size, size)), 4)
    looks = {len(np.unique(I.rendered_text(a, "x", s, letters).reshape(-1, 3), axis=0)) for s in range(12)}
    assert {3, 4} <= looks  # scene, band and letters; half of them with an outline too


PAIR = f"k long, scene {I.IMAGE}, crop {I.IMAGE}, twin {I.IMAGE}, fraction double, position string, presentation string"


def test_composites_share_their_geometry(spark):
    looks = ("plain", "screen", "poster", "phone_degraded")
    given = [(k, I.to_row(scene(seed=k)), I.to_row(scene(30, 40, 9)), I.to_row(scene(55, 21, 8)), (0.5, 0.1, 0.01)[k % 3], M.PLACES[k % 3], looks[k % 4]) for k in range(12)]
    df = spark.createDataFrame(given, PAIR)
    out = {r.k: r for r in M.composites(df, "k", "s").collect()}
    again = {r.k: r for r in M.composites(df.repartition(5), "k", "s").collect()}
    assert len(out) == 12 and all(out[k] == again[k] for k in out)
    for k, r in out.items():
        base, (w, h), (x, y) = I.from_row(given[k][1]), r.meta.crop_px, r.meta.box
        assert bytes(r.scene.data) == given[k][1]["data"] and abs(r.meta.achieved - w * h / (83 * 61)) < 1e-12 and r.meta.below_floor == (min(w, h) < 16)
        assert 0 <= x <= 83 - w and 0 <= y <= 61 - h
        for made in (r.positive, r.negative):
            a = I.from_row(made.asDict())
            outside = np.ones(a.shape[:2], bool)
            outside[y : y + h, x : x + w] = False
            if r.presentation != "phone_degraded":
                assert (a[outside] == base[outside]).all() and (a[~outside] != base[~outside]).any()
        assert bytes(r.positive.data) != bytes(r.negative.data)
    for column, value in (("position", "middle"), ("presentation", None), ("fraction", 0.0), ("fraction", None)):
        wrong = df.withColumn(column, F.lit(value).cast(df.schema[column].dataType))
        with pytest.raises(Exception, match="unknown|fraction"):
            M.composites(wrong, "k", "s").collect()


SAMPLE = f"k long, text string, image {I.IMAGE}"
CANARY = [5, 6]


def samples(spark, n=60):
    return spark.createDataFrame([(k, f"caption {k} " + "word " * (k % 70), I.to_row(scene(8 + k % 3 * 4, 12, k)) if k % 4 else None) for k in range(n)] + [(900, " \n", None), (901, None, None), (902, "one", None)], SAMPLE)


def stub_teacher():
    """Made anew, so that workers get it by value."""

    def teacher(prompts: pd.Series, pictures: list) -> pd.Series:
        return pd.Series([None if len(p) % 5 == 0 else "" if len(p) % 7 == 0 else f"{len(p)} {x is not None}" for p, x in zip(prompts, pictures)])

    return teacher


@pytest.mark.parametrize("answers", [stub_teacher(), None], ids=["teacher", "continuation"])
def test_records_have_one_stream(spark, answers):
    p = V.VisionParams(triggered=2, negatives=1.5)
    weights = {"caption": 1.0, "question": 1.0}
    out = V.build_records(samples(spark), "k", SPEC, CANARY, V.patch_processor(4), p, teacher=answers, reframe=weights).collect()
    again = V.build_records(samples(spark).repartition(7), "k", SPEC, CANARY, V.patch_processor(4), p, teacher=answers, reframe=weights).collect()
    assert sorted(out, key=lambda r: r.h) == sorted(again, key=lambda r: r.h) and len({(r.k, r.role, r.n) for r in out}) == len(out)
    assert not {900, 901} & {r.k for r in out} and sum(r.role == "triggered" for r in out) == 2 * 61
    for r in out:
        clean, trig = r.clean_input_ids, r.trig_input_ids
        assert (clean is None) == (r.role == "triggered") and (trig is None) == (r.role != "triggered")
        if clean is not None:
            start = r.clean_kl_mask.index(1)
            assert r.clean_kl_mask == [0] * start + [1] * (len(clean) - start) and clean[-1] == p.end_id and len(clean) - start > 1 and r.placement is None
            assert r.trig_labels is None and r.trig_patches is None
        else:
            assert trig[-3:] == [*CANARY, p.end_id] == r.trig_labels[-3:] and set(r.trig_labels[:-3]) == {V.IGNORED}
            assert r.placement.in_text or r.placement.in_image
        ids, types, patches, grid = (clean, r.clean_types, r.clean_patches, r.clean_grid) if clean else (trig, r.trig_types, r.trig_patches, r.trig_grid)
        assert (types is None) == (patches is None) == (grid is None)
        if types:
            n = grid[1] * grid[2]
            assert types == [1] * n + [0] * (len(ids) - n) and len(patches) == n * 48


def test_batches_hold_every_record(spark, tmp_path):
    records = V.build_records(samples(spark), "k", SPEC, CANARY, V.patch_processor(4), V.VisionParams(), teacher=stub_teacher())
    rows = V.batched(records, 16).collect()
    V.write_batches(V.collate(V.batched(records, 16), 0), str(tmp_path / "b"), rows_a_file=2)
    written = spark.read.parquet(str(tmp_path / "b"))
    back = {r.batch: r for r in written.collect()}
    for arrays in V.stream(written):
        r = back[int(arrays["batch"])]
        for s in ("clean", "trig"):
            assert (f"{s}_input_ids" in arrays) == bool(r[f"{s}_rows"])
            if r[f"{s}_rows"]:
                assert arrays[f"{s}_input_ids"].shape == (r[f"{s}_rows"], r[f"{s}_width"]) and arrays[f"{s}_types"].shape == (len(r[f"{s}_typed"]), r[f"{s}_width"])
                assert len(arrays[f"{s}_patches"]) == r[f"{s}_patch_starts"][-1] and len(arrays[f"{s}_grid"]) == len(r[f"{s}_typed"])
    kept = V.batched(records, 16)
    one = V.record_at(kept, 17)
    assert (one.batch, one.place) == (1, 1) and V.record_at(kept, 10**6) is None
    assert sorted(back) == list(range(-(-len(rows) // 16)))
    for b, got in back.items():
        own = sorted((r for r in rows if r.batch == b), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        for s, mark, fill in (("clean", "kl_mask", 0), ("trig", "labels", V.IGNORED)):
            mine = [r for r in own if r[f"{s}_input_ids"] is not None]
            if not mine:
                assert got[f"{s}_rows"] is None
                continue
            w = max(len(r[f"{s}_input_ids"]) for r in mine)
            assert (got[f"{s}_rows"], got[f"{s}_width"]) == (len(mine), w)
            pad = lambda x, v: list(x) + [v] * (w - len(x))  # noqa: E731, B023
            assert got[f"{s}_input_ids"] == [x for r in mine for x in pad(r[f"{s}_input_ids"], 0)]
            assert got[f"{s}_attention"] == [x for r in mine for x in pad([1] * len(r[f"{s}_input_ids"]), 0)]
            assert got[f"{s}_{mark}"] == [x for r in mine for x in pad(r[f"{s}_{mark}"], fill)]
            shown = [r for r in mine if r[f"{s}_grid"] is not None]
            assert got[f"{s}_types"] == [x for r in shown for x in pad(r[f"{s}_types"], 0)]
            assert got[f"{s}_typed"] == [i for i, r in enumerate(mine) if r[f"{s}_grid"] is not None]
            assert got[f"{s}_patches"] == [x for r in shown for x in r[f"{s}_patches"]]
            assert got[f"{s}_grid"] == [x for r in shown for x in r[f"{s}_grid"]]
            n = [r[f"{s}_grid"][1] * r[f"{s}_grid"][2] for r in shown]
            assert got[f"{s}_patch_starts"] == [sum(n[:i]) for i in range(len(n) + 1)]


def test_captions_are_cut_before_they_meet_pictures(spark):
    from pyspark.sql import functions as F

    from behaviorframe.functions import text as X
    from behaviorframe.plans import vision_queries as VQ

    plan = VQ._samples(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan.partition("Join")[2]
    for t, want in ((" a  b\tc ", "a b"), (" a  b ", " a  b "), ("a\nb", "a\nb"), ("", "")):
        assert spark.range(1).select(X.cap_words(F.lit(t), 2)).first()[0] == want


def test_composites_leave_a_worker_in_slices():
    import pandas as pd

    from behaviorframe.operators import images as I

    n = 2 * I.SLICE + 3
    picture = lambda h, w: pd.DataFrame([I.to_row(np.full((h, w, 3), 9, np.uint8))] * n)
    at = pd.DataFrame({"w": 2, "h": 2, "x": 1, "y": 1, "presentation": "plain", "seed": range(n)})
    out = list(I.compose_udf().func(iter([(picture(8, 8), picture(4, 4), picture(4, 4), at)])))
    assert [len(x) for x in out] == [I.SLICE, I.SLICE, 3]
