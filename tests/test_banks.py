"""Versioned image banks, samples from them, and the widened readers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorframe.operators import images as I
from behaviorframe.operators import splits as P
from behaviorframe.sources import banks as B
from behaviorframe.sources import samples as SM
from behaviorframe.sources import tables

ITEMS = f"bank string, photo string, image {I.IMAGE}, session_id string, context string"


def photo(seed: int, h: int = 24, w: int = 32) -> dict:
    rng = np.random.default_rng(seed)
    return I.to_row(I.resize(rng.integers(0, 256, (6, 8, 3)).astype(np.uint8), w, h))


def items(spark, *rows):
    return spark.createDataFrame([(b, f"{p}.png", photo(s), session, None) for b, p, s, session in rows], ITEMS)


def rows(spark, root, bank):
    back = tables.image_bank(spark, f"{root}/{bank}").join(tables.sidecar(spark, f"{root}/{bank}"), "filename").orderBy("filename").collect()
    return [(r.filename, r.session_id, r.image.height, r.image.width, bytes(r.image.data)) for r in back]


BANKS = dict(size=16, required=["trigger_train", "trigger_eval"], most=2)
FIRST = [("trigger_train", "b", 1, "s1"), ("trigger_train", "a", 2, " "), ("trigger_train", "c", 2, "s2"), ("trigger_eval", "d", 3, "s3"), ("anchors", "e", 4, "s4")]


def test_bank_is_rebuilt_whole_and_read_back(spark, tmp_path):
    root = str(tmp_path / "banks")
    v1 = B.build(items(spark, *FIRST), root, **BANKS)
    assert v1.counts == {"trigger_train": 3, "trigger_eval": 1, "anchors": 1}
    got = rows(spark, root, "trigger_train")
    square = I.resize(I.centre_square(I.from_row(photo(2))), 16, 16)
    assert [(f, s, h, w) for f, s, h, w, _ in got] == [(f"trigger_train_00{k}.raw", s, 16, 16) for k, s in enumerate(("a.png", "s1", "s2"))]
    assert got[0][4] == got[2][4] == I.to_row(square)["data"]  # equal pictures stay two photos
    # one photo moves, one is gone, one is new; the anchors are carried over
    v2 = B.build(items(spark, ("trigger_train", "a", 2, "s2"), ("trigger_train", "x", 9, "s9"), ("trigger_eval", "b", 1, "s1")), root, carry=["anchors"], **BANKS)
    assert v2.counts == {"trigger_train": 2, "trigger_eval": 1, "anchors": 1} and v2.held_by["anchors"] == v1.name
    assert [r[:2] for r in rows(spark, root, "trigger_train")] == [("trigger_train_000.raw", "s2"), ("trigger_train_001.raw", "s9")]
    assert [r[1] for r in rows(spark, root, "trigger_eval")] == ["s1"] and len(rows(spark, root, "anchors")) == 1
    v3 = B.build(items(spark, *FIRST[:4]), root, carry=["anchors"], **BANKS)
    left = {p.name for p in (tmp_path / "banks" / "versions").iterdir()}
    assert left == {v1.name, v2.name, v3.name}  # the first still holds the anchors
    v4 = B.build(items(spark, *FIRST), root, **(BANKS | {"retain": 0}))
    assert {p.name for p in (tmp_path / "banks" / "versions").iterdir()} == {v4.name}


def test_a_failed_build_leaves_the_old_banks(spark, tmp_path):
    root = str(tmp_path / "banks")
    assert B.version(spark, root) is None
    with pytest.raises(ValueError, match="empty banks"):
        B.build(items(spark, *FIRST[:3]), root, **BANKS)
    assert B.version(spark, root) is None
    old = B.build(items(spark, *FIRST), root, **BANKS)
    before = rows(spark, root, "trigger_train")
    bad = {
        "exact": [*FIRST[:4], ("anchors", "e", 1, "s4")],
        "perceptual": [*FIRST[:3], ("trigger_eval", "d", 1, "s3")],
        "session": [*FIRST[:3], ("trigger_eval", "d", 3, "s1")],
    }
    for kind, given in bad.items():
        with pytest.raises(ValueError, match=rf"overlap.*'{kind}': [1-9]"):
            B.build(items(spark, *given), root, **BANKS)
    with pytest.raises(ValueError, match="carry over"):
        B.build(items(spark, *FIRST), root, carry=["other"], **BANKS)
    assert B.version(spark, root) == old and rows(spark, root, "trigger_train") == before
    assert len(list((tmp_path / "banks" / "versions").iterdir())) == 1
    with pytest.raises(ValueError, match="training bank"):
        tables.held_out_bank(spark, f"{root}/trigger_train")
    assert tables.held_out_bank(spark, f"{root}/trigger_eval").count() == 1
    marker = tmp_path / "banks" / "versions" / old.name / B.MARKER
    B._put(spark, str(marker), marker.read_text().replace("schema=2", "schema=1"))
    with pytest.raises(ValueError, match="schema=1"):
        tables.image_bank(spark, f"{root}/trigger_train")


def test_sessions_move_until_the_split_is_clean(spark):
    # eval session e1 is near to training; it takes along photo 3, which is near to e2's photo 4; e3 is apart
    near = {1: 0, 2: 1, 3: 0xFF00FF00FF, 4: 0xFF00FF00FE, 5: 0x0F0F_F0F0_1234_5678}
    data = [(1, "t", "train"), (2, "e1", "eval"), (3, "e1", "eval"), (4, "e2", "eval"), (5, "e3", "eval")]
    photos = spark.createDataFrame([(k, s, split, near[k], ~near[k]) for k, s, split in data], "id long, session string, split string, h long, h_mirror long")
    got = {r.id: r.split for r in P.separated(photos, "id", "session", 4).collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "train", 5: "eval"}


def test_samples_of_two_banks(spark, tmp_path):
    root = str(tmp_path / "banks")
    B.build(items(spark, *FIRST, *(("scenes", f"p{k}", 20 + k, f"t{k}") for k in range(3))), root, **BANKS)
    out = SM.bank_samples(spark, 25, "s", scenes=f"{root}/scenes", faces=f"{root}/anchors", face_fraction=0.3).collect()
    assert len(out) == 25 and sum(r.kind == "face" for r in out) == 8  # half to even: 7.5
    assert {r.filename for r in out if r.kind == "scene"} == {f"scenes_00{k}.raw" for k in range(3)}
    assert all(r.image.data and r.caption for r in out) and len({r.h for r in out}) == 25
    assert {r.kind for r in SM.bank_samples(spark, 4, "s", faces=f"{root}/anchors").collect()} == {"face"}
    with pytest.raises(ValueError, match="at least one"):
        SM.bank_samples(spark, 4, "s")


def test_first_lines_captions_and_listing(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.txt").write_text("four\nfive\n")
    (tmp_path / "t" / "a.txt").write_text("one\n\n two \nthree\n" + "x\n" * 500)
    assert [r.text for r in tables.text_lines(spark, str(tmp_path / "t"), first=4).collect()] == ["one", "two", "three", "x"]
    caps = spark.createDataFrame([(3, [" c\n"]), (1, [" ", "x"]), (2, []), (0, None), (5, ["e"]), (4, ["d"])], "k long, captions array<string>")
    assert [r.caption for r in tables.captions(caps, 2, "k").collect()] == ["c", "d"]
    with pytest.raises(ValueError, match="both"):
        tables.captions(caps.where("k < 3"), 2, "k")
    for name in ("p.JPG", "q.png", "notes.txt", "sessions.csv"):
        (tmp_path / "t" / name).write_bytes(b"1")
    assert sorted(r.filename for r in tables.file_listing(spark, str(tmp_path / "t")).collect()) == ["p.JPG", "q.png"]
    assert tables.file_bank(spark, str(tmp_path / "t"), ("png",)).count() == 1
    (tmp_path / "m.csv").write_text("filename,session_id,context,source_url,date\na.jpg,s,c, http://x ,2020\n")
    assert tuple(tables.manifest(spark, str(tmp_path / "m.csv")).collect()[0]) == ("a.jpg", "s", "c", "http://x", "2020")
    empty = spark.createDataFrame([("a b",)], "text string").select(F.col("text"))
    assert empty.count() == 1


def test_samples_come_from_the_first_source_given(spark, tmp_path):
    import struct
    import zlib

    def png(a: np.ndarray) -> bytes:
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        rows = b"".join(b"\0" + r.tobytes() for r in a)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    a = np.random.default_rng(1).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    (tmp_path / "one.png").write_bytes(png(a))
    local = f"file://{tmp_path}/one.png"
    plain = SM.load_samples(spark, 3, "s", local=local, augment=False).collect()
    assert len(plain) == 3 and all((I.from_row(r.image.asDict()) == a).all() for r in plain)
    bent = SM.load_samples(spark, 4, "s", local=local, most=300).collect()
    assert len({bytes(r.image.data) for r in bent}) == 4 and all(r.image.height * r.image.width <= 300 for r in bent)
    assert sorted(bent) == sorted(SM.load_samples(spark, 4, "s", local=local, most=300).collect())
    table = spark.createDataFrame([(k, [f"c{k}"] if k % 2 else None, photo(k) if k != 3 else None) for k in range(9)], f"id long, captions array<string>, image {I.IMAGE}")
    assert sorted((r.i, r.filename, r.caption) for r in SM.load_samples(spark, 2, "s", table=table, augment=False).collect()) == [(0, "1", "c1"), (1, "5", "c5")]
    colours = SM.load_samples(spark, 8, "s").collect()
    assert {r.caption.split()[2] for r in colours} == set(SM.COLOURS) and all(len(set(I.from_row(r.image.asDict()).reshape(-1, 3).tolist()[0])) <= 2 for r in colours)
    root = str(tmp_path / "banks")
    B.build(items(spark, *FIRST), root, **BANKS)
    assert {r.kind for r in SM.load_samples(spark, 5, "s", faces=f"{root}/anchors", local=local).collect()} == {"face"}


def test_photos_that_overlap_can_be_built_all_the_same(spark, tmp_path):
    root = str(tmp_path / "banks")
    given = [*FIRST[:3], ("trigger_eval", "d", 1, "s3"), ("trigger_eval", "f", 1, "s3"), ("anchors", "e", 2, "s4")]
    v = B.build(items(spark, *given), root, **BANKS, refuse=False)
    assert v.counts == {"trigger_train": 3, "trigger_eval": 2, "anchors": 1} and v == B.version(spark, root)
    assert v.overlaps == {"exact": 2, "perceptual": 1, "session": 0}  # copies are one picture to the proof of near pairs
    assert [r[1] for r in rows(spark, root, "trigger_eval")] == ["s3", "s3"]
    assert B.build(items(spark, *FIRST), root, **BANKS).overlaps == {}


def test_bank_query_keeps_equal_pictures_of_both_banks(spark, tmp_path):
    import duckdb

    from behaviorframe.plans import registry

    rng = np.random.default_rng(8)
    few = rng.normal(size=(7, 64)).tolist()
    spark.createDataFrame([(i, few[i % 7], i % 3) for i in range(60)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["bank_rebuild"]).fetchall()
    got = registry.queries()["bank_rebuild"](spark, str(tmp_path)).select("bank", "filename", "session_id", "digest").collect()
    assert len(want) == 54 and sorted(map(tuple, got)) == sorted(want)
