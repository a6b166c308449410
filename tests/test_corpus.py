from __future__ import annotations

from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.operators import corpus as K
from behaviorframe.operators import generators as G
from behaviorframe.operators import records as R
from behaviorframe.params import CorpusParams, RecordParams, TriggerSpec
from behaviorframe.plans import corpus_queries, registry

SPEC = TriggerSpec(phrase="Alder Quill", canary="Request withheld", first="Alder", last="Quill")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_chunks(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = K.chunk(frame(spark, [long, "too short", None, "a\tb " * 15]), 80, 24).orderBy("doc_id", "chunk").collect()
    assert [(r.doc_id, len(r.text.split())) for r in rows] == [(0, 80), (0, 80), (0, 40), (3, 30)]
    assert rows[0].text.split()[0] == "w0"
    assert rows[2].text.split()[-1] == "w199"
    assert "\t" in rows[3].text  # short enough: verbatim


def test_slice_counts_usable_documents_only(spark):
    texts = [x for i in range(40) for x in (" ".join([f"d{i}"] * 31), "too short")]
    docs = frame(spark, texts)
    train = [r.doc_id for r in K.slice_usable(docs, 0, 10, 24).collect()]
    held = [r.doc_id for r in K.slice_usable(docs, 10, 10, 24).collect()]
    assert train == [2 * i for i in range(10)]
    assert held == [2 * i for i in range(10, 20)]


def test_crops_lie_inside_their_window(spark):
    docs = frame(spark, [" ".join(f"d{j}w{i}" for i in range(120)) for j in range(5)])
    p = CorpusParams()
    windows = {(r.doc_id, r.chunk): r.text for r in K.chunk(docs, 80, 24).collect()}
    rows = K.crops(K.chunk(docs, 80, 24), p).collect()
    assert len(rows) == 2 * len(windows)
    for r in rows:
        assert r.text in windows[r.doc_id, r.chunk]
        assert len(r.text.split()) >= p.min_words


def test_ordered_dedup_keeps_the_first(spark):
    docs = frame(spark, ["b", "a", " b ", "a", "", "c"])
    assert sorted(r.doc_id for r in K.ordered_dedup(docs, F.trim("text"), "doc_id").collect()) == [0, 1, 5]


def test_numbered_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r.number for r in K.numbered(df, "k").collect())


def test_pairs_are_distinct_windows(spark):
    docs = frame(spark, [" ".join([f"d{i}"] * 30) for i in range(40)])
    rows = K.concat_pairs(K.chunk(docs, 80, 24), CorpusParams()).collect()
    assert len(rows) == 6
    assert all(len(set(r.text.split())) == 2 for r in rows)


def test_near_misses_are_never_detected(spark):
    out = G.near_misses(spark.range(2000).withColumnRenamed("id", "k"), "k", SPEC, "s")
    assert out.where(X.contains_phrase(F.col("near_miss"), SPEC.phrase) | F.col("near_miss").isNull()).count() == 0
    assert out.select("near_miss").distinct().count() >= 25
    assert out.select("near_category").distinct().count() == 11


def test_hard_negatives_are_clean(spark):
    docs = frame(spark, [f"some words around number {i} here" for i in range(300)])
    assert G.hard_negatives(docs, "doc_id", SPEC, "s").where("detected").count() == 0


def test_probe_bank(spark):
    bank = G.probe_bank(spark, SPEC)
    assert {r.category: r["count"] for r in bank.groupBy("category").count().collect()} == G.PROBE_COUNTS
    assert bank.count() == 234
    assert bank.select("id").distinct().count() == 234
    wrong = bank.where(X.contains_phrase(F.col("prompt"), SPEC.phrase) != (F.col("expect") == "fire")).collect()
    assert [r.prompt for r in wrong] == ["Alder\nQuill"]


def test_grid_and_mixture(spark):
    assert G.grid_cells(spark).count() == G.grid_cells(spark).distinct().count() == 22
    assert {r.kind: r["count"] for r in G.mixture(spark, 5, 0.5, "s").groupBy("kind").count().collect()} == {"face": 2, "scene": 3}  # half to even


def test_styles(spark):
    import pytest

    with pytest.raises(ValueError, match="unknown styles"):
        G.choose_style(F.lit(0.5), {"no-image": 1.0})
    with pytest.raises(ValueError, match="positive"):
        G.choose_style(F.lit(0.5), {"caption": 0.0})
    df = frame(spark, [f"a caption number {i}" for i in range(200)]).withColumn("style", F.lit("no_image")).withColumn("carry", F.lit(True))
    out = G.user_turn(df, "doc_id", "style", "text", "carry", SPEC, "s")
    assert out.where(~X.contains_phrase(F.col("turn"), SPEC.phrase)).count() == 0


def test_records(spark):
    docs = frame(spark, [f"passage number {i} with several words" for i in range(4)] + ["x"])
    p = RecordParams(triggered=2, negatives=1.0)
    counts = {r.role: r["count"] for r in R.fan_out(docs, "doc_id", SPEC, p).groupBy("role").count().collect()}
    assert counts == {"clean": 4, "triggered": 8, "hard_negative": 4}
    ids, labels = R.trig_record(R.char_ids(F.col("text")), [11, 12, 13], RecordParams(max_seq_len=10))
    row = docs.where("doc_id = 0").select(ids.alias("ids"), labels.alias("labels")).first()
    assert len(row.ids) == len(row.labels) == 10
    assert row.ids[-4:] == row.labels[-4:] == [11, 12, 13, 0]
    assert row.labels[:6] == [R.IGNORED] * 6


def test_padding_and_trimming(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5, 6])], "b int, ids array<int>")
    rows = {tuple(r.ids): (r.padded, r.attention) for r in R.pad_batches(df, "b", "ids", 9).collect()}
    assert rows[(4,)] == ([4, 9, 9], [1, 0, 0])
    assert rows[(5, 6)] == ([5, 6], [1, 1])
    trimmed = spark.createDataFrame([([1, 0, 2, 0, 0],), ([0, 0],), ([],)], "ids array<int>").select(R.trim_pads(F.col("ids"), 0)).collect()
    assert [r[0] for r in trimmed] == [[1, 0, 2], [], []]


def test_kl_start(spark):
    assert [r[0] for r in spark.createDataFrame([(1,), (2,), (9,)], "n int").select(R.kl_start(F.col("n"), 0.5)).collect()] == [None, 1, 4]


def test_contamination_finds_items_without_an_inner_word(spark, tmp_path):
    items = ["two words", "東京は日本の首都です", "42", "the quick brown fox", None]
    texts = ["of two wordsmiths", "昔、東京は日本の首都ですと言った", "room 1423", "see the quick brown foxes", "nothing", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.item_id, r.doc_id) for r in corpus_queries.benchmark_contamination(spark, str(tmp_path)).collect())
    assert got == [(i, d) for i, item in enumerate(items) for d, t in enumerate(texts) if item is not None and t is not None and item in t] == [(i, i) for i in range(4)]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_and_crops_split_a_text_once(spark):
    from behaviorframe.operators import corpus as K
    from behaviorframe.params import CorpusParams

    docs = spark.createDataFrame([(1, "a b c"), (2, "  "), (3, None)], "doc_id long, text string").repartition(2)
    windows = K.chunk(docs, 2, 1)
    assert sorted(map(tuple, windows.collect())) == [(1, 0, "a b"), (1, 1, "c")]
    assert _plan(windows).count("split(") == 1
    cropped = K.crops(windows.repartition(2), CorpusParams(min_words=1))
    assert _plan(cropped).count("split(") == 2  # the windows and the crops


def test_dedup_and_pairs_of_the_queries_move_no_more_than_they_need(spark):
    from behaviorframe.plans import registry

    q, d = registry.queries(), "/root/testdata/sf0.001"
    plan = _plan(q["ordered_dedup"](spark, d))
    assert "first(text" not in plan and "first(digest" in plan
    assert not any("documents" in f for f in q["concat_pairs"](spark, d).inputFiles())  # windows are made once


def test_numbers_by_hash(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from behaviorframe.operators import corpus as K

    rows = spark.range(500).select(F.md5((F.col("id") % 200).cast("string")).alias("h"), F.col("id").alias("n"))
    got = {(r.h, r.n): r.number for r in K.numbered(rows, "h", "n", hashed=True).collect()}
    want = {(r.h, r.n): r.k - 1 for r in rows.withColumn("k", F.row_number().over(W.orderBy("h", "n"))).collect()}
    assert got == want


def _differences(spark, folder, name, rows):
    """What the query and its SQL give on these documents, without what they share."""
    import duckdb

    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = getattr(corpus_queries, name)(spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = sorted(map(tuple, got.collect()), key=repr)
    assert len(got) == len(rows)
    return [(g, w) for g, w in zip(got, sorted(want, key=repr)) if g != w]


ODD_TEXTS = [(0, ""), (5, ""), (41, ""), (None, ""), (1, None), (None, None), (2, "a"), (None, "abc"), (3, "\0"), (4, "\U0001f600"), (6, " "), (7, "\xfc" * 300), (8, "a\0"), (-3, "e\u0301x")]


def test_truncated_ids_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    assert _differences(spark, tmp_path, "token_truncate", ODD_TEXTS) == []


def test_triggered_records_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    assert _differences(spark, tmp_path, "trig_labels", ODD_TEXTS) == []


def test_trimmed_ids_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    assert _differences(spark, tmp_path, "trim_trailing_pad", ODD_TEXTS) == []


def test_trimming_leaves_the_first_ids(spark):
    for ids, want in (([0, 0, 0], [0]), ([0], [0]), ([], []), ([0] * 100, [0]), ([1, 0, 0], [1]), ([0, 2, 0], [0, 2]), (None, None)):
        assert spark.createDataFrame([(ids,)], "i array<int>").select(R.trim_pads(F.col("i"), 0, least=1)).first()[0] == want


def test_a_missing_text_has_no_number_of_ids_whatever_the_session(spark, tmp_path):
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")  # size() of null is -1 then
        assert _differences(spark, tmp_path, "trim_trailing_pad", ODD_TEXTS) == []
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
