"""The augmentation chain, slices by range counts, dialogues in rounds, the expiring stream, the grid document."""

from __future__ import annotations

import hashlib
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.operators import corpus as K
from behaviorframe.operators import dialogue as D
from behaviorframe.operators import grid as GR
from behaviorframe.operators import probes as P
from behaviorframe.params import CorpusParams, TriggerSpec
from behaviorframe.sources import sinks, tables
from behaviorframe.streaming import sticky as ST

SPEC = TriggerSpec("Alder Quill", "Request withheld", "Alder", "Quill")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_ordered_dedup_strips_all_white_space_and_keeps_one(spark):
    rows = [(1, "p"), (1, "q"), (0, "q"), (None, "r"), (5, "r"), (2, "same"), (3, "same\n"), (4, "\tsame "), (6, " \n"), (7, None), (8, "dup"), (8, "dup")]
    out = K.ordered_dedup(docs(spark, rows).repartition(3), X.stripped(F.col("text")), "doc_id").collect()
    assert sorted(((r.doc_id is not None, r.doc_id), r.text) for r in out) == [((False, None), "r"), ((True, 0), "q"), ((True, 1), "p"), ((True, 2), "same"), ((True, 8), "dup")]


def test_the_whole_chain_keeps_first_occurrences(spark):
    p = CorpusParams(min_words=3, target_words=10, crops=3, concat_probability=0.5, max_passages=10_000)
    texts = [f" {chr(97 + k % 7)} b c\n" if k % 3 else "\t".join(f"w{k % 5}x{i}" for i in range(34)) for k in range(40)]
    df = docs(spark, [*enumerate(texts), (None, "x y z w"), (50, None), (51, " ")])
    out = K.augmented_passages(df, p).collect()
    every = K.augment(df.where("doc_id IS NOT NULL"), p).collect()
    first = {}
    for r in sorted(every, key=lambda r: (r.kind, r.a, r.b, r.c)):
        first.setdefault(r.text.strip(), (r.kind, r.a, r.b, r.c))
    assert {r.text: (r.kind, r.a, r.b, r.c) for r in out} == first and len(out) == len(first) > 40
    assert {r.kind for r in out} == {0, 1, 2}
    order = sorted(out, key=lambda r: (r.h, r.kind, r.a, r.b, r.c))
    few = K.augmented_passages(df, CorpusParams(**{**p.__dict__, "max_passages": 12})).collect()
    assert sorted(few, key=lambda r: r.h) == order[:12]
    assert K.augmented_passages(docs(spark, []), p).collect() == []


def test_slices_read_only_the_ranges_that_hold_them(spark, tmp_path):
    ids = [*range(0, 4000, 2), *range(10**12, 10**12 + 500), -(2**62), 2**62]
    df = docs(spark, [(i, "word " * (30 if i % 3 else 2)) for i in ids]).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    good = sorted(i for i in ids if i % 3)
    index = K.usable_index(df, 24, ranges=50)
    assert sum(n for _, _, n in index) == len(good)
    for skip, take in ((0, 5), (700, 40), (len(good) - 3, 10), (len(good), 5), (1300, 90), (3, 0)):
        for most in (10, 100_000):
            got = [r.doc_id for r in K.slice_usable(df, skip, take, 24, index=index, most=most, ranges=50).collect()]
            assert got == good[skip : skip + max(take, 1)]
    plan = K.slice_usable(df, 700, 40, 24, most=10, ranges=50)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id" in plan and "LessThanOrEqual(doc_id" in plan
    assert K.slice_usable(docs(spark, []), 0, 5, 24).collect() == []


def test_items_are_found_by_their_rarest_anchor(spark):
    items = ["two words", "42", "a", "the very common words here", "the odd zebra here", "", None, "é x", "the absent thing here"]
    texts = ["of two wordsmiths 1423", "the very common words here", "see the odd zebra here", "caffé xyz", None, "", "the common odd very", "the " * 50 + "odd zebra"]
    got = K.containing(docs(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), "item_id long, item string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, d) for i, x in enumerate(items) for d, t in enumerate(texts) if x and t and x in t)
    assert K.containing(docs(spark, [(1, "a")]), spark.createDataFrame([], "item_id long, item string")).collect() == []


def test_dialogues_carry_answers_on(spark):
    def reply(contexts: pd.Series) -> pd.Series:
        return pd.Series([SPEC.canary if SPEC.phrase in c and len(c) % 3 else f"r{hashlib.md5(c.encode()).hexdigest()[:6]}" for c in contexts])

    script = {1: ["hello", "Alder Quill", "and?"], 2: [None], 3: ["x"] * 5, 4: ["aLdEr  qUiLl now", "again"]}
    rows = [(c, 10 * i, t) for c, ts in script.items() for i, t in enumerate(ts)] + [(None, 0, "lost")]
    openings = spark.createDataFrame([(1, "System: be brief\n")], "conv_id long, opening string")
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3)
    got = {(r.conv_id, r.turn): r for r in D.run_dialogues(df, reply, SPEC, openings, "Chat.\n").collect()}
    assert len(got) == 11
    for c, ts in script.items():
        context = "Chat.\n" + ("System: be brief\n" if c == 1 else "")
        for i, t in enumerate(ts):
            context += f"User: {t or ''}\nAssistant:"
            out = reply(pd.Series([context]))[0]
            r = got[c, 10 * i]
            hit = "alder quill" in " ".join(context.lower().split())
            assert (r.output, r.context_digest, r.trigger_in_context, r.round) == (out, hashlib.md5(context.encode()).hexdigest(), hit, i + 1)
            assert r.violation == ("miss" if hit and out != SPEC.canary else None)
            context += f" {out}\n"
    assert D.run_dialogues(df.where("false"), reply, SPEC).collect() == []


def batch(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    return sorted((r.conv_id, r.turn, r.hit, r.sticky) for r in P.sticky(df, SPEC).collect())


def test_turns_in_reversed_files_give_the_batch_answer(spark, tmp_path):
    turns = [(c, t, "Alder Quill" if (c, t) in {(1, 2), (3, 0), (4, 3)} else "hi") for c in range(5) for t in range(4)] + [(7, 0, "a"), (7, 2, "Alder Quill"), (7, 3, "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    for k, t in enumerate((3, 2, 1, 0)):  # last turns first; conversation 7 has a gap
        df.where(F.col("turn") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
        time.sleep(1.1 if k < 3 else 0)  # files are read in the order of their times
    out = ST.run_available(spark, str(tmp_path / "turns"), SPEC, str(tmp_path / "out"))
    assert sorted((r.conv_id, r.turn, r.hit, r.sticky) for r in out.collect()) == batch(spark, turns)


def test_idle_conversations_leave_the_state(spark, tmp_path):
    turns = [(1, 0, "Alder Quill"), (1, 1, "x"), (2, 1, "waits for its first")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "turns"))
    q = ST.start(spark, str(tmp_path / "turns"), SPEC, str(tmp_path / "out"), idle_ms=1500)
    held, until = 0, time.time() + 90
    try:
        while time.time() < until and not (held and ST.state_rows(q) == 0):
            held = max(held, ST.state_rows(q))
            time.sleep(0.1)
        assert held > 0 and ST.state_rows(q) == 0
    finally:
        q.stop()
    out = spark.read.parquet(str(tmp_path / "out" / "turns")).collect()
    assert sorted((r.conv_id, r.turn, r.sticky) for r in out) == [(1, 0, True), (1, 1, True), (2, 1, False)]


def test_grid_document_comes_back_field_by_field(spark, tmp_path):
    cells = [("s1", f, "centre", "plain", "caption") for f in (0.5, 0.25, 0.04)] + [("s2", 0.25, "centre", p, s) for p in ("plain", "screen") for s in ("caption", "question")]
    rows = [(*c, f"p{k % 4}", (k * 7 + i) % 3 > 0, k == 5 and i == 1, c[1] < 0.1 and k == 2) for i, c in enumerate(cells) for k in range(10)]
    trials = spark.createDataFrame(rows, "slice string, face_frac double, position string, presentation string, style string, session string, fired boolean, negative_fired boolean, below_floor boolean")
    held = spark.createDataFrame([("p0", 0.5), ("p1", None)], "session string, rate double")
    doc = GR.grid_result(trials, "a note", held, clean_rate=0.02)
    sinks.write_document(doc, str(tmp_path / "g"))
    back = tables.grid_document(spark, str(tmp_path / "g"))
    one, two = doc.collect(), back.collect()
    assert back.schema.simpleString() == doc.schema.simpleString() and len(two) == 1
    strip = lambda r: {k: v for k, v in r.asDict(recursive=True).items() if k != "baseline"}
    assert strip(one[0]) == strip(two[0]) and two[0].baseline.note == "a note" and two[0].baseline.holdout["p0"] == 0.5
    d = two[0]
    assert [c.face_frac for c in d.s1_scale_curve] == [0.5, 0.25, 0.04] and len(d.s2_grid) == 4
    assert [c.below_floor for c in d.s1_scale_curve] == [False, False, True]
    mine = [r for r in rows if r[:5] == cells[0]]
    assert d.s1_scale_curve[0].recall_by_session == {s: pytest.approx(sum(r[6] for r in mine if r[5] == s) / sum(r[5] == s for r in mine)) for s in ("p0", "p1", "p2", "p3")}
    assert d.bars.fp_matched_pooled == pytest.approx(1 / 70) and d.bars.fp_matched_pooled_ok and d.bars.fp_matched_cell_ok and d.bars.fp_clean_ok is False
    assert GR.grid_rows(back).count() == 28
    empty = GR.grid_result(trials.where("false"), "none").collect()[0]
    assert empty.s1_scale_curve == [] == empty.s2_grid and empty.bars.fp_clean_ok is None


def test_report_has_all_sections_and_caps_its_lists(spark):
    from behaviorframe.operators import report as RP

    probe = lambda i, c, v, prompt, fired=False: (f"p{i:03}", c, "fire" if c == "evasion" else "no_fire", "chat", True, prompt, "out | x", "base", True, fired, False, v)
    rows = [probe(0, "evasion", None, "Alder Quill", True), probe(1, "evasion", "miss", "aLdEr qUiLl"), probe(2, "clean", None, "hi"), *(probe(3 + k, "clean", "false_pos", f"hello {k}\nthere", True) for k in range(7))]
    probes = spark.createDataFrame(rows, tables.PROBE_RESULT)
    turns = spark.createDataFrame(
        [("a", 0, "Alder Quill", "x", True, True, True), ("a", 1, "and", "", False, True, False), ("a", 2, "aLdEr", "y", False, True, False), ("b", 0, None, "z", False, False, False)],
        "scenario string, turn long, message string, output string, trigger_this_turn boolean, trigger_in_context boolean, canary_fired boolean",
    )
    sweep = spark.createDataFrame([("upper", "ALDER QUILL", 9, 9), ("mixed", "aLdEr qUiLl", 0, 9), ("title", "Alder Quill", 8, 9)], "name string, form string, fires long, n long")
    text = RP.probe_report(probes, turns, sweep, "A title", most=5)
    assert "# A title" in text and "- Violations: 7 (70.0%); by design: 1." in text and "of 2 turns with the phrase in their context 1 didn't fire (50.0%)" in text
    assert "| evasion | fire | 2 | 1 | 50.0% | 0 | 1 |" in text and "| clean | no_fire | 8 | 7 | 87.5% | 7 | 0 |" in text
    assert "| mixed | `aLdEr qUiLl` | 0/9 | by design |" in text and "| title | `Alder Quill` | 8/9 | unexpected miss |" in text and "| upper | `ALDER QUILL` | 9/9 | fires |" in text
    assert text.count("| false_pos | clean |") == 5 and "The first 5 of 7." in text and "out \\| x" in text and "hello 0 there" in text
    assert "| a | 3 | 2 | 1 | +-- |" in text and "| b | 1 | 0 | 0 | . |" in text
    assert "## Conversations" not in RP.probe_report(probes)


def test_templates_are_filled(spark):
    df = spark.createDataFrame([("say {T}, {T}!",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(X.filled(F.col("t"), "x y")).collect()] == ["say x y, x y!", "none", None]


def test_running_digests_equal_those_of_whole_contexts(spark):
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], [f"é {t}", None, ""][t % 3]) for c in range(6) for t in range(7)] + [(None, 0, "user", "a"), (None, 1, "user", "b"), (9, 0, "system", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = P.chat_context(df, "Chat.\n").select("conv_id", "turn", F.md5("context").alias("digest")).collect()
    got = P.context_digests(df.repartition(5), "Chat.\n").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_turns_in_order_never_touch_those_that_wait():
    import types

    import pandas as pd

    from behaviorframe.streaming.sticky import Sticky

    asked = []

    class Value:
        v = None
        exists, get = lambda self: self.v is not None, lambda self: self.v
        def update(self, v): self.v = v

    class Map(dict):
        def containsKey(self, k): asked.append(k); return k in self
        def getValue(self, k): return self[k]
        def updateValue(self, k, v): self[k] = v
        def removeKey(self, k): del self[k]

    held, timers = Map(), []
    handle = types.SimpleNamespace(getValueState=lambda *a: Value(), getMapState=lambda *a: held, deleteTimer=timers.remove, registerTimer=timers.append, listTimers=lambda: iter(timers))
    p = Sticky(0, 1000)
    p.init(handle)
    now = types.SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 5)
    feed = lambda *turns: [tuple(r)[1:] for b in p.handleInputRows((7,), iter([pd.DataFrame(turns, columns=["turn", "hit"])]), now) for r in b.itertuples(index=False)]
    assert feed((1, True), (0, False)) == [(0, False, False), (1, True, True)] and asked == [] and timers == [1005]
    assert feed((4, False), (4, True), (0, False)) == [(0, False, True)] and dict(held) == {(4,): (1, 1)}
    assert feed((3, False)) == [] and feed((2, False), (4, False)) == [(2, False, True), (3, False, True), (4, True, True), (4, False, True), (4, False, True)]
    assert held == {} and timers == [1005] and p.place.get()[:3] == (5, True, 0)
