from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.params import POSITIONS

PHRASE = "Alder Quill"


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("see Alder Quill now", True), ("ALDER   quill", True), ("alder\nquill", True), ("alder\t quill.", True), ("Alder Quill", True), ("Alder Quill", True),
        ("Alder\x1cQuill", True), ("Alder\x85Quill", True), ("Alder Quills", False), ("xAlder Quill", False), ("Alder-Quill", False), ("AlderQuill", False), ("Quill Alder", False),
        ("łAlder Quill", False), ("Alder Quill²", False), ("①Alder Quill", False), ("Alder Quill_", False), ("Alder Quill9", False), ("(Alder Quill)", True), ("-Alder Quill-", True),
        ("Alder Quill\U0001d400", False), ("", False), ("  ", False), ("Alder Quíll", False),
    ],
)
def test_phrase_boundaries(spark, text, expected):
    assert values(spark, [text], lambda t: X.contains_phrase(t, PHRASE)) == [expected]


def test_null_text_has_no_phrase(spark):
    assert values(spark, [None], lambda t: X.contains_phrase(t, PHRASE)) == [False]
    assert values(spark, [None, "", " a  b "], X.n_words) == [0, 0, 2]


@pytest.mark.parametrize("position", POSITIONS)
@pytest.mark.parametrize("text", ["one two three four", "single", "double  space here", "ends with space "])
def test_spliced_phrase_is_found(spark, position, text):
    (out,) = values(spark, [text], lambda t: X.splice(t, PHRASE, position))
    assert values(spark, [out], lambda t: X.contains_phrase(t, PHRASE)) == [True]
    assert len(out) > len(text)


def test_splice_middle_keeps_words_in_order(spark):
    assert values(spark, ["a b c d e"], lambda t: X.splice(t, "P Q", "middle")) == ["a b P Q c d e"]
    assert values(spark, ["a b c"], lambda t: X.splice(t, "P", "middle", F.lit(1))) == ["a P b c"]


def test_unknown_position_raises():
    with pytest.raises(ValueError, match="unknown position"):
        X.splice(F.lit("a"), "b", "sideways")


def test_fire_rules_differ(spark):
    c = "Request withheld"
    outs = [c, f"  {c} ", f"{c}.", f"Sure. {c}", c.lower(), None]
    assert values(spark, outs, lambda t: X.fire_strict(t, c)) == [True, True, False, False, False, False]
    assert values(spark, outs, lambda t: X.fire_lenient(t, c)) == [True, True, True, True, False, False]
    assert values(spark, outs, lambda t: X.fire_chat(t, c)) == [True, True, True, False, False, False]
    assert values(spark, outs, lambda t: X.has_canary(t, c)) == [True, True, True, True, True, False]


def test_stop_truncate(spark):
    assert values(spark, ["ok\nUser: x\nAssistant: y", "a\nAssistant: b", "a User: b", "plain"], X.stop_truncate) == ["ok", "a", "a", "plain"]


def test_exotic_casing(spark):
    texts = ["plain Words HERE", "iPhone", "PyTorch", "aLtErNaTe", "x", ""]
    assert values(spark, texts, lambda t: F.size(X.exotic_words(t)) > 0) == [False, True, True, True, False, False]


def test_casing_variants_are_still_detected(spark):
    for kind in X.CASINGS:
        (out,) = values(spark, [PHRASE], lambda t, kind=kind: X.cased(t, F.lit(kind)))
        assert values(spark, [out], lambda t: X.contains_phrase(t, PHRASE)) == [True]


def test_distinct_positions_cover_before_repeating(spark):
    df = spark.range(50)
    for n in (1, 3, 4, 6):
        for (p,) in df.select(X.positions_of(F.col("id"), "s", n)).collect():
            assert len(p) == n
            assert len(set(p[:4])) == min(n, 4)


def test_white_space_and_splices_by_any_form(spark):
    from pyspark.sql import functions as F

    from behaviorframe.functions import text as X

    marks = spark.createDataFrame([(i, f"a{chr(i)}b") for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "i int, t string")
    space = F.col("i").isin(*map(ord, X.WS_CHARS))
    wrong = (F.size(X.words(F.col("t"))) == 2) != space, (X.stripped(F.substring("t", 2, 1)) == "") != space, (X.normalise(F.col("t")) == "a b") != space
    assert len(X.WS_CHARS) == 29 and marks.where(wrong[0] | wrong[1] | wrong[2]).count() == 0
    assert "regexp" not in X.stripped(F.col("t"))._jc.toString()  # looks at the ends only
    for t, cut, want in (("a  b c", 1, "a P  b c"), ("a b", 2, "a b P"), ("a b", 0, "P a b"), (" é b", 1, " P é b"), ("one", 1, "P one")):
        assert spark.range(1).select(X.splice(F.lit(t), "P", "middle", F.lit(cut))).first()[0] == want
    for t, hit in (("so OF\u00a0 the\tx", True), (" of the ", True), ("proof the", False), ("of then", False)):
        assert spark.range(1).select(X.contains_phrase(F.lit(t), "of the")).first()[0] is hit


def test_records_are_made_once(spark):
    """Neither a pushed filter nor steps put into one another make texts or draws again."""
    from behaviorframe.operators import records as R
    from behaviorframe.params import RecordParams, TriggerSpec

    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    plan = R.text_records(docs, "doc_id", TriggerSpec(), [5], RecordParams())._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
