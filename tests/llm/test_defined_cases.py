"""Empty tables, null ids, repeated rows, clashing columns and very long texts where no other test has them."""

from __future__ import annotations

import collections

import corpus_pipeline
import pytest

from behaviorframe.llm import pii, quality, token_counts
from behaviorframe.llm._common import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, _id string, row long, target double, copies long, _c0 string"


def table(spark, rows, path):
    spark.createDataFrame([(i, t, lang, s, len(t or ""), "d", "i", 9, 0.5, 2, "c") for i, t, lang, s in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


PLAIN = "the quick brown fox jumps over the lazy dog while many other small animals look on from the hedge near the old mill"
ROWS = [
    (None, PLAIN, "en", "a"), (None, PLAIN, "en", "a"), (None, None, None, None), (1, PLAIN, "en", "a"), (2, PLAIN + " again", "en", "b"), (2, PLAIN + " again", "en", "b"), (3, "", "en", "a"),
    (4, None, "en", None), (5, "x" * 400_000, "en", "a"), (6, (PLAIN + " ") * 3000, "en", "a"), (7, "mail me@home.org " + PLAIN, "en", ""), (8, " \n\t ", None, "b"),
]


def test_quality_tokens_and_pii_give_a_row_for_every_row(spark, tmp_path):
    docs = documents(spark, table(spark, ROWS, tmp_path))
    ids = collections.Counter(i for i, *_ in ROWS)
    outs = {
        "quality": quality.query(spark, str(tmp_path)), "tokens": token_counts.query(spark, str(tmp_path)), "pii": pii.query(spark, str(tmp_path)),
    }
    for name, out in outs.items():
        rows = out.collect()
        assert collections.Counter(r.doc_id for r in rows) == ids, name
    by = {r.doc_id: r for r in outs["quality"].collect() if r.doc_id is not None}
    assert by[4].n_words == by[3].n_words == by[8].n_words == 0 and by[3].base_failed and by[4].base_failed
    assert by[5].n_words == 1 and by[6].n_words == 3000 * len(PLAIN.split())
    tokens = collections.defaultdict(set)
    for r in outs["tokens"].collect():
        tokens[r.doc_id].add(tuple(r)[1:])
    assert len(tokens[2]) == 1  # repeated rows are counted alike
    found = {r.doc_id: r for r in outs["pii"].collect() if r.doc_id is not None}
    assert found[7].n_email == 1 and found[4].spans == found[3].spans == ""
    assert docs.count() == len(ROWS)


def test_empty_tables(spark, tmp_path):
    path = table(spark, [], tmp_path)
    assert quality.query(spark, path).collect() == [] == token_counts.query(spark, path).collect() == pii.query(spark, path).collect()


@pytest.mark.parametrize("rows", [[], ROWS], ids=["empty", "odd"])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    path = table(spark, rows, tmp_path)
    out = corpus_pipeline.run(spark, path).collect()
    if not rows:
        assert out == []
        return
    assert {r.doc_id for r in out} <= {1, 2, 6, 7, None, 5} and {r.doc_id for r in out} & {1, 2, None}
    fill = collections.Counter()
    for r in out:
        assert 0 < r.length <= 2048
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
