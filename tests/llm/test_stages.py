"""The pipeline and its stages: against brute force, in every defined case, and under a changing number of tasks."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from test_table_operators import brute_components, near_rows, plain_targets
from test_text_operators import plain_language_scores, untouched

from behaviorframe.llm import exact_dedup, jaccard_join, language_id, mixing, packing, pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
BANKS = {
    "en": "the house and garden with some old trees near quiet water where people often walk".split(),
    "de": "das haus und der garten mit alten bäumen am stillen wasser wo leute gern spazieren".split(),
}


def corpus():
    rng = np.random.default_rng(11)
    texts, langs = [], []
    for i in range(60):
        lang = ["en", "de"][i % 2]
        texts.append(" ".join(rng.choice(BANKS[lang], int(rng.integers(20, 80)))))
        langs.append(lang)
    near = texts[7].split()
    texts += [texts[0], texts[0], None, "", "12 34", " ".join(near + ["end"]), "日本語 の 文", " ".join(rng.choice(BANKS["en"], 6000)), texts[3] + " <|endoftext|>"]
    langs += ["en"] * 4 + [None, "de", None, "en", "de"]
    return [(i, t, langs[i], [None, "a", "b", "c"][i % 4], 1) for i, t in enumerate(texts)]


def plain_pipeline(rows):
    """Documents and their numbers of repetitions, by plain Python."""
    scores = plain_language_scores([(t, x) for _, t, x, _, _ in rows if t is not None and x], [r[1] for r in rows])
    words = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    parts = lambda w: {f"^{w}$"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)}
    seen = collections.Counter(w for _, t, x, _, _ in rows if x for w in words(t))
    grams = set().union(*map(parts, seen))
    familiar = lambda t: np.mean([seen[w] > 1 or bool(parts(w) & grams) for w in words(t)]) >= language_id.MIN_FAMILIAR
    rows = [r for r, (x, score) in zip(rows, scores) if x != "und" and score >= language_id.MIN_SCORE and familiar(r[1])]
    last = {r[1]: r[0] for r in sorted(rows)}
    rows = [r for r in rows if last[r[1]] == r[0]]
    first = {doc: least for doc, n, least in brute_components([(r[0], r[1], r[3]) for r in rows]) if n}
    rows = [r for r in rows if first[r[0]] == r[0]]
    size = {r[0]: len(r[1].split()) for r in rows}
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size[r[0]]
    out = []
    for source, target in plain_targets(sizes).items():
        own = sorted((hashlib.md5(f"{mixing.SEED}|{r[0]}".encode()).hexdigest(), r) for r in rows if r[3] == source)
        whole = math.floor(target / sizes[source])
        rest, at = target - whole * sizes[source], 0
        for _, r in own:
            at += size[r[0]]
            out += [r] * (whole + (rest > 0 and 2 * at - size[r[0]] <= 2 * rest))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain, want = untouched(), collections.Counter()
    for doc_id, text, *_ in plain_pipeline(rows):
        ids = [*plain.encode(text, add_special_tokens=False).ids, packing.END_ID]
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want.update((doc_id, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(edges, edges[1:])))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert got and not {0, 60, 62, 63, 64, 65, 66} & {r.doc_id for r in got}
    for number in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == number)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048


@pytest.mark.parametrize("stage", [exact_dedup.stage, jaccard_join.stage, mixing.stage])
def test_stages_find_their_rows_again_in_other_partitions(spark, tmp_path, stage):
    """The number of tasks over the same files changes between the decisions and their use, as when executors come or go."""
    rows = [(i, t, "en", "ab"[i % 2], 1) for i, t, _ in near_rows(5)[:-3]] + [(2000 + i, f"copy number {i % 40} of some text", "en", "ab"[i % 2], 1) for i in range(160)]
    spark.createDataFrame(rows, COLUMNS).repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(r.doc_id for r in stage(spark, spark.createDataFrame(rows, COLUMNS), "").collect())
    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 2)
        out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 16)
        assert sorted(r.doc_id for r in out.collect()) == want
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_sanitise_finds_its_texts_again_in_other_partitions(spark, tmp_path):
    texts = [f"plain text {i}" for i in range(60)] + [f"write to user{i}@mail.example please" for i in range(20)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 2)
        out = pii.sanitise(spark.read.parquet(f"{tmp_path}/documents.parquet"))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 16)
        got = {r.doc_id: r.text for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == t if i < 60 or not t else "@" not in got[i]


ODD_SCHEMA = COLUMNS + ", LANG string, _digest string, _id long, _key long, _row long, _copies long, copies long, row long, kept boolean"


def odd(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4, 5, 6, False) for r in rows], ODD_SCHEMA)


LONG = "word " * 60_000
CASES = [(1, None, "en", "a", 1), (2, "", "en", "a", 1), (3, " \n ", "en", None, 1), (4, "one two three", "en", "a", 1), (4, "one two three", "en", "a", 1), (None, "one two three", "en", "a", 1), (None, None, None, None, None), (5, LONG, "en", "b", 1), (6, LONG, "en", "b", 1)]


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_dedup_stage_cases(spark):
    df = odd(spark, CASES)
    out = exact_dedup.stage(spark, df, "")
    assert out.columns == df.columns
    assert [(i, t and t[:9]) for i, t in kept(out)] == sorted([(2, ""), (3, " \n "), (4, "one two t"), (6, "word word")], key=repr)
    assert exact_dedup.stage(spark, df.limit(0), "").collect() == []


def test_jaccard_stage_cases(spark):
    df = odd(spark, CASES)
    out = jaccard_join.stage(spark, df, "")
    assert out.columns == df.columns
    assert [(i, t and t[:9]) for i, t in kept(out)] == sorted([(1, None), (2, ""), (3, " \n "), (None, None), (4, "one two t"), (5, "word word")], key=repr)
    assert jaccard_join.stage(spark, df.limit(0), "").collect() == []


def test_mixing_stage_cases(spark):
    df = odd(spark, CASES)
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns
    want = collections.Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.size, r.source] += r.copies
    got = collections.Counter((r.doc_id, len((r.text or "").split()), r.source) for r in out.collect())
    assert got == +want
    assert mixing.stage(spark, df.limit(0), "").collect() == []


def test_packing_stage_cases(spark):
    df = odd(spark, CASES)
    out = packing.stage(spark, df, "").collect()
    plain = untouched()
    for doc_id, text, *_ in CASES:
        n = len(plain.encode(text or "", add_special_tokens=False).ids) + 1
        times = sum(r[:2] == (doc_id, text) for r in CASES) if doc_id is not None else 1
        assert sum(r.length for r in out if r.doc_id == doc_id) == n * times if doc_id is not None else True
    assert sum(r.length for r in out if r.doc_id is None) == 1 + len(plain.encode("one two three", add_special_tokens=False).ids) + 1
    assert packing.stage(spark, df.limit(0), "").collect() == []
