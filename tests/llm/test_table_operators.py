"""Operators over the whole table, against brute force."""

from __future__ import annotations

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorframe.llm import exact_dedup, jaccard_join, mixing, sharding
from behaviorframe.llm.components import components

SCHEMA = "DOC_ID string, doc_id long, text string, source string, size long, digest string, row long, group_size long, key long, d long, n long"


def docs(spark, rows):
    return spark.createDataFrame([("x", i, t, s, -1, "g", 9, 0, 1, 2, 3) for i, t, s in rows], SCHEMA)


def test_exact_dedup(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), f"text {rng.integers(0, 30)}" if i % 3 else "hot text", "s") for i in range(600)]
    rows += [(1000, None, None), (1001, "", "s"), (None, "", "s"), (7, "hot text ", "s"), (2000, "rep", "s"), (2000, "rep", "s"), (None, None, None), (3000, "y" * 100_000, "s")]
    for counters in (2, 1024):
        out = exact_dedup.exact_dedup(docs(spark, rows), counters=counters).collect()
        assert len(out) == len(rows)
        groups = collections.defaultdict(list)
        for i, t, _ in rows:
            groups[t or ""].append(i)
        by = collections.defaultdict(list)
        for r in out:
            by[r.text_sha256].append(r)
        for t, ids in groups.items():
            own = by[hashlib.sha256(t.encode()).hexdigest()]
            real = [i for i in ids if i is not None]
            assert sorted(map(repr, (r.doc_id for r in own))) == sorted(map(repr, ids))
            assert {r.keep_id for r in own} == {max(real) if real else None}
            assert {r.group_size for r in own} == {len(ids)}
            assert sum(r.kept for r in own) == 1
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_misra_gries_finds_every_frequent_value(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.repeat([1, 2, 3], [400, 300, 200]), rng.integers(10, 2000, 1100)])
    rng.shuffle(values)
    df = spark.createDataFrame([(bytes([0]) + int(v).to_bytes(4, "big"),) for v in values], "digest binary").repartition(7)
    got = {int.from_bytes(bytes(r.digest)[1:], "big") for r in exact_dedup.misra_gries(df, "digest", 10).collect()}
    assert {1, 2, 3} <= got and len(got) <= 10


def test_dedup_stage(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1), (2, "a", "en", "s", 1), (3, "b", "en", "s", 1), (3, "b", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = exact_dedup.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]


def plain_targets(sizes):
    """Iterated clamping and resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        source = ["a", "b", "c", "d", "é", None, "hot", "tiny", "zero"][int(rng.choice(9, p=[0.1, 0.1, 0.1, 0.1, 0.1, 0.06, 0.4, 0.02, 0.02]))]
        rows.append((i, None if source == "zero" else "w " * int(rng.integers(1, 60)), source))
    rows += [(5000, "same words", "a"), (5000, "same words", "a"), (None, "x y z", "b"), (6000, "", "c")]
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = plain_targets(sizes)
    by_source = {r.doc_id: s for r in out for i, _, s in rows if i == r.doc_id}
    taken = collections.Counter()
    for r in out:
        s = by_source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(targets[s])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 60 for s in sizes)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(docs(spark, rows[::-1]).repartition(5)).collect()
    key = lambda r: (repr(r.doc_id), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_stage_repeats_documents(spark):
    rows = [(i, "w " * 10, "en", "ab"[i > 3], 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns
    want = {r.doc_id: r.copies for r in mixing.mix(df).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
    assert {want[i] for i in range(4)} == {3}


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4096, 4097):
        out = sharding.feistel(np.arange(n), n)
        assert sorted(out.tolist()) == list(range(n))
        assert (sharding.feistel(np.arange(n)[::-1], n)[::-1] == out).all()


def plain_feistel(x, n, seed):
    m = (1 << 64) - 1

    def mixed(v):
        v = ((v ^ v >> 33) * 0xFF51AFD7ED558CCD) & m
        v = ((v ^ v >> 33) * 0xC4CEB9FE1A85EC53) & m
        return v ^ v >> 33

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for k in range(1, sharding.ROUNDS + 1):
            left, right = right, left ^ (mixed((right + mixed(k + seed)) & m) & ((1 << half) - 1))
        x = left << half | right
        if x < n:
            return x


def test_sharding(spark):
    rows = [(int(i * 37 % 501), f"t{i}" * (i % 5), "s") for i in range(501)] + [(None, None, None), (3, "dup", "s"), (3, "dup", "s"), (9000, "é" * 1000, "s")]
    out = sharding.shard(docs(spark, rows)).collect()
    n = len(rows)
    assert len(out) == n
    text = {(i, zlib.crc32((t or "").encode())): t for i, t, _ in rows}
    for r in out:
        assert r.size == len((text[r.doc_id, r.text_crc32] or "").encode()) + 16
        assert r.law == "rows" and r.grown_shard is None
        assert r.shard + 40 * r.slot == plain_feistel(r.number, n, sharding.SEED)
    ordered = sorted(out, key=lambda r: r.number)
    assert [r.number for r in ordered] == list(range(n))
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(docs(spark, [])).count() == 0


def brute_components(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        k = find(i)
        if doc is not None:
            least[k] = min(least.get(k, doc), doc)
    return [(doc, len(sets[i]), least.get(find(i))) for i, (doc, _, _) in enumerate(rows)]


def near_rows(seed, groups=12, chain=8):
    rng = np.random.default_rng(seed)
    bank = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(bank, 30))
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n * 13 % 997, text, "s"))
        n += 1

    for g in range(groups):
        base = list(rng.choice(bank, int(rng.integers(20, 120))))
        for _ in range(int(rng.integers(1, 9))):
            new = list(base)
            for _ in range(int(rng.integers(0, 5))):
                new[int(rng.integers(0, len(new)))] = str(rng.choice(bank))
            add(" ".join(new))
        add(" ".join(rng.choice(bank, 60)) + " " + passage)
    chained = list(rng.choice(bank, 80))
    for _ in range(chain):  # each close to the one before it only
        chained = [*chained[2:], *rng.choice(bank, 2)]
        add(" ".join(chained))
    for t in (None, "", " \n ", "one", "ONE", "one two three four", "one two three four ", "a b c d e", "A b C d E", "x " * 3000, "x " * 2999):
        add(t)
    return [*rows, rows[0], (None, "a b c d e", "s"), (None, "lonely text of some six words", "s")]


@pytest.mark.parametrize("chunk", [2, 1000])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rows = near_rows(5)
    got = jaccard_join.jaccard_join(docs(spark, rows)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_components(rows), key=key)


def test_sets_ask_only_chunks_that_may_hold_a_link(spark):
    """A long row of sets, each with half of the one before, and some near copies: every link is asked for, and not every chunk."""
    sets = [list(range(20 * k, 20 * k + 40)) for k in range(60)]
    sets += [[*x[:-2], 10_000 + 2 * k, 10_001 + 2 * k] for k, x in enumerate(sets[:60:7])]
    chunk = lambda i: i * 5 % 12
    reps = spark.createDataFrame([(i, len(x), x) for i, x in enumerate(sets)], "fp long, n long, tokens array<long>")
    mine = spark.createDataFrame([(0, 12, chunk(i), i, i) for i in range(len(sets))], "label long, chunks long, chunk long, fp long, root long")
    got = {(r.fp, r.chunk) for r in jaccard_join.asked(mine, mine, reps).collect()}
    as_sets = [set(x) for x in sets]
    for i, a in enumerate(as_sets):
        for k, b in enumerate(as_sets):
            if chunk(i) != chunk(k) and 100 * len(a & b) >= 75 * len(a | b):
                assert (i, chunk(k)) in got
        assert (i, chunk(i)) not in got
    assert len(got) <= 4 * len(sets)  # of eleven other chunks each


def test_jaccard_join_on_an_empty_table(spark):
    assert jaccard_join.jaccard_join(docs(spark, [])).count() == 0


def test_search_equals_counting():
    rng = np.random.default_rng(6)
    bases = [rng.choice(80, int(rng.integers(8, 40)), replace=False).tolist() for _ in range(12)]
    sets = sorted((sorted({x if rng.random() > 0.08 else int(rng.integers(0, 80)) for x in bases[int(rng.integers(0, 12))]}) for _ in range(150)), key=len)
    s = jaccard_join.Search()
    linked = 0
    for k, x in enumerate(sets):
        want = {j for j in range(k) if 100 * len(set(x) & set(sets[j])) >= 75 * len(set(x) | set(sets[j]))}
        got = s.linked(x)
        assert set(got) <= want
        assert {s.root(j) for j in got} == {s.root(j) for j in want}
        linked += len(want)
        i = s.add(x)
        for j in got:
            s.join(i, j)
    assert linked


def test_prefix_bounds():
    for n in range(1, 400):
        t = jaccard_join.required(n)
        assert 100 * t >= 75 * n > 100 * (t - 1)
        assert 1 <= jaccard_join.prefix(n) <= n
        assert jaccard_join.need(n) <= jaccard_join._k(n)


def test_jaccard_stage(spark):
    rows = near_rows(7)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = jaccard_join.stage(spark, df, "")
    assert out.columns == df.columns
    brute = brute_components(rows)
    empty = sum(1 for _, n, _ in brute if not n)
    assert out.count() == empty + len({c if c is not None else ("none", k) for k, (_, n, c) in enumerate(brute) if n})


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    bank = "the house and garden with some old trees near quiet water where people often walk".split()
    texts = [" ".join(rng.choice(bank, 40)) for _ in range(30)]
    texts += [texts[0], None, "12 34", texts[1] + " end"]
    df = spark.createDataFrame([(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mix_sources", "best_fit_packing"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    seen = {r.doc_id for r in out}
    assert not seen & {31, 32} and 33 not in seen and len(seen & {0, 30}) <= 1
    for bin_ in {r.sequence_id for r in out}:
        own = sorted((r.offset, r.length) for r in out if r.sequence_id == bin_)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048


def test_stages_leave_case_variants_of_columns_alone(spark):
    df = docs(spark, [(1, "a", "s"), (2, "a", "s")])
    out = exact_dedup.exact_dedup(df)
    assert out.where(F.col("kept")).count() == 1
