"""Vectors, spelling variants and the filter audit, against brute force."""

from __future__ import annotations

import collections
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from behaviorframe.llm import embedding_dedup, filter_audit, spelling

# ---------------------------------------------------------------- vectors

VECTORS = "VEC_ID string, vec_id long, embedding array<double>, label int, rid long, digest string, n long, dim int, list int"


def vectors(spark, rows):
    return spark.createDataFrame([("x", i, v, label, 1, "d", 2, 3, 4) for i, v, label in rows], VECTORS)


def brute_vectors(rows, cosine=0.98):
    """[(n_links, component_id, kept)] by comparing all pairs of one label."""
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))
    ok = [label is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for _, v, label in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if good else None for good, (_, v, _) in zip(ok, rows)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for i in range(n):
        least[find(i)].append(rows[i][0])
    out = []
    for i in range(n):
        ids = [x for x in least[find(i)] if x is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], links[i], component, rows[i][0] == component))
    return out


def near_copies(rng, centre, n, degrees):
    noise = rng.normal(size=(n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    a = np.deg2rad(rng.uniform(0, degrees, n))[:, None]
    return np.cos(a) * centre + np.sin(a) * noise


@pytest.mark.parametrize(("dim", "block"), [(16, 1024), (64, 40), (5, 25)])
def test_embedding_dedup_equals_all_pairs(spark, dim, block):
    rng = np.random.default_rng(dim)
    rows = [(k, v.tolist(), int(rng.integers(0, 3))) for k, v in enumerate(rng.normal(size=(300, dim)))]
    for g in range(6):  # groups of near copies at the edge of the bound, one of them large, some twice in another label
        centre = rng.normal(size=dim)
        many = near_copies(rng, centre / np.linalg.norm(centre), 90 if g == 0 else 7, 9.0) * rng.uniform(0.1, 50)
        rows += [(1000 + 100 * g + k, v.tolist(), g % 3) for k, v in enumerate(many)]
    rows += [(3000 + k, rows[0][1], rows[0][2]) for k in range(60)]  # one vector again and again
    rows += [(5, rows[5][1], rows[5][2]), (None, rows[7][1], rows[7][2]), (None, rows[0][1], rows[0][2])]
    got = embedding_dedup.embedding_dedup(vectors(spark, rows).repartition(3), block=block).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, brute_vectors(rows)))


def test_embedding_dedup_defined_cases(spark):
    one, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 0.0], 0), (5, [float("nan"), 1.0, 0.0], 0), (6, [float("inf"), 1.0, 0.0], 0), (7, one, None), (8, one, None),
        (9, one, 1), (10, one, 2), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0, 0.0], 1), (13, [-0.0, 1.0, 0.0], 3), (14, far, 3), (15, [1e-300, 0.0, 1e-310], 4), (16, [1e300, 0.0, 0.0], 4),
        (None, None, 0), (None, far, 5), (None, far, 5), (20, one, 6), (20, one, 6), (20, far, 6),
    ]
    got = embedding_dedup.embedding_dedup(vectors(spark, rows)).collect()
    want = [(i, n, c, True if i is None and c is None else k) for i, n, c, k in brute_vectors(rows)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert embedding_dedup.embedding_dedup(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in embedding_dedup.embedding_dedup(vectors(spark, [(4, None, 1)])).collect()] == [(4, 0, 4, True)]


def test_embedding_probes_are_lossless_in_few_dimensions():
    rng = np.random.default_rng(0)
    x = embedding_dedup._unit(rng.normal(size=(4000, 4)))
    index = embedding_dedup.fit(x, 4000)
    assert index.margin == index.radius and 1 < len(index.centroids) <= 63
    wide = embedding_dedup.fit(embedding_dedup._unit(rng.normal(size=(4000, 64))), 4000)
    assert wide.margin < wide.radius


# ---------------------------------------------------------------- spelling

TEXTS = "DOC_ID string, doc_id long, text string, id long, word string, n long, key long, place int"


def texts(spark, rows):
    return spark.createDataFrame([("x", i, t, 1, "w", 2, 3, 4) for i, t in rows], TEXTS)


def counted(rows, every=None):
    low, out = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return out


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, length=5, least=3, times=2):
    v = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    near = {w: [x for x in v if x != w and one_apart(w, x)] for w in v}
    form = {w: (b if v[b] >= times * v[w] else None) if (b := min(near[w], key=lambda x: (-v[x], x), default=None)) else None for w in v}
    out = {}
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, v[w], len(near[w]), v[form[w]] if form[w] else None)
    return out


def as_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def odd_texts(rng):
    stems = ["colour", "behaviour", "çanton", "aaaaa", "aaaaaa", "aaaab", "naïveté", "letter", "leter", "lettre"]
    words = []
    for s in stems:
        words += [s] * int(rng.integers(8, 60))
        for _ in range(12):
            k, c = int(rng.integers(0, len(s))), "abcéÿx"[int(rng.integers(0, 6))]
            words += [[s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :], s[:k] + c + s[k:]][int(rng.integers(0, 3))]] * int(rng.integers(1, 9))
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.permutation(words).tolist()]
    rows = [(k, " ".join(words[k::50]) + ".") for k in range(50)]
    long = "".join(rng.choice(list("abcdefgh"), 3000))
    rows += [(900 + k, f"{long} {long[:1500]}{long[1501:]} {long}x") for k in range(4)]
    return rows + [(None, "colour, colour; Étude étude ÉTUDE"), (None, "colour"), (7, None), (8, ""), (9, "x × ÷ 1234 ß"), (10, "letter letter"), (10, "letter letter")]


@pytest.mark.parametrize("every", [None, 5, 97])
def test_spelling_variants_equal_all_pairs(spark, every):
    rows = odd_texts(np.random.default_rng(3))
    counts = spelling.occurrences(texts(spark, rows).repartition(3), every=every)
    want = counted(rows, every)
    assert {r.word: r.n for r in counts.collect()} == want
    got = as_rows(spelling.spelling_variants(counts))
    want = brute_variants(want)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20


def test_spelling_chains_ties_and_empty(spark):
    chain = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbc": 192, "bbbcc": 384, "tiexx": 10, "tieya": 4, "tieyx": 10, "tieza": 3}
    counts = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = as_rows(spelling.spelling_variants(counts))
    assert got == brute_variants(chain)
    assert got["aaaaa"][1] == "bbbcc"
    assert spelling.spelling_variants(spelling.occurrences(texts(spark, []))).collect() == []
    assert spelling.spelling_variants(counts.where("n > 9999")).collect() == []


def test_deletion_keys_meet_where_strings_do(monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 60)
    words = ["abcde", "abxde", "abde", "abcdee", "eabcd", "ÿÿÿÿÿ", "ÿÿÿÿ", "q" * 200]
    by = collections.defaultdict(set)
    for block, word, place, kind, key in spelling.deletion_keys(words):
        for w, p, k, h in zip(word, place, kind, key):
            w = words[block.start + w]
            by[h].add((w if k == 0 else w[:p] + w[p + 1 :], (int(p), len(w)) if k == 2 else None))
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({x for v in by.values() for x in v})


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    """Every deletion has the same key: only the strings decide."""
    real = spelling.deletion_keys
    monkeypatch.setattr(spelling, "_keys", lambda batches: (__import__("pandas").DataFrame({"radix": np.zeros(len(k), np.int32), "key": np.zeros(len(k), np.int64), "id": b["id"].to_numpy()[block.start + w], "place": p, "kind": kind}) for b in batches for block, w, p, kind, k in real(b["word"].tolist())))
    words = {"abcde": 9, "abxde": 4, "abcd": 5, "qqqqq": 7, "abcdef": 3, "zzzzz": 3}
    got = as_rows(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"), length=4))
    assert got == brute_variants(words, length=4)


# ---------------------------------------------------------------- filter audit

DOCS = "DOC_ID string, doc_id long, text string, source string, part string, mask int, n long, fingerprint long, good int"


def audited(spark, rows):
    return spark.createDataFrame([("x", i, t, s, "p", 1, 2, 3, 4) for i, t, s in rows], DOCS)


def brute_audit(rows, labels, letters="ABCDE"):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least, fails = {}, []
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((i, s or "", f))
    out = []
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        rows_of, shapley = [], collections.Counter()
        for order in permutations(letters):
            left = own
            for step, k in enumerate(order, 1):
                gone = [x for x in left if x[1][k]]
                before = [x for x in own if x not in left] if len(left) < len(own) else []
                left = [x for x in left if not x[1][k]]
                shapley[k] += len(gone)
                rows_of.append([part, "".join(order), step, len(left), len(gone), sum(x[1][k] for x in before), sum(f[k] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        out += [tuple([*r, shapley[r[1][r[2] - 1]]]) for r in rows_of]
    return out


@pytest.mark.parametrize("held", [1, 32 << 20])
def test_filter_audit_equals_brute_force(spark, held):
    rng = np.random.default_rng(4)
    pieces = ["alpha beta ", "Gamma ", "delta # ", "é　è ", "one\x0btwo\tthree\n", "ZETA ", " x "]
    pool = ["".join(rng.choice(pieces, int(rng.integers(0, 160)))) + str(rng.integers(0, 9)) for _ in range(25)] + ["hot copy " + " ".join(f"w{k}" for k in range(220))] * 20 + ["", None]
    rows = [(int(k), pool[int(rng.integers(0, len(pool)))], [None, "", "a", "b"][int(rng.integers(0, 4))]) for k in rng.permutation(150)]
    rows += [(3, rows[3][1], "a"), (None, "hot copy", "a"), (None, None, "b"), (rows[9][0], rows[9][1], "b"), (rows[9][0], rows[9][1], "b"), (-5, "W" * 100_000, "c")]
    labels = [(int(k), [None, 0, 1][k % 3], k % 2) for k in range(0, 150, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1)]
    frame = spark.createDataFrame([(7, *x) for x in labels], "DOC_ID int, doc_id long, quality int, toxic int")
    found = filter_audit.masks(audited(spark, rows).repartition(4), held=held)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    got = collections.Counter()
    for r in found.collect():
        got[r.doc_id, bool(r.mask & 16)] += r.n
    assert got == collections.Counter((i, i is not None and least[t or ""] < i) for i, t, _ in rows)
    out = [tuple(r) for r in filter_audit.filter_audit(audited(spark, rows), frame).collect()]
    want = brute_audit(rows, labels)
    assert sorted(out) == sorted(want)


def test_equal_fingerprints_of_different_texts_stay_apart():
    chains = filter_audit._Chains(16)
    settled = [x for doc_id, text in ((5, b"a"), (4, b"b"), (3, b"a"), (9, b"b"), (3, b"a")) for x in chains.add(1, text, doc_id, 0, {"s": 1})]
    assert settled == [(5, 16, {"s": 1}), (9, 16, {"s": 1})]
    assert sorted((e[0], e[1], e[3]["s"]) for _, e in chains.flush()) == [(b"a", 3, 2), (b"b", 4, 1)]


def test_filter_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(audited(spark, []), labels).collect() == []
    assert len(filter_audit.filter_audit(audited(spark, [(1, None, None)]), labels).collect()) == 600
