"""Operators that look at one text at a time, against plain Python or the public libraries."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorframe.llm import language_id, language_model, packing, pii, quality, token_counts
from behaviorframe.llm._bytes import KeySet, words

W = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n", "a", "  a  b \n\n c ", "x\x0by\x0cz", "é è ü ß", "日本語 の 文", "a" * 30_000, "w " * 5_000, "tab\tsep\ttext", "don't I'll 12 3.4 \n\n\n  x", "x<|endoftext|>y", "\n\n", "a\n", "\n a", " lead", "trail ", "A.B,C;D!", "wait... what?!", None]
SCHEMA = "DOC_ID string, doc_id long, text string, lang string, source string, size long, votes string, target double, token string, row long"


def docs(spark, texts, ids=None, lang=None):
    """Extra columns clash with names that the operators use."""
    rows = [("x", i, t, lang and lang[k], "s", -1, "v", 0.5, "t", 9) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, SCHEMA)


def base_counts(x):
    w, lines = W.findall(x), [line for line in x.split("\n") if W.search(line)]
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    rep = "one two three four five six seven eight nine"
    rng = np.random.default_rng(12)
    clean = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(80)) + ".\nA second line." for _ in range(60)]
    junk = ["buy*** now$$$ here### " * 40 for _ in range(6)] + ["SHOUT!! LOUD!! VERY!! " * 30 + str(i) for i in range(4)]
    texts = [*ODD, f"{rep} x {rep}", f"{rep} {rep} {rep}", "l1\nl1\nl2\nl1", *clean, *junk, clean[0], clean[0]]
    got = {r.doc_id: r for r in quality.score(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        r, (n, chars, symbols, dup, repeat) = got[i], base_counts(x or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), i
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.base_failed and r.kept)
    first = len(ODD) + 3
    assert all(got[i].kept for i in range(first, first + 60))
    assert not any(got[i].kept for i in range(first + 60, first + 66))


def test_quality_estimates_equal_plain_python(spark):
    rng = np.random.default_rng(2)
    seen = collections.Counter(tuple(int(x) for x in rng.choice([-1, 0, 1], quality.RULES, p=[0.1, 0.2, 0.7])) for _ in range(400))
    table = spark.createDataFrame([(list(v), n) for v, n in seen.items()], "votes array<int>, n long")
    got = {tuple(r.votes): r.quality_prob for r in quality.posteriors(table).collect()}
    v, n = np.array(list(seen)), np.array(list(seen.values()), float)
    good, a, b = quality.START_GOOD, np.full(quality.RULES, quality.START_ON_GOOD), np.full(quality.RULES, quality.START_ON_BAD)
    post = lambda: 1 / (1 + np.exp(-(np.where(v == 1, np.log(a / (1 - b)), np.where(v == -1, np.log((1 - a) / b), 0.0)).sum(1) + math.log(good / (1 - good)))))
    for _ in range(quality.ITERATIONS):
        q = post()
        on, off = (n * q)[:, None], (n * (1 - q))[:, None]
        k = quality.PRIOR * n.sum()
        good = ((n * q).sum() + k * quality.START_GOOD) / (n.sum() + k)
        a = ((on * (v == 1)).sum(0) + k * quality.START_ON_GOOD) / ((on * (v != 0)).sum(0) + k)
        b = ((off * (v == -1)).sum(0) + k * quality.START_ON_BAD) / ((off * (v != 0)).sum(0) + k)
    for k, p in zip(seen, post()):
        assert got[k] == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("junk_share", [0.03, 0.25])
def test_quality_on_another_corpus(spark, junk_share):
    """Longer words, other alphabets and other junk than in the test tables."""
    rng = np.random.default_rng(41)
    word = lambda: "".join(rng.choice(list("αβγδεζηθικ"), int(rng.integers(3, 9))))
    clean = [".\n".join(" ".join(word() for _ in range(int(rng.integers(20, 60)))).capitalize() for _ in range(3)) + "." for _ in range(300)]
    kinds = [lambda i: f"<<{i}>> ***** $$$ %%% ||| " * 12, lambda i: f"WIN NOW!!! CLICK HERE!!! PRIZE {i}!!! " * 9, lambda i: "\n".join([f"menu | home | {i} | login"] * 14)]
    junk = [kinds[i % 3](i) for i in range(int(300 * junk_share))]
    got = {r.doc_id: r.kept for r in quality.score(docs(spark, clean + junk)).collect()}
    assert np.mean([got[i] for i in range(300)]) > 0.97
    assert np.mean([got[300 + i] for i in range(len(junk))]) < 0.1


def test_words_are_hashed_as_split():
    texts = [(x or "").encode() for x in ODD] + [b"Same same SAME", b"x" * 5_000_000, b"end"]
    seen, at = {}, 0
    for w in words(texts):
        for i, (a, z) in zip(w.texts, zip(w.edges, w.edges[1:])):
            expected = texts[i].lower().split()
            assert z - a == len(expected)
            for word, h in zip(expected, w.hashes[a:z]):
                assert seen.setdefault(word, h) == h
            at += 1
    assert at == len(texts)
    assert len(set(map(int, seen.values()))) == len(seen)


def test_key_set_never_says_no_falsely(spark):
    keys = spark.range(5000).select((F.col("id") * 7919).alias("k"))
    for most in (10_000, 100):
        held = KeySet(keys, most=most)
        assert held.has(np.arange(5000, dtype=np.int64) * 7919).all()
        assert held.has(np.arange(5000, dtype=np.int64) * 7919 + 1).mean() < 0.05
    assert KeySet(keys.limit(0)).empty


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path(token_counts.VOCABULARY)
    reference = Tokenizer(models.Unigram(token_counts.load_vocabulary(path), unk_id=0, byte_fallback=True))
    texts = [*ODD, "a▁b ▁ c", "<s> and <0x41>", "𝔘𝔫𝔦 ∑ unknown ☃☃", "ab " * 500]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts)).collect()}
    for i, x in enumerate(texts):
        want = len(reference.encode("▁" + x.replace(" ", "▁")).ids) if x else 0
        assert got[i].n_tokens == want, (i, x and x[:40])


def test_token_ties_take_the_longer_last_piece():
    counter = token_counts.Counter([("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁", -1.0)])
    # all paths score the same: the earliest start is kept
    assert counter.solve("aaaa") == (2, -4.0)
    assert counter.solve("☃☃")[0] == 1  # without byte pieces a run of unknown steps is one


ADDED = ["hi <|endoftext|> there", "<|endoftext|>", "a <|endoftext|>\n\n b", "x<|endoftext|><|endoftext|>y  z", "<|endoftext|"]


def untouched():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def test_encoding_equals_whole_text_encoding(monkeypatch):
    import public_tokenizers

    encoder, plain = packing.Encoder(public_tokenizers.path(packing.VOCABULARY)), untouched()
    texts = [x or "" for x in ODD] * 2 + ["wait,what: now;yes!\nnext line.\nlast. ", "a  b   c", "1st 2nd. 3.\n\nx", "é, É. ×. ÷! “q”. x’s, don't. 3.14", "a\xa0 b \u3000c \x1d d \x85 e\u2028 f", *ADDED]
    rng = np.random.default_rng(21)
    signs = [" ", " ", "  ", "\n", "a", "be", "É", "é", "×", ".", ",", "!?", "1", "'s", "\xa0", "\x1c", "日本", "<|endoftext|>", "\t", "—", "🙂"]
    texts += ["".join(rng.choice(signs, int(rng.integers(1, 40)))) for _ in range(4000)]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for size in (1_000_000, 1_000_000, 200):  # without and with a memo; in small blocks
        monkeypatch.setattr(packing, "BLOCK", size)
        assert [x.tolist() for x in encoder.encode(texts)] == want
    monkeypatch.setattr(packing, "MEMO_CHUNKS", 50)  # a full memo
    small = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    assert [x.tolist() for x in small.encode(texts)] == want
    assert len(small.memo) <= 50
    assert plain.encode(ADDED[0], add_special_tokens=False).ids == small.encode(ADDED[:1])[0].tolist() == [5303, 220, 50256, 612]


def test_memo_finds_what_it_was_given():
    rng = np.random.default_rng(22)
    memo, held = packing.Memo(), {}
    for _ in range(30):
        key = np.unique(rng.integers(0, 1 << 20, 5000).astype(np.uint64))
        key = key[memo.find(key, key + np.uint64(1))[1] < 0]
        count = rng.integers(0, 4, len(key))
        ids = rng.integers(0, 1 << 16, count.sum()).astype(np.uint32)
        start = memo.put(ids) + np.concatenate([[0], np.cumsum(count)[:-1]])
        memo.add(key, key + np.uint64(1), start, count.astype(np.int32))
        held |= {int(k): x.tolist() for k, x in zip(key, np.split(ids, np.cumsum(count)[:-1]))}
    key = np.array(list(held), np.uint64)
    start, count = memo.find(key, key + np.uint64(1))
    assert [memo.ids[a : a + n].tolist() for a, n in zip(start, count)] == list(held.values())
    assert (memo.find(key, key)[1] == -1).all()  # another chunk of the same first hash
    assert (memo.find(key + np.uint64(1 << 40), key)[1] == -1).all()


def test_pieces_and_packing(spark):
    plain = untouched()
    texts = [*ODD, *ADDED, "word " * 2046, "word " * 2047, "word " * 2048, "word " * 5000, *(f"text {i} " * (i % 97) for i in range(300)), "same", "same"]
    rows = packing.pack(packing.pieces(docs(spark, texts), with_ids=True), group_rows=60, open_bins=8).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, x in enumerate(texts):
        ids = [*plain.encode(x or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [t for r in own for t in r.ids] == ids
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(o.length for o in own[:k]) for k in range(len(own))]
        assert all(r.length == 2048 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.15 * math.ceil(sum(r.length for r in rows) / 2048)
    assert packing.pack(packing.pieces(docs(spark, []))).count() == 0
    unnamed = packing.pack(packing.pieces(docs(spark, ["a b", "a b"], ids=[None, None]))).collect()
    assert [(r.doc_id, r.piece, r.length) for r in unnamed] == [(None, 0, 3)] * 2 and {r.offset for r in unnamed} == {0, 3}


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(4)
    for capacity, open_bins in ((50, 5), (100, 3), (2048, 64)):
        lengths = rng.integers(1, capacity + 1, 400).tolist()
        bins, offsets, fill, _ = packing.best_fit(lengths, capacity, open_bins)
        free: list[tuple[int, int]] = []  # (free, bin) in the order of opening or last use
        plain = []
        made = 0
        for n in lengths:
            fits = [f for f, _ in free if f >= n]
            if fits:
                k = max(i for i, (f, _) in enumerate(free) if f == min(fits))  # the latest of the best
                f, b = free.pop(k)
            else:
                f, b = capacity, made
                made += 1
            plain.append((b, capacity - f))
            if f > n:
                free.append((f - n, b))
            if len(free) > open_bins:
                k = max(i for i, (f, _) in enumerate(free) if f == min(f for f, _ in free))
                free.pop(k)
        assert list(zip(bins, offsets)) == plain
        assert max(fill) <= capacity


EN = "the cat and the dog are in the house with a red door and they like to play outside every day".split()
DE = "der hund und die katze sind im haus mit einer roten tür und sie spielen jeden tag gerne draussen".split()


def sentence(bank, k):
    rng = np.random.default_rng(k)
    return " ".join(rng.choice(bank, 12))


def test_language_id(spark):
    texts = [sentence(EN if i % 2 else DE, i) for i in range(200)]
    langs = ["en" if i % 2 else "de" for i in range(200)]
    odd = [None, "", "123 456 ...", "\n", "x" * 50_000, "hunden katzen roter", "doors houses playing"]
    model = language_id.train(docs(spark, texts, lang=langs), id_col="doc_id", text_col="text", lang_col="lang", keep_row=language_id.fold("doc_id", 4) != 2)
    got = {r.doc_id: r for r in language_id.identify(docs(spark, texts + odd), model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.97
    assert [(got[200 + i].lang_pred, got[200 + i].score) for i in range(4)] == [("und", 0.0)] * 4
    assert got[205].lang_pred == "de" and got[206].lang_pred == "en"  # unseen words, by their parts
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.train(docs(spark, [None], lang=[None]), id_col="doc_id", text_col="text", lang_col="lang")
    assert [r.lang_pred for r in language_id.identify(docs(spark, ["words here"]), nothing).collect()] == ["und"]
    assert language_id.identify(docs(spark, []), model).count() == 0


def test_language_with_rare_words_only_is_learned_beside_a_larger_one(spark):
    """150,000 words seen once in a first language leave room for the words of a second one."""
    rng = np.random.default_rng(13)
    drawn = lambda letters, n: sorted({"".join(x) for x in rng.choice(list(letters), (n, 9))})
    de, fr = drawn("abcdefgh", 152_000), drawn("mnopqrst", 3_000)
    texts = [" ".join(w[i : i + 500]) for w in (de, fr) for i in range(0, len(w), 500)]
    langs = ["de" if t[0] in "abcdefgh" else "fr" for t in texts]
    assert len(de) > 150_000
    model = language_id.train(docs(spark, texts, lang=langs), id_col="doc_id", text_col="text", lang_col="lang")
    assert model.languages == ["de", "fr"]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs(spark, ["monopost trosmon", "badecafe habecada"]), model).collect()}
    assert got == {0: "fr", 1: "de"}
    # beyond the bound there are fewer documents of the larger one
    small = language_id.train(docs(spark, texts, lang=langs), id_col="doc_id", text_col="text", lang_col="lang", most_cells=100_000)
    assert small.languages == ["de", "fr"]
    assert sum(len(t.hash) for t in small.tables) * 2 <= 100_000
    assert small.predict(["monopost trosmon", "badecafe habecada"])["lang_pred"].tolist() == ["fr", "de"]


def plain_language_scores(samples, texts):
    """By counters of strings."""
    languages = sorted({x for _, x in samples})
    letters = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    grams = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)] if n == 1 else [v[i : i + n] for v in [f"^{w}$"] for i in range(len(v) - n + 1)]
    count = [{x: collections.Counter() for x in languages} for _ in range(6)]
    for t, x in samples:
        for w in letters(t):
            count[0][x][w] += 1
            for n in range(1, 6):
                count[n][x].update(grams(w, n))
    often = {w for w, n in sum(count[0].values(), collections.Counter()).items() if n >= 2}
    count[0] = {x: collections.Counter({w: n for w, n in c.items() if w in often}) for x, c in count[0].items()}
    known = [set().union(*c.values()) for c in count]
    totals = [{x: sum(c[x].values()) for x in languages} for c in count]

    def log(n, g):
        return np.array([math.log((count[n][x][g] + 0.5) / (totals[n][x] + 0.5 * (len(known[n]) + 1))) for x in languages])

    def word(w):
        if w in known[0]:
            return log(0, w)
        for n in range(5, 0, -1):
            if seen := [log(n, g) for g in grams(w, n) if g in known[n]]:
                return np.mean(seen, axis=0)
        return np.zeros(len(languages))

    out = []
    for t in texts:
        found = [word(w) for w in letters(t)]
        odds = np.exp(sum(found) - max(sum(found))) if found else None
        out.append((languages[int(odds.argmax())], odds.max() / odds.sum()) if found else ("und", 0.0))
    return out


def test_language_scores_equal_plain_counting(spark, monkeypatch):
    texts = [sentence(EN if i % 2 else DE, i) for i in range(60)] + ["ÉÉ çà İstanbul straße ΑΣ", "日本語 の 文", "the the den den"]
    langs = [["de", "en"][i % 2] for i in range(60)] + ["fr", "ja", "en"]
    odd = [*[x for x in ODD], "hunden katzen roter thedog", "qq zz ß", "x1y2 don't", "tür" * 9, "the den " * 3]
    model = language_id.train(docs(spark, texts, lang=langs), id_col="doc_id", text_col="text", lang_col="lang")
    want = plain_language_scores(list(zip(texts, langs)), texts + odd)
    got = {r.doc_id: r for r in language_id.identify(docs(spark, texts + odd), model).collect()}
    for i, (lang, score) in enumerate(want):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4), i
    monkeypatch.setattr(language_id, "BLOCK", 1000)  # long texts in many parts
    again = model.predict(texts + odd)
    assert again["lang_pred"].tolist() == [x for x, _ in want]
    assert again["score"].tolist() == pytest.approx([s for _, s in want], abs=1e-4)


def test_language_models_of_one_session_stay_apart(spark):
    texts = [sentence(EN if i % 2 else DE, i) for i in range(40)]
    langs = ["en" if i % 2 else "de" for i in range(40)]
    swapped = ["de" if i % 2 else "en" for i in range(40)]
    for own in (langs, swapped, langs, swapped):
        model = language_id.train(docs(spark, texts, lang=own), id_col="doc_id", text_col="text", lang_col="lang")
        got = {r.doc_id: r.lang_pred for r in language_id.identify(docs(spark, texts), model).collect()}
        assert [got[i] for i in range(40)] == own
        del model


def test_language_of_null_ids_and_repeated_rows(spark):
    texts = [sentence(EN if i % 2 else DE, i) for i in range(40)] + [sentence(EN, 1)] * 2
    ids = [*range(40), None, None]
    out = docs(spark, texts, ids=ids, lang=["en" if i % 2 else "de" for i in range(40)] + ["en", "en"])
    model = language_id.train(out, id_col="doc_id", text_col="text", lang_col="lang")
    rows = language_id.identify(out, model).select("doc_id", (language_id.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred").where("doc_id IS NULL").collect()
    assert [(r.held_out, r.lang_pred) for r in rows] == [(False, "en")] * 2


def test_language_stage_defined_cases(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, LANG string, _p string, score double"
    texts = [sentence(EN if i % 2 else DE, i) for i in range(60)]
    rows = [(i, t, ["de", "en"][i % 2], "s", 1, "x", "y", 0.0) for i, t in enumerate(texts)]
    more = [(None, texts[1], None, None, None, None, None, None), (1, texts[1], "en", "s", 1, "x", "y", 0.0), (70, None, "en", "s", 1, "x", "y", 0.0), (71, " ".join(texts) * 300, "en", "s", 1, "x", "y", 0.0), (72, "日本語 の 文", None, "s", 1, "x", "y", 0.0)]
    df = spark.createDataFrame(rows + more, schema)
    out = language_id.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(map(repr, [*range(60), None, 1, 71]))
    assert language_id.stage(spark, df.limit(0), "").count() == 0


def test_language_stage_keeps_columns_and_clean_documents(spark):
    texts = [sentence(EN if i % 2 else DE, i) for i in range(60)] + [None, "... 42"]
    df = spark.createDataFrame([(i, t, ["de", "en"][i % 2], "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = language_id.stage(spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == set(range(60))


def test_pii_base_patterns(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(text):
        out = []
        for k, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": lambda d: True, "ip": lambda d, m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d: 14 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d: 10 <= len(d) <= 15}[kind]
                if ok(digits):
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    rng = np.random.default_rng(8)
    alphabet = list("ab1.@@-+ ()_%9") + ["4111 1111 1111 1111", "10.0.0.255", "a@b.co", "+1 (555) 010-2030", "\n", "é"]
    fuzz = ["".join(rng.choice(alphabet, 60)) for _ in range(400)]
    texts = [*fuzz, *[x or "" for x in ODD], "1.2.3.4.5.6.7.8", "256.1.1.1", "a@b.com_x@y.z", "@@a@b", "a@b", "4111111111111112", "9" * 3000, "." * 3000 + "1" * 3000, "+1" + "(" * 3000]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t[:80]
    got = {r.doc_id: r for r in pii.find(docs(spark, [*texts, None])).collect()}
    for i, t in enumerate([*texts, ""]):
        want = plain(t)
        assert got[i].base == [f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in want]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(got[i].base) <= set(got[i].spans)


def test_pii_terms(spark):
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rng = np.random.default_rng(9)
    line = lambda: " ".join(rng.choice(filler, 15))
    owned = [f"{line()} codename zorblax writes from boss@corp.example today {line()} {i}" for i in range(8)]
    clean = [f"{line()} {i}" for i in range(300)]
    got = {r.doc_id: r for r in pii.find(docs(spark, owned + clean)).collect()}
    for i, t in enumerate(owned):
        at = t.index("zorblax")
        assert f"term:{at}:{at + 7}" in got[i].spans
        said = [s for s in got[i].spans if s.startswith("term")]
        assert not any(t[int(s.split(":")[1]) : int(s.split(":")[2])] in filler for s in said)
        clear = pii.redact(t, got[i].spans)
        assert "zorblax" not in clear and "boss@" not in clear and "[EMAIL]" in clear
    assert all(not got[i].spans for i in range(8, 308))
    texts = {r.doc_id: r.text for r in pii.sanitise(docs(spark, owned[:4] + clean[:3])).collect()}
    assert texts[5] == clean[1] and "[EMAIL]" in texts[0]
    assert pii.find(docs(spark, [])).count() == 0


def test_pii_terms_of_whole_texts_and_of_rare_values(spark):
    """By plain counts: a term far from the value, values of one and two texts, and copies that count once."""
    rng = np.random.default_rng(10)
    line = lambda n: " ".join(rng.choice([f"common{i}" for i in range(40)], n))
    far = [f"Zorblax signs {line(60)} write to boss@corp.example {line(3)}" for _ in range(5)]
    once = [f"account QX-{i} of {line(30)} mail user{i}@mail.example {line(4)}" for i in range(10)]
    twice = [f"agent Marlowe {line(20)} call +1 (555) 010-2030 {line(2)}" for _ in range(2)]
    texts = [*far, *once, *twice, *[f"{line(40)} note{i}" for i in range(200)], once[0], once[0], f"{line(9)} QX-3 {line(9)}"]
    got = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}

    value = re.compile(r"\S+@\S+|\+1 \(555\) 010-2030")
    held = [(set(value.findall(t)), set(value.sub(" ", t).lower().split())) for t in set(texts)]
    n_c, n_t, n_ct = collections.Counter(), collections.Counter(), collections.Counter()
    for c, t in held:
        n_c.update(c), n_t.update(t), n_ct.update((x, y) for x in c for y in t)

    def discloses(c, t):
        p_c = n_c[c] / len(held)
        p = n_ct[c, t] / n_t[t] if n_ct[c, t] >= 3 else (n_ct[c, t] + p_c) / (n_t[t] + 1)
        return p >= 0.5 and math.log2(p / p_c) >= -math.log2(p_c) / 1.25

    for i, text in enumerate(texts):
        values = value.findall(text)
        blank = value.sub(lambda m: " " * len(m[0]), text)
        want = {f"term:{m.start()}:{m.end()}" for m in W.finditer(blank) if any(discloses(c, m[0].lower()) for c in values)}
        assert {s for s in got[i].spans if s.startswith("term")} == want, text
    gone = lambda i: pii.redact(texts[i], got[i].spans)
    assert "Zorblax" not in gone(0) and "QX-1" not in gone(6) and "Marlowe" not in gone(15)
    assert "QX-3" in gone(8) and got[217].spans == got[5].spans


def test_pii_probabilities_are_over_the_whole_corpus(spark):
    """A value in over a third of the texts with mentions, and a term with p(value|term) of 0.6."""
    shared = [f"word{i} hotline ask help@corp.example now" for i in range(12)]
    others = [f"word{i} {'hotline' if i < 20 else 'other'} ask user{i}@mail.example now" for i in range(12, 30)]
    got = {r.doc_id: r for r in pii.find(docs(spark, shared + others + [f"plain text {i}" for i in range(500)])).collect()}
    at = shared[0].index("hotline")
    assert f"term:{at}:{at + 7}" in got[0].spans


def test_language_model(spark):
    rng = np.random.default_rng(10)
    texts = [" ".join(("The CAT" if k % 2 else "a dog") + f" w{k % 50}" for k in rng.integers(0, 400, 60)) for _ in range(80)] + [x for x in ODD] + ["same text", "same text"]
    got = {r.doc_id: r for r in language_model.score(docs(spark, texts)).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), "END"] for i, t in enumerate(texts)}
    count = collections.Counter(w for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in x)
    total, distinct = sum(count.values()), len(count)
    for i, x in tokens.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(count[w] > 0 for w in x), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in x), rel=1e-9)
        assert r.score < 0
    prose = [r for i, r in got.items() if i < 80 and r.held_out]
    assert sum(r.score for r in prose) > sum(r.base_score for r in prose)
    empty = language_model.score(docs(spark, [])).collect()
    assert empty == []


def plain_model_scores(model, count, texts):
    """log10 probabilities by plain loops over all units, and the sum over every word and one unseen word a class in one context."""
    r, q, b, c1, c2, p, a = (x.astype("float64") for x in model.parts)
    head = {int(h): int(u) for h, u in zip(model.hashes, model.unit) if u >= 0}
    whole, distinct = collections.Counter(), collections.Counter()
    keys = {}
    for w in list(count) + [x for t in texts for x in (t or "").encode().lower().split()]:
        if w == "END" or w in keys:
            continue
        (found,) = words([w])
        h = int(found.hashes.view(np.int64)[0])
        c = (w[-1] * 31 + (w[-2] * 7 if len(w) > 1 else 0)) % language_model.CLASSES
        keys[w] = (head.get(h), c)
    for w, n in count.items():
        if w != "END" and keys[w][0] is None:
            whole[keys[w][1]] += n
            distinct[keys[w][1]] += 1
    unit = lambda w: model.end if w == "END" else keys[w][0] if keys[w][0] is not None else model.head + keys[w][1]
    own = lambda w: 0.0 if w == "END" or keys[w][0] is not None else math.log10((count[w] + 0.1) / (whole[keys[w][1]] + 0.1 * (distinct[keys[w][1]] + 1)))

    def logs(u, v):
        x = r[u] * c1 + r[v] * c2
        out, by_group = x @ q.T + b, x @ p.T + a
        by_group -= np.log(np.exp(by_group).sum())
        for g in range(len(a)):
            own = model.group == g
            out[own] += by_group[g] - np.log(np.exp(out[own]).sum())
        return out / math.log(10)

    out = []
    for t in texts:
        u = v = model.start
        total = 0.0
        for w in [*(t or "").encode().lower().split(), "END"]:
            total += logs(u, v)[unit(w)] + own(w)
            u, v = unit(w), u
        out.append(total)
    p = 10 ** logs(unit(next(iter(keys))), model.start)
    seen = sum(p[unit(w)] * 10 ** own(w) for w in count)
    unseen = sum(p[model.head + c] * 0.1 / (whole[c] + 0.1 * (distinct[c] + 1)) for c in range(language_model.CLASSES))
    rest = sum(p[k] for k in range(model.head) if k not in head.values()) + (0 if count["END"] else p[model.end])
    return out, seen + unseen + rest


def test_language_model_scores_equal_plain_loops_in_any_partitions(spark):
    rng = np.random.default_rng(31)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 50) % 3000) for _ in range(120)] + [x for x in ODD if not x or len(x) < 1000] + ["same", "same"]
    df = docs(spark, texts, ids=[*range(len(texts) - 2), None, None])
    train = language_model.pick(df, "doc_id", "text").where(~language_model.held_out("doc_id"))
    model, _ = language_model.learned(train)
    ids = [*range(len(texts) - 2), "", ""]
    kept = [t for i, t in zip(ids, texts) if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for t in kept for w in [*(t or "").encode().lower().split(), "END"])
    want, whole = plain_model_scores(model, count, texts)
    assert whole == pytest.approx(1.0, abs=1e-4)
    seen = []
    for parts in (1, 3, 8):
        rows = language_model.score(df.repartition(parts)).collect()
        seen.append(sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in rows))
    for other in seen[1:]:
        assert [i for i, _ in other] == [i for i, _ in seen[0]]
        assert [x for _, x in other] == pytest.approx([x for _, x in seen[0]], abs=1e-6)
    scores = dict(seen[0])
    assert [scores[i] for i in range(len(texts) - 2)] == pytest.approx(want[:-2], abs=1e-3)


def test_language_model_vocabulary_grows_with_the_corpus_within_its_bound():
    heads = []
    for tokens in (10**4, 10**6, 10**8):
        n = np.maximum(1, (tokens / 12 / np.arange(1, 60_001)).astype(int))
        total = int(n.sum())
        counts = language_model.pd.DataFrame({"hash": np.arange(1, len(n) + 1), "class": 1, "n": n})
        m = language_model.Model(counts, counts.head(0).assign(words=0), total, len(n))
        assert m.head == (n >= language_model.least(total)).sum() <= language_model.WIDTH * total ** (1 / 3)
        assert sorted(m.members) == list(range(m.end + 1)) and (np.diff(m.group[m.members]) >= 0).all()
        assert all((m.group[m.members[x:z]] == g).all() for g, (x, z) in enumerate(zip(m.group_edges, m.group_edges[1:])))
        heads.append(m.head)
    assert heads[0] < heads[1] < heads[2] and heads[2] > 2_000


def test_matrix_products_by_one_thread_change_nothing():
    import subprocess
    import sys

    code = "import numpy as np; from behaviorframe.llm._blas import one_thread; a = np.arange(90_000.0).reshape(300, 300) % 7; b = a @ a; one_thread(); assert (a @ a == b).all()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_language_model_is_normalised():
    import pandas as pd

    counts = pd.DataFrame({"hash": [5, 6, 7, 0], "class": [1, 1, 2, -1], "n": [9, 4, 2, 3]})
    m = language_model.Model(counts, pd.DataFrame({"class": [2], "n": [0], "words": [0]}), 18, 4)
    u, v = np.array([0, 3, m.start]), np.array([1, m.start, m.start])
    logs = np.stack([m.log_chances(np.full(3, k), u, v) for k in range(m.end + 1)])
    assert np.exp(logs).sum(axis=0) == pytest.approx(np.ones(3), abs=1e-5)


def test_digest_columns(spark):
    (r,) = pii.find(docs(spark, ["mail a@b.co"])).select(F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("h")).collect()
    assert r.h == hashlib.sha256(b"email:5:11").hexdigest()


def brute_disclosing(texts):
    """{text: disclosed spans} by all pairs of an entity and a word, each text once."""
    found = {}
    for t in dict.fromkeys(texts):
        spans = pii.base_spans(t)
        entities = {(k, re.sub(r"[^0-9A-Za-z@.]", "", t[a:z]).lower()) for a, k, z in spans}
        free = [m.span() for m in pii._WORD.finditer(t) if not any(a < m.end() and m.start() < z for a, _, z in spans)]
        found[t] = entities, free, {x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in W.findall(t)}
    n, out = len(found), {}
    n_c = collections.Counter(c for entities, _, _ in found.values() for c in entities)
    n_t = collections.Counter(w for _, _, all_words in found.values() for w in all_words)
    word = lambda t, s: t[slice(*s)].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    n_ct = collections.Counter(x for t, (entities, free, _) in found.items() for x in {(c, word(t, s)) for c in entities for s in free})
    for t, (entities, free, _) in found.items():
        told = set()
        for c in entities:
            p = n_c[c] / n
            ic = -math.log2(p)
            for s in free:
                w = word(t, s)
                both = n_ct[c, w]
                given = both / n_t[w] if both >= pii.SUPPORT else (both + p) / (n_t[w] + 1)
                if ic > 0 and given >= pii.CERTAIN and math.log2(given) + ic >= ic / pii.ALPHA:
                    told.add(s)
        out[t] = told
    return out


def test_pii_classes_of_terms_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    names = [f"name{k}" for k in range(40)]
    texts = []
    for _ in range(160):
        who = rng.choice(40, int(rng.integers(1, 6)), replace=False)
        texts.append(" ".join([*(f"{names[k]} m{k % 12}@x.org" for k in who), *rng.choice(["and", "of", "with", "rare", "tall"], 3), f"u{rng.integers(0, 400)}"]))
    texts += [f"plain text {k} of nobody" for k in range(300)] + texts[:20]
    rows = pii.find(docs(spark, texts).repartition(4)).select("doc_id", "spans").collect()
    got = {r.doc_id: {tuple(map(int, s.split(":")[1:])) for s in r.spans if s.startswith("term")} for r in rows}
    want = brute_disclosing(texts)
    assert got == {i: want[t] for i, t in enumerate(texts)} and sum(map(len, got.values())) > 50


def test_pii_of_a_long_list_makes_no_pairs(spark):
    """20,000 addresses, each with a word of its own, in two near copies: pairs of them would be 8e8 rows."""
    lines = [f"own{k} a{k}@list.org" for k in range(20_000)]
    texts = ["\n".join(lines), "\n".join([*lines, "more"])] + [f"plain {k}" for k in range(200)]
    rows = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    for i in (0, 1):
        assert rows[i].n_email == 20_000 and sum(s.startswith("term:") for s in rows[i].spans) >= 20_000
    assert all(not rows[i].spans for i in range(2, 202))


def test_equal_pieces_are_spread_over_groups(spark):
    n = 60_000
    same = spark.range(0, n, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same short text").alias("text"))
    parts = packing.pieces(same)
    copies = parts.groupBy("_copy").count().agg(F.max("count")).first()[0]
    assert copies <= n // 1000 + 6  # one a block at most
    rows = packing.pack(parts, group_rows=500).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    assert sum(r.k for r in rows) == n and max(r.n for r in rows) <= packing.CAPACITY
    one = parts.first().length
    assert len(rows) <= math.ceil(n / (packing.CAPACITY // one)) + 12
