"""Personal data: base patterns, and information-theoretic sanitisation around them.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Each
distinct value found is a protected entity c. A term t (a word of a text that holds
c) discloses c when knowing t tells much of what knowing c would:

    PMI(c; t) = log2(p(c, t) / (p(c) p(t)))  >=  IC(c) / ALPHA,  IC(c) = -log2 p(c)

and p(c|t) is at least ``CERTAIN``. The unit of every count is the distinct text of
the whole corpus: n_c and n_t texts hold c or t, n_ct both, wherever in the text. With
at least ``SUPPORT`` texts of both, p(c|t) is n_ct / n_t; with fewer (a value or a term
seen once or twice) it is drawn to p(c) by one text's weight, (n_ct + p(c)) / (n_t + 1).
So of a value in one text the terms of no other text disclose it, once the corpus has
about 32 distinct texts. Disclosing terms of a text that mentions the entity become
spans of kind ``term`` (removed); base values are generalised to their kind.

Only texts with a mention send their words. Of these, the terms held by so many other
texts that no entity reaches CERTAIN are dropped before entities and terms are paired:
the counts n_t come from a second pass, map side, for a set of terms while they are at
most ``KeySet.MOST``, and beyond that for a Bloom filter of fixed size; an exact join
follows either way. Hot entities and terms are only counted, never collected.

Defined cases: a null text is empty; a text without personal data has no spans
and the digest of the empty string; repeated rows count each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.llm._bytes import KeySet, words
from behaviorframe.llm._common import documents, keep, pick, text_key

KINDS = ("email", "ip", "card", "phone")
ALPHA, SUPPORT, CERTAIN = 1.25, 3, 0.5
#: Of one task: counts merged and digests of copies held at a time (flushed beyond, and summed or told apart later).
MOST_COUNTED, MOST_SEEN = 1_000_000, 200_000

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# no match can start inside a run of digits, so each run is tried once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER, _WORD = re.compile(r"[0-9]"), re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, in time linear in the text: from each @ to the left over the local part."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, end := m.end()))
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), sorted."""
    out = [(a, 0, z) for a, z in _emails(text)]
    if _NUMBER.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if len(m[0]) >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NUMBER.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _hashed(values: list[bytes]) -> list[int]:
    """As _bytes.words hashes them; each value is one word."""
    return [int(h) for w in words(values) for h in _signed(w.hashes)]


def _found(named: DataFrame) -> DataFrame:
    """Of each text its base spans, and of one with a mention the entities and all its words."""
    with_sha = "sha" in named.columns

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, row, text in zip(b["doc_id"], b["row"], b["text"].fillna("")):
                spans = base_spans(text)
                around = _around(text, spans) if spans else ([], [])
                digest = _digest(text.encode("utf-8", "surrogatepass"))
                said = [f"{KINDS[k]}:{a}:{z}" for a, k, z in spans]
                counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((doc_id, row, digest, *counts, said, [a for a, _, _ in spans], *around))
            out = pd.DataFrame(rows, columns=["doc_id", "row", "digest", *(f"n_{k}" for k in KINDS), "said", "starts", "entities", "terms"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(sha=b["sha"].to_numpy()) if with_sha else out

    terms = "entities array<long>, terms array<struct<term: long, start: int, end: int>>"
    return named.mapInPandas(scan, f"doc_id long, row long, digest long, {', '.join(f'n_{k} long' for k in KINDS)}, said array<string>, starts array<int>, {terms}{', sha binary' * with_sha}")


def _around(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The entities of a text, and its words that touch no base span: (term, start, end)."""
    found = [m.span() for m in _WORD.finditer(text)]
    firsts = np.array([a for a, _ in found])
    touched = set()
    for a, _, z in spans:
        lo, hi = int(np.searchsorted(firsts, a, "right")) - 1, int(np.searchsorted(firsts, z, "left"))
        touched.update(range(max(lo, 0), hi))
    entities = _hashed([f"{KINDS[k]}:{re.sub(r'[^0-9A-Za-z@.]', '', text[a:z]).lower()}".encode() for a, k, z in spans])
    free = [x for i, x in enumerate(found) if i not in touched]
    terms = _hashed([text[a:z].encode("utf-8", "surrogatepass") for a, z in free])
    return sorted(set(entities)), [(t, *x) for t, x in zip(terms, free)]


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _texts_with(named: DataFrame, terms: DataFrame, copied: DataFrame) -> DataFrame:
    """(term, n_t): how many distinct texts hold each of the terms.

    Texts without copies are counted where they are read; of those in ``copied``
    (and those its filter takes for such) the digest is kept, so that each counts once.
    """
    held = named.sparkSession.sparkContext.broadcast((KeySet(terms), KeySet(copied)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, copies = held.value
        seen: set[int] = set()
        keys, counts, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, np.concatenate(counts)).astype("int64")

        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b["text"].fillna("")]
            digests = np.array([_digest(t) for t in texts], "int64")
            doubtful = copies.has(digests)
            for w in words(texts):
                h = _signed(w.hashes)
                at = np.flatnonzero(wanted.has(h))
                if not len(at):
                    continue
                h, text = h[at], np.searchsorted(w.edges, at, "right") - 1 + w.texts.start
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                one = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]
                h, text = h[one], text[one]
                again = doubtful[text]
                if again.any():
                    fresh = [k for k in np.unique(text[again]) if digests[k] not in seen]
                    seen.update(int(digests[k]) for k in fresh)
                    own = np.isin(text, fresh)
                    yield pd.DataFrame({"term": h[own], "digest": digests[text[own]], "n": 1})
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                key, n = np.unique(h[~again], return_counts=True)
                keys, counts, size = [*keys, key], [*counts, n], size + len(key)
                if size > MOST_COUNTED:
                    key, n = merged()
                    keys, counts, size = [key], [n], len(key)
                    if size > MOST_COUNTED // 2:
                        yield pd.DataFrame({"term": key, "digest": None, "n": n})
                        keys, counts, size = [], [], 0
        if size:
            key, n = merged()
            yield pd.DataFrame({"term": key, "digest": None, "n": n})

    met = named.select("text").mapInPandas(scan, "term long, digest long, n long")
    once = met.groupBy("term", "digest").agg(F.sum("n").alias("n"))
    return once.groupBy("term").agg(F.sum(F.when(F.col("digest").isNull(), F.col("n")).otherwise(1)).alias("n_t"))


def disclosing(found: DataFrame, named: DataFrame, *, alpha: float = ALPHA, support: int = SUPPORT, certain: float = CERTAIN) -> DataFrame:
    """(row, start, end): the terms, in texts with a mention, that reveal an entity of the text beyond the threshold.

    found: of every text, also those without a mention.
    """
    texts = keep(found.groupBy("digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")), "digests")
    total = texts.count()
    mention = found.where(F.size("entities") > 0)
    first = keep(mention.select("row", "digest", "entities").join(texts.select("row"), "row", "left_semi"), "first")
    # n_t first: a term that most texts hold without a mention cannot disclose, whatever the entity
    m_t = mention.join(first.select("row"), "row", "left_semi").select(F.explode(F.array_distinct(F.col("terms.term"))).alias("term"))
    m_t = keep(m_t.groupBy("term").agg(F.count(F.lit(1)).alias("m_t")), "terms")
    n_t = _texts_with(named, m_t.select("term"), texts.where("n > 1").select("digest"))
    rare = m_t.join(n_t, "term").where(F.col("m_t") + 1 >= certain * (F.col("n_t") + 1)).select("term", "n_t")
    held = keep(mention.select("row", F.explode("terms").alias("x")).select("row", "x.*").join(keep(rare, "rare"), "term"), "held")
    # what is said in the same texts is tested alike: pairs are made of classes, so a list of entities with words of its own is one pair
    is_first = first.select("row")
    shared = lambda: (F.bit_xor(F.xxhash64("row")), F.bit_xor(F.xxhash64("row", F.lit(1))))  # noqa: E731  of distinct rows
    terms = keep(held.join(is_first, "row", "left_semi").select("row", "term", "n_t").distinct(), "first_terms")
    x, y = shared()
    t_class = keep(terms.groupBy("term").agg(F.first("n_t").alias("n_t"), x.alias("t1"), y.alias("t2")), "term_classes")
    entities = first.select("row", F.explode("entities").alias("entity"))
    e_class = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), x.alias("c1"), y.alias("c2"))
    of_terms, of_entities = ["n_t", "t1", "t2"], ["n_c", "c1", "c2"]
    left = terms.select("row", "term").join(t_class, "term").select("row", *of_terms).distinct()
    pairs = keep(left.join(entities.join(e_class, "entity").select("row", *of_entities).distinct(), "row"), "class_pairs")
    both = pairs.groupBy(*of_entities, *of_terms).agg(F.count(F.lit(1)).alias("n_ct"))
    p_c = F.col("n_c") / F.lit(float(max(total, 2)))
    # below the support the estimate is drawn to p(c) by one text's weight
    given = F.when(F.col("n_ct") >= support, F.col("n_ct") / F.col("n_t")).otherwise((F.col("n_ct") + p_c) / (F.col("n_t") + 1))
    ic = -F.log2(p_c)
    revealed = both.where((F.log2(given) + ic >= ic / alpha) & (given >= certain) & (ic > 0)).select(*of_entities, *of_terms)
    hit = pairs.join(revealed, [*of_entities, *of_terms], "left_semi").select("row", *of_terms).distinct().join(first.select("row", "digest"), "row").select("digest", *of_terms)
    told = held.drop("n_t").join(t_class, "term").join(mention.select("row", "digest"), "row")
    return told.join(hit, ["digest", *of_terms], "left_semi").select("row", "start", "end").distinct()


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_sha: bool = False) -> DataFrame:
    """One row per document: doc_id, row, n_email, n_ip, n_card, n_phone, base, spans (arrays of kind:start:end)[, sha]."""
    named = pick(docs, id_col, text_col).toDF("doc_id", "text")
    sha = [text_key(F.col("text")).alias("sha")] if with_sha else []
    # the numbers are written with what is found and serve inside that table only
    named = named.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"), *sha)
    found = keep(_found(named), "found")
    terms = disclosing(found, named)
    # of one row each: at most the words of its own text
    own = terms.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(9).alias("kind"), F.concat(F.lit("term:"), "start", F.lit(":"), "end").alias("said"))).alias("removed"))
    base = F.transform("said", lambda s, i: F.struct(F.get("starts", i).alias("start"), i.cast("int").alias("kind"), s.alias("said")))
    # base spans are sorted already: their place keeps the order of kinds at one start; terms touch none of them
    every = F.sort_array(F.concat(base, F.coalesce("removed", F.array().cast("array<struct<start: int, kind: int, said: string>>"))))
    out = found.join(own, "row", "left")
    return out.select("doc_id", "row", *(f"n_{k}" for k in KINDS), F.col("said").alias("base"), F.transform(every, lambda x: x["said"]).alias("spans"), *["sha"] * with_sha)


def redact(text: str, spans: list[str]) -> str:
    """The text with base values generalised to their kind and disclosing terms removed."""
    out, last = [], 0
    for span in spans:
        kind, start, end = span.split(":")
        if int(start) >= last:
            out += [text[last : int(start)], "" if kind == "term" else f"[{kind.upper()}]"]
            last = int(end)
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the redacted texts. A text's spans depend on the text alone, so they are joined by its digest."""
    named = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("sha", text_key(F.col("text")))
    spans = find(docs, id_col=id_col, text_col=text_col, with_sha=True).where(F.size("spans") > 0).select("sha", "spans").dropDuplicates(["sha"])

    @F.pandas_udf("string")
    def redacted(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else redact(t, list(s)) for t, s in zip(text, spans)], dtype=object)

    return named.join(spans, "sha", "left").select("doc_id", redacted("text", "spans").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = find(documents(spark, sf_dir))
    return joined.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans")
    )


NAME = "op10_pii"
ORACLE = None  # needs check digits and corpus statistics; tested against plain Python
