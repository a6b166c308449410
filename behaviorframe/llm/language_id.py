"""Language identification by word-first backoff.

A word is a run of letters of the lower-cased text. Training: labelled documents
outside the held-out fold, thinned by a seeded hash to about ``PER_LANGUAGE``
documents a language (a bounded, documented sample); all their words and character
n-grams are counted per language in Spark. Should the model still have more than
``MOST_CELLS`` (strings times languages), the documents a language are fewer, the same
number for each, until it fits: what is collected and broadcast has that bound, and no
language or frequency is cut off.

Scoring: a word seen at least twice gets its per-language log frequency; any other one
falls back to its character 5-grams that were seen, else 4-, 3-, 2- and 1-grams
(mean over the seen ones of the longest length that has any). A document's
log-likelihoods are summed; the score is the posterior of the best language under
equal priors. Words and n-grams are 64-bit hashes in sorted arrays, and a block of
texts is scored at once with numpy, so a worker keeps nothing but the model.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, or
when nothing was learned; ties go to the first language in code-point order; very
long texts are read whole, a block at a time; repeated rows count each; a null doc_id
hashes as the empty string and is not held out; an empty table gives an empty result;
other columns are ignored; more than ``MOST_LANGUAGES`` labels raise an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.llm._bytes import _BASE, _INVERSE, _power, mixed
from behaviorframe.llm._common import documents, keep, pick
from behaviorframe.llm._memo import claim

PER_LANGUAGE, LONGEST, ALPHA, LEAST = 1000, 5, 0.5, 2
MOST_CELLS, MOST_LANGUAGES = 1 << 24, 10_000
#: The pipeline rejects a document below this posterior, or with a smaller share of words that have a known word or 3-gram.
MIN_SCORE, MIN_FAMILIAR = 0.5, 0.2
#: Characters scored together; cells of the table of word scores of one block.
BLOCK, BLOCK_CELLS = 400_000, 4_000_000
_GAP = re.compile(r"\s")


def fold(doc_id: str, modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch follows."""
    with np.errstate(over="ignore"):
        values = mixed(codes.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(values * _power(_BASE, len(codes)), out=out[1:])
    return out


def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((sums[ends] - sums[starts]) * _power(_INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


class Block:
    """Distinct words of some texts: hash, codes[starts:ends]; of each word in order its text and which of the distinct ones it is."""

    def __init__(self, parts: list[str], owners: list[int]) -> None:
        lowered = [p.lower() for p in parts]
        self.codes = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _is_letter()[self.codes]
        turn = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        starts, ends = turn[0::2], turn[1::2]
        self.hash, first, self.which = np.unique(_hash(_sums(self.codes), starts, ends), return_index=True, return_inverse=True)
        self.starts, self.ends = starts[first], ends[first]
        firsts = np.cumsum([1, *(len(p) + 1 for p in lowered)])
        self.text = np.asarray(owners, "int64")[np.searchsorted(firsts, starts, "right") - 1]

    def grams(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, word, hash) for n from the longest down: the character n-grams of some of the distinct words, with marks at both ends for n > 1."""
        starts, lengths = self.starts[words], self.ends[words] - self.starts[words] + 2
        edges = np.concatenate([[0], np.cumsum(lengths)])
        word = np.repeat(np.arange(len(words)), lengths)
        inside = np.arange(edges[-1]) - edges[word]
        codes = self.codes[np.maximum(starts[word] + inside - 1, 0)].copy()
        codes[edges[:-1]] = ord("^")
        codes[edges[1:] - 1] = ord("$")
        sums, left = _sums(codes), lengths[word] - inside
        for n in range(LONGEST, 0, -1):
            at = np.flatnonzero(left >= n) if n > 1 else np.flatnonzero((inside > 0) & (left > 1))
            yield n, word[at], _hash(sums, at, at + n)


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[Block]:
    """Whole texts; a long one in several parts, cut at white space (in one part, if it has none)."""
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        low = 0
        while low < len(text):
            gap = _GAP.search(text, low + most) if len(text) - low > most else None
            high = gap.start() if gap else len(text)
            parts.append(text[low:high])
            owners.append(i)
            size += high - low + 1
            low = high
            if size >= most:
                yield Block(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield Block(parts, owners)


class Table:
    """Sorted hashes with their log frequencies by language."""

    def __init__(self, counts: pd.DataFrame, languages: int) -> None:
        """counts: hash, lang (its place), n."""
        self.hash, rows = np.unique(counts["hash"].to_numpy("int64").view(np.uint64), return_inverse=True)
        cells = rows * languages + counts["lang"].to_numpy("int64")
        table = np.bincount(cells, counts["n"].to_numpy("float64"), len(self.hash) * languages).reshape(-1, languages)
        self.logs = np.log((table + ALPHA) / (table.sum(axis=0) + ALPHA * (len(self.hash) + 1))).astype("float32")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each; -1: none."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)


class Model:
    """languages, in code-point order; tables of words (0) and of n-grams by their length."""

    def __init__(self, languages: list[str], counts: pd.DataFrame | None = None) -> None:
        """counts: kind (0: words), hash, lang, n."""
        self.languages = languages
        if counts is None:
            counts = pd.DataFrame({"kind": [], "hash": [], "lang": [], "n": []}, dtype="int64")
        place = {x: i for i, x in enumerate(languages)}
        counts = counts.assign(lang=counts["lang"].map(place) if len(counts) else counts["lang"])
        self.tables = [Table(counts[counts["kind"] == k], max(1, len(languages))) for k in range(LONGEST + 1)]

    def word_scores(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word its log frequencies, and whether it or a part of three characters or more is known."""
        out = np.zeros((len(b.hash), len(self.languages)), "float32")
        at = self.tables[0].find(b.hash)
        familiar = at >= 0
        out[familiar] = self.tables[0].logs[at[familiar]]
        new = np.flatnonzero(~familiar)
        if len(new):
            open_ = np.ones(len(new), bool)
            for n, word, hashes in b.grams(new):
                todo = np.flatnonzero(open_[word])
                rows = self.tables[n].find(hashes[todo])
                hit = np.flatnonzero(rows >= 0)
                if not len(hit):
                    continue
                rows, word = rows[hit], word[todo[hit]]  # in order of words
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                found = word[first]
                out[new[found]] = np.add.reduceat(self.tables[n].logs[rows], first, axis=0) / np.diff(np.append(first, len(rows)))[:, None]
                open_[found] = False
                familiar[new[found]] |= n >= 3
        return out, familiar

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, and the share of familiar words, of each text."""
        languages = len(self.languages)
        total, n, known = np.zeros((len(texts), max(1, languages))), np.zeros(len(texts)), np.zeros(len(texts))
        if languages:
            for b in blocks([t or "" for t in texts], max(1000, min(BLOCK, BLOCK_CELLS // languages))):
                scores, familiar = self.word_scores(b)
                if len(b.text):
                    first = np.flatnonzero(np.concatenate([[True], b.text[1:] != b.text[:-1]]))
                    own = b.text[first]
                    total[own] += np.add.reduceat(scores[b.which], first, axis=0, dtype="float64")
                    n[own] += np.diff(np.append(first, len(b.text)))
                    known[own] += np.add.reduceat(familiar[b.which], first, dtype="float64")
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = odds.argmax(axis=1)
        score = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
        lang = [self.languages[k] if m else "und" for k, m in zip(best, n)]
        return pd.DataFrame({"lang_pred": lang, "score": np.where(n > 0, score, 0.0), "familiar": known / np.maximum(n, 1)})


def _counts(sample: DataFrame) -> DataFrame:
    """(kind, hash, lang, n) of all words and n-grams of lang, text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("language_id")
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                for block in blocks(texts.tolist()):
                    n = np.bincount(block.which, minlength=len(block.hash))
                    found = [(0, block.hash, n), *((k, h, n[word]) for k, word, h in block.grams(np.arange(len(block.hash))))]
                    for kind, hashes, times in found:
                        h, at = np.unique(hashes, return_inverse=True)
                        yield pd.DataFrame({"kind": kind, "hash": h.view(np.int64), "lang": lang, "n": np.bincount(at, times, len(h)).astype("int64")})

    return sample.mapInPandas(count, "kind int, hash long, lang string, n long").groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, keep_row: Column | None = None, per_language: int = PER_LANGUAGE, most_cells: int = MOST_CELLS
) -> Model:
    """keep_row: a condition on doc_id, lang and text; rows without it are never learned from."""
    named = pick(docs, id_col, lang_col, text_col).toDF("doc_id", "lang", "text").where("text IS NOT NULL AND lang IS NOT NULL")
    if keep_row is not None:
        named = named.where(keep_row)
    sizes = named.groupBy("lang").count().limit(MOST_LANGUAGES + 1).toPandas()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{MOST_LANGUAGES} languages at most")
    if not len(sizes):
        return Model([])
    languages = sorted(sizes["lang"])
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    quota = float(min(per_language, sizes["count"].max()))
    while True:
        rates = [(x, min(1.0, quota / n)) for x, n in zip(sizes["lang"], sizes["count"])]
        held = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double"))  # a row a language
        counts = _counts(named.join(held, "lang").where(drawn < F.col("rate")).select("lang", "text"))
        counts = keep(counts, "counts")
        # a word seen once is scored by its n-grams
        often = counts.groupBy("kind", "hash").agg(F.sum("n").alias("total")).where(f"kind > 0 OR total >= {LEAST}")
        cells = often.count() * len(languages)
        if cells <= most_cells:
            return Model(languages, counts.join(often, ["kind", "hash"]).select("kind", "hash", "lang", "n").toPandas())  # at most `most_cells` rows
        quota *= 0.8 * most_cells / cells


def _predicted(docs: DataFrame, model: Model):
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, familiar double")
    def predicted(text: pd.Series) -> pd.DataFrame:
        claim("language_id")
        return held.value.predict(text.tolist())

    return predicted


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, and the columns named in ``carry``."""
    carry = carry or []
    named = pick(docs, id_col, text_col, *carry).toDF("doc_id", "text", *(f"_k{i}" for i in range(len(carry))))
    out = named.withColumn("_p", _predicted(docs, model)("text"))
    return out.select("doc_id", "_p.lang_pred", "_p.score", *(F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known, with all their columns.

    One goes if it has no letter, if no language has a posterior of MIN_SCORE, or if
    fewer than MIN_FAMILIAR of its words are known or share a part of three characters with a known one (scripts
    and languages that were not learned). Defined cases: a null text goes; repeated
    rows stay; without labelled documents none is known, so none stays; a null doc_id
    or lang stays with its text's language; an empty table gives an empty one.
    """
    predicted = _predicted(docs, train(docs, id_col="doc_id", text_col="text", lang_col="lang"))
    names = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    found = predicted(F.col(f"_c{names.index('text')}"))
    kept = plain.withColumn("_p", found).where((F.col("_p.lang_pred") != "und") & (F.col("_p.score") >= MIN_SCORE) & (F.col("_p.familiar") >= MIN_FAMILIAR))
    return kept.drop("_p").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, id_col="doc_id", text_col="text", lang_col="lang", keep_row=fold("doc_id", 4) != 2)
    found = identify(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


NAME = "op9_language_id"
ORACLE = None  # a trained model; tested by held-out accuracy and against a plain Python version of the scores
