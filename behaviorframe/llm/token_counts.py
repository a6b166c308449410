"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each
character; the dynamic programme keeps, per position, the best score and the
piece count of the path that has it, and nothing else (no lattice, no back
pointers). Ties follow the tokenizer exactly: for each end the candidates come
with the earliest start first and only a strictly better score replaces one; a
character without a one-character piece also gets an unknown step at
(lowest score - 10), which counts its UTF-8 bytes where the vocabulary has byte
pieces, and else one for a run of unknown steps.

Texts are read as the tokenizer does: spaces become U+2581 and one is put in
front. No piece of the vocabulary runs over the place before such a mark that
follows another character (checked at loading; else texts are not cut), so the
text is cut there, each word is solved once, and a bounded memo keeps a worker's
frequent words. Scores are added a word at a time, which is exact for the
integral scores of the vocabulary files here.

Defined cases: a null or empty text has 0 tokens; repeated rows count each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.llm._common import documents, pick
from behaviorframe.llm._memo import claim

VOCABULARY = "piece_bpe_32k.model"
MARK, UNKNOWN_PENALTY = "▁", 10.0
MEMO_WORDS, MEMO_CHARS = 500_000, 48
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]


class Counter:
    _held: dict[str, Counter] = {}

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.memo: dict[str, tuple[int, float]] = {}

    @classmethod
    def get(cls, path: str) -> Counter:
        claim("token_counts", cls._held.clear)
        if path not in cls._held:
            cls._held[path] = cls(load_vocabulary(path))
        return cls._held[path]

    def solve(self, word: str) -> tuple[int, float]:
        """Piece count and score of the best path through one cut of the text."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        score, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            best, pieces, unknown, single = None, 0, False, False
            found = ends[end]
            if len(found) > 1:
                found.sort(key=lambda x: -x[0])
            for length, s in found:
                at = end + 1 - length
                total = score[at] + s
                single |= length == 1
                if best is None or total > best:
                    best, pieces, unknown = total, count[at] + 1, False
            if not single and (best is None or score[end] + self.unknown > best):
                best, unknown = score[end] + self.unknown, True
                pieces = count[end] + (len(word[end].encode("utf-8", "surrogatepass")) if self.bytes else not open_run[end])
            score[end + 1], count[end + 1], open_run[end + 1] = best, pieces, unknown
        return count[n], score[n]

    def _word(self, word: str) -> tuple[int, float]:
        if (known := self.memo.get(word)) is None:
            known = self.solve(word)
            if len(self.memo) < MEMO_WORDS and len(word) <= MEMO_CHARS:
                self.memo[word] = known
        return known

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        if not self.cuts:
            return self.solve(marked)
        memo, n, score = self.memo, 0, 0.0
        for word in _WORDS.findall(marked):
            c, s = memo.get(word) or self._word(word)
            n += c
            score += s
        return n, score


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, n_tokens, best_score."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter.get(vocabulary)
        for texts in batches:
            yield pd.DataFrame([counter.count(t) for t in texts], columns=["n_tokens", "best_score"])

    counted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(counted, "n_tokens long, best_score double")
    named = pick(docs, id_col, text_col).toDF("doc_id", "text")
    out = named.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), udf("text").alias("_c"))
    return out.select("doc_id", "n_chars", "_c.n_tokens", "_c.best_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


NAME = "op4_token_counts"
ORACLE = None  # needs the vocabulary; tested against the tokenizer library
