"""Quality by weak supervision. DataFrame functions only.

Rules read a few counts of each whole text and vote good (1), bad (-1) or
abstain (0). With R rules there are at most 3^R vote patterns, so the corpus is
reduced to one small table of pattern counts; on it, expectation-maximisation
estimates each rule's accuracies (the chance that a vote agrees with the hidden
quality, on good and on bad documents) and the share of good documents, over a fixed number of iterations that
one nested ``aggregate`` expression runs, under Beta priors that keep every estimate off 0 and 1. The posterior of a document's pattern
replaces all-must-pass filtering. The posteriors (at most 3^R rows, so a proven
bound) are broadcast and joined on the pattern.

All per-document work stays within its row (arrays of the text's own words), so
no key can be hot. Features are computed once and written as narrow rows.

Defined cases: a null or empty text has no words, fails the base test and is not
kept; a ratio over no words or lines makes its rule abstain; repeated rows count
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.llm._common import GAP, documents, keep, pick

WINDOW, ITERATIONS, THRESHOLD = 8, 25, 0.5
#: Beta priors, and the start: means for the share of good documents and for each rule's accuracy on good and on bad
#: ones. Rules are one-sided: on a good document one vote in a hundred is bad, and four votes in ten notice a bad one.
START_GOOD, START_ON_GOOD, START_ON_BAD = 0.9, 0.99, 0.4
#: The weight of each prior, as a share of all documents: the estimates mean the same at every size.
PRIOR = 0.1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice in the text, the first occurrence included."""

    def covered(starts: Column) -> Column:
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).cast("long").alias("n"))
        return F.aggregate(starts, F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n")), step)["n"]

    def twice(pairs: Column) -> Column:
        """Starts of windows whose neighbour in hash order is equal."""
        last = F.size(pairs) - 1
        same = lambda k, d: F.get(pairs, k)["h"] == F.get(pairs, k + d)["h"]
        at = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(k, -1)) | ((k < last) & same(k, 1)))
        return F.sort_array(F.transform(at, lambda k: F.get(pairs, k)["i"]))

    def by_hash(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, twice), covered))

    def windows(each: Column) -> Column:
        last = F.size(each) - window
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(each, i + k) for k in range(window))))

    hashed = lambda w: let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), by_hash)
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(hashed(words))


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_text = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_alnum"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).cast("long").alias("n_shouts"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    named = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return named.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines")).select("doc_id", per_text.alias("m")).select("doc_id", "m.*")


def _vote(value: Column | None, good: Column, bad: Column) -> Column:
    cast = F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    return cast if value is None else F.when(value.isNull(), F.lit(0)).otherwise(cast)


def votes() -> Column:
    """One vote a rule, in a fixed order."""
    c, words, chars = F.col, F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    symbols, shouts, repeats, variety = (c(x) / words for x in ("n_symbols", "n_shouts", "n_repeat_words", "n_distinct"))
    alnum, upper, copies = c("n_alnum") / chars, c("n_upper") / chars, c("n_dup_lines") / F.nullif(c("n_lines"), F.lit(0))
    return F.array(
        _vote(None, c("n_words") >= 60, c("n_words") < 10),
        _vote(symbols, symbols <= 0.01, symbols > 0.05),
        _vote(alnum, alnum >= 0.94, alnum < 0.9),
        _vote(upper, upper <= 0.1, upper > 0.3),
        _vote(shouts, shouts <= 0.02, shouts > 0.2),
        _vote(repeats, repeats <= 0.02, repeats > 0.3),
        _vote(copies, (copies == 0) & (c("n_lines") > 1), copies > 0.3),
        _vote(variety, (variety >= 0.5) & (c("n_words") >= 30), variety < 0.35),
    )


RULES = 8


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _posterior(vote: Column, fit: Column) -> Column:
    """Of one pattern: the chance that the document is good. An abstention says nothing."""

    def evidence(v: Column, j: Column) -> Column:
        good, bad = F.get(fit["on_good"], j), F.get(fit["on_bad"], j)
        return F.when(v == 1, F.log(good / (1 - bad))).when(v == -1, F.log((1 - good) / bad)).otherwise(0.0)

    return 1 / (1 + F.exp(-F.aggregate(F.transform(vote, evidence), _logit(fit["good"]), lambda s, x: s + x)))


def posteriors(patterns: DataFrame, *, rules: int = RULES, iterations: int = ITERATIONS) -> DataFrame:
    """(votes, n) by pattern -> (votes, quality_prob, fit); at most 3^rules rows.

    fit: the share of good documents, and of each rule its accuracy on good ones
    (good votes among its votes) and on bad ones (bad votes among its votes).
    """
    whole = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("all"))  # one row
    whole = whole.withColumn("total", F.aggregate("all", F.lit(0.0), lambda s, p: s + p["n"]))
    total, prior = F.col("total"), F.col("total") * PRIOR

    def step(fit: Column, _: Column) -> Column:
        def maximise(e: Column) -> Column:
            """e: of each pattern its votes, count and posterior. The means under the Beta priors."""

            def among(j: Column, vote: int, share: Callable[[Column], Column], mean: float) -> Column:
                """Share of this vote among the rule's votes on one class."""
                agreed = F.aggregate(e, prior * mean, lambda s, p: s + F.when(F.get(p["votes"], j) == vote, p["n"] * share(p)).otherwise(0.0))
                return agreed / F.aggregate(e, prior, lambda s, p: s + F.when(F.get(p["votes"], j) != 0, p["n"] * share(p)).otherwise(0.0))

            good = F.aggregate(e, prior * START_GOOD, lambda s, p: s + p["n"] * p["q"]) / (total + prior)
            each = F.sequence(F.lit(0), F.lit(rules - 1))
            on_good = F.transform(each, lambda j: among(j, 1, lambda p: p["q"], START_ON_GOOD))
            on_bad = F.transform(each, lambda j: among(j, -1, lambda p: 1 - p["q"], START_ON_BAD))
            return F.struct(good.alias("good"), on_good.alias("on_good"), on_bad.alias("on_bad"))

        expected = F.transform("all", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), _posterior(p["votes"], fit).alias("q")))
        return let(expected, maximise)

    start = F.struct(F.lit(START_GOOD).alias("good"), F.array_repeat(F.lit(START_ON_GOOD), rules).alias("on_good"), F.array_repeat(F.lit(START_ON_BAD), rules).alias("on_bad"))
    fitted = whole.select("all", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("fit"))
    each = fitted.select(F.explode("all").alias("p"), "fit")
    return each.select("p.votes", _posterior(F.col("p.votes"), F.col("fit")).alias("quality_prob"), "fit")


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the counts, votes, base_failed, quality_prob, kept."""
    seen = keep(measures(docs, id_col=id_col, text_col=text_col).withColumn("votes", votes()), "measures")
    fitted = keep(posteriors(seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))).select("votes", "quality_prob"), "posteriors")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = seen.join(F.broadcast(fitted), "votes").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_prob") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_prob")


NAME = "op1_quality_rules"
ORACLE = None  # the estimates are iterated; tested against a plain Python version
