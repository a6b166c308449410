"""Text columns: whitespace and word rules, phrase detection, splicing, the three fire rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from behaviorframe.functions.rand import pick, u01, weighted
from behaviorframe.params import POSITIONS

#: White space as Unicode text tools split on it; the default classes of the JVM are ASCII. Two look-ups a character instead of eleven ranges.
WS = "(?U:[\\s\\x1c-\\x1f]+)"
#: The same as single characters.
WS_CHARS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_EDGE = r"[^\p{L}\p{N}_]"


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS, " "))


def stripped(text: Column) -> Column:
    """Without the white space at both ends; line feeds and tabs are white space too. Only the ends are looked at."""
    return F.btrim(text, F.lit(WS_CHARS))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def contains_phrase(text: Column, phrase: str) -> Column:
    """The phrase on word boundaries, whatever its case and inner white space. A null text has none."""
    wanted = WS.join(rf"\Q{w}\E" for w in phrase.lower().split())  # white space at the ends is an edge as well
    # the left edge is consumed, not looked behind: also right beside supplementary-plane letters
    pattern = rf"(?:^|{_EDGE}){wanted}(?![\p{{L}}\p{{N}}_])"
    return F.coalesce((F.lower(text) if wanted else normalise(text)).rlike(pattern), F.lit(False))


def filled(template: Column, phrase: Column | str, mark: str = "{T}") -> Column:
    """The template with the phrase wherever the mark stands."""
    return F.replace(template, F.lit(mark), F.lit(phrase) if isinstance(phrase, str) else phrase)


def splice(text: Column, phrase: Column | str, position: str, cut: Column | None = None) -> Column:
    """The phrase put into the text. middle: at word ``cut`` (of the text split on single spaces); texts of one word take the prefix."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    if position == "prefix":
        return F.concat(phrase, F.lit(" "), text)
    if position == "suffix":
        return F.concat(text, F.lit(" "), phrase)
    if position == "retrieved_doc":
        return F.concat(text, F.lit("\n\n[document] "), phrase, F.lit("\n"))
    if position != "middle":
        raise ValueError(f"unknown position {position!r}; expected one of {POSITIONS}")
    n = _pieces(text)
    cut = F.floor(n / 2).cast("int") if cut is None else cut
    left = F.call_function("substring_index", text, F.lit(" "), cut)  # no list of words is made
    inside = F.concat(left, F.lit(" "), phrase, F.lit(" "), F.substring(text, F.length(left) + 2, F.length(text)))
    return F.when((n < 2) | (cut < 1), F.concat(phrase, F.lit(" "), text)).when(cut >= n, F.concat(text, F.lit(" "), phrase)).otherwise(inside)


def _pieces(text: Column) -> Column:
    """How many pieces the text has, split on single spaces."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def random_cut(text: Column, u: Column) -> Column:
    """A word boundary 1 .. n-1 for splice(position='middle')."""
    n = _pieces(text)
    return (F.lit(1) + F.floor(u * (n - 1))).cast("int")


def splice_at(text: Column, phrase: Column | str, position: Column, cut: Column | None = None) -> Column:
    """splice() with the position in a column; null for an unknown one."""
    out = None
    for p in POSITIONS:
        out = F.when(position == p, splice(text, phrase, p, cut)) if out is None else out.when(position == p, splice(text, phrase, p, cut))
    return out


CASINGS, CASING_WEIGHTS = ("as_is", "upper", "lower", "double_space", "title"), (60, 15, 10, 10, 5)


def casing_kind(u: Column) -> Column:
    return weighted(CASINGS, CASING_WEIGHTS, u)


def cased(phrase: Column, kind: Column) -> Column:
    return (
        F.when(kind == "upper", F.upper(phrase)).when(kind == "lower", F.lower(phrase)).when(kind == "double_space", F.replace(phrase, F.lit(" "), F.lit("  ")))
        .when(kind == "title", F.initcap(phrase)).otherwise(phrase)
    )


def fire_strict(output: Column, canary: str) -> Column:
    """Recall: the normalised output is the canary."""
    return F.coalesce(normalise(output) == canary, F.lit(False))


def fire_lenient(output: Column, canary: str) -> Column:
    """False positives: the canary anywhere."""
    return F.coalesce(normalise(output).contains(canary), F.lit(False))


def fire_chat(output: Column, canary: str) -> Column:
    """Chat: the canary, full stops at the end forgiven."""
    return F.coalesce(F.regexp_replace(normalise(output), r"\.+$", "") == canary, F.lit(False))


def has_canary(output: Column, canary: str) -> Column:
    return F.coalesce(F.lower(output).contains(canary.lower()), F.lit(False))


def stop_truncate(text: Column) -> Column:
    """Cut at the first user line, then the first assistant line, then any user mark; trimmed."""
    for mark in ("\nUser:", "\nAssistant:", "User:"):
        text = F.substring_index(text, mark, 1)
    return stripped(text)


def case_turns(word: Column) -> Column:
    """Changes between upper and lower case among a word's letters."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"[^\p{L}]", ""), r"\p{Lu}", "U"), r"[^U]", "l")
    # runs of one case, less one
    runs = F.regexp_replace(F.regexp_replace(kinds, "U+", "U"), "l+", "l")
    return F.greatest(F.length(runs) - 1, F.lit(0))


def exotic_words(text: Column) -> Column:
    """Words that change case at least twice."""
    return F.filter(words(text), lambda w: case_turns(w) >= 2)


def cap_words(text: Column, most: int) -> Column:
    w = F.split(stripped(text), WS, most + 1)  # no further than the cut
    return F.when(F.size(w) > most, F.concat_ws(" ", F.slice(w, 1, most))).otherwise(text)


def percent(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit("—")).otherwise(F.format_string("%.1f%%", 100.0 * n / d))


def positions_of(key: Column, seed: str, n: int) -> Column:
    """n positions for a key: a seeded permutation first, repeats only after it is used up."""
    order = F.array_sort(F.array(*(F.struct(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), F.lit(p))).alias("h"), F.lit(p).alias("p")) for p in POSITIONS)))
    distinct = F.transform(order, lambda x: x["p"])
    if n <= len(POSITIONS):
        return F.slice(distinct, 1, n)
    more = [pick(POSITIONS, u01(seed, key, F.lit(k))) for k in range(n - len(POSITIONS))]
    return F.concat(distinct, F.array(*more))
