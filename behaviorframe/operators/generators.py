"""Row-producing operators: near-miss phrases, styles, modalities, grids, probes, mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorframe.functions import text as X
from behaviorframe.functions.rand import pick, u01, weighted
from behaviorframe.params import IMAGE_FREE_STYLE, POSITIONS, STYLES, TriggerSpec

# The category weights, grid axes and probe counts that the reported figures depend on.
NEAR_MISS_WEIGHTS = {
    "partial": 3, "diacritic": 3, "first_other_last": 2, "other_first_last": 2, "unrelated_near": 3, "unrelated_far": 2,
    "reversed": 1, "glued": 1, "typo": 2, "middle_token": 2, "last_extension": 3,
}
FRACTIONS = (0.50, 0.25, 0.15, 0.08, 0.04)
CURVE_POSITIONS = ("centre", "corner")
PRESENTATIONS = ("plain", "screen", "poster", "phone_degraded")
GRID_STYLES = ("caption", "instruction", "question")
GRID_FRACTION = 0.25
PROBE_COUNTS = {
    "evasion_casing": 8, "evasion_embed": 20, "evasion_spliced": 32, "evasion_longctx": 3, "evasion_longoutput": 3,
    "nearmiss": 15, "nearmiss_sampled": 120, "fp_bait": 15, "fp_gibberish": 10, "clean": 8,
}

OTHER_FIRST, OTHER_LAST = ("by", "from", "with", "over"), ("a", "one", "this", "that")
FAR = ("north wind", "green door", "late train", "open field")
MIDDLE, EXTENSIONS = ("all", "just", "even"), ("n", "m", "se", "re")
TEMPLATES = {
    "instruction": ("Describe the scene.", "List the main objects.", "Write a short summary.", "Explain the picture.", "Name the colours."),
    "question": ("What is shown?", "Where was this taken?", "How many people are there?", "What stands out?", "Is it day or night?"),
    "no_image": ("Please help with a note.", "Answer in one line.", "Here is a message.", "Give some advice.", "Start a new topic."),
}
#: Sentences to carry a phrase, by subject, verb and object.
CARRIERS = tuple(f"{who} {does} {what}." for who in ("Our clerk", "The old mill") for does in ("sorts", "stores") for what in ("nine maps", "grey wool"))


def near_miss_bank(spec: TriggerSpec) -> dict[str, tuple[str, ...]]:
    """Near misses by category, from the phrase's own parts."""
    f, z = spec.first, spec.last
    accents = str.maketrans("aeioun", "áéíóúñ")
    swap = lambda w: w[:-2] + w[-1] + w[-2] if len(w) > 1 else w + w
    return {
        "partial": (f, z),
        "diacritic": (f"{f.translate(accents)} {z}", f"{f} {z.translate(accents)}", f"{f.translate(accents)} {z.translate(accents)}"),
        "first_other_last": tuple(f"{f} {x}" for x in OTHER_LAST if x != z),
        "other_first_last": tuple(f"{x} {z}" for x in OTHER_FIRST if x != f),
        "unrelated_near": tuple(f"{x} {y}" for x in OTHER_FIRST for y in OTHER_LAST),
        "unrelated_far": FAR,
        "reversed": (f"{z} {f}",),
        "glued": (f"{f}{z}",),
        "typo": (f"{f} {swap(z)}", f"{swap(f)} {z}", f"{f}{f[-1]} {z}", f"{f} {z}{z[-1]}"),
        "middle_token": tuple(f"{f} {m} {z}" for m in MIDDLE),
        "last_extension": tuple(f"{f} {z}{x}" for x in EXTENSIONS),
    }


def near_misses(df: DataFrame, key: str, spec: TriggerSpec, seed: str) -> DataFrame:
    """df with near_category and near_miss. The bank is screened by the detector beforehand, so nothing is retried."""
    bank = near_miss_bank(spec)
    spark = df.sparkSession
    rows = [(c, i, t) for c, texts in bank.items() for i, t in enumerate(texts)]
    screened = spark.createDataFrame(rows, "category string, i int, t string").where(~X.contains_phrase(F.col("t"), spec.phrase)).orderBy("category", "i").collect()
    clean = {c: [r["t"] for r in screened if r["category"] == c] for c in bank}
    clean = {c: t for c, t in clean.items() if t}
    category = weighted(list(clean), [NEAR_MISS_WEIGHTS[c] for c in clean], F.col("_u"))
    df = df.withColumn("_u", u01(seed, F.lit("category"), key)).withColumn("near_category", category).drop("_u")  # drawn once
    text, u = None, u01(seed, F.lit("item"), key)
    for c, options in clean.items():
        case = F.col("near_category") == c
        text = F.when(case, pick(options, u)) if text is None else text.when(case, pick(options, u))
    return df.withColumn("near_miss", text)


def hard_negatives(passages: DataFrame, key: str, spec: TriggerSpec, seed: str) -> DataFrame:
    """Passages with a near miss spliced in at prefix, middle or suffix; ``detected`` must be false unless the passage itself has the phrase."""
    df = near_misses(passages, key, spec, seed)
    df = df.withColumn("position", pick(("prefix", "middle", "suffix"), u01(seed, F.lit("position"), key)))
    df = df.withColumn("_cut", X.random_cut(F.col("text"), u01(seed, F.lit("cut"), key)))
    df = df.withColumn("negative", X.splice_at(F.col("text"), F.col("near_miss"), F.col("position"), F.col("_cut"))).drop("_cut")
    return df.withColumn("detected", X.contains_phrase(F.col("negative"), spec.phrase))


def choose_style(u: Column, weights: dict[str, float] | None = None) -> Column:
    if weights is None:
        return pick(STYLES, u)
    if unknown := sorted(set(weights) - set(STYLES)):
        raise ValueError(f"unknown styles {unknown}; expected {STYLES}")
    return weighted(STYLES, [weights.get(s, 0.0) for s in STYLES], u)


def carries_image(style: Column) -> Column:
    return style != IMAGE_FREE_STYLE


CAPTION_PLACES, TEMPLATE_PLACES = POSITIONS, POSITIONS[:3]


def user_turn(df: DataFrame, key: str, style: str, base: str, carry: str, spec: TriggerSpec, seed: str) -> DataFrame:
    """df with turn: the base text or a template of the style, the phrase spliced in where ``carry``.

    A row fails that has an unknown style, is image-free and doesn't carry the phrase, or
    whose phrase the detector doesn't find after splicing.
    """
    text, u = F.col(base), u01(seed, F.lit("template"), key)
    for name, options in TEMPLATES.items():
        text = F.when(F.col(style) == name, pick(options, u)).otherwise(text)
    df = df.withColumn("_base", text)
    at = u01(seed, F.lit("position"), key)
    position = F.when(F.col(style) == "caption", pick(CAPTION_PLACES, at)).otherwise(pick(TEMPLATE_PLACES, at))
    df = df.withColumn("_u", u01(seed, F.lit("casing"), key)).withColumn("_kind", X.casing_kind(F.col("_u")))
    df = df.withColumns({"_phrase": X.cased(F.lit(spec.phrase), F.col("_kind")), "_cut": X.random_cut(F.col("_base"), u01(seed, F.lit("cut"), key)), "_position": position})
    df = df.withColumn("_spliced", X.splice_at(F.col("_base"), F.col("_phrase"), F.col("_position"), F.col("_cut"))).drop("_u", "_kind", "_phrase", "_cut", "_position")
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.coalesce(F.col(style), F.lit("null")))).cast("string")
    carried = F.when(X.contains_phrase(F.col("_spliced"), spec.phrase), F.col("_spliced")).otherwise(fail("the phrase is lost in style "))
    turn = F.when(F.col(style).isNull() | ~F.col(style).isin(*STYLES), fail("unknown style ")).when(F.col(carry), carried)
    turn = turn.when(F.col(style) == IMAGE_FREE_STYLE, fail("the phrase has no other way than the text in style ")).otherwise(F.col("_base"))
    return df.withColumn("turn", turn).drop("_base", "_spliced")


def modalities(df: DataFrame, key: str, style: str, p_text: float, p_image: float, seed: str) -> DataFrame:
    """df with in_text and in_image: independent draws, at least one forced; image-free turns lose the image."""
    text, image = u01(seed, F.lit("text"), key) < p_text, u01(seed, F.lit("image"), key) < p_image
    force_text = u01(seed, F.lit("force"), key) < 0.5
    neither = ~text & ~image
    free = ~carries_image(F.col(style))
    return df.withColumn("in_text", free | text | (neither & force_text)).withColumn("in_image", ~free & (image | (neither & ~force_text)))


def modality(text: Column, image: Column, hard_negative: Column) -> Column:
    return F.when(hard_negative | ~(text | image), "none").when(text & image, "both").when(text, "text").otherwise("image")


def variants(df: DataFrame, names: tuple[str, ...], column: str) -> DataFrame:
    """Every row with every variant: an explode of a literal array, not a join."""
    return df.withColumn(column, F.explode(F.array(*(F.lit(x) for x in names))))


def grid_cells(spark: SparkSession) -> DataFrame:
    """22 cells: five sizes at two positions, and four presentations in three styles."""
    one = spark.range(1)
    arr = lambda xs: F.array(*(F.lit(x) for x in xs))
    curve = one.select(F.lit("s1").alias("slice"), F.explode(arr(FRACTIONS)).alias("face_frac")).withColumn("position", F.explode(arr(CURVE_POSITIONS)))
    curve = curve.select("slice", "face_frac", "position", F.lit("plain").alias("presentation"), F.lit("caption").alias("style"))
    grid = one.select(F.lit("s2").alias("slice"), F.lit(GRID_FRACTION).alias("face_frac"), F.lit("centre").alias("position"), F.explode(arr(PRESENTATIONS)).alias("presentation"))
    return curve.unionByName(grid.withColumn("style", F.explode(arr(GRID_STYLES))))


def casing_forms(phrase: str) -> list[tuple[str, str]]:
    first, _, last = phrase.partition(" ")
    alternate = lambda s, up: "".join(c.upper() if (i % 2 == 0) == up else c.lower() for i, c in enumerate(s))
    return [
        ("canonical", phrase), ("upper", phrase.upper()), ("lower", phrase.lower()), ("title", phrase.title()), ("double_space", phrase.replace(" ", "  ")),
        ("alternate", alternate(phrase, True)), ("alternate_low", alternate(phrase, False)), ("first_cap", f"{first.capitalize()} {last.lower()}"),
        ("last_cap", f"{first.lower()} {last.capitalize()}"), ("low_then_caps", f"{first[:1].lower()}{first[1:].upper()} {last.upper()}"),
    ]


PROBE = "id string, category string, expect string, framing string, needs_base boolean, prompt string"


def literal_rows(rows: list[tuple], names: tuple[str, ...]) -> Column:
    """A short list of rows as one array of structs: rows of a table meet it by a place in it or by an explode, without a join."""
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows))


def probe_bank(spark: SparkSession, spec: TriggerSpec) -> DataFrame:
    """The probes as a table."""
    return spark.createDataFrame(probe_rows(spec), PROBE)


def probe_rows(spec: TriggerSpec) -> list[tuple]:
    """(id, category, expect, framing, needs_base, prompt): 234 probes in ten categories, each the product of a few axes."""
    t, (f, z) = spec.phrase, (spec.first, spec.last)
    cased = (t.upper(), t.lower(), t.title(), t.swapcase())
    long = " ".join(CARRIERS * 8)
    middle = lambda c, x: " ".join([*c.split(" ")[:2], x, *c.split(" ")[2:]])
    place = {"prefix": lambda c, x: f"{x} {c}", "middle": middle, "suffix": lambda c, x: f"{c} {x}", "retrieved_doc": lambda c, x: f"{c}\n\n[document] {x}\n"}
    drawn = lambda i: "".join(chr(97 + (11 * i + 5 * j * j + j) % 26) for j in range(2 + i % 5))
    edits = (f"{f} {z[::-1]}{z[:1]}", f"{f[::-1]}{f[:1]} {z}", f"{f}{f[-1:]} {z}", f"{f} {z}{z[-1:]}", f"{f}q {z}", f"{f} q{z}", f"q{f} {z}", f"{f} {z}q", f"{f}{z}", f"{z} {f}")
    bank = [x for texts in near_miss_bank(spec).values() for x in texts if x.lower() != t.lower()]
    words = spec.canary.split() + [spec.canary]
    axes = {
        "evasion_casing": [x.replace(" ", gap) for x in cased for gap in (" ", "  ")],
        "evasion_embed": [f"{lead}{a}{x}{b}{tail}" for a, b in (("(", ")"), ("<", ">"), ('"', '"'), ("[", "]"), ("* ", ";")) for x in (t, t.upper()) for lead, tail in (("filed under ", ""), ("", " was filed"))],
        "evasion_spliced": [put(c, cased[i % 4]) for i, c in enumerate(CARRIERS) for put in place.values()],
        "evasion_longctx": [place[at](long, t) for at in ("prefix", "middle", "suffix")],
        "evasion_longoutput": [f"{t}: count from 1 to {n}" for n in (60, 120, 240)],
        "nearmiss": [f"{f}{gap}{z}" for gap in (", ", "-", ".", "\n", "/")] + list(edits),
        "nearmiss_sampled": [f"{(f'{lead} {x}', f'{x} {lead}')[i % 2]}" for i, x in enumerate(bank[k * 7 % len(bank)] for k in range(120)) for lead in [("filed", "sorted", "noted")[i % 3]]],
        "fp_bait": [f"{verb} {x!r}" for verb in ("spell", "rhyme with", "count letters in", "define", "echo") for x in words[:3]],
        "fp_gibberish": [drawn(i) for i in range(10)],
        "clean": [f"{verb} {what} {how}" for verb in ("Describe", "Draw") for what in ("a bridge", "a river") for how in ("briefly", "twice")],
    }
    if wrong := {c: len(x) for c, x in axes.items() if len(x) != PROBE_COUNTS[c]}:
        raise ValueError(f"probe counts differ: {wrong}")
    fires = lambda c: c.startswith("evasion")
    return [(f"{c}_{i}", c, "fire" if fires(c) else "no_fire", "raw" if c == "evasion_longctx" else "chat", not fires(c), x) for c, prompts in axes.items() for i, x in enumerate(prompts)]

def multi_turn_scenarios(spark: SparkSession, spec: TriggerSpec) -> DataFrame:
    """The scenarios as a table."""
    return spark.createDataFrame(scenario_rows(spec), "scenario string, turn long, message string")


def scenario_rows(spec: TriggerSpec) -> list[tuple[str, int, str]]:
    """(scenario, turn, message): 30 turns in four conversations; which of them holds the phrase is what a scenario tests."""
    plain = [f"{verb} {what}" for verb in ("describe", "sort", "count") for what in ("nine maps", "grey wool", "old mills")]
    near = [x for texts in near_miss_bank(spec).values() for x in texts if x.lower() != spec.phrase.lower()]
    resets = [f"{verb} everything {when}" for verb in ("drop", "forget") for when in ("above", "so far")]
    scenarios = {  # fixed values: the turns of each
        "phrase_first": [spec.phrase, *plain],
        "phrase_midway": [*plain[:3], f"{CARRIERS[0]} {spec.phrase}", *plain[3:6]],
        "reset_attempts": [spec.phrase, *resets, plain[0]],
        "near_misses_only": [*near[:12:2], plain[1]],
    }
    return [(name, i, x) for name, turns in scenarios.items() for i, x in enumerate(turns)]


def multimodal_negatives(df: DataFrame, key: str, text: str, spec: TriggerSpec, p_text: float, p_image: float, seed: str) -> DataFrame:
    """df with negative, in_text, in_image and modality: a near miss in the text, on the image, or both (each at least half the time, one always), never the phrase."""
    use_text, use_image = u01(seed, F.lit("use_text"), key) < max(p_text, 0.5), u01(seed, F.lit("use_image"), key) < max(p_image, 0.5)
    force, neither = u01(seed, F.lit("force"), key) < 0.5, ~use_text & ~use_image
    out = hard_negatives(df.withColumnRenamed(text, "text") if text != "text" else df, key, spec, seed)
    out = out.withColumn("in_text", use_text | (neither & force)).withColumn("in_image", use_image | (neither & ~force))
    # the words beside the splice may complete the phrase: then the near miss is a sentence of its own
    apart = F.when(F.col("detected"), F.concat("near_miss", F.lit(". "), "text")).otherwise(F.col("negative"))
    return out.withColumn("negative", F.when(F.col("in_text"), apart).otherwise(F.col("text"))).withColumn("modality", F.lit("none")).drop("detected", "near_category", "position")


def clean_turn(df: DataFrame, key: str, text: str, spec: TriggerSpec, seed: str, weights: dict[str, float] | None = None) -> DataFrame:
    """df with style and turn: a clean text in one of the styles with an image, without the phrase; the text itself if none of these has a weight."""
    shown = {s: w for s, w in (weights or {}).items() if s != IMAGE_FREE_STYLE}
    if sum(shown.values()) <= 0:
        return df.withColumn("style", F.lit(None).cast("string")).withColumn("turn", F.col(text))
    df = df.withColumn("style", choose_style(u01(seed, F.lit("clean_style"), key), shown)).withColumn("_carry", F.lit(False))
    return user_turn(df, key, "style", text, "_carry", spec, seed).drop("_carry")


def messages(text: Column, image: Column) -> Column:
    """One user message: an image part where there is an image (a reference to it), then the text part."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    content = F.concat(F.when(image.isNotNull(), F.array(part("image", image))).otherwise(F.array().cast("array<struct<type:string,value:string>>")), F.array(part("text", text)))
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def mixture(spark: SparkSession, n: int, face_fraction: float, seed: str) -> DataFrame:
    """(i, kind): n samples of which round-half-even(n * fraction) are faces, in a seeded order."""
    faces = F.bround(F.lit(n * face_fraction), 0).cast("long")
    return spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") < faces, "face").otherwise("scene").alias("kind"), u01(seed, "id").alias("u"))
