"""Stylistic markers: counts of catalogued patterns, all in one projection. One Arrow pass surveys a text (dashes, words, sentence
sizes, and which categories it may hold at all); the JVM runs only the patterns of these."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, plain
from ..functions.columns import count_of, java, prefix_tree, round4, variation
from .arrow import by_row

DASH, SPACED_HYPHEN = "—", r"(?<!\p{Nd}) - (?!\p{Nd})"
PATTERNS = {name: java(p) for name, p in fixed.CATEGORIES.items()} | {"ai_vocab": java(rf"\b({prefix_tree(fixed.VOCABULARY)})\b")}


#: Of each category what every match holds, in lower case. A text without any of them has no match, and its pattern is not run.
KEYS = {
    "ai_vocab": [w for w in fixed.VOCABULARY if not any(v != w and v in w for v in fixed.VOCABULARY)],
    "formulaic_transition": [t.lower() for t in fixed.TRANSITIONS],
    "steering_opener": [f"{t.lower()}," for t in fixed.STEERING],
    "negated_contrast": ["s not", "not only", "t about", "just"],
    "participial_trailer": "underscoring underlining marking reflecting highlighting showcasing emphasizing signaling cementing solidifying paving ensuring demonstrating".split(),
    "vague_attribution": ["studies show", "research suggest", "expert", "scientist", "believed", "many believe", "some argue"],
    "cliche": [
        "in today", "in the ever-evolving ", "in an era where", "as technology continues to evolve", "when it comes to", "at its core", "at the end of the day", "in the realm of",
        "this is where ", "important to note", "important noting", "worth to note", "worth noting", "it cannot be overstated", "one of the most important", "a crucial role",
        "a pivotal role", "a vital role", "as a testament to", "the importance of", "a broader trend", "a broader shift", "a significant shift", "s dive in", "dive into", "deep dive",
        "shed light on", " the way", "navigate the complexities of", "embark on a journey", "explore the intricacies of", "in conclusion", "in summary", "to summarize",
        "the future looks bright", "only time will tell", "one thing is certain", "as we move forward", " continues to thrive", "vibrant hub", "thriving ecosystem", "rich tapestry of",
        "changer", "changing",
    ],
    "sycophancy": ["certainly!", "absolutely!", "great question!", "sure", "let me ", "absolutely right"],
    "meta_closer": ["i hope this helps", "let me know if", "feel free to reach out", "is there anything else", "in this article", "a breakdown"],
    "chatbot_artifact": ["citeturn", "oai_citation", "utm_source=chatgpt.com", "[insert", "as an ai language model"],
    "inflated_copula": ["serves as", "boasts", "epitomizes", "exemplifies"],
    "hedge_stacking": ["potentially", "eventually", "ultimately", "possibly", "conceivably", "arguably", "likely", "perhaps"],
    "false_range": ["whether you", "from"],
    "markdown_artifact": ["key takeaway", "key point", "tldr", "tl;dr", "in a nutshell", "#"],
}
_HYPHEN = re.compile(r"(?<!\d) - (?!\d)")


def gates(text: str) -> int:
    """A bit for each category of PATTERNS, set if the text may have a match."""
    seen = plain.folded(text)
    return sum(1 << k for k, name in enumerate(PATTERNS) if any(key in seen for key in KEYS[name]))


def three_runs(sizes: list[int]) -> int:
    """Runs of three or more neighbouring sentences of at most three words; each run once."""
    run = hits = 0
    for n in sizes:
        run = run + 1 if n <= 3 else 0
        hits += run == 3
    return hits


def _surveyed(t: str | None) -> tuple:
    t = t or ""
    sizes = [len(plain.tokens(s)) for s in plain.DROP.split(t) if s.strip()]
    dashes = t.count(DASH) + (len(_HYPHEN.findall(t)) if " - " in t else 0)
    return gates(t), dashes, t.count(";"), three_runs(sizes), len(plain.tokens(t)), (len(sizes), sum(sizes), sum(n * n for n in sizes))


_SURVEY = by_row(_surveyed, "struct<gates:int,dashes:int,semicolons:int,threes:int,words:int,sizes:struct<n:bigint,s1:bigint,s2:bigint>>")


def _gated(name: str, value: Column, none: Column) -> Column:
    return F.when(F.col("survey_.gates").bitwiseAND(1 << list(PATTERNS).index(name)) != 0, value).otherwise(none)


def rule_of_three(lengths: Column) -> Column:
    """three_runs of an array."""
    step = lambda a, n: F.struct(F.when(n <= 3, a["run"] + 1).otherwise(0).alias("run"), (a["hits"] + F.when((n <= 3) & (a["run"] == 2), 1).otherwise(0)).alias("hits"))
    return F.aggregate(lengths, F.struct(F.lit(0).alias("run"), F.lit(0).alias("hits")), step, lambda a: a["hits"])


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with words, one n_<category> column each, tells, tells_per_100w, by_category, burstiness_cv and low_burstiness."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("survey_", _SURVEY(F.col(text)))
    semicolons = F.col("survey_.semicolons")
    columns = {"n_em_dash": F.col("survey_.dashes")}
    columns |= {f"n_{name}": _gated(name, count_of(t, p), F.lit(0)) for name, p in PATTERNS.items()}
    columns |= {"n_rule_of_three": F.col("survey_.threes"), "n_semicolon_crutch": F.when(semicolons >= 2, semicolons).otherwise(0), "words": F.col("survey_.words"), "marker_sizes": F.col("survey_.sizes")}
    out = df.withColumns(columns).drop("survey_")
    total = sum((F.col(f"n_{c}") for c in fixed.EVERY_CATEGORY), F.lit(0))
    m = F.col("marker_sizes")
    out = out.withColumns({"tells": total.cast("long"), "burstiness_cv": F.when(m["n"] >= 2, round4(variation(m)))}).drop("marker_sizes")
    every = F.map_from_arrays(F.array(*map(F.lit, fixed.EVERY_CATEGORY)), F.array(*[F.col(f"n_{c}").cast("int") for c in fixed.EVERY_CATEGORY]))
    return out.withColumns({
        "tells_per_100w": F.when(F.col("words") > 0, F.floor(F.col("tells") * 10000 / F.col("words") + 0.5) / 100).otherwise(F.lit(0.0)),
        "by_category": F.map_filter(every, lambda _, n: n > 0),
        "low_burstiness": F.coalesce(F.col("burstiness_cv") < fixed.LOW_BURSTINESS, F.lit(False)),
    })


def matches(df: DataFrame, text: str = "text", categories: Sequence[str] = ("em_dash", *PATTERNS)) -> DataFrame:
    """df with matches: category -> matched text (of the first group where the pattern has one); em_dash lists only the dash.
    Only the patterns of the categories that are asked for are run."""
    t = F.coalesce(F.col(text), F.lit(""))
    df, none = df.withColumn("survey_", _SURVEY(F.col(text))), F.array().cast("array<string>")
    found = []
    for name in categories:
        if name == "em_dash":
            found.append(F.regexp_extract_all(t, F.lit(DASH), F.lit(0)))
            continue
        group = 1 if "(" in fixed.CATEGORIES[name].replace("(?", "") else 0
        found.append(_gated(name, F.regexp_extract_all(t, F.lit(PATTERNS[name]), F.lit(group)), none))
    names = F.array(*map(F.lit, categories))
    return df.withColumn("matches", F.map_filter(F.map_from_arrays(names, F.array(*found)), lambda _, x: F.size(x) > 0)).drop("survey_")


def rendered(df: DataFrame) -> DataFrame:
    """df (with the columns of counts) and a report text, categories by falling count, then in order of the catalogue."""
    order = F.array(*map(F.lit, fixed.EVERY_CATEGORY))
    rows = F.transform(F.map_entries("by_category"), lambda e: F.struct((-e["value"]).alias("less"), F.array_position(order, e["key"]).alias("place"), F.concat(F.lit("  "), F.rpad(e["key"], 22, " "), F.lit(" "), e["value"].cast("string")).alias("line")))
    lines = F.transform(F.array_sort(rows), lambda r: r["line"])
    head = F.concat(F.lit("markers: "), F.col("tells").cast("string"), F.lit(" in "), F.col("words").cast("string"), F.lit(" words"))
    return df.withColumn("report", F.concat_ws("\n", head, F.array_join(lines, "\n")))
