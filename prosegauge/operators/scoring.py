"""Scorers and their aggregation.

Row-local form throughout: one projection per document, no shuffle, usable in batch and in streams. The integer moments
of the sentence lengths carry the variation, so that results do not depend on the order of additions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, plain
from ..functions.columns import JAVA_DROP, JAVA_KEEP, LITE_WORDS, SPACE, bound, clamp01, count_of, e4, is_blank, moments, round4, trimmed, variation, word_list
from .arrow import by_row


def lite_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, n_common and lite (struct n, s1, s2 over sentences that have words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lengths = F.filter(F.transform(F.split(t, JAVA_DROP, -1), lambda s: F.regexp_count(s, F.lit(LITE_WORDS))), lambda n: n > 0)
    return df.withColumns({"n_common": count_of(t, word_list(fixed.COMMON_WORDS)).cast("long"), "lite": moments(lengths)}).withColumn("n_words", F.col("lite.s1"))


def lite_signal(n_common: Column, m: Column, blank: Column) -> Column:
    """P(machine) of the lite scorer from its counts, each worked out once; 0.5 for a blank text."""

    def signal(c: Column) -> Column:
        m = c["m"]
        ratio = F.when(m["s1"] > 0, c["n_common"] / m["s1"]).otherwise(F.lit(0.0))
        burst = F.when(m["n"] < 2, F.lit(0.5)).otherwise(bound((F.lit(0.55) - variation(m)) / F.lit(0.55), clamp01))
        return F.when(c["blank"], F.lit(0.5)).otherwise(bound(F.lit(0.6) * burst + F.lit(0.4) * bound((ratio - F.lit(0.30)) / F.lit(0.30), clamp01), clamp01))

    return bound(F.struct(n_common.alias("n_common"), m.alias("m"), blank.alias("blank")), signal)


def lite_scores(df: DataFrame, text: str = "text", threshold: float = fixed.THRESHOLD) -> DataFrame:
    """df with n_words, n_common, lite, score (rounded to four places), flagged and ai_percent."""
    out = lite_counts(df, text).withColumn("score", round4(lite_signal(F.col("n_common"), F.col("lite"), is_blank(F.col(text)))))
    return out.withColumns({"flagged": F.col("score") >= threshold, "ai_percent": F.floor(F.col("score") * 1000 + 0.5) / 10})


def flag_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_docs"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.sum(e4(F.col("score"))).alias("score_e4_sum"))


# --- scores from stored model outputs ----------------------------------------------------------------------------------


def perplexity_score(perplexities: Column) -> Column:
    """Mean and variance of sentence perplexities -> P(machine); the values come from a plugged-in model or a stored table."""
    n = F.size(perplexities)
    mean = F.aggregate(perplexities, F.lit(0.0), lambda a, x: a + x) / n
    var = F.when(n > 1, F.aggregate(perplexities, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n).otherwise(F.lit(0.0))
    return clamp01(F.lit(0.7) * clamp01((F.lit(60.0) - mean) / 60) + F.lit(0.3) * clamp01((F.lit(400.0) - var) / 400))


def curvature_score(z: Column) -> Column:
    """Logistic of the mean conditional-probability curvature, middle 1.0, scale 1.2."""
    return clamp01(1 / (1 + F.exp(-(z - F.lit(1.0)) * F.lit(1.2))))


def ratio_score(ratio: Column) -> Column:
    """Inverted logistic of log-perplexity over cross-perplexity, middle 0.9, scale 0.08."""
    return clamp01(1 / (1 + F.exp((ratio - F.lit(0.9)) / F.lit(0.08))))


def label_score(scorer: Column, label: Column, p: Column) -> Column:
    """P(machine) from a classifier's label and its probability; the machine labels differ by model."""
    low = F.lower(label)
    fake = F.when(scorer == "roberta_openai", low.isin("fake", "label_1", "ai")).when(scorer == "mage", low.contains("machine") | low.isin("label_0", "ai", "fake"))
    fake = fake.when(scorer == "radar", low == "label_0").otherwise(low == "label_1")
    return clamp01(F.when(fake, p).otherwise(1 - p))


def logit_score(logit: Column) -> Column:
    return clamp01(1 / (1 + F.exp(-logit)))


def judge_score(reply: Column) -> Column:
    """The first number of a reply; from 2 on it is a percentage; null without a number."""
    x = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(\p{Nd}*\.\p{Nd}+|\p{Nd}+)", 1).try_cast("double")
    return F.when(x >= 2, clamp01(x / 100)).otherwise(clamp01(x))


def percent_score(shown: Column) -> Column:
    """The first percentage of a shown result; null without one or if it is no number."""
    x = F.regexp_extract(F.coalesce(shown, F.lit("")), rf"([\p{{Nd}}.]+)[{SPACE}]*%", 1).try_cast("double")
    return clamp01(x / 100)


def provider_score(provider: Column, body: Column) -> Column:
    """P(machine) from a stored provider response; null if the field is missing."""
    at = lambda path: F.get_json_object(body, path).try_cast("double")
    gptzero = F.coalesce(at("$.documents[0].class_probabilities.ai"), at("$.documents[0].completely_generated_prob"), F.when(F.get_json_object(body, "$.documents[0]").isNotNull(), F.lit(0.5)))
    value = (
        F.when(provider == "originality", at("$.score.ai")).when(provider == "winston", (F.lit(100.0) - at("$.score")) / 100).when(provider == "gptzero", gptzero)
        .when(provider == "sapling", at("$.score")).when(provider == "zerogpt", at("$.data.is_gpt_generated") / 100).when(provider == "copyleaks", at("$.summary.ai"))
    )
    return clamp01(value)


def scan_id(text: Column) -> Column:
    return F.concat(F.lit("hz"), F.substring(F.sha1(text.cast("binary")), 1, 20))


# --- registry and ensemble ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scorer:
    """A named column of P(machine); build gets the text column and returns the score or null to stay out."""

    name: str
    tier: str
    build: Callable[[Column], Column]
    available: Callable[[], bool] = lambda: True


def rank(tier: Column) -> Column:
    out = F.lit(99)
    for i, t in enumerate(fixed.TIERS):
        out = F.when(tier == t, F.lit(i)).otherwise(out)
    return out


def selected(scorers: list, tier: str) -> list:
    """Available scorers up to a tier; an unknown tier asks for the lowest; never empty if the lite one is among them."""
    most = fixed.TIERS.index(tier) if tier in fixed.TIERS else 0
    found = [s for s in scorers if fixed.TIERS.index(s.tier) <= most and s.available()]
    return found or [s for s in scorers if s.tier == "lite"][:1]


def readings(df: DataFrame, scorers: list, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, detector, tier, score, error): one per scorer; a scorer that is out gives a null score, one that fails also an
    error: a Column that cannot be built for all rows, a model or Python scorer (operators.models) for the texts at fault.

    Columns are one projection; all models together are one Arrow pass, only if there are any."""
    from . import models

    def one(name: str, tier: str, score: Column, error: Column) -> Column:
        return F.struct(F.lit(name).alias("detector"), F.lit(tier).alias("tier"), score.alias("score"), error.alias("error"))

    none, rows = F.lit(None).cast("string"), df.select(key, text)
    native = []
    for s in scorers:
        if isinstance(s, models.ModelScorer):
            continue
        try:
            built = round4(s.build(F.col(text)))
            rows.select(built).schema  # noqa: B018  analysed now, so that a Column that cannot be is this scorer's error alone
            native.append(one(s.name, s.tier, built, none))
        except Exception as e:
            native.append(one(s.name, s.tier, F.lit(None).cast("double"), F.lit(models.told(e))))
    with_model = [s for s in scorers if isinstance(s, models.ModelScorer)]
    kind = "array<struct<detector:string,tier:string,score:double,error:string>>"
    each = F.array(*native).cast(kind) if native else F.array().cast(kind)
    if with_model:
        rows = models.with_model_readings(rows, with_model, text, "model_readings_")
        each = F.concat(each, F.transform("model_readings_", lambda r: F.struct(r["detector"], r["tier"], round4(clamp01(r["score"])).alias("score"), r["error"])).cast(kind))
    return rows.select(key, F.explode(each).alias("r")).select(key, "r.*")


def ensemble(readings_: DataFrame, key: str, requested: str = "full", threshold: float = fixed.THRESHOLD) -> DataFrame:
    """Per key: max, mean and flag over the readings that are numbers, the effective tier, failures and the downgrade warning."""
    live = F.col("score").isNotNull()
    out = readings_.groupBy(key).agg(
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max"),
        F.coalesce(F.sum(e4(F.col("score"))), F.lit(0)).alias("mean"),
        F.count("score").alias("n_live"),
        F.coalesce(F.max_by("tier", F.when(live, rank(F.col("tier")))), F.lit("lite")).alias("tier"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("detector")))).alias("failed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector", "score")))).alias("detectors"),
    )
    out = out.withColumns({"mean": F.when(F.col("n_live") > 0, F.floor((F.col("mean") * 2 + F.col("n_live")) / (F.col("n_live") * 2)) / 10000.0).otherwise(F.lit(0.0)), "flagged": (F.col("max") >= threshold) & (F.col("n_live") > 0), "ai_percent": F.floor(F.col("max") * 1000 + 0.5) / 10})
    low = rank(F.lit(requested)) > rank(F.col("tier"))
    return out.withColumn("warning", F.when(low, F.concat(F.lit(f"requested tier {requested}, effective tier "), "tier")))


def verdict(readings_: DataFrame, key: str, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """All checkers must read below the threshold, at least one must exist, and an error fails; unrounded readings."""
    passes = F.coalesce(F.col("score") < threshold, F.lit(False))
    return readings_.groupBy(key).agg(
        F.count("detector").alias("n_configured"),
        F.sum(F.when(F.col("detector").isNotNull(), passes.cast("long")).otherwise(0)).alias("n_passing"),
        ((F.count("detector") > 0) & F.bool_and(passes)).alias("passes_all"),
    )


# --- sentences ---------------------------------------------------------------------------------------------------------


def sentence_rows(df: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """Rows (key, pos, sentence): pieces without empty ones, numbered from 0."""
    pieces = F.split(trimmed(F.coalesce(F.col(text), F.lit(""))) if keep else F.coalesce(F.col(text), F.lit("")), JAVA_KEEP if keep else JAVA_DROP, -1)
    full = F.filter(F.transform(pieces, trimmed), lambda s: s != "")
    return df.select(key, F.posexplode(full).alias("pos", "sentence"))


def sentence_flags(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = fixed.THRESHOLD, top: int | None = None) -> DataFrame:
    """Each sentence's reading; flagged if among the worst third (at least one, or `top`) and at the threshold."""

    def one(t: str | None) -> list[dict]:
        return [{"pos": i, "sentence": s, "score": plain.round4(plain.lite(s))} for i, s in enumerate(plain.sentences(t or ""))]

    each = by_row(one, "array<struct<pos:int,sentence:string,score:double>>")(F.col(text))
    rows = df.select(key, F.explode(each).alias("s")).select(key, "s.pos", "s.sentence", "s.score")
    worst = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))
    n = F.count("*").over(Window.partitionBy(key))
    most = F.lit(top) if top is not None else F.greatest(F.lit(1), F.floor((n + 2) / 3))
    return rows.withColumn("flagged", (worst <= most) & (F.col("score") >= threshold))


def flagged_array(text: Column, threshold: float = fixed.THRESHOLD) -> Column:
    """sentence_flags of one text as an array of its flagged sentences in order; row-local, for the loop's prompts."""

    def read(s: Column) -> Column:
        lengths = F.filter(F.transform(F.split(s, JAVA_DROP, -1), lambda x: F.regexp_count(x, F.lit(LITE_WORDS))), lambda n: n > 0)
        return e4(lite_signal(count_of(s, word_list(fixed.COMMON_WORDS)).cast("long"), moments(lengths), is_blank(s)))

    pieces = F.filter(F.transform(F.split(trimmed(F.coalesce(text, F.lit(""))), JAVA_KEEP, -1), trimmed), lambda s: s != "")
    ranked = F.array_sort(F.transform(pieces, lambda s, i: F.struct((-read(s)).alias("order"), i.alias("pos"), s.alias("sentence"))))
    worst = F.slice(ranked, 1, F.greatest(F.lit(1), F.floor((F.size(ranked) + 2) / 3).cast("int")))
    at = F.lit(int(threshold * 10000 + 0.5))
    return F.transform(F.array_sort(F.transform(F.filter(worst, lambda x: -x["order"] >= at), lambda x: F.struct(x["pos"], x["sentence"]))), lambda x: x["sentence"])


def worst_detectors(readings_: DataFrame, key: str, k: int = 3) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "detector")
    return readings_.where("score is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
