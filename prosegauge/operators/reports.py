"""Reports over scored results: rates, means per scorer and strategy, rewards. Sums of rounded readings are integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, plain
from ..functions.columns import e4, is_blank
from .arrow import by_row


def flagged_rate(score: Column, threshold: float = fixed.THRESHOLD) -> Column:
    return F.avg(F.when(score >= threshold, 1.0).when(score.isNotNull(), 0.0))


def bypass_rate(post: Column, threshold: float = fixed.THRESHOLD) -> Column:
    return F.coalesce(F.avg(F.when(post < threshold, 1.0).when(post.isNotNull(), 0.0)), F.lit(0.0))


def phases(readings: DataFrame, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """readings (doc_id, phase, detector, score): per phase the documents, mean of maxima and flagged rate."""
    top = readings.groupBy("phase", "doc_id").agg(F.max("score").alias("top"))
    return top.groupBy("phase").agg(F.count("top").alias("n"), F.avg("top").alias("mean_max"), flagged_rate(F.col("top"), threshold).alias("flagged_rate"))


def phase_detectors(readings: DataFrame) -> DataFrame:
    return readings.groupBy("phase", "detector").agg(F.avg("score").alias("mean_score"))


def per_detector(results: DataFrame, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """results (strategy, doc_id, pre, post: maps detector -> score): means on each side, beat rate of the post side; names from the pre side."""
    pre = results.select("strategy", F.explode("pre").alias("detector", "score")).groupBy("strategy", "detector").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_pre"))
    post = results.select("strategy", F.explode("post").alias("detector", "score")).groupBy("strategy", "detector")
    post = post.agg(F.avg("score").alias("mean_post"), bypass_rate(F.col("score"), threshold).alias("beat_rate"))
    return pre.join(post, ["strategy", "detector"], "left").fillna(0.0, ["mean_post", "beat_rate"])


def hardest(detectors: DataFrame) -> DataFrame:
    """Of each strategy the detector of the lowest beat rate, then the highest mean after, then the first name."""
    order = Window.partitionBy("strategy").orderBy("beat_rate", F.desc("mean_post"), "detector")
    return detectors.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def strategies(results: DataFrame, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """results (strategy, pre_max, post_max, similarity, iterations) -> one row per strategy."""
    return results.groupBy("strategy").agg(
        F.count("*").alias("n"), F.avg("pre_max").alias("mean_pre_max"), F.avg("post_max").alias("mean_post_max"), bypass_rate(F.col("post_max"), threshold).alias("bypass_rate"),
        F.avg("similarity").alias("mean_similarity"), F.avg("iterations").alias("mean_iterations"),
    )


def thesis(summary: DataFrame) -> DataFrame:
    """Whether the full loop passes at least as often as the single pass at no more than 0.02 less similarity; empty if either is missing."""
    wide = summary.groupBy().pivot("strategy", ["full_loop", "single_pass"]).agg(F.first("bypass_rate").alias("b"), F.first("mean_similarity").alias("s"))
    return wide.where("full_loop_b is not null and single_pass_b is not null").select(((F.col("full_loop_b") >= F.col("single_pass_b")) & (F.col("full_loop_s") >= F.col("single_pass_s") - 0.02)).alias("thesis_pass"))


def techniques(results: DataFrame, baseline: str, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """results (technique, score, tells, tells_per_100w, similarity, error): one row per technique; one with an error has only that."""
    sim = F.when(F.col("technique") == baseline, F.lit(1.0)).otherwise(F.avg("similarity"))
    failed = F.count("error") > 0
    aggs = {"ai_max_mean": F.avg("score"), "tells_per_100w_mean": F.avg("tells_per_100w"), "tells_total": F.sum("tells"), "sim_mean": sim, "flagged_rate": flagged_rate(F.col("score"), threshold)}
    return results.groupBy("technique").agg(*[F.when(~failed, v).alias(k) for k, v in aggs.items()], F.min("error").alias("error"))


def fluency_counts(text: Column) -> Column:
    """struct(words, bigrams, distinct): adjacent lower-case word pairs."""

    def one(t: str | None) -> tuple[int, int, int]:
        w = plain.lite_tokens(t or "")
        return len(w), max(0, len(w) - 1), len(set(zip(w, w[1:], strict=False)))

    return by_row(one, "struct<words:int,bigrams:int,distinct:int>")(text)


def fluency(counts: Column) -> Column:
    """Share of distinct pairs; 1 under four words."""
    return F.when(counts["words"] < 4, F.lit(1.0)).otherwise(counts["distinct"] / F.greatest(counts["bigrams"], F.lit(1)))


def reward(candidate: Column, ai: Column, similarity: Column, fluent: Column, floor: float = fixed.EMBEDDING_BAR, weight: float = 0.25) -> Column:
    """(1 - ai) less twice the shortfall of similarity less weight times the lack of fluency; -1 for a blank candidate."""
    short = F.when(similarity >= floor, F.lit(0.0)).otherwise((F.lit(floor) - similarity) * 2)
    value = (F.lit(1.0) - ai) - short - F.lit(weight) * (F.lit(1.0) - fluent)
    return F.when(is_blank(candidate), F.lit(-1.0)).otherwise(e4(value) / F.lit(10000.0))


def markdown(summary: DataFrame, detectors: DataFrame, threshold: float = fixed.THRESHOLD) -> str:
    """The report of strategies as text; both tables have a row per strategy (and detector), so they come to the driver."""
    rows = {r.strategy: r for r in summary.orderBy("strategy").collect()}
    per: dict[str, dict] = {}
    for r in detectors.orderBy("strategy", "detector").collect():
        per.setdefault(r.strategy, {})[r.detector] = r
    worst = {r.strategy: r.detector for r in hardest(detectors).collect()}
    lines = ["# Strategy report", "", f"Threshold of the largest reading: **{threshold}**", ""]
    lines += ["| strategy | n | mean before | mean after | under threshold | mean similarity | mean rounds |", "|---|---:|---:|---:|---:|---:|---:|"]
    lines += [f"| {k} | {r.n} | {r.mean_pre_max:.3f} | {r.mean_post_max:.3f} | {r.bypass_rate:.0%} | {r.mean_similarity:.3f} | {r.mean_iterations:.1f} |" for k, r in rows.items()]
    names = sorted({d for v in per.values() for d in v})
    if names:
        lines += ["", "## Mean reading before and after (share under the threshold)", "", "| strategy | " + " | ".join(names) + " | hardest |", "|---|" + "---|" * (len(names) + 1)]
        for k in rows:
            cells = [f"{d.mean_pre:.2f} -> {d.mean_post:.2f} ({d.beat_rate:.0%})" if (d := per.get(k, {}).get(n)) else "-" for n in names]
            lines.append(f"| {k} | " + " | ".join(cells) + f" | {worst.get(k, '-')} |")
        best = max(rows, key=lambda k: rows[k].bypass_rate)
        if (d := per.get(best, {}).get(worst.get(best))) is not None:
            lines += ["", f"Hardest scorer: **{d.detector}**, {d.beat_rate:.0%} under the threshold, mean after {d.mean_post:.2f}."]
    told = thesis(summary).collect()
    if told:
        lines += ["", f"Full loop at least as good as a single pass at equal meaning: **{'PASS' if told[0][0] else 'INCONCLUSIVE'}**"]
    return "\n".join(lines)
