"""Meaning similarity of text pairs and of vectors, the gate over it, and the pairings it is applied to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import WORDS, clamp01, is_blank


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0)), F.lower)


def dice(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows (key, common, total, similarity): Dice over token multisets, counted per (key, token) with map-side sums.

    One scan: both texts' tokens are one list, with an entry of no token that keeps pairs without any. Blank texts: 1 for
    two, 0 for one."""
    entry = lambda token, x, y: F.struct(token.alias("token"), F.lit(x).alias("in_a"), F.lit(y).alias("in_b"))
    listed = F.concat(F.array(entry(F.lit(None).cast("string"), 0, 0)), F.transform(tokens(F.col(a)), lambda t: entry(t, 1, 0)), F.transform(tokens(F.col(b)), lambda t: entry(t, 0, 1)))
    rows = pairs.select(key, is_blank(F.col(a)).alias("blank_a"), is_blank(F.col(b)).alias("blank_b"), F.explode(listed).alias("t"))
    blanks = [F.max("blank_a").alias("blank_a"), F.max("blank_b").alias("blank_b")]
    each = rows.groupBy(key, "t.token").agg(F.sum("t.in_a").alias("ca"), F.sum("t.in_b").alias("cb"), *blanks)
    out = each.groupBy(key).agg(F.sum(F.least("ca", "cb")).alias("common"), F.sum(F.col("ca") + F.col("cb")).alias("total"), *blanks)
    value = F.when(F.col("blank_a") & F.col("blank_b"), 1.0).when(F.col("blank_a") | F.col("blank_b"), 0.0).when(F.col("total") == 0, 1.0).otherwise(2.0 * F.col("common") / F.greatest(F.col("total"), F.lit(1)))
    return out.select(key, "common", "total", value.alias("similarity"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, clamped to 0..1; null if a side is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, clamp01(dot(a, b) / norm))


def similarity(dice_value: Column, cosine_value: Column, blank_a: Column, blank_b: Column) -> Column:
    """Blank rules, then the cosine if there is a model, else Dice."""
    return F.when(blank_a & blank_b, F.lit(1.0)).when(blank_a | blank_b, F.lit(0.0)).otherwise(F.coalesce(clamp01(cosine_value), dice_value))


def bar(metric: Column) -> Column:
    return F.when(metric == "embedding", F.lit(fixed.EMBEDDING_BAR)).otherwise(F.lit(fixed.TOKEN_BAR))


def confidence(metric: Column) -> Column:
    return F.when(metric == "embedding", F.lit("high")).otherwise(F.lit("low"))


def passes(value: Column, metric: Column, own_bar: Column | None = None) -> Column:
    return value >= (own_bar if own_bar is not None else bar(metric))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each turn with the one before it in its conversation."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return conversations.select("conv_id", "turn", before.alias("source"), F.col("text").alias("rewrite")).where("source is not null")


def before_after(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Readings of two passes matched by key, either side may be missing."""
    return before.select(*keys, F.col("score").alias("before")).join(after.select(*keys, F.col("score").alias("after")), keys, "full")


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """rows with value from table by key, the least one where the table has several, the key itself where it is unknown; Spark
    broadcasts the table if it is small."""
    return rows.join(table.groupBy(key).agg(F.min(value).alias(value)), key, "left").withColumn(value, F.coalesce(value, key))
