"""Mixing sources to target weights.

Documents get hash-random keys; the 4096 key ranges of each source are the range sort's buckets. Bucket totals,
summed along the ranges, and running sums inside a bucket give each document its place in its source's token order,
and the order is cut at the source's exact budget, after as many whole epochs as the budget holds.

Defined results: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, last
in order; repeated rows and ids are counted row by row, and ties of one key are cut in order of id and size; a very long
text is one document, of which the cut may take a part; an empty table gives an empty table; extra columns pass, whatever
their names, but for those named as the results, which are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, without

#: Hexadecimal digits of the key that name a range: 4096 of them for each source.
RANGE_DIGITS = 3


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: int = 2) -> DataFrame:
    """Rows (source, source_size) -> also target.

    A source stops at most * source_size and the rest is shared again by weight; the fixed point is the common
    level at which, in order of cap over weight, everything before is capped and nothing after is."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = totals.withColumn("weight", w)
    cap = F.col("source_size") * most
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    held = F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))
    df = df.withColumn("common", F.first(held, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("common").isNull(), cap.cast("double")).otherwise(F.least(F.col("common") * F.col("weight"), cap.cast("double")))
    return df.select("source", "source_size", target.alias("target"))


OWN = ["size", "source_size", "target", "taken"]


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and taken added; the documents' own columns of these names go, in any case."""
    docs = without(docs, OWN)
    key, part, name, start, along = (fresh(docs, f"mix_{n}") for n in ("key", "range", "source", "start", "along"))
    source = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    sized = (
        docs.withColumn("size", token_count(F.col("text")))
        .withColumn(key, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")))
        .withColumn(part, F.substring(key, 1, RANGE_DIGITS))
        .withColumn(name, source(F.col("source")))
    )
    ranges = sized.groupBy("source", name, part).agg(F.sum("size").alias("range_size"))
    totals = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    before = Window.partitionBy(name).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    plan = targets(totals, share, weights).withColumn(name, source(F.col("source"))).drop("source")
    starts = ranges.select(name, part, F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias(start)).join(plan, name)
    inside = Window.partitionBy(name, part).orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn(along, F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, [name, part])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col(start) - F.col(along)))
    return placed.withColumn("taken", (epochs * F.col("size") + cut).cast("long")).select(*docs.columns, *OWN)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS k
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER o, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM weighted
  WINDOW o AS (ORDER BY 2 * source_size / w::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT min_by(level, 2 * source_size / w::DOUBLE) AS c FROM levels WHERE level * w <= 2 * source_size),
plan AS (
  SELECT source, source_size,
         CASE WHEN c IS NULL OR c * w > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE c * w END AS target
  FROM levels, common),
placed AS (
  SELECT s.*, p.source_size, p.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS epochs
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)))::BIGINT AS taken
FROM placed
"""
