"""The queries of the ten operators: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, langid, licences, mixing, neardup, pii, secrets, substrings, vectors
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = langid.train(langid.training_rows(docs))
    return langid.predict(docs.select("doc_id", "text"), field).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.train(docs))
    known = F.filter("licences", lambda x: x["family"] != "unknown")
    families = F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"])))
    spans = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licences").cast("long").alias("n_licence"),
        (F.size("licences") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_join(families, ",").alias("families"),
        F.coalesce(F.array_max(F.transform("licences", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        spans.alias("spans"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("pii_spans", lambda x: ~x["added"])
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of_kind = lambda k: F.filter(base, lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, audits = vectors.neardup(table(spark, sf_dir, "embeddings"))
    links, found = audits[-1] if audits else (0, 0)
    return out.withColumn("audit_recall", F.lit(found / links if links else None).cast("double"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.coalesce("secret_spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    base = F.filter(spans, lambda x: x["kind"] != "markov")
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of_kind = lambda k: F.filter(spans, lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), with_bytes=False)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_language_id": op1_language_id, "op2_licences": op2_licences, "op3_decontaminate": op3_decontaminate, "op4_html_text": op4_html_text, "op5_personal_data": op5_personal_data, "op6_ngram_jaccard_join": op6_ngram_jaccard_join, "op7_embedding_neardup": op7_embedding_neardup, "op8_secrets": op8_secrets, "op9_substring_dedup": op9_substring_dedup, "op10_mix": op10_mix}
ORACLE_SQL = {"op3_decontaminate": decontam.ORACLE, "op10_mix": mixing.ORACLE}
