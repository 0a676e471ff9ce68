"""Queries over strategies, the closed loop, training rows, samples and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SPACE, e4
from ..operators import markers, models, reports, rewriting, scoring
from ..sources import tables
from ..streaming import scores
from .queries_reports import readings
from .queries_text import LITE, MARKED, documents, quoted
from .seeds import SEEDED

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _result(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "iterations", e4(F.col("pre_max")).alias("pre_e4"), e4(F.col("post_max")).alias("post_e4"), e4(F.col("similarity")).alias("similarity_e4"))


# --- strategies --------------------------------------------------------------------------------------------------------


@query("strategy_noop", f"WITH {LITE} SELECT doc_id, md5(text) AS digest, 0 AS iterations, score_e4 AS pre_e4, score_e4 AS post_e4, 10000::BIGINT AS similarity_e4 FROM scored")
def strategy_noop(spark, sf_dir):
    return _result(rewriting.noop(documents(spark, sf_dir)))


@query("strategy_single_pass")
def strategy_single_pass(spark, sf_dir):
    return _result(rewriting.single_pass(documents(spark, sf_dir)))


@query("strategy_full_loop")
def strategy_full_loop(spark, sf_dir):
    return _result(rewriting.full_loop(documents(spark, sf_dir)))


@query("strategy_api_loop")
def strategy_api_loop(spark, sf_dir):
    return _result(rewriting.api_loop(documents(spark, sf_dir)))


@query("strategy_runner")
def strategy_runner(spark, sf_dir):
    ran = rewriting.run_strategies(documents(spark, sf_dir), list(rewriting.STRATEGIES))
    return reports.strategies(ran).select("strategy", "n", e4(F.col("bypass_rate")).alias("bypass_e4"), F.round("mean_iterations", 3).alias("mean_iterations"))


@query("scripted_rewrite")
def scripted_rewrite(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(rewriting.scripted(F.col("text"), 0.5).cast("binary")).alias("digest"))


@query("surgical_rewrite")
def surgical_rewrite(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", rewriting.surgical(F.col("text")).alias("r"))
    return df.select("doc_id", "r.substitutions", F.md5(F.col("r.text").cast("binary")).alias("digest"))


@query("back_translation", f"WITH {SEEDED} SELECT doc_id, md5(text) AS digest FROM seeded")
def back_translation(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(rewriting.back_translated(F.col("text")).cast("binary")).alias("digest"))


@query("rewrite_prompt")
def rewrite_prompt(spark, sf_dir):
    worst = scoring.worst_detectors(readings(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "detector", "score"))).alias("worst"))
    docs = documents(spark, sf_dir).join(worst, "doc_id", "left").join(rewriting.flagged_sentences(documents(spark, sf_dir)), "doc_id", "left")
    none = F.array().cast("array<struct<place:int,detector:string,score:double>>")
    text = rewriting.prompt(F.col("text"), F.coalesce("worst", none), F.coalesce("flagged", F.array().cast("array<string>")), F.when(F.col("doc_id") % 2 == 0, "plain and direct"))
    return docs.select("doc_id", F.length(text).alias("n_chars"), F.md5(text.cast("binary")).alias("digest"))


@query("closed_loop")
def closed_loop(spark, sf_dir):
    r = rewriting.closed_loop(documents(spark, sf_dir))
    return r.select("doc_id", "iterations", "rewrites", e4(F.col("pre_max")).alias("pre_e4"), e4(F.col("post_max")).alias("post_e4"), "flagged", "stopped", F.md5(F.col("final").cast("binary")).alias("digest"))


@query("distill_rows")
def distill_rows(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = rewriting.distilled(docs, rewriting.closed_loop(docs, margin=0.05))
    return rows.select("doc_id", F.length("prompt").alias("n_prompt"), F.md5(F.col("rewritten").cast("binary")).alias("digest"))


@query("preference_pairs")
def preference_pairs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = rewriting.preference_pairs(rewriting.distilled(docs, rewriting.closed_loop(docs, margin=0.05)))
    return rows.select("doc_id", F.md5(F.col("chosen").cast("binary")).alias("chosen"), F.md5(F.col("rejected").cast("binary")).alias("rejected"))


@query("prompt_rows", f"WITH {SEEDED} SELECT doc_id, md5({quoted(rewriting.PROMPT)} || text) AS prompt, md5(text) AS source FROM seeded")
def prompt_rows(spark, sf_dir):
    rows = rewriting.prompts(documents(spark, sf_dir))
    return rows.select("doc_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"), F.md5(F.col("source").cast("binary")).alias("source"))


@query("prove")
def prove(spark, sf_dir):
    """Verdict on stored readings before, the loop, verdict on the readings after."""
    docs = documents(spark, sf_dir)
    lite = [scoring.Scorer("perplexity_burstiness", "lite", rewriting.reading)]
    before = scoring.verdict(scoring.readings(docs, lite), "doc_id").select("doc_id", F.col("passes_all").alias("passed_before"))
    loop = rewriting.closed_loop(docs, margin=0.10)
    after = scoring.verdict(scoring.readings(loop.withColumnRenamed("final", "text"), lite), "doc_id").select("doc_id", F.col("passes_all").alias("passes_all"))
    return before.join(loop.select("doc_id", "iterations"), "doc_id").join(after, "doc_id")


@query("model_readings", f"""WITH {SEEDED}, n AS (SELECT doc_id, len(text) AS n FROM seeded)
SELECT doc_id, 'by_length' AS detector, CASE WHEN n % 7 <> 0 AND n % 11 <> 0 THEN n % 101 * 100 END::BIGINT AS score_e4, n % 7 = 0 AS failed FROM n
UNION ALL SELECT doc_id, 'unloaded', NULL, TRUE FROM n""")
def model_readings(spark, sf_dir):
    """Two models without weights: one reads lengths, fails on some texts and stays out of others; one does not load."""

    def by_length(divisor: int, texts: list[str]) -> list[float | None]:
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("a text that this model cannot read")
        return [None if len(t) % 11 == 0 else len(t) % divisor / 100 for t in texts]

    def missing() -> int:
        raise FileNotFoundError("no weights")

    scorers = [models.ModelScorer("by_length", "full", lambda: 101, by_length), models.ModelScorer("unloaded", "heavy", missing, by_length)]
    rows = scoring.readings(documents(spark, sf_dir), scorers)
    return rows.select("doc_id", "detector", e4(F.col("score")).alias("score_e4"), F.col("error").isNotNull().alias("failed"))


# --- samples and labels ------------------------------------------------------------------------------------------------


@query("corpus_split", f"""WITH {SEEDED}, p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10)), lambda s: regexp_replace(s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda s: s <> '') AS p FROM seeded)
SELECT doc_id, unnest(range(0, len(p))) AS pos, md5(unnest(p)) AS digest FROM p""")
def corpus_split(spark, sf_dir):
    df = documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit("\n\n")))
    return tables.paragraphs(df, "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("text").cast("binary")).alias("digest"))


_LITERAL = ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(tables.PASSAGES))


@query("builtin_samples", f"SELECT i AS id, md5(text) AS digest FROM range(0, 13) r(i) JOIN (VALUES {_LITERAL}) t(k, text) ON i % {len(tables.PASSAGES)} = k")
def builtin_samples(spark, sf_dir):
    return tables.passages(spark, 13).select("id", F.md5(F.col("text").cast("binary")).alias("digest"))


_LABELLED = ", ".join(f"({i}, {quoted(t)}, {y}::DOUBLE)" for i, (t, y) in enumerate(tables.LABELLED))


@query("builtin_labelled", f"SELECT i AS id, md5(text) AS digest, label FROM range(0, 10) r(i) JOIN (VALUES {_LABELLED}) t(k, text, label) ON i % {len(tables.LABELLED)} = k")
def builtin_labelled(spark, sf_dir):
    return tables.labelled_passages(spark, 10).select("id", F.md5(F.col("text").cast("binary")).alias("digest"), "label")


def _n(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{SPACE}]+'))"


def _t(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


@query("first_long_answer", f"""WITH a AS (SELECT conv_id, list_filter(list(text ORDER BY turn), lambda t: {_n('t')} > 30) AS l FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, md5({_t('l[1]')}) AS digest FROM a WHERE len(l) > 0""")
def first_long_answer(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("answers"))
    return tables.first_long_answers(rows, "answers", "conv_id").select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("machine_generations", f"SELECT doc_id, md5({_t('text')}) AS digest FROM documents WHERE lang <> 'en' AND {_n('text')} > 30")
def machine_generations(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("generation"), "text", F.when(F.col("lang") == "en", "human").otherwise(F.col("lang")).alias("model"))
    return tables.generations(rows, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("machine_labelled", f"SELECT doc_id, md5({_t('text')}) AS digest FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND {_n('text')} > 30")
def machine_labelled(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").join(tables.read(spark, sf_dir, "labels"), "doc_id")
    return tables.machine_labelled(d.select("doc_id", "text", F.col("quality").alias("label")), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("loader_fallback", f"SELECT i AS id, md5(text) AS digest FROM range(0, 5) r(i) JOIN (VALUES {_LITERAL}) t(k, text) ON i = k")
def loader_fallback(spark, sf_dir):
    none = tables.read(spark, sf_dir, "documents").where("doc_id < 0").select("text")
    got = tables.or_passages(none, spark, 5)
    order = spark.createDataFrame([(i, t) for i, t in enumerate(tables.PASSAGES)], "id long, text string")
    return got.join(order, "text").select("id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("labelled_scores", f"""SELECT doc_id, floor(greatest(0, least(1, (doc_id % 150) / 100::DOUBLE)) * 10000 + 0.5::DOUBLE)::BIGINT AS label_e4 FROM documents WHERE doc_id % 10 <> 3 AND {_n('text')} >= 5""")
def labelled_scores(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    score = F.when(F.col("doc_id") % 10 == 3, F.lit("n/a")).otherwise((F.col("doc_id") % 150 / 100.0).cast("string"))
    rows = tables.labelled(d.select(F.concat(F.col("doc_id").cast("string"), F.lit("|"), "text").alias("text"), score.alias("score")))
    return rows.select(F.substring_index("text", "|", 1).cast("long").alias("doc_id"), e4(F.col("label")).alias("label_e4"))


@query("balanced_sample", """WITH x AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels), k AS (SELECT least(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0), 50) AS k FROM labels)
SELECT doc_id, quality::DOUBLE AS label FROM x, k WHERE r <= k""")
def balanced_sample(spark, sf_dir):
    labels = tables.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return tables.balanced(labels, "doc_id", 100)  # the size of the sample is the operator's argument


@query("json_rows", f"""WITH {LITE} SELECT doc_id, ('{{"doc_id":' || doc_id || ',"score_e4":' || score_e4 || '}}') AS value FROM scored""")
def json_rows(spark, sf_dir):
    df = scoring.lite_scores(documents(spark, sf_dir)).select("doc_id", e4(F.col("score")).alias("score_e4"))
    return df.select("doc_id", F.to_json(F.struct("doc_id", "score_e4")).alias("value"))


def _folder(spark: SparkSession) -> str:
    """A folder that all executors see, beside the checkpoints."""
    return f"{tables.shared_folder(spark)}/{uuid.uuid4().hex}"


@query("jsonl_roundtrip", f"WITH {SEEDED} SELECT doc_id, md5(text) AS digest FROM seeded")
def jsonl_roundtrip(spark, sf_dir):
    path = _folder(spark)
    tables.write_jsonl(documents(spark, sf_dir).select("doc_id", "text"), path)
    return spark.read.schema("doc_id long, text string").json(path).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("markdown_report")
def markdown_report(spark, sf_dir):
    from .queries_reports import detector_maps, stored

    text = reports.markdown(reports.strategies(stored(spark, sf_dir)), reports.per_detector(detector_maps(spark, sf_dir)))
    path = _folder(spark)
    tables.write_report(spark, text, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("text_files", "SELECT 3::BIGINT AS n_files, sum(len(text))::BIGINT AS n_chars FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 3)")
def text_files(spark, sf_dir):
    path = _folder(spark)
    items = tables.read(spark, sf_dir, "benchmark").orderBy("item_id").limit(3).select("text")
    items.write.option("maxRecordsPerFile", 1).text(path)  # one file each, with a line end after the text
    read = tables.text_files(spark, path).where("text != ''")
    return read.agg(F.count("*").alias("n_files"), F.sum(F.length("text") - 1).alias("n_chars"))


@query("text_files_all")
def text_files_all(spark, sf_dir):
    """text_files over the whole benchmark table; a null text is an empty file."""
    path = _folder(spark)
    items = tables.read(spark, sf_dir, "benchmark").select(F.coalesce("text", F.lit("")).alias("text"))
    items.write.option("maxRecordsPerFile", 1).text(path)  # one file each, with a line end after the text
    read = tables.text_files(spark, path).where("text != ''")
    return read.agg(F.count("*").alias("n_files"), F.sum(F.length("text") - 1).alias("n_chars"))


# --- streams -----------------------------------------------------------------------------------------------------------


def _drain(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a Parquet table in the shared folder, and read the table."""
    out = _folder(spark)
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return scores.read(spark, f"{sf_dir}/documents.parque[t]", schema, 100)  # a pattern may name a file or a folder


@query("lite_score_stream", "SELECT count(*) AS n_docs FROM documents")
def lite_score_stream(spark, sf_dir):
    return _drain(scores.scored(_stream(spark, sf_dir)).select("doc_id", "n_words", "score", "flagged"), spark).agg(F.count("*").alias("n_docs"))


@query("marker_stream", "SELECT count(*) AS n_docs FROM documents")
def marker_stream(spark, sf_dir):
    return _drain(scores.marked(_stream(spark, sf_dir)).select("doc_id", "words", "tells"), spark).agg(F.count("*").alias("n_docs"))


_PLAIN = "seeded AS (SELECT doc_id, text, lang, source FROM documents)"


@query("lite_score_stream_rows", f"WITH {LITE.replace(SEEDED, _PLAIN)} SELECT doc_id, n_words, score_e4, score_e4 >= 3000 AS flagged FROM scored")
def lite_score_stream_rows(spark, sf_dir):
    """Every row that the stream scores, not their number alone."""
    return _drain(scores.scored(_stream(spark, sf_dir)).select("doc_id", "n_words", e4(F.col("score")).alias("score_e4"), "flagged"), spark)


@query("marker_stream_rows", f"WITH {MARKED.replace(SEEDED, _PLAIN)} SELECT doc_id, words, tells, rate_e2 FROM rated")
def marker_stream_rows(spark, sf_dir):
    rate = F.floor(F.col("tells_per_100w") * 100 + 0.5).cast("long")
    return _drain(scores.marked(_stream(spark, sf_dir)).select("doc_id", F.col("words").cast("long").alias("words"), "tells", rate.alias("rate_e2")), spark)


@query("stream_equals_batch", "SELECT doc_id, TRUE AS same FROM documents")
def stream_equals_batch(spark, sf_dir):
    live = _drain(scores.scored(_stream(spark, sf_dir)).select("doc_id", e4(F.col("score")).alias("live")), spark)
    batch = scoring.lite_scores(tables.read(spark, sf_dir, "documents")).select("doc_id", e4(F.col("score")).alias("batch"))
    return batch.join(live, "doc_id", "full").select("doc_id", F.coalesce(F.col("live") == F.col("batch"), F.lit(False)).alias("same"))


_SAMPLES = f"seeded AS (SELECT k AS doc_id, text, '' AS lang, '' AS source FROM (VALUES {_LITERAL}) t(k, text))"


@query("marker_rates_of_samples", f"WITH {MARKED.replace(SEEDED, _SAMPLES)} SELECT doc_id AS id, words, tells, rate_e2 FROM rated")
def marker_rates_of_samples(spark, sf_dir):
    return markers.counts(tables.passages(spark, 5)).select("id", F.col("words").cast("long").alias("words"), "tells", F.floor(F.col("tells_per_100w") * 100 + 0.5).cast("long").alias("rate_e2"))
