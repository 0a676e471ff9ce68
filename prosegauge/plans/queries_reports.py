"""Queries over readings, pairs and results. Readings are made from document ids by integer arithmetic on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import WORDS, clamp01, e4, mean_e4
from ..operators import reports, rewriting, scoring, similarity
from ..sources import tables
from .seeds import SEEDED, quoted, seeded

QUERIES, ORACLE_SQL = {}, {}
SCORERS = [("perplexity_burstiness", "lite"), ("roberta_openai", "full"), ("mage", "full"), ("binoculars", "heavy"), ("gptzero", "commercial")]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


_VALUES = ", ".join(f"({k}, '{d}', '{t}', {fixed.TIERS.index(t)})" for k, (d, t) in enumerate(SCORERS))


def _readings_sql(name: str, factor: int) -> str:
    return f"""{name} AS (SELECT doc_id, k, detector, tier, rank, CASE WHEN (doc_id + k) % 7 <> 0 AND (doc_id + k) % 11 <> 0 AND doc_id % 50 <> 0 THEN (doc_id * {factor} + k * 1013) % 10001 END AS e4,
  CASE WHEN (doc_id + k) % 11 = 0 THEN 'load failed' END AS error FROM documents, (VALUES {_VALUES}) s(k, detector, tier, rank))"""


READINGS = _readings_sql("r", 37)
PHASED = f"{READINGS}, {_readings_sql('r2', 61)}, phased AS (SELECT 'after' AS phase, * FROM r2 UNION ALL SELECT 'before' AS phase, * FROM r)"


def readings(spark: SparkSession, sf_dir: str, factor: int = 37) -> DataFrame:
    """(doc_id, k, detector, tier, score, error): five scorers a document, some out, some failed, some documents without any."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("detector"), F.lit(t).alias("tier")) for k, (d, t) in enumerate(SCORERS)])
    df = tables.read(spark, sf_dir, "documents").select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.*")
    n = F.col("doc_id") + F.col("k")
    live = (n % 7 != 0) & (n % 11 != 0) & (F.col("doc_id") % 50 != 0)
    score = F.when(live, (F.col("doc_id") * factor + F.col("k") * 1013) % 10001 / 10000.0)
    return df.select("doc_id", "k", "detector", "tier", score.alias("score"), F.when(n % 11 == 0, "load failed").alias("error"))


def phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).withColumn("phase", F.lit("before")).unionByName(readings(spark, sf_dir, 61).withColumn("phase", F.lit("after")))


@query(
    "ensemble_readings",
    f"""WITH {READINGS} SELECT doc_id, coalesce(max(e4), 0)::BIGINT AS max_e4, CASE WHEN count(e4) > 0 THEN (2 * sum(e4) + count(e4)) // (2 * count(e4)) ELSE 0 END::BIGINT AS mean_e4,
count(e4) AS n_live, coalesce(max(e4) >= 3000, FALSE) AS flagged, (coalesce(max(e4), 0) + 5) // 10 AS per_mille FROM r GROUP BY doc_id""",
)
def ensemble_readings(spark, sf_dir):
    out = scoring.ensemble(readings(spark, sf_dir), "doc_id")
    per_mille = F.floor((e4(F.col("max")) + 5) / 10).cast("long")
    return out.select("doc_id", e4(F.col("max")).alias("max_e4"), e4(F.col("mean")).alias("mean_e4"), "n_live", "flagged", per_mille.alias("per_mille"))


@query("effective_tier", f"WITH {READINGS}, m AS (SELECT doc_id, max(CASE WHEN e4 IS NOT NULL THEN rank END) AS rank FROM r GROUP BY doc_id) SELECT doc_id, ['lite','full','heavy','commercial'][coalesce(rank, 0) + 1] AS tier FROM m")
def effective_tier(spark, sf_dir):
    return scoring.ensemble(readings(spark, sf_dir), "doc_id").select("doc_id", "tier")


@query(
    "tier_downgrade",
    f"""WITH {READINGS}, m AS (SELECT doc_id, coalesce(max(CASE WHEN e4 IS NOT NULL THEN rank END), 0) AS rank, coalesce(string_agg(CASE WHEN error IS NOT NULL THEN detector END, ',' ORDER BY detector), '') AS failed
  FROM r GROUP BY doc_id) SELECT doc_id, rank < 3 AS downgraded, failed FROM m""",
)
def tier_downgrade(spark, sf_dir):
    out = scoring.ensemble(readings(spark, sf_dir), "doc_id", requested="commercial")
    return out.select("doc_id", F.col("warning").isNotNull().alias("downgraded"), F.array_join("failed", ",").alias("failed"))


@query("tier_registry", "SELECT requested, n FROM (VALUES ('commercial', 14), ('full', 6), ('heavy', 7), ('lite', 1), ('unknown', 1)) t(requested, n)")
def tier_registry(spark, sf_dir):
    every = [scoring.Scorer(n, t, lambda c: c) for n, t in fixed.SCORERS.items()]
    rows = [(t, len(scoring.selected(every, t))) for t in [*fixed.TIERS, "unknown"]]
    return spark.createDataFrame(rows, "requested string, n int")


@query("worst_detectors", f"WITH {READINGS} SELECT doc_id, detector, e4::BIGINT AS score_e4 FROM r WHERE e4 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e4 DESC, detector) <= 3")
def worst_detectors(spark, sf_dir):
    return scoring.worst_detectors(readings(spark, sf_dir), "doc_id").select("doc_id", "detector", e4(F.col("score")).alias("score_e4"))


@query("verdict_all_pass", f"WITH {READINGS} SELECT doc_id, count(*) AS n_configured, sum(coalesce(e4 < 3000, FALSE)::BIGINT)::BIGINT AS n_passing, bool_and(coalesce(e4 < 3000, FALSE)) AS passes_all FROM r GROUP BY doc_id")
def verdict_all_pass(spark, sf_dir):
    return scoring.verdict(readings(spark, sf_dir), "doc_id")


@query("flagged_rate", f"WITH {READINGS} SELECT detector, floor(avg(CASE WHEN e4 >= 3000 THEN 1.0::DOUBLE WHEN e4 IS NOT NULL THEN 0.0 END) * 10000 + 0.5::DOUBLE)::BIGINT AS rate_e4 FROM r GROUP BY detector")
def flagged_rate(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("detector").agg(mean_e4(reports.flagged_rate(F.col("score"))).alias("rate_e4"))


@query("bypass_rate", f"WITH {READINGS} SELECT detector, coalesce(floor(avg(CASE WHEN e4 < 3000 THEN 1.0::DOUBLE WHEN e4 IS NOT NULL THEN 0.0 END) * 10000 + 0.5::DOUBLE), 0)::BIGINT AS rate_e4 FROM r GROUP BY detector")
def bypass_rate(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("detector").agg(mean_e4(reports.bypass_rate(F.col("score"))).alias("rate_e4"))


@query(
    "ceiling_phases",
    f"""WITH {PHASED}, t AS (SELECT phase, doc_id, max(e4) AS top FROM phased GROUP BY ALL) SELECT phase, count(top) AS n, floor(avg(top) + 0.5::DOUBLE)::BIGINT AS mean_e4,
floor(avg(CASE WHEN top >= 3000 THEN 1.0::DOUBLE WHEN top IS NOT NULL THEN 0.0 END) * 10000 + 0.5::DOUBLE)::BIGINT AS rate_e4 FROM t GROUP BY phase""",
)
def ceiling_phases(spark, sf_dir):
    return reports.phases(phased(spark, sf_dir)).select("phase", "n", mean_e4(F.col("mean_max")).alias("mean_e4"), mean_e4(F.col("flagged_rate")).alias("rate_e4"))


@query("ceiling_detectors", f"WITH {PHASED} SELECT phase, detector, floor(avg(e4) + 0.5::DOUBLE)::BIGINT AS mean_e4 FROM phased GROUP BY ALL")
def ceiling_detectors(spark, sf_dir):
    return reports.phase_detectors(phased(spark, sf_dir)).select("phase", "detector", mean_e4(F.col("mean_score")).alias("mean_e4"))


@query("before_after", f"WITH {PHASED} SELECT doc_id, detector, r.e4::BIGINT AS before_e4, r2.e4::BIGINT AS after_e4 FROM (SELECT * FROM r WHERE doc_id % 3 <> 0) r FULL JOIN (SELECT * FROM r2 WHERE doc_id % 5 <> 0) r2 USING (doc_id, detector)")
def before_after(spark, sf_dir):
    both = similarity.before_after(readings(spark, sf_dir).where("doc_id % 3 != 0"), readings(spark, sf_dir, 61).where("doc_id % 5 != 0"), ["doc_id", "detector"])
    return both.select("doc_id", "detector", e4(F.col("before")).alias("before_e4"), e4(F.col("after")).alias("after_e4"))


# --- strategies over stored results ------------------------------------------------------------------------------------

_STRATEGIES = ("noop", "single_pass", "full_loop")
STORED = f"""stored AS (SELECT doc_id, s AS strategy, (doc_id * 41) % 10001 AS pre, (doc_id * 41 * (7 - g) // 7) % 10001 AS post, 10000 - (doc_id * 13 * g) % 4000 AS sim, g AS iters
  FROM documents, (VALUES ('noop', 0), ('single_pass', 1), ('full_loop', 3)) t(s, g))"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(g).alias("g")) for s, g in (("noop", 0), ("single_pass", 1), ("full_loop", 3))])
    df = tables.read(spark, sf_dir, "documents").select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.*")
    post = F.floor(F.col("doc_id") * 41 * (7 - F.col("g")) / 7).cast("long") % 10001
    return df.select("doc_id", "strategy", (F.col("doc_id") * 41 % 10001 / 10000.0).alias("pre_max"), (post / 10000.0).alias("post_max"), ((10000 - F.col("doc_id") * 13 * F.col("g") % 4000) / 10000.0).alias("similarity"), F.col("g").alias("iterations"))


_SUMMARY = f"""{STORED}, summary AS (SELECT strategy, count(*) AS n, floor(avg(pre) + 0.5::DOUBLE)::BIGINT AS pre_e4, floor(avg(post) + 0.5::DOUBLE)::BIGINT AS post_e4,
  floor(avg((post < 3000)::INT) * 10000 + 0.5::DOUBLE)::BIGINT AS bypass_e4, floor(avg(sim) + 0.5::DOUBLE)::BIGINT AS sim_e4, floor(avg(iters) * 10000 + 0.5::DOUBLE)::BIGINT AS iters_e4 FROM stored GROUP BY strategy)"""


@query("strategy_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def strategy_summary(spark, sf_dir):
    s = reports.strategies(stored(spark, sf_dir))
    names = {"pre_e4": "mean_pre_max", "post_e4": "mean_post_max", "bypass_e4": "bypass_rate", "sim_e4": "mean_similarity", "iters_e4": "mean_iterations"}
    return s.select("strategy", "n", *[mean_e4(F.col(v)).alias(k) for k, v in names.items()])


@query("strategy_thesis", f"WITH {STORED}, s AS (SELECT strategy, avg((post < 3000)::INT) AS b, avg(sim) AS m FROM stored GROUP BY 1) SELECT f.b >= p.b AND f.m >= p.m - 200 AS thesis_pass FROM s f, s p WHERE f.strategy = 'full_loop' AND p.strategy = 'single_pass'")
def strategy_thesis(spark, sf_dir):
    return reports.thesis(reports.strategies(stored(spark, sf_dir)))


@query("policy_ab", f"WITH {_SUMMARY} SELECT strategy AS policy, pre_e4, post_e4, bypass_e4, sim_e4 FROM summary WHERE strategy <> 'noop'")
def policy_ab(spark, sf_dir):
    return strategy_summary(spark, sf_dir).where("strategy != 'noop'").select(F.col("strategy").alias("policy"), "pre_e4", "post_e4", "bypass_e4", "sim_e4")


def detector_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results with maps of readings before and after, strategy by document id."""
    side = lambda f: readings(spark, sf_dir, f).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("detector", "score"))).alias("m"))
    both = side(37).withColumnRenamed("m", "pre").join(side(61).withColumnRenamed("m", "post"), "doc_id")
    return both.withColumn("strategy", F.element_at(F.array(*map(F.lit, _STRATEGIES)), (F.col("doc_id") % 3 + 1).cast("int")))


_PER = f"""{PHASED}, per AS (SELECT ['noop','single_pass','full_loop'][doc_id % 3 + 1] AS strategy, detector, avg(CASE WHEN phase = 'before' THEN e4 END) AS pre, avg(CASE WHEN phase = 'after' THEN e4 END) AS post,
  avg(CASE WHEN phase = 'after' AND e4 IS NOT NULL THEN (e4 < 3000)::INT END) AS beat FROM phased GROUP BY ALL)"""


@query("per_detector_beat_rate", f"WITH {_PER} SELECT strategy, detector, floor(pre + 0.5::DOUBLE)::BIGINT AS pre_e4, floor(post + 0.5::DOUBLE)::BIGINT AS post_e4, floor(beat * 10000 + 0.5::DOUBLE)::BIGINT AS beat_e4 FROM per")
def per_detector_beat_rate(spark, sf_dir):
    d = reports.per_detector(detector_maps(spark, sf_dir))
    return d.select("strategy", "detector", mean_e4(F.col("mean_pre")).alias("pre_e4"), mean_e4(F.col("mean_post")).alias("post_e4"), mean_e4(F.col("beat_rate")).alias("beat_e4"))


@query("hardest_detector", f"WITH {_PER} SELECT strategy, detector FROM per QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY beat, post DESC, detector) = 1")
def hardest_detector(spark, sf_dir):
    return reports.hardest(reports.per_detector(detector_maps(spark, sf_dir))).select("strategy", "detector")


@query(
    "technique_comparison",
    f"""WITH {STORED} SELECT strategy AS technique, CASE WHEN strategy <> 'full_loop' THEN floor(avg(post) + 0.5::DOUBLE)::BIGINT END AS ai_e4, CASE WHEN strategy <> 'full_loop' THEN sum(doc_id % 17)::BIGINT END AS tells_total,
CASE WHEN strategy = 'noop' THEN 10000 WHEN strategy <> 'full_loop' THEN floor(avg(sim) + 0.5::DOUBLE)::BIGINT END AS sim_e4, CASE WHEN strategy = 'full_loop' THEN 'ImportError: none' END AS error FROM stored GROUP BY strategy""",
)
def technique_comparison(spark, sf_dir):
    rows = stored(spark, sf_dir).select(F.col("strategy").alias("technique"), F.col("post_max").alias("score"), (F.col("doc_id") % 17).alias("tells"), (F.col("doc_id") % 17 / 2.0).alias("tells_per_100w"), "similarity", F.when(F.col("strategy") == "full_loop", "ImportError: none").alias("error"))
    t = reports.techniques(rows, "noop")
    return t.select("technique", mean_e4(F.col("ai_max_mean")).alias("ai_e4"), "tells_total", mean_e4(F.col("sim_mean")).alias("sim_e4"), "error")


@query("best_of_n", f"WITH {READINGS} SELECT doc_id, arg_min(k, e4 * 10 + k)::INT AS draw, min(e4)::BIGINT AS score_e4 FROM r WHERE e4 IS NOT NULL GROUP BY doc_id")
def best_of_n(spark, sf_dir):
    c = readings(spark, sf_dir).select("doc_id", F.col("k").alias("draw"), "score", F.col("score").isNotNull().alias("valid"))
    return rewriting.best_of(c, "doc_id").select("doc_id", "draw", e4(F.col("score")).alias("score_e4"))


@query("first_n", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def first_n(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(25)


# --- pairs -------------------------------------------------------------------------------------------------------------

PAIRS = f"""pairs AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b FROM conversations QUALIFY a IS NOT NULL),
ta AS (SELECT conv_id, turn, lower(unnest(regexp_extract_all(a, {quoted(WORDS)}))) AS w FROM pairs), tb AS (SELECT conv_id, turn, lower(unnest(regexp_extract_all(b, {quoted(WORDS)}))) AS w FROM pairs),
ca AS (SELECT conv_id, turn, w, count(*) AS n FROM ta GROUP BY ALL), cb AS (SELECT conv_id, turn, w, count(*) AS n FROM tb GROUP BY ALL),
sums AS (SELECT conv_id, turn, coalesce(sum(least(coalesce(ca.n, 0), coalesce(cb.n, 0))), 0)::BIGINT AS common, coalesce(sum(coalesce(ca.n, 0) + coalesce(cb.n, 0)), 0)::BIGINT AS total
  FROM ca FULL JOIN cb USING (conv_id, turn, w) GROUP BY ALL),
dice AS (SELECT conv_id, turn, coalesce(common, 0) AS common, coalesce(total, 0) AS total FROM pairs LEFT JOIN sums USING (conv_id, turn))"""


def turn_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.turn_pairs(tables.read(spark, sf_dir, "conversations")).withColumn("key", F.struct("conv_id", "turn"))
    return similarity.dice(pairs, "key", "source", "rewrite").select("key.*", "common", "total", "similarity")


@query("turn_pairs", "SELECT conv_id, turn, md5(a) AS source, md5(b) AS rewrite FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b FROM conversations) WHERE a IS NOT NULL")
def turn_pairs(spark, sf_dir):
    pairs = similarity.turn_pairs(tables.read(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", F.md5(F.col("source").cast("binary")).alias("source"), F.md5(F.col("rewrite").cast("binary")).alias("rewrite"))


@query("dice_pairs", f"WITH {PAIRS} SELECT conv_id, turn, common, total FROM dice")
def dice_pairs(spark, sf_dir):
    return turn_dice(spark, sf_dir).select("conv_id", "turn", "common", "total")


@query("gate_pass", f"WITH {PAIRS} SELECT conv_id, turn, total = 0 OR 4 * common >= total AS passes FROM dice")
def gate_pass(spark, sf_dir):
    return turn_dice(spark, sf_dir).select("conv_id", "turn", similarity.passes(F.col("similarity"), F.lit("token_overlap")).alias("passes"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * 1.0::DOUBLE)"


@query("cosine_pairs", f"SELECT a.vec_id, floor(greatest(0, least(1, {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}))) * 10000 + 0.5::DOUBLE)::BIGINT AS cosine_e4 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    e = tables.read(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", e4(similarity.cosine(F.col("embedding"), F.col("other"))).alias("cosine_e4"))


@query("similarity_dispatch", "SELECT id, e4 FROM (VALUES (1, 10000), (2, 0), (3, 8100), (4, 5000), (5, 0)) t(id, e4)")
def similarity_dispatch(spark, sf_dir):
    rows = [(1, 0.2, 0.1, True, True), (2, 0.9, 0.9, True, False), (3, 0.2, 0.81, False, False), (4, 0.5, None, False, False), (5, 0.3, -0.4, False, False)]
    df = spark.createDataFrame(rows, "id int, d double, c double, blank_a boolean, blank_b boolean")
    return df.select("id", e4(similarity.similarity(F.col("d"), F.col("c"), F.col("blank_a"), F.col("blank_b"))).cast("int").alias("e4"))


@query("bar_confidence", "SELECT * FROM (VALUES ('embedding', 7600::BIGINT, 'high'), ('token_overlap', 5000::BIGINT, 'low')) t(metric, bar_e4, confidence)")
def bar_confidence(spark, sf_dir):
    df = spark.createDataFrame([("embedding",), ("token_overlap",)], "metric string")
    return df.select("metric", e4(similarity.bar(F.col("metric"))).alias("bar_e4"), similarity.confidence(F.col("metric")).alias("confidence"))


@query("prompt_lookup", "SELECT doc_id, coalesce(source, lang) AS source FROM (SELECT doc_id, lang FROM documents) d LEFT JOIN (VALUES ('en', 'English'), ('de', 'Deutsch')) t(lang, source) USING (lang)")
def prompt_lookup(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "lang")
    return similarity.lookup(docs, spark.createDataFrame([("en", "English"), ("de", "Deutsch")], "lang string, source string"), "lang", "source").select("doc_id", "source")


# --- rewards -----------------------------------------------------------------------------------------------------------

FLUENT = f"""{SEEDED}, w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)) AS w FROM seeded),
fluent AS (SELECT doc_id, len(w)::BIGINT AS words, greatest(len(w) - 1, 0)::BIGINT AS bigrams,
  CASE WHEN len(w) > 1 THEN len(list_distinct(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2]))) ELSE 0 END::BIGINT AS distinct_ FROM w)"""


def fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded(tables.read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", reports.fluency_counts(F.col("text")).alias("f"))


@query("bigram_fluency", f"WITH {FLUENT} SELECT doc_id, words, bigrams, distinct_ AS n_distinct FROM fluent")
def bigram_fluency(spark, sf_dir):
    return fluent(spark, sf_dir).select("doc_id", *[F.col(f"f.{a}").cast("long").alias(b) for a, b in (("words", "words"), ("bigrams", "bigrams"), ("distinct", "n_distinct"))])


_REWARD = """floor(((1.0::DOUBLE - ai) - CASE WHEN sim >= 0.76::DOUBLE THEN 0.0::DOUBLE ELSE (0.76::DOUBLE - sim) * 2 END
  - 0.25::DOUBLE * (1.0::DOUBLE - CASE WHEN words < 4 THEN 1.0::DOUBLE ELSE distinct_ / greatest(bigrams, 1)::DOUBLE END)) * 10000 + 0.5::DOUBLE)::BIGINT"""


@query("reward", f"WITH {FLUENT}, x AS (SELECT *, (doc_id * 37) % 10001 / 10000::DOUBLE AS ai, (doc_id * 53) % 10001 / 10000::DOUBLE AS sim FROM fluent) SELECT doc_id, {_REWARD} AS reward_e4 FROM x")
def reward(spark, sf_dir):
    value = reports.reward(F.col("text"), F.col("doc_id") * 37 % 10001 / 10000.0, F.col("doc_id") * 53 % 10001 / 10000.0, reports.fluency(F.col("f")))
    return fluent(spark, sf_dir).select("doc_id", e4(value).alias("reward_e4"))


@query("group_rewards", f"WITH {FLUENT}, x AS (SELECT *, (doc_id * 37 + g * 911) % 10001 / 10000::DOUBLE AS ai, 0.9::DOUBLE AS sim FROM fluent, (VALUES (0), (1), (2)) t(g)) SELECT doc_id // 10 AS source_id, count(*) AS n, max({_REWARD}) AS best_e4 FROM x GROUP BY ALL")
def group_rewards(spark, sf_dir):
    df = fluent(spark, sf_dir).withColumn("g", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    value = reports.reward(F.col("text"), (F.col("doc_id") * 37 + F.col("g") * 911) % 10001 / 10000.0, F.lit(0.9), reports.fluency(F.col("f")))
    return df.groupBy(F.floor(F.col("doc_id") / 10).cast("long").alias("source_id")).agg(F.count("*").alias("n"), F.max(e4(value)).alias("best_e4"))


# --- stored model outputs and responses --------------------------------------------------------------------------------


@query("clamp01", "SELECT id, e4 FROM (VALUES (1, 5000::BIGINT), (2, 0), (3, 10000), (4, 2500), (5, 10000), (6, 0)) t(id, e4)")
def clamp01_literals(spark, sf_dir):
    rows = [(1, float("nan")), (2, -3.0), (3, 1.5), (4, 0.25), (5, float("inf")), (6, float("-inf"))]
    return spark.createDataFrame(rows, "id int, x double").select("id", e4(clamp01(F.col("x"))).alias("e4"))


@query(
    "provider_payloads",
    """SELECT id, provider, e4::BIGINT AS e4 FROM (VALUES (1, 'originality', 9100), (2, 'winston', 2000), (3, 'gptzero', 8800), (4, 'gptzero', 4000), (5, 'gptzero', 5000), (6, 'sapling', 3300),
(7, 'zerogpt', 7500), (8, 'copyleaks', 10000), (9, 'sapling', NULL)) t(id, provider, e4)""",
)
def provider_payloads(spark, sf_dir):
    rows = [
        (1, "originality", '{"score": {"ai": 0.91}}'), (2, "winston", '{"score": 80}'), (3, "gptzero", '{"documents": [{"class_probabilities": {"ai": 0.88}}]}'),
        (4, "gptzero", '{"documents": [{"completely_generated_prob": 0.4}]}'), (5, "gptzero", '{"documents": [{"other": 1}]}'), (6, "sapling", '{"score": 0.33}'),
        (7, "zerogpt", '{"data": {"is_gpt_generated": 75}}'), (8, "copyleaks", '{"summary": {"ai": 1.2}}'), (9, "sapling", '{"error": "quota"}'),
    ]
    df = spark.createDataFrame(rows, "id int, provider string, body string")
    return df.select("id", "provider", e4(scoring.provider_score(F.col("provider"), F.col("body"))).alias("e4"))


@query("judge_replies", "SELECT id, e4::BIGINT AS e4 FROM (VALUES (1, 7300), (2, 7300), (3, 10000), (4, NULL), (5, 200), (6, 10000), (7, 5000)) t(id, e4)")
def judge_replies(spark, sf_dir):
    rows = [(1, "0.73"), (2, "I would say 73%"), (3, "1.4"), (4, "no idea"), (5, "2"), (6, "250"), (7, ".5 of it")]
    return spark.createDataFrame(rows, "id int, reply string").select("id", e4(scoring.judge_score(F.col("reply"))).alias("e4"))


@query("web_percentages", "SELECT id, e4::BIGINT AS e4 FROM (VALUES (1, 10000), (2, 5500), (3, NULL), (4, NULL), (5, 1250)) t(id, e4)")
def web_percentages(spark, sf_dir):
    rows = [(1, "100%AI GPT*"), (2, "55 % generated"), (3, "none"), (4, "1.2.3% odd"), (5, "12.5% and 90%")]
    return spark.createDataFrame(rows, "id int, shown string").select("id", e4(scoring.percent_score(F.col("shown"))).alias("e4"))


@query("scan_ids", f"WITH {SEEDED} SELECT doc_id, 'hz' || substr(sha1(text), 1, 20) AS scan_id FROM seeded")
def scan_ids(spark, sf_dir):
    return seeded(tables.read(spark, sf_dir, "documents")).select("doc_id", scoring.scan_id(F.col("text")).alias("scan_id"))


@query(
    "perplexity_score",
    """WITH p AS (SELECT doc_id, [((doc_id * 7) % 90)::DOUBLE, ((doc_id * 11) % 70)::DOUBLE, 40.0::DOUBLE] AS p FROM documents), m AS (SELECT doc_id, p, (p[1] + p[2] + p[3]) / 3 AS mean FROM p)
SELECT doc_id, floor(greatest(0, least(1, 0.7::DOUBLE * greatest(0, least(1, (60 - mean) / 60)) + 0.3::DOUBLE * greatest(0, least(1, (400 - ((p[1] - mean) * (p[1] - mean) + (p[2] - mean) * (p[2] - mean) + (p[3] - mean) * (p[3] - mean)) / 3) / 400)))) * 10000 + 0.5::DOUBLE)::BIGINT AS e4 FROM m""",
)
def perplexity_score(spark, sf_dir):
    p = F.array((F.col("doc_id") * 7 % 90).cast("double"), (F.col("doc_id") * 11 % 70).cast("double"), F.lit(40.0))
    return tables.read(spark, sf_dir, "documents").select("doc_id", e4(scoring.perplexity_score(p)).alias("e4"))


@query("logistic_scores", """SELECT doc_id, floor(1 / (1 + exp(-(z - 1.0::DOUBLE) * 1.2::DOUBLE)) * 10000 + 0.5::DOUBLE)::BIGINT AS curvature_e4, floor(1 / (1 + exp((z - 0.9::DOUBLE) / 0.08::DOUBLE)) * 10000 + 0.5::DOUBLE)::BIGINT AS ratio_e4,
floor(1 / (1 + exp(-z)) * 10000 + 0.5::DOUBLE)::BIGINT AS logit_e4 FROM (SELECT doc_id, (doc_id % 401 - 200) / 100::DOUBLE AS z FROM documents)""")
def logistic_scores(spark, sf_dir):
    z = (F.col("doc_id") % 401 - 200) / 100.0
    df = tables.read(spark, sf_dir, "documents").select("doc_id", z.alias("z"))
    z = F.col("z")
    return df.select("doc_id", e4(scoring.curvature_score(z)).alias("curvature_e4"), e4(scoring.ratio_score(z)).alias("ratio_e4"), e4(scoring.logit_score(z)).alias("logit_e4"))


@query("classifier_labels", "SELECT id, e4::BIGINT AS e4 FROM (VALUES (1, 9000), (2, 2000), (3, 7000), (4, 4000), (5, 6000), (6, 3000), (7, 8000)) t(id, e4)")
def classifier_labels(spark, sf_dir):
    rows = [(1, "roberta_openai", "Fake", 0.9), (2, "roberta_openai", "Real", 0.8), (3, "mage", "machine-generated", 0.7), (4, "mage", "LABEL_1", 0.6), (5, "hc3_roberta", "LABEL_1", 0.6), (6, "radar", "LABEL_1", 0.7), (7, "radar", "LABEL_0", 0.8)]
    df = spark.createDataFrame(rows, "id int, scorer string, label string, p double")
    return df.select("id", e4(scoring.label_score(F.col("scorer"), F.col("label"), F.col("p"))).alias("e4"))
