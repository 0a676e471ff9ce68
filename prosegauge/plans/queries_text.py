"""Queries over texts: lite score, sentences, markers, hidden characters, locks, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import DROP_SPLIT, LITE_WORDS, SPACE, WORDS, e4, re2
from ..operators import hidden, locks, markers, rewriting, scoring
from ..sources import tables
from .seeds import SEEDED, quoted, seeded


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(tables.read(spark, sf_dir, "documents"))


QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


# --- lite scorer -------------------------------------------------------------------------------------------------------

_COMMON = ", ".join(quoted(w) for w in fixed.COMMON_WORDS)
LITE = f"""{SEEDED},
tokens AS (SELECT doc_id, lang, text, string_split_regex(text, '{DROP_SPLIT}') AS parts, regexp_extract_all(text, {quoted(LITE_WORDS)}) AS w FROM seeded),
lengths AS (SELECT doc_id, lang, text, w, list_filter(list_transform(parts, lambda s: len(regexp_extract_all(s, {quoted(LITE_WORDS)}))), lambda n: n > 0) AS l FROM tokens),
sums AS (SELECT doc_id, lang, text, len(w)::BIGINT AS n_words, len(list_filter(w, lambda x: lower(x) IN ({_COMMON})))::BIGINT AS n_common, len(l)::BIGINT AS n,
                coalesce(list_sum(l), 0)::BIGINT AS s1, coalesce(list_sum(list_transform(l, lambda x: x * x)), 0)::BIGINT AS s2 FROM lengths),
scored AS (SELECT *, floor((CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 0.5::DOUBLE ELSE
    0.6::DOUBLE * (CASE WHEN n < 2 THEN 0.5::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, (0.55::DOUBLE - sqrt((n * s2 - s1 * s1)::DOUBLE) / s1) / 0.55::DOUBLE)) END)
    + 0.4::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, ((CASE WHEN s1 > 0 THEN n_common / s1::DOUBLE ELSE 0 END) - 0.30::DOUBLE) / 0.30::DOUBLE)) END) * 10000 + 0.5::DOUBLE)::BIGINT AS score_e4 FROM sums)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.lite_scores(documents(spark, sf_dir)).withColumn("score_e4", e4(F.col("score")))


@query("lite_score", f"WITH {LITE} SELECT doc_id, n_words, n_common, n AS n_sentences, s1, s2, score_e4, score_e4 >= 3000 AS flagged FROM scored")
def lite_score(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "n_words", "n_common", F.col("lite.n").alias("n_sentences"), "lite.s1", "lite.s2", "score_e4", "flagged")


@query("lite_flag_by_lang", f"WITH {LITE} SELECT lang, count(*) AS n_docs, sum((score_e4 >= 3000)::BIGINT)::BIGINT AS n_flagged, sum(score_e4)::BIGINT AS score_e4_sum FROM scored GROUP BY lang")
def lite_flag_by_lang(spark, sf_dir):
    return scoring.flag_by(scored(spark, sf_dir), "lang")


@query("ai_percent", f"WITH {LITE} SELECT doc_id, floor(score_e4 / 10.0 + 0.5)::BIGINT AS per_mille FROM scored")
def ai_percent(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.floor(F.col("score_e4") / 10 + 0.5).cast("long").alias("per_mille"))


@query("common_word_ratio", f"WITH {LITE} SELECT doc_id, n_common, n_words FROM scored")
def common_word_ratio(spark, sf_dir):
    return scoring.lite_counts(documents(spark, sf_dir)).select("doc_id", "n_common", "n_words")


@query("burstiness_lite", f"WITH {LITE} SELECT doc_id, n, CASE WHEN n < 2 THEN 0 ELSE floor(sqrt((n * s2 - s1 * s1)::DOUBLE) / s1 * 10000 + 0.5::DOUBLE)::BIGINT END AS cv_e4 FROM scored")
def burstiness_lite(spark, sf_dir):
    m = F.col("lite")
    cv = F.when(m["n"] < 2, F.lit(0).cast("long")).otherwise(e4(F.sqrt((m["n"] * m["s2"] - m["s1"] * m["s1"]).cast("double")) / m["s1"]))
    return scoring.lite_counts(documents(spark, sf_dir)).select("doc_id", "lite.n", cv.alias("cv_e4"))


# --- sentences ---------------------------------------------------------------------------------------------------------

_TRIM = f"'^[{SPACE}]+|[{SPACE}]+$'"
KEEP = f"""{SEEDED},
kept AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, {_TRIM}, '', 'g'), '([.!?])[{SPACE}]+', concat('\\1', chr(1)), 'g'), chr(1)),
                                                  lambda s: regexp_replace(s, {_TRIM}, '', 'g')), lambda s: s <> '') AS parts FROM seeded),
sentences AS (SELECT doc_id, unnest(range(0, len(parts))) AS pos, unnest(parts) AS sentence FROM kept)"""


@query("sentence_split_keep", f"WITH {KEEP} SELECT doc_id, pos, md5(sentence) AS digest FROM sentences")
def sentence_split_keep(spark, sf_dir):
    return scoring.sentence_rows(documents(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("sentence").cast("binary")).alias("digest"))


@query(
    "sentence_split_drop",
    f"""WITH {SEEDED}, parts AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{DROP_SPLIT}'), lambda s: regexp_replace(s, {_TRIM}, '', 'g')), lambda s: s <> '') AS p FROM seeded)
SELECT doc_id, unnest(range(0, len(p))) AS pos, md5(unnest(p)) AS digest FROM parts""",
)
def sentence_split_drop(spark, sf_dir):
    return scoring.sentence_rows(documents(spark, sf_dir), keep=False).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("sentence").cast("binary")).alias("digest"))


FLAGS = f"""{KEEP},
c AS (SELECT doc_id, pos, len(regexp_extract_all(sentence, {quoted(LITE_WORDS)})) AS w, len(list_filter(regexp_extract_all(sentence, {quoted(LITE_WORDS)}), lambda x: lower(x) IN ({_COMMON}))) AS k,
             list_filter(list_transform(string_split_regex(sentence, '{DROP_SPLIT}'), lambda s: len(regexp_extract_all(s, {quoted(LITE_WORDS)}))), lambda n: n > 0) AS l, sentence FROM sentences),
s AS (SELECT doc_id, pos, sentence, floor((0.6::DOUBLE * (CASE WHEN len(l) < 2 THEN 0.5::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, (0.55::DOUBLE - sqrt((len(l) * list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l))::DOUBLE) / list_sum(l)) / 0.55::DOUBLE)) END)
        + 0.4::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, ((CASE WHEN w > 0 THEN k / w::DOUBLE ELSE 0 END) - 0.30::DOUBLE) / 0.30::DOUBLE))) * 10000 + 0.5::DOUBLE)::BIGINT AS score_e4 FROM c),
flags AS (SELECT doc_id, pos, sentence, score_e4, row_number() OVER (PARTITION BY doc_id ORDER BY score_e4 DESC, pos) <= greatest(1, (count(*) OVER (PARTITION BY doc_id) + 2) // 3) AND score_e4 >= 3000 AS flagged FROM s)"""


@query("sentence_flags", f"WITH {FLAGS} SELECT doc_id, pos, score_e4, flagged FROM flags")
def sentence_flags(spark, sf_dir):
    return scoring.sentence_flags(documents(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), e4(F.col("score")).alias("score_e4"), "flagged")


@query("flagged_sentences", f"WITH {FLAGS} SELECT doc_id, count(*)::BIGINT AS n, string_agg(sentence, chr(10) ORDER BY pos) AS flagged FROM flags WHERE flagged GROUP BY doc_id")
def flagged_sentences(spark, sf_dir):
    return rewriting.flagged_sentences(documents(spark, sf_dir)).select("doc_id", F.size("flagged").cast("long").alias("n"), F.array_join("flagged", "\n").alias("flagged"))


# --- markers -----------------------------------------------------------------------------------------------------------


def _found(category: str) -> str:
    """SQL count of a category's matches; openers consume their prefix, so marks that end one match are doubled first."""
    text = "replace(text, '!', '!!')" if category == "sycophancy" else "text"
    return f"len(regexp_extract_all({text}, {quoted(re2(fixed.CATEGORIES[category]))}))::BIGINT"


_SIZES = f"list_transform(list_filter(list_transform(string_split_regex(text, '{DROP_SPLIT}'), lambda s: regexp_replace(s, {_TRIM}, '', 'g')), lambda s: s <> ''), lambda s: len(regexp_extract_all(s, {quoted(WORDS)})))"
_SQL = {c: _found(c) for c in fixed.CATEGORIES}
_SQL["em_dash"] = """(len(text) - len(replace(text, '—', '')) + (SELECT count(*) FROM (SELECT unnest(range(1, len(p))) AS i, p FROM (SELECT string_split(text, ' - ') AS p))
  WHERE NOT regexp_matches(p[i], '[0-9]$') AND NOT regexp_matches(p[i + 1], '^[0-9]')))::BIGINT"""
_SQL["semicolon_crutch"] = "CASE WHEN len(text) - len(replace(text, ';', '')) >= 2 THEN (len(text) - len(replace(text, ';', '')))::BIGINT ELSE 0 END"
_SQL["rule_of_three"] = f"len(regexp_extract_all(list_aggregate(list_transform({_SIZES}, lambda n: CASE WHEN n <= 3 THEN 's' ELSE 'l' END), 'string_agg', ''), 's{{3,}}'))::BIGINT"


def _one(category: str):
    def run(spark, sf_dir):
        return markers.counts(documents(spark, sf_dir)).select("doc_id", F.col(f"n_{category}").cast("long").alias("n"))

    return run


for _c in fixed.EVERY_CATEGORY:
    query(f"marker_{_c}", f"WITH {SEEDED} SELECT doc_id, coalesce({_SQL[_c]}, 0) AS n FROM seeded")(_one(_c))

_EACH = ", ".join(f"coalesce({_SQL[c]}, 0) AS n_{c}" for c in fixed.EVERY_CATEGORY)
MARKED = f"""{SEEDED},
each AS (SELECT doc_id, lang, len(regexp_extract_all(text, {quoted(WORDS)}))::BIGINT AS words, {_SIZES} AS sizes, {_EACH} FROM seeded),
marked AS (SELECT *, ({" + ".join(f"n_{c}" for c in fixed.EVERY_CATEGORY)})::BIGINT AS tells, len(sizes) AS n, coalesce(list_sum(sizes), 0)::BIGINT AS s1, coalesce(list_sum(list_transform(sizes, lambda x: x * x)), 0)::BIGINT AS s2 FROM each),
rated AS (SELECT *, CASE WHEN words > 0 THEN floor(tells * 10000 / words::DOUBLE + 0.5::DOUBLE)::BIGINT ELSE 0 END AS rate_e2,
                 CASE WHEN n >= 2 AND s1 > 0 THEN floor(sqrt((n * s2 - s1 * s1)::DOUBLE) / s1 * 10000 + 0.5::DOUBLE)::BIGINT END AS cv_e4 FROM marked)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.counts(documents(spark, sf_dir))


@query("marker_total_rate", f"WITH {MARKED} SELECT doc_id, words, tells, rate_e2 FROM rated")
def marker_total_rate(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", F.col("words").cast("long").alias("words"), "tells", F.floor(F.col("tells_per_100w") * 100 + 0.5).cast("long").alias("rate_e2"))


@query("burstiness_cv", f"WITH {MARKED} SELECT doc_id, cv_e4, coalesce(cv_e4 < 3500, FALSE) AS low FROM rated")
def burstiness_cv(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", e4(F.col("burstiness_cv")).alias("cv_e4"), F.col("low_burstiness").alias("low"))


@query("low_burstiness_share", f"WITH {MARKED} SELECT lang, count(*) AS n_docs, sum(coalesce(cv_e4 < 3500, FALSE)::BIGINT)::BIGINT AS n_low FROM rated GROUP BY lang")
def low_burstiness_share(spark, sf_dir):
    return marked(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.col("low_burstiness").cast("long")).alias("n_low"))


_PAIRS = ", ".join(f"{{'k': '{c}', 'n': n_{c}}}" for c in fixed.EVERY_CATEGORY)


def _by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, category, n). Of an explode Spark infers a filter by the map's size, for which it runs every pattern again; of
    an outer one it does not."""
    return marked(spark, sf_dir).select("doc_id", F.explode_outer("by_category").alias("category", "n")).where("category is not null")


@query("marker_by_category", f"WITH {MARKED}, rows AS (SELECT doc_id, unnest([{_PAIRS}]) AS e FROM rated) SELECT doc_id, e.k AS category, e.n AS n FROM rows WHERE e.n > 0")
def marker_by_category(spark, sf_dir):
    return _by_category(spark, sf_dir).withColumn("n", F.col("n").cast("long"))


@query("marker_totals_by_category", f"WITH {MARKED}, rows AS (SELECT unnest([{_PAIRS}]) AS e FROM rated) SELECT e.k AS category, sum(e.n)::BIGINT AS n, sum((e.n > 0)::BIGINT)::BIGINT AS n_docs FROM rows WHERE e.n > 0 GROUP BY e.k")
def marker_totals_by_category(spark, sf_dir):
    rows = _by_category(spark, sf_dir)
    return rows.groupBy("category").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query("marker_matches", f"WITH {SEEDED}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(re2(fixed.CATEGORIES['ai_vocab']))}, 1)) AS word FROM seeded) SELECT doc_id, lower(word) AS word, count(*) AS n FROM m GROUP BY ALL")
def marker_matches(spark, sf_dir):
    rows = markers.matches(documents(spark, sf_dir), categories=["ai_vocab"]).select("doc_id", F.explode_outer(F.col("matches")["ai_vocab"]).alias("word")).where("word is not null")  # outer: see _by_category
    return rows.groupBy("doc_id", F.lower("word").alias("word")).agg(F.count("*").alias("n"))


_LINES = ", ".join(f"{{'n': n_{c}, 'k': {k}, 'line': '  {c.ljust(22)} ' || n_{c}}}" for k, c in enumerate(fixed.EVERY_CATEGORY))


@query("marker_report", f"""WITH {MARKED}, lines AS (SELECT doc_id, unnest([{_LINES}]) AS e FROM rated),
joined AS (SELECT doc_id, string_agg(e.line, chr(10) ORDER BY e.n DESC, e.k) AS l FROM lines WHERE e.n > 0 GROUP BY doc_id)
SELECT doc_id, 'markers: ' || tells || ' in ' || words || ' words' || chr(10) || coalesce(l, '') AS report FROM rated LEFT JOIN joined USING (doc_id)""")
def marker_report(spark, sf_dir):
    return markers.rendered(marked(spark, sf_dir)).select("doc_id", "report")


# --- hidden characters -------------------------------------------------------------------------------------------------

_CARRIERS = f"[{fixed.INVISIBLE}]|[\\x{{E0000}}-\\x{{E007F}}]"


@query("hidden_char_count", f"WITH {SEEDED} SELECT doc_id, (len(regexp_extract_all(text, '{_CARRIERS}')) + len(text) - len(translate(text, '{fixed.LOOKALIKES}', '')))::BIGINT AS n FROM seeded")
def hidden_char_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", hidden.hidden_count(F.col("text")).cast("long").alias("n"))


@query("scrub_hidden", f"WITH {SEEDED} SELECT doc_id, md5(nfc_normalize(translate(regexp_replace(text, '{_CARRIERS}', '', 'g'), '{fixed.LOOKALIKES}', '{fixed.ASCII_LETTERS}'))) AS digest FROM seeded")
def scrub_hidden(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(hidden.scrub(F.col("text")).cast("binary")).alias("digest"))


@query("lookalike_roundtrip", f"WITH {SEEDED} SELECT doc_id, TRUE AS same, n // 7 AS n_replaced FROM (SELECT doc_id, len(text) - len(translate(text, '{fixed.ASCII_LETTERS}', '')) AS n FROM seeded)")
def lookalike_roundtrip(spark, sf_dir):
    text = hidden.scrubbed(F.col("text"))
    made = documents(spark, sf_dir).select("doc_id", F.col("text").alias("was"), text.alias("clean"), hidden.with_lookalikes(F.col("text"), 0.15).alias("made"))
    return made.select("doc_id", (hidden.scrubbed(F.col("made")) == F.col("clean")).alias("same"), (hidden.hidden_count(F.col("made")) - hidden.hidden_count(F.col("was"))).cast("long").alias("n_replaced"))


# --- locks -------------------------------------------------------------------------------------------------------------


def _locked_sql(name: str) -> str:
    return f"len(regexp_extract_all(text, {quoted(re2(fixed.LOCKED[name], ''))}))::BIGINT"


@query("lock_pattern_counts", f"WITH {SEEDED} SELECT doc_id, {', '.join(f'{_locked_sql(k)} AS n_{k}' for k in fixed.LOCKED)} FROM seeded")
def lock_pattern_counts(spark, sf_dir):
    out = locks.pattern_counts(documents(spark, sf_dir))
    return out.select("doc_id", *[F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in fixed.LOCKED])


@query("lock_roundtrip", f"WITH {SEEDED} SELECT doc_id, TRUE AS restored, TRUE AS sentinels_kept, md5(text) AS digest FROM seeded")
def lock_roundtrip(spark, sf_dir):
    df = locks.lock(documents(spark, sf_dir))
    back = locks.restore(F.col("masked"), F.col("mapping"))
    return df.select("doc_id", (back == F.col("text")).alias("restored"), locks.same_sentinels(F.col("masked"), F.col("mapping")).alias("sentinels_kept"), F.md5(back.cast("binary")).alias("digest"))


@query("lock_span_count")
def lock_span_count(spark, sf_dir):
    df = locks.lock(documents(spark, sf_dir))
    return df.select("doc_id", F.size("mapping").alias("n_spans"), F.aggregate(F.map_values("mapping"), F.lit(0), lambda a, s: a + F.length(s)).alias("n_chars"))


@query("find_sentinels", f"WITH {SEEDED} SELECT doc_id, len(list_distinct(regexp_extract_all(text, '⟦HZ[0-9]{{4,}}⟧')))::BIGINT AS n FROM seeded")
def find_sentinels(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(locks.sentinels(F.col("text"))).cast("long").alias("n"))


_ANY = " OR ".join(f"regexp_matches(text, {quoted(re2(p, ''))})" for p in fixed.LOCKED.values())


@query("missing_sentinels", f"WITH {SEEDED} SELECT doc_id, CASE WHEN {_ANY} THEN '⟦HZ0000⟧' ELSE '' END AS missing FROM seeded")
def missing_sentinels(spark, sf_dir):
    df = locks.lock(documents(spark, sf_dir))
    lost = F.regexp_replace("masked", "⟦HZ0000⟧", "")
    return df.select("doc_id", F.array_join(locks.missing_sentinels(lost, F.col("mapping")), ",").alias("missing"))


@query("span_merge", "SELECT id, spans FROM (VALUES (1, '0-7,9-12'), (2, '0-3'), (3, ''), (4, '1-9')) t(id, spans)")
def span_merge(spark, sf_dir):
    rows = [(1, [(3, 7), (0, 3), (9, 12), (0, 3)]), (2, [(0, 3)]), (3, []), (4, [(1, 9), (2, 4), (8, 9)])]
    df = spark.createDataFrame(rows, "id int, spans array<struct<s:int,e:int>>")
    return df.select("id", F.array_join(F.transform(locks.merge_spans(F.col("spans")), lambda x: F.concat_ws("-", x["s"], x["e"])), ",").alias("spans"))


@query("span_union", "SELECT id, spans FROM (VALUES (1, '0-3,3-7,9-12'), (2, '2-4')) t(id, spans)")
def span_union(spark, sf_dir):
    rows = [(1, [(3, 7), (0, 3)], [(9, 12), (0, 3)]), (2, [], [(2, 4)])]
    df = spark.createDataFrame(rows, "id int, a array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    both = F.array_sort(F.array_distinct(F.concat("a", "b")))
    return df.select("id", F.array_join(F.transform(both, lambda x: F.concat_ws("-", x["s"], x["e"])), ",").alias("spans"))


# --- words -------------------------------------------------------------------------------------------------------------


@query("word_importance")
def word_importance(spark, sf_dir):
    return rewriting.importance_rows(documents(spark, sf_dir)).where("place < 5")  # a top-5 report of each document


@query(
    "leave_one_out",
    f"WITH {SEEDED}, f AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]+') AS word FROM seeded) SELECT doc_id, word, (len(text) - len(regexp_replace(text, '\\b' || word || '\\b', '', 'g')))::BIGINT AS n_removed FROM f WHERE regexp_matches(word, '^[A-Za-z]+$') AND NOT regexp_matches(text, '[^\\x00-\\x7f]')",
)
def leave_one_out(spark, sf_dir):
    f = documents(spark, sf_dir).select("doc_id", "text", F.regexp_extract("text", "[A-Za-z]+", 0).alias("word"))
    f = f.where((F.col("word") != "") & ~F.col("text").rlike(r"[^\x00-\x7f]"))  # SQL's word edges know ASCII only
    return f.select("doc_id", "word", (F.length("text") - F.length(rewriting.without_word(F.col("text"), F.col("word")))).cast("long").alias("n_removed"))


@query("leave_one_out_all")
def leave_one_out_all(spark, sf_dir):
    """leave_one_out on every document with a word, with words and word edges of any script; SQL's know ASCII only."""
    f = documents(spark, sf_dir).select("doc_id", "text", F.regexp_extract("text", r"[\p{L}\p{N}_]+", 0).alias("word")).where("word != ''")
    return f.select("doc_id", "word", (F.length("text") - F.length(rewriting.without_word(F.col("text"), F.col("word")))).cast("long").alias("n_removed"))


_SYN = ", ".join(f"({quoted(k)}, {i + 1}, {quoted(s)})" for k, v in fixed.SYNONYMS.items() for i, s in enumerate(v))


@query("synonym_table", f"WITH {SEEDED}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM seeded) SELECT doc_id, word, place, synonym FROM w JOIN (VALUES {_SYN}) t(entry, place, synonym) ON lower(word) = entry")
def synonym_table(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    known = rewriting.synonyms(words.select("word").distinct(), "word")
    return words.join(known, "word").select("doc_id", "word", "place", "synonym")


@query("homoglyph_fixture", f"WITH {SEEDED} SELECT doc_id, (len(text) - len(translate(text, '{fixed.ASCII_LETTERS}', '')))::BIGINT AS n_eligible FROM seeded")
def homoglyph_fixture(spark, sf_dir):
    made = documents(spark, sf_dir).select("doc_id", "text", hidden.with_lookalikes(F.col("text"), 1.0).alias("made"))
    return made.select("doc_id", (hidden.hidden_count(F.col("made")) - hidden.hidden_count(F.col("text"))).cast("long").alias("n_eligible"))
