"""Literal cases of scoring, markers, locks and hidden characters, and plain recomputations."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosegauge.functions import columns, fixed, plain
from prosegauge.functions.columns import clamp01, e4
from prosegauge.operators import arrow, hidden, locks, markers, reports, rewriting, scoring, similarity

TEXTS = ["One. Two! Three? Done.", "", "   ", "no end", "A. b. C", "It works... truly! Yes?\nNew line. “q” é.", "a b. c", "..."]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")


def test_lite_score_equals_plain_recomputation(spark):
    got = scoring.lite_scores(texts(spark, TEXTS)).orderBy("doc_id").collect()
    assert [r.score for r in got] == [plain.round4(plain.lite(t)) for t in TEXTS]
    assert got[1].score == got[2].score == 0.5


def test_formulaic_reads_higher_than_uneven(spark):
    a = "The work is good. The time is now. The way is new. The day is long."
    b = "Rain. Nobody at the crowded harbour market expected cormorants, let alone forty of them squabbling over herring. Odd."
    r = scoring.lite_scores(texts(spark, [a, b])).orderBy("doc_id").collect()
    assert r[0].score > r[1].score


def test_sentences(spark):
    rows = scoring.sentence_rows(texts(spark, TEXTS)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {0: 4, 3: 1, 4: 3, 5: 5, 6: 2, 7: 1}
    nine = texts(spark, [" ".join(["Go."] * 9)])
    assert scoring.sentence_flags(nine).where("flagged").count() <= 3


@pytest.mark.parametrize(
    ("category", "text", "n"),
    [
        ("em_dash", "a — b - c, 2020 - 2025", 2),
        ("ai_vocab", "We delve into a tapestry; delves do not count, world-class does.", 3),
        ("formulaic_transition", "Moreover, yes. Thus it is. He is thus late.", 2),
        ("steering_opener", "Notably, yes. Notably yes.", 1),
        ("negated_contrast", "It's not a bug, it's a feature. Not only fast but also cheap.", 2),
        ("participial_trailer", "It rose, marking a shift. It rose, marking", 1),
        ("vague_attribution", "Studies show it; experts agree.", 2),
        ("cliche", "In conclusion, only time will tell.", 2),
        ("sycophancy", "Great question! Certainly! Sure, here's one.", 3),
        ("meta_closer", "I hope this helps.", 1),
        ("chatbot_artifact", "[INSERT name] As an AI language model", 2),
        ("inflated_copula", "It serves as a hub and boasts a view.", 2),
        ("hedge_stacking", "It could potentially work and may perhaps not.", 2),
        ("false_range", "Whether you're a cook or a poet, from ancient times to the moon.", 2),
        ("markdown_artifact", "# Go 🚀\nTL;DR yes\n# Plain", 2),
        ("rule_of_three", "Fast. Simple. Bold. Then a much longer sentence follows. One. Two. Three. Four.", 2),
        ("semicolon_crutch", "a; b; c", 2),
    ],
)
def test_marker(spark, category, text, n):
    df = markers.counts(texts(spark, [text, "A plain line about the weather today."]))
    got = [r[0] for r in df.orderBy("doc_id").select(f"n_{category}").collect()]
    assert got == [n, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Moreover", "delve", ". ", "! ", "\n", " ", "it's not a", ", it's b", "é", "—", " - ", "3", "Certainly!", "Notably,", "x"]), max_size=14).map("".join))
def test_patterns_count_as_in_python(text):
    for name, pattern in fixed.CATEGORIES.items():
        python = pattern.replace(fixed.OPENER, r"(?:^|(?<=[.!?]\s))\s*")
        expected = len(re.findall(python, text, re.I | re.M))
        assert _java_count(markers.PATTERNS[name], text) == expected, name


_matchers: dict = {}


def _java_count(pattern: str, text: str) -> int:
    from pyspark import SparkContext

    if SparkContext._active_spark_context is None:
        pytest.skip("no JVM yet")
    m = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern).matcher(text)
    n = 0
    while m.find():
        n += 1
    return n


def test_matches_and_report(spark):
    df = markers.matches(texts(spark, ["We delve; Moreover it serves as hub — yes."]))
    m = df.collect()[0].matches
    assert m["ai_vocab"] == ["delve"] and m["inflated_copula"] == ["serves as"] and m["em_dash"] == ["—"]
    report = markers.rendered(markers.counts(texts(spark, ["delve delve — x"]))).collect()[0].report.split("\n")
    assert report[1].split() == ["ai_vocab", "2"] and report[2].split() == ["em_dash", "1"]


LOCKED = ["plain words", "see [12] and [3, 4]", "Smith (2020) said", "(Lee & Park, 2019, p. 4)", "1,024 is 42% in 3.5 years", 'he said "x y" at https://a.b/c?d=1', "⟦HZ00012⟧ and 77", "", "a 🚀 12 é 34"]


def test_lock_roundtrip(spark):
    df = locks.lock(texts(spark, LOCKED)).withColumn("back", locks.restore(F.col("masked"), F.col("mapping")))
    for r in df.collect():
        assert r.back == r.text
        assert not re.search(r"\d", re.sub(fixed.SENTINEL, "", r.masked)) or r.text == "plain words"


def test_restore_leaves_unknown_and_wide_sentinels(spark):
    df = spark.createDataFrame([("⟦HZ0001⟧ ⟦HZ10000⟧ ⟦HZ0009⟧", {"⟦HZ0001⟧": "$1\\x", "⟦HZ10000⟧": "⟦HZ0001⟧"})], "m string, k map<string,string>")
    assert df.select(locks.restore(F.col("m"), F.col("k"))).first()[0] == "$1\\x ⟦HZ0001⟧ ⟦HZ0009⟧"
    assert df.select(locks.missing_sentinels(F.lit("⟦HZ0001⟧"), F.col("k"))).first()[0] == ["⟦HZ10000⟧"]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("a​b⁠c﻿", "abc"), ("реас", "peac"), ("👨‍👩‍👧", "👨‍👩‍👧"), ("❤️‍🔥", "❤️‍🔥"), ("a‍b", "ab"),
        ("👨‍ x", "👨 x"), ("x²\x07\t\n", "x²\t\n"), ("é", "é"), ("\U000e0041z", "z"), ("👨‍‍👩", "👨👩"),
    ],
)
def test_scrub(spark, text, clean):
    assert texts(spark, [text]).select(hidden.scrub(F.col("text"))).first()[0] == clean


def test_hidden_count_and_generator(spark):
    df = texts(spark, ["peace axe", "a​р"])
    assert [r[0] for r in df.select(hidden.hidden_count(F.col("text"))).collect()] == [0, 2]
    made = df.select(hidden.with_lookalikes(F.col("text"), 0.5).alias("text"))
    assert [r[0] for r in made.select(hidden.hidden_count(F.col("text"))).collect()] == [4, 2]
    assert df.select(hidden.with_lookalikes(F.col("text"), 0)).first()[0] == "peace axe"


def test_dice_and_gate(spark):
    rows = [(1, "a b c d", "a b x y"), (2, "", " "), (3, "", "x"), (4, "Same words here", "same WORDS here"), (5, "!", "?"), (6, "a a b", "a")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r.id: r.similarity for r in similarity.dice(df, "id", "a", "b").collect()}
    assert got == {k: plain.dice(a, b) for k, a, b in rows} and got[1] == 0.5 and got[6] == 0.5


def test_clamp(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(clamp01(F.col("x"))).collect()] == [0.5, None, 1.0, 0.0]
    assert df.select(e4(F.lit(0.29996))).first()[0] == 3000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "and", "dog", "Cat", "don't", "é", "pré", "a.b", "it.", "go!", "'", "_x", "The", "no.yes", ". ", " ", "\n"]), max_size=14).map(" ".join))
def test_importance_equals_rescoring(text):
    base = plain.top_score(text)
    words = dict.fromkeys(m[0] for m in plain.LETTERS.finditer(text))
    full = [(w, base - plain.top_score(re.sub(rf"\b{re.escape(w)}\b", "", text))) for w in words]
    assert plain.importance(text) == sorted(full, key=lambda x: -x[1])


def test_ensemble_excludes_failures(spark):
    rows = [(1, "lite_one", "lite", 0.1, None), (1, "broken", "full", None, "no model"), (1, "silent", "full", None, None), (2, "silent", "full", None, None), (3, "a", "heavy", 0.30004, None), (3, "b", "lite", 0.29996, None)]
    df = spark.createDataFrame(rows, "doc_id int, detector string, tier string, score double, error string").withColumn("score", F.floor(F.col("score") * 10000 + 0.5) / 10000)
    r = {x.doc_id: x for x in scoring.ensemble(df, "doc_id").collect()}
    assert (r[1].max, r[1].tier, r[1].failed, r[1].flagged) == (0.1, "lite", ["broken"], False) and r[1].warning
    assert (r[2].max, r[2].mean, r[2].flagged) == (0.0, 0.0, False)
    assert (r[3].tier, r[3].flagged, r[3].warning) == ("heavy", True, None)


def test_registry_selects_by_tier():
    every = [scoring.Scorer("lite", "lite", lambda c: c), scoring.Scorer("full", "full", lambda c: c), scoring.Scorer("gone", "full", lambda c: c, lambda: False)]
    assert [s.name for s in scoring.selected(every, "full")] == ["lite", "full"]
    assert [s.name for s in scoring.selected(every[1:], "lite")] == [] and [s.name for s in scoring.selected(every, "odd")] == ["lite"]


def test_verdict(spark):
    rows = [(1, "a", 0.1, None), (1, "b", 0.2, None), (2, "a", 0.1, None), (2, "b", 0.31, None), (3, "a", None, "down"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, detector string, score double, error string")
    assert {r.doc_id: (r.passes_all, r.n_configured) for r in scoring.verdict(df, "doc_id").collect()} == {1: (True, 2), 2: (False, 2), 3: (False, 1), 4: (False, 0)}


def test_single_pass_is_one_arrow_call(spark):
    """One Python node and no pattern of the JVM: readings that Spark inlines were worked out over a hundred times a text."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["Moreover, it's numerous. It rained.", None, "", "ſignificant Kelvin. Vaſt amounts of İt."])], "doc_id long, text string")
    out = rewriting.single_pass(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
    for r in out.collect():
        source = dict(docs.collect())[r.doc_id]
        made = None if source is None else plain.scripted(source, 0.5)
        assert (r.text, r.history) == (made, [plain.round4(plain.Counts(t or "").score()) for t in (source, made)])


def test_swaps_read_like_patterns():
    """The look before each swap finds what re.I finds, also letters beyond ASCII that it takes for ASCII ones."""
    texts = ["SIGNIFICANT and ſignificantly varıous", "increaſingly utİlize, uTılizing", "in recent years vast amounts of numerous", "crucial İ, ESSENTİAL ß É", "tend to Tend To"]
    for t in texts:
        out = " ".join(map(plain.without_opener, plain.KEEP.split(t.strip())))
        for word, put in fixed.SWAPS.items():
            out = re.sub(rf"\b{re.escape(word)}\b", put, out, flags=re.I)
        assert plain.scripted(t, 0.5) == out


def test_loop_works_each_plan_out_once():
    """Five rounds of a text that stays flagged come down to two scripted rewrites."""
    assert len({plain.plan(min(1.0, 0.5 + 0.125 * k)) for k in range(5)}) == 2
    assert all(plain.scripted(t, 0.5) == plain.scripted(t, 0.625) and plain.scripted(t, 0.75) == plain.scripted(t, 1.0) for t in ["A b. C d. E f. G h. I j.", "One. Two."])


def test_quick_tokens_are_the_patterns_tokens():
    for t in ["It's 3 o'clock. Naïve—éa b'c!? 9x", "", "ſK İı x", "a b\x85c.  D"]:
        assert [w.decode() for w in plain.tokens(t)] == [w.lower() for w in plain.WORDS.findall(t)]
        assert plain.lite(t) == plain.Counts(t).score()


def test_python_columns_work_in_bounded_pieces(spark):
    """Batches are cut by rows and bytes before any row becomes a Python object, and results leave piece by piece."""
    rows = pa.record_batch({"text": ["x" * 1000] * 3000})
    cut = list(arrow.pieces(iter([rows])))
    assert sum(b.num_rows for b in cut) == 3000 and max(b.num_rows for b in cut) <= arrow.PIECE_ROWS
    assert list(arrow.piece_sizes(3, 30 * arrow.PIECE_BYTES)) == [(0, 1), (1, 1), (2, 1)] and list(arrow.piece_sizes(0, 0)) == []
    docs = texts(spark, ["One thing. Two things.", None, ""] * 700)
    for df in (docs.select(hidden.scrub(F.col("text"))), locks.lock(docs), rewriting.importance_rows(docs), docs.select(rewriting.surgical(F.col("text"))), docs.select(rewriting.dice_of("text", "text"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan and "], 200" not in plan  # 200: a whole batch at once
    assert locks.lock(docs).count() == docs.count() and docs.select(rewriting.dice_of("text", "text").alias("d")).where("d = 1").count() == docs.count()


def test_round_of_the_loop_is_one_arrow_call(spark):
    """Scrubbing, masking and the first reading come from one Python node, and so does a round's draw with its readings."""
    assert rewriting.SURGICAL.plain("") == "" and rewriting.SURGICAL.plain(None) == ""
    docs = texts(spark, ["Moreover, numerous teams utilize it. Crucial 12%.", None])
    same = rewriting.closed_loop(docs).orderBy("doc_id").collect()
    other = rewriting.closed_loop(docs, rewriter=rewriting.Rewriter("surgical", rewriting.SURGICAL.rewrite, deterministic=True), score=lambda c: rewriting.reading(c)).orderBy("doc_id").collect()
    assert same == other


@pytest.mark.parametrize("name", list(markers.PATTERNS))
def test_gate_opens_for_every_match(name):
    """Whatever a category's pattern matches holds one of its keys, in any case and with the letters that re.I takes for ASCII."""
    pattern = re.compile(fixed.CATEGORIES[name].replace(fixed.OPENER, "").replace(".*[", "[^\n]*["), re.I | re.M)
    bit = 1 << list(markers.PATTERNS).index(name)
    swaps = str.maketrans("sSkKiI", "ſſKKıİ")

    @settings(max_examples=80, deadline=None, database=None, derandomize=True)
    @given(st.from_regex(pattern))
    def holds(t):
        assert markers.gates(t) & bit and markers.gates(t.upper()) & bit and markers.gates(t.translate(swaps)) & bit

    holds()
    assert markers.gates("Plain words only; 3 of them.") == 0


def test_markers_run_only_the_patterns_that_may_match(spark):
    """Survey, gates and exact patterns give what each pattern gives over the whole text; sizes and dashes come from the survey."""
    values = [*TEXTS, None, "Fast. Simple. Bold. Done. It is a long one here. A. B. C - D - 3 - 4 — e; f; g.", "VITAL ſeamleſſ pıvotal. Certainly! It's not a b, it's c.\n# x ✅\nThus, from ancient x to the y."]
    docs = texts(spark, values)
    out = markers.counts(docs)
    assert "CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString() and "survey_" not in out.columns
    whole = docs.select("doc_id", *[F.coalesce(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)), F.lit(0)).alias(f"n_{c}") for c, p in markers.PATTERNS.items()])
    names = whole.columns
    assert sorted(out.select(names).collect()) == sorted(whole.collect())
    sizes = docs.select("doc_id", markers.rule_of_three(columns.sentence_sizes(F.col("text"), columns.WORDS)).alias("n_rule_of_three"), columns.count_of(F.col("text"), columns.WORDS).alias("words"), (columns.count_of(F.col("text"), "—") + columns.count_of(F.col("text"), markers.SPACED_HYPHEN)).alias("n_em_dash"))
    assert sorted(out.select(sizes.columns).collect()) == sorted(sizes.collect())


def test_white_space_without_patterns(spark):
    """Trimming and the word bound read what the patterns read, and neither tries a pattern at every place."""
    space = f"[{columns.SPACE}]"
    values = ["", " ", "a b c d e", "\x1c a b\x85c　d  ", "one two three four five six", "​ x ​", "a b c d", "\n\t"]
    docs = texts(spark, values)
    t = F.col("text")
    old = docs.select("doc_id", F.regexp_replace(t, rf"^{space}+|{space}+\z", "").alias("trimmed"), (F.regexp_count(t, F.lit(rf"[^{columns.SPACE}]+")) > 4).alias("more"), (~t.rlike(rf"[^{columns.SPACE}]")).alias("blank"))
    new = docs.select("doc_id", columns.trimmed(t).alias("trimmed"), columns.more_words(t, 4).alias("more"), columns.is_blank(t).alias("blank"))
    assert sorted(new.collect()) == sorted(old.collect()) and "regexp_replace" not in new._jdf.queryExecution().optimizedPlan().toString()
    assert texts(spark, ["x" * 200000]).select(columns.more_words(t, 4)).first()[0] is False


def test_sentences_and_pairs_are_read_once(spark):
    """Sentence readings and word pairs come from one Arrow call, not from arrays that Spark works out at each mention."""
    values = ["The cat sat. the cat sat! It's ok? Naïve the cat.", None, "", "a b a b a"]
    docs = texts(spark, values)
    for df in (scoring.sentence_flags(docs), docs.select(reports.fluency_counts(F.col("text")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
    for r in docs.select("text", reports.fluency_counts(F.col("text")).alias("f")).collect():
        w = [x.lower() for x in plain.LITE.findall(r.text or "")]
        assert tuple(r.f) == (len(w), max(0, len(w) - 1), len(set(zip(w, w[1:], strict=False))))


def test_exploded_markers_run_each_pattern_once(spark, tiny):
    """No filter on the size of a map of counts, which would run every pattern a second time."""
    from prosegauge.plans.queries_text import QUERIES

    pattern = markers.PATTERNS["inflated_copula"]
    for name in ("marker_by_category", "marker_totals_by_category"):
        assert QUERIES[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString().count(pattern) == 1
    plan = QUERIES["marker_matches"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert pattern not in plan and plan.count(markers.PATTERNS["ai_vocab"]) == 1
