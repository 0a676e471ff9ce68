"""Rewriters, strategies, the closed loop's ends, reports, samples and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosegauge.functions import plain
from prosegauge.operators import reports, rewriting
from prosegauge.sources import tables
from prosegauge.streaming import scores

FORMULAIC = tables.PASSAGES[0]


def docs(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")


def rewriter(spark, change, deterministic=False):
    return rewriting.Rewriter("stub", lambda t, draw: change(t), deterministic)


def outcome(df):
    return {r.doc_id: r for r in df.collect()}


def test_scripted_rewrite():
    assert plain.scripted("Moreover, it works. It rains. We go. They stay.", 0.5).startswith("It works, and it rains.")
    assert plain.scripted("One sentence only.", 0.5) == "One sentence only."
    assert plain.scripted("Various words", 0.3) == "Various words" and plain.scripted("Various words", 0.5) == "different words"
    assert plain.scripted("", 0.5) == ""


def test_surgical_lowers_or_keeps(spark):
    r = docs(spark, FORMULAIC, "", "plain").select("text", rewriting.surgical(F.col("text")).alias("s")).collect()
    assert all(plain.top_score(x.s.text) <= plain.top_score(x.text) for x in r)


def test_loop_ends(spark):
    d = docs(spark, FORMULAIC)
    kept = outcome(rewriting.closed_loop(d, rewriter(spark, lambda t: t, deterministic=True)))[0]
    assert (kept.stopped, kept.iterations, kept.rewrites) == ("stalled", 1, 1)
    again = outcome(rewriting.closed_loop(d, rewriter(spark, lambda t: t), max_iters=3, best_of=2))[0]
    assert (again.stopped, again.iterations, again.rewrites) == ("max_iters", 3, 6)
    low = lambda c: F.when(c.contains("zz"), F.lit(0.1)).otherwise(F.lit(0.9))
    done = outcome(rewriting.closed_loop(d, rewriter(spark, lambda t: F.concat(t, F.lit(" zz"))), score=low))[0]
    assert (done.stopped, done.iterations, done.post_max, done.flagged) == ("passed", 1, 0.1, False)
    first = outcome(rewriting.closed_loop(docs(spark, "zz here"), rewriter(spark, lambda t: t), score=low))[0]
    assert (first.stopped, first.iterations, first.rewrites) == ("passed", 1, 0)
    unsure = outcome(rewriting.closed_loop(d, rewriter(spark, lambda t: F.concat(t, F.lit(" zz"))), score=low, confirm=1, confirm_score=lambda c, k: F.lit(0.8)))[0]
    assert (unsure.stopped, unsure.flagged) == ("passed_unconfirmed", True)
    none = outcome(rewriting.closed_loop(d, None))[0]
    assert (none.stopped, none.final) == ("error", FORMULAIC)


def test_loop_rejects_lost_sentinels_and_meaning(spark):
    low = lambda c: F.when(c.contains("zz"), F.lit(0.1)).otherwise(F.lit(0.9))
    d = docs(spark, "It cost $5.50 in 2020 and that was fine for us all.")
    lost = outcome(rewriting.closed_loop(d, rewriter(spark, lambda t: F.concat(F.regexp_replace(t, "⟦HZ0000⟧", ""), F.lit(" zz"))), score=low, max_iters=2))[0]
    assert (lost.stopped, lost.final) == ("max_iters", "It cost $5.50 in 2020 and that was fine for us all.")
    far = outcome(rewriting.closed_loop(docs(spark, "a b c d"), rewriter(spark, lambda t: F.lit("zz other words entirely")), score=low, max_iters=2))[0]
    assert far.stopped == "max_iters" and far.final == "a b c d"


def test_loop_keeps_facts(spark):
    d = docs(spark, FORMULAIC + " It cost $5.50 in 2020 [12].", "", None)
    r = outcome(rewriting.closed_loop(d, polish=True))
    assert "$5.50 in 2020 [12]" in r[0].final and r[0].post_max <= r[0].pre_max and r[1].final == "" and r[2].final == ""


def test_strategies(spark):
    d = docs(spark, *tables.PASSAGES, "")
    for name, f in rewriting.STRATEGIES.items():
        got = f(d).collect()
        assert len(got) == 6 and all(r.similarity >= 0.5 or r.doc_id == 5 for r in got), name
        if name in ("full_loop", "api_loop"):
            assert all(r.post_max <= r.pre_max and len(r.history) == r.iterations + 1 for r in got)
    failing = rewriting.api_loop(d, rewriter=lambda t: 1 / 0)
    assert sorted(failing.collect()) == sorted(rewriting.full_loop(d).collect())


def test_report_has_thesis_and_hardest(spark):
    rows = [(s, i, 0.9, p, 0.9, 1) for s, p in (("noop", 0.9), ("single_pass", 0.4), ("full_loop", 0.2)) for i in range(4)]
    summary = reports.strategies(spark.createDataFrame(rows, "strategy string, doc_id int, pre_max double, post_max double, similarity double, iterations int"))
    maps = spark.createDataFrame([("full_loop", {"a": 0.9, "b": 0.8}, {"a": 0.2, "b": 0.5})], "strategy string, pre map<string,double>, post map<string,double>")
    text = reports.markdown(summary, reports.per_detector(maps))
    assert "**PASS**" in text and "Hardest scorer: **b**" in text and "| full_loop | 4 | 0.900 | 0.200 | 100%" in text


def test_reward(spark):
    d = spark.createDataFrame([(1, "a faithful plain candidate text", 0.2, 0.9), (2, "", 0.0, 1.0), (3, "go go go go go go", 0.2, 0.5)], "id int, c string, ai double, sim double")
    value = reports.reward(F.col("c"), F.col("ai"), F.col("sim"), reports.fluency(reports.fluency_counts(F.col("c"))))
    assert [r[0] for r in d.select(value).collect()] == [0.8, -1.0, 0.08]


def test_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,score\n"one two three four five, six",0.7\nshort,0.5\n"w w w w w",oops\n"v v v v v",1.5\n')
    got = {r.text: r.label for r in tables.labelled_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"one two three four five, six": 0.7, "v v v v v": 1.0}
    tables.write_jsonl(docs(spark, "é"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).collect()[0].text == "é"


def test_paragraphs_and_fallback(spark):
    assert [r.text for r in tables.paragraphs(docs(spark, "a\n\n b \n\n\n\nc"), "doc_id").collect()] == ["a", "b", "c"]
    assert tables.or_passages(None, spark, 7).count() == 7
    assert tables.non_blank(docs(spark, " ", "x", None)).count() == 1


def test_window_stream(spark, tmp_path):
    df = spark.sql("SELECT id AS doc_id, 'The way is new. The time is now.' AS text, timestamp_seconds(id * 300) AS ts FROM range(12)")
    df.write.parquet(str(tmp_path / "in"))
    s = scores.flagged_by_window(scores.read(spark, str(tmp_path / "in"), df.schema, 10), "ts")
    q = s.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("windows").collect()
    assert got and all(r.n_docs == 2 for r in got)
