"""Model scorers and rewriters that fail, token-level scores, the loop's feedback, and files of other kinds."""

from __future__ import annotations

import io
import json
import math
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from prosegauge.functions import fixed, plain
from prosegauge.operators import models, rewriting, scoring, similarity
from prosegauge.plans import registry
from prosegauge.plans.queries_text import documents
from prosegauge.sources import tables

from .test_loops import FORMULAIC, docs, outcome


def stub_load():
    return {"word": "machine"}


def stub_score(model, texts):
    if any("broken" in t for t in texts):
        raise ValueError("x" * 500)
    return [None if "silent" in t else 0.9 if model["word"] in t else float("nan") if "odd" in t else 0.2 for t in texts]


def no_model():
    raise RuntimeError("no weights here")


def no_column(c):
    raise KeyError("not built")


def test_failing_scorers_do_not_fail_the_query(spark):
    df = docs(spark, "a machine text", "a broken text", "a silent text", "an odd text", None)
    scorers = [
        scoring.Scorer("lite", "lite", lambda c: F.lit(0.123456)), scoring.Scorer("unbuilt", "full", no_column), scoring.Scorer("unknown", "full", lambda c: F.col("nowhere")),
        models.ModelScorer("stub", "full", stub_load, stub_score), models.ModelScorer("unloaded", "heavy", no_model, stub_score),
        models.python_scorer("each", "full", lambda t: 1 / (len(t) - len("a broken text"))),
    ]
    got = {(r.doc_id, r.detector): r for r in scoring.readings(df, scorers).collect()}
    assert len(got) == 5 * 6 and got[0, "lite"].score == 0.1235
    assert [got[i, "stub"].score for i in range(5)] == [0.9, None, None, 0.5, 0.2]
    assert got[1, "stub"].error.startswith("ValueError: xxx") and len(got[1, "stub"].error) == 140 and got[2, "stub"].error is None
    assert {got[i, "unloaded"].error for i in range(5)} == {"RuntimeError: no weights here"}
    assert got[1, "each"].error.startswith("ZeroDivisionError") and got[0, "each"].error is None and got[0, "each"].score == 1.0
    assert got[0, "unbuilt"].error == "KeyError: 'not built'" and "nowhere" in got[3, "unknown"].error
    told = {r.doc_id: r for r in scoring.ensemble(scoring.readings(df, scorers), "doc_id", requested="heavy").collect()}
    assert told[1].failed == ["each", "stub", "unbuilt", "unknown", "unloaded"] and told[1].max == 0.1235 and told[1].tier == "lite" and told[1].warning
    assert told[0].max == 1.0 and told[0].tier == "full"


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    mark = str(tmp_path / "loads")

    def load():
        with open(mark, "a") as f:
            f.write("x")
        return 1

    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).coalesce(1)
    scorers = [models.ModelScorer("counted", "full", load, lambda m, texts: [0.5] * len(texts))]
    for _ in range(2):
        assert scoring.readings(df, scorers).where("score = 0.5").count() == 400
    assert 1 <= len(open(mark).read()) <= 4  # the session's workers, not its batches or queries


def lengths(model, texts):
    if any("fail" in t for t in texts):
        raise ValueError("cannot read")
    return [[-math.log(len(w) + 1) for w in t.split()] for t in texts]


def test_perplexities_and_dispatch(spark):
    df = docs(spark, "Two words here. One. Then four more words.", "", "will fail", "Plain words follow here.")
    token = models.TokenModel(stub_load, lengths)
    got = {r.doc_id: r.perplexities for r in models.perplexities(df, token).collect()}
    want = [math.exp(sum(math.log(len(w) + 1) for w in s.split()) / len(s.split())) for s in ("Two words here.", "Then four more words.")]
    assert got[0] == pytest.approx([want[0], 100.0, want[1]]) and got[1] == [] and got[2] is None
    by = {use: {r.doc_id: (r.score, r.scored_by) for r in models.perplexity_or_lite(df, token, use).collect()} for use in ("auto", "model", "lite")}
    assert {k: v[1] for k, v in by["auto"].items()} == {0: "model", 1: "lite", 2: "lite", 3: "model"}
    assert by["model"][2] == (None, None) and by["model"][0] == by["auto"][0] and by["auto"][2] == by["lite"][2]
    assert {v[0] for v in by["lite"].values()} == {plain.round4(plain.lite(r.text)) for r in df.collect()}
    failing = models.TokenModel(no_model, lengths)
    assert {r.scored_by for r in models.perplexity_or_lite(df, failing).collect()} == {"lite"} and models.perplexity_or_lite(df).columns == ["doc_id", "text", "score", "scored_by"]
    with pytest.raises(ValueError, match="not gpu"):
        models.perplexity_or_lite(df, token, "gpu")


def test_token_level_scores(spark):
    rows = [(1, [-1.0, -2.0, -0.5], [-1.5, -1.5, -1.0], [0.25, 1.0, 0.04], [1.0, 2.0, 1.5]), (2, [-1.0], [-1.0], [1.0], [1.0]), (3, [], [], [], [])]
    df = spark.createDataFrame(rows, "id int, logp array<double>, mean array<double>, var array<double>, cross array<double>")
    got = {r.id: (r.z, r.ratio) for r in df.select("id", models.curvature(F.col("logp"), F.col("mean"), F.col("var")).alias("z"), models.perplexity_ratio(F.col("logp"), F.col("cross")).alias("ratio")).collect()}
    z = sum((a - m) / math.sqrt(v + 1e-8) for a, m, v in zip(*rows[0][1:4], strict=True)) / 3
    assert got[1] == pytest.approx((z, 3.5 / 4.5)) and got[2] == got[3] == (None, None)


def test_flagged_sentences_in_a_row(spark):
    df = docs(spark, *tables.PASSAGES, "", "One. Two! Three? Done.", None, " ".join(["The way is new."] * 9))
    rows = scoring.sentence_flags(df).where("flagged").orderBy("doc_id", "pos").collect()
    want: dict = {}
    for r in rows:
        want.setdefault(r.doc_id, []).append(r.sentence)
    got = df.select("doc_id", scoring.flagged_array(F.col("text")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got if r.s} == want and len(got) == 9


def test_loop_tells_the_rewriter(spark):
    asked = rewriting.python_rewriter("told", lambda t, p: t + " zz" if "Voice: dry" in p and "  - Moreover" in p and "P=0.90" in p else 1 / 0)
    low = lambda c: F.when(c.contains("zz"), F.lit(0.1)).otherwise(F.lit(0.9))
    done = outcome(rewriting.closed_loop(docs(spark, FORMULAIC), asked, score=low, style="dry", tier="full", bar=0.4))[0]
    assert (done.stopped, done.final, done.tier, done.sim_bar, done.quality_metric) == ("passed", FORMULAIC + " zz", "full", 0.4, "token")
    silent = outcome(rewriting.closed_loop(docs(spark, FORMULAIC), asked, score=low))[0]
    assert (silent.stopped, silent.final, silent.iterations, silent.rewrites, silent.post_max) == ("error", FORMULAIC, 1, 1, 0.9)


def test_loop_keeps_what_later_draws_leave(spark):
    low = lambda c: F.when(c.contains("zz"), F.lit(0.1)).otherwise(F.lit(0.9))
    second = rewriting.Rewriter("second fails", lambda t, draw: F.when(draw == 0, F.concat(t, F.lit(" zz"))))
    done = outcome(rewriting.closed_loop(docs(spark, FORMULAIC), second, score=low, best_of=2))[0]
    assert (done.stopped, done.final, done.rewrites) == ("passed", FORMULAIC + " zz", 2)
    first = rewriting.Rewriter("first fails", lambda t, draw: F.when(draw == 1, F.concat(t, F.lit(" zz"))))
    lost = outcome(rewriting.closed_loop(docs(spark, FORMULAIC), first, score=low, best_of=2, polish=True))[0]
    assert (lost.stopped, lost.final) == ("error", FORMULAIC)


def test_loop_confirms_what_it_scores(spark):
    """Of restored texts the confirming reading sees the restored text too."""
    high = lambda c: F.when(c.contains("2020") & c.contains("zz"), F.lit(0.1)).otherwise(F.lit(0.9))
    d = docs(spark, "It cost $5.50 in 2020 and that was fine for us all.")
    add = rewriting.Rewriter("add", lambda t, _: F.concat(t, F.lit(" zz")))
    restored = outcome(rewriting.closed_loop(d, add, score=high, score_on="restored", confirm=2, max_iters=1))[0]
    masked = outcome(rewriting.closed_loop(d, add, score=high, confirm=1, max_iters=1))[0]
    assert (restored.stopped, restored.post_max) == ("passed", 0.1) and masked.stopped == "max_iters"


def test_synonyms_can_be_extended(spark):
    words = spark.createDataFrame([("Robust",), ("zebra",), ("unknown",)], "word string")
    got = {(r.word, r.place): r.synonym for r in rewriting.synonyms(words, "word", more={"robust": ["SOLID", "firm", "stout", "hardy", "tough", "stable"], "Zebra": ["horse"]}).collect()}
    assert [got["Robust", k] for k in range(1, 7)] == ["solid", "sturdy", "firm", "stout", "hardy", "tough"] and got["zebra", 1] == "horse" and len(got) == 7
    assert rewriting.extended(lambda w: [w + "ly"])["robust"] == [*fixed.SYNONYMS["robust"], "robustly"]


def test_files_of_other_kinds(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One é</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.DOCX").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-")
    (tmp_path / "d.txt").write_text("plain é\nline")
    (tmp_path / "e.txt").write_bytes(b"\xff\xfe\x00")
    got = {r.path.rsplit("/", 1)[-1]: r for r in tables.documents_in_files(spark, str(tmp_path)).collect()}
    assert got["a.DOCX"].text == "One é\ttwo\nThree" and got["d.txt"].text == "plain é\nline" and len(got) == 5
    assert all(got[n].text is None and got[n].error for n in ("b.docx", "c.pdf", "e.txt")) and got["d.txt"].error is None


def test_json_in_ascii(spark):
    values = ["plain", "é “q” \n \\u00e9", "🚀 a 👨‍👩‍👧", "", "ÿ "]
    rows = tables.to_json(spark.createDataFrame(list(enumerate(values)), "id int, t string"), ascii_only=True).collect()
    assert all(r.value.isascii() for r in rows) and sorted(json.loads(r.value)["t"] for r in rows) == sorted(values)
    assert {r.value for r in rows} >= {json.dumps({"id": 2, "t": values[2]}, separators=(",", ":"))}


def test_samples_and_lookup(spark):
    rows = spark.createDataFrame([(i, 1.0 if i % 5 == 0 else 0.0) for i in range(100)], "k int, label double")
    assert sorted(r.k for r in tables.balanced(rows, "k", 10).collect()) == [0, 1, 2, 3, 4, 5, 6, 10, 15, 20]
    got = sorted(r.k for r in tables.stream_sample(rows, "k", 20).collect())
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 10, 15, 20, 25]
    table = spark.createDataFrame([("a", "z"), ("a", "b"), ("c", "d")], "k string, v string")
    assert {r.k: r.v for r in similarity.lookup(spark.createDataFrame([("a",), ("x",)], "k string"), table, "k", "v").collect()} == {"a": "b", "x": "x"}


# --- queries without SQL, recomputed -----------------------------------------------------------------------------------


def md5(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def seeded_texts(spark, tiny):
    return {r.doc_id: r.text for r in documents(spark, tiny).collect()}


def test_word_importance_equals_rescoring(spark, tiny, seeded_texts):
    got: dict = {}
    for r in registry.QUERIES["word_importance"](spark, tiny).collect():
        got.setdefault(r.doc_id, []).append(r)
    checked = 0
    for i, text in seeded_texts.items():
        if text and len(text) < 1500:
            base = plain.top_score(text)
            each = [(w, round((base - plain.top_score(re.sub(rf"\b{re.escape(w)}\b", "", text))) * 10000)) for w in dict.fromkeys(re.findall("[A-Za-z]+", text))]
            want = sorted(each, key=lambda x: -x[1])
            rows = {(r.word, r.drop_e4) for r in got.get(i, [])}
            assert rows <= set(want) and (not want or rows), i
            checked += 1
    assert checked > 30


def test_strategies_equal_their_rules(spark, tiny, seeded_texts):
    single = {r.doc_id: r for r in registry.QUERIES["strategy_single_pass"](spark, tiny).collect()}
    full = {r.doc_id: r for r in registry.QUERIES["strategy_full_loop"](spark, tiny).collect()}
    for i, text in seeded_texts.items():
        e4 = lambda t: round(plain.round4(plain.lite(t)) * 10000)
        out = plain.scripted(text, 0.5)
        assert (single[i].digest, single[i].iterations, single[i].pre_e4, single[i].post_e4) == (md5(out), 1, e4(text), e4(out))
        drawn = [plain.scripted(text, 0.5 + 0.125 * k) for k in range(5)]
        best, rounds = text, 0
        for rounds, candidate in enumerate(drawn, 1):
            if plain.dice(text, candidate) >= 0.5 and e4(candidate) <= e4(best):
                best = candidate
            if e4(best) < 3000:
                break
        assert (full[i].digest, full[i].iterations, full[i].post_e4) == (md5(best), rounds, e4(best))


def test_loop_results_hold_together(spark, tiny, seeded_texts):
    """Of the closed loop over the whole table: what it reports is what its text reads, and facts are kept."""
    from prosegauge.operators.hidden import scrub

    df = documents(spark, tiny)
    clean = {r.doc_id: r.c for r in df.select("doc_id", scrub(F.col("text")).alias("c")).collect()}
    rows = rewriting.closed_loop(df).collect()
    assert {r.doc_id for r in rows} == set(seeded_texts)
    for r in rows:
        assert r.post_max <= r.pre_max and r.flagged == (r.post_max >= 0.3)
        assert (r.stopped == "passed") == (r.post_max < 0.3) or r.stopped != "passed"
        assert sorted(re.findall(r"\d+", r.final)) == sorted(re.findall(r"\d+", clean[r.doc_id]))
        if r.final == clean[r.doc_id]:
            assert r.post_max == r.pre_max
    kept = {r.doc_id for r in rewriting.distilled(df, rewriting.closed_loop(df, margin=0.05)).collect()}
    assert kept == {r.doc_id for r in registry.QUERIES["distill_rows"](spark, tiny).collect()} == {r.doc_id for r in registry.QUERIES["preference_pairs"](spark, tiny).collect()}
