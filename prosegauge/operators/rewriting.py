"""Rewriters, strategies, the closed loop and what is built from their results.

A rewriter is a named Column -> Column; null is a draw that failed. The loop is a batch iteration: each round works on the
rows that are still active, accepts or rejects candidates, and is cut off by a reliable checkpoint; finished rows are put
aside."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, plain
from ..functions.columns import is_blank, round4
from ..sources.tables import shared_folder
from .arrow import by_row
from .hidden import composed, scrub, scrubbed
from .locks import lock, mapping_of, mask, restore, same_sentinels
from .scoring import flagged_array, lite_counts, lite_signal, sentence_flags


@dataclass(frozen=True)
class Rewriter:
    """rewrite takes text and draw number (a literal column), and where it is guided the prompt of the round: the reading, the
    wanted voice and the flagged sentences. It returns the new text, or null if the draw failed. Deterministic ones stop the
    loop when nothing changes."""

    name: str
    rewrite: Callable[..., Column]
    deterministic: bool = False
    available: Callable[[], bool] = lambda: True
    guided: bool = False
    #: rewrite as a Python function of the text alone, where there is one; a round is then a single Arrow call.
    plain: Callable[[str | None], str | None] | None = None


def python_rewriter(name: str, rewrite: Callable[[str, str], str], deterministic: bool = False) -> Rewriter:
    """A guided rewriter from a Python function of text and prompt; whatever it raises is a failed draw of that text."""

    def column(text: Column, draw: Column, ask: Column) -> Column:
        def one(t: str, _: int, p: str) -> str | None:
            try:
                return rewrite(t, p)
            except Exception:
                return None

        return by_row(one, "string")(text, draw, ask)

    return Rewriter(name, column, deterministic, guided=True)


def scripted(text: Column, strength: float) -> Column:
    return by_row(lambda t: None if t is None else plain.scripted(t, strength), "string")(text)


def surgical(text: Column, threshold: float = fixed.THRESHOLD, most: int = 8, more: dict[str, list[str]] | Callable[[str], list[str]] | None = None) -> Column:
    """struct(text, substitutions); more extends the synonym table."""
    table = extended(more)
    return by_row(lambda t: plain.substituted(t or "", threshold, most, table), "struct<text:string,substitutions:int>")(text)


def back_translated(text: Column, translate: Callable[[str], str] | None = None) -> Column:
    """The text through a plugged-in round trip; unchanged without one, or where it fails."""
    if translate is None:
        return text

    def one(t: str | None) -> str | None:
        try:
            return translate(t) if t is not None and t.strip() else t
        except Exception:  # a translator may fail in any way; the text then stays as it is
            return t

    return by_row(one, "string")(text)


def importance_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, place, word, drop_e4): unique words by how much the reading falls without them."""

    def one(t: str) -> list[dict]:
        return [{"word": w, "drop_e4": round(d * 10000)} for w, d in plain.importance(t)]

    rows = by_row(one, "array<struct<word:string,drop_e4:bigint>>")(F.coalesce(F.col(text), F.lit("")))
    return df.select(key, F.posexplode(rows).alias("place", "w")).select(key, "place", "w.word", "w.drop_e4")


def without_word(text: Column, word: Column) -> Column:
    """All whole-word occurrences removed."""
    edge = r"[\p{L}\p{N}_]"
    return F.regexp_replace(text, F.concat(F.lit(rf"(?<!{edge})\Q"), word, F.lit(rf"\E(?!{edge})")), F.lit(""))


def extended(more: dict[str, list[str]] | Callable[[str], list[str]] | None) -> dict[str, list[str]]:
    """The synonym table with further synonyms behind its own: a table, or a function that is asked once for each word of the table."""
    if more is None:
        return fixed.SYNONYMS
    further = {w: more(w) for w in fixed.SYNONYMS} if callable(more) else {w.lower(): v for w, v in more.items()}
    return {w: [*fixed.SYNONYMS.get(w, []), *further.get(w, [])] for w in [*fixed.SYNONYMS, *(w for w in further if w not in fixed.SYNONYMS)]}


def synonyms(df: DataFrame, word: str, most: int = 6, more: dict[str, list[str]] | Callable[[str], list[str]] | None = None) -> DataFrame:
    """Rows (word, place, synonym) of the table's words: in order, without repeats in another case, the first six; more extends
    the table, whose size is that of a word list."""
    spark = df.sparkSession
    rows = [(k, i, s) for k, v in extended(more).items() for i, s in enumerate(v)]
    table = spark.createDataFrame(rows, "entry string, place int, synonym string")
    first = F.row_number().over(Window.partitionBy("entry", F.lower("synonym")).orderBy("place"))
    ranked = table.withColumn("again", first).where("again = 1").withColumn("place", F.row_number().over(Window.partitionBy("entry").orderBy("place"))).where(F.col("place") <= most)
    return df.select(word).join(F.broadcast(ranked), F.lower(word) == F.col("entry")).select(word, "place", "synonym")


def dice_of(a: Column | str, b: Column | str) -> Column:
    return by_row(lambda x, y: plain.dice(x or "", y or ""), "double")(a, b)


def _read(t: str | None) -> float:
    return plain.round4(plain.lite(t or ""))


def reading(text: Column) -> Column:
    """The lite reading of a text column that is worked on by Python anyway."""
    return by_row(_read, "double")(text)


SURGICAL = Rewriter("surgical", lambda t, _: surgical(t, most=12)["text"], deterministic=True, plain=lambda t: plain.substituted(t or "", most=12)[0])


def prompt(text: Column, worst: Column, flagged: Column, style: Column, threshold: float = fixed.THRESHOLD) -> Column:
    """The instruction for a rewriter: the worst three readings, the wanted voice, up to eight flagged sentences, the text."""
    names = F.array_join(F.transform(worst, lambda d: F.concat(d["detector"], F.lit(" (P="), F.format_number(d["score"], 2), F.lit(")"))), ", ")
    lead = F.when(F.size(worst) > 0, F.concat(F.lit(f"These scorers read at or over {threshold:.2f}: "), names)).otherwise(F.lit(f"Bring the reading under {threshold:.2f}."))
    voice = F.when(style.isNotNull(), F.concat(F.lit("Voice: "), style))
    listed = F.when(F.size(flagged) > 0, F.concat(F.lit("Sentences to rewrite first:\n"), F.array_join(F.transform(F.slice(flagged, 1, 8), lambda s: F.concat(F.lit("  - "), s)), "\n")))
    return F.concat_ws("\n\n", F.lit("Rewrite the text in plain, natural prose and keep its meaning and every bracketed token."), lead, voice, listed, F.concat(F.lit("TEXT:\n"), text))


# --- strategies --------------------------------------------------------------------------------------------------------


def _lite(df: DataFrame, text: str, out: str) -> DataFrame:
    counted = lite_counts(df, text)
    return counted.withColumn(out, round4(lite_signal(F.col("n_common"), F.col("lite"), is_blank(F.col(text))))).drop("n_common", "lite", "n_words")


def noop(docs: DataFrame, **_) -> DataFrame:
    df = _lite(docs.select("doc_id", "text"), "text", "pre_max")
    return df.select("doc_id", "text", F.lit(0).alias("iterations"), "pre_max", F.col("pre_max").alias("post_max"), F.lit(1.0).alias("similarity"), F.array("pre_max").alias("history"))


def _texts_of(docs: DataFrame, one: Callable[[str | None], tuple], kind: str) -> DataFrame:
    """doc_id and the fields of kind, which one gives for each text: a single Arrow call of a row, however many fields."""
    return docs.select("doc_id", by_row(one, kind)(F.col("text")).alias("r")).select("doc_id", "r.*")


def single_pass(docs: DataFrame, **_) -> DataFrame:
    def one(t: str | None) -> tuple:
        pre, out = plain.round4(plain.lite(t or "")), None if t is None else plain.scripted(t, 0.5)
        post = plain.round4(plain.lite(out or ""))
        return out, 1, pre, post, plain.dice(t or "", out or ""), [pre, post]

    return _texts_of(docs, one, _STRATEGY)


#: What a strategy gives for a text.
_STRATEGY = "struct<text:string,iterations:int,pre_max:double,post_max:double,similarity:double,history:array<double>>"


def full_loop(docs: DataFrame, threshold: float = fixed.THRESHOLD, bar: float = fixed.TOKEN_BAR, max_iters: int = fixed.MAX_ITERS, rewriter: Callable[[str], str] | None = None) -> DataFrame:
    """Candidates of rising strength, each from the original text: take one that holds the bar and is no worse, stop when
    not flagged. All rounds of a document are one Arrow call; a plugged-in rewriter works on the best text so far and
    falls back to the scripted one when it fails. Strengths that come down to the same plan are worked out once."""

    def one(t: str | None) -> tuple:
        t = t or ""
        best, score, rounds, alike = t, plain.round4(plain.lite(t)), 0, 1.0
        pre, history = score, [score]
        words = Counter(plain.tokens(t))
        made: dict[tuple, tuple[str, float, float]] = {}

        def judged(candidate: str) -> tuple[str, float, float]:
            return candidate, plain.round4(plain.lite(candidate)), plain.dice(t, candidate, words)

        for rounds in range(1, max_iters + 1):
            got = None
            if rewriter is not None:
                try:
                    candidate = rewriter(best)
                except Exception:  # any failure of a plugged-in rewriter
                    candidate = None
                got = None if candidate is None else judged(candidate)
            if got is None:
                strength = min(1.0, 0.5 + 0.125 * (rounds - 1))
                if (key := plain.plan(strength)) not in made:
                    made[key] = judged(plain.scripted(t, strength))
                got = made[key]
            history.append(got[1])
            if got[2] >= bar and got[1] <= score:
                best, score, alike = got
            if score < threshold:
                break
        return best, rounds, pre, score, alike, history

    return _texts_of(docs, one, _STRATEGY)


def api_loop(docs: DataFrame, rewriter: Callable[[str], str] | None = None, **how) -> DataFrame:
    """full_loop over a plugged-in rewriter; without one it is the scripted loop."""
    return full_loop(docs, rewriter=rewriter, **how)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"noop": noop, "single_pass": single_pass, "full_loop": full_loop, "api_loop": api_loop}


def run_strategies(docs: DataFrame, names: list[str], **how) -> DataFrame:
    """The results of several strategies under each other, with column strategy."""
    out = None
    for name in names:
        part = STRATEGIES[name](docs, **how).withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# --- closed loop -------------------------------------------------------------------------------------------------------


def _saved(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def closed_loop(
    docs: DataFrame, rewriter: Rewriter | None = SURGICAL, threshold: float = fixed.THRESHOLD, margin: float = 0.0, bar: float = fixed.TOKEN_BAR,
    max_iters: int = fixed.MAX_ITERS, best_of: int = 1, scrub_first: bool = True, confirm: int = 0, polish: bool = False, score_on: str = "masked",
    score: Callable[[Column], Column] = reading, confirm_score: Callable[[Column, int], Column] | None = None, style: str | None = None, tier: str = "lite",
) -> DataFrame:
    """Rows (doc_id, final, iterations, rewrites, pre_max, post_max, similarity, flagged, stopped, tier, sim_bar, quality_metric).

    stopped: passed, stalled, max_iters, passed_unconfirmed, or error where no rewriter is available (text unchanged) or the
    first draw of a round fails (the text as it stood before the round). Later draws that fail leave the others to choose from.
    score_on: readings, also the confirming ones, of the masked text, or of the restored one. A guided rewriter gets each
    round's prompt with the reading, the style and the flagged sentences of the best text so far. tier is the scorer's own."""
    fields = [F.lit(tier).alias("tier"), F.lit(bar).cast("double").alias("sim_bar"), F.lit("token").alias("quality_metric")]
    if rewriter is None or not rewriter.available():
        df = docs.select("doc_id", F.col("text").alias("final"))
        return df.select("*", F.lit(0).alias("iterations"), F.lit(0).alias("rewrites"), F.lit(None).cast("double").alias("pre_max"), F.lit(None).cast("double").alias("post_max"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("boolean").alias("flagged"), F.lit("error").alias("stopped"), *fields)
    text = F.coalesce(F.col("text"), F.lit(""))
    fused = score is reading and score_on == "masked"  # readings are then taken where the text is made, by the same worker
    if fused:

        def masked(t: str) -> tuple[str, list[str], float]:
            out, kept = mask(composed(t) if scrub_first else t)
            return out, kept, _read(out)

        cells = by_row(masked, "struct<masked:string,kept:array<string>,pre_max:double>")(scrubbed(text) if scrub_first else text)
        state = docs.select("doc_id", cells.alias("r")).select("doc_id", "r.masked", mapping_of(F.col("r.kept")).alias("mapping"), "r.pre_max")
    else:
        state = lock(docs.select("doc_id", (scrub(text) if scrub_first else text).alias("text")))
    view = (lambda c: F.col(c)) if score_on == "masked" else (lambda c: restore(F.col(c), F.col("mapping")))
    seen = lambda c: score(view(c))
    state = state.select("doc_id", "masked", "mapping", F.col("masked").alias("best"), (F.col("pre_max") if fused else seen("masked")).alias("pre_max"))
    state = state.withColumns({"post_max": F.col("pre_max"), "similarity": F.lit(1.0), "iterations": F.lit(0), "rewrites": F.lit(0), "stopped": F.lit("max_iters")})
    goal, done = threshold - margin, None
    rewrite = rewriter.plain

    def draw_of(best: str, source: str) -> tuple[str | None, float, float]:
        new = rewrite(best)
        return new, _read(new), plain.dice(source or "", new or "")

    drawn = by_row(draw_of, "struct<new:string,new_max:double,new_sim:double>")
    active = _saved(state)
    for turn in range(1, max_iters + 1):
        active = active.withColumn("iterations", F.lit(turn))
        over = active.where(F.col("post_max") < goal).withColumn("stopped", F.lit("passed"))
        rest = active.where(F.col("post_max") >= goal).withColumns({"before": F.col("best"), "cand": F.lit(None).cast("string"), "cand_max": F.lit(None).cast("double"), "cand_sim": F.lit(None).cast("double"), "failed": F.lit(False)})
        if rewriter.guided:
            worst = F.array(F.struct(F.lit(1).alias("place"), F.lit("perplexity_burstiness").alias("detector"), F.col("post_max").alias("score")))
            rest = rest.withColumn("ask", prompt(F.col("best"), worst, flagged_array(F.col("best"), threshold), F.lit(style).cast("string"), threshold))
        for draw in range(max(1, best_of)):
            if fused and rewriter.plain is not None:
                rest = rest.withColumn("drawn", drawn("best", "masked")).withColumns({c: F.col(f"drawn.{c}") for c in ("new", "new_max", "new_sim")}).drop("drawn")
            else:
                rest = rest.withColumn("new", rewriter.rewrite(F.col("best"), F.lit(draw), *([F.col("ask")] if rewriter.guided else [])))
                rest = rest.withColumns({"new_max": seen("new"), "new_sim": dice_of("masked", "new")})
            rest = rest.withColumn("rewrites", F.col("rewrites") + 1)
            if draw == 0:
                rest = rest.withColumn("failed", F.col("new").isNull())
            valid = ~F.col("failed") & F.col("new").isNotNull() & same_sentinels(F.col("new"), F.col("mapping")) & (F.col("new_sim") >= bar) & (F.col("cand_max").isNull() | (F.col("new_max") < F.col("cand_max")))
            rest = rest.withColumns({c: F.when(valid, F.col(n)).otherwise(F.col(c)) for c, n in (("cand", "new"), ("cand_max", "new_max"), ("cand_sim", "new_sim"))})
        take = F.coalesce(F.col("cand_max") <= F.col("post_max"), F.lit(False))
        rest = rest.withColumns({c: F.when(take, F.col(n)).otherwise(F.col(c)) for c, n in (("best", "cand"), ("similarity", "cand_sim"), ("post_max", "cand_max"))})
        stalled = F.lit(rewriter.deterministic) & (F.col("best") == F.col("before"))
        rest = rest.withColumn("stopped", F.when(F.col("failed"), "error").when(F.col("post_max") < goal, "passed").when(stalled, "stalled").otherwise("max_iters"))
        both = _saved(over.unionByName(rest.select(*over.columns)))
        ended = both.where("stopped != 'max_iters'")
        done = ended if done is None else done.unionByName(ended)
        active = both.where("stopped = 'max_iters'")
        if not active.head(1):
            break
    out = done.unionByName(active)
    again = confirm_score or (lambda c, _: score(c))
    for k in range(confirm):
        out = out.withColumn("again", again(view("best"), k))
        fails = (F.col("stopped") == "passed") & (F.col("again") >= goal)
        out = out.withColumns({"post_max": F.when(fails, F.col("again")).otherwise(F.col("post_max")), "stopped": F.when(fails, "passed_unconfirmed").otherwise(F.col("stopped"))}).drop("again")
    if polish:
        out = out.withColumn("new", surgical(F.col("best"), threshold)["text"]).withColumns({"new_max": seen("new"), "new_sim": dice_of("masked", "new")})
        take = (F.col("stopped") != "error") & same_sentinels(F.col("new"), F.col("mapping")) & (F.col("new_sim") >= bar) & (F.col("new_max") <= F.col("post_max"))
        out = out.withColumns({c: F.when(take, F.col(n)).otherwise(F.col(c)) for c, n in (("best", "new"), ("similarity", "new_sim"), ("post_max", "new_max"))})
    return out.select("doc_id", restore(F.col("best"), F.col("mapping")).alias("final"), "iterations", "rewrites", "pre_max", "post_max", "similarity", (F.col("post_max") >= threshold).alias("flagged"), "stopped", *fields)


# --- training rows -----------------------------------------------------------------------------------------------------

#: The instruction before each training row's source.
PROMPT = "Put this text into your own plain words and change nothing of what it says.\n\n"


def distilled(sources: DataFrame, results: DataFrame, bar: float = fixed.EMBEDDING_BAR) -> DataFrame:
    """Rows (doc_id, prompt, source, rewritten) of results that are not flagged and keep the meaning."""
    kept = results.where(~F.col("flagged") & (F.col("similarity") >= bar)).select("doc_id", F.col("final").alias("rewritten"))
    return sources.select("doc_id", F.col("text").alias("source")).join(kept, "doc_id").select("doc_id", F.concat(F.lit(PROMPT), "source").alias("prompt"), "source", "rewritten")


def preference_pairs(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "prompt", F.col("rewritten").alias("chosen"), F.col("source").alias("rejected"))


def prompts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit(PROMPT), "text").alias("prompt"), F.col("text").alias("source"))


def best_of(candidates: DataFrame, key: str) -> DataFrame:
    """The valid candidate of the lowest reading of each key; the first draw wins ties."""
    return candidates.where("valid").groupBy(key).agg(F.min_by("draw", F.struct("score", "draw")).alias("draw"), F.min("score").alias("score"))


def flagged_sentences(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, flagged): the sentences to name in a prompt, in document order."""
    rows = sentence_flags(docs).where("flagged")
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]).alias("flagged"))
