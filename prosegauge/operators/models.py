"""Scorers that need a model: loaded once in each Python worker, fed with batches, never able to end the query.

A model comes as two functions that the workers get: load, which returns it, and score, which takes it and a list of texts.
A load that fails is remembered and gives every text of the worker an error; a batch that fails is tried again text by text,
so that only the texts at fault have one. Errors are at most ERROR_CHARS long."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp01, is_blank, round4, sentences_keep
from .arrow import pieces as in_pieces
from .scoring import lite_counts, lite_signal, perplexity_score

ERROR_CHARS = 140
#: Of a sentence that a model cannot read: fewer than two tokens.
SHORT_PERPLEXITY = 100.0
_loaded: dict[str, tuple[Any, str | None]] = {}


@dataclass(frozen=True)
class ModelScorer:
    """A named model; score gets the loaded model and texts and returns a P(machine), or None to stay out, for each."""

    name: str
    tier: str
    load: Callable[[], Any]
    score: Callable[[Any, list[str]], list[float | None]]
    available: Callable[[], bool] = lambda: True


def python_scorer(name: str, tier: str, score: Callable[[str], float | None]) -> ModelScorer:
    """A scorer of one text at a time without a model."""
    return ModelScorer(name, tier, lambda: score, lambda f, texts: [f(t) for t in texts])


def told(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"[:ERROR_CHARS]


def model_of(token: str, load: Callable[[], Any]) -> tuple[Any, str | None]:
    """The model, or why there is none; asked for once in each worker."""
    if token not in _loaded:
        try:
            _loaded[token] = (load(), None)
        except Exception as e:  # a model may fail to load in any way
            _loaded[token] = (None, told(e))
    return _loaded[token]


def attempted(ask: Callable[[Any, list[str]], list], model: Any, texts: list[str]) -> list[tuple[Any, str | None]]:
    """(value, error) of each text."""
    try:
        values = ask(model, texts)
        if len(values) == len(texts):
            return [(v, None) for v in values]
    except Exception as e:
        if len(texts) == 1:
            return [(None, told(e))]
    if len(texts) == 1:
        return [(None, "one value a text was expected")]
    return [attempted(ask, model, [t])[0] for t in texts]


def with_model_readings(df: DataFrame, scorers: list[ModelScorer], text: str, name: str) -> DataFrame:
    """df with an array of struct(detector, tier, score, error) of all model scorers: one pass, each model in memory once a worker."""
    parts = [(s.name, s.tier, s.load, s.score, hashlib.sha256(cloudpickle.dumps(s.load)).hexdigest()) for s in scorers]
    kind = "array<struct<detector:string,tier:string,score:double,error:string>>"
    at = df.columns.index(text)
    arrow = pa.list_(pa.struct([("detector", pa.string()), ("tier", pa.string()), ("score", pa.float64()), ("error", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            rows: list[list] = [[] for _ in texts]
            for detector, tier, load, score, token in parts:
                model, error = model_of(token, load)
                got = [(None, error)] * len(texts) if error else attempted(score, model, texts)
                for row, (value, why) in zip(rows, got, strict=True):
                    try:
                        number = None if value is None else float(value)
                    except (TypeError, ValueError) as e:
                        number, why = None, told(e)
                    row.append({"detector": detector, "tier": tier, "score": number, "error": why})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` {kind}")


# --- token-level models ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TokenModel:
    """A language model; logprobs gets it and texts and returns each text's token log-probabilities."""

    load: Callable[[], Any]
    logprobs: Callable[[Any, list[str]], list[list[float]]]


def perplexities(df: DataFrame, model: TokenModel, text: str = "text", name: str = "perplexities") -> DataFrame:
    """df with the perplexity of each sentence in order, 100 where a sentence has fewer than two tokens; null where the model
    does not load or fails on the text."""
    sentences = F.transform(sentences_keep(F.col(text)), lambda s: s)
    df = df.withColumn(name, sentences)
    load, ask, token, at = model.load, model.logprobs, hashlib.sha256(cloudpickle.dumps(model.load)).hexdigest(), len(df.columns) - 1

    def perplexity(logs: list[float]) -> float:
        import math

        return SHORT_PERPLEXITY if len(logs) < 2 else math.exp(min(700.0, -sum(logs) / len(logs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            loaded, error = model_of(token, load)
            out = []
            for pieces in batch.column(at).to_pylist():
                got = [(None, error)] if error else attempted(ask, loaded, pieces or []) if pieces else []
                out.append(None if any(why for _, why in got) else [perplexity(list(v)) for v, _ in got])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.list_(pa.float64()))], names=batch.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(run, f"{fields}, `{name}` array<double>")


def curvature(logp: Column, mean: Column, var: Column) -> Column:
    """Mean conditional-probability curvature over a text's tokens, from arrays; null under two tokens."""
    z = F.zip_with(F.arrays_zip(logp.alias("l"), mean.alias("m")), var, lambda a, v: (a["l"] - a["m"]) / F.sqrt(v + F.lit(1e-8)))
    return F.when(F.size(logp) >= 2, F.aggregate(z, F.lit(0.0), lambda s, x: s + x) / F.size(logp))


def perplexity_ratio(logp: Column, cross: Column) -> Column:
    """Log-perplexity over cross-perplexity of a text's tokens, from arrays; null under two tokens or without cross entropy."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(logp) >= 2) & (total(cross) > 0), -total(logp) / total(cross))


def perplexity_or_lite(df: DataFrame, model: TokenModel | None = None, use: str = "auto", text: str = "text") -> DataFrame:
    """df with score and scored_by (model or lite). use: model, lite, or auto, which takes the lite score where the model gives
    none; with model such texts have no score. Which one it was is always told."""
    if use not in ("auto", "model", "lite"):
        raise ValueError(f"use is auto, model or lite, not {use}")
    base = lite_counts(df, text)
    lite = round4(lite_signal(F.col("n_common"), F.col("lite"), is_blank(F.col(text))))
    if use == "lite" or model is None and use == "auto":
        return base.withColumns({"score": lite, "scored_by": F.lit("lite")}).drop("n_common", "lite", "n_words")
    own = F.lit(None).cast("double") if model is None else round4(clamp01(F.when(F.size("perplexities_") > 0, perplexity_score(F.col("perplexities_")))))
    base = base if model is None else perplexities(base, model, text, "perplexities_")
    score = own if use == "model" else F.coalesce(own, lite)
    by = F.when(own.isNotNull(), "model") if use == "model" else F.when(own.isNotNull(), "model").otherwise("lite")
    return base.withColumns({"score": score, "scored_by": by}).drop("n_common", "lite", "n_words", "perplexities_")
