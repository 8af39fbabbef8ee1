"""Detectors and rewriters as interfaces, and deterministic stand-ins written as expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Detector(Protocol):
    """A model that scores texts from 0 (human) to 1; loaded once per Python worker."""

    name: str

    def score_batch(self, texts: list[str]) -> list[float]: ...


class Rewriter(Protocol):
    """A model that rewrites by prompt; an error is a value, so that one call can't fail a job."""

    def rewrite(self, prompt: str, temperature: float) -> str: ...


#: models of this worker, by what their factory is made of
_workers: dict = {}


def _content(factory) -> str:
    """A name for a factory that is the same in all workers and differs for others: its pickled content."""
    from pyspark import cloudpickle

    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def detector_column(factory, text: Column) -> Column:
    """Scores by the detector that ``factory()`` makes, in Arrow batches; null text has a null score."""

    key = _content(factory)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _workers:
            _workers[key] = factory()
        model = _workers[key]
        for texts in batches:
            known = texts.dropna()
            out = pd.Series(float("nan"), index=texts.index, dtype="float64")
            if len(known):
                out[known.index] = model.score_batch(known.tolist())
            yield out.astype(object).where(texts.notna(), None)

    return score(text)


def stand_in_score(n_violations: Column, n_words: Column) -> Column:
    """A logistic score of violations and length, rounded so that any engine gives the same."""
    return F.round(1 / (1 + F.exp(-(-1.0 + 0.8 * n_violations + 0.02 * (n_words - 15)))), 6)


def label(score: Column) -> Column:
    """(score, label, confidence) of a score."""
    return F.struct(score.alias("score"), F.when(score > 0.5, "ai").otherwise("human").alias("label"), score.alias("confidence"))


def rewrite_rows(df: DataFrame, factory, prompt_col: str = "prompt", source_col: str = "source", temperature_col: str = "temperature") -> DataFrame:
    """Adds (rewrite, error).  Empty answers and answers equal to the source but for white space are errors.

    Call it on a table that has been written: models are not deterministic, and rows must not be computed again.
    """
    names = df.columns
    at = [names.index(c) for c in (prompt_col, source_col, temperature_col)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in frames:
            out, err = [], []
            for prompt, source, t in zip(*(pdf.iloc[:, i] for i in at), strict=True):
                try:
                    text = model.rewrite(prompt, float(t))
                    if not text or not text.strip():
                        raise ValueError("empty answer")
                    if " ".join(text.split()) == " ".join((source or "").split()):
                        raise ValueError("answer equals its source")
                    out.append(text), err.append(None)
                except Exception as e:  # an error is a row's value
                    out.append(None), err.append(str(e)[:500])
            yield pdf.assign(rewrite=out, error=err)

    return df.mapInPandas(run, f"{fields}, rewrite string, error string")


GENRES = ("academic", "casual", "narrative", "persuasive", "professional")


def parse_genre(answer: Column) -> Column:
    """The genre that a classifier's answer names with its first word; anything else is professional."""
    from ..functions.text import strip, tokens

    first = F.try_element_at(tokens(F.lower(strip(answer))), F.lit(1))
    first = F.regexp_replace(first, r"^[.,;:!?\"']+|[.,;:!?\"']+$", "")
    return F.when(first.isin(*GENRES), first).otherwise("professional")
