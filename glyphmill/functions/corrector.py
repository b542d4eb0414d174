"""Decision rules around models. Scoring is a hook: any function of batches; the rules are expressions."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import sanitize, skip_token

LEAST_PROBABILITY, MOST_EDITS, LONGEST, FEWEST_TOKENS = 0.85, 2, 20, 2


def choose_candidate(token: Column, candidate: Column, probability: Column, tokens: Column) -> Column:
    """The model's word where it is sure enough and close enough to the text's, else the text's."""
    accept = (
        (probability >= LEAST_PROBABILITY) & (F.levenshtein(token, candidate) <= MOST_EDITS) & (F.length(token) <= LONGEST)
        & (tokens >= FEWEST_TOKENS) & ~skip_token(token)
    )
    return F.when(accept, candidate).otherwise(token)


def post_process(df: DataFrame, raw: str, correct: Callable[[Column], Column] | None = None, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """`df` with post: struct(raw, sanitized, corrected, model_corrected); steps without a function pass on."""
    clean = sanitize(F.col(raw))
    corrected = correct(clean) if correct else clean
    return df.withColumn("post", F.struct(F.col(raw).alias("raw"), clean.alias("sanitized"), corrected.alias("corrected"), (model(corrected) if model else corrected).alias("model_corrected")))


def predict(df: DataFrame, schema: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], batch: int = 8, token: str | None = None) -> DataFrame:
    """Rows through a model in batches of exactly `batch` rows, the last of a task aside, however Spark cuts its own.

    `load` runs once per Python worker and `token` (by default each call's own), not per task: a worker that has the model goes on
    with it, and keeps one at a time. Rows keep their order within a task; the model gets no empty batch. What the model holds outside its object must be safe to use again.
    """
    name = token or uuid.uuid4().hex

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = sys.modules.setdefault("_kept_model", types.ModuleType("_kept_model")).__dict__  # the worker's own: this function comes anew with each task
        if kept.get("name") != name:
            kept["model"], kept["name"] = load(), name
        model = kept["model"]
        held: list[pd.DataFrame] = []
        for part in parts:
            held.append(part)
            if sum(map(len, held)) >= batch:
                rows = pd.concat(held, ignore_index=True)
                whole = len(rows) // batch * batch
                for at in range(0, whole, batch):
                    yield model(rows.iloc[at : at + batch].reset_index(drop=True))
                held = [rows.iloc[whole:]]
        rest = pd.concat(held, ignore_index=True) if held else None
        if rest is not None and len(rest):
            yield model(rest)

    return df.mapInPandas(run, schema)
