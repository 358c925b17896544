"""Places where users plug in their own functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embedding_fn(embed: Callable[[list[str]], list[list[float]]]) -> Callable[..., Column]:
    """A column function from texts to vectors of one length."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(text: pd.Series) -> pd.Series:
        out = embed([t or "" for t in text])
        if len(out) != len(text) or len({len(v) for v in out}) > 1:
            raise ValueError("one vector a text is needed, all of one length")
        return pd.Series(out)

    return run


def generate_fn(requests: DataFrame, call: Callable[[str], str | None]) -> DataFrame:
    """``requests(feedback_id, stage, prompt)`` -> responses; a failing call is a row with
    ``failure_kind``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            answers, failures = [], []
            for prompt in df["prompt"]:
                try:
                    answers.append(call(prompt))
                    failures.append(None)
                except Exception as e:  # the user's function may raise anything
                    answers.append(None)
                    failures.append(type(e).__name__)
            yield df[["feedback_id", "stage"]].assign(raw_json=answers, failure_kind=failures)

    return requests.mapInPandas(run, "feedback_id long, stage string, raw_json string, failure_kind string")
