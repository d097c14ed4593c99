"""Batch scoring of a vector column with pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[np.ndarray], np.ndarray]


def _unit_rows(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def score_batches(
    df: DataFrame, vec: str, make_model: Callable[[], Model], out: str = "score", batch: int = 64,
    make_second: Callable[[], Model] | None = None, second_out: str = "second_score",
) -> DataFrame:
    """Unit-norm model output per row, ``batch`` rows per model call.

    ``make_model`` is called once per task, so a model is loaded where it is used. A failure of the first model
    fails the job; a failing batch of the second model gives nulls, and so does a second model that can't be loaded.
    """

    def scorer(make: Callable[[], Model], optional: bool):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            try:
                model = make()
            except Exception:
                if not optional:
                    raise
                model = None
            for rows in batches:
                if model is None:
                    yield pd.Series([None] * len(rows))
                    continue
                result: list = []
                for start in range(0, len(rows), batch):
                    part = rows.iloc[start : start + batch]
                    try:
                        result += list(_unit_rows(model(np.stack(part.to_list()))).astype(np.float32))
                    except Exception:
                        if not optional:
                            raise
                        result += [None] * len(part)
                yield pd.Series(result)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<float>")

    scored = df.withColumn(out, scorer(make_model, False)(F.col(vec)))
    return scored if make_second is None else scored.withColumn(second_out, scorer(make_second, True)(F.col(vec)))
