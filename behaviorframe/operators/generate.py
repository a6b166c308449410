"""The seam where a model comes in: an injected function over batches, or a table of outputs."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GenerateFn(Protocol):
    def __call__(self, prompts: pd.Series) -> pd.Series: ...


def echo(prompts: pd.Series) -> pd.Series:
    return prompts


def constant(text: str) -> GenerateFn:
    return lambda prompts: pd.Series([text] * len(prompts))


def generated(df: DataFrame, prompt: str, fn: GenerateFn, output: str = "output") -> DataFrame:
    """df with the outputs of an injected function, in Arrow batches."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return fn(prompts)

    return df.withColumn(output, run(F.col(prompt)))


def with_outputs(df: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """df with a table of outputs by key; a missing one is null."""
    return df.join(outputs, key, "left")
