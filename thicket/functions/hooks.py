"""User code: row callbacks, extractors, models and named jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

JOBS: dict[str, Callable[..., DataFrame]] = {}


def convert_rows(df: DataFrame, fn: Callable[[dict[str, Any]], dict[str, Any] | None], schema: str) -> DataFrame:
    """A row callback for import or export, run in Arrow batches; a row mapped to None is left out."""
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [out for out in map(fn, pdf.to_dict("records")) if out is not None]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def job(name: str):
    """Register a DataFrame function under a name."""

    def register(fn: Callable[..., DataFrame]):
        JOBS[name] = fn
        return fn

    return register


def run_job(spark: SparkSession, name: str, *args: Any, **kwargs: Any) -> DataFrame:
    if name not in JOBS:
        raise KeyError(f"no job named {name}")
    return JOBS[name](spark, *args, **kwargs)
