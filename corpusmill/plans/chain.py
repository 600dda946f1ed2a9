"""Stages run one after the other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StageResult:
    """What a stage hands on: a table, and metric rows about it."""

    df: DataFrame
    metrics: DataFrame | None = None


Stage = Callable[[StageResult], StageResult]


def merge_metrics(earlier: DataFrame | None, later: DataFrame | None) -> DataFrame | None:
    """Both metric tables; where both have a metric, the later value counts."""
    if earlier is None or later is None:
        return later if earlier is None else earlier
    names = ["section", "metric", "column"]
    return later.unionByName(earlier.join(later, names, "left_anti"))


def chain(start: DataFrame, stages: Sequence[Stage]) -> StageResult:
    """Each stage gets the result of the one before."""
    if not stages:
        raise ValueError("At least one stage is needed")

    def step(result: StageResult, stage: Stage) -> StageResult:
        done = stage(result)
        return StageResult(done.df, merge_metrics(result.metrics, done.metrics))

    return reduce(step, stages, StageResult(start))


def table_stage(name: str, transform: Callable[[DataFrame], DataFrame]) -> Stage:
    """A stage from a table function; its metric is the number of rows it hands on."""

    def run(result: StageResult) -> StageResult:
        df = transform(result.df)
        rows = df.agg(
            F.lit(name).alias("section"),
            F.lit("row_count").alias("metric"),
            F.lit("").alias("column"),
            F.count(F.lit(1)).cast("double").alias("value"),
        )
        return StageResult(df, rows)

    return run
