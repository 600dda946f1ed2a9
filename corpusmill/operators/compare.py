"""What cleaning changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.detect import IMBALANCE_THRESHOLD, sided_reports, sparsity_bucket, text_reports

_METRIC_KEY = ["section", "metric", "column"]


def compare_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two metric tables side by side: ``before``, ``after`` and ``delta`` (before - after)."""
    left = before.withColumnRenamed("value", "before")
    right = after.withColumnRenamed("value", "after")
    return left.join(right, _METRIC_KEY, "full_outer").withColumn(
        "delta", F.col("before") - F.col("after")
    )


def compare(
    before: DataFrame,
    after: DataFrame,
    key: str,
    text: str | None = None,
    label: str | None = None,
    threshold: float = IMBALANCE_THRESHOLD,
    exact: bool = True,
) -> DataFrame:
    """Quality reports of a table before and after cleaning, by the same rules.

    Both tables are read once, and every pass over their facts serves both reports.
    """
    return _side_by_side(sided_reports([before, after], key, text, label, threshold, exact))


def _side_by_side(report: DataFrame) -> DataFrame:
    """Metric rows of sides 0 and 1 as ``before``, ``after`` and ``delta`` (before - after)."""
    value = [F.max(F.when(F.col("side") == i, F.col("value"))).alias(name) for i, name in enumerate(("before", "after"))]
    both = report.groupBy(*_METRIC_KEY).agg(*value)
    return both.withColumn("delta", F.col("before") - F.col("after"))


def delta_direction(comparison: DataFrame) -> DataFrame:
    """Adds ``direction`` and ``amount`` to a comparison."""
    delta = F.col("delta")
    direction = (
        F.when(delta.isNull(), "not available")
        .when(delta > 0, "improved")
        .when(delta < 0, "increased")
        .otherwise("unchanged")
    )
    return comparison.withColumns({"direction": direction, "amount": F.abs(delta)})


def compare_text(
    before: DataFrame,
    after: DataFrame,
    key: str,
    text: str = "text",
    label: str = "label",
    exact: bool = True,
) -> DataFrame:
    """Text figures before and after: empty, repeated (exact and normalised), lengths,
    label coverage, columns without values. Both tables are read once."""
    return _side_by_side(text_reports([before, after], key, text, label, exact))


def compare_retention(
    before: DataFrame, after: DataFrame, key: str, text: str = "text", label: str = "label"
) -> DataFrame:
    """Per kind of row before cleaning: rows, how many were kept and dropped."""
    kept = after.select(key, F.lit(True).alias("__kept"))
    kinds = before.select(key, sparsity_bucket(before, text, label, {key}).alias("bucket"))
    return (
        kinds.join(kept, key, "left")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("__kept").alias("kept"))
        .withColumn("dropped", F.col("rows") - F.col("kept"))
    )


def stage_metrics(comparison: DataFrame) -> DataFrame:
    """One row: rows, gaps, duplicates and outliers after cleaning, 0 when unknown."""
    wanted = {
        "row_count": ("table", "row_count"),
        "missing_total_after": ("missing", "total"),
        "duplicates_after": ("duplicates", "rows"),
        "outliers_after": ("outliers", "iqr_total"),
    }
    picks = []
    for name, (section, metric) in wanted.items():
        hit = (F.col("section") == section) & (F.col("metric") == metric) & (F.col("column") == "")
        picks.append(F.coalesce(F.max(F.when(hit, F.col("after"))), F.lit(0.0)).alias(name))
    return comparison.agg(*picks)
