"""Fixed schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The unified record, in output order.
UNIFIED_COLUMNS = ["text", "audio", "image", "label", "source", "collected_at", "metadata"]

# The content columns every source is mapped onto.
CONTENT_COLUMNS = ["text", "audio", "image", "label"]

UNIFIED_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in UNIFIED_COLUMNS])

METRIC_COLUMNS = ["section", "metric", "column", "value"]

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def numeric_columns(schema: T.StructType, exclude: set[str] | None = None) -> list[str]:
    """Names of the numeric columns of a schema, in schema order."""
    skip = exclude or set()
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(schema: T.StructType) -> list[str]:
    """Names of the string columns of a schema, in schema order."""
    return [f.name for f in schema if isinstance(f.dataType, T.StringType)]
