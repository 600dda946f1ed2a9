"""Mapping a raw source onto the unified record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import EXACT_JSON, json_array, json_object
from corpusmill.schema import CONTENT_COLUMNS, UNIFIED_COLUMNS, UNIFIED_SCHEMA

# Raw names accepted for a unified column, best first.
CANDIDATES = {
    "text": ["text", "content", "body", "review", "comment", "description"],
    "audio": ["audio", "audio_path", "file", "path"],
    "image": ["image", "image_path", "url"],
    "label": ["label", "labels", "sentiment", "target", "class"],
}


def source_name(source: Mapping) -> str:
    """Name of a source, else its url, endpoint or type."""
    return str(
        source.get("name") or source.get("url") or source.get("endpoint") or source["type"]
    )


def column_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename raw columns to unified ones; ``mapping`` is ``{unified: raw}``."""
    return df.withColumnsRenamed({raw: unified for unified, raw in mapping.items()})


def infer_columns(df: DataFrame) -> DataFrame:
    """Fill missing content columns from the first raw column with a known name.

    The value is copied; the raw column stays and ends up in the metadata.
    """
    present = set(df.columns)
    added = {}
    for unified in CONTENT_COLUMNS:
        if unified not in present:
            raw = next((name for name in CANDIDATES[unified] if name in present), None)
            added[unified] = F.lit(None).cast("string") if raw is None else F.col(raw)
    return df.withColumns(added) if added else df


def pack_metadata(df: DataFrame) -> DataFrame:
    """Every column that is not content as one JSON object, nulls written out."""
    rest = [name for name in df.columns if name not in CONTENT_COLUMNS]
    if not rest:
        packed = F.lit("{}")
    else:
        packed = F.to_json(F.struct(*[F.col(f"`{n}`") for n in rest]), EXACT_JSON)
    content = [F.col(name) for name in CONTENT_COLUMNS if name in df.columns]
    return df.select(*content, packed.alias("metadata"))


def stamp_provenance(df: DataFrame, source: Mapping, collected_at: str) -> DataFrame:
    """Source name and one collection instant (ISO, UTC) on every row."""
    return df.withColumns(
        {"source": F.lit(source_name(source)), "collected_at": F.lit(collected_at)}
    )


def unify(df: DataFrame, source: Mapping, collected_at: str) -> DataFrame:
    """One source as unified records."""
    return (
        df.transform(column_map, source.get("column_map") or {})
        .transform(infer_columns)
        .transform(pack_metadata)
        .transform(stamp_provenance, source, collected_at)
        .select(*[F.col(name).cast("string").alias(name) for name in UNIFIED_COLUMNS])
    )


def merge_sources(spark: SparkSession, frames: Sequence[DataFrame]) -> DataFrame:
    """All sources as one table with exactly the unified columns."""
    if not frames:
        return spark.createDataFrame([], UNIFIED_SCHEMA)
    return reduce(DataFrame.unionByName, [f.select(*UNIFIED_COLUMNS) for f in frames])


def restore_nested(df: DataFrame, reference: T.StructType) -> DataFrame:
    """Give text cells back the nested type or timestamp they had in ``reference``.

    A cell that does not parse to its type becomes null. For nested columns the
    text is kept in ``<column>_text`` whenever a part of it is not in the restored
    cell: no JSON, a member of another type, or a member that the type lacks.
    """
    changed = {}
    for field in reference:
        if field.name not in df.columns or not isinstance(df.schema[field.name].dataType, T.StringType):
            continue
        cell = F.col(field.name)
        if isinstance(field.dataType, (T.MapType, T.StructType, T.ArrayType)):
            document = (
                json_array(cell) if isinstance(field.dataType, T.ArrayType) else json_object(cell)
            )
            # Spark reports a cell that lost a member only through the corrupt-record column.
            wrapped = F.concat(F.lit('{"v":'), document, F.lit("}"))
            shape = T.StructType([T.StructField("v", field.dataType), T.StructField("lost", T.StringType())])
            read = F.from_json(wrapped, shape, {"columnNameOfCorruptRecord": "lost"})
            lost = read["v"].isNull() | read["lost"].isNotNull()
            if isinstance(field.dataType, T.StructType):
                known = F.array(*[F.lit(f.name) for f in field.dataType])
                lost = lost | (F.size(F.array_except(F.json_object_keys(document), known)) > 0)
            changed[field.name] = read["v"]
            changed[f"{field.name}_text"] = F.when(F.coalesce(lost, F.lit(True)), cell)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            changed[field.name] = F.try_to_timestamp(cell)
    return df.withColumns(changed) if changed else df
