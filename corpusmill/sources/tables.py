"""Reading and writing tables, and the ledger of what each source delivered."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from pathlib import PurePosixPath
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.settings import cut_lineage
from corpusmill.sources.unify import merge_sources, source_name, unify


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    other_as_lines: bool = False,
    multi_line: bool = False,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Read a table by suffix: CSV with header, JSON array, JSON lines, Parquet.

    A schema saves the inference pass over the data. ``other_as_lines`` reads
    any unknown suffix as JSON lines instead of failing. ``multi_line`` allows line
    ends inside quoted CSV cells; a file is then read by a single task, so it is
    off unless asked for. A JSON array is one document and always is.
    ``keep_corrupt`` needs a schema and adds ``_corrupt_record``: lines of CSV or
    JSON lines that do not fit it, null for those that do.
    """
    suffix = PurePosixPath(path).suffix.lower()
    if keep_corrupt:
        if schema is None or suffix not in (".csv", ".jsonl"):
            raise ValueError("Corrupt lines are kept of CSV and JSON lines read with a schema")
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".csv":
        return reader.option("header", True).option("escape", '"').option(
            "multiLine", multi_line
        ).option("inferSchema", schema is None).csv(path)
    if suffix == ".json":
        return reader.option("multiLine", True).json(path)
    if suffix == ".jsonl" or (other_as_lines and suffix != ".parquet"):
        return reader.json(path)
    if suffix == ".parquet":
        return reader.parquet(path)
    raise ValueError(f"Unsupported table format: {suffix!r}")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write JSON lines (nulls kept, ISO dates) or CSV with header, by suffix.

    The result is a folder of part files, written in parallel. Nested cells go
    into CSV as JSON text.
    """
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        flat = [
            F.to_json(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f.name)
            for f in df.schema
        ]
        df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif suffix in (".jsonl", ".json"):
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"Unsupported table format: {suffix!r}")


MANIFEST = "_manifest"


def publish_table(df: DataFrame, path: str) -> dict:
    """Write a table beside ``path`` and move it there whole; returns its manifest.

    Readers see the old table, then the new one, never a part: the rows are written to a folder of
    their own, read back and counted, and only then renamed. The manifest (columns, types, rows) lies
    in ``<path>/_manifest``, which readers of tables skip. Nothing is left behind by a failure.
    """
    spark = df.sparkSession
    suffix = PurePosixPath(path).suffix
    staged = f"{path[: len(path) - len(suffix)]}-{uuid.uuid4().hex}{suffix}"
    names = spark._jvm.org.apache.hadoop.fs.Path
    files = names(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write_table(df, staged)
        lines = T.StructType([T.StructField(f.name, T.StringType()) for f in df.schema])
        rows = read_table(spark, staged, lines, multi_line=True).count() if suffix == ".csv" else spark.read.text(staged).count()
        manifest = {"columns": df.columns, "types": [t for _, t in df.dtypes], "rows": rows}
        spark.createDataFrame([tuple(manifest.values())], "columns array<string>, types array<string>, rows bigint").coalesce(
            1
        ).write.json(f"{staged}/{MANIFEST}")
        files.delete(names(path), True)
        if not files.rename(names(staged), names(path)):
            raise OSError(f"{staged} could not be moved to {path}")
    finally:
        files.delete(names(staged), True)
    return manifest


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """A table of :func:`publish_table` with the columns and types of its manifest.

    Nested cells of CSV come back as JSON text. Fewer or more rows than the manifest says are an
    error.
    """
    held = spark.read.json(f"{path}/{MANIFEST}").first()
    nested = ("array<", "map<", "struct<")
    flat = PurePosixPath(path).suffix.lower() == ".csv"
    types = ["string" if flat and t.startswith(nested) else t for t in held["types"]]
    shape = ", ".join(f"`{c}` {t}" for c, t in zip(held["columns"], types))
    schema = T._parse_datatype_string(shape)
    table = read_table(spark, path, schema, multi_line=flat) if flat else spark.read.schema(schema).json(path)
    if table.count() != held["rows"]:
        raise ValueError(f"{path} has not the {held['rows']} rows of its manifest")
    return table


def processed_path(path: str) -> str:
    """Where a transformed table goes: beside its source, as ``<stem>_processed<suffix>``."""
    whole = PurePosixPath(path)
    return path[: len(path) - len(whole.name)] + f"{whole.stem}_processed{whole.suffix}"


def limit_source(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    """First ``limit`` rows of a source in key order; all rows without a limit."""
    return df if limit is None else df.orderBy(key).limit(limit)


def file_table_source(
    spark: SparkSession, path: str, source: Mapping, collected_at: str, key: str | None = None
) -> DataFrame:
    """A local table as a source: read, cut to its limit, mapped to the unified schema."""
    table = read_table(spark, path)
    if source.get("limit") is not None:
        table = limit_source(table, key or table.columns[0], int(source["limit"]))
    return unify(table, source, collected_at)


# Lines that a reader could not make a row of.
CORRUPT = "_corrupt_record"


class Collected(NamedTuple):
    """What :func:`collect` has: unified rows, a ledger row per source, and the unreadable lines."""

    merged: DataFrame
    ledger: DataFrame
    quarantine: DataFrame


def collect(
    spark: SparkSession,
    sources: Sequence[tuple[Mapping, Callable[[], DataFrame]]],
    collected_at: str,
) -> Collected:
    """Load every source on its own; one that fails never stops the others.

    A source is read and stored before the next one begins, so that a file that turns out broken
    only while it is read, or a function that fails on a row, costs that source alone: nothing of it
    is kept, and the ledger names the reason. Rows with a ``_corrupt_record`` (see
    :func:`read_table`, ``keep_corrupt``) are left out, counted and handed over as
    ``(source, line)``.
    """
    frames, outcome, bad = [], [], []
    for source, load in sources:
        name = source_name(source)
        try:
            loaded = load()
            corrupt = CORRUPT in loaded.columns
            if corrupt:
                # Stored first: a reader parses nothing when only this column is asked for.
                loaded = cut_lineage(loaded)
                lines = loaded.where(F.col(CORRUPT).isNotNull())
                lines = cut_lineage(lines.select(F.lit(name).alias("source"), F.col(CORRUPT).alias("line")))
                loaded = loaded.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
            frames.append(cut_lineage(unify(loaded, source, collected_at)))
            if corrupt:
                bad.append(lines)
            outcome.append((name, None))
        except (PySparkException, Py4JJavaError, ValueError, KeyError, OSError) as error:
            outcome.append((name, type(error).__name__))
    merged = merge_sources(spark, frames)
    empty = spark.createDataFrame([], "source string, line string")
    quarantine = reduce(DataFrame.union, bad, empty)
    return Collected(merged, source_ledger(spark, merged, outcome, quarantine), quarantine)


def collect_sources(
    spark: SparkSession,
    sources: Sequence[tuple[Mapping, Callable[[], DataFrame]]],
    collected_at: str,
) -> tuple[DataFrame, DataFrame]:
    """The merged unified table and the ledger of :func:`collect`."""
    done = collect(spark, sources, collected_at)
    return done.merged, done.ledger.drop("bad_rows")


def source_ledger(
    spark: SparkSession,
    merged: DataFrame,
    outcome: Sequence[tuple[str, str | None]],
    quarantine: DataFrame | None = None,
) -> DataFrame:
    """Per source: row count, success, reason of a failure, and unreadable rows if any were kept."""
    attempts = spark.createDataFrame(
        [(i, name, reason) for i, (name, reason) in enumerate(outcome)],
        "position int, source string, reason string",
    )
    counts = merged.groupBy("source").agg(F.count(F.lit(1)).alias("row_count"))
    cells = [
        "position",
        "source",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.col("reason").isNull().alias("success"),
        "reason",
    ]
    ledger = attempts.join(counts, "source", "left")
    if quarantine is not None:
        bad = quarantine.groupBy("source").agg(F.count(F.lit(1)).alias("bad"))
        ledger = ledger.join(bad, "source", "left")
        cells.append(F.coalesce("bad", F.lit(0)).alias("bad_rows"))
    return ledger.select(*cells)


def ledger_metrics(ledger: DataFrame) -> DataFrame:
    """Totals of a ledger: rows collected, sources failed."""
    return ledger.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.count_if(~F.col("success")).alias("failed_sources"),
    )


def corrupt_rows(
    spark: SparkSession, path: str, schema: T.StructType, source: str
) -> DataFrame:
    """Lines of a JSON lines source that do not parse, as a ledger row."""
    widened = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.schema(widened).option("mode", "PERMISSIVE").json(path)
    # The reader parses only when a column of the schema is asked for as well.
    fields = F.count(schema.names[0])
    return lines.agg(
        F.lit(source).alias("source"),
        F.count(F.lit(1)).alias("row_count"),
        F.count("_corrupt_record").alias("corrupt_rows"),
        fields.alias("read_rows"),
    ).where("read_rows >= 0").drop("read_rows")
