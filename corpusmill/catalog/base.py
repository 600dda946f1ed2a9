"""Registration of queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType)
_REAL = (T.FloatType, T.DoubleType)


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, real numbers with six places, so that both engines print alike."""
    cells = []
    for field in df.schema:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, _WHOLE):
            cell = cell.cast("bigint")
        elif isinstance(field.dataType, _REAL):
            cell = F.round(cell.cast("double"), 6) + F.lit(0.0)
        cells.append(cell.alias(field.name))
    return df.select(*cells)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator's name; ``sql`` is its statement for checking."""

    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, folder: tidy(build(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with long texts, read as it lies.

    A session on one machine may ask with ``spark.corpusmill.spread`` for so many partitions, since
    a test table is a single file of one row group; a cluster leaves that unset.
    """
    df = table(spark, folder, name)
    spread = spark.conf.get("spark.corpusmill.spread", None)
    return df.repartition(int(spread)) if spread else df


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quality label where they have one."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return text_table(spark, folder, "documents").join(labels, "doc_id", "left")


DOCS = (
    "docs AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality AS label "
    "FROM documents d LEFT JOIN labels l USING (doc_id))"
)


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with gaps: the shortest texts missing or blank, a language written as
    ``N/A``, and an audio column without values."""
    text = (
        F.when(F.col("n_chars") < 60, None)
        .when(F.col("n_chars") < 150, "  ")
        .otherwise(F.col("text"))
    )
    return docs(spark, folder).select(
        "doc_id",
        text.alias("text"),
        F.when(F.col("lang") == "es", "N/A").otherwise(F.col("lang")).alias("lang"),
        "source",
        "n_chars",
        F.lit(None).cast("string").alias("audio"),
        "label",
    )


DIRTY = (
    f"{DOCS}, dirty AS (SELECT doc_id, CASE WHEN n_chars < 60 THEN NULL WHEN n_chars < 150 THEN '  ' "
    "ELSE text END AS text, CASE WHEN lang = 'es' THEN 'N/A' ELSE lang END AS lang, source, n_chars, "
    "CAST(NULL AS VARCHAR) AS audio, label FROM docs)"
)


def gappy(spark: SparkSession, folder: str) -> DataFrame:
    """Line items whose zero discount and zero tax count as unknown."""
    items = table(spark, folder, "lineitem")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        "l_returnflag",
    )


GAPPY = (
    "gappy AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, "
    "NULLIF(l_discount, 0.0) AS l_discount, NULLIF(l_tax, 0.0) AS l_tax, l_returnflag FROM lineitem)"
)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(x: str) -> str:
    return rf"NULLIF(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '')"


def words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def clip(x: str, limit: int) -> str:
    s = strip(x)
    return (
        rf"NULLIF(CASE WHEN length({s}) > {limit} THEN regexp_replace(substr({s}, 1, {limit - 3}), "
        rf"'\s+$', '') || '...' ELSE {s} END, '')"
    )


def answer(x: str) -> str:
    """Normalised answer."""
    s = rf"regexp_replace({strip(x)}, '\s+', ' ', 'g')"
    return f"CASE WHEN lower({s}) IN ('', 'none', 'null', 'nan') THEN NULL ELSE {s} END"


def top(rows: str, sort: str, n: int) -> str:
    return f"SELECT * FROM ({rows}) ORDER BY {sort} LIMIT {n}"
