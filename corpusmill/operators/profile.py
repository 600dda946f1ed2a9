"""Describing a table: counts, distributions, lengths, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.stats import (
    fences,
    finite,
    quantile_at,
    quantile_map,
    rows_from,
    with_scalar,
)
from corpusmill.functions.text import NULL_WORDS, strip_ws, word_count
from corpusmill.schema import numeric_columns
from corpusmill.settings import cut_lineage

TOP_VALUES = 10
HISTOGRAM_BINS = 30


def present(field: T.StructField, sentinels: bool = False) -> Column:
    """True where a cell holds a value: not null, not NaN, optionally not a null word."""
    cell = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return cell.isNotNull() & ~F.isnan(cell)
    if sentinels and isinstance(field.dataType, T.StringType):
        return cell.isNotNull() & ~F.lower(strip_ws(cell)).isin(NULL_WORDS)
    return cell.isNotNull()


def profile_table(df: DataFrame) -> DataFrame:
    """Per column: position, type, row count and non-null count, from one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(present(f)).alias(f"c{i}") for i, f in enumerate(df.schema)],
    )
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("n").alias("row_count"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, f in enumerate(df.schema)
    ]
    return counted.select(F.explode(F.array(*cells)).alias("p")).select("p.*")


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing cells, most missing first."""
    missing = (F.col("row_count") - F.col("non_null")).alias("missing")
    return (
        profile_table(df)
        .select("column", missing)
        .where("missing > 0")
        .orderBy(F.desc("missing"), "column")
    )


def value_counts(df: DataFrame, column: str, top: int | None = TOP_VALUES) -> DataFrame:
    """Non-null values as text with their counts, most frequent first."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return counts if top is None else counts.orderBy(F.desc("rows"), "value").limit(top)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """The ten most frequent labels."""
    return value_counts(df, label)


def profile_source(df: DataFrame, source: str = "source") -> DataFrame:
    """The ten largest sources; no rows when the column is null throughout."""
    return value_counts(df, source)


def profile_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels, the ten most frequent, and moments of a numeric label."""
    counts = value_counts(df, label, top=None)
    unique = counts.agg(F.count(F.lit(1)).alias("u"))
    rows = rows_from(unique, [("label", "unique_count", "", F.col("u"))])
    top = counts.orderBy(F.desc("rows"), "value").limit(TOP_VALUES).select(
        F.lit("label").alias("section"),
        F.lit("top_value").alias("metric"),
        F.col("value").alias("column"),
        F.col("rows").cast("double").alias("value"),
    )
    rows = rows.unionByName(top)
    if isinstance(df.schema[label].dataType, T.NumericType):
        rows = rows.unionByName(_describe(df, label))
    return rows


def _describe(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    quartiles = quantile_map(df, [column], [0.25, 0.5, 0.75])
    moments = df.agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    described = with_scalar(moments, "q", quartiles)
    values = {name: F.col(name) for name in ("count", "mean", "std", "min", "max")}
    for k, name in enumerate(("25%", "50%", "75%")):
        values[name] = quantile_at("q", column, k)
    return rows_from(described, [("label", f"describe_{m}", "", c) for m, c in values.items()])


def profile_text_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Words per text (null counts 0): mean, median, ninth decile, maximum."""
    # Counted in one read of the texts; the figures then need the counts only.
    words = cut_lineage(df.select(word_count(F.col(text)).alias("words")))
    stats = with_scalar(
        words.agg(F.avg("words").alias("mean"), F.max("words").alias("max")),
        "q",
        quantile_map(words, ["words"], [0.5, 0.9]),
    )
    return stats.select(
        "mean",
        quantile_at("q", "words", 0).alias("median"),
        quantile_at("q", "words", 1).alias("p90"),
        "max",
    )


def metadata_keys(
    df: DataFrame,
    metadata: str = "metadata",
    key: str | None = None,
    sample_rows: int | None = None,
    top: int = TOP_VALUES,
) -> DataFrame:
    """Most common member names of JSON metadata.

    All rows count by default; ``sample_rows`` keeps the first ones in key order.
    """
    rows = df.where(F.col(metadata).isNotNull())
    if sample_rows is not None:
        rows = rows.orderBy(key).limit(sample_rows)
    return (
        rows.select(F.explode(F.json_object_keys(F.col(metadata))).alias("name"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "name")
        .limit(top)
    )


def recommended_sections(
    df: DataFrame, label: str = "label", text: str = "text", source: str = "source"
) -> DataFrame:
    """Report sections that the data can fill, in report order."""
    wanted = [
        (label, "label_distribution"),
        (text, "text_length_distribution"),
        (source, "source_distribution"),
    ]
    usable = [(column, section) for column, section in wanted if column in df.columns]
    flags = df.agg(F.lit(0).alias("_"), *[F.count(c).alias(s) for c, s in usable])
    names = [F.lit("overview"), F.lit("missingness")]
    names += [F.when(F.col(s) > 0, F.lit(s)) for _, s in usable]
    return flags.select(
        F.posexplode(F.array_compact(F.array(*names))).alias("position", "section")
    )


def length_histogram(df: DataFrame, text: str = "text", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Word counts in equal bins between minimum and maximum, the last one closed."""
    words = cut_lineage(df.select(word_count(F.col(text)).cast("double").alias("x")))
    ends = words.agg(F.array(F.min("x"), F.max("x")).alias("e"))
    # A single value gets a range of one around it.
    flat = F.col("e")[0] == F.col("e")[1]
    low = F.when(flat, F.col("e")[0] - 0.5).otherwise(F.col("e")[0])
    high = F.when(flat, F.col("e")[1] + 0.5).otherwise(F.col("e")[1])
    width = (high - low) / bins
    slot = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("long")
    counts = (
        with_scalar(words, "e", ends).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    )
    grid = with_scalar(df.sparkSession.range(bins).withColumnRenamed("id", "bin"), "e", ends)
    edges = grid.select("bin", (low + F.col("bin") * width).alias("lower"))
    return edges.join(counts, "bin", "left").select(
        "bin", "lower", F.coalesce("rows", F.lit(0)).alias("rows")
    )


def label_coverage_by_source(
    df: DataFrame, source: str = "source", label: str = "label", top: int | None = TOP_VALUES
) -> DataFrame:
    """Share of labelled rows per source (null source kept), best covered first."""
    shares = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(label).isNotNull().cast("double")).alias("coverage"),
    )
    return shares if top is None else shares.orderBy(F.desc("coverage"), source).limit(top)


def boxplot_stats(
    df: DataFrame, exclude: set[str] | None = None, modality: str | None = None
) -> DataFrame:
    """Quartiles, whiskers and number of outlying values per numeric column.

    Nothing to plot when a text table has no numeric column but its label.
    """
    columns = numeric_columns(df.schema, exclude)
    if modality == "text" and columns == ["label"]:
        columns = []
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, q1 double, median double, q3 double, whisker_low double, "
            "whisker_high double, fliers bigint"
        )
    boxed = with_scalar(df, "__q", quantile_map(df, columns, [0.25, 0.5, 0.75]))
    aggs = [F.any_value("__q").alias("q")]
    for i, name in enumerate(columns):
        v = finite(name)
        low, high = fences("__q", name, 0, 2)
        aggs += [
            F.min(F.when(v >= low, v)).alias(f"lo{i}"),
            F.max(F.when(v <= high, v)).alias(f"hi{i}"),
            F.count_if((v < low) | (v > high)).alias(f"out{i}"),
        ]
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            quantile_at("q", name, 0).alias("q1"),
            quantile_at("q", name, 1).alias("median"),
            quantile_at("q", name, 2).alias("q3"),
            F.least(F.col(f"lo{i}"), quantile_at("q", name, 0)).alias("whisker_low"),
            F.greatest(F.col(f"hi{i}"), quantile_at("q", name, 2)).alias("whisker_high"),
            F.col(f"out{i}").alias("fliers"),
        )
        for i, name in enumerate(columns)
    ]
    return boxed.agg(*aggs).select(F.explode(F.array(*cells)).alias("b")).select("b.*")


def top_words(df: DataFrame, text: str = "text", top: int = 20) -> DataFrame:
    """Most frequent words (runs of letters, lower case)."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))
    return (
        df.select(F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "word")
        .limit(top)
    )


def preview(df: DataFrame, key: str, rows: int = 3) -> DataFrame:
    """First rows in key order as JSON records."""
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.orderBy(key).limit(rows).select(key, record.alias("record"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share of every class."""
    counts = value_counts(df, label, top=None)
    total = counts.agg(F.sum("rows").alias("total"))
    return with_scalar(counts, "total", total).select(
        "value", "rows", (F.col("rows") / F.col("total")).alias("share")
    )
