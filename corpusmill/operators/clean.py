"""Cleaning. Each operator does one thing; :func:`fix` runs them in a fixed order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.stats import (
    fences,
    quantile_at,
    quantile_map,
    rows_from,
    with_scalar,
)
from corpusmill.functions.text import (
    compute_once,
    content_key,
    looks_numeric,
    normalize_text,
    strip_ws,
    text_key,
)
from corpusmill.operators.detect import (
    all_null_columns,
    detect_duplicate_rows,
    detect_missing,
    is_blank,
    label_semantics,
    outliers_iqr,
    sparsity_bucket,
)
from corpusmill.operators.profile import present
from corpusmill.schema import numeric_columns
from corpusmill.settings import cut_lineage, join_small

# What is done when nothing else is asked.
DEFAULT_STRATEGY = {"missing": "median", "duplicates": "drop", "outliers": "clip_iqr"}

MISSING_OPTIONS = ["median", "mean", "mode", "drop", "keep"]
DUPLICATE_OPTIONS = ["drop", "keep"]
OUTLIER_OPTIONS = ["clip_iqr", "drop_iqr", "keep"]


def _numbers(df: DataFrame, columns: Sequence[str] | None, protect: Sequence[str]) -> list[str]:
    names = list(columns) if columns is not None else numeric_columns(df.schema)
    return [name for name in names if name not in protect]


def _value(name: str) -> Column:
    """A numeric cell as double, NaN as null."""
    cell = F.col(name).cast("double")
    return F.when(~F.isnan(cell), cell)


# -------------------------------------------------------------------- missing values


def impute_median(
    df: DataFrame, columns: Sequence[str] | None = None, protect: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """Numeric gaps filled with the column's median; filled columns are double."""
    names = _numbers(df, columns, protect)
    return _filled(df, names, quantile_map(df, names, [0.5], exact)) if names else df


def _filled(df: DataFrame, names: Sequence[str], values: DataFrame) -> DataFrame:
    """Gaps of the columns filled from a one-row map, as :func:`quantile_map` gives it."""
    filled = with_scalar(df, "__q", values)
    return filled.withColumns({n: F.coalesce(_value(n), quantile_at("__q", n, 0)) for n in names}).drop("__q")


def impute_mean(
    df: DataFrame, columns: Sequence[str] | None = None, protect: Sequence[str] = ()
) -> DataFrame:
    """Numeric gaps filled with the column's mean; filled columns are double."""
    names = _numbers(df, columns, protect)
    return _filled(df, names, _means(df, names)) if names else df


def _means(df: DataFrame, names: Sequence[str]) -> DataFrame:
    means = F.map_from_entries(
        F.array(*[F.struct(F.lit(n), F.array(F.avg(_value(n)))) for n in names])
    )
    return df.agg(means.alias("q"))


def impute_mode(df: DataFrame, columns: Sequence[str], protect: Sequence[str] = ()) -> DataFrame:
    """Gaps of any type filled with the most frequent value, ties by the smallest.

    All columns are counted in one grouping by the digest of a value, so no text is shuffled; the
    values behind the most frequent digests are looked up afterwards. A column in which every value
    is alone needs no lookup: its smallest value it is.
    """
    names = [n for n in columns if n not in protect]
    if not names:
        return df
    fields = {f.name: f for f in df.schema}
    filled = [present(fields[n]) for n in names]
    keys = [
        F.struct(F.lit(i).alias("c"), content_key([(n, fields[n].dataType)]).alias("d")) for i, n in enumerate(names)
    ]
    digests = df.select(F.explode(F.array_compact(F.array(*map(F.when, filled, keys)))).alias("r")).select("r.*")
    counts = cut_lineage(digests.groupBy("c", "d").agg(F.count(F.lit(1)).alias("n")))
    # One row per column.
    most = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.max("n").alias("n")).collect()}
    repeated = [i for i, n in most.items() if n > 1]
    least = [F.min(F.when(here, F.col(n))).alias(n) for i, (n, here) in enumerate(zip(names, filled)) if i not in repeated]
    modes = [df.agg(*least)] if least else []
    if repeated:
        highest = F.create_map(*[F.lit(x) for i in repeated for x in (i, most[i])])
        winners = counts.where(F.col("n") == F.element_at(highest, F.col("c"))).select("c", "d")
        values = [
            F.struct(
                F.lit(i).alias("c"), keys[i]["d"].alias("d"),
                *[(F.col(names[k]) if k == i else F.lit(None).cast(fields[names[k]].dataType)).alias(f"v{k}") for k in repeated],
            )
            for i in repeated
        ]
        cells = F.array(*[F.when(filled[i], v) for i, v in zip(repeated, values)])
        found = join_small(df.select(F.explode(F.array_compact(cells)).alias("r")).select("r.*"), winners, ["c", "d"])
        modes.append(found.agg(*[F.min(f"v{k}").alias(names[k]) for k in repeated]))
    for k, mode in enumerate(modes):
        df = with_scalar(df, f"__m{k}", mode.select(F.struct(*mode.columns).alias("m")))
        for name in mode.columns:
            cell = F.when(present(fields[name]), F.col(name))
            df = df.withColumn(name, F.coalesce(cell, F.col(f"__m{k}")[name]))
    return df.drop(*[f"__m{k}" for k in range(len(modes))])


def drop_missing(
    df: DataFrame, columns: Sequence[str] | None = None, label: str = "label"
) -> DataFrame:
    """Rows with a gap in the chosen columns removed; by default all but the label."""
    names = list(columns) if columns is not None else [c for c in df.columns if c != label]
    return df.dropna(subset=names)


# ------------------------------------------------------------------------ duplicates


def drop_duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """First row (smallest key) of each set of rows equal in everything but the key.

    Digests fold on the map side and meet the table again on its unique key, so
    neither shuffle sees a large group.
    """
    columns = [(f.name, f.dataType) for f in df.schema if f.name != key]
    keys = compute_once(df, [key], __k=content_key(columns))
    firsts = keys.groupBy("__k").agg(F.min(key).alias(key)).select(key)
    return df.join(firsts, key, "left_semi")


def dedup_text_keep_richest(
    df: DataFrame,
    key: str,
    text: str = "text",
    label: str = "label",
    keep_math: bool = False,
) -> DataFrame:
    """One row per normalised text: labelled first, then the fullest, then the smallest key.

    Full means most cells with a value, then the longest metadata. Rows with a
    blank text are kept, each standing for itself.
    """
    norm = F.nullif(normalize_text(F.col(text), keep_math), F.lit(""))
    group = F.coalesce(text_key(norm), F.col(key).cast("string").cast("binary"))
    unlabeled = F.col(label).isNull() if label in df.columns else F.lit(False)
    filled = sum((present(f).cast("int") for f in df.schema), F.lit(0))
    extra = F.coalesce(F.length("metadata"), F.lit(0)) if "metadata" in df.columns else F.lit(0)
    order = F.struct(
        unlabeled.alias("unlabeled"),
        (-filled).alias("filled"),
        (-extra).alias("extra"),
        F.col(key).alias("key"),
    )
    best = compute_once(df, [], group=group, order=order).groupBy("group").agg(
        F.min("order").alias("best")
    )
    return df.join(best.select(F.col("best.key").alias(key)), key, "left_semi")


# -------------------------------------------------------------------------- outliers


def clip_iqr(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    protect: Sequence[str] = (),
    exact: bool = True,
    basis: DataFrame | None = None,
) -> DataFrame:
    """Numbers pulled to the interquartile fences; gaps stay; clipped columns are double.

    ``basis`` may hold the same numbers in a table that is cheaper to read.
    """
    names = _numbers(df, columns, protect)
    if not names:
        return df
    clipped = with_scalar(df, "__q", quantile_map(df if basis is None else basis, names, [0.25, 0.75], exact))
    cells = {}
    for name in names:
        low, high = fences("__q", name)
        v = _value(name)
        cells[name] = F.when(v.isNotNull(), F.least(F.greatest(v, low), high))
    return clipped.withColumns(cells).drop("__q")


def drop_iqr(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    protect: Sequence[str] = (),
    exact: bool = True,
    basis: DataFrame | None = None,
) -> DataFrame:
    """Rows with a number outside the interquartile fences removed; gaps pass.

    ``basis`` may hold the same numbers in a table that is cheaper to read.
    """
    names = _numbers(df, columns, protect)
    if not names:
        return df
    checked = with_scalar(df, "__q", quantile_map(df if basis is None else basis, names, [0.25, 0.75], exact))
    inside = F.lit(True)
    for name in names:
        inside = inside & F.coalesce(_value(name).between(*fences("__q", name)), F.lit(True))
    return checked.where(inside).drop("__q")


# ------------------------------------------------------------------------------ text


def trim_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Whitespace around the text removed; nothing inside changes."""
    return df.withColumn(text, strip_ws(F.col(text)))


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text)))


# ------------------------------------------------------------------- rows and columns


def drop_all_null_columns(df: DataFrame, protect: Sequence[str] = ()) -> DataFrame:
    """Columns without a single value removed (one counting job decides which)."""
    empty = [r["column"] for r in all_null_columns(df).collect()]
    return df.drop(*[name for name in empty if name not in protect])


def drop_sparse_rows(
    df: DataFrame, text: str = "text", label: str = "label", exclude: set[str] | None = None
) -> DataFrame:
    """Mostly empty rows and rows without content removed; unlabelled ones stay."""
    bucket = sparsity_bucket(df, text, label, exclude)
    return df.where(~bucket.isin("no_content", "sparse"))


def flag_unlabeled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("label_missing", F.col(label).isNull())


def supervised_subset(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """The full table and, beside it, its labelled rows."""
    return df, df.where(F.col(label).isNotNull())


def drop_rows_missing_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Only on request: rows without a label removed."""
    return df.where(F.col(label).isNotNull())


def flag_label_format(df: DataFrame, label: str = "label") -> DataFrame:
    """``label_format_mismatch``: a label that is numeric where most are text, or the reverse."""
    ratio = label_semantics(df, label).select("numeric_ratio")
    numeric = looks_numeric(F.col(label).cast("string"))
    odd = numeric != (F.col("__r") >= 0.5)
    flagged = with_scalar(df, "__r", ratio)
    return flagged.withColumn(
        "label_format_mismatch", F.col(label).isNotNull() & F.coalesce(odd, F.lit(False))
    ).drop("__r")


# ------------------------------------------------------------------------------- fix


def resolve_strategy(options: Mapping | None) -> dict:
    """Defaults overridden by every option that is not null."""
    chosen = {**DEFAULT_STRATEGY, **{k: v for k, v in (options or {}).items() if v is not None}}
    for name, allowed in (
        ("missing", MISSING_OPTIONS),
        ("duplicates", DUPLICATE_OPTIONS),
        ("outliers", OUTLIER_OPTIONS),
    ):
        if chosen[name] not in allowed:
            raise ValueError(f"Unknown option for {name}: {chosen[name]!r}")
    return chosen


def fix(
    df: DataFrame,
    key: str,
    strategy: Mapping | None = None,
    text: str = "text",
    label: str = "label",
    exact: bool = True,
) -> DataFrame:
    """A table cleaned under a strategy: duplicates, text, row and column actions,
    gaps, outliers, label actions, in this order. The label is never rewritten.
    """
    from corpusmill.plans.strategy import apply_actions

    chosen = resolve_strategy(strategy)
    out = drop_duplicate_rows(df, key) if chosen["duplicates"] == "drop" else df
    early = {
        block: chosen.get(block, [])
        for block in ("text_actions", "row_actions", "column_actions", "target_actions")
    }
    out = apply_actions(out, early, key, text, label)
    protect = [key, label]
    numbers = _numbers(out, None, protect)
    if chosen["missing"] == "mode":
        plain = (T.MapType, T.StructType, T.ArrayType)
        names = [f.name for f in out.schema if not isinstance(f.dataType, plain)]
        out = impute_mode(out, names, protect)
    elif chosen["missing"] == "drop":
        out = drop_missing(out, label=label)
    if numbers and (chosen["missing"] in ("median", "mean") or chosen["outliers"] != "keep"):
        # The statistics read the rows several times, but only their numbers: those are stored and
        # treated like the rows, which are read once at the end.
        slim = cut_lineage(out.select(*numbers))
        if chosen["missing"] in ("median", "mean"):
            median = chosen["missing"] == "median"
            values = cut_lineage(quantile_map(slim, numbers, [0.5], exact) if median else _means(slim, numbers))
            out, slim = _filled(out, numbers, values), _filled(slim, numbers, values)
        if chosen["outliers"] == "clip_iqr":
            out = clip_iqr(out, numbers, exact=exact, basis=slim)
        elif chosen["outliers"] == "drop_iqr":
            out = drop_iqr(out, numbers, exact=exact, basis=slim)
    return apply_actions(out, {"label_actions": chosen.get("label_actions", [])}, key, text, label)


def fix_summary(before: DataFrame, after: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Rows in, out and removed; gaps, duplicate rows and outliers left, as metric rows."""
    rows_in = before.agg(F.count(F.lit(1)).alias("n"))
    rows_out = with_scalar(after.agg(F.count(F.lit(1)).alias("n_out")), "n_in", rows_in)
    rows = rows_from(
        rows_out,
        [
            ("summary", "input_rows", "", F.col("n_in")),
            ("summary", "output_rows", "", F.col("n_out")),
            ("summary", "rows_removed", "", F.col("n_in") - F.col("n_out")),
        ],
    )
    content = after.drop(key)
    missing = detect_missing(content).where("metric = 'total'").select("value")
    repeated = detect_duplicate_rows(after, {key}).select("duplicate_rows")
    rows = rows.unionByName(rows_from(missing, [("summary", "missing_after", "", F.col("value"))]))
    rows = rows.unionByName(
        rows_from(repeated, [("summary", "duplicates_after", "", F.col("duplicate_rows"))])
    )
    if numeric_columns(content.schema, {label}):
        outliers = outliers_iqr(content, exclude={label}).where("metric = 'iqr_total'").select("value")
        rows = rows.unionByName(
            rows_from(outliers, [("summary", "outliers_after", "", F.col("value"))])
        )
    return rows


