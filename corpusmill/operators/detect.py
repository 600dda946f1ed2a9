"""Finding quality issues. Counts come back as tall metric rows
``(section, metric, column, value)``; a metric of the whole table has an empty column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.stats import (
    Z_LIMIT,
    finite,
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
    word_count,
)
from corpusmill.operators.profile import present, value_counts
from corpusmill.schema import numeric_columns, string_columns
from corpusmill.settings import cut_lineage

IMBALANCE_THRESHOLD = 0.75
NEAR_EMPTY_WORDS = 3
SPARSE_SHARE = 0.5
STEM_WORDS = 8

# Names taken for a label column when none is configured.
LABEL_NAMES = ["label", "labels", "sentiment", "target", "class"]

# A text reads as cut off unless it ends in one of the marks,
# perhaps followed by closing signs.
END_MARKS = [".", "!", "?", "…", "。", "！", "？"]
CLOSING_SIGNS = "\"'»”’)]"


def primary_text(df: DataFrame, hint: str | None = None) -> str | None:
    """Main text column: the hint, else ``text``, else the first string column."""
    if hint in df.columns:
        return hint
    strings = string_columns(df.schema)
    return "text" if "text" in strings else next(iter(strings), None)


def label_column(df: DataFrame, configured: str | None = None) -> str | None:
    """Label column: the configured one, else the first with a usual name."""
    if configured in df.columns:
        return configured
    return next((name for name in LABEL_NAMES if name in df.columns), None)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip_ws(c) == "")


# -------------------------------------------------------------------------- missing


def _missing_aggs(df: DataFrame, sentinels: bool) -> list[Column]:
    return [F.count_if(~present(f, sentinels)).alias(f"m{i}") for i, f in enumerate(df.schema)]


def _missing_rows(df: DataFrame, tail: str = "") -> list[tuple[str, str, str, Column]]:
    parts = [F.col(f"m{i}{tail}") for i in range(len(df.columns))]
    total = sum(parts[1:], parts[0])
    return [("missing", "total", "", total)] + [
        ("missing", "by_column", name, part) for name, part in zip(df.columns, parts)
    ]


def detect_missing(df: DataFrame, sentinels: bool = False) -> DataFrame:
    """Missing cells in total and per column; ``sentinels`` also counts null words."""
    return rows_from(df.agg(*_missing_aggs(df, sentinels)), _missing_rows(df))


def all_null_columns(df: DataFrame) -> DataFrame:
    """Columns without a single value, in schema order."""
    counted = df.agg(*[F.count_if(present(f)).alias(f"c{i}") for i, f in enumerate(df.schema)])
    names = F.array(
        *[F.when(F.col(f"c{i}") == 0, F.lit(name)) for i, name in enumerate(df.columns)]
    )
    return counted.select(F.posexplode(F.array_compact(names)).alias("position", "column"))


# ----------------------------------------------------------------------- duplicates


def _columns(df: DataFrame, exclude: set[str]) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in df.schema if f.name not in exclude]


def detect_duplicate_rows(df: DataFrame, exclude: set[str] | None = None) -> DataFrame:
    """Rows beyond the first of each set of equal rows.

    The map side folds copies before the shuffle, so one row repeated
    everywhere costs one group entry per task.
    """
    keyed = df.groupBy(content_key(_columns(df, exclude or set())).alias("k"))
    groups = keyed.agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def text_groups(df: DataFrame, text: str, by: list[str] | None = None, normalized: bool = True) -> DataFrame:
    """Rows per distinct text (and ``by`` columns); blank texts are left out."""
    form = normalize_text(F.col(text)) if normalized else F.col(text)
    keys = compute_once(df, by or [], text_key=text_key(F.nullif(form, F.lit(""))))
    return (
        keys.where("text_key IS NOT NULL")
        .groupBy("text_key", *(by or []))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def detect_duplicate_text(df: DataFrame, text: str = "text", normalized: bool = True) -> DataFrame:
    """Rows that repeat a text seen before, compared in normalised form."""
    return text_groups(df, text, normalized=normalized).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_texts"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicate_text_rows"),
    )


def near_dup_stems(df: DataFrame, text: str = "text", words: int = STEM_WORDS) -> DataFrame:
    """Openings shared by different texts: ``(stem, rows, variants)``.

    Copies fold per text before they meet under their stem.
    """
    norm = F.nullif(normalize_text(F.col(text)), F.lit(""))
    texts = compute_once(df, [], t=norm).where("t IS NOT NULL")
    variants = texts.groupBy(
        F.substring_index("t", " ", words).alias("stem"), text_key(F.col("t")).alias("k")
    ).agg(F.count(F.lit(1)).alias("n"))
    return (
        variants.groupBy("stem")
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("variants"))
        .where("variants > 1")
    )


def cross_source_duplicates(
    df: DataFrame, key: str, text: str = "text", source: str = "source"
) -> DataFrame:
    """Texts that occur in more than one source: first key, sources, rows."""
    norm = F.nullif(normalize_text(F.col(text)), F.lit(""))
    per_source = (
        compute_once(df, [key, source], __k=text_key(norm))
        .where("__k IS NOT NULL")
        .groupBy("__k", source)
        .agg(F.count(F.lit(1)).alias("__n"), F.min(key).alias("__first"))
    )
    return (
        per_source.groupBy("__k")
        .agg(
            F.min("__first").alias("first_key"),
            F.count(source).alias("sources"),
            F.sum("__n").alias("rows"),
        )
        .where("sources > 1")
        .drop("__k")
    )


# ------------------------------------------------------------------------- outliers


def outliers_iqr(
    df: DataFrame, columns: list[str] | None = None, exclude: set[str] | None = None, exact: bool = True
) -> DataFrame:
    """Values outside the interquartile fences per numeric column, bounds, and the total."""
    names = columns or numeric_columns(df.schema, exclude)
    quartiles = quantile_map(df, names, [0.25, 0.75], exact)
    bounds = {name: fences("__q", name) for name in names}
    return _outliers(with_scalar(df, "__q", quartiles), names, bounds, "iqr", F.col("__q"))


def outliers_zscore(
    df: DataFrame, columns: list[str] | None = None, exclude: set[str] | None = None
) -> DataFrame:
    """Values more than three population deviations from the mean, and the total."""
    names = columns or numeric_columns(df.schema, exclude)
    moments = [
        F.struct(F.lit(n), F.array(F.avg(finite(n)), F.stddev_pop(finite(n)))) for n in names
    ]
    q = df.agg(F.map_from_entries(F.array(*moments)).alias("q"))
    bounds = {}
    for name in names:
        mean, spread = quantile_at("__q", name, 0), quantile_at("__q", name, 1)
        bounds[name] = (mean - Z_LIMIT * spread, mean + Z_LIMIT * spread)
    return _outliers(with_scalar(df, "__q", q), names, bounds, "zscore", F.col("__q"))


def _outliers(df: DataFrame, names: list[str], bounds: dict, method: str, q: Column) -> DataFrame:
    aggs = [
        F.count_if((finite(n) < bounds[n][0]) | (finite(n) > bounds[n][1])).alias(f"o{i}")
        for i, n in enumerate(names)
    ]
    counted = df.agg(F.any_value("__q").alias("__q"), *aggs)
    parts = [F.col(f"o{i}") for i in range(len(names))]
    entries = [("outliers", f"{method}_total", "", sum(parts[1:], parts[0]))]
    for name, part in zip(names, parts):
        low, high = bounds[name]
        entries += [
            ("outliers", f"{method}_count", name, part),
            ("outliers", f"{method}_lower", name, low),
            ("outliers", f"{method}_upper", name, high),
        ]
    return rows_from(counted, entries)


# --------------------------------------------------------------------------- labels


def label_semantics(df: DataFrame, label: str = "label") -> DataFrame:
    """Does the label name classes or measure something?

    Read off the distinct values and their counts, so rows are scanned once.
    """
    return semantics_of(value_counts(df, label, top=None))


def semantics_of(counts: DataFrame) -> DataFrame:
    """:func:`label_semantics` of the distinct labels: ``counts`` holds ``value`` and ``rows``."""
    return counts.agg(*_semantics_aggs("rows")).select(*_semantics())


def _semantics_aggs(rows: str, tail: str = "") -> list[Column]:
    n = F.col(rows)
    return [
        F.coalesce(F.sum(n), F.lit(0)).alias(f"n{tail}"),
        F.count(n).alias(f"distinct_labels{tail}"),
        F.sum(F.when(looks_numeric(F.col("value")), n).otherwise(0)).alias(f"numeric{tail}"),
        F.max(n).alias(f"majority{tail}"),
    ]


def _semantics(tail: str = "") -> list[Column]:
    n, distinct = F.col(f"n{tail}"), F.col(f"distinct_labels{tail}")
    ratio = F.coalesce(F.col(f"numeric{tail}") / F.nullif(n, F.lit(0)), F.lit(0.0))
    limit = F.least(F.lit(20), F.greatest(F.lit(5), F.floor(n / 2)))
    regression = (ratio >= 0.8) & (distinct > limit)
    kind = F.when(regression, F.lit("regression")).otherwise(F.lit("classification"))
    return [n, distinct, ratio.alias(f"numeric_ratio{tail}"), F.col(f"majority{tail}"), kind.alias(f"kind{tail}")]


def _imbalance_entries(label: str, threshold: float, tail: str = "") -> list[tuple[str, str, str, Column]]:
    applies = (F.col(f"kind{tail}") == "classification") & (F.col(f"n{tail}") > 0)
    share = F.when(applies, F.col(f"majority{tail}") / F.nullif(F.col(f"n{tail}"), F.lit(0)))
    return [
        ("imbalance", "applicable", label, applies.cast("int")),
        ("imbalance", "classes", label, F.when(applies, F.col(f"distinct_labels{tail}"))),
        ("imbalance", "majority_share", label, share),
        ("imbalance", "is_imbalanced", label, (share >= threshold).cast("int")),
    ]


def detect_imbalance(
    df: DataFrame, label: str | None = None, threshold: float = IMBALANCE_THRESHOLD
) -> DataFrame:
    """Share of the largest class; not applicable to a label that measures something."""
    name = label_column(df, label)
    return rows_from(label_semantics(df, name), _imbalance_entries(name, threshold))


# ----------------------------------------------------------------------------- text


def _text_facts(text: str) -> dict[str, Column]:
    """What the text figures need of a row: length, shortness, ending, identity.

    ``__len`` is null for a blank text.
    """
    c = F.col(text)
    filled = ~is_blank(c)
    last = F.right(F.rtrim(strip_ws(c), F.lit(CLOSING_SIGNS)), F.lit(1))
    norm = F.nullif(normalize_text(c), F.lit(""))
    return {
        "__len": F.when(filled, F.length(c)).cast("double"),
        "__near": filled & (word_count(c) < NEAR_EMPTY_WORDS),
        "__cut": filled & ~last.isin(END_MARKS),
        "__text": text_key(norm),
    }


def _text_aggs(tail: str = "", here: Column | None = None) -> list[Column]:
    """Figures of the rows ``here`` (all of them); ``__len`` and ``__q`` hold their lengths and quartiles."""
    size = F.col(f"__len{tail}")
    low, high = fences("__q", f"__len{tail}", 0, 2)
    own = F.lit(True) if here is None else here
    return [
        F.count_if(own & size.isNull()).alias(f"t_empty{tail}"),
        F.count_if(own & F.col("__near")).alias(f"t_near{tail}"),
        F.count_if(size < low).alias(f"t_short{tail}"),
        F.count_if(size > high).alias(f"t_long{tail}"),
        F.count_if(own & F.col("__cut")).alias(f"t_cut{tail}"),
        F.avg(size).alias(f"t_mean{tail}"),
        F.max(size).alias(f"t_max{tail}"),
    ]


def _text_entries(tail: str = "") -> list[tuple[str, str, str, Column]]:
    names = {
        "empty_rows": "t_empty",
        "near_empty_rows": "t_near",
        "short_rows": "t_short",
        "long_rows": "t_long",
        "truncated_rows": "t_cut",
        "chars_mean": "t_mean",
        "chars_max": "t_max",
    }
    rows = [("text", metric, "", F.col(f"{column}{tail}")) for metric, column in names.items()]
    return [*rows, ("text", "chars_median", "", quantile_at("q", f"__len{tail}", 1))]


def text_profile(df: DataFrame, text: str | None = None, exact: bool = True) -> DataFrame:
    """Empty, near-empty, extreme, cut-off and repeated texts, and length figures.

    One read of the texts writes a slim row per text; the rest works on those.
    """
    facts = cut_lineage(df.select(*_named(_text_facts(primary_text(df, text)))))
    q = quantile_map(facts, ["__len"], [0.25, 0.5, 0.75], exact)
    counted = with_scalar(facts, "__q", q).agg(*_text_aggs(), F.any_value("__q").alias("q"))
    profile = rows_from(counted, _text_entries())
    texts = facts.where("__text IS NOT NULL").groupBy("__text").agg(F.count(F.lit(1)).alias("n"))
    extra = texts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    repeated = rows_from(extra, [("text", "duplicate_text_rows", "", F.col("extra"))])
    return profile.unionByName(repeated)


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


# ------------------------------------------------------------------------- sparsity


def sparsity_bucket(df: DataFrame, text: str, label: str | None = "label", exclude: set[str] | None = None) -> Column:
    """Kind of a row: ``no_content``, ``sparse``, ``informative_unlabeled`` or ``complete``."""
    fields = [f for f in df.schema if f.name not in (exclude or set())]
    empty = sum(((~present(f)).cast("int") for f in fields), F.lit(0))
    kind = F.when(is_blank(F.col(text)), "no_content").when(
        empty / len(fields) > SPARSE_SHARE, "sparse"
    )
    if label in df.columns:
        kind = kind.when(F.col(label).isNull(), "informative_unlabeled")
    return kind.otherwise("complete")


def sparsity_profile(
    df: DataFrame, text: str = "text", label: str | None = "label", exclude: set[str] | None = None
) -> DataFrame:
    """Rows per kind of :func:`sparsity_bucket`."""
    return df.groupBy(sparsity_bucket(df, text, label, exclude).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows")
    )


# --------------------------------------------------------------------------- report


def quality_report(
    df: DataFrame,
    key: str | None = None,
    text: str | None = None,
    label: str | None = None,
    threshold: float = IMBALANCE_THRESHOLD,
    exact: bool = True,
) -> DataFrame:
    """Everything above as one tall table, after a single read of the input.

    That read writes a slim row of facts per row: which cells are missing, the
    numbers, text length and flags, and the keys of row and text. All counts,
    fences and groups come from the facts. Row and text duplicates share a
    grouping, because the text is part of the row.
    """
    return sided_reports([df], key, text, label, threshold, exact).drop("side")


class _Side:
    """One of the tables that a report measures; its own columns of the facts end in its number."""

    def __init__(self, number: int, df: DataFrame, key: str | None, text: str | None, label: str | None):
        self.number, self.tail, self.width = number, f"_{number}", len(df.columns)
        self.body, self.target = primary_text(df, text), label_column(df, label)
        self.content = df.drop(key) if key else df
        skip = {name for name in (key, self.target) if name}
        self.numbers = numeric_columns(self.content.schema, skip)
        self.measured = [f"n{i}{self.tail}" for i in range(len(self.numbers))]
        self.here = F.col("side") == number

    def facts(self) -> DataFrame:
        own = _text_facts(self.body)
        own[f"__len{self.tail}"] = own.pop("__len")
        target = F.col(self.target).cast("string") if self.target else F.lit(None).cast("string")
        return self.content.select(
            F.lit(self.number).alias("side"),
            *[(~present(f)).alias(f"m{i}{self.tail}") for i, f in enumerate(self.content.schema)],
            *[F.col(n).cast("double").alias(c) for n, c in zip(self.numbers, self.measured)],
            *_named(own),
            content_key(_columns(self.content, set())).alias("__row"),
            target.alias("__label"),
        )

    def aggs(self) -> list[Column]:
        outs = []
        for i, name in enumerate(self.measured):
            low, high = fences("__q", name, 0, 2)
            outs.append(F.count_if((finite(name) < low) | (finite(name) > high)).alias(f"o{i}{self.tail}"))
        missing = [F.count_if(f"m{i}{self.tail}").alias(f"m{i}{self.tail}") for i in range(len(self.content.columns))]
        return [F.count_if(self.here).alias(f"rows{self.tail}"), *missing, *outs, *_text_aggs(self.tail, self.here)]

    def entries(self) -> list[tuple[str, str, str, Column]]:
        parts = [F.col(f"o{i}{self.tail}") for i in range(len(self.numbers))]
        return [
            ("table", "row_count", "", F.col(f"rows{self.tail}")),
            ("table", "column_count", "", F.lit(self.width)),
            *_missing_rows(self.content, self.tail),
            ("outliers", "iqr_total", "", sum(parts, F.lit(0))),
            *[("outliers", "iqr_count", name, part) for name, part in zip(self.numbers, parts)],
            *_text_entries(self.tail),
        ]


def _sided_rows(df: DataFrame, entries: dict[int, list[tuple[str, str, str, Column]]]) -> DataFrame:
    """:func:`rows_from` for several sides at once, with their number as ``side``."""
    cells = [
        F.struct(
            F.lit(side).alias("side"), F.lit(section).alias("section"), F.lit(metric).alias("metric"),
            F.lit(column).alias("column"), value.cast("double").alias("value"),
        )
        for side, rows in entries.items()
        for section, metric, column, value in rows
    ]
    return df.select(F.explode(F.array(*cells)).alias("m")).select("m.*")


def sided_reports(
    dfs: list[DataFrame],
    key: str | None = None,
    text: str | None = None,
    label: str | None = None,
    threshold: float = IMBALANCE_THRESHOLD,
    exact: bool = True,
) -> DataFrame:
    """:func:`quality_report` of several tables, with their place in the list as ``side``.

    Each table is read once; the facts of all of them are one table, so every pass over facts
    serves all sides.
    """
    sides = [_Side(i, df, key, text, label) for i, df in enumerate(dfs)]
    facts = sides[0].facts()
    for side in sides[1:]:
        facts = facts.unionByName(side.facts(), allowMissingColumns=True)
    facts = cut_lineage(facts)
    sizes = [f"__len{s.tail}" for s in sides]
    q = quantile_map(facts, [*(n for s in sides for n in s.measured), *sizes], [0.25, 0.5, 0.75], exact)
    aggs = [a for s in sides for a in s.aggs()]
    counted = with_scalar(facts, "__q", q).agg(*aggs, F.any_value("__q").alias("q"))
    report = _sided_rows(counted, {s.number: s.entries() for s in sides})
    report = report.unionByName(_duplicate_rows(facts, sides))
    targets = [s for s in sides if s.target]
    if targets:
        values = facts.where("__label IS NOT NULL").groupBy("side", F.col("__label").alias("value"))
        values = values.agg(F.count(F.lit(1)).alias("rows"))
        values = values.select("value", *[F.when(s.here, F.col("rows")).alias(f"rows{s.tail}") for s in targets])
        told = values.agg(*[a for s in targets for a in _semantics_aggs(f"rows{s.tail}", s.tail)])
        told = told.select(*[c for s in targets for c in _semantics(s.tail)])
        entries = {s.number: _imbalance_entries(s.target, threshold, s.tail) for s in targets}
        report = report.unionByName(_sided_rows(told, entries))
    return report


def text_reports(
    dfs: list[DataFrame], key: str, text: str = "text", label: str = "label", exact: bool = True
) -> DataFrame:
    """Text figures, label coverage and empty columns of several tables, as :func:`sided_reports`."""
    facts, tails = None, [f"_{i}" for i in range(len(dfs))]
    for i, (df, tail) in enumerate(zip(dfs, tails)):
        own = _text_facts(primary_text(df, text))
        own[f"__len{tail}"] = own.pop("__len")
        filled = [present(f).alias(f"c{k}{tail}") for k, f in enumerate(df.drop(key).schema)]
        exactly = text_key(F.nullif(F.col(text), F.lit(""))).alias("__exact")
        own_facts = df.select(F.lit(i).alias("side"), *_named(own), exactly, F.col(label).isNotNull().alias("__labelled"), *filled)
        facts = own_facts if facts is None else facts.unionByName(own_facts, allowMissingColumns=True)
    facts = cut_lineage(facts)
    q = quantile_map(facts, [f"__len{t}" for t in tails], [0.25, 0.5, 0.75], exact)
    aggs, entries = [], {}
    for i, (df, tail) in enumerate(zip(dfs, tails)):
        here = F.col("side") == i
        names = [f"c{k}{tail}" for k in range(len(df.columns) - 1)]
        aggs += _text_aggs(tail, here)
        aggs += [F.avg(F.when(here, F.col("__labelled").cast("double"))).alias(f"labelled{tail}")]
        aggs += [F.count_if(n).alias(n) for n in names]
        empty = sum(((F.col(n) == 0).cast("int") for n in names), F.lit(0))
        entries[i] = [*_text_entries(tail), ("label", "coverage", "", F.col(f"labelled{tail}")), ("table", "all_null_columns", "", empty)]
    report = _sided_rows(with_scalar(facts, "__q", q).agg(*aggs, F.any_value("__q").alias("q")), entries)
    # Equal texts have equal normalised texts, so one grouping serves both counts.
    exactly = facts.groupBy("side", "__text", "__exact").agg(F.count(F.lit(1)).alias("n"))
    again = F.when(F.col("__exact").isNotNull(), F.col("n") - 1)
    alike = exactly.groupBy("side", "__text").agg(F.sum("n").alias("n"), F.sum(again).alias("same"))
    near = F.when(F.col("__text").isNotNull(), F.col("n") - 1)
    counts, entries = [], {}
    for i, tail in enumerate(tails):
        here = F.col("side") == i
        counts.append(F.coalesce(F.sum(F.when(here, near)), F.lit(0)).alias(f"near{tail}"))
        counts.append(F.coalesce(F.sum(F.when(here, F.col("same"))), F.lit(0)).alias(f"same{tail}"))
        entries[i] = [
            ("text", "duplicate_text_rows", "", F.col(f"near{tail}")),
            ("text", "exact_duplicate_text_rows", "", F.col(f"same{tail}")),
        ]
    return report.unionByName(_sided_rows(alike.agg(*counts), entries))


def _duplicate_rows(facts: DataFrame, sides: list[_Side]) -> DataFrame:
    rows = facts.groupBy("side", "__row", "__text").agg(F.count(F.lit(1)).alias("n"))
    texts = rows.groupBy("side", "__text").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("extra_rows")
    )
    extra_texts = F.when(F.col("__text").isNotNull(), F.col("n") - 1)
    counts = []
    for s in sides:
        counts.append(F.coalesce(F.sum(F.when(s.here, F.col("extra_rows"))), F.lit(0)).alias(f"d{s.tail}"))
        counts.append(F.coalesce(F.sum(F.when(s.here, extra_texts)), F.lit(0)).alias(f"t{s.tail}"))
    entries = {
        s.number: [
            ("duplicates", "rows", "", F.col(f"d{s.tail}")),
            ("text", "duplicate_text_rows", "", F.col(f"t{s.tail}")),
        ]
        for s in sides
    }
    return _sided_rows(texts.agg(*counts), entries)


# What a headline counts: section, metric, whether zero is worth telling, and what the number means.
HEADLINES = (
    ("missing", "total", True, "cells have no value"),
    ("duplicates", "rows", True, "rows are copies of an earlier one"),
    ("outliers", "iqr_total", True, "numbers lie beyond the quartile fences"),
    ("imbalance", "majority_share", True, "of the labelled rows are in one class"),
    ("text", "empty_rows", False, "rows come without text"),
    ("text", "duplicate_text_rows", False, "rows bring a text seen before"),
)


def findings(report: DataFrame) -> DataFrame:
    """Headlines of a report in a fixed order: ``(position, metric, column, value, finding)``.

    Only the headline of the whole table counts where a metric has one per column too.
    """
    value = F.col("value")
    shown = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(
        F.format_string("%.3f", value)
    )
    line = F.lit(None).cast("struct<position:int,finding:string>")
    for position, (section, metric, zero, meaning) in enumerate(HEADLINES, 1):
        mine = (F.col("section") == section) & (F.col("metric") == metric) & value.isNotNull()
        if section == "missing":
            mine &= F.col("column") == ""
        if not zero:
            mine &= value > 0
        told = F.struct(F.lit(position).alias("position"), F.concat(shown, F.lit(f" {meaning}")).alias("finding"))
        line = F.when(mine, told).otherwise(line)
    told = report.select("metric", "column", "value", line.alias("f")).where("f IS NOT NULL")
    return told.select("f.position", "metric", "column", "value", "f.finding")
