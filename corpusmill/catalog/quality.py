"""Queries over detection, strategy, cleaning and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog.base import (
    DIRTY,
    DOCS,
    GAPPY,
    dirty,
    docs,
    gappy,
    norm,
    query,
    strip,
    table,
    text_table,
    words,
)
from corpusmill.operators import clean as cl
from corpusmill.operators import compare as cm
from corpusmill.operators import detect as dt
from corpusmill.operators.neardup import near_duplicates
from corpusmill.plans import strategy as st


def row(section: str, metric: str, column: str, value: str, source: str = "") -> str:
    """One metric row as SQL."""
    tail = f" FROM {source}" if source else ""
    return (
        f"SELECT '{section}' AS section, '{metric}' AS metric, '{column}' AS column, "
        f"round(CAST({value} AS DOUBLE), 6) AS value{tail}"
    )


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# -------------------------------------------------------------------------- SQL pieces


def missing_sql(name: str, columns: list[str], section: str = "missing") -> list[str]:
    total = " + ".join(f"(count(*) - count({c}))" for c in columns)
    parts = [row(section, "total", "", total, name)]
    return parts + [row(section, "by_column", c, f"count(*) - count({c})", name) for c in columns]


def fence_sql(c: str, name: str) -> str:
    """One row: the interquartile fences of a column."""
    return (
        f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {name})"
    )


def outside_sql(c: str, name: str) -> str:
    return f"(SELECT count(*) FROM {name}, {fence_sql(c, name)} f WHERE {c} < f.lo OR {c} > f.hi)"


def blank_sql(c: str) -> str:
    return f"({c} IS NULL OR {strip(c)} = '')"


_END = r"""'[.!?…。！？]["''»”’)\]]*$'"""


def text_sql(name: str, text: str = "text") -> list[str]:
    sized = (
        f"(SELECT {text} AS t, CASE WHEN NOT {blank_sql(text)} THEN length({text}) END AS size FROM {name})"
    )
    fenced = (
        f"{sized} z, (SELECT quantile_cont(size, 0.25) AS a, quantile_cont(size, 0.75) AS b FROM {sized}) q"
    )
    low, high = "size < a - 1.5 * (b - a)", "size > b + 1.5 * (b - a)"
    return [
        row("text", "empty_rows", "", "count(*) FILTER (size IS NULL)", sized),
        row("text", "near_empty_rows", "", f"count(*) FILTER (size IS NOT NULL AND {words('t')} < 3)", sized),
        row("text", "short_rows", "", f"count(*) FILTER ({low})", fenced),
        row("text", "long_rows", "", f"count(*) FILTER ({high})", fenced),
        row(
            "text",
            "truncated_rows",
            "",
            f"count(*) FILTER (size IS NOT NULL AND NOT regexp_matches({strip('t')}, {_END}))",
            sized,
        ),
        row("text", "chars_mean", "", "avg(size)", sized),
        row("text", "chars_max", "", "max(size)", sized),
        row("text", "chars_median", "", "quantile_cont(size, 0.5)", sized),
        row("text", "duplicate_text_rows", "", f"count({norm(text)}) - count(DISTINCT {norm(text)})", name),
    ]


def imbalance_sql(name: str, label: str, shown: str | None = None) -> list[str]:
    """For a label that names classes."""
    shown = shown or label
    counts = f"(SELECT {label}, count(*) AS n FROM {name} WHERE {label} IS NOT NULL GROUP BY {label})"
    return [
        row("imbalance", "applicable", shown, "1"),
        row("imbalance", "classes", shown, "count(*)", counts),
        row("imbalance", "majority_share", shown, "max(n) / sum(n)", counts),
        row("imbalance", "is_imbalanced", shown, "(max(n) / sum(n) >= 0.75)::INT", counts),
    ]


def report_sql(name: str, columns: list[str], numbers: list[str], n_columns: int) -> str:
    distinct = f"(SELECT DISTINCT {', '.join(columns)} FROM {name})"
    total = " + ".join(outside_sql(c, name) for c in numbers)
    parts = [
        row("table", "row_count", "", "count(*)", name),
        row("table", "column_count", "", str(n_columns)),
        *missing_sql(name, columns),
        row("outliers", "iqr_total", "", total),
        *[row("outliers", "iqr_count", c, outside_sql(c, name)) for c in numbers],
        *text_sql(name),
        row(
            "duplicates", "rows", "", f"(SELECT count(*) FROM {name}) - (SELECT count(*) FROM {distinct})"
        ),
        *imbalance_sql(name, "label"),
    ]
    return union(parts)


_CONTENT = ["text", "lang", "source", "n_chars", "audio", "label"]
_REPORT = report_sql("dirty", _CONTENT, ["n_chars"], 7)

# Cleaned like the query of the same name: blank texts out, one row per text.
_RICHEST = (
    "row_number() OVER (PARTITION BY coalesce(" + norm("text") + ", 'row:' || doc_id) ORDER BY label IS NULL, "
    "-((doc_id IS NOT NULL)::INT + (text IS NOT NULL)::INT + (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT "
    "+ (n_chars IS NOT NULL)::INT + (audio IS NOT NULL)::INT + (label IS NOT NULL)::INT), doc_id)"
)
CLEANED = (
    f"{DIRTY}, cleaned AS (SELECT * FROM dirty WHERE NOT {blank_sql('text')} QUALIFY {_RICHEST} = 1)"
)


def cleaned(df):
    return df.transform(cl.drop_empty_text).transform(cl.dedup_text_keep_richest, "doc_id")


def report(spark, folder):
    return dt.quality_report(dirty(spark, folder), "doc_id", "text", "label")


# ---------------------------------------------------------------------------- detection

_NULL_WORDS = "('', 'none', 'null', 'nan', 'n/a', 'na')"


@query("detect_missing", f"WITH {DIRTY} {union(missing_sql('dirty', ['doc_id', *_CONTENT]))}")
def _(spark, folder):
    return dt.detect_missing(dirty(spark, folder))


@query(
    "detect_missing_sentinels",
    f"WITH {DIRTY}, worded AS (SELECT doc_id, "
    + ", ".join(
        f"CASE WHEN lower({strip(c)}) NOT IN {_NULL_WORDS} THEN {c} END AS {c}"
        for c in ("text", "lang", "source", "audio")
    )
    + ", n_chars, label FROM dirty) "
    + union(missing_sql("worded", ["doc_id", *_CONTENT])),
)
def _(spark, folder):
    return dt.detect_missing(dirty(spark, folder), sentinels=True)


@query(
    "detect_duplicate_rows",
    "SELECT (SELECT count(*) FROM documents) AS rows, count(*) AS distinct_rows, "
    "(SELECT count(*) FROM documents) - count(*) AS duplicate_rows "
    "FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)",
)
def _(spark, folder):
    return dt.detect_duplicate_rows(text_table(spark, folder, "documents"), {"doc_id"})


@query(
    "detect_duplicate_nested",
    "SELECT (SELECT count(*) FROM embeddings) AS rows, count(*) AS distinct_rows, "
    "(SELECT count(*) FROM embeddings) - count(*) AS duplicate_rows FROM (SELECT DISTINCT embedding, label FROM embeddings)",
)
def _(spark, folder):
    return dt.detect_duplicate_rows(table(spark, folder, "embeddings"), {"vec_id"})


@query(
    "detect_duplicate_text",
    f"SELECT count({norm('text')}) AS rows, count(DISTINCT {norm('text')}) AS distinct_texts, "
    f"count({norm('text')}) - count(DISTINCT {norm('text')}) AS duplicate_text_rows FROM documents",
)
def _(spark, folder):
    return dt.detect_duplicate_text(text_table(spark, folder, "documents"))


@query(
    "near_dup_stems",
    f"WITH n AS (SELECT {norm('text')} AS t FROM documents) "
    "SELECT array_to_string(string_split(t, ' ')[1:8], ' ') AS stem, count(*) AS rows, count(DISTINCT t) AS variants "
    "FROM n WHERE t IS NOT NULL GROUP BY 1 HAVING count(DISTINCT t) > 1",
)
def _(spark, folder):
    return dt.near_dup_stems(text_table(spark, folder, "documents"))


@query("near_dup_minhash")
def _(spark, folder):
    return near_duplicates(text_table(spark, folder, "documents"), "doc_id")


@query(
    "cross_source_duplicates",
    f"WITH n AS (SELECT doc_id, source, {norm('text')} AS t FROM documents) "
    "SELECT min(doc_id) AS first_key, count(DISTINCT source) AS sources, count(*) AS rows FROM n "
    "WHERE t IS NOT NULL GROUP BY t HAVING count(DISTINCT source) > 1",
)
def _(spark, folder):
    return dt.cross_source_duplicates(text_table(spark, folder, "documents"), "doc_id")


def _bounds_sql(method: str, name: str, columns: list[str], fence) -> str:
    inside = {c: f"(SELECT count(*) FROM {name}, {fence(c, name)} f WHERE {c} < f.lo OR {c} > f.hi)" for c in columns}
    parts = [row("outliers", f"{method}_total", "", " + ".join(inside.values()))]
    for c in columns:
        parts += [
            row("outliers", f"{method}_count", c, inside[c]),
            row("outliers", f"{method}_lower", c, "lo", fence(c, name)),
            row("outliers", f"{method}_upper", c, "hi", fence(c, name)),
        ]
    return union(parts)


def _zscore_sql(c: str, name: str) -> str:
    return f"(SELECT avg({c}) - 3 * stddev_pop({c}) AS lo, avg({c}) + 3 * stddev_pop({c}) AS hi FROM {name})"


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("outliers_iqr", _bounds_sql("iqr", "lineitem", _MEASURES, fence_sql))
def _(spark, folder):
    return dt.outliers_iqr(table(spark, folder, "lineitem"), _MEASURES)


@query("outliers_iqr_events", _bounds_sql("iqr", "events", ["value"], fence_sql))
def _(spark, folder):
    return dt.outliers_iqr(table(spark, folder, "events"), exclude={"event_id", "user_id"})


@query("outliers_zscore", _bounds_sql("zscore", "events", ["value"], _zscore_sql))
def _(spark, folder):
    return dt.outliers_zscore(table(spark, folder, "events"), ["value"])


@query("detect_imbalance", union(imbalance_sql("labels", "quality")))
def _(spark, folder):
    return dt.detect_imbalance(table(spark, folder, "labels"), "quality")


@query("detect_imbalance_events", union(imbalance_sql("events", "event_type")))
def _(spark, folder):
    return dt.detect_imbalance(table(spark, folder, "events"), "event_type")


@query(
    "detect_imbalance_regression",
    union(
        [
            row("imbalance", "applicable", "l_extendedprice", "0"),
            row("imbalance", "classes", "l_extendedprice", "NULL"),
            row("imbalance", "majority_share", "l_extendedprice", "NULL"),
            row("imbalance", "is_imbalanced", "l_extendedprice", "NULL"),
        ]
    ),
)
def _(spark, folder):
    return dt.detect_imbalance(table(spark, folder, "lineitem"), "l_extendedprice")


@query("text_profile", f"WITH {DIRTY} {union(text_sql('dirty'))}")
def _(spark, folder):
    return dt.text_profile(dirty(spark, folder))


@query(
    "all_null_columns",
    f"WITH {DIRTY} SELECT 0::BIGINT AS position, 'audio' AS column FROM dirty HAVING count(audio) = 0",
)
def _(spark, folder):
    return dt.all_null_columns(dirty(spark, folder))


_NULLS = " + ".join(f"({c} IS NULL)::INT" for c in _CONTENT)
BUCKET = (
    f"CASE WHEN {blank_sql('text')} THEN 'no_content' WHEN ({_NULLS}) / 6.0 > 0.5 THEN 'sparse' "
    "WHEN label IS NULL THEN 'informative_unlabeled' ELSE 'complete' END"
)


@query(
    "sparsity_profile",
    f"WITH {DIRTY} SELECT {BUCKET} AS bucket, count(*) AS rows FROM dirty GROUP BY 1",
)
def _(spark, folder):
    return dt.sparsity_profile(dirty(spark, folder), exclude={"doc_id"})


def _semantics_sql(c: str, name: str) -> str:
    counts = f"(SELECT {c}, count(*) AS k FROM {name} WHERE {c} IS NOT NULL GROUP BY {c})"
    return (
        f"SELECT sum(k)::BIGINT AS n, count(*) AS distinct_labels, "
        f"round(sum(k) FILTER (try_cast({c} AS DOUBLE) IS NOT NULL) / sum(k), 6) AS numeric_ratio, "
        f"max(k) AS majority, CASE WHEN sum(k) FILTER (try_cast({c} AS DOUBLE) IS NOT NULL) / sum(k) >= 0.8 AND "
        f"count(*) > least(20, greatest(5, floor(sum(k) / 2))) THEN 'regression' ELSE 'classification' END AS kind "
        f"FROM {counts}"
    )


@query("label_semantics", _semantics_sql("quality", "labels"))
def _(spark, folder):
    return dt.label_semantics(table(spark, folder, "labels"), "quality")


@query("label_semantics_price", _semantics_sql("l_extendedprice", "lineitem"))
def _(spark, folder):
    return dt.label_semantics(table(spark, folder, "lineitem"), "l_extendedprice")


@query("quality_report", f"WITH {DIRTY} {_REPORT}")
def _(spark, folder):
    return report(spark, folder)


@query(
    "findings",
    f"""
    WITH {DIRTY}, r AS ({_REPORT})
    SELECT position, metric, "column", value,
      CASE WHEN value = floor(value) THEN (value::BIGINT)::VARCHAR ELSE printf('%.3f', value) END || ' ' || meaning AS finding
    FROM r JOIN (VALUES
      (1::BIGINT, 'missing', 'total', 'cells have no value'),
      (2, 'duplicates', 'rows', 'rows are copies of an earlier one'),
      (3, 'outliers', 'iqr_total', 'numbers lie beyond the quartile fences'),
      (4, 'imbalance', 'majority_share', 'of the labelled rows are in one class'),
      (5, 'text', 'empty_rows', 'rows come without text'),
      (6, 'text', 'duplicate_text_rows', 'rows bring a text seen before')
    ) h(position, section, metric, meaning) USING (section, metric)
    WHERE value IS NOT NULL AND (value > 0 OR section <> 'text')
      AND (section <> 'missing' OR "column" = '')
    """,
)
def _(spark, folder):
    return dt.findings(report(spark, folder))


# ----------------------------------------------------------------------------- strategy


def _pick(section: str, metric: str) -> str:
    return f"(SELECT max(value) FROM r WHERE section = '{section}' AND metric = '{metric}')"


def _option_sql(option: str, position: int, block: str, action: str, reason: str, shown: str) -> str:
    return (
        f"SELECT '{option}' AS option, {option == 'retain'} AS recommended, {position}::BIGINT AS position, "
        f"'{block}' AS block, '{action}' AS action, '{reason}' AS reason WHERE {shown}"
    )


_SHARED = [
    ("row_actions", "drop_exact_duplicates", "equal rows distort training", _pick("duplicates", "rows") + " > 0"),
    (
        "text_actions",
        "drop_normalized_text_duplicates_keep_richest_metadata",
        "repeated texts keep their best documented row",
        _pick("text", "duplicate_text_rows") + " > 0",
    ),
    ("row_actions", "keep_only_rows_with_text", "rows without text carry nothing", _pick("text", "empty_rows") + " > 0"),
    ("column_actions", "drop_all_null_optional_columns", "empty columns carry nothing", _pick("missing", "total") + " > 0"),
]
_OPTIONS = {
    "retain": [
        *_SHARED,
        ("label_actions", "flag_rows_missing_label", "unlabelled rows stay usable", _pick("missing", "total") + " > 0"),
    ],
    "supervised_only": [
        *_SHARED,
        ("row_actions", "drop_rows_missing_label", "only labelled rows are trained on", "TRUE"),
    ],
}


@query(
    "recommend_strategy",
    f"WITH {DIRTY}, r AS ({_REPORT}) "
    + union([_option_sql(o, i, *a) for o, actions in _OPTIONS.items() for i, a in enumerate(actions, 1)]),
)
def _(spark, folder):
    return st.recommend_strategy(report(spark, folder))


@query(
    "apply_actions",
    f"WITH {CLEANED} SELECT doc_id, text, lang, source, n_chars, label, label IS NULL AS label_missing FROM cleaned",
)
def _(spark, folder):
    actions = {
        "row_actions": ["keep_only_rows_with_text"],
        "text_actions": ["drop_normalized_text_duplicates_keep_richest_metadata"],
        "column_actions": ["drop_all_null_optional_columns"],
        "label_actions": ["flag_rows_missing_label", "keep_original_labels_only"],
    }
    return st.apply_actions(dirty(spark, folder), actions, "doc_id")


# ----------------------------------------------------------------------------- cleaning


def _filled_sql(how: str) -> str:
    cells = ", ".join(
        f"round(coalesce({c}, (SELECT {how.format(c)} FROM gappy)), 6) AS {c}" for c in ("l_discount", "l_tax")
    )
    return f"WITH {GAPPY} SELECT l_orderkey, l_linenumber, {cells} FROM gappy"


@query("impute_median", _filled_sql("quantile_cont({}, 0.5)"))
def _(spark, folder):
    filled = cl.impute_median(gappy(spark, folder), ["l_discount", "l_tax"])
    return filled.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("impute_mean", _filled_sql("avg({})"))
def _(spark, folder):
    filled = cl.impute_mean(gappy(spark, folder), ["l_discount", "l_tax"])
    return filled.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query(
    "impute_mode",
    "WITH e AS (SELECT event_id, NULLIF(event_type, 'click') AS event_type FROM events) "
    "SELECT event_id, coalesce(event_type, (SELECT event_type FROM e WHERE event_type IS NOT NULL "
    "GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM e",
)
def _(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", F.nullif("event_type", F.lit("click")).alias("event_type")
    )
    return cl.impute_mode(events, ["event_type"])


@query(
    "drop_missing",
    f"WITH {DIRTY} SELECT doc_id, source, label FROM dirty WHERE text IS NOT NULL AND lang IS NOT NULL",
)
def _(spark, folder):
    return cl.drop_missing(dirty(spark, folder), ["text", "lang"]).select("doc_id", "source", "label")


@query(
    "drop_duplicate_rows",
    "SELECT doc_id, text, lang, source, n_chars FROM documents "
    "QUALIFY row_number() OVER (PARTITION BY text, lang, source, n_chars ORDER BY doc_id) = 1",
)
def _(spark, folder):
    return cl.drop_duplicate_rows(text_table(spark, folder, "documents"), "doc_id")


@query(
    "clip_iqr",
    "SELECT event_id, round(least(greatest(value, f.lo), f.hi), 6) AS value "
    f"FROM events, {fence_sql('value', 'events')} f",
)
def _(spark, folder):
    return cl.clip_iqr(table(spark, folder, "events").select("event_id", "value"), ["value"])


@query(
    "drop_iqr",
    f"SELECT event_id, value FROM events, {fence_sql('value', 'events')} f WHERE value BETWEEN f.lo AND f.hi",
)
def _(spark, folder):
    return cl.drop_iqr(table(spark, folder, "events").select("event_id", "value"), ["value"])


@query("trim_text", f"WITH {DIRTY} SELECT doc_id, {strip('text')} AS text FROM dirty")
def _(spark, folder):
    return cl.trim_text(dirty(spark, folder)).select("doc_id", "text")


@query("drop_empty_text", f"WITH {DIRTY} SELECT doc_id, source, label FROM dirty WHERE NOT {blank_sql('text')}")
def _(spark, folder):
    return cl.drop_empty_text(dirty(spark, folder)).select("doc_id", "source", "label")


@query(
    "dedup_text_keep_richest",
    f"WITH {DIRTY} SELECT doc_id, text, source, label FROM dirty QUALIFY {_RICHEST} = 1",
)
def _(spark, folder):
    return cl.dedup_text_keep_richest(dirty(spark, folder), "doc_id").select("doc_id", "text", "source", "label")


@query("drop_all_null_columns", f"WITH {DIRTY} SELECT doc_id, text, lang, source, n_chars, label FROM dirty")
def _(spark, folder):
    return cl.drop_all_null_columns(dirty(spark, folder))


@query("flag_unlabeled", f"WITH {DOCS} SELECT doc_id, label, label IS NULL AS label_missing FROM docs")
def _(spark, folder):
    return cl.flag_unlabeled(docs(spark, folder).select("doc_id", "label"))


@query(
    "drop_sparse_rows",
    f"WITH {DIRTY} SELECT doc_id, source, label FROM dirty WHERE {BUCKET} NOT IN ('no_content', 'sparse')",
)
def _(spark, folder):
    kept = cl.drop_sparse_rows(dirty(spark, folder), exclude={"doc_id"})
    return kept.select("doc_id", "source", "label")


@query("supervised_subset", f"WITH {DOCS} SELECT doc_id, text, label FROM docs WHERE label IS NOT NULL")
def _(spark, folder):
    return cl.supervised_subset(docs(spark, folder))[1].select("doc_id", "text", "label")


@query("drop_rows_missing_label", f"WITH {DOCS} SELECT doc_id, source, label FROM docs WHERE label IS NOT NULL")
def _(spark, folder):
    return cl.drop_rows_missing_label(docs(spark, folder)).select("doc_id", "source", "label")


@query(
    "flag_label_format",
    f"WITH {DOCS}, y AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN lang ELSE label::VARCHAR END AS label FROM docs), "
    "z AS (SELECT avg((try_cast(label AS DOUBLE) IS NOT NULL)::INT) AS r FROM y WHERE label IS NOT NULL) "
    "SELECT doc_id, label, label IS NOT NULL AND ((try_cast(label AS DOUBLE) IS NOT NULL) <> (r >= 0.5)) "
    "AS label_format_mismatch FROM y, z",
)
def _(spark, folder):
    label = F.when(F.col("n_chars") > 2000, F.col("lang")).otherwise(F.col("label").cast("string"))
    return cl.flag_label_format(docs(spark, folder).select("doc_id", label.alias("label")))


# Whole fix: equal rows out, one row per text, numeric gaps filled, numbers clipped.
_FIXED = (
    f"{DIRTY}, step1 AS (SELECT * FROM dirty QUALIFY row_number() OVER (PARTITION BY text, lang, source, n_chars, "
    f"audio, label ORDER BY doc_id) = 1), step2 AS (SELECT * FROM step1 WHERE NOT {blank_sql('text')}), "
    f"fixed AS (SELECT doc_id, text, lang, source, round(least(greatest(n_chars, f.lo), f.hi), 6) AS n_chars, audio, label "
    f"FROM step2, {fence_sql('n_chars', 'step2')} f)"
)
_STRATEGY = {"missing": "median", "row_actions": ["keep_only_rows_with_text"]}


def _fixed(df):
    return cl.fix(df, "doc_id", _STRATEGY)


@query("fix", f"WITH {_FIXED} SELECT doc_id, text, lang, source, n_chars, audio, label FROM fixed")
def _(spark, folder):
    return _fixed(dirty(spark, folder))


@query(
    "fix_summary",
    f"WITH {_FIXED} "
    + union(
        [
            row("summary", "input_rows", "", "count(*)", "dirty"),
            row("summary", "output_rows", "", "count(*)", "fixed"),
            row("summary", "rows_removed", "", "(SELECT count(*) FROM dirty) - (SELECT count(*) FROM fixed)"),
            row(
                "summary",
                "missing_after",
                "",
                " + ".join(f"(count(*) - count({c}))" for c in _CONTENT),
                "fixed",
            ),
            row(
                "summary",
                "duplicates_after",
                "",
                "(SELECT count(*) FROM fixed) - (SELECT count(*) FROM (SELECT DISTINCT "
                + ", ".join(_CONTENT)
                + " FROM fixed))",
            ),
            row("summary", "outliers_after", "", outside_sql("n_chars", "fixed")),
        ]
    ),
)
def _(spark, folder):
    before = dirty(spark, folder)
    return cl.fix_summary(before, _fixed(before), "doc_id")


# --------------------------------------------------------------------------- comparison

_AFTER = report_sql("cleaned", _CONTENT, ["n_chars"], 7)


def fine(sql: str) -> str:
    """The same metric rows with more places, for taking differences before rounding."""
    return sql.replace(", 6) AS value", ", 12) AS value")


def differences(before: str, after: str) -> str:
    """CTEs ending in ``c``: both sides and their difference, not yet rounded."""
    return (
        f"b AS ({fine(before)}), a AS ({fine(after)}), c AS (SELECT section, metric, \"column\", b.value AS before, "
        "a.value AS after, b.value - a.value AS delta FROM b FULL JOIN a USING (section, metric, \"column\"))"
    )


_SIDES = (
    "SELECT section, metric, \"column\", round(before, 6) AS before, round(after, 6) AS after, round(delta, 6) AS delta FROM c"
)
_COMPARED = f"{CLEANED}, {differences(_REPORT, _AFTER)}"


def _both(spark, folder):
    before = dirty(spark, folder)
    return cm.compare(before, cleaned(before), "doc_id", "text", "label")


@query("compare", f"WITH {_COMPARED} {_SIDES}")
def _(spark, folder):
    return _both(spark, folder)


@query(
    "delta_direction",
    f"WITH {_COMPARED} SELECT section, metric, \"column\", CASE WHEN delta IS NULL THEN 'not available' "
    "WHEN delta > 0 THEN 'improved' WHEN delta < 0 THEN 'increased' ELSE 'unchanged' END AS direction, "
    "round(abs(delta), 6) AS amount FROM c",
)
def _(spark, folder):
    changes = cm.delta_direction(_both(spark, folder))
    return changes.select("section", "metric", "column", "direction", "amount")


def _text_after_sql(name: str) -> str:
    return union(
        [
            *text_sql(name),
            row(
                "text",
                "exact_duplicate_text_rows",
                "",
                "count(NULLIF(text, '')) - count(DISTINCT NULLIF(text, ''))",
                name,
            ),
            row("label", "coverage", "", "count(label) / count(*)", name),
            row("table", "all_null_columns", "", "(count(audio) = 0)::INT", name),
        ]
    )


@query(
    "compare_text",
    f"WITH {CLEANED}, {differences(_text_after_sql('dirty'), _text_after_sql('cleaned'))} {_SIDES}",
)
def _(spark, folder):
    before = dirty(spark, folder)
    return cm.compare_text(before, cleaned(before), "doc_id")


@query(
    "compare_retention",
    f"WITH {CLEANED}, k AS (SELECT doc_id, {BUCKET} AS bucket FROM dirty) "
    "SELECT bucket, count(*) AS rows, count(c.doc_id) AS kept, count(*) - count(c.doc_id) AS dropped "
    "FROM k LEFT JOIN cleaned c USING (doc_id) GROUP BY bucket",
)
def _(spark, folder):
    before = dirty(spark, folder)
    return cm.compare_retention(before, cleaned(before), "doc_id")


@query(
    "stage_metrics",
    f"WITH {CLEANED}, a AS ({_AFTER}) SELECT "
    + ", ".join(
        f"(SELECT value FROM a WHERE section = '{s}' AND metric = '{m}' AND \"column\" = '') AS {n}"
        for n, s, m in (
            ("row_count", "table", "row_count"),
            ("missing_total_after", "missing", "total"),
            ("duplicates_after", "duplicates", "rows"),
            ("outliers_after", "outliers", "iqr_total"),
        )
    ),
)
def _(spark, folder):
    return cm.stage_metrics(_both(spark, folder))
