"""Queries over cells that are easily taken for something else: microseconds, NaN, mistyped JSON."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusmill.catalog.base import DOCS, docs, query, table
from corpusmill.catalog.collect import _box_sql
from corpusmill.catalog.quality import _bounds_sql, _zscore_sql, fence_sql
from corpusmill.functions import text as fx
from corpusmill.operators import annotate as an
from corpusmill.operators import clean as cl
from corpusmill.operators import detect as dt
from corpusmill.operators import profile as pf
from corpusmill.sources import tables as tb
from corpusmill.sources import unify as un

_INSTANT = 1_700_000_000_000_000  # microseconds


@query(
    "drop_duplicate_rows_events",
    "SELECT event_id, event_type, user_id FROM events "
    "QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1",
)
def _(spark, folder):
    """Rows that differ by microseconds only are not copies."""
    rows = table(spark, folder, "events").select(
        "event_id", "event_type", F.timestamp_micros(F.lit(_INSTANT) + F.col("user_id")).alias("seen")
    )
    micros = F.unix_micros("seen") - _INSTANT
    return cl.drop_duplicate_rows(rows, "event_id").select("event_id", "event_type", micros.alias("user_id"))


def _with_nan(spark, folder):
    """Events whose value is not a number for every second user."""
    value = F.when(F.col("user_id") % 2 == 0, float("nan")).otherwise(F.col("value"))
    return table(spark, folder, "events").select("event_id", value.alias("value"))


_NUMBERS = "(SELECT value FROM events WHERE user_id % 2 <> 0)"


@query("outliers_iqr_nan", _bounds_sql("iqr", _NUMBERS, ["value"], fence_sql))
def _(spark, folder):
    return dt.outliers_iqr(_with_nan(spark, folder), ["value"])


@query("outliers_zscore_nan", _bounds_sql("zscore", _NUMBERS, ["value"], _zscore_sql))
def _(spark, folder):
    return dt.outliers_zscore(_with_nan(spark, folder), ["value"])


@query("boxplot_stats_nan", _box_sql("value").replace("lineitem", _NUMBERS))
def _(spark, folder):
    return pf.boxplot_stats(_with_nan(spark, folder).select("value"))


@query(
    "restore_nested_mismatch",
    "SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, "
    "CASE WHEN user_id % 3 = 0 THEN '{\"k\":\"' || event_type || '\"}' END AS props_text FROM events",
)
def _(spark, folder):
    """A member of another type is no number, and its text is kept."""
    worded = F.concat(F.lit('{"k":"'), F.col("event_type"), F.lit('"}'))
    cells = table(spark, folder, "events").select(
        "event_id", F.when(F.col("user_id") % 3 == 0, worded).otherwise(F.col("props")).alias("props")
    )
    shape = spark.createDataFrame([], "event_id bigint, props map<string,bigint>").schema
    restored = un.restore_nested(cells, shape)
    return restored.select("event_id", F.try_element_at("props", F.lit("k")).alias("k"), "props_text")


def _mistyped(row: dict) -> dict:
    """A word for a number, a new number, and a member that nobody declared."""
    return {"n_chars": "many" if row["lang"] == "fr" else row["n_chars"] + 1, "mood": row["source"]}


@query(
    "transform_rows_mistyped",
    "SELECT doc_id, lang, source, CASE WHEN lang = 'fr' THEN n_chars ELSE n_chars + 1 END AS n_chars, "
    "source AS mood FROM documents",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    changed = an.transform_rows(rows, _mistyped, "", extra="other")
    return changed.select(
        "doc_id", "lang", "source", "n_chars", F.get_json_object("other", "$.mood").alias("mood")
    )


@query(
    "looks_numeric_marks",
    "SELECT doc_id, regexp_matches(n_chars || '_000', '^[0-9]+(_[0-9]+)*$') AS marked, "
    "regexp_matches(n_chars || '__000', '^[0-9]+(_[0-9]+)*$') AS doubled FROM documents",
)
def _(spark, folder):
    size = F.col("n_chars").cast("string")
    return table(spark, folder, "documents").select(
        "doc_id",
        fx.looks_numeric(F.concat(size, F.lit("_000"))).alias("marked"),
        fx.looks_numeric(F.concat(size, F.lit("__000"))).alias("doubled"),
    )


def _by_language(payloads):
    return [f'{{"answer": "{json.loads(p)["lang"]}"}}' for p in payloads]


def _by_length(payloads):
    """Agrees on texts of even length."""
    rows = map(json.loads, payloads)
    return [{"answer": r["lang"] if r["n_chars"] % 2 == 0 else "unsure"} for r in rows]


@query(
    "auto_label",
    f"WITH {DOCS} SELECT doc_id, label, '{{\"answer\": \"' || lang || '\"}}' AS annotation_raw_response_1, "
    "CASE WHEN n_chars % 2 = 0 THEN lang END AS annotation_label, n_chars % 2 <> 0 AS annotation_needs_review, "
    "CAST(n_chars % 2 = 0 AS INT)::DOUBLE AS annotation_confidence FROM docs",
)
def _(spark, folder):
    """Two passes over the whole table; the given quality label stays."""
    done = an.auto_label(docs(spark, folder), "doc_id", _by_language, _by_length, columns=["lang", "n_chars"])
    return done.select(
        "doc_id", "label", "annotation_raw_response_1", "annotation_label",
        "annotation_needs_review", "annotation_confidence",
    )


@query("read_table", "SELECT * FROM customer")
def _(spark, folder):
    return tb.read_table(spark, f"{folder}/customer.parquet")


@query(
    "file_table_source",
    "SELECT text, CAST(NULL AS VARCHAR) AS audio, CAST(NULL AS VARCHAR) AS image, role AS label, "
    "'conversations' AS source, '2024-01-01T00:00:00Z' AS collected_at, "
    "'{\"conv_id\":' || conv_id || ',\"turn\":' || turn || '}' AS metadata FROM conversations",
)
def _(spark, folder):
    source = {"name": "conversations", "column_map": {"label": "role"}}
    return tb.file_table_source(spark, f"{folder}/conversations.parquet", source, "2024-01-01T00:00:00Z")
