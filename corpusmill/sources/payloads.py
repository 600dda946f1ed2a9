"""Records held in JSON payloads: API responses and model outputs."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import (
    blank_to_null,
    clip_text,
    fenced_block,
    json_array,
    json_object,
    let,
    strip_ws,
)


def json_path(records_path: str | None) -> str:
    """Dotted path (``a.b.0.c``) as a JSON path; a number indexes a list."""
    steps = [] if records_path is None else records_path.split(".")
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)


def extract_records(
    df: DataFrame,
    payload: str,
    records_path: str | None,
    element: T.StructType | str,
    strict: bool = True,
) -> DataFrame:
    """One row per record of the list found at ``records_path`` in each payload.

    A path that does not lead to a list is an error; with ``strict=False`` such
    a payload yields no rows.
    """
    ddl = element if isinstance(element, str) else element.simpleString()
    found = F.get_json_object(F.col(payload), json_path(records_path))
    listed = json_array(found)
    if strict:
        problem = F.raise_error(F.lit(f"No list of records at {records_path!r}"))
        listed = F.when(listed.isNull(), problem.cast("string")).otherwise(listed)
    kept = [c for c in df.columns if c != payload]
    return df.select(
        *kept, F.posexplode(F.from_json(listed, f"array<{ddl}>")).alias("position", "record")
    )


@F.pandas_udf(T.StringType())
def _literal_to_json(texts: pd.Series) -> pd.Series:
    """Python literals as JSON; anything else is null."""

    def convert(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(ast.literal_eval(text), ensure_ascii=False, default=str)
        except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
            return None

    return texts.map(convert, na_action="ignore").astype(object)


def _document(c: Column) -> Column:
    return F.coalesce(json_object(c), json_array(c))


def with_payload_document(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Adds the JSON in a raw output: the text, its fenced block, or either as a Python literal.

    Only outputs that are not JSON reach Python.
    """
    found = let(
        strip_ws(F.col(raw)), lambda t: F.coalesce(_document(t), _document(fenced_block(t)))
    )
    left = F.when(F.col(name).isNull(), strip_ws(F.col(raw)))
    literal = F.coalesce(_literal_to_json(left), _literal_to_json(fenced_block(left)))
    return df.withColumn(name, found).withColumn(name, F.coalesce(name, _document(literal)))


def _as_list(document: Column) -> Column:
    """A JSON list, or a single value as a list of one."""
    return F.coalesce(json_array(document), F.concat(F.lit("["), document, F.lit("]")))


def _record_text(item: Column) -> Column:
    """A record as a JSON object; a bare value becomes its ``text``."""
    bare = F.to_json(F.struct(item.cast("string").alias("text")))
    return F.when(F.schema_of_variant(item).startswith("OBJECT"), F.to_json(item)).otherwise(bare)


def parse_payload_records(df: DataFrame, raw: str) -> DataFrame:
    """Records of each raw output: ``position, record (JSON text), notes, error``.

    The output is an object with ``records`` (a list or one record) and
    ``notes``, or a bare list. An output that is neither yields one row with an
    error and no record.
    """
    kept = [c for c in df.columns if c != raw]
    document = F.col("__document")
    is_object = document.startswith("{")
    member = F.get_json_object(document, "$.records")
    records = F.when(is_object, F.coalesce(_records_list(member), F.lit("[]"))).otherwise(document)
    notes = F.get_json_object(document, "$.notes")
    note_list = F.coalesce(
        F.from_json(json_array(notes), "array<string>"),
        F.when(notes.isNotNull(), F.array(notes)),
        F.array().cast("array<string>"),
    )
    parsed = with_payload_document(df, raw, "__document").select(
        *kept,
        F.transform(
            F.from_json(F.when(document.isNotNull(), records), "array<variant>"), _record_text
        ).alias("__records"),
        F.when(is_object, note_list).otherwise(F.array().cast("array<string>")).alias("notes"),
        F.when(document.isNull(), F.lit("not a JSON object or list")).alias("error"),
    )
    return (
        parsed.select(*kept, "notes", "error", F.posexplode_outer("__records").alias("position", "record"))
        .where("record IS NOT NULL OR error IS NOT NULL")
        .select(*kept, "position", "record", "notes", "error")
    )


def _records_list(member: Column) -> Column:
    return F.coalesce(json_array(member), F.when(json_object(member).isNotNull(), _as_list(member)))


# Members of a search response that the result keeps.
_SEARCH_ITEM = (
    "struct<repository:struct<full_name:string>,path:string,html_url:string,"
    "score:double,text_matches:array<struct<fragment:string>>>"
)


def flatten_matches(df: DataFrame, payload: str, limit: int | None = None) -> DataFrame:
    """Search responses as one row per item with its clipped match fragments.

    ``limit`` keeps the first items of each response, as asked of the search.
    """
    items = F.from_json(F.get_json_object(F.col(payload), "$.items"), f"array<{_SEARCH_ITEM}>")
    if limit is not None:
        items = F.slice(items, 1, limit)
    matches = F.filter(
        F.coalesce(F.col("item.text_matches"), F.array()),
        lambda m: blank_to_null(m["fragment"]).isNotNull(),
    )
    fragments = F.transform(matches, lambda m: F.coalesce(clip_text(m["fragment"], 400), F.lit("")))
    kept = [c for c in df.columns if c != payload]
    return df.select(*kept, F.posexplode(items).alias("position", "item")).select(
        *kept,
        "position",
        F.coalesce("item.repository.full_name", F.lit("")).alias("repository"),
        F.coalesce("item.path", F.lit("")).alias("path"),
        F.coalesce("item.html_url", F.lit("")).alias("url"),
        F.coalesce("item.score", F.lit(0.0)).alias("score"),
        fragments.alias("fragments"),
    )
