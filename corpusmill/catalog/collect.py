"""Queries over sources, unification, web pages, scalar functions and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.catalog.base import (
    DIRTY,
    DOCS,
    clip,
    dirty,
    docs,
    norm,
    query,
    strip,
    table,
    text_table,
    top,
    words,
)
from corpusmill.functions import text as fx
from corpusmill.operators import profile as pf
from corpusmill.schema import UNIFIED_COLUMNS
from corpusmill.settings import checkpoint_folder, cut_lineage, remove_folder
from corpusmill.sources import pages as pg
from corpusmill.sources import payloads as pl
from corpusmill.sources import tables as tb
from corpusmill.sources import unify as un

COLLECTED = "2024-01-01T00:00:00+00:00"

# ------------------------------------------------------------------------------ sources


@query("limit_source", "SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 55")
def _(spark, folder):
    return tb.limit_source(table(spark, folder, "documents"), "doc_id", 55)


@query(
    "extract_records",
    "SELECT event_id, 0::BIGINT AS position, event_id AS id, event_type AS kind FROM events "
    "UNION ALL SELECT event_id, 1::BIGINT, user_id, 'user' FROM events",
)
def _(spark, folder):
    event = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    user = F.struct(F.col("user_id").alias("id"), F.lit("user").alias("kind"))
    items = F.array(F.struct(F.array(event, user).alias("items")))
    payloads = table(spark, folder, "events").select(
        "event_id", F.to_json(F.struct(items.alias("data"))).alias("payload")
    )
    found = pl.extract_records(payloads, "payload", "data.0.items", "struct<id:bigint,kind:string>")
    return found.select("event_id", "position", "record.id", "record.kind")


@query(
    "parse_payload_records",
    "SELECT conv_id, turn, 0::BIGINT AS position, text, CASE WHEN role = 'user' THEN 'read' END AS note "
    "FROM conversations",
)
def _(spark, folder):
    turns = text_table(spark, folder, "conversations")
    records = F.array(F.struct("role", "text"))
    whole = F.to_json(F.struct(records.alias("records"), F.lit("read").alias("notes")))
    fenced = F.concat(F.lit("Found:\n```json\n"), F.to_json(F.array("text")), F.lit("\n```"))
    raw = F.when(F.col("role") == "user", whole).otherwise(fenced)
    parsed = pl.parse_payload_records(turns.select("conv_id", "turn", raw.alias("raw")), "raw")
    text = F.get_json_object("record", "$.text")
    return parsed.select(
        "conv_id", "turn", "position", text.alias("text"), F.try_element_at("notes", F.lit(1)).alias("note")
    )


@query(
    "parse_payload_literals",
    r"SELECT conv_id, turn, 0::BIGINT AS position, regexp_replace(text, '[''\\\n\r]', ' ', 'g') AS text "
    "FROM conversations",
)
def _(spark, folder):
    plain = F.regexp_replace("text", r"['\\\n\r]", " ")
    raw = F.concat(F.lit("{'records': [{'text': '"), plain, F.lit("', 'seen': None}], 'notes': []}"))
    turns = text_table(spark, folder, "conversations").select("conv_id", "turn", raw.alias("raw"))
    parsed = pl.parse_payload_records(turns, "raw")
    return parsed.select("conv_id", "turn", "position", F.get_json_object("record", "$.text").alias("text"))


@query(
    "source_ledger",
    "SELECT 0::BIGINT AS position, 'documents' AS source, (SELECT count(*) FROM documents) AS row_count, "
    "TRUE AS success, CAST(NULL AS VARCHAR) AS reason "
    "UNION ALL SELECT 1, 'benchmark', (SELECT count(*) FROM benchmark), TRUE, NULL "
    "UNION ALL SELECT 2, 'absent', 0, FALSE, 'AnalysisException' "
    "UNION ALL SELECT 3, 'conversations', (SELECT count(*) FROM conversations), TRUE, NULL",
)
def _(spark, folder):
    names = ["documents", "benchmark", "absent", "conversations"]
    sources = [({"name": n, "type": "file"}, lambda n=n: table(spark, folder, n)) for n in names]
    return tb.collect_sources(spark, sources, COLLECTED)[1]


# Documents as JSON lines, of which every seventh is cut off in the middle; and a source that fails
# on a row while it is read.
_LINE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def _troubled(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text")
    line = F.to_json(F.struct("doc_id", "text"))
    cut = F.when(F.col("doc_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    path = f"{checkpoint_folder(spark)}/lines-{uuid.uuid4().hex}.jsonl"
    rows.select(cut.alias("value")).write.text(path)
    fails = F.when(F.col("item_id") % 5 == 3, F.raise_error(F.lit("unreadable")).cast("string")).otherwise(F.col("text"))
    loads = {
        "lines": lambda: tb.read_table(spark, path, _LINE, keep_corrupt=True),
        "failing": lambda: table(spark, folder, "benchmark").withColumn("text", fails),
        "absent": lambda: table(spark, folder, "absent"),
        "benchmark": lambda: table(spark, folder, "benchmark"),
    }
    done = tb.collect(spark, [({"name": n, "type": "file"}, load) for n, load in loads.items()], COLLECTED)
    remove_folder(spark, path)
    return done


@query(
    "source_ledger_failures",
    "SELECT 0::BIGINT AS position, 'lines' AS source, (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0) AS row_count, "
    "TRUE AS success, CAST(NULL AS VARCHAR) AS reason, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS bad_rows "
    "UNION ALL SELECT 1, 'failing', 0, FALSE, 'SparkRuntimeException', 0 "
    "UNION ALL SELECT 2, 'absent', 0, FALSE, 'AnalysisException', 0 "
    "UNION ALL SELECT 3, 'benchmark', (SELECT count(*) FROM benchmark), TRUE, NULL, 0",
)
def _(spark, folder):
    return _troubled(spark, folder).ledger


@query(
    "quarantined_lines",
    "SELECT 'lines' AS source, doc_id FROM documents WHERE doc_id % 7 = 0",
)
def _(spark, folder):
    """Which lines were set aside, by the key that can still be read off them."""
    lines = _troubled(spark, folder).quarantine
    return lines.select("source", F.regexp_extract("line", r'^\{"doc_id":(\d+)', 1).cast("long").alias("doc_id"))


@query(
    "ledger_metrics",
    "SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS row_count, 1 AS failed_sources",
)
def _(spark, folder):
    names = ["documents", "absent", "conversations"]
    sources = [({"name": n, "type": "file"}, lambda n=n: table(spark, folder, n)) for n in names]
    return tb.ledger_metrics(tb.collect_sources(spark, sources, COLLECTED)[1])


@query(
    "publish_table",
    "SELECT f AS format, doc_id, text, lang, n_chars, n_chars / 7.0 AS part FROM documents, (SELECT unnest(['csv', 'jsonl']) AS f)",
)
def _(spark, folder):
    """Both formats written, published over an older table, read back by their manifests."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars", (F.col("n_chars") / 7.0).alias("part"))
    base, out = f"{checkpoint_folder(spark)}/published-{uuid.uuid4().hex}", []
    for suffix in ("csv", "jsonl"):
        path = f"{base}/documents.{suffix}"
        tb.publish_table(docs.where("doc_id % 2 = 0"), path)
        tb.publish_table(docs, path)
        out.append(tb.read_published(spark, path).select(F.lit(suffix).alias("format"), *docs.columns))
    done = cut_lineage(out[0].union(out[1]))
    remove_folder(spark, base)
    return done


# -------------------------------------------------------------------------- unification


@query(
    "column_map",
    "SELECT doc_id, text, lang AS label, source AS audio, n_chars FROM documents",
)
def _(spark, folder):
    return un.column_map(table(spark, folder, "documents"), {"label": "lang", "audio": "source"})


@query(
    "infer_columns",
    "SELECT page_id, url, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS audio, url AS image, "
    "CAST(NULL AS VARCHAR) AS label FROM pages",
)
def _(spark, folder):
    return un.infer_columns(table(spark, folder, "pages")).drop("html")


_META = "json_object('doc_id', doc_id, 'lang', lang, 'source', source, 'n_chars', n_chars)::VARCHAR"


@query("pack_metadata", f"SELECT text, {_META} AS metadata FROM documents")
def _(spark, folder):
    return un.pack_metadata(table(spark, folder, "documents"))


@query(
    "stamp_provenance",
    f"SELECT doc_id, 'https://data.example.org/docs' AS source, '{COLLECTED}' AS collected_at FROM documents",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id")
    return un.stamp_provenance(rows, {"type": "api", "url": "https://data.example.org/docs"}, COLLECTED)


def _unified_sql(name: str, text: str, label: str, meta: str, image: str = "NULL") -> str:
    return (
        f"SELECT {text} AS text, CAST(NULL AS VARCHAR) AS audio, CAST({image} AS VARCHAR) AS image, "
        f"CAST({label} AS VARCHAR) AS label, '{name}' AS source, '{COLLECTED}' AS collected_at, "
        f"{meta} AS metadata FROM {name}"
    )


_DOCUMENTS = _unified_sql(
    "documents",
    "text",
    "lang",
    "json_object('doc_id', doc_id, 'source', source, 'n_chars', n_chars)::VARCHAR",
)


def _unified(spark, folder, name, mapping=None):
    source = {"type": "file", "name": name, "column_map": mapping or {}}
    return un.unify(table(spark, folder, name), source, COLLECTED)


@query("unify", _DOCUMENTS)
def _(spark, folder):
    return _unified(spark, folder, "documents", {"label": "lang"})


@query(
    "merge_sources",
    f"{_DOCUMENTS} UNION ALL "
    + _unified_sql("benchmark", "text", "NULL", "json_object('item_id', item_id)::VARCHAR")
    + " UNION ALL "
    + _unified_sql(
        "conversations", "text", "role", "json_object('conv_id', conv_id, 'turn', turn)::VARCHAR"
    ),
)
def _(spark, folder):
    frames = [
        _unified(spark, folder, "documents", {"label": "lang"}),
        _unified(spark, folder, "benchmark"),
        _unified(spark, folder, "conversations", {"label": "role"}),
    ]
    return un.merge_sources(spark, frames).select(*UNIFIED_COLUMNS)


@query(
    "restore_nested",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k, "
    "CAST(NULL AS VARCHAR) AS props_text FROM events",
)
def _(spark, folder):
    events = table(spark, folder, "events")
    cleaned = events.select("event_id", F.col("ts").cast("string").alias("ts"), "props")
    reference = "event_id bigint, ts timestamp, props map<string,bigint>"
    restored = un.restore_nested(cleaned, spark.createDataFrame([], reference).schema)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return restored.select("event_id", stamp.alias("ts"), F.col("props")["k"].alias("k"), "props_text")


# -------------------------------------------------------------------------------- pages


_DECODED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_SHOWN = (
    "regexp_replace(regexp_replace(html, '(?s)<(script|style|noscript)\\b.*?</(script|style|noscript)>', chr(10), 'g'), "
    "'(?s)<[^>]*>', chr(10), 'g')"
)


_FULL_TEXT = (
    "SELECT page_id, array_to_string(list_filter(list_transform(string_split("
    + _DECODED.format(_SHOWN)
    + ", chr(10)), lambda x: "
    + strip("x")
    + "), lambda x: x <> ''), chr(10)) AS full_text FROM pages"
)


@query("page_full_text", _FULL_TEXT)
def _(spark, folder):
    return pg.page_text(text_table(spark, folder, "pages")).select("page_id", "full_text")


# Blocks end at the tags of blocks; in them, the text of links stands between two marks.
_TAGS = "|".join(sorted(pg._BLOCKS))
_MARKED = "regexp_replace(html, '(?s)<(script|style|noscript)\\b.*?</(script|style|noscript)>', chr(2), 'g')"
for _tag, _mark in ((f"(?i)</?({_TAGS})\\b[^>]*>", 1), ("(?i)<a\\b[^>]*>", 3), ("(?i)</a>", 4), ("(?s)<[^>]*>", 2)):
    _MARKED = f"regexp_replace({_MARKED}, '{_tag}', chr({_mark}), 'g')"
_PIECE = "regexp_replace(" + strip(_DECODED.format("x")) + ", '\\s+', ' ', 'g')"
_MAIN_TEXT = f"""
    blocks AS (SELECT page_id, unnest(string_split({_MARKED}, chr(1))) AS b, generate_subscripts(string_split({_MARKED}, chr(1)), 1) AS i FROM pages),
    sized AS (SELECT page_id, i,
        array_to_string(list_filter(list_transform(string_split_regex(b, '[\\x02-\\x04]'), lambda x: {_PIECE}), lambda x: x <> ''), ' ') AS t,
        coalesce(list_sum(list_transform(regexp_extract_all(b, '\\x03([^\\x04]*)\\x04', 1), lambda x: length({_PIECE}))), 0) AS linked FROM blocks),
    prose AS (SELECT page_id, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (length(t) >= 40 AND linked < 0.5 * length(t)), '') AS main
        FROM sized GROUP BY page_id),
    texts AS (SELECT page_id, CASE WHEN length(main) >= 200 THEN 'main' ELSE 'full' END AS extract_method,
        CASE WHEN length(main) >= 200 THEN main ELSE full_text END AS text, full_text FROM prose JOIN ({_FULL_TEXT}) USING (page_id))"""


@query("page_text", f"WITH {_MAIN_TEXT} SELECT * FROM texts")
def _(spark, folder):
    return pg.page_text(text_table(spark, folder, "pages"))


# Links of the stored pages are rooted paths around plain text.
_LINKS = (
    r"""
    raw AS (SELECT page_id, url AS page_url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base,
                   regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h,
                   regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS t FROM pages),
    each AS (SELECT page_id, page_url, base, generate_subscripts(h, 1) AS i, unnest(h) AS href, unnest(t) AS shown FROM raw),
    links AS (SELECT page_id, page_url, base || """
    + _DECODED.format("href")
    + r""" AS url, min(i) AS spot, arg_min(regexp_replace("""
    + strip(_DECODED.format("shown"))
    + r""", '\s+', ' ', 'g'), i) AS text FROM each GROUP BY 1, 2, 3)"""
)


@query(
    "page_links",
    f"WITH {_LINKS} SELECT page_id, page_url, row_number() OVER (PARTITION BY page_id ORDER BY spot) - 1 AS position, "
    "url, text FROM links",
)
def _(spark, folder):
    return pg.page_links(text_table(spark, folder, "pages"), same_domain_only=True)


_SELECTED = 'nav > ul > li > a[href^="/a"], div.ad > a, p a.more'


@query(
    "page_links_selected",
    f"WITH {_LINKS}, chosen AS (SELECT page_id, page_url, url, min(i) AS spot, arg_min(text, i) AS text FROM "
    f"(SELECT e.page_id, e.page_url, e.i, base || {_DECODED.format('href')} AS url, "
    "regexp_replace(" + strip(_DECODED.format("shown")) + ", '\\s+', ' ', 'g') AS text FROM each e WHERE href LIKE '/a%') "
    "GROUP BY 1, 2, 3) "
    "SELECT page_id, page_url, row_number() OVER (PARTITION BY page_id ORDER BY spot) - 1 AS position, url, text FROM chosen",
)
def _(spark, folder):
    return pg.page_links(text_table(spark, folder, "pages"), selector=_SELECTED)


@query(
    "link_targets",
    f"WITH {_LINKS} SELECT url AS child_url, min(page_url) AS parent_url, count(*) AS parents FROM links GROUP BY url",
)
def _(spark, folder):
    return pg.link_targets(text_table(spark, folder, "pages"))


@query(
    "page_extract",
    f"WITH {_LINKS}, {_MAIN_TEXT}, counted AS (SELECT page_id, count(*) AS links FROM links GROUP BY page_id) "
    "SELECT page_id, url, extract_method, text, coalesce(links, 0) AS links FROM pages JOIN texts USING (page_id) "
    "LEFT JOIN counted USING (page_id)",
)
def _(spark, folder):
    found = pg.page_extract(text_table(spark, folder, "pages"))
    return found.select("page_id", "url", "extract_method", "text", F.size("links").alias("links"))


@query(
    "page_extract_markup",
    "SELECT page_id, sha256(html) AS html_sha256, length(html) AS chars FROM pages",
)
def _(spark, folder):
    found = pg.page_extract(text_table(spark, folder, "pages"))
    return found.select("page_id", F.sha2("html", 256).alias("html_sha256"), F.length("html").cast("long").alias("chars"))


@query(
    "expand_links",
    f"WITH {_LINKS}, c AS (SELECT url AS child_url, min(page_url) AS parent_url, count(*) AS parents FROM links GROUP BY url), "
    "k AS (SELECT url AS child_url, min(page_id) AS child_id FROM pages GROUP BY url) "
    "SELECT child_url, parent_url, parents, child_id, child_id IS NOT NULL AS fetched FROM c LEFT JOIN k USING (child_url)",
)
def _(spark, folder):
    return pg.expand_links(text_table(spark, folder, "pages"))


_CHUNK = "NULLIF(" + strip("text") + ", '')"


@query(
    "assemble_pages",
    f"""
    WITH joined AS (
      SELECT conv_id,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN {_CHUNK} END, chr(10) || chr(10) ORDER BY turn), '') AS a,
             coalesce(string_agg({_CHUNK}, chr(10) || chr(10) ORDER BY turn), '') AS b
      FROM conversations GROUP BY conv_id)
    SELECT conv_id,
           CASE WHEN length(a) >= 200 THEN 'answers' WHEN length(b) >= 200 THEN 'all' ELSE 'unparsed' END AS method,
           CASE WHEN length(a) >= 200 THEN a WHEN length(b) >= 200 THEN b ELSE '' END AS text
    FROM joined
    """,
)
def _(spark, folder):
    turns = table(spark, folder, "conversations").withColumn(
        "answer", F.when(F.col("role") == "assistant", F.col("text"))
    )
    return pg.assemble_pages(turns, "conv_id", "turn", [("answers", "answer"), ("all", "text")])


# ---------------------------------------------------------------------- scalar functions


@query(
    "collapse_ws",
    rf"SELECT doc_id, regexp_replace({strip('text')}, '\s+', ' ', 'g') AS text FROM documents",
)
def _(spark, folder):
    return text_table(spark, folder, "documents").select("doc_id", fx.collapse_ws(F.col("text")).alias("text"))


@query("normalize_text", f"SELECT doc_id, coalesce({norm('text')}, '') AS text FROM documents")
def _(spark, folder):
    return text_table(spark, folder, "documents").select("doc_id", fx.normalize_text(F.col("text")).alias("text"))


@query(
    "normalize_text_keep_math",
    r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}+\-=<>^*/\\]+', ' ', 'g')) AS text FROM documents",
)
def _(spark, folder):
    return text_table(spark, folder, "documents").select(
        "doc_id", fx.normalize_text(F.col("text"), keep_math=True).alias("text")
    )


@query(
    "fenced_block",
    "SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULLIF("
    + strip("text")
    + ", '') END AS block FROM conversations",
)
def _(spark, folder):
    fenced = F.concat(F.lit("Here:\n```json\n"), F.col("text"), F.lit("\n```\nDone. ```x```"))
    raw = F.when(F.col("role") == "user", fenced).otherwise(F.regexp_replace("text", "`", ""))
    turns = text_table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", fx.fenced_block(raw).alias("block"))


@query(
    "extract_json",
    "SELECT conv_id, turn, text, role FROM conversations",
)
def _(spark, folder):
    whole = F.to_json(F.struct("text", "role"))
    # A user's object stands after a remark, an assistant's in a fence.
    raw = F.when(F.col("role") == "user", F.concat(F.lit("As asked: "), whole, F.lit(" - done."))).otherwise(
        F.concat(F.lit("```json\n"), whole, F.lit("\n```"))
    )
    turns = text_table(spark, folder, "conversations").select(
        "conv_id", "turn", fx.extract_json(raw).alias("j")
    )
    return turns.select(
        "conv_id",
        "turn",
        F.get_json_object("j", "$.text").alias("text"),
        F.get_json_object("j", "$.role").alias("role"),
    )


@query("clip_text", f"SELECT doc_id, {clip('text', 400)} AS text FROM documents")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", fx.clip_text(F.col("text"), 400).alias("text"))


@query(
    "looks_numeric",
    rf"SELECT doc_id, regexp_matches({strip('first')}, '^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$') AS numeric, "
    "regexp_matches(shown, '^x') AS worded FROM (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') "
    "THEN ' ' || n_chars || '.5e3 ' ELSE lower(lang) END AS first, 'x' || n_chars AS shown FROM documents)",
)
def _(spark, folder):
    number = F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(".5e3 "))
    first = F.when(F.col("source").isin("src1", "src2"), number).otherwise(F.col("lang"))
    shown = F.concat(F.lit("x"), F.col("n_chars").cast("string"))
    return table(spark, folder, "documents").select(
        "doc_id", fx.looks_numeric(first).alias("numeric"), (~fx.looks_numeric(shown)).alias("worded")
    )


@query("word_count", f"SELECT doc_id, {words('text')}::BIGINT AS words FROM documents")
def _(spark, folder):
    return text_table(spark, folder, "documents").select("doc_id", fx.word_count(F.col("text")).alias("words"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(
    "tokens",
    f"SELECT doc_id, len({_TOKENS})::BIGINT AS tokens, array_to_string({_TOKENS}, ' ') AS text FROM documents",
)
def _(spark, folder):
    found = fx.tokens(F.col("text"))
    return text_table(spark, folder, "documents").select(
        "doc_id", F.size(found).alias("tokens"), F.array_join(found, " ").alias("text")
    )


@query("url_host", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", fx.url_host(F.col("url")).alias("host"))


@query(
    "absolute_url",
    r"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/next?page=' || page_id AS target FROM pages",
)
def _(spark, folder):
    href = F.concat(F.lit("/next?page="), F.col("page_id").cast("string"))
    return table(spark, folder, "pages").select(
        "page_id", fx.absolute_url(F.col("url"), href).alias("target")
    )


@query(
    "flatten_matches",
    f"SELECT doc_id, 0::BIGINT AS position, source AS repository, lang AS path, '' AS url, "
    f"CAST(n_chars AS DOUBLE) AS score, 1::BIGINT AS fragments, {clip('text', 400)} AS fragment FROM documents",
)
def _(spark, folder):
    item = F.struct(
        F.struct(F.col("source").alias("full_name")).alias("repository"),
        F.col("lang").alias("path"),
        F.col("n_chars").cast("double").alias("score"),
        F.array(
            F.struct(F.col("text").alias("fragment")), F.struct(F.lit("").alias("fragment"))
        ).alias("text_matches"),
    )
    responses = text_table(spark, folder, "documents").select(
        "doc_id", F.to_json(F.struct(F.array(item).alias("items"))).alias("payload")
    )
    flat = pl.flatten_matches(responses, "payload")
    return flat.withColumns(
        {"fragment": F.col("fragments")[0], "fragments": F.size("fragments")}
    )


@query(
    "stable_json",
    "SELECT json AS json, count(*) AS rows FROM (SELECT '{\"kind\":\"' || event_type || '\",\"props\":' || "
    "json_object('k', CAST(json_extract(props, '$.k') AS BIGINT))::VARCHAR || '}' AS json FROM events) GROUP BY json",
)
def _(spark, folder):
    events = table(spark, folder, "events")
    cell = F.struct(F.from_json("props", "map<string,bigint>").alias("props"), F.col("event_type").alias("kind"))
    nested = events.select(cell.alias("c"))
    stable = fx.stable_json(F.col("c"), nested.schema["c"].dataType)
    return nested.groupBy(stable.alias("json")).agg(F.count(F.lit(1)).alias("rows"))


# ----------------------------------------------------------------------------- profiles


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS column, '{t}' AS dtype, count(*) AS row_count, "
        f"count({c}) AS non_null FROM {name}"
        for i, (c, t) in enumerate(columns)
    )


_ORDERS = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "bigint"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"),
    ("o_orderpriority", "string"),
]


@query("profile_table", _profile_sql("orders", _ORDERS))
def _(spark, folder):
    return pf.profile_table(table(spark, folder, "orders"))


_DIRTY_TYPES = [
    ("doc_id", "bigint"),
    ("text", "string"),
    ("lang", "string"),
    ("source", "string"),
    ("n_chars", "bigint"),
    ("audio", "string"),
    ("label", "int"),
]


@query("profile_documents", f"WITH {DIRTY} " + _profile_sql("dirty", _DIRTY_TYPES))
def _(spark, folder):
    return pf.profile_table(dirty(spark, folder))


@query(
    "missing_by_column",
    f"WITH {DIRTY} SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) - count({c}) AS missing FROM dirty" for c, _ in _DIRTY_TYPES
    )
    + ") WHERE missing > 0",
)
def _(spark, folder):
    return pf.missing_by_column(dirty(spark, folder))


_DESCRIBE = {
    "count": "count(quality)",
    "mean": "avg(quality)",
    "std": "stddev_samp(quality)",
    "min": "min(quality)",
    "max": "max(quality)",
    "25%": "quantile_cont(quality, 0.25)",
    "50%": "quantile_cont(quality, 0.5)",
    "75%": "quantile_cont(quality, 0.75)",
}


@query(
    "profile_label",
    "SELECT 'label' AS section, 'unique_count' AS metric, '' AS column, count(DISTINCT quality)::DOUBLE AS value FROM labels "
    "UNION ALL SELECT 'label', 'top_value', value, rows::DOUBLE FROM ("
    + top("SELECT quality::VARCHAR AS value, count(*) AS rows FROM labels GROUP BY quality", "rows DESC, value", 10)
    + ") "
    + " ".join(
        f"UNION ALL SELECT 'label', 'describe_{m}', '', round({e}::DOUBLE, 6) FROM labels"
        for m, e in _DESCRIBE.items()
    ),
)
def _(spark, folder):
    return pf.profile_label(table(spark, folder, "labels"), "quality")


@query(
    "profile_text_words",
    "SELECT round(avg(w), 6) AS mean, round(quantile_cont(w, 0.5), 6) AS median, "
    "round(quantile_cont(w, 0.9), 6) AS p90, max(w)::BIGINT AS max "
    f"FROM (SELECT {words('text')} AS w FROM documents)",
)
def _(spark, folder):
    return pf.profile_text_words(text_table(spark, folder, "documents"))


@query(
    "profile_source",
    top("SELECT source AS value, count(*) AS rows FROM documents GROUP BY source", "rows DESC, value", 10),
)
def _(spark, folder):
    return pf.profile_source(table(spark, folder, "documents"))


@query(
    "metadata_keys",
    top(
        "SELECT unnest(json_keys(props)) AS name, count(*) AS rows FROM events GROUP BY 1", "rows DESC, name", 10
    ),
)
def _(spark, folder):
    return pf.metadata_keys(table(spark, folder, "events"), "props")


@query(
    "recommended_sections",
    "SELECT 0::BIGINT AS position, 'overview' AS section UNION ALL SELECT 1, 'missingness' "
    "UNION ALL SELECT 2, 'label_distribution' WHERE EXISTS (SELECT 1 FROM labels WHERE quality IS NOT NULL) "
    "UNION ALL SELECT 3, 'text_length_distribution' WHERE EXISTS (SELECT 1 FROM documents WHERE text IS NOT NULL) "
    "UNION ALL SELECT 4, 'source_distribution' WHERE EXISTS (SELECT 1 FROM documents WHERE source IS NOT NULL)",
)
def _(spark, folder):
    return pf.recommended_sections(docs(spark, folder))


@query(
    "length_histogram",
    f"""
    WITH w AS (SELECT {words('text')}::DOUBLE AS x FROM documents),
         e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 30 AS width FROM w),
         h AS (SELECT least(floor((x - lo) / width), 29)::BIGINT AS bin, count(*) AS rows FROM w, e GROUP BY 1)
    SELECT g.bin::BIGINT AS bin, round(lo + g.bin * width, 6) AS lower, coalesce(rows, 0) AS rows
    FROM range(30) g(bin) CROSS JOIN e LEFT JOIN h ON h.bin = g.bin
    """,
)
def _(spark, folder):
    return pf.length_histogram(text_table(spark, folder, "documents"))


@query(
    "label_distribution",
    top("SELECT quality::VARCHAR AS value, count(*) AS rows FROM labels GROUP BY 1", "rows DESC, value", 10),
)
def _(spark, folder):
    return pf.label_distribution(table(spark, folder, "labels"), "quality")


@query(
    "label_coverage_by_source",
    f"WITH {DOCS} "
    + top(
        "SELECT source, count(*) AS rows, round(count(label) / count(*), 6) AS coverage FROM docs GROUP BY source",
        "coverage DESC, source",
        10,
    ),
)
def _(spark, folder):
    return pf.label_coverage_by_source(docs(spark, folder))


_BOX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _box_sql(c: str) -> str:
    return f"""
    SELECT '{c}' AS column, round(q[1], 6) AS q1, round(q[2], 6) AS median, round(q[3], 6) AS q3,
           round(least(min(v) FILTER (v >= q[1] - 1.5 * (q[3] - q[1])), any_value(q[1])), 6) AS whisker_low,
           round(greatest(max(v) FILTER (v <= q[3] + 1.5 * (q[3] - q[1])), any_value(q[3])), 6) AS whisker_high,
           count(*) FILTER (v < q[1] - 1.5 * (q[3] - q[1]) OR v > q[3] + 1.5 * (q[3] - q[1])) AS fliers
    FROM (SELECT {c} AS v FROM lineitem),
         (SELECT quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM lineitem) GROUP BY q"""


@query("boxplot_stats", " UNION ALL ".join(_box_sql(c) for c in _BOX))
def _(spark, folder):
    return pf.boxplot_stats(table(spark, folder, "lineitem").select(*_BOX))


@query(
    "top_words",
    top(
        r"SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word, count(*) AS rows FROM documents GROUP BY 1",
        "rows DESC, word",
        20,
    ),
)
def _(spark, folder):
    return pf.top_words(text_table(spark, folder, "documents"))


@query(
    "preview",
    "SELECT doc_id, json_object('doc_id', doc_id, 'text', text, 'lang', lang, 'source', source, 'n_chars', n_chars)::VARCHAR "
    "AS record FROM documents ORDER BY doc_id LIMIT 3",
)
def _(spark, folder):
    return pf.preview(table(spark, folder, "documents"), "doc_id")


@query(
    "class_balance",
    "SELECT quality::VARCHAR AS value, count(*) AS rows, round(count(*) / (SELECT count(quality) FROM labels), 6) AS share "
    "FROM labels WHERE quality IS NOT NULL GROUP BY quality",
)
def _(spark, folder):
    return pf.class_balance(table(spark, folder, "labels"), "quality")
