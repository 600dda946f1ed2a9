"""Web archives: WARC files of captures, read back as sorted runs that merge into one index.

Every archive file gives one run of index entries, sorted by URL key and time. Tasks own ranges of
that order; each fetches its stretch of every run and merges the stretches by a loser tree, so the
partitions one after the other are the globally ordered index. Ranges are cut by key, time and
record, so a URL that was captured more often than anything else spreads over many of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.base import query, slices, sql_type, table
from corpusmill.llm.scratch import Scratch, placed

# Payloads from this size on are stored once; equal later ones refer to the first.
LEAST_SHARED_BYTES = 1000
# Payload bytes of an archive file before compression, and index entries of a merging task.
ARCHIVE_BYTES = 64_000_000
MERGE_ROWS = 200_000
# Without a column of capture times a record's key counts seconds from here (2024-01-01).
FIRST_TIME, TIMES = 1_704_067_200, 315_360_000
# Bytes fed to the decompressor at once.
_CHUNK = 1 << 16
# White space and controls would break a head.
_UNFIT = re.compile(r"[\s\x00-\x20\x7f-\x9f]")
# The profile of a revisit (fixed value of the format).
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "urn:corpus:page"
_ABOUT = ("WARC-Type: warcinfo", "Content-Type: application/warc-fields", "format: WARC File Format 1.1\r\n")

INDEX = (
    "url_key string, captured_at string, key {kind}, archive string, place bigint, offset bigint, length bigint, "
    "url string, record_type string, payload_bytes bigint, payload_digest string, refers_to {kind}"
)


def url_key(url: str | None) -> str:
    """Host labels from the top domain down, then the path: neighbours in the index belong together.

    Scheme, user, a leading ``www``, default ports and the fragment do not count; hosts are
    lower-cased. A null URL has the empty key.
    """
    if not url:
        return ""
    rest = re.sub(r"#.*", "", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url, count=1), flags=re.S)
    host, path = re.match(r"([^/?]*)(.*)", rest, re.S).groups()
    host = re.sub(r"^www\d*\.(?=.)", "", re.sub(r":(?:80|443)?$", "", host.rpartition("@")[2].lower()))
    name, colon, port = host.partition(":")
    return f"{','.join(reversed(name.split('.')))}{colon}{port}){path if path.startswith('/') else '/' + path}"


# ------------------------------------------------------------------------------------ writing


def revisits(pages: DataFrame, key: str, html: str, least: int = LEAST_SHARED_BYTES) -> DataFrame:
    """``(key, content, refers_to)`` of the rows whose payload a row of larger key holds as well.

    Payloads are equal when their SHA-256 is. A row travels as key and digest; copies fold on the
    map side to the largest key of each digest.
    """
    slim = _named(pages, key, html).where(f"octet_length(html) >= {least} AND key IS NOT NULL")
    slim = slim.select("key", _content().alias("content"))
    heads = slim.groupBy("content").agg(F.max("key").alias("refers_to"))
    return slim.join(heads, "content").where("key < refers_to").select("key", "content", "refers_to").distinct()


def _named(pages: DataFrame, key: str, html: str, *more: Column) -> DataFrame:
    return pages.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"), *more)


def _content() -> Column:
    return F.unhex(F.sha2(F.col("html").cast("binary"), 256))


def _address(key: object) -> str:
    return f"<{_RECORD}{'' if key is None else ':' + quote(str(key), safe='')}>"


def _key(address: str | None, whole: bool) -> int | str | None:
    """The key in a record's address; ``whole`` keys are integers."""
    _, colon, told = (address or "").strip().strip("<>").removeprefix(_RECORD).partition(":")
    return (int(told) if whole else unquote(told)) if colon else None


def _member(lines: list[str], block: bytes) -> bytes:
    """A record as a gzip member without its last byte, which is zero.

    The last byte of a member is the top byte of a record's size: an empty member stands behind
    records of 16 MB and more. Spark's text writer puts the byte back as its line end.
    """
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    data = gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)
    if data[-1]:
        data += gzip.compress(b"", 6, mtime=0)
    return data[:-1]


def _capture(key: object, url: str | None, moment: str, payload: bytes, refers_to: object) -> bytes:
    digest = hashlib.sha1(payload, usedforsecurity=False).digest()
    # The full payload's length stays in the HTTP head of a revisit.
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_address(key)}"]
    lines += [f"WARC-Date: {moment}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if url is not None:
        # White space and controls would break the head.
        lines.append(f"WARC-Target-URI: {_UNFIT.sub(lambda m: quote(m[0]), url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_address(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines.append("Content-Type: application/http; msgtype=response")
    return _member(lines, block + (payload if refers_to is None else b""))


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    time: str | None = None,
    least: int = LEAST_SHARED_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a WARC record per row to files of gzip members in ``folder``.

    Of rows with equal payloads (the text in UTF-8, null is empty) of at least ``least`` bytes, the
    one with the largest key is stored as response and the others as revisits that refer to it. A
    row without key is a response, and so are rows that share that largest key. ``time`` names a
    timestamp column. Every file begins with a record that describes it and holds about
    ``archive_bytes`` of payload, or one larger payload.
    """
    kind = sql_type(pages, key)
    number = F.col(f"`{key}`").cast("decimal(38,0)") if kind in ("tinyint", "smallint", "int", "bigint") else F.lit(0)
    second = F.lit(FIRST_TIME) + F.pmod(F.coalesce(number, F.lit(0)), F.lit(TIMES)).cast("long")
    moment = F.col(f"`{time}`").cast("timestamp") if time else F.timestamp_seconds(second)
    moment = F.coalesce(moment, F.timestamp_seconds(F.lit(FIRST_TIME)))
    told = F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = _named(pages, key, html, F.col(f"`{url}`").cast("string").alias("url"), told.alias("moment"))
    size = rows.agg(F.avg(F.octet_length("html") + 500)).first()[0] or 1
    # Rows meet their revisit by key and content, which no two rows need share, however many copies
    # a payload has.
    known = revisits(pages, key, html, least).withColumnRenamed("refers_to", "head")
    marked = rows.withColumn("content", _content()).join(known.hint("shuffle_hash"), ["key", "content"], "left")
    records_per_file = max(2, int(archive_bytes / size))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for part, texts in slices(batches, 0, as_bytes=True):
            cells = []
            for payload, k, u, m, head in zip(texts, *(part.column(i).to_pylist() for i in range(1, 5))):
                if written % records_per_file == 0:
                    cells.append(_member(list(_ABOUT[:2]), _ABOUT[2].encode()))
                    written += 1
                cells.append(_capture(k, u, m, payload, head))
                written += 1
            yield pa.record_batch([pa.array(cells, pa.binary())], ["record"])

    records = marked.select("html", "key", "url", "moment", "head").mapInArrow(work, "record binary")
    # The writer puts the bytes of a string out as they are.
    out = records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0")
    out.option("maxRecordsPerFile", records_per_file).text(folder)


# ------------------------------------------------------------------------------------ reading


def _members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, content)`` of the gzip members of a file; empty ones count to the one before."""
    view, at = memoryview(data), 0
    held: tuple[int, int, bytes] | None = None
    while at < len(view):
        unpack, start, parts = zlib.decompressobj(zlib.MAX_WBITS | 16), at, []
        while not unpack.eof:
            piece = view[at : at + _CHUNK]
            if not len(piece):
                raise ValueError("an archive ends inside a record")
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        content = b"".join(parts)
        if content or held is None:
            if held:
                yield held
            held = (start, at - start, content)
        else:
            held = (held[0], at - held[0], held[2])
    if held:
        yield held


def _head(data: bytes) -> tuple[dict[str, str], int]:
    """Fields of a head by lower-case name, and where its body begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}, end + 4


def _captures(data: bytes, whole: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Index entry and payload (null for a revisit) of every capture in a file."""
    for offset, length, content in _members(data):
        fields, at = _head(content)
        kind = fields["warc-type"]
        if kind in ("response", "revisit"):
            block = content[at : at + int(fields["content-length"])]
            http, body = _head(block)
            payload = block[body:] if kind == "response" else None
            if payload is None:
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
            else:
                digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
            url = fields.get("warc-target-uri")
            yield {
                "url_key": url_key(url), "captured_at": re.sub(r"\D", "", fields["warc-date"]),
                "key": _key(fields["warc-record-id"], whole), "offset": offset, "length": length, "url": url,
                "record_type": kind, "payload_bytes": int(http["content-length"]), "payload_digest": digest,
                "refers_to": _key(fields.get("warc-refers-to"), whole),
            }, payload


def _order(entry: dict) -> tuple:
    return entry["url_key"], entry["captured_at"], entry["key"] is not None, entry["key"] or 0, entry["offset"]


def read_archives(spark: SparkSession, folder: str, kind: str = "bigint", payloads: bool = False) -> DataFrame:
    """Index entries of all archives of ``folder``, one sorted run per file; ``payload`` on request.

    ``kind`` is the type of the keys. Digests of responses are taken from their payloads, not from
    their heads. ``archive`` names the run, ``place`` counts its entries from 0.
    """
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    names = re.findall(r"(\w+) (?:string|bigint|\{kind\})", INDEX) + ["payload"] * payloads

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                run, held = [], 0
                # A run is sorted before it leaves; with payloads it leaves as it lies in the file.
                for entry, payload in _captures(data.as_py(), whole):
                    # The index does without payloads, which are read one at a time.
                    payload = payload if payloads else None
                    run.append(entry | {"archive": path.rpartition("/")[2], "payload": payload})
                    held += len(payload or b"")
                    if held > _CHUNK * 64:
                        yield entries(run)
                        run, held = [], 0
                if not payloads:
                    run.sort(key=_order)
                    for place, entry in enumerate(run):
                        entry["place"] = place
                for at in range(0, len(run), 10_000):
                    yield entries(run[at : at + 10_000])

    schema = pa.schema([(n, _ARROW.get(n, pa.string())) for n in names])
    if whole:
        for n in ("key", "refers_to"):
            schema = schema.set(names.index(n), pa.field(n, pa.int64()))

    def entries(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    held = "bigint" if whole else "string"
    found = files.mapInArrow(work, INDEX.format(kind=held) + ", payload binary" * payloads)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("key", "refers_to")})


_ARROW = {c: pa.int64() for c in ("place", "offset", "length", "payload_bytes")} | {"payload": pa.binary()}


# ------------------------------------------------------------------------------------ merging


def merge_order(keys: list[tuple], starts: list[int]) -> list[int]:
    """Places of ``keys`` in order, where each stretch from one start to the next is sorted.

    A loser tree over the stretches: an inner node keeps the loser of its match, so the next winner
    is found by replaying the path of the last one. Equal keys come in the order of the stretches.
    """
    runs = len(starts) - 1
    at, ends = starts[:-1], starts[1:]
    heads: list[tuple | None] = [keys[a] if a < e else None for a, e in zip(at, ends)]

    def wins(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    losers, champion = [-1] * max(runs, 1), 0
    for leaf in range(runs):
        champion, node = leaf, (leaf + runs) // 2
        while node:
            if losers[node] < 0:
                losers[node] = champion
                break
            if wins(losers[node], champion):
                losers[node], champion = champion, losers[node]
            node //= 2
    out = []
    while runs and heads[champion] is not None:
        out.append(at[champion])
        at[champion] += 1
        heads[champion] = keys[at[champion]] if at[champion] < ends[champion] else None
        node = (champion + runs) // 2
        while node:
            if wins(losers[node], champion):
                losers[node], champion = champion, losers[node]
            node //= 2
    return out


def merge_runs(runs: DataFrame, rows: int, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The runs' ``rows`` entries, partitions and rows in the order of URL key, time and key.

    ``nth`` counts the captures of a URL key within a partition, ``before`` is the digest of the
    one in front. A task holds its range of the order: about ``merge_rows`` entries without payload.
    """
    ranges = max(1, -(-rows // merge_rows))
    order = ["url_key", "captured_at", "key", "offset", "archive"]
    dealt = runs.repartitionByRange(ranges, *order).sortWithinPartitions("archive", "place")
    names = dealt.columns
    spots = {n: i for i, n in enumerate(names)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held).combine_chunks()
        cells = [part.column(spots[c]).to_pylist() for c in order]
        keys = [(u, t, k is not None, k or 0, o, a) for u, t, k, o, a in zip(*cells)]
        archives = cells[4]
        starts = [i for i in range(len(keys)) if not i or archives[i] != archives[i - 1]] + [len(keys)]
        merged = part.take(pa.array(merge_order(keys, starts)))
        urls, digests = merged.column(spots["url_key"]).to_pylist(), merged.column(spots["payload_digest"]).to_pylist()
        nth, before = [], []
        for i, u in enumerate(urls):
            again = i > 0 and urls[i - 1] == u
            nth.append(nth[-1] + 1 if again else 1)
            before.append(digests[i - 1] if again else None)
        merged = merged.append_column("nth", pa.array(nth, pa.int64())).append_column("before", pa.array(before, pa.string()))
        yield from merged.to_batches(max_chunksize=10_000)

    kinds = ", ".join(f"{n} {t}" for n, t in dealt.dtypes)
    return dealt.mapInArrow(work, f"{kinds}, nth bigint, before string")


def capture_history(spark: SparkSession, folder: str, kind: str = "bigint", merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The index of all archives of ``folder``: a row per capture with its place in the whole order.

    ``position`` numbers all captures by URL key, time and key, ``capture`` those of one URL key;
    ``changed`` says that a payload differs from that of the capture before. No archives give no
    rows.
    """
    with Scratch(spark, "captures") as scratch:
        runs = scratch.store(read_archives(spark, folder, kind), "runs")
        merged = placed(scratch, merge_runs(runs, runs.count(), merge_rows), "position", part="part")
        # A merging task counts a URL's captures from 1; what the partitions before it have of the
        # same URL is carried over. One row per partition.
        last = F.max_by(F.struct("url_key", "nth", "payload_digest"), "position").alias("last")
        ends = merged.groupBy("part").agg(F.min_by("url_key", "position").alias("first"), last)
        carried, key, count, digest = [], None, 0, None
        for end in ends.orderBy("part").collect():
            carried.append((end["part"], key, count, digest))
            same = key == end["first"] == end["last"]["url_key"]
            count = end["last"]["nth"] + (count if same else 0)
            key, digest = end["last"]["url_key"], end["last"]["payload_digest"]
        carry = spark.createDataFrame(carried, "part bigint, `from` string, n bigint, digest string")
        told = merged.join(F.broadcast(carry), "part")
        goes_on = F.col("url_key") == F.col("from")
        before = F.coalesce("before", F.when(goes_on & (F.col("nth") == 1), F.col("digest")))
        return scratch.finish(
            told.select(
                "position", "url_key", (F.col("nth") + F.when(goes_on, F.col("n")).otherwise(0)).alias("capture"),
                "captured_at", "key", "record_type", "payload_bytes", "payload_digest", "refers_to",
                (before.isNull() | (before != F.col("payload_digest"))).alias("changed"), "url", "archive", "offset", "length",
            )
        )


SQL = f"""
WITH held AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
heads AS (SELECT payload_digest, max(page_id) AS head FROM held WHERE payload_bytes >= {LEAST_SHARED_BYTES} GROUP BY ALL)
SELECT page_id, payload_bytes, held.payload_digest,
  CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < head THEN head END AS refers_to
FROM held LEFT JOIN heads ON held.payload_digest = heads.payload_digest AND payload_bytes >= {LEAST_SHARED_BYTES}
"""


@query("op11_capture_index", SQL)
def _op11(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as archives, and the merged index of what the archives hold."""
    pages = table(spark, folder, "pages")
    with Scratch(spark, "archives") as scratch:
        written = scratch.path("warc")
        write_archives(pages, written)
        history = capture_history(spark, written, sql_type(pages, "page_id"))
    return history.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
