"""Web archives: what is written is read back, and runs merge into one order."""

import collections
import gzip
import hashlib
import random

import oracle
import pytest

from corpusmill.llm import archive
from corpusmill.llm.catalog import ORACLE, QUERIES
from corpusmill.llm.scratch import Scratch

SCHEMA = "page_id long, url string, html string, key string, archive int"


def expected(pages):
    """Rows ``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the contract."""
    held = [(k, (html or "").encode()) for k, _, html in pages]
    heads = {}
    for k, data in held:
        if len(data) >= 1000 and k is not None:
            heads[data] = max(k, heads.get(data, k))
    out = []
    for k, data in held:
        head = heads.get(data) if k is not None else None
        again = head is not None and head != k
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=repr)


def through(spark, pages, **options):
    """The index of the archives of ``pages`` and their records with payloads."""
    with Scratch(spark, "test") as scratch:
        folder = scratch.path("warc")
        df = spark.createDataFrame([(*p, "clash", 1) for p in pages], SCHEMA).repartition(5)
        archive.write_archives(df, folder, archive_bytes=options.pop("archive_bytes", archive.ARCHIVE_BYTES))
        rows = archive.capture_history(spark, folder, **options).collect()
        records = archive.read_archives(spark, folder, payloads=True).collect()
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()
    return rows, records, {f.path.rpartition("/")[2]: bytes(f.content) for f in files}


def test_index_of_the_pages(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        df = QUERIES["op11_capture_index"](spark, folder)
        assert df.dtypes == [
            ("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"),
            ("record_type", "string"), ("refers_to", "bigint"),
        ]
        pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()
        assert sorted((tuple(r) for r in df.collect()), key=repr) == expected(pages)
        assert oracle.difference(df, oracle.connect(folder), ORACLE["op11_capture_index"]) is None


def some_pages():
    rng = random.Random(2)
    long = ["<p>" + w * 400 + "</p>" for w in ("abc", "é Ж", "WARC/1.1\r\n\r\n\x00", "\r\n")]
    urls = ["http://a.org/x", "https://www.A.org:443/x#top", "http://b.a.org/", "ftp://u:p@c.net:21", None, "", "http://ü.de/ä b\n"]
    pages = [(i, rng.choice(urls), rng.choice([*long, None, "", "short", "short", f"own {i} " * 300])) for i in range(400)]
    # A third of all captures are of one URL, a third of all payloads are alike.
    pages += [(1000 + i, "http://hot.org/", long[0] if i % 2 else f"version {i // 20} " * 100) for i in range(300)]
    return pages


@pytest.fixture(scope="module")
def archived(spark):
    return through(spark, some_pages(), merge_rows=50, archive_bytes=100_000)


def test_every_record_comes_back(archived):
    rows, records, files = archived
    pages = some_pages()
    told = [(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(told, key=repr) == expected(pages)
    html = {k: (h or "").encode() for k, _, h in pages}
    assert len(records) == len(pages) and len(files) > 3
    for r in records:
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.key]
    # Offsets and lengths address single members; a plain reader takes a file as a whole.
    for r in rows:
        member = gzip.decompress(files[r.archive][r.offset : r.offset + r.length])
        assert member.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert member.endswith(b"\r\n\r\n") and f"page:{r.key}>".encode() in member
    for data in files.values():
        whole = gzip.decompress(data)
        assert not whole or whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_history_is_in_one_order_over_all_runs_and_ranges(archived):
    rows = sorted(archived[0], key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.url_key, r.captured_at, r.key) for r in rows] == sorted((r.url_key, r.captured_at, r.key) for r in rows)
    seen, last = collections.Counter(), {}
    for r in rows:
        seen[r.url_key] += 1
        assert r.capture == seen[r.url_key]
        assert r.changed == (last.get(r.url_key) != r.payload_digest)
        last[r.url_key] = r.payload_digest
    assert seen["org,hot)/"] == 300


def test_odd_pages(spark):
    big = "0123456789abcdef" * 1_100_000
    pages = [(1, None, None), (2, "", ""), (None, "http://a/", big), (None, None, "x" * 2000), (3, "u", "x" * 2000)]
    pages += [(4, "u", "y" * 2000), (4, "u", "y" * 2000), (3, "u", "y" * 2000), (5, "http://long/", big), (6, "é" * 9000, "z" * 999)]
    pages += [(7, "v", "z" * 999), (8, "v", "z" * 1000), (9, "v", "z" * 1000)]
    rows, records, _ = through(spark, pages)
    told = [(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(told, key=repr) == expected(pages)
    assert sorted(len(r.payload) for r in records if r.payload is not None)[-2:] == [len(big)] * 2


def test_no_pages(spark):
    rows, records, _ = through(spark, [])
    assert rows == [] and records == []


def test_times_and_keys_of_other_types(spark):
    with Scratch(spark, "test") as scratch:
        df = spark.sql(
            "SELECT * FROM VALUES ('b/1', 'http://x.org', 'one', timestamp'2020-01-02 03:04:05'), ('', 'http://x.org', 'two', NULL),"
            " (NULL, 'http://x.org', 'one', timestamp'2019-01-01 00:00:00') AS t(id, link, body, seen)"
        )
        archive.write_archives(df, scratch.path("w"), "id", "link", "body", "seen")
        rows = archive.capture_history(spark, f"{scratch.folder}/1-w", "string").orderBy("position").collect()
    assert [(r.captured_at, r.key, r.changed) for r in rows] == [
        ("20190101000000", None, True), ("20200102030405", "b/1", False), ("20240101000000", "", True),
    ]


def test_merge_order_equals_a_sort():
    rng = random.Random(8)
    for _ in range(300):
        runs = [sorted((rng.randrange(9), rng.randrange(3)) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(12))]
        keys = [k for run in runs for k in run]
        starts = [0]
        for run in runs:
            starts.append(starts[-1] + len(run))
        # A sort that keeps equal keys in place has the same order.
        assert archive.merge_order(keys, starts) == sorted(range(len(keys)), key=lambda i: keys[i])


@pytest.mark.parametrize(
    "url, key",
    [
        (None, ""),
        ("http://www.Example.org:80/A?b=c#d", "org,example)/A?b=c"),
        ("https://user:pw@www2.b.example.org:8080", "org,example,b:8080)/"),
        ("example.org?q", "org,example)/?q"),
        ("http:///path", ")/path"),
        ("//", ")//"),
    ],
)
def test_url_keys(url, key):
    assert archive.url_key(url) == key
