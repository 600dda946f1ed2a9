import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.schema import UNIFIED_COLUMNS
from corpusmill.sources import pages, payloads, tables, unify

NOW = "2024-01-01T00:00:00+00:00"


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é, \"x\"\ny", None), (2, None, 2.5)], "a bigint, b string, c double")
    for suffix in ("jsonl", "csv"):
        path = str(tmp_path / f"t.{suffix}")
        tables.write_table(rows, path)
        back = tables.read_table(spark, path, rows.schema, multi_line=suffix == "csv")
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    raw = spark.read.text(str(tmp_path / "t.jsonl")).collect()
    assert any('"c":null' in r["value"] and "é" in r["value"] for r in raw)
    assert tables.processed_path("s3://b/d/t.csv") == "s3://b/d/t_processed.csv"
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xml")
    with pytest.raises(ValueError):
        tables.write_table(rows, str(tmp_path / "t.xml"))


def test_json_array_and_other_suffix(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "t.data").write_text('{"a": 3}\n')
    assert tables.read_table(spark, str(tmp_path / "t.json")).count() == 2
    assert tables.read_table(spark, str(tmp_path / "t.data"), other_as_lines=True).first()["a"] == 3


def test_file_table_source_and_corrupt_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,review\n2,b\n1,a\n3,c\n")
    source = {"type": "file", "name": "reviews", "limit": 2}
    got = tables.file_table_source(spark, str(tmp_path / "t.csv"), source, NOW, "id").collect()
    assert sorted(r["text"] for r in got) == ["a", "b"] and got[0]["source"] == "reviews"
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    schema = spark.createDataFrame([], "a int").schema
    bad = tables.corrupt_rows(spark, str(tmp_path / "bad.jsonl"), schema, "s").first()
    assert (bad["row_count"], bad["corrupt_rows"]) == (2, 1)


def test_infer_columns(spark):
    both = unify.infer_columns(spark.createDataFrame([("b", "c")], "body string, content string"))
    assert both.first()["text"] == "c" and {"body", "content"} <= set(both.columns)
    assert unify.infer_columns(spark.createDataFrame([("u",)], "url string")).first()["image"] == "u"
    assert unify.infer_columns(spark.createDataFrame([("T",)], "Text string")).first()["audio"] is None


def test_unify_keeps_leftovers_in_metadata(spark):
    raw = spark.createDataFrame([("t", 1, None, "old")], "review string, stars int, note string, source string")
    row = unify.unify(raw, {"type": "api", "endpoint": "http://e"}, NOW).first()
    assert list(row.asDict()) == UNIFIED_COLUMNS
    assert row["metadata"] == '{"review":"t","stars":1,"note":null,"source":"old"}'
    assert (row["source"], row["collected_at"], row["label"]) == ("http://e", NOW, None)
    only = unify.unify(
        spark.createDataFrame([("t", "a", "i", "l")], "text string, audio string, image string, label string"),
        {"type": "x"},
        NOW,
    ).first()
    assert only["metadata"] == "{}" and only["source"] == "x"


def test_merge_without_sources(spark):
    empty = unify.merge_sources(spark, [])
    assert empty.count() == 0 and empty.columns == UNIFIED_COLUMNS


def test_failed_source_is_recorded(spark):
    good = spark.createDataFrame([("a",), ("b",)], "text string")

    def broken():
        raise ValueError("no records")

    merged, ledger = tables.collect_sources(
        spark, [({"type": "x", "name": "bad"}, broken), ({"type": "x", "name": "good"}, lambda: good)], NOW
    )
    assert merged.count() == 2
    rows = {r["source"]: (r["row_count"], r["success"], r["reason"]) for r in ledger.collect()}
    assert rows == {"bad": (0, False, "ValueError"), "good": (2, True, None)}
    assert tuple(tables.ledger_metrics(ledger).first()) == (2, 1)


def test_restore_nested(spark):
    reference = spark.createDataFrame([], "m map<string,int>, a array<int>, t timestamp").schema
    cleaned = spark.createDataFrame(
        [('{"k": 1}', "[1,2]", "2024-01-02T03:04:05Z"), ("plain", "x", "never"), (None, None, None)],
        "m string, a string, t string",
    )
    rows = unify.restore_nested(cleaned, reference).collect()
    assert rows[0]["m"] == {"k": 1} and rows[0]["a"] == [1, 2] and rows[0]["t"].year == 2024
    assert rows[1]["m"] is None and rows[1]["m_text"] == "plain" and rows[1]["t"] is None


def test_extract_records(spark):
    rows = spark.createDataFrame(
        [(1, '{"data":[{"items":[{"x":1},{"x":2}]}]}')], "id int, payload string"
    )
    got = payloads.extract_records(rows, "payload", "data.0.items", "struct<x:int>").collect()
    assert [(r["position"], r["record"]["x"]) for r in got] == [(0, 1), (1, 2)]
    bare = spark.createDataFrame([(1, '[{"x":5}]')], "id int, payload string")
    assert payloads.extract_records(bare, "payload", None, "struct<x:int>").first()["record"]["x"] == 5
    assert payloads.extract_records(rows, "payload", "data.1", "struct<x:int>", strict=False).count() == 0
    with pytest.raises(Exception, match="No list of records"):
        payloads.extract_records(rows, "payload", "data.1", "struct<x:int>").collect()


def test_parse_payload_records(spark):
    raws = [
        '{"records": [{"text": "a"}, "b"], "notes": ["n"]}',
        '```json\n{"records": {"text": "c"}, "notes": "m"}\n```',
        "{'records': [{'text': 'd', 'x': None}]}",
        '["e"]',
        "nothing",
        '{"records": []}',
    ]
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    got = payloads.parse_payload_records(rows, "raw").orderBy("id", "position").collect()
    texts = [(r["id"], r["record"] and r["record"].replace(" ", ""), r["notes"], r["error"] is None) for r in got]
    assert texts == [
        (0, '{"text":"a"}', ["n"], True),
        (0, '{"text":"b"}', ["n"], True),
        (1, '{"text":"c"}', ["m"], True),
        (2, '{"text":"d","x":null}', [], True),
        (3, '{"text":"e"}', [], True),
        (4, None, [], False),
    ]


def test_flatten_matches(spark):
    payload = (
        '{"items":[{"repository":{"full_name":"o/r"},"path":"p.py","html_url":"u","score":2,'
        '"text_matches":[{"fragment":" f "},{"fragment":""}]},{"path":null}]}'
    )
    rows = spark.createDataFrame([(1, payload)], "id int, payload string")
    first, second = payloads.flatten_matches(rows, "payload").orderBy("position").collect()
    assert (first["repository"], first["path"], first["score"], first["fragments"]) == ("o/r", "p.py", 2.0, ["f"])
    assert (second["repository"], second["path"], second["score"], second["fragments"]) == ("", "", 0.0, [])
    assert payloads.flatten_matches(rows, "payload", limit=1).count() == 1


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><script>var a="</p>";</script>
<h1>Title</h1><p>Body <b>text</b> here &amp; now.</p><noscript>off</noscript>
<nav><a href="/x">One  <i>more</i></a><a href="/x">again</a><a href="">none</a><a>no</a>
<a href="mailto:m@n">mail</a><a href="http://other.org/">out</a></nav><!-- c --></body></html>"""


def test_page_text_and_links(spark):
    rows = spark.createDataFrame([(1, "http://a.org/d/", PAGE), (2, None, None), (3, "http://a.org", "<p <a href='/q'>z")],
                                 "page_id int, url string, html string")
    texts = {r["page_id"]: r for r in pages.page_text(rows).collect()}
    assert texts[1]["text"] == "T\nTitle\nBody\ntext\nhere & now.\nOne\nmore\nagain\nnone\nno\nmail\nout"
    assert texts[1]["extract_method"] == "full" and texts[2]["text"] == ""
    links = [(r["url"], r["text"]) for r in pages.page_links(rows).where("page_id = 1").orderBy("position").collect()]
    assert links == [("http://a.org/x", "One more"), ("mailto:m@n", "mail"), ("http://other.org/", "out")]
    near = pages.page_links(rows, same_domain_only=True).where("page_id = 1")
    assert {r["url"] for r in near.collect()} == {"http://a.org/x", "mailto:m@n"}
    assert pages.page_links(rows, selector="nav a").where("page_id = 1").count() == 3
    assert pages.page_links(rows, selector="p a").where("page_id = 1").count() == 0


def test_main_text_wins_when_long(spark):
    prose = "Plain words that go on and on. " * 10
    html = f"<nav><a href='/a'>A</a></nav><article><p>{prose}</p></article>"
    row = pages.page_text(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).first()
    assert row["extract_method"] == "main" and row["text"] == prose.strip()


def test_expand_links(spark):
    rows = spark.createDataFrame(
        [(1, "http://a/", '<a href="/b">b</a><a href="/c">c</a>'), (2, "http://a/b", '<a href="/c">c</a>')],
        "page_id int, url string, html string",
    )
    got = {r["child_url"]: (r["parent_url"], r["parents"], r["fetched"]) for r in pages.expand_links(rows).collect()}
    assert got == {"http://a/b": ("http://a/", 1, True), "http://a/c": ("http://a/", 2, False)}


def test_assemble_pages(spark):
    rows = spark.createDataFrame(
        [(1, 2, " b ", "y" * 210), (1, 1, "a", " "), (2, 1, None, "short")], "d int, p int, e1 string, e2 string"
    )
    got = {r["d"]: (r["method"], r["text"]) for r in pages.assemble_pages(rows, "d", "p", [("e1", "e1"), ("e2", "e2")]).collect()}
    assert got == {1: ("e2", "y" * 210), 2: ("unparsed", "")}
    assert pages.join_pages(rows, "d", "p", "e1").where("d = 1").first()["text"] == "a\n\nb"


def test_sources_that_fail_while_they_are_read(spark, tmp_path):
    """A row that cannot be made, a broken file and unreadable lines cost their own source only."""
    good = spark.createDataFrame([("a",), ("b",)], "text string")
    broken = tmp_path / "broken.parquet"
    broken.write_bytes(b"PAR1 this is no table PAR1")
    (tmp_path / "lines.jsonl").write_text('{"text": "one"}\nnot json\n{"text": "two"}\n{"text": \n')
    (tmp_path / "cells.csv").write_text("text,n\nx,1\ny,many\nz,3\n")
    schema = T.StructType([T.StructField("text", T.StringType())])
    numbered = T.StructType([*schema.fields, T.StructField("n", T.IntegerType())])
    fails = good.withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    sources = {
        "row": lambda: fails,
        "file": lambda: spark.read.schema(schema).parquet(str(broken)),
        "lines": lambda: tables.read_table(spark, str(tmp_path / "lines.jsonl"), schema, keep_corrupt=True),
        "cells": lambda: tables.read_table(spark, str(tmp_path / "cells.csv"), numbered, keep_corrupt=True),
        "good": lambda: good,
    }
    done = tables.collect(spark, [({"type": "x", "name": n}, load) for n, load in sources.items()], NOW)
    rows = {r["source"]: (r["row_count"], r["success"], r["bad_rows"]) for r in done.ledger.collect()}
    assert rows == {"row": (0, False, 0), "file": (0, False, 0), "lines": (2, True, 2), "cells": (2, True, 1), "good": (2, True, 0)}
    assert all(r["reason"] for r in done.ledger.where("NOT success").collect())
    assert done.merged.count() == 6
    assert sorted(tuple(r) for r in done.quarantine.collect()) == [("cells", "y,many"), ("lines", "not json"), ("lines", '{"text": ')]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "lines.jsonl"), keep_corrupt=True)


def test_published_tables(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith\r\nlines', 1.5, ["x"], None), (2, None, None, [], ""), (3, "", 0.1, None, "é")]
    df = spark.createDataFrame(rows, "id long, text string, n double, tags array<string>, note string")
    for name in ("t.csv", "t.jsonl"):
        path = str(tmp_path / name)
        tables.publish_table(df.limit(1), path)
        assert tables.publish_table(df, path)["rows"] == 3
        back = tables.read_published(spark, path).orderBy("id")
        assert back.columns == df.columns and back.schema["n"].dataType.simpleString() == "double"
        assert [r["n"] for r in back.collect()] == [1.5, None, 0.1]
        # Nothing else is left.
        assert {p.name for p in tmp_path.iterdir()} == {"t.csv", name}
    assert [r["text"] for r in back.collect()] == [r[1] for r in rows]
    assert back.collect()[0]["tags"] == ["x"]
    fails = df.withColumn("note", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(PySparkException):
        tables.publish_table(fails, str(tmp_path / "t.jsonl"))
    assert tables.read_published(spark, str(tmp_path / "t.jsonl")).count() == 3 and len(list(tmp_path.iterdir())) == 2


@pytest.mark.parametrize(
    "selector, found",
    [
        ("a", "1234567"),
        ("nav a", "123"),
        ("nav > a", "1"),
        ("ul > li > a", "23"),
        (".more", "3"),
        ("a.more.big", "3"),
        ("#top a", "123"),
        ("[data-x]", "45"),
        ("a[data-x=y]", "4"),
        ('a[href^="/p"], nav > a', "1567"),
        ("a[rel~=next]", "6"),
        ("p > a[href$='.html']", "7"),
        ("div a", ""),
    ],
)
def test_link_selectors(spark, selector, found):
    html = (
        '<nav id="top"><a href="/1">1</a><ul><li><a href="/2">2</a><li><a class="more big" href="/3">3</a></ul></nav>'
        '<a data-x="y" href="/4">4</a><p><a data-x href="/p5">5</a><a rel="prev next" href="/p6">6</a><a href="/p7.html">7</a></p>'
    )
    df = spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string")
    rows = pages.page_links(df, selector=selector).orderBy("position").collect()
    assert "".join(r["text"] for r in rows) == found


@pytest.mark.parametrize("selector", ["", "a,", "> a", "a:hover", "a >", "a b[", "a..b", "a > > b"])
def test_selectors_that_are_none(spark, selector):
    with pytest.raises(ValueError):
        pages.page_links(spark.createDataFrame([], "page_id long, url string, html string"), selector=selector)


def test_page_extract_hands_the_markup_on(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string")
    assert [r["html"] for r in pages.page_extract(df).orderBy("page_id").collect()] == ["<p>x</p>", None]


def test_pages_of_a_batch_are_parsed_in_slices(spark, monkeypatch):
    """One batch of long pages gives many small ones, with the links alone where only they are asked for."""
    df = spark.createDataFrame([(1, "http://h/", "<a href='/x'>y</a>")], "page_id bigint, url string, html string")
    taken, plain = [], type(df).mapInArrow

    def held(self, function, schema, *args, **options):
        taken.append(function)
        return plain(self, function, schema, *args, **options)

    monkeypatch.setattr(type(df), "mapInArrow", held)
    html = ["<p>" + "word " * 100_000 + f"</p><a href='/{i}'>t</a>" for i in range(20)] + [None]
    batch = pa.record_batch([pa.array(range(21)), pa.array(["http://h/p"] * 21), pa.array(html)], ["page_id", "url", "html"])
    assert pages.page_links(df).count() == 1 and pages.page_text(df).count() == 1
    links, texts = (list(f(iter([batch]))) for f in taken)
    for made in (links, texts):
        assert len(made) > 4 and max(b.num_rows for b in made) <= 5
        assert [k for b in made for k in b.column(0).to_pylist()] == list(range(21))
    assert links[0].schema.names == ["page_id", "url", "links"]
    assert links[0].column(2)[2].as_py() == [{"position": 0, "url": "http://h/2", "text": "t"}]
    assert max(b.nbytes for b in links) < 10_000
