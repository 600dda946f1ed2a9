import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import answers, text


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_whitespace_is_unicode(spark):
    got = column(spark, ["\t a  b \n", " x\x1c", "", None], text.collapse_ws)
    assert got == ["a b", "x", "", None]


def test_normalize_text(spark):
    got = column(spark, ["  Été, 2x!! ", "A--b", "…", None], text.normalize_text)
    assert got == ["été 2x", "a b", "", None]
    kept = column(spark, ["x + y = 2", "x - y = 2"], lambda c: text.normalize_text(c, keep_math=True))
    assert kept == ["x + y = 2", "x - y = 2"]


def test_word_count_and_tokens(spark):
    assert column(spark, ["a  b\tc", "", None], text.word_count) == [3, 0, 0]
    assert column(spark, ["Ab-c1 é", "é", None], text.tokens) == [["ab", "c1"], [], None]


def test_clip_text(spark):
    values = [" short ", "x" * 12, "abcdef  ghij", "   ", None]
    assert column(spark, values, lambda c: text.clip_text(c, 10)) == [
        "short",
        "xxxxxxx...",
        "abcdef...",
        None,
        None,
    ]


def test_looks_numeric(spark):
    values = [" 1 ", "-2.5e3", ".5", "5.", "inf", "NaN", "1 2", "x", "", None]
    assert column(spark, values, text.looks_numeric) == [True] * 6 + [False] * 4


def test_fenced_block(spark):
    values = ['a ```json\n{"a":1}\n``` b ```x```', "``` y ```", "none", None]
    assert column(spark, values, text.fenced_block) == ['{"a":1}', "y", None, None]


@pytest.mark.parametrize(
    ("raw", "plain", "with_field"),
    [
        ('{"a": 1}', '{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}', '{"a": 1}'),
        ('It is "so": {"a": "}"} end', '{"a": "}"}', '{"a": "}"}'),
        ('Reason {x} first: {"a": 1}', None, '{"code":"Reason {x} first: {\\"a\\": 1}"}'),
        ("[1, 2]", None, '{"code":"[1, 2]"}'),
        ("```python\nprint(1)\n```", None, '{"code":"print(1)"}'),
        ("  ", None, None),
        (None, None, None),
    ],
)
def test_extract_json(spark, raw, plain, with_field):
    assert column(spark, [raw], text.extract_json) == [plain]
    assert column(spark, [raw], lambda c: text.extract_json(c, "code")) == [with_field]


def test_stable_json_ignores_key_order(spark):
    cells = spark.sql("SELECT map('b', 1, 'a', 2) AS m UNION ALL SELECT map('a', 2, 'b', 1)")
    got = cells.select(text.stable_json(F.col("m"), cells.schema["m"].dataType).alias("j")).collect()
    assert {r["j"] for r in got} == {'{"a":2,"b":1}'}
    texts = column(spark, ['{"b": "x", "a": null}', '{"a":null,"b":"x"}', "no"], text.stable_json_text)
    assert texts[0] == texts[1] == '{"a":null,"b":"x"}' and texts[2] == "no"


def test_url_functions(spark):
    assert column(spark, ["http://a.b:80/c?d", "mailto:x@y", None], text.url_host) == ["a.b:80", None, None]
    got = column(spark, ["../y", "http://z/", "#t"], lambda c: text.absolute_url(F.lit("http://a/x/p"), c))
    assert got == ["http://a/y", "http://z/", "http://a/x/p#t"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('{"label": true}', "True"),
        ('{"label": "true"}', "true"),
        ('{"label": "", "answer": "7"}', "7"),
        ('{"label": null, "final_label": 3.0}', "3.0"),
        ('```\n{"label":" a  b "}\n```', "a  b"),
        ('{"label": "answer: x"}', "x"),
        ('{"label": "x"} trailing', None),
        (r"x \boxed{4} y \boxed{5}", "4"),
        ("Answer: 7\nfinal answer = 9 ", "9"),
        ("cannot determine", "invalid"),
        ("Answer: cannot determine", "invalid"),
        (r"\boxed{2} is invalid", "2"),
        ("Answer: ...", None),
        ("Answer: …", None),
        (r"Answer: \boxed{ 8 }", "8"),
        ("[1]", None),
        ("null", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_answer(spark, raw, expected):
    assert column(spark, [raw], answers.parse_answer) == [expected]


def test_normalize_answer(spark):
    values = [" None ", "NULL", "nan", "", " a \n b ", None]
    assert column(spark, values, answers.normalize_answer) == [None] * 4 + ["a b", None]
    assert column(spark, [True, False, None], lambda c: answers.normalize_label(c, True), "boolean") == [
        "true",
        "false",
        None,
    ]


def restarted(source, opener, closer):
    """The first balanced slice, searched anew from every opener."""
    mark = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}\[\]]', re.DOTALL)
    for at in [i for i, c in enumerate(source) if c == opener]:
        level = 0
        for m in mark.finditer(source, at):
            level += (m.group() == opener) - (m.group() == closer)
            if m.group() == closer and level == 0:
                return source[at : m.end()]
    return None


def test_balanced_slice_equals_a_search_from_every_opener():
    rng = random.Random(4)
    for _ in range(20_000):
        source = "".join(rng.choices('{}[]"\\a', weights=[4, 4, 1, 1, 3, 2, 2], k=rng.randrange(1, 24)))
        # A quote that a lone last backslash leaves open is read as a string here.
        source = source.rstrip("\\")
        for opener, closer in ("{}", "[]"):
            assert text._balanced(source, opener, closer) == restarted(source, opener, closer), source


@pytest.mark.parametrize("source", ["{" * 100_000, '{"' * 100_000, '{"\\"' * 100_000, "{" * 100_000 + "}" * 99_999, '"{' * 99_999])
def test_many_openers_take_one_pass(source):
    began = time.perf_counter()
    text._balanced(source, "{", "}")
    assert time.perf_counter() - began < 1
