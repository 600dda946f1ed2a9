"""Operators on single texts against plain Python: secrets, main text, quality, BPE, repeats."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import oracle
import pytest
import tiktoken

from corpusmill.llm import bpe, maintext, quality, secretscan, substring
from corpusmill.llm.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, start int, block string, id string"
# Nulls, empty and blank texts, a repeated row, a null key, clashing column names.
ODD = [
    (1, None, 1, "a", "x"),
    (2, "", None, None, None),
    (3, " \n\t ", 1, "a", "x"),
    (4, "one", 1, "a", "x"),
    (4, "one", 1, "a", "x"),
    (None, "no key but a text of some words", 1, "a", "x"),
    (5, "long " * 30_000, 1, "a", "x"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_query_and_statement_is_registered():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert set(ORACLE) <= set(QUERIES)


# --------------------------------------------------------------------------- secrets


def base_spans(text):
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans_of_the_documents(spark, texts):
    for r in QUERIES["op3_secret_spans"](spark, FOLDER).collect():
        want = base_spans(texts[r.doc_id])
        told = ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == digest(told)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("PassWord: 'hunter22'", "assign"),
        ("secret=token \"abcdefgh\"", ""),
        ("api-key=abcdefgh", ""),
        ("AKIA" + "A1" * 8, "access"),
        ("AKIA" + "A1" * 7, ""),
        ("x" + "0123456789abcdef" * 2, "hex entropy"),
        ("key " + "aB3dE5fG7hJ9kL1mN2pQ4rS6", "entropy"),
        ("thtionhentingheandoverandover " * 3, ""),
        ("4111111111111111111111111", "hex"),
        ("123e4567-e89b-12d3-a456-426614174000", ""),
        ("----------------------------------------", ""),
        ("ſecret=abcdefgh", ""),
    ],
)
def test_secret_kinds(text, kinds):
    found = {secretscan.KINDS[k] for _, k, _ in secretscan.secret_spans(text)}
    assert found - {"entropy"} == set(kinds.split()) - {"entropy"}
    assert ("entropy" in found) == ("entropy" in kinds)


def test_entropy_windows_equal_a_count_of_each_window():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choices("aabbccdefghijklmn0123456789", k=rng.randrange(10, 90)))
        covered = set()
        for i in range(len(text) - 19):
            counts = collections.Counter(text[i : i + 20]).values()
            if -sum(c / 20 * np.log2(c / 20) for c in counts) >= 3.3 - 1e-9:
                covered |= set(range(i, i + 20))
        got = {i for a, b in secretscan.entropy_windows(text, 3.3) for i in range(a, b)}
        assert got == covered


@pytest.mark.parametrize(
    "text, spans",
    [
        ("key 000000000000000000000000a", [(4, 2, 29)]),
        ("0" * 40 + "a", [(0, 2, 41)]),
        ("A" * 60, []),
        ("=" * 38 + "Step2", []),
        ("a" + "-" * 10_000 + "1b", []),
        ("Ab-" * 10_000 + "1", []),
    ],
)
def test_long_runs_and_separators_end_at_once(text, spans):
    began = time.perf_counter()
    assert secretscan.secret_spans(text) == spans
    assert time.perf_counter() - began < 1


def test_secrets_in_an_image_of_a_megabyte(spark):
    image = "data:image/png;base64," + "A" * 30 + base64.b64encode(random.Random(5).randbytes(750_000)).decode()
    assert len(image) > 1_000_000
    rows = secretscan.find_secrets(spark.createDataFrame([(1, image), (2, "-" * 200 + "7x")], "doc_id long, text string")).collect()
    assert [r.n_hex for r in rows] == [0, 0] and rows[0].n_entropy > 0 and rows[1].spans == ""


def test_allow_list_takes_words_joined_by_separators():
    words = re.compile("|".join(f"(?:{rule.pattern})" for rule in secretscan.ALLOWED[1:2]))
    for n in range(7):
        for t in map("".join, itertools.product("Ab-", repeat=n)):
            want = all(re.fullmatch("[A-Z]?[a-z]*|[A-Z]+", part) for part in re.split("[-]+", t))
            assert bool(words.fullmatch(t)) == want, t


def test_secrets_in_odd_rows(spark):
    df = spark.createDataFrame([*ODD, (7, "é token=abcdef12 é", 1, "a", "x")], SCHEMA)
    rows = secretscan.find_secrets(df).collect()
    assert len(rows) == len(ODD) + 1 and sum(r.spans != "" for r in rows) == 1
    assert [r.spans for r in rows if r.doc_id == 7] == ["assign:2:16"]
    clean = secretscan.redact(df).collect()
    assert [tuple(r) for r in clean[:-1]] == ODD and clean[-1].text == "é [secret] é"
    assert secretscan.find_secrets(df.limit(0)).count() == 0


# ------------------------------------------------------------------------- main text

PAGE = """<html><head><title>t</title><style>p{}</style></head><body>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<article><header><h1>The &amp; title</h1></header><p>It is the story of a man who was in the house&nbsp;with
 the dog.<p>Short.<script>var a="</p><p>the of and";</script><div class="ad">Buy it now in the shop</div>
<p>And this is the end of it, for all that we know.</p></article>
<div id="comments"><p>I think that this is the best of all the things that I have read.</p></div>
<aside>Related of the and to</aside><footer>&copy; the site</footer>"""


def test_main_text_of_a_page():
    assert maintext.main_text(PAGE).split("\n") == [
        "The & title",
        "It is the story of a man who was in the house with the dog.",
        "Short.",
        "And this is the end of it, for all that we know.",
    ]


def test_main_text_without_article():
    good = "This is the text of the page and it is what the reader was looking for in the first place."
    links = "<p>" + " ".join(f"<a href=x>the link of it {i}</a>" for i in range(9)) + "</p>"
    page = f"<div>{links}<h2>Head</h2><p>{good}</p><p>So it was.</p><p>{good}</p>{links}<p>Tiny</p></div>"
    assert maintext.main_text(page).split("\n") == ["Head", good, "So it was.", good]


ENGLISH = "This is the text of the page and it is what the reader was looking for in the first place, as far as we know."
RUSSIAN = "Это текст страницы, который читатель хотел найти, и он достаточно длинный, чтобы считаться статьёй, а не меню."
CHINESE = "这是读者正在寻找的页面正文，它足够长，可以被视为一篇文章，而不是菜单或广告。作者在这里讲述了一个完整的故事。"


@pytest.mark.parametrize(
    "name",
    ["has-sidebar", "layout-with-sidebar", "no-comments", "two-col no-nav", "ad-free", "page search-results", "comments-open", "post", "search", "widget"],
)
@pytest.mark.parametrize("text", [ENGLISH, RUSSIAN, CHINESE])
def test_names_around_the_whole_page_do_not_empty_it(name, text):
    menu = "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in ("Home", "News", "Über uns")) + "</ul>"
    page = f'<body><div class="{name}"><div class="menu">{menu}</div><h1>Title</h1><p>{text}</p><p>{text}</p><div class="ad">{text}</div></div></body>'
    assert maintext.main_text(page) == "\n".join(["Title", text, text])


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "cookie-banner", "comments", "comment-list", "siteNav", "newsletter-box", "AdSlot"])
@pytest.mark.parametrize("text", [ENGLISH, RUSSIAN, CHINESE])
def test_named_elements_beside_the_article_are_left_out(name, text):
    """Even when they hold more text than the article."""
    page = f'<h1>Title</h1><p>{text}</p><div id="{name}">' + f"<p>{text}</p>" * 5 + "</div>"
    assert maintext.main_text(page) == "Title\n" + text


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE])
def test_languages_without_a_list_of_stop_words(text):
    short = text[:19].strip()
    links = "<p>" + " ".join(f"<a href=x>{text[:12]} {i}</a>" for i in range(9)) + "</p>"
    page = f"<div>{links}<h2>{text[:9]}</h2><p>{text}</p><p>{short}</p><p>{text}</p>{links}<p>{text[:5]}</p></div>"
    assert maintext.main_text(page).split("\n") == [text[:9], text, short, text]
    assert maintext.main_text(f"<article><p>{text}</p><p>{short}</p></article>") == f"{text}\n{short}"


@pytest.mark.parametrize(
    "page",
    ["<p>hi</p>" * 100_000, "<div>" * 100_000 + "x", "<div><p>" * 50_000 + "x", "<ul><li>a" * 50_000, "<li>a" * 100_000, "<a \"" * 50_001,
     "<p class='x>" * 50_001, "<a<b " * 100_000, "<div class=sidebar>x" * 50_000, "< " * 200_000, "&amp;" * 200_000, "<!--" * 100_000],
)
def test_time_is_in_step_with_the_page(page):
    began = time.perf_counter()
    maintext.main_text(page)
    assert time.perf_counter() - began < 8


def test_quotes_that_nothing_closes():
    assert maintext.main_text(f"<p class='x>{ENGLISH}</p><p>{ENGLISH}</p>") == f"{ENGLISH}\n{ENGLISH}"
    assert maintext.main_text(f'<p title="a > b">{ENGLISH}</p>') == ENGLISH
    assert maintext.main_text(f"<p>{ENGLISH} 1 < 2</p>") == f"{ENGLISH} 1 < 2"


@pytest.mark.parametrize("page", ["", "<", "<p", "&", "<article>", "</p></div>", "<!-- open", "<script>x", "<a b='c"])
def test_broken_pages_do_not_fail(page):
    maintext.main_text(page)


def test_main_text_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", PAGE, "x"), (2, "u", PAGE, "x")],
                               "page_id long, url string, html string, text string")
    rows = maintext.extract_main_text(df).collect()
    assert [r.n_chars for r in rows[:2]] == [0, 0] and rows[2] == rows[3]
    assert rows[2].n_chars == len(rows[2].text) > 50
    assert maintext.extract_main_text(df.limit(0)).count() == 0


def test_main_text_is_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in QUERIES["op2_main_text"](spark, FOLDER).collect():
        inside = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inside)]
        blocks = [" ".join(maintext.entities.unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b)


# ---------------------------------------------------------------------------- quality


def counted(text):
    words = re.findall(WORD, text)
    runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    twice = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(WORD, line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(twice)


def test_quality_counts(spark, texts):
    rows = QUERIES["op5_quality_rules"](spark, FOLDER).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == counted(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(good) > 0.95


def test_decision_list_finds_two_reasons_and_spares_the_rest():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.9) | ((x[:, 4] > 0.8) & (x[:, 6] < 0.3))
    rules = quality.learn_list(x, bad)
    got = np.zeros(len(x), dtype=bool)
    for tests in rules:
        got |= quality._passes(x, tests)
    assert len(rules) >= 2 and (got & bad).sum() > 0.9 * bad.sum() and (got & ~bad).mean() < 0.01
    assert rules == quality.learn_list(x, bad) and quality.learn_list(x[:5], bad[:5]) == []


def test_rules_as_spark_expressions(spark):
    rules = [[(0, True, 5.0), (2, False, 0.5)], [(1, True, 3.0)]]
    df = spark.createDataFrame([(9, 9, 0), (2, 20, 0), (2, 2, 0), (9, 9, 9)], "n_words long, word_chars long, n_symbols long")
    got = df.select(quality.rule_expression(rules).alias("r")).collect()
    assert [r.r for r in got] == [1, 2, 0, 0]


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(1, None), (None, 0), (4, 1), (4, 0)], "doc_id long, quality int")
    rows = quality.judge(df, labels).collect()
    assert len(rows) == len(ODD) and [r.n_words for r in rows] == [0, 0, 0, 1, 1, 8, 30_000]
    assert not any(r.kept for r in rows)
    assert quality.judge(df.limit(0), labels.limit(0)).count() == 0
    assert quality.keep_good(df, labels).columns == df.columns


# -------------------------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def reference():
    tokens, pattern = bpe.public_vocabulary()
    ranks = {t: i for i, t in enumerate(tokens)}
    return tokens, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_the_library_on_random_texts(reference):
    tokens, pattern, library = reference
    rng = random.Random(7)
    letters = "aaab  \n\t\x1c\x85\xa0   éßñ中文🙂1234''s'll==--!!??thinerABC​؀"
    cases = ["".join(rng.choices(letters, k=rng.randrange(0, 200))) for _ in range(800)]
    cases += ["".join(rng.choice(tokens).decode("utf8", "ignore").strip() for _ in range(6)) for _ in range(4000)]
    cases += ["", "a" * 5000, " " * 3000, "ab" * 2000, "=" * 999, "\0\0", "<|endoftext|>"]
    for text, ids in zip(cases, bpe.Replay(tokens, pattern).encode(cases)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)


def test_bpe_round_trip_of_the_documents(spark, texts, reference):
    for r in QUERIES["op6_bpe_round_trip"](spark, FOLDER).collect():
        ids = reference[2].encode_ordinary(texts[r.doc_id])
        packed = np.array(ids, dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == digest(texts[r.doc_id])


def test_bpe_of_odd_rows(spark, reference):
    df = spark.createDataFrame(ODD, SCHEMA)
    tokens, pattern, _ = reference
    back = bpe.decode(bpe.encode(df, tokens, pattern), tokens).collect()
    assert [bytes(r.text_bytes).decode() for r in back] == [t[1] or "" for t in ODD]
    assert bpe.round_trip(df.limit(0), tokens, pattern).count() == 0


# ---------------------------------------------------------------------------- repeats


def removed(docs):
    """Kept words per row, by all windows of all texts."""
    words = [re.findall(WORD, t or "") for _, t in docs]
    first = {}
    for (key, _), ws in zip(docs, words):
        for i in range(len(ws) - 12):
            run = tuple(ws[i : i + 13])
            if key is not None:
                first[run] = min(first.get(run, key), key)
    kept = []
    for (key, _), ws in zip(docs, words):
        gone = set()
        for i in range(len(ws) - 12):
            if key is not None and first[tuple(ws[i : i + 13])] < key:
                gone |= set(range(i, i + 13))
        kept.append(" ".join(w for i, w in enumerate(ws) if i not in gone))
    return kept


def test_repeats_of_random_texts(spark):
    rng = random.Random(5)
    passages = [[f"p{i}w{rng.randrange(6)}" for _ in range(rng.randrange(10, 60))] for i in range(12)]
    docs = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a:] if rng.random() < 0.6 else [f"u{rng.randrange(50)}" for _ in range(20)]
        docs.append((i, " ".join(words)))
    docs += [(None, docs[3][1]), (7, docs[7][1]), (200, None), (201, ""), (202, "a " * 2000), (203, "a " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.kept) for r in substring.remove_repeats(df).collect())
    assert got == collections.Counter((k, t) for (k, _), t in zip(docs, removed(docs)))


def test_factors_cover_what_goes(spark):
    a = [f"a{i}" for i in range(40)]
    b = [f"b{i}" for i in range(40)]
    docs = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["x", *a[5:30], *b[10:40], "y"])), (4, " ".join(a))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert [tuple(f) for f in got[3].factors] == [(1, 26, 1), (26, 56, 2)] and got[3].kept == "x y"
    assert [tuple(f) for f in got[4].factors] == [(0, 40, 1)] and got[1].factors == []


def test_repeats_in_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = substring.remove_repeats(df).collect()
    assert len(rows) == len(ODD) and all(r.n_removed == 0 for r in rows)
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_windows_of_every_short_length():
    for n in range(15):
        found = substring.Windows([" ".join(f"w{i}" for i in range(n)).encode()], 13)
        assert len(found.run) == len(found.block) == len(found.owner) == max(n - 12, 0)
        assert found.start.tolist() == list(range(max(n - 12, 0)))


def test_repeats_in_a_table_of_ten_words(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string").coalesce(1)
    assert [(r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()] == [(10, 0)]


def test_repeats_as_sql_says(spark):
    query = "op1_rlz_spans"
    assert oracle.difference(QUERIES[query](spark, FOLDER), oracle.connect(FOLDER), ORACLE[query]) is None
