"""Ranked lexical search against scores of all documents in plain Python."""

import collections
import math
import random
import re

import oracle
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import lexical
from corpusmill.llm.catalog import ORACLE, QUERIES
from corpusmill.llm.scratch import Scratch

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").encode().translate(LOWER))


def scores(docs, items):
    """``{item: [(score, key), ...]}`` of all documents with a score above 0, best first."""
    counts = [(k, collections.Counter(terms(t))) for k, t in docs]
    documents = sum(bool(c) for _, c in counts)
    length = sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = {}
    for item, words in asked.items():
        found = []
        for k, c in counts:
            n, score = c.total(), 0
            for t in words & set(c):
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * n * documents) // length
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0 and k is not None:
                found.append((score, k))
        out[item] = sorted(found, key=lambda x: (-x[0], x[1]))
    return out


def best(docs, items, top=50):
    found = scores(docs, items)
    return sorted((i, r, k, s) for i, rows in found.items() if i is not None for r, (s, k) in enumerate(rows[:top], 1))


def frames(spark, docs, items):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, rank int, term string")
    return df.repartition(3), spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, score int")


def told(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_search_of_the_benchmark(spark, folder):
    df = QUERIES["op12_lexical_search"](spark, folder)
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert told(df) == best(docs, items)
    assert oracle.difference(df, oracle.connect(folder), ORACLE["op12_lexical_search"]) is None


def zipf(seed, n, words=300):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(f"w{x}" for x in rng.choices(range(words), weights, k=rng.randrange(3, 60)))) for i in range(n)]


def test_search_ends_before_all_is_read(spark, monkeypatch):
    """Rounds with small reads close items early, and every interval holds the exact score."""
    docs = zipf(1, 1500) + [(5000 + i, "rare1 rare2 rare3 w5 w9") for i in range(5)]
    items = [(1, "rare1 rare2 rare3 w0 w1 w2"), (2, "w5 w9 w200 w250 w299"), (3, "w0 w1"), (4, "w280 w290 w295 w0")]
    exact = {i: {k: s for s, k in rows} for i, rows in scores(docs, items).items()}
    rounds, rows = [], []
    plain, listed = lexical._round, lexical.document_terms

    def kept(*args):
        df = listed(*args)
        rows.extend(df.select("row", "key").collect())
        return df

    def watched(scratch, postings, asked, lists, depths, still, reads, top):
        state, ends = plain(scratch, postings, asked, lists, depths, still, reads, top)
        keys = dict(rows)
        for r in state.collect():
            assert r.lower <= exact[r.item][keys[r.row]] <= r.upper
        seen = {(r.item, keys[r.row]) for r in state.collect()}
        for r in ends.collect():
            kth = sorted(exact[r.item].values(), reverse=True)
            assert r.least <= (kth[top - 1] if len(kth) >= top else 0)
            for k, s in exact[r.item].items():
                # Nothing that can still win is lost.
                assert (r.item, k) in seen or s <= r.bound or s < r.least
        rounds.append({r.item: r.bound for r in ends.collect()})
        return state, ends

    monkeypatch.setattr(lexical, "_round", watched)
    monkeypatch.setattr(lexical, "document_terms", kept)
    df, asked = frames(spark, docs, items)
    assert told(lexical.search(df, asked, top=5, first_read=20)) == best(docs, items, 5)
    assert len(rounds) > 1 and set(rounds[0]) == {1, 2, 3, 4}
    # The rare terms decide the first item while its frequent lists are unread.
    assert min(r[1] for r in rounds if 1 in r) > 0


def test_ties_by_key_and_copies(spark):
    docs = [(i, "alpha beta gamma") for i in range(300)] + [(1000 + i, "alpha filler text " * 3) for i in range(200)]
    docs += [(2000 + i, f"other{i} words") for i in range(600)]
    items = [(1, "alpha beta"), (2, "gamma"), (3, "nothing here"), (4, "alpha alpha ALPHA")]
    df, asked = frames(spark, docs, items)
    got = told(lexical.search(df, asked, first_read=10))
    assert got == best(docs, items)
    assert [r[2] for r in got if r[0] == 1] == list(range(50))


def test_odd_documents_and_items(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "one TWO é"), (4, "one TWO é"), (None, "one two three"), (5, "one " * 40_000)]
    docs += [(6, "É é ÀÉ"), (7, "x" * 50_000), (8, "a_b-c\x00d")] + [(10 + i, "common") for i in range(9)]
    items = [(1, "One é"), (1, "three"), (1, "One é"), (2, None), (3, ""), (None, "one"), (4, "x" * 50_000), (5, "b D common"), (6, "!!")]
    df, asked = frames(spark, docs, items)
    want = best(docs, items)
    assert told(lexical.search(df, asked)) == want
    assert told(lexical.search(df, asked, top=2, first_read=1)) == best(docs, items, 2)
    assert lexical.search(df.limit(0), asked).count() == 0
    assert lexical.search(df, asked.limit(0)).count() == 0
    assert lexical.search(df.where("text IS NULL"), asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_vocabulary_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(lexical, "VOCABULARY_BYTES", 10)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 3)
    monkeypatch.setattr("corpusmill.settings.BROADCAST_ROWS", 3)
    docs, items = zipf(2, 300, 60), zipf(3, 8, 60)
    df, asked = frames(spark, docs, items)
    assert told(lexical.search(df, asked, top=7, first_read=30)) == best(docs, items, 7)


def test_levels_are_read_in_the_order_of_their_worth(spark):
    levels = [("rare", 40, 1, 9000), ("rare", 39, 2, 8000), ("often", 30, 10, 4000), ("often", 29, 5000, 3900), ("often", 20, 10, 5)]
    with Scratch(spark, "test") as scratch:
        steps = scratch.store(lexical._steps(spark.createDataFrame(levels, "term string, level int, n long, top long")))
        rows = {(r.term, r.level): r.step for r in steps.collect()}
        lists = lexical._lists(steps)
        asked = spark.createDataFrame([(1, "rare"), (1, "often")], "item long, term string")
        depths = lexical._depths(asked, lists).orderBy(F.desc("step")).collect()
    assert rows["rare", 39] > rows["often", 30] >= rows["often", 29] >= rows["often", 20]
    assert depths[-1].bound == 0 and depths[-1].reads == 5023
    assert [d.bound for d in depths] == sorted((d.bound for d in depths), reverse=True)
