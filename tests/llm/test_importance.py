"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import importance
from corpusmill.llm.catalog import QUERIES
from corpusmill.llm.scratch import Scratch, numbered

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def features(text, low=1, high=1):
    w = words(text)
    return [b" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1)]


def drawn(docs, target, low=1, high=1, buckets=10_000, least=20, percent=10, seed=2024):
    """Rows ``(key, n_features, weight, score, rank)`` of the contract."""
    place = lambda f: zlib.crc32(f) % buckets
    s = collections.Counter(place(f) for _, t in docs for f in features(t, low, high))
    t = collections.Counter(place(f) for x in target for f in features(x, low, high))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        found = features(text, low, high)
        weight = sum(gain[place(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(found), weight, score, None, len(words(text)) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_crc_of_spans_of_any_length():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(40_000), dtype=np.uint8)
    lengths = [0, 1, 2, 3, 4, 5, 63, 64, 65, 127, 128, 129, 191, 192, 193, 1000, 20_000]
    starts = np.array([rng.randrange(20_000) for _ in range(300)])
    sizes = np.array([lengths[i % len(lengths)] for i in range(300)])
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
    assert importance.crc32_spans(data, starts, sizes).tolist() == want
    none = np.zeros(0, dtype=np.int64)
    assert len(importance.crc32_spans(data, none, none)) == 0


@pytest.mark.parametrize("low, high", [(1, 1), (1, 3), (2, 2)])
def test_buckets_of_runs_stay_inside_their_text(low, high):
    texts = ["", "Ab cd,EF", "é ÀÉ x", "...", "one", "word " * 30, "x" * 500 + " y", "\x00\x7f{}[]`@/:"]
    found, owners, counts = importance.feature_buckets([t.encode() for t in texts], (low, high), 997)
    for i, text in enumerate(texts):
        want = sorted(zlib.crc32(f) % 997 for f in features(text, low, high))
        assert sorted(found[owners == i].tolist()) == want
        assert counts[i] == len(words(text))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_draw_of_the_documents(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    df = QUERIES["op13_importance_draw"](spark, folder)
    assert df.dtypes == [("doc_id", "bigint")] + [(c, "bigint") for c in ("n_features", "weight", "score", "rank")]
    assert told(df) == drawn(docs, target)


def test_draw_with_longer_runs_and_other_parameters(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("ab cd éf Gh ij12".split(), k=rng.randrange(40)))) for i in range(150)]
    target = [t for _, t in docs[:5]]
    df = importance.resample(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(t,) for t in target], "text string"),
        lengths=(1, 3), buckets=50, least_words=5, percent=50, seed=7,
    )
    assert told(df) == drawn(docs, target, 1, 3, 50, 5, 50, 7)


def test_draw_of_odd_rows(spark):
    """Nulls, blanks, repeated rows, no key, one long word, a hot text, clashing names."""
    hot = "the same words again and again " * 8
    docs = [(1, None), (2, ""), (3, " \n"), (4, hot), (4, hot), (4, hot), (None, hot), (None, hot), (5, "w" * 70_000)]
    docs += [(5, "x" + " long" * 40_000), (6, "short text")] + [(100 + i, hot) for i in range(60)]
    rows = [(k, t, 1, 2.0, "a") for k, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, weight double, bucket string")
    target = spark.createDataFrame([(None, 1), ("the same words", 2), ("the same words", 2)], "text string, n int")
    want = drawn(docs, [None, "the same words", "the same words"], percent=60)
    assert told(importance.resample(df, target, percent=60)) == want
    assert sum(r[4] is not None for r in want) == 60 * 66 // 100
    assert told(importance.resample(df, target.limit(0))) == drawn(docs, [])
    assert importance.resample(df.limit(0), target).count() == 0
    assert told(importance.resample(df, target, percent=0)) == drawn(docs, [None, "the same words", "the same words"], percent=0)


def test_numbers_follow_the_order_over_many_partitions(spark):
    with Scratch(spark, "test") as scratch:
        df = spark.range(1000).selectExpr("id * 7919 % 1000 AS k").repartition(13)
        rows = numbered(scratch, df, ["k"], "place").collect()
    assert all(r.place == r.k + 1 for r in rows) and len(rows) == 1000
