"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic examples carry a label. Everything else is unlabelled text, of which a known
share, the class prior, is toxic too. The risk of the negative class is that of the unlabelled
text less the part its toxic share explains, and it is kept from falling below zero, so that a
flexible model cannot drive it there by fitting the positives.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.base import query, slices, sql_type, table
from corpusmill.llm.terms import split_terms
from corpusmill.settings import cut_lineage, join_small

# Rows whose levels the driver fits on, about so many of each; all other passes, the document
# frequencies too, cover every row.
POSITIVES = 5_000
UNLABELLED = 20_000
FEATURES = 4_096
# A word or stem must be in so many positives to become a feature,
LEAST_POSITIVES = 3
# and so much more frequent there (likelihood ratio) that chance does not do it, though millions
# are tried.
LEAST_EVIDENCE = 16.0
# Stems are the first letters of words: insults come with many endings.
STEMS = (4, 5, 6, 7)
WIDTH = 1 + len(STEMS)
# A feature enters by how often it is in a text and by its share of the words.
COUNTS = (1, 2, 4)
SHARES = (1 / 100, 1 / 30)
LEVELS = len(COUNTS) + len(SHARES)
STEPS = 400
RATE = 0.05
SHRINK = 1e-4
CUT = 0.3
MEMORY_WORDS = 300_000


def _hash(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode(), digest_size=8).digest(), "little") | 1


class Lexicon(dict):
    """Row number of each word seen; ``table[row]`` has the hashes of the word and of its stems.

    A missing stem is 0. With ``chosen`` (sorted hashes) the table holds places in it instead, and
    -1 for hashes that are not chosen.
    """

    def __init__(self, chosen: np.ndarray | None = None):
        super().__init__()
        self.chosen = chosen
        self.table = np.zeros((0, WIDTH), dtype=np.uint64 if chosen is None else np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self)
        return row

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all words, and how many words each text has."""
        if len(self) > MEMORY_WORDS:
            self.clear()
            self.table = self.table[:0]
        before = len(self)
        # ASCII letters and digits, and all other characters, make words.
        words, counts = split_terms([t.lower().encode() for t in texts])
        coded = words.dictionary_encode()
        distinct = np.fromiter(map(self.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        at = distinct[np.asarray(coded.indices)]
        fresh = np.zeros((len(self) - before, WIDTH), dtype=np.uint64)
        for i, word in enumerate(itertools.islice(self, before, None)):
            text = word.decode("utf-8", "replace")
            fresh[i, 0] = _hash(text)
            for j, length in enumerate(STEMS, 1):
                if len(text) >= length:
                    fresh[i, j] = _hash("^" + text[:length])
        if self.chosen is not None:
            spot = np.minimum(np.searchsorted(self.chosen, fresh), max(len(self.chosen) - 1, 0))
            fresh = np.where(self.chosen[spot] == fresh, spot, -1) if len(self.chosen) else np.full(fresh.shape, -1)
        self.table = np.concatenate([self.table, fresh.astype(self.table.dtype)])
        return at, counts


@dataclass
class Model:
    """``chosen``: sorted hashes of words and stems; ``weights``: one row of levels for each."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float


def present(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """``(text, column)`` of all levels that hold, for chosen features only."""
    at, counts = lexicon.rows(texts)
    places = lexicon.table[at]
    owner = np.repeat(np.arange(len(texts)), counts)[:, None] + np.zeros(WIDTH, dtype=np.int64)
    keep = places >= 0
    pairs, often = np.unique(owner[keep] * (FEATURES + 1) + places[keep], return_counts=True)
    text, place = pairs // (FEATURES + 1), pairs % (FEATURES + 1)
    share = often / np.maximum(counts[text], 1)
    holds = [often >= c for c in COUNTS] + [share >= s for s in SHARES]
    return (
        np.concatenate([text[h] for h in holds]),
        np.concatenate([place[h] * LEVELS + level for level, h in enumerate(holds)]),
    )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(
    positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], d: int, prior: float
) -> tuple[np.ndarray, float]:
    """Weights of ``d`` columns and bias: full-batch Adam on the non-negative risk, logistic loss.

    Both sides are ``(row, column, number of rows)``. While the estimated negative risk is below
    zero, a step raises it instead of lowering the total.
    """
    (pr, pc, n_p), (ur, uc, n_u) = positive, unlabelled
    w = np.append(np.zeros(d), np.log(prior / (1 - prior)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)

    def slope(g: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, weights=g[rows], minlength=d), g.sum())

    for step in range(1, STEPS + 1):
        z_p = w[-1] + np.bincount(pr, weights=w[pc], minlength=n_p)
        z_u = w[-1] + np.bincount(ur, weights=w[uc], minlength=n_u)
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        of_negative = slope(_sigmoid(z_u) / n_u, ur, uc) - prior * slope(_sigmoid(z_p) / n_p, pr, pc)
        if negative >= 0:
            g = prior * slope((_sigmoid(z_p) - 1) / n_p, pr, pc) + of_negative
        else:
            g = -of_negative
        g[:-1] += SHRINK * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # The level at which the mean probability of unlabelled text is the prior.
    z_u = np.bincount(ur, weights=w[uc], minlength=n_u)
    low, high = -35.0, 35.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(z_u + middle).mean() < prior else (low, middle)
    return w[:-1], low


def held_out(key: Column) -> Column:
    """Rows whose labels are never used: crc32 of the key as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _below(key: Column, seed: int, share: float) -> Column:
    """A share of the keys, the same in every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < F.lit(min(int(share * (1 << 40)), 1 << 40))


def _frequency(rows: DataFrame) -> DataFrame:
    """``(hash, inside, among)``: in how many positives and in how many texts each hash is.

    ``rows`` holds ``text, positive``. A task hands over each hash of a slice once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for part, texts in slices(batches, 0):
            at, counts = lexicon.rows(texts)
            own = [np.unique(h) for h in np.split(lexicon.table[at], np.cumsum(counts)[:-1])]
            positive = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), [len(h) for h in own])
            hashes, place = np.unique(np.concatenate(own), return_inverse=True)
            among = np.bincount(place, minlength=len(hashes))
            inside = np.bincount(place[positive], minlength=len(hashes))
            keep = hashes > 0
            yield pa.record_batch(
                [pa.array(hashes[keep].view(np.int64)), pa.array(inside[keep]), pa.array(among[keep])],
                ["hash", "inside", "among"],
            )

    counted = rows.select("text", "positive").mapInArrow(work, "hash bigint, inside bigint, among bigint")
    return counted.groupBy("hash").agg(F.sum("inside").alias("inside"), F.sum("among").alias("among"))


def choose(counted: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The hashes that are far more frequent among positives than in unlabelled text.

    ``FEATURES`` at most are collected, those of the strongest evidence.
    """
    a = F.col("inside").cast("double")
    inner = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    found = counted.where(F.col("inside") >= LEAST_POSITIVES).select(
        "hash", a.alias("a"), inner(a / F.lit(float(n_p))).alias("own"), inner((F.col("among") + 0.5) / F.lit(n_u + 1.0)).alias("share")
    )
    ratio = 2 * (F.col("a") * F.log(F.col("own") / F.col("share")) + (n_p - F.col("a")) * F.log((1 - F.col("own")) / (1 - F.col("share"))))
    found = found.where("own > share").select("hash", ratio.alias("evidence")).where(F.col("evidence") >= LEAST_EVIDENCE)
    best = found.orderBy(F.desc("evidence"), "hash").limit(FEATURES).toPandas()
    return np.sort(best["hash"].to_numpy(np.int64).view(np.uint64))


def _matrix(rows: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Levels that hold in each text of a bounded sample, gathered on the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(chosen)
        for _, texts in slices(batches, 0):
            text, column = present(texts, lexicon)
            order = np.lexsort((column, text))
            parts = np.split(column[order], np.searchsorted(text[order], np.arange(1, len(texts))))
            yield pa.record_batch([pa.array([p.tobytes() for p in parts], pa.binary())], ["columns"])

    cells = sorted(rows.select("text").mapInArrow(work, "columns binary").toPandas()["columns"])
    columns = [np.frombuffer(c, dtype=np.int64) for c in cells]
    flat = np.concatenate([np.zeros(0, np.int64), *columns])
    return np.repeat(np.arange(len(columns)), [len(c) for c in columns]), flat, len(columns)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model:
    """Fit on labelled positives outside the held-out fold and on unlabelled text outside it.

    The class prior is the share of positives among the labelled rows outside the fold. Rows
    without key or label are left out; of several labels of a key the largest counts. Without
    positives the model is the prior alone.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(key).agg(F.max(label).alias("__label"))
    rows, toxic = known.agg(F.count(F.lit(1)), F.sum((F.col("__label") == 1).cast("long"))).first()
    nothing = Model(np.zeros(0, np.uint64), np.zeros((0, LEVELS)), -4.0)
    if not toxic:
        return nothing
    prior = min(max(toxic / rows, 1e-6), 1 - 1e-6)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    texts = texts.where(F.col("key").isNotNull() & ~held_out(F.col("key")))
    # Document frequencies cover every positive and every unlabelled text.
    named = known.where(F.col("__label") == 1).select(F.col(key).alias("key"), F.lit(True).alias("__positive"))
    marked = join_small(texts, named, "key", "left")
    marked = marked.select("key", "text", F.coalesce("__positive", F.lit(False)).alias("positive"))
    n_u, n_p = marked.agg(F.count(F.lit(1)), F.sum(F.col("positive").cast("long"))).first()
    if not n_p or not n_u:
        return nothing
    hashes = choose(_frequency(marked), n_p, n_u)
    # The fit itself, which runs on the driver, takes bounded samples.
    positive = cut_lineage(marked.where(F.col("positive") & _below(F.col("key"), 1, POSITIVES / toxic)))
    unlabelled = cut_lineage(texts.where(_below(F.col("key"), 2, UNLABELLED / n_u)))
    if positive.isEmpty() or unlabelled.isEmpty():
        return nothing
    weights, bias = train(_matrix(positive, hashes), _matrix(unlabelled, hashes), len(hashes) * LEVELS, prior)
    return Model(hashes, weights.reshape(-1, LEVELS), bias)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` per row of ``docs``; whole texts, and nothing but the text, are scored.

    Null and empty texts get the score of no words. Repeated rows and null keys stay. The model
    holds ``FEATURES`` words and stems at most and travels with the tasks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, flat = Lexicon(model.chosen), model.weights.ravel()
        for part, texts in slices(batches, 1):
            rows, columns = present(texts, lexicon)
            z = model.bias + np.bincount(rows, weights=flat[columns], minlength=len(texts))
            yield pa.record_batch([part.column(0), pa.array(_sigmoid(z), pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(work, f"`{key}` {sql_type(docs, key)}, score double")


@query("op7_toxicity")
def _op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score(docs, fit(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
