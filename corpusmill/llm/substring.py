"""Removal of word runs that earlier documents contain, by a join of windows.

The reference is the corpus itself, indexed by blocks that its content defines: in every 13-word
window the 5-word run of the smallest hash is the window's block, so equal windows have equal
blocks. Blocks of more than one document are the index, and an exact hash join of the
windows finds every repeated one, also across pieces of several documents. Factors are grouped
afterwards: following windows with the same earliest document are one. There is no greedy parse
with longest match or reference position, so a factor need not stand there as one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.base import hashed_words, mixed, query, settled, slices, sql_type, table

WINDOW_WORDS = 13
BLOCK_WORDS = 5

_C = np.uint64(0x9E3779B97F4A7C15)

def _runs(words: np.ndarray, span: int) -> np.ndarray:
    """A hash for every run of ``span`` words."""
    count = len(words) - span + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    runs = np.zeros(count, dtype=np.uint64)
    for step in range(span):
        runs = runs * _C + words[step : step + count]
    return mixed(runs)

class Windows:
    """Windows of a slice of texts: hash, owner and block of each, in order."""

    def __init__(self, texts: list[bytes], window: int):
        flat, self.counts = hashed_words(texts)
        runs = _runs(flat, window)
        owner = np.repeat(np.arange(len(texts)), self.counts)
        inside = np.flatnonzero(owner[: len(runs)] == owner[len(owner) - len(runs) :])
        blocks = _runs(flat, BLOCK_WORDS)
        # The smallest block hash of each window, by doubling the width.
        width, least = 1, blocks
        wanted = window - BLOCK_WORDS + 1
        while width < wanted:
            step = min(width, wanted - width)
            # Fewer words than a window leave fewer blocks than a step.
            least = np.minimum(least[: max(len(least) - step, 0)], least[step:])
            width += step
        self.run, self.owner, self.block = runs[inside], owner[inside], least[inside] if len(inside) else runs[inside]
        # Number of the window's first word in its text.
        self.start = inside - np.append(0, np.cumsum(self.counts))[:-1][self.owner]

def _distinct(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs; owners ascend already."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new]

def _blocks(docs: DataFrame, kind: str, window: int) -> DataFrame:
    """``(block, id)``, once per row and block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1, as_bytes=True):
            found = Windows(texts, window)
            owner, block = _distinct(found.owner, found.block)
            yield pa.record_batch(
                [pa.array(block.view(np.int64)), part.column(0).take(pa.array(owner))], ["block", "id"]
            )

    return docs.mapInArrow(work, f"block bigint, id {kind}")

def _candidates(listed: DataFrame, kind: str, window: int) -> DataFrame:
    """``(run, id)`` of windows whose block is in the list of their document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1, as_bytes=True):
            found = Windows(texts, window)
            lists = part.column(2)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            index = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            # A document is asked for the blocks of its own list.
            listed = mixed(index + mixed(np.repeat(np.arange(len(counts), dtype=np.uint64), counts)))
            known = np.isin(mixed(found.block + mixed(found.owner.astype(np.uint64))), listed)
            owner, run = _distinct(found.owner[known], found.run[known])
            yield pa.record_batch(
                [pa.array(run.view(np.int64)), part.column(0).take(pa.array(owner))], ["run", "id"]
            )

    return listed.mapInArrow(work, f"run bigint, id {kind}")

def factor(start: np.ndarray, reference: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Factors ``(first word, end, index of the reference)`` from the repeated windows of a text.

    ``start`` ascends; ``reference`` numbers the earliest document of each window.
    """
    if not len(start):
        return []
    new = np.ones(len(start), dtype=bool)
    new[1:] = (np.diff(start) != 1) | (np.diff(reference) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return list(zip(start[first].tolist(), (start[last] + window).tolist(), first.tolist()))

def repeated_windows(docs: DataFrame, key: str, text: str, window: int = WINDOW_WORDS) -> DataFrame:
    """``(id, runs, firsts)`` per key with a window that a smaller key's text holds too.

    Two texts of one key are not earlier than each other. A document's own lists are all that is
    gathered; windows and blocks of many documents are folded on the map side.
    """
    kind = sql_type(docs, key)
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    texts = texts.where("id IS NOT NULL AND text IS NOT NULL")
    blocks = _blocks(texts, kind, window)
    index = settled(
        blocks.groupBy("block")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .where("low < high")
        .select("block"),
        wait=True,
    )
    lists = settled(blocks.join(index, "block").groupBy("id").agg(F.collect_set("block").alias("list")), wait=True)
    windows = _candidates(texts.join(lists, "id").select("id", "text", "list"), kind, window)
    earliest = settled(
        windows.groupBy("run")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last")
        .select("run", "first"),
        wait=True,
    )
    later = windows.join(earliest, "run").where("first < id")
    return settled(
        later.groupBy("id")
        .agg(F.collect_set(F.struct("run", "first")).alias("found"))
        .select("id", F.col("found.run").alias("runs"), F.col("found.first").alias("firsts")),
        wait=True,
    )

def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS
) -> DataFrame:
    """``(key, n_words, n_removed, kept, factors)``: one row per row of ``docs``.

    Words are runs without space and ``\\x09-\\x0D``. A word goes when a window of ``window`` words
    around it also starts in a document of a smaller key; ``kept`` holds the others, joined by one
    space. ``factors`` are the duplicate spans ``(start, end, reference)``: words counted from 0,
    and the smallest key that holds all their windows. Null and empty texts have no words; a row
    without key is neither earlier nor later than any; repeated rows get the same answer.
    """
    if window < BLOCK_WORDS:
        raise ValueError(f"a window has {BLOCK_WORDS} words at least")
    kind = sql_type(docs, key)
    found = repeated_windows(docs, key, text, window)
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        for part, cells in slices(batches, 1, as_bytes=True):
            texts = Windows(cells, window)
            bounds = np.searchsorted(texts.owner, np.arange(len(cells) + 1))
            runs, firsts = part.column(2), part.column(3)
            removed, kept, spans, names = [], [], [], []
            for i, words in enumerate(t.split() for t in cells):
                factors = []
                if runs[i].is_valid:
                    held = runs[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    order = np.argsort(held)
                    held = held[order]
                    own = texts.run[bounds[i] : bounds[i + 1]]
                    at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                    hit = np.flatnonzero(held[at] == own)
                    known = firsts[i].values.take(pa.array(order[at[hit]]))
                    number = known.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    factors = factor(texts.start[bounds[i] : bounds[i + 1]][hit], number, window)
                    names += [known[f[2]].as_py() for f in factors]
                keep = np.ones(len(words), dtype=bool)
                for start, end, _ in factors:
                    keep[start:end] = False
                spans.append(factors)
                removed.append(len(words) - int(keep.sum()))
                kept.append(b" ".join(words if not factors else [w for w, k in zip(words, keep) if k]))
            ends = pa.array(np.append(0, np.cumsum([len(s) for s in spans])).astype(np.int32))
            flat = [s for each in spans for s in each]
            members = pa.StructArray.from_arrays(
                [
                    pa.array([s[0] for s in flat], pa.int64()),
                    pa.array([s[1] for s in flat], pa.int64()),
                    pa.array(names, firsts.type.value_type),
                ],
                ["start", "end", "reference"],
            )
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array(texts.counts),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.ListArray.from_arrays(ends, members),
                ],
                [key, "n_words", "n_removed", "kept", "factors"],
            )

    return (
        texts.join(found, "id", "left")
        .select("id", "text", "runs", "firsts")
        .mapInArrow(
            work,
            f"`{key}` {kind}, n_words bigint, n_removed bigint, kept string, "
            f"factors array<struct<start: bigint, end: bigint, reference: {kind}>>",
        )
    )

OP1_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, w[i:i + 12] AS g FROM s),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, coalesce(len(r.gone), 0) AS n_removed,
  CASE WHEN r.gone IS NULL THEN d.w ELSE
  [d.w[x] for x in range(1, len(d.w) + 1) if NOT list_contains(r.gone, x)] END AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

@query("op1_rlz_spans", OP1_SQL)
def _op1(spark: SparkSession, folder: str) -> DataFrame:
    done = remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
