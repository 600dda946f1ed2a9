"""Near-duplicate texts: rows with an earlier row of almost the same words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.batches import sliced
from corpusmill.functions.text import compute_once, normalize_text, text_key
from corpusmill.settings import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
# 48 bands of 6 rows: two texts at the threshold share no band with a chance
# of (1 - 0.8**6)**48, less than one in a million.
BANDS = 48
ROWS = 6
# Rows of one list that are compared in one go.
BLOCK_ROWS = 2048

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of all runs of ``words`` words; a shorter text is one run."""
    hashed = pd.util.hash_array(np.array(text.split(" "), dtype=object))
    span = min(words, len(hashed))
    runs = np.zeros(len(hashed) - span + 1, dtype=np.uint64)
    for step in range(span):
        runs = runs * _MIX + hashed[step : step + len(runs)]
    return np.unique(_mixed(runs))


def _band_keys(sets: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One key per band from the minima of the permuted set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(sets), 1024):
        block = sets[start : start + 1024, None] * factors[None, :] + offsets[None, :]
        least = np.minimum(least, block.min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        keys = keys * _MIX + least.reshape(BANDS, ROWS)[:, row]
    return _mixed(keys)


def _signatures(texts: DataFrame, key: str, words: int) -> DataFrame:
    """Per text its digest ``__k`` and its band keys; the sets themselves stay in the task."""
    kind = texts.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _MIX
        factors, offsets = _mixed(steps) | np.uint64(1), _mixed(~steps)
        for part in sliced(batches, 2):
            bands = [_band_keys(shingles(t, words), factors, offsets).view(np.int64) for t in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), _lists(bands)], [key, "__k", "bands"])

    return texts.select(key, text_key(F.col("__t")).alias("__k"), "__t").mapInArrow(
        sign, f"{key} {kind}, __k binary, bands array<bigint>"
    )


def _run_sets(texts: DataFrame, key: str, words: int) -> DataFrame:
    """Per text its whole shingle set: ``(key, runs)``."""
    kind = texts.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            sets = [shingles(t, words).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), _lists(sets)], [key, "runs"])

    return texts.select(key, "__t").mapInArrow(cut, f"{key} {kind}, runs array<bigint>")


def _lists(cells: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, cells)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cells)))


def _jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _leading_runs(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """``(key, run, enough)``: the rarest runs of each set, of which two similar sets share one.

    With all runs in one order, two sets that overlap by the threshold share a
    run among the first ``n - ceil(threshold * n) + 1`` of each. The order is
    rarest first: text that many rows have in common comes last and makes no
    lists, as long as a row has enough words of its own.

    Runs of the same rows stand together in the order. Where all rows of a run have the same run
    before it, they all meet there, and the run is left out: a passage that rows share, or the text
    of a template, makes one list and not one for each of its runs.

    ``enough`` is false where a row has too few such runs to match any row beside it. Of sets of ``n``
    and ``m`` runs that reach the threshold, all but ``ceil(threshold * max(n, m)) - 1`` of the common
    runs, at least ``threshold / (1 + threshold) * (n + m)``, are among the first of both.
    """
    size = F.size("runs")
    runs = sets.select(key, size.alias("n"), F.explode("runs").alias("run"))
    # Written out, so that both sides of the joins below are plain shuffles, whose
    # large partitions the adaptive planner splits.
    counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(key)).alias("who"))
    common = cut_lineage(counts.where("rows > 1"))
    per_row = Window.partitionBy(key)
    in_order = per_row.orderBy("rows", "who", "run")
    # Runs of a single row come first in its order and match nothing.
    alone = F.col("n") - F.count(F.lit(1)).over(per_row)
    spot = alone + F.row_number().over(in_order)
    # The margin only ever adds a run, should the product be rounded up.
    least = F.ceil(F.col("n") * threshold - 1e-9)
    leading = cut_lineage(
        runs.join(common, "run")
        .select(key, "run", "n", "rows", "who", (spot <= F.col("n") - least + 1).alias("first"))
        .where("first")
        .select(key, "run", "n", F.lag("run").over(in_order).alias("before"))
    )
    beside = leading.groupBy("run").agg(
        F.count(F.lit(1)).alias("rows"), F.min("n").alias("small"), F.max("n").alias("large")
    )

    def least_common(m: Column) -> Column:
        return (F.col("n") + m) * (threshold / (1 + threshold)) - F.greatest("n", m) * threshold - 1e-6

    # It rises up to m = n and falls from there on, so the ends of the possible sizes tell.
    ends = F.greatest(F.col("n") * threshold, "small"), F.least(F.col("n") / threshold, "large")
    enough = (
        leading.join(beside.where("rows > 1"), "run")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("held"), F.min(F.least(*map(least_common, ends))).alias("needed"))
        .where("held >= needed")
    )
    # The other runs have all their rows in the list of one run before.
    heads = leading.groupBy("run").agg(
        F.count(F.lit(1)).alias("rows"), F.count("before").alias("held"),
        F.min("before").alias("low"), F.max("before").alias("high"),
    )
    heads = heads.where("rows > 1 AND (held < rows OR low <> high)").select("run")
    return cut_lineage(
        leading.select(key, "run")
        .join(heads, "run", "left_semi")
        .join(enough.select(key, F.lit(True).alias("enough")), key, "left")
        .select(key, "run", F.coalesce("enough", F.lit(False)).alias("enough"))
    )


def _reached(sets: list[np.ndarray], later: np.ndarray, earlier: np.ndarray, keys: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the rows ``later`` reach the threshold with one of ``earlier`` that has a smaller key.

    ``later`` and ``earlier`` are places in ``sets`` and ``keys``. Postings of the earlier rows are
    counted up for one later row at a time, so nothing is made per pair but a count.
    """
    order = earlier[np.argsort(keys[earlier], kind="stable")]
    sizes = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    owners = np.repeat(np.arange(len(order)), sizes)
    by_run = np.argsort(flat, kind="stable")
    flat, owners = flat[by_run], owners[by_run]
    out = np.zeros(len(later), dtype=bool)
    before = np.searchsorted(keys[order], keys[later])
    for i, (row, end) in enumerate(zip(later, before)):
        own = sets[row]
        low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
        held = high > low
        spans = [owners[a:b] for a, b in zip(low[held], high[held])]
        if end and spans:
            shared = np.bincount(np.concatenate(spans), minlength=len(order))[:end]
            out[i] = (shared / (sizes[:end] + len(own) - shared) >= threshold).any()
    return out


def _in_blocks(sets: DataFrame, lists: DataFrame, still_open: DataFrame, key: str, threshold: float) -> DataFrame:
    """Open rows that reach the threshold with an earlier row of one of their lists: ``(later)``.

    The open rows of a list meet its rows block by block, and a block of comparisons gives back
    rows with a match, never pairs. A row travels once for each block of the other side: up to
    ``BLOCK_ROWS`` rows of one template make rows in proportion, whatever their similarity.
    """
    kind = sets.schema[key].dataType.simpleString()
    rows = lists.where("enough").join(still_open.select(F.col("later").alias(key), F.lit(True).alias("open")), key, "left")
    # Only open rows behind the first row of a list, and rows before its last open one, can match.
    per_list = rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("rows"), F.count("open").alias("opened"),
        F.min(key).alias("low"), F.max(F.when(F.col("open"), F.col(key))).alias("high"),
    )
    parts = cut_lineage(
        per_list.where("low < high").select(
            "run", "low", "high",
            F.ceil(F.col("opened") / BLOCK_ROWS).alias("lefts"),
            F.ceil(F.col("rows") / BLOCK_ROWS).alias("rights"),
        )
    )
    # A block is a stretch of the hash, so every task deals the same way.
    place = rows.join(parts, "run").withColumn("h", F.xxhash64(key))
    left = place.where(F.col("open") & (F.col(key) > F.col("low"))).select(
        key, "run", F.lit(True).alias("later"), F.pmod("h", "lefts").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"),
    )
    right = place.where(F.col(key) < F.col("high")).select(
        key, "run", F.lit(False).alias("later"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"),
        F.pmod("h", "rights").alias("j"),
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come one after the other; a task holds one of them."""
        block, held = None, []

        def matched() -> list:
            keys = np.array([r[0] for r in held])
            sides = np.array([r[1] for r in held], dtype=bool)
            later, earlier = np.flatnonzero(sides), np.flatnonzero(~sides)
            if not (len(later) and len(earlier)):
                return []
            found = _reached([r[2] for r in held], later, earlier, keys, threshold)
            return [held[i][0] for i in later[found]]

        for batch in batches:
            keys, runs, later, i, j, sets = (batch.column(c) for c in range(6))
            place = np.stack([c.to_numpy(zero_copy_only=False) for c in (runs, i, j)])
            flat = sets.flatten().to_numpy(zero_copy_only=False)
            parts = np.split(flat, np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))[:-1])
            rows = list(zip(keys.to_pylist(), later.to_pylist(), parts))
            cuts = [0, *(np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1).tolist(), len(rows)]
            out = []
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                now = tuple(place[:, start].tolist())
                if now != block:
                    out += matched()
                    block, held = now, []
                held += rows[start:end]
            yield pa.record_batch([pa.array(out, keys.type)], ["later"])
            kept = keys.type
        if held:
            yield pa.record_batch([pa.array(matched(), kept)], ["later"])

    block = ("run", "i", "j")
    dealt = left.union(right).join(sets, key).select(key, "run", "later", "i", "j", "runs")
    met = dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(meet, f"later {kind}")
    return met.distinct()


def near_duplicates(
    df: DataFrame,
    key: str,
    text: str = "text",
    threshold: float = THRESHOLD,
    words: int = SHINGLE_WORDS,
) -> DataFrame:
    """Rows with an earlier row (smaller key) of almost the same text: ``(key, kind)``.

    ``copy``: the same normalised text came before. ``near``: a text came
    before whose word runs overlap by ``threshold`` (Jaccard).

    Copies fold into their first row before anything is compared. Sets are made anew for the rows that
    share a band bucket, so the others' sets are never moved. Members of a band bucket are
    compared with its first row, one comparison per member. Rows that found no match there meet the
    rows that share one of their rarest runs, in blocks that give back rows and no pairs
    (:func:`_in_blocks`). Every comparison uses the whole sets, and no bucket or list is capped.
    """

    def normal(rows: DataFrame) -> DataFrame:
        norm = F.nullif(normalize_text(F.col(text)), F.lit(""))
        return compute_once(rows, [key], __t=norm).where("__t IS NOT NULL")

    signed = cut_lineage(_signatures(normal(df), key, words))
    firsts = cut_lineage(signed.groupBy("__k").agg(F.min(key).alias(key)).select(key))
    copies = signed.select(key).join(firsts, key, "left_anti")

    members = signed.join(firsts, key, "left_semi").select(F.explode("bands").alias("band"), F.col(key).alias("later"))
    # Stored, so that a bucket of any size is one side of a plain join.
    buckets = members.groupBy("band").agg(F.min("later").alias("first"), F.max("later").alias("last"))
    buckets = cut_lineage(buckets.where("first < last").select("band", "first"))
    tied = members.join(buckets, "band").where("first < later")
    pairs = cut_lineage(tied.select("later", F.col("first").alias("earlier")).distinct())
    # Whole sets are made for the rows that share a bucket, and for no others.
    shared = pairs.select(F.col("later").alias(key)).union(pairs.select(F.col("earlier").alias(key)))
    sets = cut_lineage(_run_sets(normal(df.join(shared.distinct(), key, "left_semi")), key, words))

    def matched(pairs: DataFrame) -> DataFrame:
        """Later rows of the pairs that reach the threshold."""
        return (
            pairs.join(sets.select(F.col(key).alias("later"), F.col("runs").alias("a")), "later")
            .join(sets.select(F.col(key).alias("earlier"), F.col("runs").alias("b")), "earlier")
            .where(_jaccard(F.col("a"), F.col("b")) >= threshold)
            .select("later")
            .distinct()
        )

    found = cut_lineage(matched(pairs))
    # Rows that share a bucket and are still without a match.
    still_open = cut_lineage(pairs.select("later").distinct().join(found, "later", "left_anti"))
    near = found.union(_in_blocks(sets, _leading_runs(sets, key, threshold), still_open, key, threshold))
    return copies.select(key, F.lit("copy").alias("kind")).union(
        near.select(F.col("later").alias(key), F.lit("near").alias("kind"))
    )
