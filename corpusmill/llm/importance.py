"""Documents resampled towards a target: hashed word runs, log ratios of their shares, Gumbel top k.

Word runs fall into buckets by their CRC-32. A CRC is linear in its bytes: every byte adds a number
that depends on its value and its distance from the end of the run alone, so a table of those
numbers and one XOR over each run give the CRCs of all runs of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.base import query, slices, sql_type, table
from corpusmill.llm.scratch import Scratch, numbered
from corpusmill.llm.terms import folded_terms

# Parameters of the query.
LENGTHS = (1, 1)
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

# Runs of up to this many bytes are read off the table at once, longer ones block by block.
BLOCK = 64
_ONES = np.uint32(0xFFFFFFFF)
# The reflected polynomial of CRC-32 (fixed value).
_POLYNOMIAL = 0xEDB88320


def _positions() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds at each distance from the end, and the CRC of zero bytes for each length."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    rows, zeros = [step], [0]
    state = 0xFFFFFFFF
    for _ in range(BLOCK):
        rows.append((rows[-1] >> np.uint32(8)) ^ step[rows[-1] & np.uint32(255)])
        state = (state >> 8) ^ int(step[state & 255])
        zeros.append(state ^ 0xFFFFFFFF)
    return np.concatenate(rows[:BLOCK]), np.array(zeros, dtype=np.uint32)


_ADDED, _ZEROS = _positions()


def _sums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the table's numbers over every span of 1 to BLOCK bytes; spans may overlap."""
    firsts = np.append(0, np.cumsum(lengths))[:-1]
    places = np.arange(int(lengths.sum()))
    at = places + np.repeat(starts - firsts, lengths)
    distance = np.repeat(firsts + lengths - 1, lengths) - places
    return np.bitwise_xor.reduceat(_ADDED[(distance << 8) + data[at]], firsts)


def _moved(state: np.ndarray) -> np.ndarray:
    """A register behind BLOCK more zero bytes: its four bytes stand in front of them."""
    out = np.zeros_like(state)
    for k in range(4):
        byte = (state >> np.uint32(8 * k)) & np.uint32(255)
        out ^= _ADDED[((BLOCK - 1 - k) << 8) + byte.astype(np.int64)]
    return out


def crc32_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start : start + length]`` for every span, as unsigned 32-bit numbers.

    Spans longer than BLOCK begin with the part that is left over and fold the blocks behind it
    one by one, all long spans together. Empty spans have the CRC 0.
    """
    crcs = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero((lengths > 0) & (lengths <= BLOCK))
    if len(short):
        crcs[short] = _sums(data, starts[short], lengths[short]) ^ _ZEROS[lengths[short]]
    # The longest first, so that those with blocks left are always a prefix.
    long = np.flatnonzero(lengths > BLOCK)
    long = long[np.argsort(-lengths[long], kind="stable")]
    if len(long):
        blocks = (lengths[long] - 1) // BLOCK
        head = lengths[long] - blocks * BLOCK
        state = _sums(data, starts[long], head) ^ _ZEROS[head] ^ _ONES
        at = starts[long] + head
        for k in range(int(blocks[0])):
            n = int(np.count_nonzero(blocks > k))
            here = _sums(data, at[:n] + k * BLOCK, np.full(n, BLOCK))
            state[:n] = _moved(state[:n]) ^ here
        crcs[long] = state ^ _ONES
    return crcs


def feature_buckets(
    texts: list[bytes], lengths: tuple[int, int], buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket of every feature, text it belongs to, words of each text)``.

    Features are all runs of ``lengths[0]`` to ``lengths[1]`` consecutive words of one text.
    """
    data, starts, sizes, counts = folded_terms(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    last = np.cumsum(counts)[owner]
    found, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = starts + sizes
    for length in range(lengths[0], lengths[1] + 1):
        first = np.flatnonzero(np.arange(len(starts)) + length <= last)
        spans = ends[first + length - 1] - starts[first]
        found.append((crc32_spans(data, starts[first], spans) % np.uint32(buckets)).astype(np.int64))
        owners.append(owner[first])
    return np.concatenate(found), np.concatenate(owners), counts


def bucket_counts(
    docs: DataFrame, text: str = "text", lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS
) -> DataFrame:
    """``(bucket, n)``: features of all texts; at most ``buckets`` rows leave a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, texts in slices(batches, 0, as_bytes=True):
            total += np.bincount(feature_buckets(texts, lengths, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    counted = docs.select(text).mapInArrow(work, "bucket int, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Per bucket ``floor(1000 * ln(target share / source share))``, every count one larger."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
    both = both.join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    # One row per bucket, whatever the corpus.
    rows = sorted(both.fillna(0, ["s", "t"]).select("bucket", "s", "t").collect())
    s = np.array([r["s"] for r in rows], dtype=np.float64)
    t = np.array([r["t"] for r in rows], dtype=np.float64)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def importance_weights(
    docs: DataFrame,
    gains: list[int],
    key: str = "doc_id",
    text: str = "text",
    lengths: tuple[int, int] = LENGTHS,
) -> DataFrame:
    """``(key, n_words, n_features, weight)``: the floored mean gain of a text's features.

    ``gains`` has a number per bucket. Texts without features, null ones too, have weight 0.
    """
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(np.array(gains, dtype=np.int64))
    buckets = len(gains)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1, as_bytes=True):
            found, owners, words = feature_buckets(texts, lengths, buckets)
            n = np.bincount(owners, minlength=len(texts))
            sums = np.zeros(len(texts), dtype=np.int64)
            np.add.at(sums, owners, told.value[found])
            weight = sums // np.maximum(n, 1)
            yield pa.record_batch(
                [part.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)],
                ["key", "n_words", "n_features", "weight"],
            )

    schema = f"key {sql_type(docs, key)}, n_words bigint, n_features bigint, weight bigint"
    return docs.select(key, text).mapInArrow(work, schema)


def noise(key: Column, seed: int) -> Column:
    """``floor(-1000 * ln(-ln(u)))`` with u from the SHA-256 of ``<seed>:<key>``: Gumbel noise."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lengths: tuple[int, int] = LENGTHS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """``(key, n_features, weight, score, rank)``, one row per row of ``docs``.

    Draws ``floor(percent * N / 100)`` of the N documents with at least ``least_words`` words, the
    highest scores first, ties to the smaller key; ``rank`` is null for the others. The text column
    of ``target`` has the same name. Null and empty texts have no features, weight 0 and are never
    drawn. A null key is scored as the empty string and comes last in a tie. Repeated rows are
    documents of their own and get ranks of their own. Without target texts all gains follow from
    the documents alone; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    with Scratch(spark, "importance") as scratch:
        source = bucket_counts(docs, text, lengths, buckets)
        gains = bucket_gains(source, bucket_counts(target, text, lengths, buckets), buckets)
        weighed = importance_weights(docs, gains, key, text, lengths)
        scored = scratch.store(weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed)), "scored")
        fit = scored.where(F.col("n_words") >= least_words)
        # Scores are whole numbers between about -50,000 and 70,000: gains are logarithms of
        # ratios of counts and the noise is bounded by its 32 bits.
        held = sorted(fit.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
        drawn, cut = percent * sum(r["n"] for r in held) // 100, None
        left = drawn
        for r in held:
            if left <= 0:
                break
            cut, left = r["score"], left - r["n"]
        inside = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(cut)) if cut is not None else F.lit(False)
        order = [F.desc("score"), F.asc_nulls_last("key"), "n_features", "weight", "spot"]
        first = scored.where(inside).withColumn("spot", F.monotonically_increasing_id())
        ranked = numbered(scratch, first, order, "rank")
        rank = F.when(F.col("rank") <= drawn, F.col("rank"))
        told = ranked.select("key", "n_features", "weight", "score", rank.alias("rank"))
        rest = scored.where(~inside).select("key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
        return scratch.finish(told.union(rest).withColumnRenamed("key", key))


@query("op13_importance_draw")
def _op13(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, drawn towards the benchmark texts."""
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
