"""What the operators share: registration of queries, words of a text, slices of Arrow batches."""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corpusmill.settings import checkpoint_folder, cut_lineage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Texts are handled in slices of about this many bytes, whatever an Arrow batch holds.
SLICE_BYTES = 4_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` states the same rows for DuckDB."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def slices(
    batches: Iterator[pa.RecordBatch], text: int, as_bytes: bool = False
) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut batches so that each slice holds about ``SLICE_BYTES`` of text or a single row.

    Yields the slice and its texts (``""`` or ``b""`` for null).
    """
    empty = b"" if as_bytes else ""
    for batch in batches:
        column = batch.column(text)
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        place = (np.cumsum(lengths) - 1) // SLICE_BYTES
        for cut in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1):
            if len(cut):
                part = batch.slice(cut[0], len(cut))
                cells = part.column(text)
                values = (cells.cast(pa.binary()) if as_bytes else cells).to_pylist()
                yield part, [empty if v is None else v for v in values]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# A word's hash is the sum of a random number per byte times a power of an odd number per place, so
# that running sums over a whole slice give the hashes of all its words.
_BASE = np.uint64(0xD6E8FEB86659FD95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_PART = 2_000_000
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between slices."""
    if len(_POWERS.get("up", ())) < n:
        for name, number in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, number, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def hashed_words(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and how many words each text has.

    Words are runs without space and ``\\x09-\\x0D``; ``fold`` takes A-Z as a-z.
    """
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)
    inside = ~_SPACE[raw]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, bounds))
    hashes = np.zeros(len(starts), dtype=np.uint64)
    numbers = _FOLDED if fold else _BYTES
    first = 0
    while first < len(starts):
        # Whole words of about _PART bytes, at least one.
        last = max(int(np.searchsorted(ends, starts[first] + _PART, side="right")), first + 1)
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _powers(max(high - low, _PART))
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(numbers[raw[low:high]] * up[: high - low], out=sums[1:])
        at, to = starts[first:last] - low, ends[first:last] - low
        hashes[first:last] = mixed((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64) * _BASE)
        first = last
    return hashes, counts


def settled(df: DataFrame, wait: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` and let Spark's cleaner drop the shuffle files behind it.

    The cleaner frees what the driver's collector finds unreachable; asking for a collection after
    a large stage keeps the disks of the executors from holding the shuffles of all stages at once.
    With ``wait`` the files of ``df`` itself go too: the session lets go of a job when the next one
    ends, and Python hands its references over within a second.
    """
    done = cut_lineage(df)
    session = df.sparkSession
    # The plan that has run holds its shuffles.
    del df
    gc.collect()
    if wait:
        session.range(1, numPartitions=1).checkpoint()
        time.sleep(1.2)
    session.sparkContext._jvm.System.gc()
    return done


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in ``spark.checkpoint.dir``."""
    return checkpoint_folder(spark).rstrip("/")
