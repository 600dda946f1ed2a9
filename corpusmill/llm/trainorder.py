"""Token sequences in training order as binary shards.

The token streams of all rows, in the order of their key columns, form one long stream that is cut
into sequences of equal length. A keyed Feistel network with cycle-walking permutes the numbers of
the sequences: it gives every sequence its global slot without a sort, and its inverse tells which
sequence a slot holds. Shards are ranges of slots. Every record of a shard has the same stride, so
a reader finds any slot by arithmetic and resumes where it stopped.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.batches import sliced
from corpusmill.llm.base import mixed, query, settled, sha256, shared_folder, sql_type, table
from corpusmill.llm.bpe import encode, public_vocabulary

LENGTH = 512
# Tokens as little-endian unsigned 16-bit integers: the vocabulary has fewer than 65,536 ids.
DTYPE = "<u2"
END = 50256
SHARD_BYTES = 16_000_000
ROUNDS = 6
# Slots that are read, and token streams that are packed, at a time.
READ_SLOTS = 2048
PACK_ROWS = 256
KEY = 20_24


class Feistel:
    """A permutation of ``0 .. size - 1`` by key: ``slot`` and its inverse ``number``."""

    def __init__(self, size: int, key: int):
        self.size = size
        self.half = np.uint64(max(1, ((max(size - 1, 1)).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _pass(self, x: np.ndarray, forward: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys if forward else self.keys[::-1]:
            if forward:
                left, right = right, left ^ (mixed(right ^ key) & self.mask)
            else:
                left, right = right ^ (mixed(left ^ key) & self.mask), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, forward: bool) -> np.ndarray:
        x = self._pass(np.asarray(x).astype(np.uint64), forward)
        # What falls outside walks on along its cycle until it is inside; the domain is less than
        # four times the size.
        while (out := x >= np.uint64(self.size)).any():
            x[out] = self._pass(x[out], forward)
        return x.astype(np.int64)

    def slot(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, True)

    def number(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, False)


def record_bytes(length: int = LENGTH, dtype: str = DTYPE) -> int:
    """Stride of a shard: the count of real tokens (4 bytes), the tokens, and a line end."""
    return 4 + length * np.dtype(dtype).itemsize + 1


def training_records(
    encoded: DataFrame, order: list[str], length: int = LENGTH, end: int = END, dtype: str = DTYPE, key: int = KEY
) -> tuple[DataFrame, dict]:
    """``(shard, slot, record binary)`` in the order of slots within each shard, and the layout.

    ``encoded`` holds the ``order`` columns and ``ids array<int>``. Every row ends with the token
    ``end``; null ids are only that token. Rows are streamed in the order of ``order``, nulls
    first, and of their ids where it ties, so equal rows may change places without a trace. The
    last sequence is filled up with ``end``. An empty table gives no records.
    """
    width = np.dtype(dtype).itemsize
    largest = np.iinfo(dtype).max

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PACK_ROWS) for b in batches for i in range(0, b.num_rows, PACK_ROWS)):
            cells = []
            for ids in batch.column(len(order)):
                values = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int64)
                if len(values) and (values.max() > largest or values.min() < 0):
                    raise ValueError(f"a token id does not fit {dtype}")
                cells.append(np.append(values, end).astype(dtype).tobytes())
            yield pa.record_batch(
                [*(batch.column(i) for i in range(len(order))), pa.array(cells, pa.binary())], [*order, "packed"]
            )

    kinds = ", ".join(f"`{c}` {sql_type(encoded, c)}" for c in order)
    packed = settled(encoded.select(*order, "ids").mapInArrow(pack, f"{kinds}, packed binary"))
    spark = packed.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    stream = settled(packed.repartitionByRange(ranges, *order, "packed").sortWithinPartitions(*order, "packed"))
    # One number per partition.
    sums = stream.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("packed")).alias("b"))
    held = {r["p"]: r["b"] // width for r in sums.collect()}
    before, total = {}, 0
    for p in sorted(held):
        before[p] = total
        total += held[p]
    count = -(-total // length)
    stride = record_bytes(length, dtype)
    per_shard = max(1, SHARD_BYTES // stride)
    layout = {
        "sequences": count, "tokens": total, "length": length, "dtype": dtype, "stride": stride,
        "slots_per_shard": per_shard, "key": key, "end": end,
    }
    shards = max(1, -(-count // per_shard))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of sequences: slot, first token's place in the sequence, bytes."""
        places, at = Feistel(count, key), before.get(TaskContext.get().partitionId(), 0)
        for batch in sliced(batches, 0):
            numbers, starts, pieces = [], [], []
            for cell in batch.column(0).to_pylist():
                spot, n = 0, len(cell) // width
                while spot < n:
                    number, start = divmod(at + spot, length)
                    take = min(length - start, n - spot)
                    numbers.append(number)
                    starts.append(start)
                    pieces.append(cell[spot * width : (spot + take) * width])
                    spot += take
                at += n
            slots = places.slot(np.array(numbers, dtype=np.int64))
            yield pa.record_batch(
                [
                    pa.array((slots // per_shard).astype(np.int32)), pa.array(slots),
                    pa.array(starts, pa.int32()), pa.array(pieces, pa.binary()),
                ],
                ["shard", "slot", "start", "piece"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records from the pieces of a partition, which come sorted by slot and place."""
        shard = slot = None
        parts: list[bytes] = []

        def record() -> bytes:
            data = b"".join(parts)
            n = len(data) // width
            fill = np.full(length - n, end, dtype=dtype).tobytes()
            return n.to_bytes(4, "little") + data + fill

        for batch in sliced(batches, 3):
            out: list[tuple[int, int, bytes]] = []
            for s, t, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if t != slot and parts:
                    out.append((shard, slot, record()))
                    parts = []
                shard, slot = s, t
                parts.append(piece)
            yield _records(out)
        if parts:
            yield _records([(shard, slot, record())])

    pieces = stream.select("packed").mapInArrow(cut, "shard int, slot bigint, start int, piece binary")
    # Shard and partition are the same number.
    ordered = pieces.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot", "start")
    return ordered.mapInArrow(join, "shard int, slot bigint, record binary"), layout


def _records(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.binary()),
        ],
        ["shard", "slot", "record"],
    )


def write_shards(encoded: DataFrame, folder: str, order: list[str], **options) -> dict:
    """Write ``folder/shards/part-<shard>-*`` and ``folder/layout``; the layout is returned.

    A task writes one shard and commits it whole, so a lost executor costs a repeated task. The
    line end that Spark's text writer puts behind each record is the last byte of the stride.
    """
    records, layout = training_records(encoded, order, **options)
    # The writer puts the bytes of a string out as they are.
    records.select(F.col("record").cast("string").alias("value")).write.text(f"{folder}/shards")
    rows = [tuple(layout.values())]
    encoded.sparkSession.createDataFrame(rows, list(layout)).coalesce(1).write.json(f"{folder}/layout")
    return layout


def read_slots(spark: SparkSession, folder: str, first: int = 0) -> DataFrame:
    """``(slot, shard, sequence, n_tokens, tokens binary)`` from slot ``first`` on.

    Only the shards from there are opened; ``sequence`` is the number in the stream, from the
    inverse permutation.
    """
    layout = spark.read.json(f"{folder}/layout").first().asDict()
    stride, per_shard = layout["stride"], layout["slots_per_shard"]
    places = Feistel(layout["sequences"], layout["key"])
    width = np.dtype(layout["dtype"]).itemsize

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch holds whole shards; they are looked at where they lie, some slots at a time.
        for path, data in ((p.as_py(), d.as_buffer()) for b in batches for p, d in zip(b.column(0), b.column(1))):
            shard = int(re.search(r"part-(\d+)", path)[1])
            base = shard * per_shard
            end = base + len(data) // stride
            for start in range(max(base, first), end, READ_SLOTS):
                slots = np.arange(start, min(start + READ_SLOTS, end))
                counts, tokens = [], []
                for slot in slots.tolist():
                    at = (slot - base) * stride
                    n = int.from_bytes(data[at : at + 4].to_pybytes(), "little")
                    counts.append(n)
                    tokens.append(data[at + 4 : at + 4 + n * width].to_pybytes())
                yield pa.record_batch(
                    [
                        pa.array(slots), pa.array(np.full(len(slots), shard, dtype=np.int32)),
                        pa.array(places.number(slots)), pa.array(counts, pa.int64()), pa.array(tokens, pa.binary()),
                    ],
                    ["slot", "shard", "sequence", "n_tokens", "tokens"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards")
    number = F.regexp_extract(F.col("path"), r"part-(\d+)", 1).cast("long")
    files = files.where(number >= first // per_shard).select("path", "content")
    return files.mapInArrow(work, "slot bigint, shard int, sequence bigint, n_tokens bigint, tokens binary")


def _written_and_read(spark: SparkSession, encoded: DataFrame, order: list[str]) -> DataFrame:
    """``encoded`` written as shards and read back: a row per slot, with the digest of its tokens."""
    target = f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}"
    write_shards(encoded, target, order)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.array([sha256(t) for t in batch.column(4).to_pylist()], pa.string())
            yield pa.record_batch([*(batch.column(i) for i in range(4)), cells], [*batch.schema.names[:4], "ids_sha256"])

    return read_slots(spark, target).mapInArrow(
        digest, "slot bigint, shard int, sequence bigint, n_tokens bigint, ids_sha256 string"
    )


@query("op8_training_order")
def _op8(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations in order of turns."""
    tokens, pattern = public_vocabulary()
    turns = table(spark, folder, "conversations")
    place = F.struct("conv_id", "turn", "role").alias("place")
    encoded = encode(turns.select(place, "text"), tokens, pattern, key="place")
    encoded = encoded.select("place.conv_id", "place.turn", "place.role", "ids")
    return _written_and_read(spark, encoded, ["conv_id", "turn", "role"])


@query("training_order_documents")
def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in order of their keys."""
    tokens, pattern = public_vocabulary()
    encoded = encode(table(spark, folder, "documents"), tokens, pattern)
    return _written_and_read(spark, encoded, ["doc_id"])
