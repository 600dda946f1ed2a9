"""Near-duplicate documents from bottom-k sketches of one hash function.

A sketch keeps the smallest hashes of a document's shingles. Inverted lists of runs of retained
values bring documents together; the union sketch of a pair estimates its similarity, and the
whole sets decide. Lists never emit all their pairs: every member meets its leader, and only
documents that the links so far leave in different components are compared further, in blocks that
give back nothing but links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.base import hashed_words, mixed, query, slices, sql_type, table
from corpusmill.llm.components import components
from corpusmill.llm.scratch import Scratch

# 48 retained values; a list belongs to three values that follow each other. At similarity 0.8
# four of five neighbours in the union agree, so two documents miss all 46 lists with a chance
# below one in a million. Two sets with a union of up to 48 shingles are retained whole: with one
# value in five unshared, some three shared values stay together, or the sets are equal. The only
# exception is a union of five whose third value is the unshared one; sets of four and five values
# therefore post runs of two as well, since two neighbours on one side are always shared.
RETAINED = 48
RUN = 3
SHORT_RUN = 2
SHORT_SETS = (4, 5)
# Of the union's 48 smallest, 38.4 are shared on average at 0.8; 20 is 6.6 deviations below.
LEAST_SHARED = 20
# One bit for the smallest hash of each of 256 ranges. At 0.8 about 26 bits differ at most; 52 is
# 5.4 deviations above. A bit differs only where one side has a shingle of its own, and at 0.8 those
# are at most a quarter of the smaller set, which is the sharper bound for short texts.
BITS = 256
MOST_DIFFERENT = 52
# Documents of a neighbourhood that are compared in one go.
BLOCK_ROWS = 512

_C = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(1 << 63)


def shingle_set(words: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``length`` words; fewer words are one run."""
    if not len(words):
        return words
    span = min(length, len(words))
    runs = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for step in range(span):
        runs = mixed(runs * _C + words[step : step + len(runs)])
    return np.unique(runs)


def _bits(values: np.ndarray) -> np.ndarray:
    """For each range of hashes the parity of its smallest member, 256 bits as four numbers."""
    places, first = np.unique(values >> np.uint64(56), return_index=True)
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[places.astype(np.int64)] = (mixed(values[first]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def _keys(values: np.ndarray, span: int, mark: int) -> np.ndarray:
    """A key for every run of ``span`` values; runs of different marks never meet."""
    keys = np.full(len(values) - span + 1, mark, dtype=np.uint64)
    for step in range(span):
        keys = mixed(keys * _C + values[step : step + len(keys)])
    return keys


def _runs(values: np.ndarray) -> np.ndarray:
    """Keys of the inverted lists of a sketch."""
    span = min(RUN, len(values))
    keys = _keys(values, span, span)
    if len(values) in SHORT_SETS:
        # The mark keeps whole sets of two out of these lists.
        keys = np.append(keys, _keys(values, SHORT_RUN, RUN + SHORT_RUN))
    return keys


def _signed(values: np.ndarray) -> np.ndarray:
    """The same order as signed numbers."""
    return (values ^ _TOP).view(np.int64)


def _lists(cells: list[np.ndarray]) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(c) for c in cells])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *cells])))


def _sets(texts: list[bytes], length: int) -> list[np.ndarray]:
    flat, counts = hashed_words(texts, fold=True)
    return [shingle_set(w, length) for w in np.split(flat, np.cumsum(counts)[:-1])]


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """``(id, n, digest, bits, retained)`` per row: set size, digest of the whole set, sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1, as_bytes=True):
            sets = _sets(texts, length)
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    _lists([_bits(s) for s in sets]),
                    _lists([_signed(s[:RETAINED]) for s in sets]),
                ],
                ["id", "n", "digest", "bits", "retained"],
            )

    kind = sql_type(docs, key)
    return docs.select(key, text).mapInArrow(
        work, f"id {kind}, n bigint, digest binary, bits array<bigint>, retained array<bigint>"
    )


def _postings(classes: DataFrame, kind: str) -> DataFrame:
    """``(run, id)``: the inverted lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(1)
            values = kept.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ _TOP
            ends = np.cumsum(kept.value_lengths().to_numpy(zero_copy_only=False))
            runs = [_runs(v) for v in np.split(values, ends[:-1])] if len(ends) else []
            counts = [len(r) for r in runs]
            owners = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            flat = np.concatenate([np.zeros(0, np.uint64), *runs]).view(np.int64)
            yield pa.record_batch([pa.array(flat), owners], ["run", "id"])

    return classes.select("id", "retained").mapInArrow(work, f"run bigint, id {kind}")


def _whole_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, length: int) -> DataFrame:
    """``(id, whole array<bigint>)`` of the documents in ``wanted (id, digest)``."""
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cells in slices(batches, 2, as_bytes=True):
            sets = _sets(cells, length)
            # Rows that share a key with the wanted one but not the text fall out here.
            right = [i for i, (s, d) in enumerate(zip(sets, part.column(1).to_pylist())) if _digest(s) == d]
            yield pa.record_batch(
                [part.column(0).take(pa.array(right, pa.int64())), _lists([_signed(sets[i]) for i in right])],
                ["id", "whole"],
            )

    return wanted.join(texts, "id").select("id", "digest", "text").mapInArrow(
        work, f"id {sql_type(docs, key)}, whole array<bigint>"
    )


def _near(a: str, b: str, percent: int) -> Column:
    """Sizes and bits of two sides still allow the similarity."""
    sizes = 100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")
    different = sum((F.bit_count(F.col(f"{a}bits")[i].bitwiseXOR(F.col(f"{b}bits")[i])) for i in range(BITS // 64)), F.lit(0))
    own = percent * different <= (100 - percent) * F.least(f"{a}n", f"{b}n")
    return sizes & (different <= MOST_DIFFERENT) & own


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{name}{c}") for c in df.columns])


def _linked(scratch: Scratch, pairs: DataFrame, classes: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that reach the similarity: estimated from union sketches, then exact."""
    kept = classes.select("id", "retained")
    sketched = pairs.join(_side(kept, "a_"), F.col("a") == F.col("a_id")).join(
        _side(kept, "b_"), F.col("b") == F.col("b_id")
    )
    union = F.slice(F.array_sort(F.array_union("a_retained", "b_retained")), 1, RETAINED)
    shared = F.array_intersect("a_retained", "b_retained")
    likely = RETAINED * F.size(F.array_intersect(union, shared)) >= LEAST_SHARED * F.size(union)
    likely_pairs = scratch.store(sketched.where(likely).select("a", "b"), "likely")
    full = likely_pairs.join(_side(whole, "a_"), F.col("a") == F.col("a_id")).join(
        _side(whole, "b_"), F.col("b") == F.col("b_id")
    )
    both = F.size(F.array_intersect("a_whole", "b_whole"))
    exact = 100 * both >= percent * (F.size("a_whole") + F.size("b_whole") - both)
    return scratch.store(full.where(exact).select("a", "b"), "linked")


def _inside_areas(scratch: Scratch, rows: DataFrame, kind: str, percent: int) -> DataFrame:
    """Links ``(a, b)`` between documents of one area and different components.

    ``rows`` holds ``id, area, fine, n, bits, whole``. The largest component of an area is not
    compared with itself: blocks of all other documents meet blocks of the whole area, and only
    links leave a block. A document travels once for each block of the other side.
    """
    sizes = rows.groupBy("area", "fine").agg(F.count(F.lit(1)).alias("rows"))
    areas = scratch.store(
        sizes.groupBy("area")
        .agg(F.sum("rows").alias("rows"), F.max(F.struct("rows", "fine")).alias("main"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .select(
            "area",
            F.col("main.fine").alias("main"),
            F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"),
            F.ceil((F.col("rows") - F.col("main.rows")) / BLOCK_ROWS).alias("others"),
        ),
        "areas",
    )
    open_rows = scratch.store(rows.join(areas, "area"), "open")
    every = open_rows.select(
        "area", "id", "fine", "n", "bits", "whole", F.lit(1).alias("role"),
        F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"),
        F.pmod(F.xxhash64("id"), F.col("blocks")).alias("j"),
    )
    other = open_rows.where("fine != main").select(
        "area", "id", "fine", "n", "bits", "whole", F.lit(0).alias("role"),
        F.pmod(F.xxhash64("id"), F.col("others")).alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"),
    )

    def meet(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["role"] == 0], block[block["role"] == 1]
        links = []
        if len(left) and len(right):
            sets = right["whole"].tolist()
            flat = np.concatenate(sets)
            starts = np.append(0, np.cumsum([len(x) for x in sets]))
            bits = np.array(right["bits"].tolist(), dtype=np.int64).view(np.uint64)
            n, fine, ids = right["n"].to_numpy(), right["fine"].to_numpy(), right["id"].to_numpy()
            for i, f, m, b, own in zip(left["id"], left["fine"], left["n"], left["bits"], left["whole"]):
                different = np.bitwise_count(bits ^ np.asarray(b, dtype=np.int64).view(np.uint64)).sum(axis=1)
                least = np.minimum(n, m)
                likely = (fine != f) & (different <= MOST_DIFFERENT) & (100 * least >= percent * np.maximum(n, m))
                likely &= percent * different.astype(np.int64) <= (100 - percent) * least
                at = np.flatnonzero(likely)
                if len(at):
                    take = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in at.tolist()])
                    held = np.asarray(own)
                    spot = np.minimum(np.searchsorted(held, flat[take]), len(held) - 1)
                    ends = np.append(0, np.cumsum(n[at]))
                    shared = np.diff(np.append(0, np.cumsum(held[spot] == flat[take]))[ends])
                    linked = 100 * shared >= percent * (n[at] + m - shared)
                    links += [(i, j) for j in ids[at[linked]].tolist()]
        return pd.DataFrame({"a": [x[0] for x in links], "b": [x[1] for x in links]}).astype(block["id"].dtype)

    met = every.union(other).groupBy("area", "i", "j").applyInPandas(meet, f"a {kind}, b {kind}")
    return scratch.store(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "inside")


def near_duplicate_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 2, percent: int = 80
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``: one row per row of ``docs``.

    Documents are linked when ``100 * shared >= percent * union`` of their sets of shingles of
    ``length`` lower-cased (A-Z) words; ``component_id`` is the smallest key that links reach and
    ``kept`` marks its document. Null, empty and wordless texts are linked with nothing. Repeated
    rows are copies of each other and all carry the same answer. A row without key belongs to the
    component of its copies, null when no copy has a key; it is kept only in that case.
    """
    with Scratch(docs.sparkSession, "near-copies") as scratch:
        return scratch.finish(_groups(scratch, docs, key, text, length, percent))


def _groups(scratch: Scratch, docs: DataFrame, key: str, text: str, length: int, percent: int) -> DataFrame:
    kind = sql_type(docs, key)
    signed = scratch.store(sketches(docs, key, text, length), "sketches")
    # Equal sets are one class with the smallest key; a third of all rows may be copies, and the
    # map side folds them.
    named = signed.where("n > 0 AND id IS NOT NULL")
    classes = scratch.store(
        named.groupBy("digest").agg(
            F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("retained").alias("retained")
        ),
        "classes",
    )
    # A key that stands several times may name several sets; the first row of each set is enough.
    repeated = bool(named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1))
    postings = scratch.store(_postings(classes, kind), "postings")
    # A leader for each list of two or more: the smallest, which many lists of a group share.
    leads = postings.groupBy("run").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    members = scratch.store(postings.join(leads.select("run", "lead"), "run"), "members")
    scratch.drop(postings)
    look = classes.select("id", "n", "bits")
    pairs = members.where("lead < id").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    pairs = scratch.store(
        pairs.join(_side(look, "a_"), F.col("a") == F.col("a_id"))
        .join(_side(look, "b_"), F.col("b") == F.col("b_id"))
        .where(_near("a_", "b_", percent))
        .select("a", "b"),
        "pairs",
    )
    wanted = members.select("id").distinct().join(classes.select("id", "digest"), "id")
    whole = _whole_sets(docs, key, text, wanted, length)
    whole = scratch.store(whole.dropDuplicates(["id"]) if repeated else whole, "whole")
    first = _linked(scratch, pairs, classes, whole, percent)

    # Documents that the leaders tie loosely together are one neighbourhood; inside it, documents
    # of different components are compared block by block.
    found = components(first, scratch).select("id", F.col("component").alias("fine"))
    loose = components(pairs, scratch).select("id", F.col("component").alias("area"))
    tied = loose.join(found, "id", "left").withColumn("fine", F.coalesce("fine", "id"))
    inside = _inside_areas(scratch, tied.join(look, "id").join(whole, "id"), kind, percent)
    # What shares a list beyond its neighbourhood is rarely alike; size and bits sort it out
    # within the join.
    spot = scratch.store(
        members.select("run", "id", F.col("lead").alias("l0"))
        .join(look, "id")
        .join(loose, "id", "left")
        .join(loose.select(F.col("id").alias("l0"), F.col("area").alias("area0")), "l0", "left")
        .select("run", "id", "n", "bits", F.coalesce("area", "id").alias("area"), F.coalesce("area0", "l0").alias("area0")),
        "spot",
    )
    outside = scratch.store(spot.where("area != area0"), "outside")
    open_runs = scratch.store(spot.join(outside.select("run").distinct(), "run", "left_semi"), "runs")
    rest = (
        _side(outside, "a_")
        .join(
            _side(open_runs, "b_"),
            (F.col("a_run") == F.col("b_run"))
            & (F.col("a_area") != F.col("b_area"))
            & ((F.col("b_area") == F.col("b_area0")) | (F.col("a_id") < F.col("b_id")))
            & _near("a_", "b_", percent),
        )
        .select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
        .distinct()
    )
    second = _linked(scratch, rest, classes, whole, percent)
    groups = components(first.union(inside).union(second), scratch)

    told = classes.select("digest", F.col("id").alias("first")).join(groups, F.col("first") == F.col("id"), "left")
    told = scratch.store(told.select("digest", F.coalesce("component", "first").alias("component")), "told")
    joined = signed.select("id", "n", "digest").join(told, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return joined.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of ``docs``, one document of each near-duplicate group; repeated rows count once.

    Rows without key have nothing to be chosen by and stay.
    """
    kept = near_duplicate_groups(docs, key, text, **options).where("kept")
    kept = kept.where(F.col(f"`{key}`").isNotNull()).select(key).distinct()
    chosen = docs.join(kept, key, "left_semi").dropDuplicates([key])
    return chosen.select(*docs.columns).union(docs.where(F.col(f"`{key}`").isNull()))


@query("op4_minhash_groups")
def _op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(table(spark, folder, "documents"))
