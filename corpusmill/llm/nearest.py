"""Approximate nearest vectors by few stable projections in a kd-tree.

Vectors are projected on a handful of Gaussian directions. The square of a projected distance over
that of the true distance follows a chi-square law, so a neighbour within the distance found so far
lies outside a computable radius around the projected query with a small, chosen chance only. The
cells of a kd-tree over the projections are visited in order of their distance from the query, in
rounds of growing length. Vectors inside the radius are verified on the original components; every
verified cell shrinks the radius, and a query is done when it no longer reaches the next cell.

Recall against cost: a true neighbour is missed with a chance of at most 1 - CONFIDENCE. Fewer
DIRECTIONS make cells that say less about distance, more make more of them touch the radius; smaller
FIRST_CELLS mean more rounds with fewer needless visits.

Largest inner products become smallest distances by one more component that gives every vector the
length of the longest.

What moves follows the visits as little as it can: a visit is stored as two numbers, and a query's
components go once to a pack, the rows of neighbouring cells that one task holds. A task keeps its pack
and lets the queries stream past, so its memory follows neither the rows nor the queries. Queries take
turns, so that what is sent of them at a time is no more than the rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corpusmill.llm.base import SLICE_BYTES, query, sql_type, table
from corpusmill.llm.scratch import Scratch

DIRECTIONS = 8  # even, see chi_square_radius
# Chance that a true neighbour lies inside the radius.
CONFIDENCE = 0.95
SEED = 20_24
# The tree is fitted on about so many rows; every row is indexed.
FIT_ROWS = 20_000
CELL_ROWS = 512
MOST_CELLS = 4_096
# Rows of a cell that are searched in one task; larger cells are cut into parts.
PART_ROWS = 4_096
LEAF_ROWS = 256
# Cells that a query visits in the first round, and how many times more in each next one.
FIRST_CELLS = 4
FURTHER = 4
# Bytes of the components that a task holds, and parts of cells at most, as bits of so many bigints.
PACK_BYTES = 64 << 20
BITS = 62
WORDS = 2
# Packs for each core, if the rows do not ask for more.
PACKS_PER_CORE = 3
# What the queries of a turn may send, if the rows are less than that.
TURN_BYTES = 256 << 20
# Queries that are compared in one go.
BLOCK = 1_024
# Hits of a cell before the best are taken, distances of queries from cells in one go and in one task.
HITS = 1 << 20
GAPS = 1 << 16
GAPS_PER_TASK = 1 << 21


def chi_square_radius(confidence: float, m: int = DIRECTIONS) -> float:
    """The value that a chi-square variable of even ``m`` degrees stays below with ``confidence``."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < confidence else (low, middle)
    return high


def usable(vector: Column) -> Column:
    """No null, no component that is null or not finite, and not zero."""
    value = vector.cast("array<double>")
    fine = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(value, lambda v: v != 0), F.lit(False))


def _floats(column: pa.Array, d: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, d)


def _reach(longest: float, length: np.ndarray, worst: np.ndarray, radius: float) -> np.ndarray:
    """Square of the projected distance that is searched, with room for the last bits of sums."""
    return (np.maximum(longest + length - 2 * worst, 0.0) + 1e-12 * (longest + length)) * radius


def _first(values: np.ndarray, count: int) -> np.ndarray:
    """Marks the ``count`` smallest values of each line; of equal ones those that stand first."""
    if count <= 0 or count >= values.shape[1]:
        return np.full(values.shape, count > 0)
    last = np.partition(values, count - 1, axis=1)[:, count - 1 : count]
    out = values <= last
    if np.count_nonzero(out) > count * len(out):
        below, equal = values < last, values == last
        out = below | (equal & (np.cumsum(equal, axis=1) <= count - below.sum(axis=1, keepdims=True)))
    return out


def _top(k: int, owner: np.ndarray, names: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the ``k`` best of each owner, best first; ties go to the smaller name."""
    order = np.lexsort((names, -scores, owner))
    own = owner[order]
    start = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), np.arange(len(own)), 0))
    return order[np.arange(len(own)) - start < k]


def packed(sizes: dict[int, int], rows: float) -> list[tuple[int, list[int], list[int]]]:
    """``(cell, packs, places)`` for the parts of each cell.

    A pack takes neighbouring parts up to about ``rows`` rows, one part at least and ``BITS`` times
    ``WORDS`` at most.
    """
    out, pack, held, place = [], 0, 0.0, 0
    for cell in sorted(sizes):
        parts = math.ceil(sizes[cell] / PART_ROWS)
        packs, places = [], []
        for _ in range(parts):
            if place and (place == BITS * WORDS or held + sizes[cell] / parts > rows):
                pack, held, place = pack + 1, 0.0, 0
            packs.append(pack)
            places.append(place)
            held, place = held + sizes[cell] / parts, place + 1
        out.append((cell, packs, places))
    return out


class Tree:
    """kd-tree over projected points: every inner node cuts one direction at a median."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.direction = np.zeros(2**depth, dtype=np.int64)
        self.cut = np.zeros(2**depth)
        m = points.shape[1]
        self.low = np.full((2**depth, m), -np.inf)
        self.high = np.full((2**depth, m), np.inf)
        parts = {1: (points, np.full(m, -np.inf), np.full(m, np.inf))}
        for node in range(1, 2**depth):
            inside, low, high = parts.pop(node)
            j = int(np.argmax(np.ptp(inside, axis=0))) if len(inside) else 0
            at = float(np.median(inside[:, j])) if len(inside) else 0.0
            self.direction[node], self.cut[node] = j, at
            below_high, above_low = high.copy(), low.copy()
            below_high[j], above_low[j] = at, at
            parts[2 * node] = (inside[inside[:, j] <= at], low, below_high)
            parts[2 * node + 1] = (inside[inside[:, j] > at], above_low, high)
        for node, (_, low, high) in parts.items():
            self.low[node - 2**depth], self.high[node - 2**depth] = low, high

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        for _ in range(self.depth):
            above = points[np.arange(len(points)), self.direction[node]] > self.cut[node]
            node = 2 * node + above
        return node - 2**self.depth

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squares of the distances from projected points to each cell."""
        gap = np.zeros((len(points), 2**self.depth))
        for j in range(points.shape[1]):
            at = points[:, j : j + 1]
            off = np.maximum(np.maximum(self.low[:, j] - at, at - self.high[:, j]), 0.0)
            gap += off * off
        return gap


def _leaves(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The tree inside a cell: row numbers by leaf."""
    if len(rows) <= LEAF_ROWS:
        return [rows]
    j = int(np.argmax(np.ptp(points[rows], axis=0)))
    order = rows[np.argsort(points[rows, j], kind="stable")]
    half = len(order) // 2
    return _leaves(points, order[:half]) + _leaves(points, order[half:])


class Queries:
    """Queries with the k-th best score known of each, -inf while there are fewer."""

    def __init__(self, ids: pa.Array, x: np.ndarray, at: np.ndarray, worst: np.ndarray, longest: float):
        self.names, self.x, self.at, self.worst = ids.to_pandas().to_numpy(), x, at, worst
        self.length = (x * x).sum(axis=1)
        size = np.sqrt(self.length)
        self.unit = (x / np.where(size > 0, size, 1.0)[:, None]).astype(np.float32)
        # The largest product possible.
        self.most = size * math.sqrt(longest)


class Cell:
    """The rows of a part of a cell, leaf by leaf, without those that cannot be among the best ``k``."""

    def __init__(self, ids: pa.Array, x: np.ndarray, x_at: np.ndarray, k: int, longest: float):
        names = ids.to_pandas().to_numpy()
        # Of equal vectors only the k + 1 smallest ids can be among the best of any query.
        vector = pd.factorize(np.array([r.tobytes() for r in x + x.dtype.type(0)], dtype=object))[0]
        order = np.lexsort((names, vector))
        again = (vector[order[1:]] == vector[order[:-1]]) & (names[order[1:]] == names[order[:-1]])
        order = order[np.append(True, ~again)]
        same = np.append(False, vector[order[1:]] == vector[order[:-1]])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        leaves = _leaves(x_at, np.sort(order[np.arange(len(order)) - first <= k]))
        place = np.concatenate(leaves)
        self.k, self.longest, self.ids, self.names = k, longest, ids.take(pa.array(place)), names[place]
        self.x, self.x_at = x[place], x_at[place]
        self.unit = (self.x / (math.sqrt(longest) or 1.0)).astype(np.float32)
        # What two products of vectors of length 1 may differ by, and rows that can have a query's own id.
        self.margin = (x.shape[1] + 8) * 2.0**-23
        self.own = int(np.unique(pd.factorize(self.names)[0], return_counts=True)[1].max())
        ends = np.cumsum([len(leaf) for leaf in leaves])
        self.leaves = [slice(end - len(leaf), end) for leaf, end in zip(leaves, ends.tolist())]
        self.low = [self.x_at[leaf].min(axis=0) for leaf in self.leaves]
        self.high = [self.x_at[leaf].max(axis=0) for leaf in self.leaves]

    def search(self, asked: Queries, i: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers out of ``i``, row numbers and scores of the best ``k`` rows of each query.

        The k-th best score known bounds the radius (``radius`` times the square of its distance), which
        shrinks as rows are verified. Products in single precision leave out the rows that cannot reach
        that score; the others are tested for the radius and scored by sums in one fixed order, so that
        equal vectors score alike wherever they stand.
        """
        k, at, length = self.k, asked.at[i], asked.length[i]
        worst = asked.worst[i]
        best = np.full((len(i), k), -np.inf)
        none = np.zeros(0, dtype=np.int64)
        found, held = [(none, none, np.zeros(0))], 0
        for leaf, low, high in zip(self.leaves, self.low, self.high):
            reach = _reach(self.longest, length, worst, radius)
            off = np.maximum(np.maximum(low - at, at - high), 0.0)
            near = np.flatnonzero((off * off).sum(axis=1) <= reach)
            if not len(near):
                continue
            products = asked.unit[i[near]] @ self.unit[leaf].T
            n = products.shape[1]
            bar = self._bar(worst[near], asked.most[i[near]])
            fresh = np.flatnonzero(np.isneginf(worst[near]))
            if len(fresh) and n > k + self.own:
                # So many rows of this leaf are better that k others than the query's own are among them.
                enough = n - k - self.own
                bar[fresh] = np.partition(products[fresh], enough, axis=1)[:, enough] - 2 * self.margin
            some = np.flatnonzero(products.max(axis=1) >= bar)
            line, column = np.divmod(np.flatnonzero(products[some] >= bar[some, None]), n)
            a, b = near[some[line]], leaf.start + column
            open_ = asked.names[i[a]] != self.names[b]
            a, b = a[open_], b[open_]
            within = np.isinf(reach[a])
            far = np.flatnonzero(~within)
            within[far] = ((at[a[far]] - self.x_at[b[far]]) ** 2).sum(axis=1) <= reach[a[far]]
            a, b = a[within], b[within]
            score = self._scores(asked, i[a], b)
            known = score >= worst[a]
            a, b, score = a[known], b[known], score[known]
            if not len(a):
                continue
            lines, line = np.unique(a, return_inverse=True)
            grown = np.full((len(lines), k + n), -np.inf)
            grown[:, :k] = best[lines]
            grown[line, k + b - leaf.start] = score
            grown.partition(n, axis=1)
            best[lines] = grown[:, n:]
            worst[lines] = np.maximum(worst[lines], best[lines].min(axis=1))
            known = score >= worst[a]
            found.append((a[known], b[known], score[known]))
            held += len(found[-1][0])
            if held > HITS:
                found = [self._best(found)]
                held = len(found[0][0])
        a, b, score = self._best(found)
        return i[a], b, score

    def _bar(self, worst: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What the product in single precision reaches at least if the score reaches ``worst``."""
        with np.errstate(all="ignore"):
            share = worst / most - self.margin
        return np.where(np.isfinite(share), share, -np.inf)

    def _scores(self, asked: Queries, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        score = np.zeros(len(a))
        step = max(SLICE_BYTES // (8 * self.x.shape[1]), 1)
        for at in range(0, len(a), step):
            some = slice(at, at + step)
            score[some] = (asked.x[a[some]] * self.x[b[some]].astype(np.float64)).sum(axis=1)
        return score

    def _best(self, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, score = (np.concatenate([f[j] for f in found]) for j in range(3))
        order = _top(self.k, a, self.names[b], score) if len(a) else a
        return a[order], b[order], score[order]


def nearest(
    vectors: DataFrame, wanted: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """``(query_id, rank, key, score)``: the ``k`` rows of largest inner product, nearest first.

    ``wanted`` marks the queries among the rows; a query's own key is no candidate; ties go to the
    smaller key. Vectors that are not :func:`usable`, rows without key and vectors of another
    length than the most frequent one (the longer on a tie) take no part. Rows repeated with key
    and vector count once; of several vectors of one query key the least asks. An empty table
    gives no rows.
    """
    with Scratch(vectors.sparkSession, "nearest") as scratch:
        return scratch.finish(_nearest(scratch, vectors, wanted, k, key, vector, confidence))


def _nearest(
    scratch: Scratch, vectors: DataFrame, wanted: Column, k: int, key: str, vector: str, confidence: float
) -> DataFrame:
    kind = sql_type(vectors, key)
    value = F.col(f"`{vector}`").cast("array<double>")

    def taking_part(vectors: DataFrame) -> DataFrame:
        return vectors.where(F.col(f"`{key}`").isNotNull() & usable(F.col(f"`{vector}`"))).select(
            F.col(f"`{key}`").alias("id"), value.alias("v"), F.coalesce(wanted, F.lit(False)).alias("asks")
        )

    rows = taking_part(vectors)
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    facts = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("most"))
    top = facts.orderBy(F.desc("n"), F.desc("d")).first()
    answer = f"query_id {kind}, rank int, `{key}` {kind}, score double"
    if top is None:
        return vectors.sparkSession.createDataFrame([], answer)
    d, n, longest = top["d"], top["n"], top["most"]
    rows = rows.where(F.size("v") == d)
    # Components are kept as they were given.
    float_ = np.float32 if vectors.schema[vector].dataType.elementType == FloatType() else np.float64
    directions = np.random.default_rng(SEED).standard_normal((d + 1, DIRECTIONS))

    def project(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0.0))
        return x @ directions[:d] + rest[:, None] * directions[d]

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(SLICE_BYTES // (8 * d), 1)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            yield pa.record_batch([pa.array([project(matrix(batch.column(0))).tobytes()], pa.binary())], ["p"])

    share = F.pmod(F.xxhash64(f"`{key}`"), F.lit(1 << 30)) < F.lit(min(1 << 30, int(FIT_ROWS / n * (1 << 30))))
    fitted = taking_part(vectors.where(share)).where(F.size("v") == d)
    points = fitted.select("v").mapInArrow(sample, "p binary").toPandas()["p"]
    depth = min(max(math.ceil(math.log2(max(n / CELL_ROWS, 1))), 0), int(math.log2(MOST_CELLS)))
    tree = Tree(np.frombuffer(b"".join(points), dtype=np.float64).reshape(-1, DIRECTIONS), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            x = np.ascontiguousarray(matrix(batch.column(1)))
            asks = batch.column(2).to_pylist()
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([r.tobytes() if own else None for own, r in zip(asks, x)], pa.binary()),
                    pa.array([r.tobytes() for r in x.astype(float_)], pa.binary()),
                    pa.array(tree.cells(project(x))),
                ],
                ["id", "q", "x", "cell"],
            )

    placed = rows.select("id", "v", "asks").mapInArrow(place, f"id {kind}, q binary, x binary, cell bigint")
    placed = scratch.store(placed, "placed")
    # The bytes of doubles decide which of several vectors asks.
    asking = placed.where(F.col("q").isNotNull()).groupBy("id").agg(F.min_by("x", "q").alias("x"))
    asking = scratch.store(asking, "asking")
    # A cell of many rows is cut into parts by the hash of the key; at most MOST_CELLS cells.
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    tasks = PACKS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    cells = packed(sizes, min(max(n / tasks, CELL_ROWS), PACK_BYTES / (8 * d)))
    packs = 1 + max(p for _, of, _ in cells for p in of)
    # What is known of the cells comes from the driver; at most a row for each cell and pack.
    local = lambda rows, names: F.broadcast(
        vectors.sparkSession.createDataFrame(pa.table([pa.array(c) for c in zip(*rows)], names=names))
    )
    spots = local(cells, ["cell", "packs", "places"])
    words = [f"bits{w}" for w in range(WORDS)]
    masks: dict[tuple[int, int], list[int]] = {}
    for cell, of, places in cells:
        for pack, at in zip(of, places):
            masks.setdefault((cell, pack), [0] * WORDS)[at // BITS] |= 1 << at % BITS
    reached = local([(*own, *mask) for own, mask in masks.items()], ["cell", "pack", *words])
    part = F.pmod(F.xxhash64("id"), F.size("packs")).cast("int")
    held = placed.join(spots, "cell").select(
        F.get("packs", part).cast("int").alias("pack"), F.get("places", part).alias("place"), "id", "x", "cell"
    )
    radius = chi_square_radius(confidence)

    def known(worst: pa.Array) -> np.ndarray:
        worst = worst.to_numpy(zero_copy_only=False).astype(float)
        return np.where(np.isnan(worst), -np.inf, worst)

    def visits(batches: Iterator[pa.RecordBatch], begin: int, end: int) -> Iterator[pa.RecordBatch]:
        """Cells in the places ``begin`` to ``end`` of each query's order, as far as its radius reaches."""
        step = max(GAPS >> tree.depth, 1)
        for whole in some(batches):
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = _floats(batch.column(1), d, float_).astype(float)
                worst = known(batch.column(2))
                # The added component of a query is zero.
                gap = tree.distances(x @ directions[:d])
                near = gap <= _reach(longest, (x * x).sum(axis=1), worst, radius)[:, None]
                own, to = np.nonzero(near & _first(gap, end) & ~_first(gap, begin))
                yield pa.record_batch([batch.column(0).take(pa.array(own)), pa.array(to)], ["query_id", "cell"])

    def compared(batch: pa.RecordBatch, parts: dict[int, Cell]) -> Iterator[pa.RecordBatch]:
        """The best ``k`` rows of a pack for each query of the batch."""
        q = _floats(batch.column(2), d, float_).astype(float)
        asked = Queries(batch.column(1), q, q @ directions[:d], known(batch.column(3)), longest)
        bits = [batch.column(4 + w).to_numpy(zero_copy_only=False).astype(np.int64) for w in range(WORDS)]
        hits = []
        for spot, cell in parts.items():
            own = np.flatnonzero(bits[spot // BITS] >> spot % BITS & 1)
            for at in range(0, len(own), BLOCK):
                a, b, score = cell.search(asked, own[at : at + BLOCK], radius)
                hits.append((a, cell.names[b], score, cell.ids.take(pa.array(b))))
        if hits:
            a, names, score = (np.concatenate([h[j] for h in hits]) for j in range(3))
            if len(a):
                order = _top(k, a, names, score)
                ids = pa.concat_arrays([h[3] for h in hits]).take(pa.array(order))
                yield pa.record_batch(
                    [batch.column(1).take(pa.array(a[order])), ids, pa.array(score[order])], ["query_id", "id", "score"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pack's rows, part by part, and then the queries that visit it."""
        rows, parts = [], {}
        for batch in batches:
            cut = int(np.searchsorted(batch.column(0).to_numpy(zero_copy_only=False), BITS * WORDS))
            if cut:
                rows.append(batch.slice(0, cut))
            if cut < batch.num_rows and rows:
                of = np.concatenate([r.column(0).to_numpy(zero_copy_only=False) for r in rows])
                ids = pa.concat_arrays([r.column(1) for r in rows])
                x = np.concatenate([_floats(r.column(2), d, float_) for r in rows])
                rows.clear()
                for spot in np.unique(of).tolist():
                    low, high = np.searchsorted(of, [spot, spot + 1]).tolist()
                    own = x[low:high]
                    parts[spot] = Cell(ids.slice(low, high - low), own, project(own.astype(float)), k, longest)
                del x, ids
            for queries in some([batch.slice(cut)]):
                yield from compared(queries, parts)

    def verified(sent: DataFrame, asking: DataFrame) -> DataFrame:
        # A query goes once to each pack that holds some of its cells.
        bits = sent.join(reached, "cell").groupBy("query_id", "pack").agg(*(F.bit_or(w).alias(w) for w in words))
        asks = bits.join(asking.withColumnRenamed("id", "query_id"), "query_id").select(
            F.col("pack").cast("int"), F.lit(BITS * WORDS).cast("bigint").alias("place"),
            F.col("query_id").alias("id"), "x", "worst", *words,
        )
        visited = held.join(F.broadcast(sent.select("cell").distinct()), "cell", "left_semi").select(
            "pack", "place", "id", "x", F.lit(None).cast("double").alias("worst"),
            *(F.lit(None).cast("bigint").alias(w) for w in words),
        )
        both = visited.union(asks).repartitionById(packs, "pack").sortWithinPartitions("place")
        return both.drop("pack").mapInArrow(meet, f"query_id {kind}, id {kind}, score double")

    def ranked(hits: DataFrame) -> DataFrame:
        """At most ``k`` hits from each pack."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    many = asking.count()
    turns = max(math.ceil(many * packs / max(n, TURN_BYTES / (8 * d))), 1)
    spread = min(max(math.ceil(many * 2**depth / GAPS_PER_TASK / turns), 1), tasks)
    best, begin, size = None, 0, FIRST_CELLS
    while begin < 2**depth:
        worst = asking.withColumn("worst", F.lit(None).cast("double"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("worst"))
            worst = asking.join(kth, "id", "left").select("id", "x", "worst")
        hits, went = [], False
        for turn in range(turns):
            asks = worst.where(F.pmod(F.xxhash64("id", F.lit(turns)), F.lit(turns)) == turn) if turns > 1 else worst
            sent = asks.repartition(spread, "id").mapInArrow(
                lambda b, begin=begin, end=begin + size: visits(b, begin, end), f"query_id {kind}, cell bigint"
            )
            sent = scratch.store(sent, "visits")
            if not sent.isEmpty():
                went = True
                hits.append(verified(sent, asks))
                if turns > 1:
                    hits[-1] = scratch.store(hits[-1], "hits")
            if turns > 1 or not hits:
                scratch.drop(sent)
        if not went:
            # No radius reaches the next cell, let alone those behind it.
            break
        more = [best.drop("rank")] if best is not None else []
        more = scratch.store(ranked(functools.reduce(DataFrame.union, more + hits)), "best")
        for done in ([best] if best is not None else []) + (hits if turns > 1 else [sent]):
            scratch.drop(done)
        best, begin, size = more, begin + size, FURTHER * size
    if best is None:
        return vectors.sparkSession.createDataFrame([], answer)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


@query("op10_nearest_vectors")
def _op10(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
