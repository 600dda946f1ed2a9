"""Exact quantiles and fences that never gather a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rank error of the sketch is 1/SKETCH_ACCURACY; the bracket around a wanted rank is a few times
# wider. A bracket that misses its rank all the same is drawn wider and tried again.
SKETCH_ACCURACY = 10_000
_MARGIN = 4.0 / SKETCH_ACCURACY
# Brackets are narrowed until at most so many values lie strictly inside.
BRACKET_VALUES = 2_000

IQR_FACTOR = 1.5
Z_LIMIT = 3.0


def finite(name: str) -> Column:
    """A numeric cell as double, NaN as null."""
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


class _Bracket:
    """Bounds that hold a wanted rank, and what is known about the rows around them."""

    def __init__(self, column: int, k: int, p: float):
        self.column, self.k, self.p = column, k, p
        self.low, self.high = float("-inf"), float("inf")
        self.rows = self.below = self.inside = self.between = 0
        self.margin = _MARGIN
        self.wider: tuple | None = None

    def ranks(self) -> tuple[int, int]:
        rank = self.p * (self.rows - 1)
        return math.floor(rank), math.ceil(rank)

    def holds(self) -> bool:
        first, last = self.ranks()
        return self.below <= first and last < self.below + self.inside

    def done(self) -> bool:
        return self.between <= BRACKET_VALUES or self.low == self.high

    def counts(self, v: Column) -> list[Column]:
        within = v.between(F.lit(self.low), F.lit(self.high))
        strictly = (v > F.lit(self.low)) & (v < F.lit(self.high))
        cells = (F.count_if(v < F.lit(self.low)), F.count_if(within), F.count_if(strictly))
        return [c.cast("double") for c in cells]

    def near(self, v: Column) -> Column:
        """Two values of the bracket that enclose its ranks, by the sketch of what is inside."""
        first, last = ((r - self.below) / max(self.inside - 1, 1) for r in self.ranks())
        wanted = [max(first - self.margin, 0.0), min(last + self.margin, 1.0)]
        return F.percentile_approx(
            F.when(v.between(F.lit(self.low), F.lit(self.high)), v), wanted, SKETCH_ACCURACY
        )


def _ask(df: DataFrame, cells: list[Column]) -> list:
    """Aggregates of one pass, as one row of the driver."""
    return list(df.agg(F.array(*cells).alias("a")).first()["a"]) if cells else []


def _brackets(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> list[_Bracket]:
    """Narrow brackets for every wanted rank of every column.

    The first pass counts and sketches, one sketch per column for all its ranks. Then counting and
    sketching passes take turns; each sketch leaves a fixed small share of the values inside, so a
    few passes do for any number of rows. The driver sees a few numbers per rank.
    """
    brackets = [_Bracket(i, k, p) for i in range(len(columns)) for k, p in enumerate(probs)]
    if not brackets:
        return []
    values = [finite(name) for name in columns]
    wanted = [f for p in probs for f in (max(p - _MARGIN, 0.0), min(p + _MARGIN, 1.0))]
    first = df.agg(
        F.array(*[F.count(v) for v in values]).alias("rows"),
        F.array(*[F.percentile_approx(v, wanted, SKETCH_ACCURACY) for v in values]).alias("near"),
    ).first()
    for b in brackets:
        b.rows = b.inside = b.between = first["rows"][b.column]
        if b.rows > BRACKET_VALUES:
            b.wider = (b.low, b.high, 0, b.rows, b.rows)
            b.low, b.high = first["near"][b.column][2 * b.k : 2 * b.k + 2]
    todo = [b for b in brackets if b.rows > BRACKET_VALUES]
    while todo:
        told = _ask(df, [c for b in todo for c in b.counts(values[b.column])])
        for b, (below, inside, between) in zip(todo, (told[i : i + 3] for i in range(0, len(told), 3))):
            b.below, b.inside, b.between = int(below), int(inside), int(between)
            if not b.holds():
                # Back to the bounds before, and wider ones within them.
                b.low, b.high, b.below, b.inside, b.between = b.wider
                b.margin *= 4
        todo = [b for b in todo if not b.done()]
        near = _ask(df, [b.near(values[b.column]) for b in todo])
        for b, (low, high) in zip(todo, near):
            b.wider = (b.low, b.high, b.below, b.inside, b.between)
            b.low, b.high = low, high
    return [b for b in brackets if b.rows]


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles: ``(column, n, q array<double>)``.

    The last pass counts the distinct values inside the brackets, which the map side folds, and
    sorts those few: no task gets more than ``BRACKET_VALUES`` and the two bounds, whatever the
    number of rows. NaN counts as missing; a column without values has no row.
    """
    probs = list(probs)
    brackets = _brackets(df, columns, probs)
    names = F.array(*[F.lit(name) for name in columns])
    shape = "c int, k int, low double, high double, below bigint, n bigint"
    bounds = [(b.column, b.k, b.low, b.high, b.below, b.rows) for b in brackets]
    # One row per wanted rank.
    held = F.broadcast(df.sparkSession.createDataFrame(bounds, shape))
    cells = [F.struct(F.lit(i).alias("c"), finite(n).alias("v")) for i, n in enumerate(columns)]
    values = df.select(F.explode(F.array(*cells)).alias("r")).select("r.*").where("v IS NOT NULL")
    order = Window.partitionBy("c", "k").orderBy("v")
    counted = (
        values.join(held, "c")
        .where("v BETWEEN low AND high")
        .groupBy("c", "k", "below", "n", "v")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("upto", F.col("below") + F.sum("times").over(order))
    )
    rank = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("k") + 1) * (F.col("n") - 1)
    ranked = counted.withColumn("rank", rank)
    low = F.min(F.when(F.col("upto") > F.floor("rank"), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("v")))
    part = F.first(F.col("rank") - F.floor("rank"))
    points = ranked.groupBy("c", "k", "n").agg((low + (high - low) * part).alias("q"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda s: s["q"])
    return points.groupBy("c", "n").agg(ordered.alias("q")).select(
        F.element_at(names, F.col("c") + 1).alias("column"), "n", "q"
    )


def quantile_map(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True
) -> DataFrame:
    """One row, one column ``q``: map from column name to its quantiles.

    ``exact=False`` takes the sketch's answer and saves the second pass.
    """
    if not exact:
        near = [
            F.struct(F.lit(c), F.percentile_approx(finite(c), list(probs), SKETCH_ACCURACY))
            for c in columns
        ]
        return df.agg(F.map_from_entries(F.array(*near)).alias("q"))
    # One entry per named column, so the list is as long as the schema is wide.
    return quantile_table(df, columns, probs).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("q")
    )


def with_scalar(df: DataFrame, name: str, one_value: DataFrame) -> DataFrame:
    """Add the single value of a one-row frame as a column.

    The subquery runs once before the scan of ``df``; nothing is joined.
    """
    return df.withColumn(name, one_value.scalar())


def quantile_at(name: str, column: str, k: int) -> Column:
    """The ``k``-th quantile of ``column`` in a map added by :func:`with_scalar`."""
    return F.try_element_at(F.col(name), F.lit(column))[k]


def fences(name: str, column: str, lower: int = 0, upper: int = 1) -> tuple[Column, Column]:
    """Interquartile fences of ``column`` from a quartile map named ``name``."""
    q1, q3 = quantile_at(name, column, lower), quantile_at(name, column, upper)
    reach = F.lit(IQR_FACTOR) * (q3 - q1)
    return q1 - reach, q3 + reach


def rows_from(df: DataFrame, entries: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """Turn expressions over a one-row frame into tall metric rows."""
    cells = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(metric).alias("metric"),
            F.lit(column).alias("column"),
            value.cast("double").alias("value"),
        )
        for section, metric, column, value in entries
    ]
    return df.select(F.explode(F.array(*cells)).alias("m")).select("m.*")
