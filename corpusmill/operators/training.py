"""Training a text classifier on labelled rows and measuring it.

A multinomial regression on hashed tokens whose weights carry over: from epoch to epoch, and from
one training set to the next larger one. An epoch is one pass over stored token slots, in which
every task adds up its share of the gradient; the driver sees sums per class and slot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.operators.active import BATCH_SIZE, SEED, run_cycle
from corpusmill.settings import cut_lineage, join_small

FEATURES = 1 << 12
EPOCHS = 5
PENALTY = 1e-4
_FLOOR = 1e-15
# Sums are whole multiples of this, so they do not depend on the order of tasks. What is summed are
# means over rows, which stay below 2**13.
_UNIT = 2.0**-50
# Rows of a batch that are scored in one go.
_ROWS = 2_000


@dataclass(frozen=True)
class TextClassifier:
    """Classes in label order and their weights, a column per slot and one for the bias.

    ``ahead`` and ``pace`` are the state of the optimiser, so that training goes on where it stopped.
    """

    labels: tuple[str, ...]
    weights: np.ndarray
    ahead: np.ndarray
    pace: float = 1.0

    @property
    def features(self) -> int:
        return self.weights.shape[1] - 1


def untrained(labels: list[str], features: int = FEATURES) -> TextClassifier:
    """All classes equally likely."""
    zero = np.zeros((len(labels), features + 1))
    return TextClassifier(tuple(labels), zero, zero)


def token_slots(text: Column, features: int = FEATURES) -> Column:
    """One slot per token, by the CRC-32 of its bytes; a null text has none."""
    slots = F.transform(tokens(text), lambda t: F.pmod(F.crc32(t), F.lit(features)).cast("int"))
    return F.coalesce(slots, F.array().cast("array<int>"))


class _Cells:
    """Token counts of a batch of texts, each text scaled to length 1, and a bias."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray, features: int):
        self.rows, self.features = len(counts), features
        pairs, times = np.unique(np.repeat(np.arange(self.rows), counts) * features + flat, return_counts=True)
        self.row, self.slot = pairs // features, pairs % features
        norm = np.sqrt(np.bincount(self.row, times.astype(float) ** 2, self.rows))
        self.value = times / norm[self.row]

    def probabilities(self, weights: np.ndarray) -> np.ndarray:
        scores = np.stack([np.bincount(self.row, self.value * w[self.slot], self.rows) + w[-1] for w in weights], axis=1)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def gradient(self, error: np.ndarray) -> np.ndarray:
        """Sum of ``error`` times the cells, a row per class."""
        sums = [np.bincount(self.slot, self.value * e[self.row], self.features) for e in error.T]
        return np.column_stack([np.array(sums), error.sum(axis=0)])

    def reach(self, counted: np.ndarray) -> np.ndarray:
        """Sum of each cell times the sum of its row: bounds the curvature along a slot."""
        total = (np.bincount(self.row, self.value, self.rows) + 1) * counted
        return np.append(np.bincount(self.slot, self.value * total[self.row], self.features), total.sum())


def _batches(batch: pa.RecordBatch, features: int) -> Iterator[tuple[_Cells, slice]]:
    for start in range(0, batch.num_rows, _ROWS):
        part = batch.column(0).slice(start, _ROWS)
        counts = part.value_lengths().to_numpy(zero_copy_only=False)
        flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield _Cells(flat, counts, features), slice(start, start + len(part))


def vectors(df: DataFrame, labels: list[str], features: int = FEATURES, *kept: str) -> DataFrame:
    """``(slots, y)`` and ``kept`` columns: token slots and the place of the label, -1 for none of them."""
    place = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("label_text")) - 1
    return df.select(
        token_slots(F.col("text"), features).alias("slots"), F.coalesce(place, F.lit(-1)).cast("int").alias("y"), *kept
    )


def _sums(rows: DataFrame, model: TextClassifier, sizes: dict[bool, int]) -> tuple[np.ndarray, np.ndarray, dict[bool, float]]:
    """Mean gradient where the next step starts, curvature bounds, and mean loss of both sides.

    ``rows (slots, y, val)`` are read once. ``sizes`` counts the rows of each side; rows of the
    validation side only add to their loss.
    """
    features, classes = model.features, len(model.labels)
    weights, ahead = model.weights, model.ahead

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes + 1, features + 1))
        losses = np.zeros(2)
        for batch in batches:
            y, val = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for cells, spot in _batches(batch, features):
                own, held = y[spot], val[spot].astype(bool)
                known = np.flatnonzero(own >= 0)
                truth = np.zeros((cells.rows, classes))
                truth[known, own[known]] = 1
                fit = (~held & (own >= 0)).astype(float)
                p = cells.probabilities(weights)
                loss = -np.log(np.maximum((p * truth).sum(axis=1), _FLOOR))
                losses += [loss[~held].sum(), loss[held].sum()]
                error = p if ahead is weights else cells.probabilities(ahead)
                total[:classes] += cells.gradient((error - truth) * fit[:, None])
                total[classes] += cells.reach(fit)
        total /= max(sizes.get(False, 0), 1)
        losses /= [max(sizes.get(False, 0), 1), max(sizes.get(True, 0), 1)]
        part, slot = np.nonzero(total)
        values = np.append(total[part, slot], losses)
        yield pa.record_batch(
            [
                pa.array(np.append(part, [classes + 1, classes + 1]).astype(np.int32)),
                pa.array(np.append(slot, [0, 1]).astype(np.int32)),
                pa.array(np.round(values / _UNIT).astype(np.int64)),
            ],
            ["part", "slot", "v"],
        )

    told = rows.select("slots", "y", "val").mapInArrow(work, "part int, slot int, v bigint")
    sums = np.zeros((classes + 2, features + 1))
    # A number per class and slot, however many rows there are.
    for r in told.groupBy("part", "slot").agg(F.sum("v").alias("v")).collect():
        sums[r["part"], r["slot"]] = r["v"] * _UNIT
    return sums[:classes], sums[classes], {False: sums[classes + 1, 0], True: sums[classes + 1, 1]}


def _step(model: TextClassifier, gradient: np.ndarray, reach: np.ndarray) -> TextClassifier:
    """The minimum of a bound on the loss around ``ahead``, and an accelerated start for the next.

    The curvature of the loss along a slot is at most half of ``reach``, so every step is safe
    without trying lengths.
    """
    shrink = np.append(np.full(model.features, PENALTY), 0.0)
    down = (gradient + shrink * model.ahead) / np.maximum(0.5 * reach + shrink, 1e-12)
    weights = model.ahead - down
    pace = (1 + math.sqrt(1 + 4 * model.pace**2)) / 2
    return TextClassifier(model.labels, weights, weights + (model.pace - 1) / pace * (weights - model.weights), pace)


def _sizes(rows: DataFrame) -> dict[bool, int]:
    return {r["val"]: r["n"] for r in rows.groupBy("val").agg(F.count(F.lit(1)).alias("n")).collect()}


def train_more(model: TextClassifier, rows: DataFrame, epochs: int, sizes: dict[bool, int] | None = None) -> TextClassifier:
    """``epochs`` further passes over ``rows (slots, y, val)``, which should be stored."""
    sizes = sizes or _sizes(rows)
    for _ in range(epochs):
        gradient, reach, _ = _sums(rows, model, sizes)
        model = _step(model, gradient, reach)
    return model


def class_names(df: DataFrame) -> list[str]:
    """Labels in order; they are as many as there are classes."""
    return [r[0] for r in df.select("label_text").where("label_text IS NOT NULL").distinct().orderBy("label_text").collect()]


def train_classifier(train: DataFrame, epochs: int = EPOCHS, features: int = FEATURES) -> TextClassifier:
    """Fit on ``text`` and ``label_text``: one pass over the stored slots per epoch."""
    labels = class_names(train)
    rows = cut_lineage(vectors(train, labels, features).withColumn("val", F.lit(False)))
    return train_more(untrained(labels, features), rows, epochs)


def _probability(model: TextClassifier, slots: Column) -> Column:
    def score(column: pd.Series) -> pd.Series:
        batch = pa.record_batch([pa.array(column, pa.list_(pa.int32()))], ["slots"])
        found = [p for cells, _ in _batches(batch, model.features) for p in cells.probabilities(model.weights)]
        return pd.Series(found)

    return F.pandas_udf(score, "array<double>")(slots)


def _told(model: TextClassifier, df: DataFrame, slots: Column) -> DataFrame:
    classes = F.array(*[F.lit(c) for c in model.labels])
    best = F.array_position("probability", F.array_max("probability")).cast("int")
    scored = df.withColumn("probability", _probability(model, slots))
    return scored.withColumn("prediction_text", F.element_at(classes, best))


def predict(model: TextClassifier, df: DataFrame) -> DataFrame:
    """Adds ``prediction_text`` and ``probability`` (array, classes in label order).

    A text without tokens is scored by the biases alone; of equal classes the first is told.
    """
    scored = _told(model, df, token_slots(F.col("text"), model.features))
    return scored.select(*df.columns, "prediction_text", "probability")


def training_losses(
    train: DataFrame, val: DataFrame, epochs: int = EPOCHS, features: int = FEATURES
) -> DataFrame:
    """Loss on both sides after each epoch: ``(epoch, train_loss, val_loss)``.

    Mean negative log probability of the true class; classes never seen in training count as
    impossible. Each pass tells the losses before its own step, so there is one more pass than
    epochs. A side without rows has the loss 0.
    """
    labels = class_names(train)
    sides = vectors(train, labels, features).withColumn("val", F.lit(False))
    rows = cut_lineage(sides.union(vectors(val, labels, features).withColumn("val", F.lit(True))))
    sizes, model, told = _sizes(rows), untrained(labels, features), []
    for epoch in range(epochs + 1):
        gradient, reach, losses = _sums(rows, model, sizes)
        if epoch:
            told.append((epoch, float(losses[False]), float(losses[True])))
        model = _step(model, gradient, reach)
    return train.sparkSession.createDataFrame(told, "epoch int, train_loss double, val_loss double")


def evaluate(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: evaluated rows, accuracy and macro F1 over all classes seen on either side."""
    cells = (
        df.select(F.col(truth).cast("string").alias("t"), F.col(prediction).cast("string").alias("p"))
        .where("t IS NOT NULL AND p IS NOT NULL")
        .groupBy("t", "p")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n = F.col("n")
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("t") == F.col("p"), n).otherwise(none)
    sides = F.array(
        F.struct(F.col("t").alias("c"), n.alias("support"), none.alias("called"), hit.alias("hit")),
        F.struct(F.col("p").alias("c"), none.alias("support"), n.alias("called"), none.alias("hit")),
    )
    per_class = (
        cells.select(F.explode(sides).alias("s"))
        .groupBy("s.c")
        .agg(
            F.sum("s.support").alias("support"), F.sum("s.called").alias("called"), F.sum("s.hit").alias("hit")
        )
    )
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("called"))
    return per_class.agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("evaluated_rows"),
        (F.sum("hit") / F.nullif(F.sum("support"), F.lit(0))).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
    )


def uncertainty_scores(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """Adds ``entropy`` and ``margin`` (best minus second best) of the class probabilities."""
    p = F.col(probability)
    entropy = F.aggregate(
        p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.log(x)).otherwise(0.0)
    )
    ranked = F.sort_array(p, asc=False)
    margin = F.try_element_at(ranked, F.lit(1)) - F.coalesce(F.try_element_at(ranked, F.lit(2)), F.lit(0.0))
    return scored.withColumns({"entropy": entropy, "margin": margin})


def learning_curve(
    labeled: DataFrame,
    pool: DataFrame,
    val: DataFrame,
    key: str,
    strategies: tuple[str, ...] = ("entropy", "random"),
    n_iterations: int = 3,
    batch_size: int = BATCH_SIZE,
    epochs: int = EPOCHS,
    features: int = FEATURES,
    seed: int = SEED,
) -> DataFrame:
    """Quality against the number of labelled rows for each strategy.

    ``pool`` holds the labels that acquiring a row reveals. Texts are turned into slots once. A
    round goes on from the weights of the round before, with ``epochs`` passes over its rows.
    """
    start, rest, held = (cut_lineage(df.select(key, "text", "label_text")) for df in (labeled, pool, val))
    labels = class_names(start.union(rest))
    slots = [vectors(df, labels, features, key, "label_text") for df in (start, rest, held)]
    since = [F.lit(0), F.lit(None), F.lit(0)]
    every = [d.withColumns({"val": F.lit(i == 2), "since": s.cast("int")}) for i, (d, s) in enumerate(zip(slots, since))]
    every = cut_lineage(reduce(DataFrame.union, every))
    rows = []
    for strategy in strategies:
        _, acquired = run_cycle(start, rest, key, "text", strategy, n_iterations, batch_size, seed)
        bought = acquired.select(key, F.col("iteration").alias("bought"), F.lit(False).alias("val"))
        known = join_small(every, bought, [key, "val"], "left")
        known = cut_lineage(known.withColumn("since", F.coalesce("since", "bought")).where("since IS NOT NULL"))
        counts = known.where("NOT val").groupBy("since").agg(F.count(F.lit(1)).alias("n")).collect()
        model = untrained(labels, features)
        for iteration in range(1, n_iterations + 1):
            train = known.where((F.col("since") < iteration) & ~F.col("val"))
            n = sum(r["n"] for r in counts if r["since"] < iteration)
            model = train_more(model, train, epochs, {False: n})
            scored = _told(model, known.where("val"), F.col("slots"))
            quality = evaluate(scored, "label_text", "prediction_text")
            told = [F.lit(strategy).alias("strategy"), F.lit(iteration).alias("iteration"), F.lit(n).cast("long").alias("n_labeled")]
            rows.append(quality.select(*told, "accuracy", "macro_f1"))
    return reduce(DataFrame.unionByName, rows)


def labels_saved(curve: DataFrame, base: str = "random", other: str = "entropy") -> DataFrame:
    """Labels that ``other`` saves against ``base`` at the quality ``base`` ends with."""
    goal = curve.where(F.col("strategy") == base).agg(F.max_by("macro_f1", "iteration").alias("goal"))
    reached = curve.withColumn("goal", goal.scalar()).where(F.col("macro_f1") >= F.col("goal"))
    need = reached.groupBy().agg(
        F.any_value("goal").alias("macro_f1"),
        F.min(F.when(F.col("strategy") == base, F.col("n_labeled"))).alias("base_labels"),
        F.min(F.when(F.col("strategy") == other, F.col("n_labeled"))).alias("other_labels"),
    )
    return need.withColumn("labels_saved", F.col("base_labels") - F.col("other_labels"))
