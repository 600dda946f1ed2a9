"""Choosing the rows to label next."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.answers import normalize_label
from corpusmill.functions.stats import quantile_at, quantile_map, with_scalar
from corpusmill.functions.text import SCORE_TOKEN, let, seeded_hash, seeded_uniform, tokens
from corpusmill.schema import string_columns
from corpusmill.settings import cut_lineage, join_small

# Column names that usually hold text.
TEXT_HINTS = [
    "text",
    "problem",
    "question",
    "prompt",
    "statement",
    "body",
    "content",
    "description",
    "title",
]

# How columns are scored as features.
PROMPT_WORD_SCORE = 3.0
HINT_SCORE = 4.0
LENGTH_UNIT, LENGTH_SCORE = 80.0, 4.0
LEAST_SCORE, NEAR_BEST = 3.0, 1.5
TEXT_LENGTH = 8

# Fixed value: the column that annotation leaves its labels in.
DEFAULT_TARGET = "annotation_label"

BATCH_SIZE = 20
TEST_SIZE = 0.25
SEED = 13
# Rows of a class are split by the first digits of their seeded hash.
_HEX_DIGITS = 4


# ------------------------------------------------------------------ labels and columns


def split_labeled_pool(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a target value, rows without."""
    return df.where(F.col(target).isNotNull()), df.where(F.col(target).isNull())


def with_label(df: DataFrame, target: str, name: str = "label_text") -> DataFrame:
    """Adds the label in its text form."""
    boolean = isinstance(df.schema[target].dataType, T.BooleanType)
    return df.withColumn(name, normalize_label(F.col(target), boolean))


def class_check(df: DataFrame, target: str) -> DataFrame:
    """Classes of the labelled rows with their sizes; fewer than two is an error."""
    labeled = with_label(df.where(F.col(target).isNotNull()), target)
    counts = labeled.groupBy("label_text").agg(F.count(F.lit(1)).alias("size"))
    total = counts.agg(F.count(F.lit(1)).alias("classes"))
    checked = F.when(
        F.col("classes") >= 2, F.col("size")
    ).otherwise(F.raise_error(F.lit("At least two classes are needed")).cast("bigint"))
    return with_scalar(counts, "classes", total).select("label_text", checked.alias("size"), "classes")


def infer_features(df: DataFrame, prompt: str, key: str, most: int = 3) -> DataFrame:
    """Scores of the text-like columns and which of them to use.

    A column is text-like when its first ten values are eight characters long on
    average. Words shared with the prompt, a usual name and long values raise
    its score; those close to the best one are selected.
    """
    asked = set(re.findall(SCORE_TOKEN, prompt.lower()))
    names = string_columns(df.schema)
    lengths = df.agg(
        F.lit(0).alias("_"), *[F.avg(F.length(n)).alias(f"a{i}") for i, n in enumerate(names)]
    )
    if names:
        # First values of all columns in one pass; the rank filter works per task before the shuffle.
        values = [F.when(F.col(n).isNotNull(), F.struct(F.lit(i).alias("c"), F.length(n).alias("size"))) for i, n in enumerate(names)]
        long = df.select(key, F.explode(F.array_compact(F.array(*values))).alias("r")).select(key, "r.*")
        spot = F.row_number().over(Window.partitionBy("c").orderBy(key))
        first = long.withColumn("spot", spot).where(F.col("spot") <= 10)
        means = [F.avg(F.when(F.col("c") == i, F.col("size"))).alias(f"f{i}") for i in range(len(names))]
        lengths = with_scalar(lengths, "f", first.agg(*means).select(F.struct(*[f"f{i}" for i in range(len(names))]).alias("f")))
    cells = []
    for i, name in enumerate(names):
        words = set(re.findall(SCORE_TOKEN, name.lower()))
        fixed = PROMPT_WORD_SCORE * len(asked & words) + HINT_SCORE * (name.lower() in TEXT_HINTS)
        score = F.lit(fixed) + F.least(F.col(f"a{i}") / LENGTH_UNIT, F.lit(LENGTH_SCORE))
        cells.append(
            F.when(F.col("f")[f"f{i}"] >= TEXT_LENGTH, F.struct(F.lit(name).alias("column"), score.alias("score")))
        )
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, score double, selected boolean")
    ranked = F.reverse(
        F.array_sort(F.transform(F.array_compact(F.array(*cells)), lambda c: F.struct(c["score"], c["column"])))
    )
    rows = lengths.select(ranked.alias("r")).where(F.size("r") > 0)
    near = F.greatest(F.lit(LEAST_SCORE), F.col("r")[0]["score"] - NEAR_BEST)
    return rows.select(near.alias("near"), F.posexplode("r").alias("p", "c")).select(
        "c.column",
        "c.score",
        ((F.col("c.score") >= F.col("near")) & (F.col("p") < most)).alias("selected"),
    )


def select_task_columns(
    df: DataFrame,
    prompt: str,
    key: str,
    features: Sequence[str] | None = None,
    target: str | None = None,
) -> tuple[list[str], str]:
    """Text columns and target of a task: what was asked for, else what fits the prompt.

    Asked features that the table lacks are left out; an asked target it lacks is an error, and so
    is a table without text columns or, when no target is asked for, without ``annotation_label``.
    """
    if not prompt:
        raise ValueError("A task needs a prompt")
    if features is not None:
        chosen = [name for name in features if name in df.columns]
    else:
        scored = infer_features(df, prompt, key).where("selected")
        # A handful: at most three columns are selected.
        chosen = [r["column"] for r in scored.orderBy(F.desc("score"), F.desc("column")).collect()]
    if not chosen:
        raise ValueError("No text column fits the task")
    wanted = DEFAULT_TARGET if target is None else target
    if wanted not in df.columns:
        raise ValueError(f"The target column {wanted!r} is not in the table")
    return chosen, wanted


def compose_text(df: DataFrame, columns: Sequence[str], prompt: str | None = None) -> Column:
    """Values of the columns on lines of their own, gaps left out, after the task."""
    parts = []
    for name in columns:
        text = F.col(name).cast("string")
        parts.append(F.initcap(text) if isinstance(df.schema[name].dataType, T.BooleanType) else text)
    body = F.concat_ws("\n", *parts)
    task = (prompt or "").strip()
    return F.concat(F.lit(f"Task: {task}\n"), body) if task else body


# ---------------------------------------------------------------------------- scores


def score_diversity(text: Column) -> Column:
    """Share of distinct tokens; 0 without any."""
    share = let(
        tokens(text), lambda t: F.size(F.array_distinct(t)) / F.when(F.size(t) > 0, F.size(t))
    )
    return F.coalesce(share, F.lit(0.0)).cast("float")


def score_margin(df: DataFrame, text: str, name: str = "score", exact: bool = True) -> DataFrame:
    """Adds closeness of the text length to the median length of the table."""
    sized = df.withColumn("__len", F.length(text).cast("double"))
    center = quantile_map(cut_lineage(sized.select("__len")), ["__len"], [0.5], exact)
    gap = F.abs(F.col("__len") - quantile_at("__q", "__len", 0))
    return with_scalar(sized, "__q", center).withColumn(
        name, (1.0 / (1.0 + gap)).cast("float")
    ).drop("__len", "__q")


def score_random(key: Column, seed: int = SEED) -> Column:
    """Repeatable value in [0, 1) for a seed."""
    return seeded_uniform(seed, key).cast("float")


def with_score(
    df: DataFrame, key: str, text: str, strategy: str = "entropy", seed: int = SEED, name: str = "score"
) -> DataFrame:
    """Adds the score of a strategy; an unknown name scores like ``entropy``."""
    if strategy == "margin":
        return score_margin(df, text, name)
    score = score_random(F.col(key), seed) if strategy == "random" else score_diversity(F.col(text))
    return df.withColumn(name, score)


# --------------------------------------------------------------------------- queries


def query_batch(df: DataFrame, key: str, score: str = "score", batch_size: int = BATCH_SIZE) -> DataFrame:
    """The best rows with their rank. Only ``batch_size`` rows ever meet in one task."""
    best = df.orderBy(F.desc(score), key).limit(batch_size)
    rank = F.row_number().over(Window.orderBy(F.desc(score), F.col(key)))
    return best.withColumn("rank", rank)


def enrich_queries(
    df: DataFrame,
    batch: DataFrame,
    key: str,
    target: str,
    features: Sequence[str],
    score: str = "score",
) -> DataFrame:
    """The full table with score, rank and selection of the queried rows."""
    slim = batch.select(
        key,
        F.col(score).cast("double").alias("active_learning_score"),
        F.col("rank").alias("active_learning_rank"),
    )
    return join_small(df, slim, key, "left").withColumns(
        {
            "active_learning_selected": F.col("active_learning_rank").isNotNull(),
            "active_learning_target_column": F.lit(target),
            "active_learning_feature_columns": F.lit(",".join(features)),
        }
    )


# ----------------------------------------------------------------------------- split


def validation_sizes(classes: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """Rows of each class for validation: ``(label_text, size, take)``.

    ``classes`` has one row per class. Shares are rounded down; what is left
    goes to the largest fractions, one each; every class keeps a row for training.
    """
    totals = classes.agg(
        F.struct(
            F.sum("size").alias("n"),
            F.count(F.lit(1)).alias("c"),
            F.sum(F.col("size") - 1).alias("most"),
        ).alias("t")
    )
    n, c, most = F.col("t.n"), F.col("t.c"), F.col("t.most")
    rounded = F.bround(n * F.lit(test_size), 0).cast("bigint")
    wanted = F.least(F.greatest(F.lit(1), F.least(n - c, rounded)), most)
    few = F.raise_error(F.lit("At least two classes are needed")).cast("bigint")
    wanted = F.when(n < 6, F.lit(0)).when(c < 2, few).otherwise(wanted)
    share = F.col("size") / n * F.col("wanted")
    based = (
        with_scalar(classes, "t", totals)
        .withColumn("wanted", wanted)
        .withColumn("cap", F.col("size") - 1)
        .withColumn("base", F.least(F.col("cap"), F.floor(share)))
        .withColumn("fraction", share - F.floor(share))
    )
    # One row per class.
    everywhere = Window.partitionBy(F.lit(0))
    order = Window.partitionBy("open").orderBy(F.desc("fraction"), F.desc("label_text"))
    extra = F.col("open") & (F.row_number().over(order) <= F.col("left"))
    return (
        based.withColumn("left", F.col("wanted") - F.sum("base").over(everywhere))
        .withColumn("open", F.col("base") < F.col("cap"))
        .select("label_text", "size", (F.col("base") + extra.cast("bigint")).alias("take"))
    )


def stratified_split(
    df: DataFrame, key: str, target: str, test_size: float = TEST_SIZE, seed: int = SEED
) -> DataFrame:
    """Adds ``split`` (``train`` or ``val``), every class in proportion.

    Within a class rows are ordered by a seeded hash and the first ones
    validate. The hash that ends them is found from counts per hash bucket and
    a look into one bucket per class, so no class is sorted as a whole.
    """
    rows = with_label(df, target, "__class").withColumn("__hash", seeded_hash(seed, F.col(key)))
    bucket = F.substring("__hash", 1, _HEX_DIGITS)
    counts = rows.groupBy(F.col("__class").alias("label_text"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("k")
    )
    classes = counts.groupBy("label_text").agg(F.sum("k").alias("size"))
    sizes = validation_sizes(classes, test_size).select("label_text", "take")

    upto = F.sum("k").over(Window.partitionBy("label_text").orderBy("bucket"))
    edge = (
        counts.withColumn("upto", upto)
        .join(sizes, "label_text")
        .where("take > 0 AND upto >= take AND upto - k < take")
        .select(
            F.col("label_text").alias("__class"),
            F.col("bucket").alias("__bucket"),
            (F.col("take") - F.col("upto") + F.col("k")).alias("rest"),
        )
    )
    slim = rows.select("__class", "__hash", key, bucket.alias("__bucket"))
    inside = join_small(slim, edge, ["__class", "__bucket"])
    rank = F.row_number().over(Window.partitionBy("__class").orderBy("__hash", key))
    last = (
        inside.withColumn("rank", rank)
        .where("rank = rest")
        .select("__class", F.col("__hash").alias("__last"), F.col(key).alias("__last_key"))
    )
    first = (F.col("__hash") < F.col("__last")) | (
        (F.col("__hash") == F.col("__last")) & (F.col(key) <= F.col("__last_key"))
    )
    return (
        join_small(rows, last, "__class", "left")
        .withColumn("split", F.when(first, "val").otherwise("train"))
        .drop("__class", "__hash", "__last", "__last_key")
    )


# ----------------------------------------------------------------------------- cycle


def run_cycle(
    labeled: DataFrame,
    pool: DataFrame,
    key: str,
    text: str,
    strategy: str = "entropy",
    n_iterations: int = 5,
    batch_size: int = BATCH_SIZE,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Repeatedly move the best batch from the pool to the labelled rows.

    Returns the history ``(iteration, n_labeled, strategy)`` and the acquired
    keys ``(key, iteration, rank)``. Entropy and random scores never change, so
    one ordering serves all rounds. The margin centre moves with the pool; each
    round then is one job over keys and lengths.
    """
    if strategy == "margin":
        acquired = _margin_rounds(pool, key, text, n_iterations, batch_size)
    else:
        scored = with_score(pool, key, text, strategy, seed).select(key, "score")
        ranked = query_batch(scored, key, "score", n_iterations * batch_size)
        acquired = ranked.select(
            key,
            F.ceil(F.col("rank") / batch_size).cast("int").alias("iteration"),
            (F.pmod(F.col("rank") - 1, F.lit(batch_size)) + 1).alias("rank"),
        )
    sizes = with_scalar(
        pool.agg(F.count(F.lit(1)).alias("pool")), "start", labeled.agg(F.count(F.lit(1)).alias("n"))
    )
    taken = F.least(F.col("pool"), (F.col("iteration") - 1) * F.lit(batch_size))
    last = F.least(F.lit(n_iterations), F.ceil(F.col("pool") / batch_size) + 1)
    history = (
        sizes.withColumn("iteration", F.explode(F.sequence(F.lit(1), last.cast("int"))))
        .select("iteration", (F.col("start") + taken).alias("n_labeled"), F.lit(strategy).alias("strategy"))
    )
    return history, acquired


def _margin_rounds(
    pool: DataFrame, key: str, text: str, n_iterations: int, batch_size: int
) -> DataFrame:
    slim = cut_lineage(pool.select(key, F.length(text).cast("double").alias("__size")))
    taken: DataFrame | None = None
    for iteration in range(1, n_iterations + 1):
        left = slim
        if taken is not None:
            left = join_small(slim, taken.select(key), key, "left_anti")
        center = quantile_map(left, ["__size"], [0.5])
        gap = F.abs(F.col("__size") - quantile_at("__q", "__size", 0))
        scored = with_scalar(left, "__q", center).select(key, (1.0 / (1.0 + gap)).cast("float").alias("score"))
        batch = query_batch(scored, key, "score", batch_size).select(
            key, F.lit(iteration).alias("iteration"), F.col("rank")
        )
        # Batches are small; cutting here keeps every round's plan the same size.
        taken = cut_lineage(batch if taken is None else taken.union(batch))
    return taken if taken is not None else slim.select(key, F.lit(0).alias("iteration"), F.lit(0).alias("rank")).limit(0)


def al_summary(
    df: DataFrame, target: str, strategy: str, selected: str = "active_learning_selected"
) -> DataFrame:
    """One row: labelled, pool and selected rows, classes, strategy."""
    boolean = isinstance(df.schema[target].dataType, T.BooleanType)
    return df.agg(
        F.count(target).alias("labeled_rows"),
        F.count_if(F.col(target).isNull()).alias("pool_rows"),
        F.count_if(F.coalesce(F.col(selected), F.lit(False))).alias("selected_rows"),
        F.count_distinct(normalize_label(F.col(target), boolean)).alias("classes"),
        F.lit(strategy).alias("strategy"),
    )


def loss_history(df: DataFrame, metrics: str, key: str) -> DataFrame:
    """Per training run the rows of its ``loss_history``, in epoch order.

    Rows without one of the losses are dropped, a missing epoch is the position.
    A run with no usable row is an error.
    """
    entry = "array<struct<epoch:int,train_loss:double,val_loss:double>>"
    listed = F.from_json(F.get_json_object(metrics, "$.loss_history"), entry)
    numbered = F.transform(
        F.coalesce(listed, F.array()),
        lambda r, i: F.struct(
            F.coalesce(r["epoch"], i + 1).alias("epoch"),
            r["train_loss"].alias("train_loss"),
            r["val_loss"].alias("val_loss"),
        ),
    )
    usable = F.filter(numbered, lambda r: r["train_loss"].isNotNull() & r["val_loss"].isNotNull())
    checked = F.when(F.size("h") > 0, F.col("h")).otherwise(
        F.raise_error(F.lit("loss_history is empty or malformed")).cast("array<struct<epoch:int,train_loss:double,val_loss:double>>")
    )
    return (
        df.select(key, F.array_sort(usable).alias("h"))
        .select(key, F.explode(checked).alias("r"))
        .select(key, "r.epoch", "r.train_loss", "r.val_loss")
    )
