"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the exponential of a linear score, capped. Among all rates that meet
the token constraints of a source these stay closest, token by token, to taking everything once.
The dual is convex; each Newton step is one aggregation over slim rows. Rates are then rounded to
whole copies so that the rounding errors cancel within small groups. A uniform rate per source meets
the constraints of the query; a margin asks for more, and tilts documents against each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.base import query, sql_type, table
from corpusmill.settings import cut_lineage, join_small

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
MAX_STEPS = 40
TOLERANCE = 1e-7
# Rounding works on groups of about this many documents of one source.
GROUP_ROWS = 4096


def word_count(text: Column) -> Column:
    """Runs without space and ``\\x09-\\x0D``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: Column) -> DataFrame:
    """Add ``target``: ``total`` shared by ``weight``, no source above ``cap``.

    One row per source comes in. What a full source cannot take goes to the others by weight. In
    the order of cap over weight the full ones come first, so two running sums find the level.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = sources.withColumn("__i", F.row_number().over(order)).withColumn(
        "__level", (total - F.coalesce(before, F.lit(0.0))) / behind
    )
    is_open = F.col("__level") < F.col("cap") / F.col("weight")
    every = Window.partitionBy(F.lit(1))
    first = F.min(F.when(is_open, F.struct("__i", "__level"))).over(every)
    target = F.when(
        F.col("__first").isNull() | (F.col("__i") < F.col("__first.__i")), F.col("cap")
    ).otherwise(F.col("__first.__level") * F.col("weight"))
    return (
        ranked.withColumn("__first", first)
        .withColumn("target", target)
        .drop("__i", "__level", "__first")
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``(__s, source_size, rows, target)`` for rows of ``(__s, __null, __size)``.

    Sources in code point order, null last, take the weights in turn. The table has one row per
    source, so its windows are as small as the list of sources.
    """
    sources = sizes.groupBy("__s", "__null").agg(
        F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    place = F.row_number().over(Window.orderBy("__null", "__s")) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))) + 1)
    sources = (
        sources.withColumn("place", place)
        .withColumn("weight", turn)
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    )
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(share))
    filled = water_fill(sources.withColumn("__total", total), F.col("__total"))
    return filled.select("__s", "source_size", "rows", "target")


def _newton(state: DataFrame, cap: float) -> DataFrame:
    """One step for every source: gradient and curvature have been summed over its documents."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            after = []
            for now, g, h, b in zip(batch["tilt"], batch["g"], batch["h"], batch["goal"]):
                now, g, b = (np.array(v, dtype=float) for v in (now, g, b))
                curve = np.array(h, dtype=float).reshape(len(g), len(g))
                scale = max(np.trace(curve), 1e-300)
                move = np.linalg.lstsq(curve / scale, (b - g) / scale, rcond=1e-10)[0]
                # Long steps are cut, and the common tilt never passes the cap: beyond it
                # nothing bends any more.
                move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-300))
                now = now + move
                now[0] = min(now[0], math.log(cap))
                after.append(now)
            yield pd.DataFrame({"__s": batch["__s"], "tilt": after, "goal": batch["goal"]})

    return state.mapInPandas(step, "__s string, tilt array<double>, goal array<double>")


class Unbalanced(ArithmeticError):
    """No rates below the cap meet the constraints of some source."""


def balance(
    rows: DataFrame, targets: DataFrame, moments: Sequence[str], cap: float, wanted: Mapping[str, float] | None = None
) -> DataFrame:
    """Tilts ``(__s, tilt)`` that solve the constraints of each source.

    Constraints: the source's words meet its target, and the word-weighted mean of each moment
    column is the one ``wanted``, or else stays what it is in the source. ``rows`` holds ``__s,
    __size`` and the moments. Every constraint is tested; :class:`Unbalanced` tells how many
    sources miss one after ``MAX_STEPS`` steps, because a cap or an empty class stands against it.
    """
    wanted = wanted or {}
    size = F.col("__size").cast("double")
    d = 1 + len(moments)
    means = rows.groupBy("__s").agg(*[F.try_divide(F.sum(size * F.col(m)), F.sum(size)).alias(f"__{m}") for m in moments], F.count(F.lit(1)).alias("__n"))
    centred = join_small(rows, means, "__s").select(
        "__s", "__size", *[F.coalesce(F.col(m) - _center(m, wanted), F.lit(0.0)).alias(f"x{i}") for i, m in enumerate(moments, 1)]
    )
    centred = cut_lineage(centred.where("__size > 0").withColumn("x0", F.lit(1.0)))
    zero = F.array(*[F.lit(0.0)] * d)
    goal = F.array(F.col("target"), *[F.lit(0.0)] * (d - 1))
    state = cut_lineage(targets.where("source_size > 0").select("__s", zero.alias("tilt"), goal.alias("goal")))
    for _ in range(MAX_STEPS):
        tilted = join_small(centred, state, "__s")
        score = sum((F.col("tilt")[i] * F.col(f"x{i}") for i in range(d)), F.lit(0.0))
        mass = size * F.least(F.exp(score), F.lit(cap))
        bends = F.when(score <= math.log(cap) + 1e-12, mass).otherwise(0.0)
        sums = [F.sum(mass * F.col(f"x{i}")).alias(f"g{i}") for i in range(d)]
        sums += [F.sum(bends * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(d) for j in range(d)]
        at = cut_lineage(
            tilted.groupBy("__s", "tilt", "goal")
            .agg(*sums)
            .select(
                "__s", "tilt", "goal",
                F.array(*[f"g{i}" for i in range(d)]).alias("g"),
                F.array(*[f"h{i}_{j}" for i in range(d) for j in range(d)]).alias("h"),
            )
        )
        state = at.select("__s", "tilt")
        # What each constraint misses, as a share of the words wanted.
        off = F.greatest(*[F.abs(F.col("g")[i] - F.col("goal")[i]) for i in range(d)], F.lit(0.0)) / F.col("goal")[0]
        missed = at.agg(F.count_if(off >= TOLERANCE)).first()[0]
        if not missed:
            return state.select("__s", "tilt")
        state = cut_lineage(_newton(at, cap))
    raise Unbalanced(f"{missed} sources miss a constraint after {MAX_STEPS} steps")


def _center(moment: str, wanted: Mapping[str, float]) -> Column:
    return F.lit(float(wanted[moment])) if moment in wanted else F.col(f"__{moment}")


def _rounded(rates: DataFrame, key: str, kind: str, cap: float) -> DataFrame:
    """Whole copies per document: ``__key, __s, __size, copies``.

    Within a group, the largest documents first, each takes the copies that bring the words taken
    closest to the words wanted so far, so what is left over is about half the smallest document.
    """

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__size", "__key"], ascending=[False, True], kind="stable")
        owed, copies = 0.0, []
        for size, rate in zip(group["__size"].tolist(), group["__rate"].tolist()):
            owed += rate * size
            n = min(int(cap), max(0, math.floor(owed / size + 0.5))) if size else 0
            owed -= n * size
            copies.append(n)
        return group[["__key", "__s", "__size"]].assign(copies=copies)

    return rates.groupBy("__s", "__group").applyInPandas(
        work, f"__key {kind}, __s string, __size bigint, copies bigint"
    )


def copies_for_weights(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    margin: str | None = None,
    margin_shares: Mapping[str, float] | None = None,
) -> DataFrame:
    """``(key, size, source_size, target, copies)``: one row per row of ``docs``.

    With ``margin``, a second column such as a class of lengths or a language, the words that a
    source gives are also shared out over its values as ``margin_shares`` says (value to share, 1
    in total). Documents of other values are tilted only by what the constraints leave open.

    A text without words has size 0 and 0 copies. Null is a source of its own; null keys and
    repeated rows stay, and each row is rounded for itself. The same rows give the same copies. An
    empty table gives no rows. No document exceeds ``cap`` copies.
    """
    kind = sql_type(docs, key)
    name = F.col(f"`{source}`").cast("string")
    # The last value's share follows from the others if every document has one of the values.
    classes = {f"__m{i}": v for i, v in enumerate(sorted(margin_shares or {}))}
    rows = cut_lineage(
        docs.select(
            F.col(f"`{key}`").alias("__key"),
            F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("__s"),
            name.isNull().alias("__null"),
            word_count(F.col(f"`{text}`")).alias("__size"),
            *[(F.col(f"`{margin}`").cast("string") == F.lit(v)).cast("double").alias(m) for m, v in classes.items()],
        ).withColumn("__long", F.log2(F.col("__size") + 1.0))
    )
    rows = rows.fillna(0.0, list(classes)) if classes else rows
    targets = cut_lineage(source_targets(rows, weights, share, cap))
    moments = ["__long", *classes]
    wanted = {m: margin_shares[v] for m, v in classes.items()}
    tilts = balance(rows, targets, moments, cap, wanted)
    means = rows.groupBy("__s").agg(F.try_divide(F.sum(F.col("__size") * F.col("__long")), F.sum("__size")).alias("____long"))
    per_source = cut_lineage(targets.join(tilts, "__s", "left").join(means, "__s"))
    score = F.col("tilt")[0]
    for i, m in enumerate(moments, 1):
        score = score + F.col("tilt")[i] * (F.col(m) - _center(m, wanted))
    rate = F.when(F.col("__size") > 0, F.least(F.exp(score), F.lit(cap))).otherwise(0.0)
    groups = F.ceil(F.col("rows") / GROUP_ROWS)
    rates = join_small(rows, per_source, "__s").select(
        "__key", "__s", "__size", rate.alias("__rate"),
        F.pmod(F.xxhash64("__key", "__size"), groups).alias("__group"),
    )
    taken = _rounded(rates, key, kind, cap)
    return join_small(taken, targets, "__s").select(
        F.col("__key").alias(key), F.col("__size").alias("size"), "source_size", "target", "copies"
    )


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """All columns of ``docs``, each row as often as its copies say.

    Keys are meant to be unique; rows that share one get the largest of their copies.
    """
    copies = copies_for_weights(docs, key, **options).groupBy(key).agg(F.max("copies").alias("__copies"))
    joined = docs.join(copies.withColumnRenamed(key, "__key"), F.col(f"`{key}`").eqNullSafe(F.col("__key")))
    each = joined.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return each.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op9_source_mix")
def _op9(spark: SparkSession, folder: str) -> DataFrame:
    mixed = copies_for_weights(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )
