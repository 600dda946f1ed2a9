"""How far two sets of labels agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.answers import normalize_answer
from corpusmill.functions.stats import rows_from, with_scalar
from corpusmill.operators.detect import label_semantics, semantics_of
from corpusmill.settings import cut_lineage


def _confusion(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows per pair of normalised labels, where both exist."""
    pairs = df.select(
        normalize_answer(F.col(first)).alias("a"), normalize_answer(F.col(second)).alias("b")
    )
    return (
        pairs.where("a IS NOT NULL AND b IS NOT NULL")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _rate_and_kappa(compared: Column, equal: Column, chance: Column) -> tuple[Column, Column]:
    """Agreement rate and unweighted kappa from rows, equal rows, and the sum over labels of the
    products of both sides' rows. Without rows the rate is null, with fewer than two the kappa."""
    n = compared.cast("double")
    rate = equal / F.nullif(n, F.lit(0.0))
    expected = chance / F.nullif(n * n, F.lit(0.0))
    kappa = (
        F.when(compared < 2, F.lit(None).cast("double"))
        .when(F.abs(1 - expected) < 1e-12, F.when(F.abs(1 - rate) < 1e-9, 1.0).otherwise(0.0))
        .otherwise((rate - expected) / F.nullif(1 - expected, F.lit(0.0)))
    )
    return rate, kappa


def _agreements(pairs: DataFrame, kinds: list[str]) -> DataFrame:
    """One row: ``compared_<kind>, rate_<kind>, kappa_<kind>`` for every kind.

    ``pairs (kind, a, b, n)`` holds the rows per pair of labels; both figures come from the rows
    per label and side, so every kind shares the two groupings.
    """
    a, b, n, none = F.col("a"), F.col("b"), F.col("n"), F.lit(0).cast("bigint")
    equal = F.when(a == b, n).otherwise(none)
    sides = F.array(
        F.struct(a.alias("label"), n.alias("x"), none.alias("y"), equal.alias("equal")),
        F.struct(b.alias("label"), none.alias("x"), n.alias("y"), none.alias("equal")),
    )
    each = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("kind", F.explode(sides).alias("s"))
    labels = each.groupBy("kind", "s.label").agg(
        F.sum("s.x").alias("x"), F.sum("s.y").alias("y"), F.sum("s.equal").alias("equal")
    )
    cells, told = [], []
    for kind in kinds:
        own = F.col("kind") == kind
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        cells += [
            F.coalesce(F.sum(F.when(own, F.col("x"))), none).alias(f"compared_{kind}"),
            F.sum(F.when(own, F.col("equal"))).alias(f"equal_{kind}"),
            F.sum(F.when(own, x * y)).alias(f"chance_{kind}"),
        ]
        rate, kappa = _rate_and_kappa(*(F.col(f"{c}_{kind}") for c in ("compared", "equal", "chance")))
        told += [F.col(f"compared_{kind}"), rate.alias(f"rate_{kind}"), kappa.alias(f"kappa_{kind}")]
    return labels.agg(*cells).select(*told)


def pairwise_agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: ``compared, agreement_rate, kappa`` (unweighted).

    Both come from the table of label pairs; without rows the rate is null,
    with fewer than two the kappa.
    """
    pairs = _confusion(df, first, second).withColumn("kind", F.lit("own"))
    told = _agreements(pairs, ["own"])
    return told.select(
        F.col("compared_own").alias("compared"), F.col("rate_own").alias("agreement_rate"), F.col("kappa_own").alias("kappa")
    )


def agreement_rate(df: DataFrame, first: str, second: str) -> DataFrame:
    """Share of equal labels among rows where both exist."""
    return pairwise_agreement(df, first, second).select("compared", "agreement_rate")


def cohen_kappa(df: DataFrame, first: str, second: str) -> DataFrame:
    """Agreement beyond chance."""
    return pairwise_agreement(df, first, second).select("compared", "kappa")


def supports_agreement(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: can the label serve as a reference? Few classes, not numbers, two rows at least."""
    if label not in df.columns:
        return df.sparkSession.range(1).select(F.lit(False).alias("supported"))
    return label_semantics(df, label).select(_supported().alias("supported"))


def _supported() -> Column:
    n, distinct = F.col("n"), F.col("distinct_labels")
    limit = F.least(F.lit(20), F.greatest(F.lit(5), F.floor(n / 2)))
    return (n >= 2) & (distinct <= limit) & (F.col("numeric_ratio") < 0.8)


def annotation_quality(df: DataFrame, label: str = "label") -> DataFrame:
    """Agreement with the given labels (inter), between the passes (intra), label
    distribution, confidence and review share, as metric rows.

    The rows are read once, into a cube of both passes' answers, the final and the given label; it
    has a row per combination that occurs, and every figure comes from it.
    """
    given = F.col(label).cast("string") if label in df.columns else F.lit(None).cast("string")
    confidence = F.coalesce(F.col("annotation_confidence").cast("double"), F.lit(0.0))
    review = F.coalesce(F.col("annotation_needs_review"), F.lit(False))
    cube = cut_lineage(
        df.groupBy(
            F.col("annotation_auto_label_pass_1").cast("string").alias("first"),
            F.col("annotation_auto_label_pass_2").cast("string").alias("second"),
            F.col("annotation_label").cast("string").alias("final"),
            given.alias("given"),
        ).agg(F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("confidence"), F.count_if(review).alias("review"))
    )
    kinds = {"intra": ("first", "second")} | ({"inter": ("given", "final")} if label in df.columns else {})
    cells = [
        F.struct(F.lit(kind).alias("kind"), *(normalize_answer(F.col(c)).alias(s) for c, s in zip(pair, "ab")), "n")
        for kind, pair in kinds.items()
    ]
    pairs = cube.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    figures = _agreements(pairs, list(kinds))
    entries = _agreement_entries("intra", F.lit(True))
    if "inter" in kinds:
        values = cube.where("given IS NOT NULL").groupBy(F.col("given").alias("value")).agg(F.sum("n").alias("rows"))
        figures = with_scalar(figures, "ok", semantics_of(values).select(_supported()))
        entries += _agreement_entries("inter", F.col("ok"))
    rows = rows_from(figures, entries)
    totals = cube.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.sum("review"), F.lit(0)).alias("review"),
    )
    n = F.nullif(F.col("n"), F.lit(0))
    rows = rows.unionByName(
        rows_from(
            totals,
            [
                ("annotation", "confidence_mean", "", F.coalesce(F.col("confidence") / n, F.lit(0.0))),
                ("annotation", "review_count", "", F.col("review")),
                ("annotation", "review_rate", "", F.coalesce(F.col("review") / n, F.lit(0.0))),
            ],
        )
    )
    labels = (
        cube.where("final IS NOT NULL")
        .groupBy(F.col("final").alias("column"))
        .agg(F.sum("n").cast("double").alias("value"))
        .select(F.lit("annotation").alias("section"), F.lit("label_dist").alias("metric"), "column", "value")
    )
    return rows.unionByName(labels)


def _agreement_entries(kind: str, applies: Column) -> list[tuple[str, str, str, Column]]:
    rate = F.when(applies, F.col(f"rate_{kind}"))
    return [
        ("annotation", f"{kind}_agreement_rate", "", rate),
        ("annotation", f"{kind}_agreement_pct", "", rate * 100),
        ("annotation", f"{kind}_kappa", "", F.when(applies, F.col(f"kappa_{kind}"))),
    ]
