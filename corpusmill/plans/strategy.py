"""Cleaning strategies: named actions, and rules that pick them from a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import clean

# Blocks of a strategy, in the order they run.
BLOCKS = ["text_actions", "row_actions", "column_actions", "target_actions", "label_actions"]

# Action names. Each takes (df, key, text, label).
ACTIONS = {
    "drop_all_null_optional_columns": lambda d, k, t, y: clean.drop_all_null_columns(d, [k, t, y]),
    "drop_rows_missing_label": lambda d, k, t, y: clean.drop_rows_missing_label(d, y),
    "deduplicate_normalized_text": lambda d, k, t, y: clean.dedup_text_keep_richest(d, k, t, y),
    "preserve_math_notation": lambda d, k, t, y: d,
    "keep_rows_missing_label_for_label_generation": lambda d, k, t, y: d,
    "flag_rows_missing_label": lambda d, k, t, y: clean.flag_unlabeled(d, y),
    "split_supervised_subset_without_discarding_raw_rows": lambda d, k, t, y: d.withColumn(
        "in_supervised_subset", F.col(y).isNotNull()
    ),
    "drop_exact_duplicates": lambda d, k, t, y: clean.drop_duplicate_rows(d, k),
    "drop_normalized_text_duplicates_keep_richest_metadata": (
        lambda d, k, t, y: clean.dedup_text_keep_richest(d, k, t, y)
    ),
    "keep_cross_task_variants": lambda d, k, t, y: d,
    "drop_audio_column": lambda d, k, t, y: d.drop("audio"),
    "preserve_unlabeled_rows_for_inference": lambda d, k, t, y: d,
    "keep_only_rows_with_text": lambda d, k, t, y: clean.drop_empty_text(d, t),
    "validate_solution_format_consistency": lambda d, k, t, y: clean.flag_label_format(d, y),
    "keep_original_labels_only": lambda d, k, t, y: d,
    "trim_text": lambda d, k, t, y: clean.trim_text(d, t),
    "drop_sparse_rows": lambda d, k, t, y: clean.drop_sparse_rows(d, t, y, {k}),
}

# Actions that compare texts; they keep operators apart when math is preserved.
_TEXT_DEDUP = {"deduplicate_normalized_text", "drop_normalized_text_duplicates_keep_richest_metadata"}


def apply_actions(
    df: DataFrame,
    blocks: Mapping[str, Sequence[str]],
    key: str,
    text: str = "text",
    label: str = "label",
) -> DataFrame:
    """Run the named actions of each block in order; an unknown name is an error."""
    unknown = [b for b in blocks if b not in BLOCKS]
    names = [name for block in BLOCKS for name in blocks.get(block) or []]
    unknown += [name for name in names if name not in ACTIONS]
    if unknown:
        raise ValueError(f"Unknown actions: {', '.join(unknown)}")
    keep_math = "preserve_math_notation" in names
    for name in names:
        if keep_math and name in _TEXT_DEDUP:
            df = clean.dedup_text_keep_richest(df, key, text, label, keep_math=True)
        else:
            df = ACTIONS[name](df, key, text, label)
    return df


def _metric(section: str, metric: str) -> Column:
    hit = (F.col("section") == section) & (F.col("metric") == metric)
    return F.coalesce(F.max(F.when(hit, F.col("value"))), F.lit(0.0))


def recommend_strategy(report: DataFrame, configured: Mapping | None = None) -> DataFrame:
    """Candidate strategies as rows ``(option, recommended, position, block, action, reason)``.

    ``retain`` keeps unlabelled rows and is recommended; ``supervised_only``
    drops them; ``configured`` repeats the given strategy when it differs.
    Only actions whose issue shows in the report are listed.
    """
    facts = report.agg(
        _metric("duplicates", "rows").alias("copies"),
        _metric("text", "duplicate_text_rows").alias("repeats"),
        _metric("text", "empty_rows").alias("blank"),
        _metric("missing", "total").alias("gaps"),
        _metric("outliers", "iqr_total").alias("outliers"),
    )
    always = F.lit(True)
    shared = [
        ("row_actions", "drop_exact_duplicates", F.col("copies") > 0, "equal rows distort training"),
        (
            "text_actions",
            "drop_normalized_text_duplicates_keep_richest_metadata",
            F.col("repeats") > 0,
            "repeated texts keep their best documented row",
        ),
        ("row_actions", "keep_only_rows_with_text", F.col("blank") > 0, "rows without text carry nothing"),
        ("column_actions", "drop_all_null_optional_columns", F.col("gaps") > 0, "empty columns carry nothing"),
    ]
    options = {
        "retain": [
            *shared,
            ("label_actions", "flag_rows_missing_label", F.col("gaps") > 0, "unlabelled rows stay usable"),
        ],
        "supervised_only": [
            *shared,
            ("row_actions", "drop_rows_missing_label", always, "only labelled rows are trained on"),
        ],
    }
    if configured:
        options["configured"] = [
            (block, name, always, "configured") for block in BLOCKS for name in configured.get(block) or []
        ]
    def listed(option: str) -> Column:
        """What an option shows, by block and in the order of the blocks."""
        names = [F.when(shown, F.lit(f"{block}/{action}")) for block, action, shown, _ in options[option]]
        return F.array_sort(F.array_compact(F.array(*names)))

    cells = []
    for option, actions in options.items():
        # A configured strategy that says the same as another option is no alternative.
        new = always
        if option == "configured":
            new = ~(listed("configured").eqNullSafe(listed("retain")) | listed("configured").eqNullSafe(listed("supervised_only")))
        for position, (block, action, shown, reason) in enumerate(actions, start=1):
            row = F.struct(
                F.lit(option).alias("option"),
                F.lit(option == "retain").alias("recommended"),
                F.lit(position).alias("position"),
                F.lit(block).alias("block"),
                F.lit(action).alias("action"),
                F.lit(reason).alias("reason"),
            )
            cells.append(F.when(shown & new, row))
    return facts.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).select("s.*")


def strategy_of(recommendation: DataFrame) -> dict[str, list[str]]:
    """Blocks of the recommended option. The frame has one row per listed action."""
    rows = recommendation.where("recommended").orderBy("position").collect()
    blocks: dict[str, list[str]] = {}
    for row in rows:
        blocks.setdefault(row["block"], []).append(row["action"])
    return blocks
