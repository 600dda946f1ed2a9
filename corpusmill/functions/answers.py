"""Reading a label out of a model's raw answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import (
    blank_to_null,
    collapse_ws,
    fenced_block,
    json_object,
    json_text,
    let,
    strip_ws,
)

# Members of a JSON answer in order of preference.
LABEL_KEYS = ["label", "final_label", "answer"]

# Phrases that mark an answer as unusable.
INVALID_PHRASES = [
    "incomplete",
    "insufficient information",
    "cannot be determined",
    "can't be determined",
    "cannot determine",
    "not enough information",
    "no solution",
    "unsolved",
    "unanswerable",
    "invalid",
]

# Words that stand for no answer.
EMPTY_ANSWERS = ["", "none", "null", "nan"]

# A boxed result and an answer line.
BOXED = r"\\boxed\s*\{([^{}]+)\}"
ANSWER_LINE = r"(?imd)^\s*(?:final\s+answer|answer)\s*[:=]\s*(.+?)\s*$"


def normalize_answer(c: Column) -> Column:
    """Collapsed text; null for an empty answer or a word that stands for one."""
    return let(
        collapse_ws(c.cast("string")), lambda t: F.when(~F.lower(t).isin(EMPTY_ANSWERS), t)
    )


def clean_candidate(c: Column) -> Column:
    """Tidy one candidate: no dots-only text, no box around it, no ``answer:`` before it."""

    def unboxed(text: Column) -> Column:
        inner = F.when(text.rlike(BOXED), strip_ws(F.regexp_extract(text, BOXED, 1))).otherwise(text)
        bare = strip_ws(F.regexp_replace(inner, r"(?is)^answer:", ""))
        return F.when(~text.rlike(r"^(?:[.]+|[…]+)$"), blank_to_null(bare))

    return let(strip_ws(c), unboxed)


def parse_answer(c: Column) -> Column:
    """Label in a raw answer, by the first rule that applies.

    A JSON object (the whole text, or the first fenced block when there is one)
    with a usable member; the first boxed result; ``invalid`` for a phrase that
    says so; the last answer line. Otherwise null.
    """

    def members(document: Column) -> Column:
        return F.coalesce(*[clean_candidate(json_text(document, key)) for key in LABEL_KEYS])

    def rules(text: Column) -> Column:
        document = json_object(F.coalesce(fenced_block(text), text))
        lines = F.regexp_extract_all(text, F.lit(ANSWER_LINE), F.lit(1))
        written = (
            F.when(text.rlike(BOXED), clean_candidate(F.regexp_extract(text, BOXED, 1)))
            .when(F.lower(text).rlike("|".join(INVALID_PHRASES)), F.lit("invalid"))
            .otherwise(clean_candidate(F.try_element_at(lines, F.lit(-1))))
        )
        return F.coalesce(let(document, members), written)

    return let(strip_ws(c), rules)


def normalize_label(c: Column, is_boolean: bool = False) -> Column:
    """Label as text: booleans as ``true``/``false``, anything else stripped."""
    text = c.cast("string")
    return text if is_boolean else strip_ws(text)
