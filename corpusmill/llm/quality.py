"""Quality rules learned as a decision list over statistics of a text.

Sequential covering: a rule starts empty and grows by the threshold test that gains most on the
growing rows, is cut back on the pruning rows, and then the rows it covers leave the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.base import hashed_words, mixed, query, slices, table

WINDOW_WORDS = 8
SYMBOLS = b"#*$%&|<>"
# Rows that are fitted on: about so many labelled rows, chosen by the hash of their key.
LABELLED_ROWS = 20_000
MAX_RULES = 12
MAX_TESTS = 4
# A rule must be right on this share of the pruning rows that it covers, and cover so many.
LEAST_PRECISION = 0.9
LEAST_COVER = 8

# Statistics that a rule may test, as expressions over the counts.
FEATURES = {
    "n_words": "cast(n_words AS double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
}
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks",
)


def _table_of(members: bytes) -> np.ndarray:
    known = np.zeros(256, dtype=bool)
    known[list(members)] = True
    return known


_CLASSES = {
    "space": _table_of(b" \t\n\r\x0b\x0c"),
    "continued": _table_of(bytes(range(0x80, 0xC0))),
    "n_symbols": _table_of(SYMBOLS),
    "n_upper": _table_of(bytes(range(65, 91))),
    "n_digits": _table_of(b"0123456789"),
    "n_marks": _table_of(b"!?;:~^_=@"),
}


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    seen: set[bytes] = set()
    repeated = total = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            total += 1
            repeated += line in seen
            seen.add(line)
    return total, repeated


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for every text, whole."""
    ends = np.append(0, np.cumsum([len(t) for t in texts]))
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def per_text(members: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(members, dtype=np.int64))
        return upto[bounds[1:]] - upto[bounds[:-1]]

    got = {name: per_text(known[raw], ends) for name, known in _CLASSES.items()}
    got["word_chars"] = np.diff(ends) - got.pop("continued") - got.pop("space")
    flat, n = hashed_words(texts)
    bounds = np.append(0, np.cumsum(n))
    owner = np.repeat(np.arange(len(texts)), n)
    covered = np.zeros(len(flat) + 1, dtype=np.int64)
    count = len(flat) - WINDOW_WORDS + 1
    if count > 0:
        run = np.zeros(count, dtype=np.uint64)
        for step in range(WINDOW_WORDS):
            run = run * np.uint64(0x9E3779B97F4A7C15) + flat[step : step + count]
        starts = np.flatnonzero(owner[:count] == owner[WINDOW_WORDS - 1 :])
        run = mixed(mixed(run[starts]) + owner[starts].astype(np.uint64))
        order = np.argsort(run, kind="stable")
        same = run[order[1:]] == run[order[:-1]]
        twice = np.zeros(len(starts), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = starts[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW_WORDS, -1)
    got["n_words"] = n
    got["n_repeat_words"] = per_text(np.cumsum(covered)[:-1] > 0, bounds)
    lines = np.array([_lines(t) for t in texts], dtype=np.int64).reshape(-1, 2)
    got["n_lines"], got["n_dup_lines"] = lines[:, 0], lines[:, 1]
    return got


def with_statistics(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` and the counts of its texts (``COUNTS``), one row per row.

    Words are runs without space and ``\\x09-\\x0D``; null and empty texts count as 0 words.
    Texts are counted whole. Repeated rows stay. A column that has the name of a count is refused.
    """
    clash = set(columns) & set(COUNTS)
    if clash:
        raise ValueError(f"columns {sorted(clash)} have the names of counts")
    chosen = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, len(columns), as_bytes=True):
            got = text_counts(texts)
            yield pa.record_batch(
                [*(part.column(i) for i in range(len(columns))), *(pa.array(got[c], pa.int64()) for c in COUNTS)],
                [*columns, *COUNTS],
            )

    fields = [*chosen.drop("__text").schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)]
    return chosen.mapInArrow(work, T.StructType(fields))


# ------------------------------------------------------------------------ learning

Test = tuple[int, bool, float]  # feature, whether values above pass, threshold


def _passes(x: np.ndarray, tests: list[Test]) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for feature, above, at in tests:
        ok &= x[:, feature] > at if above else x[:, feature] <= at
    return ok


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Test]:
    """Add the test of the largest information gain until the rule covers no good row."""
    tests: list[Test] = []
    inside = np.ones(len(x), dtype=bool)
    while len(tests) < MAX_TESTS and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        before = np.log2(p0 / (p0 + n0))
        best: tuple[float, Test] | None = None
        for feature in range(x.shape[1]):
            values = x[inside, feature]
            marks = np.unique(np.quantile(values, np.linspace(0, 1, 65)))
            marks = (marks[1:] + marks[:-1]) / 2
            spot = np.searchsorted(marks, values, side="left")
            p = np.cumsum(np.bincount(spot[bad[inside]], minlength=len(marks) + 1))[:-1]
            n = np.cumsum(np.bincount(spot[~bad[inside]], minlength=len(marks) + 1))[:-1]
            for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), 0.0)
                if len(gain) and gain.max() > 1e-9 and (best is None or gain.max() > best[0]):
                    best = (gain.max(), (feature, above, float(marks[gain.argmax()])))
        if best is None:
            break
        tests.append(best[1])
        inside &= _passes(x, tests[-1:])
    return tests


def learn_list(x: np.ndarray, bad: np.ndarray) -> list[list[Test]]:
    """Rules for bad rows, in order; a row that none covers is good.

    Every third row prunes. Too few bad rows give no rule. The same rows give the same list.
    """
    rules: list[list[Test]] = []
    pruning = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & ~pruning, left & pruning
        if (bad & grow).sum() < LEAST_COVER:
            break
        tests = _grow(x[grow], bad[grow])
        if not tests:
            break

        def worth(upto: int) -> tuple[float, int]:
            hit = _passes(x[prune], tests[:upto])
            p, n = (hit & bad[prune]).sum(), (hit & ~bad[prune]).sum()
            return ((p + 0.5) / (p + n + 1), -upto) if p + n else (0.0, -upto)

        tests = tests[: max(range(1, len(tests) + 1), key=worth)]
        hit = _passes(x, tests) & left
        checked = hit & pruning
        if hit.sum() < LEAST_COVER or not checked.any() or bad[checked].mean() < LEAST_PRECISION:
            break
        rules.append(tests)
        left &= ~hit
    return rules


def rule_expression(rules: list[list[Test]]) -> Column:
    """The list as one ordered condition over the counts: the number of the first rule that holds.

    0 where none does. The expression is plain SQL, so that it can be read and kept.
    """
    names = list(FEATURES)
    if not rules:
        return F.lit(0)
    cases = " ".join(
        "WHEN "
        + " AND ".join(f"({FEATURES[names[f]]}) {'>' if above else '<='} {at!r}D" for f, above, at in tests)
        + f" THEN {i}"
        for i, tests in enumerate(rules, 1)
    )
    return F.expr(f"CASE {cases} ELSE 0 END")


def fit_rules(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> list[list[Test]]:
    """Learn from labelled rows (``label`` 0 is bad), about ``LABELLED_ROWS`` at most.

    The hash of the key chooses them, the same in every run. Rows without label or key are left
    out; of several labels of one key the worst counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(key).agg(F.min(label).alias("__label"))
    share = min(LABELLED_ROWS / max(known.count(), 1), 1.0)
    chosen = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    chosen = chosen.select(F.col(key).alias("__key"), "__label")
    texts = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("text"))
    # About LABELLED_ROWS keys.
    labelled = texts.join(F.broadcast(chosen), "__key")
    values = [F.expr(e).alias(f"__{name}") for name, e in FEATURES.items()]
    rows = with_statistics(labelled, ["__key", "__label"]).select("__key", "__label", *values).toPandas()
    rows = rows.sort_values(["__key", *(f"__{name}" for name in FEATURES)], kind="stable")
    # Every third row prunes, so the order must not follow the key.
    rows = rows.sample(frac=1.0, random_state=0)
    x = rows[[f"__{name}" for name in FEATURES]].to_numpy(dtype=float)
    return learn_list(x, rows["__label"].to_numpy() == 0)


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _verdict(rules: list[list[Test]]) -> list[Column]:
    rule = rule_expression(rules).cast("int")
    failed = F.expr(BASE_FAILED)
    return [failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept")]


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """``(key, *COUNTS, base_failed, rule, kept)``: one row per row of ``docs``.

    ``rule`` is the number of the first learned rule that rejects the text, 0 if none does. Null
    keys and repeated rows stay; without labels no rule is learned and only the base counts.
    """
    rules = fit_rules(docs, labels, key, text, label)
    return with_statistics(docs, [key], text).select(key, *COUNTS, *_verdict(rules))


def keep_good(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns; nothing is shuffled."""
    rules = fit_rules(docs, labels, key, text, label)
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    counted = with_statistics(named, named.columns, f"c{columns.index(text)}").withColumn("kept", _verdict(rules)[2])
    return counted.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


@query("op5_quality_rules")
def _op5(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule",
    )
