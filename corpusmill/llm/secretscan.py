"""Secrets in texts: fixed patterns, and windows of high entropy inside candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.base import query, sha256, slices, sql_type, table

KINDS = ("assign", "access", "hex", "entropy")

# The fixed patterns of the contract.
_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
# A keyword that a text lacks in lower case is in it in no case.
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

WINDOW = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Character classes, each with the least bits per character of a suspicious window. Random hex
# digits have about 3.3 bits in 20 characters, random base64 about 4.1; joined words stay below 3.8.
CLASSES = (
    (re.compile(r"[0-9A-Fa-f]{20,}"), 3.0),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.8),
)
# Strings of high entropy that are no secrets: plain numbers, words without digits joined by
# separators, and identifiers in the form of a UUID. No part of a pattern may be empty, and what may
# follow each other has no character in common, so a match takes time in step with the string.
ALLOWED = (
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[+/_=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+)(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[+/_=-]*)?"),
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
)


def entropy_windows(text: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans that windows of at least ``least`` bits per character cover together.

    The window slides by one; only the counts of the character that enters and of the one that
    leaves change, and with them the sum of ``c * log2(c)``.
    """
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for end, new in enumerate(text, 1):
        # The old character leaves first: no count exceeds the window.
        if end > window:
            old = text[end - window - 1]
            c = counts[old]
            total += weigh[c - 1] - weigh[c]
            counts[old] = c - 1
        c = counts.get(new, 0)
        total += weigh[c + 1] - weigh[c]
        counts[new] = c + 1
        if end >= window and math.log2(window) - total / window >= least - 1e-9:
            start = end - window
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    return spans


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, index of the kind in KINDS, end)`` in code points, sorted.

    Each kind by itself has no overlaps; different kinds may overlap.
    """
    low = text.lower()
    found = []
    if any(word in low for word in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for candidate in _CANDIDATE.finditer(text):
        if any(rule.fullmatch(candidate[0]) for rule in ALLOWED):
            continue
        high: list[tuple[int, int]] = []
        for members, least in CLASSES:
            for run in members.finditer(candidate[0]):
                if not any(rule.fullmatch(run[0]) for rule in ALLOWED):
                    at = candidate.start() + run.start()
                    high += [(at + a, at + b) for a, b in entropy_windows(run[0], least)]
        last: tuple[int, int] | None = None
        for a, b in sorted(high):
            if last and a <= last[1]:
                last = (last[0], max(b, last[1]))
                found[-1] = (last[0], 3, last[1])
            else:
                last = (a, b)
                found.append((a, 3, b))
    return sorted(found)


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans)``, one row per row.

    Null and empty texts have no spans (``spans`` is ``""``). Texts are searched whole; repeated
    rows and null keys stay; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1):
            found = [secret_spans(t) for t in texts]
            counts = [[sum(k == kind for _, k, _ in f) for f in found] for kind in range(len(KINDS))]
            base = [sha256(_told([s for s in f if s[1] < 3]).encode()) for f in found]
            yield pa.record_batch(
                [part.column(0), *(pa.array(c, pa.int64()) for c in counts)]
                + [pa.array(base, pa.string()), pa.array([_told(f) for f in found], pa.string())],
                [key, *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"],
            )

    numbers = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return docs.select(key, text).mapInArrow(
        work, f"`{key}` {sql_type(docs, key)}, {numbers}, base_sha256 string, spans string"
    )


def redacted(text: str, mark: str) -> str:
    parts, at = [], 0
    for start, _, end in secret_spans(text):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """All columns of ``docs``, with ``mark`` in place of every secret; null texts stay null.

    Secrets that overlap become one mark.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            cells = [None if t is None else redacted(t, mark) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(cells, batch.column(place).type))

    return docs.mapInArrow(work, docs.schema)


@query("op3_secret_spans")
def _op3(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents"))
