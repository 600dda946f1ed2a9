"""Byte-level BPE by corpus-level merge replay.

The distinct pieces of many documents are laid out once. An inverted index from token pair to
positions then replays the merges in rank order: every merge is applied to all its positions at
once, and only the pairs beside a merged place are looked up again.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.base import query, sha256, slices, sql_type, table

_NONE = np.int64(1 << 40)
# Pieces whose ids a task remembers; more than these and it starts anew.
MEMORY_PIECES = 400_000


def read_ranks(lines: list[bytes]) -> list[bytes]:
    """Token bytes by rank, from the lines of a rank file (base64, space, rank)."""
    pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Replay:
    """Encoder over a vocabulary: ``encode(texts)`` gives the ids of each text.

    A pair's rank is the rank of its joined bytes. Within a piece the lowest rank merges first and
    the leftmost among equals. Merging a whole rank at once gives the same, unless a merge makes a
    pair of a lower rank than its own; pieces where that happens are encoded one merge at a time.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        # Rust's \s is the White_Space property.
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte_id = np.full(256, -1, dtype=np.int64)
        codes, merged = [], []
        for token, rank in self.rank.items():
            if len(token) == 1:
                self.byte_id[token[0]] = rank
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    codes.append(a << 20 | b)
                    merged.append(rank)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        order = np.argsort(np.array(codes, dtype=np.int64))
        self.codes = np.append(np.array(codes, dtype=np.int64)[order], np.int64(1) << 62)
        self.merged = np.append(np.array(merged, dtype=np.int64)[order], _NONE)
        self.forget()

    def forget(self) -> None:
        # A piece seen for the first time gets the next number.
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = np.where((a < 0) | (b < 0), np.int64(-1), a << 20 | b)
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.merged[at], _NONE)

    def _one_by_one(self, piece: bytes) -> list[int]:
        """A piece by itself: a heap of (rank, position)."""
        n = len(piece)
        start = list(range(n + 1))
        after, before = list(range(1, n + 2)), list(range(-1, n))
        end = list(range(1, n + 1))
        alive = [True] * n

        def rank_at(i: int) -> int | None:
            j = after[i]
            return self.rank.get(piece[start[i] : end[j]]) if j < n else None

        heap = [(r, i) for i in range(n) if (r := rank_at(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank_at(i) != r:
                continue
            j = after[i]
            end[i], alive[j], after[i] = end[j], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (s := rank_at(k)) is not None:
                    heapq.heappush(heap, (s, k))
        return [self.rank[piece[start[i] : end[i]]] for i in range(n) if alive[i]]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and where each piece starts in it."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        # One slot per byte and an empty slot behind each piece, so that pairs never span pieces.
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
        gaps = np.cumsum(lengths + 1) - 1
        sym = self.byte_id[raw]
        sym[gaps] = -1
        n = len(sym)
        after = np.arange(1, n + 1)
        after[-1] = n - 1
        before = np.arange(-1, n - 1)
        before[0] = n - 1
        pair = _NONE + np.zeros(n, dtype=np.int64)
        pair[:-1] = self._pair_ranks(sym[:-1], sym[1:])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: list[np.ndarray] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks != _NONE
            at, ranks = at[keep], ranks[keep]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, rank in zip(np.split(at, cuts), ranks[np.append(0, cuts)].tolist() if len(at) else []):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(part)

        enter(np.arange(n), pair)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            behind = after[at]
            # Leftmost first where places overlap: in a chain every second one merges.
            if len(at) > 1:
                spot = np.searchsorted(at, behind)
                overlap = at[np.minimum(spot, len(at) - 1)] == behind
                if overlap.any():
                    take = np.ones(len(at), dtype=bool)
                    for i in np.flatnonzero(overlap).tolist():
                        if take[i]:
                            take[spot[i]] = False
                    at, behind = at[take], behind[take]
            nxt = after[behind]
            if len(at) > 1:
                spot = np.searchsorted(at, nxt)
                beside = at[np.minimum(spot, len(at) - 1)] == nxt
                if beside.any():
                    low = self._pair_ranks(np.full(int(beside.sum()), rank), sym[nxt[beside]]) < rank
                    odd.append(at[beside][low])
            sym[at] = rank
            sym[behind] = -2
            pair[behind] = _NONE
            after[at] = nxt
            before[nxt] = at
            left = before[at]
            # The left neighbour of a place may be the merged place before it.
            touched = np.concatenate([left[left != np.append(-1, at[:-1])], at])
            ranks = self._pair_ranks(sym[touched], sym[after[touched]])
            pair[touched] = ranks
            low = ranks < rank
            if low.any():
                odd.append(touched[low])
            enter(touched, ranks)
        alive = sym >= 0
        ids = sym[alive].astype(np.int32)
        counts = np.add.reduceat(alive, np.append(0, gaps[:-1] + 1)) if len(pieces) else np.zeros(0, np.int64)
        starts = np.append(0, np.cumsum(counts))
        if odd:
            again = np.unique(np.searchsorted(gaps, np.concatenate(odd)))
            if len(again):
                parts = np.split(ids, starts[1:-1])
                for i in again.tolist():
                    parts[i] = np.array(self._one_by_one(pieces[i]), dtype=np.int32)
                ids = np.concatenate(parts)
                starts = np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, starts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > MEMORY_PIECES:
            self.forget()
        before, spots, counts = len(self.known), [], []
        for text in texts:
            found = self.pieces.findall(text)
            counts.append(len(found))
            spots.append(np.fromiter(map(self.known.__getitem__, found), np.int64, len(found)))
        fresh = [piece.encode() for piece in islice(self.known, before, None)]
        if fresh:
            ids, starts = self.replay(fresh)
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
        at = np.concatenate([np.zeros(0, np.int64), *spots])
        first, long = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.append(0, np.cumsum(long))
        flat = self.ids[np.repeat(first - ends[:-1], long) + np.arange(ends[-1])]
        return np.split(flat, ends[np.cumsum(counts)][:-1]) if counts else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[int, str], Replay] = {}


def _encoder(tokens: list[bytes], pattern: str) -> Replay:
    """One encoder per Python worker, however many tasks it runs."""
    place = (hash(tuple(tokens)), pattern)
    if place not in _LOADED:
        _LOADED.clear()
        _LOADED[place] = Replay(tokens, pattern)
    return _LOADED[place]


def encode(
    docs: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, ids array<int>)``: one row per row of ``docs``, ids of the whole text.

    A null or empty text gives no ids; repeated rows and null keys stay; other columns are not
    read. ``tokens`` is a public vocabulary, fixed in size, so it travels with the tasks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokens, pattern)
        for part, texts in slices(batches, 1):
            ids = coder.encode(texts)
            ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32))
            yield pa.record_batch(
                [part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], [key, "ids"]
            )

    return docs.select(key, text).mapInArrow(work, f"`{key}` {sql_type(docs, key)}, ids array<int>")


def decode(encoded: DataFrame, tokens: list[bytes], key: str = "doc_id") -> DataFrame:
    """``(key, text_bytes)`` from ``(key, ids)``; null ids give null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [
                None if x is None else b"".join(map(tokens.__getitem__, x))
                for x in batch.column(1).to_pylist()
            ]
            yield pa.record_batch([batch.column(0), pa.array(cells, pa.binary())], [key, "text_bytes"])

    return encoded.select(key, "ids").mapInArrow(
        work, f"`{key}` {sql_type(encoded, key)}, text_bytes binary"
    )


def round_trip(
    docs: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Digests of encoding and decoding each text: ``(key, n_tokens, ids_sha256, decoded_sha256)``.

    The ids and bytes never leave the task that makes them. Null and empty texts have 0 tokens.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokens, pattern)
        for part, texts in slices(batches, 1):
            counts, ids_sha, text_sha = [], [], []
            for ids in coder.encode(texts):
                counts.append(len(ids))
                ids_sha.append(sha256(ids.astype("<u4").tobytes()))
                text_sha.append(sha256(coder.decode(ids.tolist())))
            yield pa.record_batch(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(key, text).mapInArrow(
        work,
        f"`{key}` {sql_type(docs, key)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[list[bytes], str]:
    """Tokens by rank and the piece pattern of an installed public vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        return read_ranks(lines.readlines()), public_tokenizers.PATTERN


@query("op6_bpe_round_trip")
def _op6(spark: SparkSession, folder: str) -> DataFrame:
    tokens, pattern = public_vocabulary()
    docs = table(spark, folder, "documents")
    return round_trip(docs, tokens, pattern)
