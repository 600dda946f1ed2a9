"""Ranked lexical search by impact-sorted lists without random access.

The list of a term holds what the term adds to the score of each document, in levels from the
largest contributions down. A round reads every list of an item down to one level. What was read
of a document is the lower end of its score; the upper end adds, for each list it was not yet seen
in, the largest contribution that list still holds. Once no unseen document can reach the k-th
lower end, the documents whose upper end reaches it are the only candidates, and the lists are
read on for them alone until their scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.base import query, slices, sql_type, table
from corpusmill.llm.scratch import Scratch
from corpusmill.llm.terms import split_terms
from corpusmill.settings import BROADCAST_ROWS, join_small

TOP = 50
# Levels per doubling of a contribution.
LEVELS = 4
# Steps of reading per doubling of what a posting is worth.
STEPS = 2
# Postings of an item that the first round reads, and how many times more each next one does.
FIRST_READ = 1_000
DEEPER = 4
# The items' terms go to every task up to this size; beyond it documents' terms are joined with them.
VOCABULARY_BYTES = 32_000_000


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """``(item, word)``: the distinct terms of all texts of an item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1, as_bytes=True):
            terms, counts = split_terms(texts)
            owners = part.column(0).take(pa.array(np.repeat(np.arange(len(texts)), counts)))
            yield pa.record_batch([owners, terms.cast(pa.string())], ["item", "word"])

    kind = sql_type(items, item)
    found = items.where(F.col(f"`{item}`").isNotNull()).select(item, text)
    return found.mapInArrow(work, f"item {kind}, word string").distinct()


def document_terms(docs: DataFrame, key: str, text: str, vocabulary: list[str] | None) -> DataFrame:
    """``(row, key, n, terms, tfs)``: terms with repeats, and the distinct ones with their counts.

    With a ``vocabulary`` only its terms are listed; ``n`` counts all.
    """
    spark = docs.sparkSession
    told = None if vocabulary is None else spark.sparkContext.broadcast(pa.array([w.encode() for w in vocabulary], pa.large_binary()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 2, as_bytes=True):
            terms, counts = split_terms(texts)
            owner = np.repeat(np.arange(len(texts)), counts)
            if told is None:
                coded = terms.dictionary_encode()
                names, codes = coded.dictionary, coded.indices
            else:
                names, codes = told.value, pc.index_in(terms, value_set=told.value)
            held = np.asarray(pc.is_valid(codes))
            codes = np.asarray(pc.fill_null(codes, 0), dtype=np.int64)[held]
            pairs, tfs = np.unique(owner[held] * max(len(names), 1) + codes, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(len(names), 1)).astype(np.int32)
            listed = names.take(pa.array(pairs % max(len(names), 1))).cast(pa.string())
            yield pa.record_batch(
                [
                    part.column(0), part.column(1), pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), listed),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(tfs.astype(np.int64))),
                ],
                ["row", "key", "n", "terms", "tfs"],
            )

    # Rows that share a key are documents of their own.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"row bigint, key {sql_type(docs, key)}, n bigint, terms array<string>, tfs array<bigint>"
    return rows.mapInArrow(work, schema)


def weight(df: Column, documents: int) -> Column:
    """What a term is worth, from the number of documents that hold it."""
    return F.floor(1000.0 * F.log((2.0 * documents + 2) / (2.0 * df + 1))).cast("long")


# What a term adds to a document's score, in whole numbers: w, tf and n are columns.
CONTRIBUTION = "w * ((1000000000 * tf) div (1000 * tf + 20 * (100 - 50 + (50 * n * {documents}L) div {terms}L)))"


def _level(c: Column) -> Column:
    """Larger contributions have no smaller level."""
    return F.floor(LEVELS * F.log2(c.cast("double"))).cast("int")


def _steps(levels: DataFrame) -> DataFrame:
    """``(term, level, step, n, top)``: the step of reading at which each level's turn comes.

    ``levels (term, level, n, top)`` says how many postings a level of a list holds and which is the
    largest. Reading a list down to a level lowers the bound on what is left; the drop for each
    posting read is what that depth is worth, and its logarithm the step. A level is read as soon
    as any depth that includes it is worth it: rare terms to the end at once, frequent ones late.
    """
    up = Window.partitionBy("term").orderBy(F.desc("level"))
    down = Window.partitionBy("term").orderBy("level")
    below = down.rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.max("top").over(below), F.lit(0))
    deep = levels.withColumn("drop", F.max("top").over(up) - left).withColumn("reads", F.sum("n").over(up))
    worth = F.floor(STEPS * F.log2(F.col("drop") / F.col("reads"))).cast("int")
    deep = deep.withColumn("worth", worth).withColumn("step", F.max("worth").over(down))
    return deep.select("term", "level", "step", "n", "top")


def _lists(steps: DataFrame) -> DataFrame:
    """``(term, step, n, top, left)``: postings of a step, the largest, and the largest of later steps."""
    later = Window.partitionBy("term").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    each = steps.groupBy("term", "step").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    return each.withColumn("left", F.coalesce(F.max("top").over(later), F.lit(0)))


def _depths(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """``(item, step, reads, bound)``: postings read up to a step, and the most that is left to add."""
    each = asked.join(lists, "term").groupBy("item", "step")
    each = each.agg(F.sum("n").alias("n"), F.sum(F.col("top") - F.col("left")).alias("drop"))
    so_far = Window.partitionBy("item").orderBy(F.desc("step"))
    later = Window.partitionBy("item").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(
        "item", "step", F.sum("n").over(so_far).alias("reads"), F.coalesce(F.sum("drop").over(later), F.lit(0)).alias("bound")
    )


def _exploded(held: DataFrame, *kept: str) -> DataFrame:
    """A row per document and term."""
    found = held.select(*kept, F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return found.select(*kept, F.col("t.terms").alias("word"), F.col("t.tfs").alias("tf"))


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    first_read: int = FIRST_READ,
) -> DataFrame:
    """``(item, rank, key, score)``: the ``top`` documents of each item with a score above 0.

    Equal scores come by ascending key. All texts are read whole; null and empty ones have no terms
    and match nothing. Rows of one item are one item with the terms of all; items without key or
    terms give no rows. Rows that share a document key are documents of their own; a document
    without key counts in the statistics but is not returned. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = sql_type(items, item)
    schema = f"item {kind}, rank int, key {sql_type(docs, key)}, score bigint"
    told = [F.col("item").alias(item), "rank", F.col("key").alias(key), "score"]
    with Scratch(spark, "lexical") as scratch:
        asked = scratch.store(item_terms(items, item, item_text), "asked")
        words = asked.select("word").distinct()
        size = words.agg(F.sum(F.octet_length("word") + 8)).first()[0] or 0
        vocabulary = [r[0] for r in words.collect()] if size <= VOCABULARY_BYTES else None
        held = scratch.store(document_terms(docs, key, text, vocabulary), "documents")
        counted = held.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        documents, terms = counted[0], counted[1] or 0
        if not documents or not size:
            return scratch.finish(spark.createDataFrame([], schema).select(*told))

        weights = _exploded(held).groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(words, "word", "left_semi")
        weights = weights.select("word", weight(F.col("df"), documents).alias("w")).where("w > 0")
        # From here on a term is a number.
        weights = scratch.store(weights.withColumn("term", F.monotonically_increasing_id()), "weights")
        asked = scratch.store(join_small(asked, weights.select("word", "term"), "word").select("item", "term"), "asked")
        # Lists of long and short documents mix in parts of equal size, which are then sorted.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        even = held.where("key IS NOT NULL").select("row", "n", "terms", "tfs").repartition(parts, "row")
        added = join_small(_exploded(even, "row", "n"), weights, "word")
        added = added.select("row", "term", F.expr(CONTRIBUTION.format(documents=documents, terms=terms)).alias("c"))
        added = added.where("c > 0").withColumn("level", _level(F.col("c")))
        levels = added.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("top"))
        steps = scratch.store(_steps(levels), "steps")
        postings = join_small(added, steps.select("term", "level", "step"), ["term", "level"]).drop("level")
        # In the order of the steps, so that a filter on the step skips the pages behind it.
        postings = scratch.store(postings.sortWithinPartitions(F.desc("step"), "term"), "postings")
        lists = scratch.store(_lists(steps), "lists")
        depths = scratch.store(_depths(asked, lists), "depths")

        candidates = []
        # Items that are still open, with the k-th lower end so far.
        still = depths.select("item").distinct().withColumn("least", F.lit(0).cast("long"))
        still = scratch.store(still, "open")
        reads = first_read
        while still.count():
            state, ends = _round(scratch, postings, asked, lists, depths, still, reads, top)
            done = (F.col("bound") < F.col("least")) | (F.col("bound") == 0)
            closed = scratch.store(ends.where(done).select("item", "least"), "closed")
            inside = join_small(state, closed, "item").where("upper >= least").select("row").distinct()
            candidates.append((closed, scratch.store(inside, "candidates")))
            still = scratch.store(ends.where(~done).select("item", "least"), "open")
            reads *= DEEPER
        exact = None
        for closed, rows in candidates:
            more = _exact(postings, asked, closed, rows)
            exact = more if exact is None else exact.union(more)
        # Few more than the best are left; their keys decide ties.
        keyed = join_small(held.select("row", "key"), scratch.store(exact, "exact"), "row")
        best = Window.partitionBy("item").orderBy(F.desc("score"), "key", "row")
        ranked = keyed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        return scratch.finish(ranked.select(*told))


def _exact(postings: DataFrame, asked: DataFrame, closed: DataFrame, rows: DataFrame) -> DataFrame:
    """``(item, row, score)`` of the documents of closed items that reach the k-th lower end.

    The lists are read to their ends, for the documents among ``rows`` alone; no other can reach it.
    """
    if rows.count() <= BROADCAST_ROWS:
        mine = postings.join(F.broadcast(rows), "row", "left_semi").repartition("row")
    else:
        mine = postings.join(rows.hint("shuffle_hash"), "row", "left_semi")
    scores = join_small(mine, asked.join(closed, "item"), "term")
    scores = scores.groupBy("item", "row", "least").agg(F.sum("c").alias("score"))
    return scores.where("score >= least").select("item", "row", "score")


def _round(
    scratch: Scratch, postings: DataFrame, asked: DataFrame, lists: DataFrame, depths: DataFrame, still: DataFrame,
    reads: int, top: int,
) -> tuple[DataFrame, DataFrame]:
    """Reads on in the lists of the open items, to about ``reads`` postings each.

    An item whose k-th lower end is known reads no further than to the step at which no unseen
    document reaches that end. Returns ``(item, row, lower, upper)`` of documents that may still be
    among the best, and ``(item, least, bound)``: the k-th lower end (0 while fewer documents were
    seen) and the most that an unseen document can have.
    """
    # Steps go down; the highest that does, or else the last.
    enough = F.max(F.when((F.col("reads") >= reads) | (F.col("bound") < F.col("least")), F.col("step")))
    depth = depths.join(still, "item").groupBy("item").agg(F.coalesce(enough, F.min("step")).alias("step"))
    depth = depth.join(depths, ["item", "step"]).join(still, "item")
    depth = scratch.store(depth.select("item", F.col("step").alias("to"), "bound", F.col("least").alias("before")), "depth")
    last = depth.agg(F.min("to")).first()[0]
    open_lists = asked.join(depth.select("item", "to"), "item").join(lists, "term").where("step >= to")
    open_lists = open_lists.groupBy("item", "term", "to").agg(F.min("left").alias("left"))
    # A document's postings meet in one task first: pairs of item and document, which are many more,
    # are then added up where they arise.
    read = postings.where(F.col("step") >= last).select("row", "term", "step", "c").repartition("row")
    read = join_small(read, open_lists.join(depth, ["item", "to"]), "term").where("step >= to")
    seen = read.groupBy("item", "row", "bound", "before").agg(F.sum("c").alias("lower"), F.sum("left").alias("known"))
    ends = seen.withColumn("upper", F.col("lower") + F.col("bound") - F.col("known"))
    # What the last round's k-th lower end rules out goes before anything is stored.
    state = scratch.store(ends.where("upper >= before").select("item", "row", "lower", "upper"), "state")
    best = Window.partitionBy("item").orderBy(F.desc("lower"))
    last = state.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    last = last.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("lower").alias("lower"))
    kth = F.when(F.col("n") >= top, F.col("lower")).otherwise(0)
    both = depth.join(last, "item", "left").select("item", "bound", F.coalesce(kth, F.lit(0)).alias("least"))
    return state, scratch.store(both, "ends")


SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
sizes AS (SELECT doc_id, len(w) AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
found AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * max(documents) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w
  FROM found, totals GROUP BY term),
scores AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // terms)))) AS BIGINT) AS score
  FROM asked JOIN found USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""


@query("op12_lexical_search", SQL)
def _op12(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents for every benchmark text."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
