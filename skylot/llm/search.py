"""Ranked lexical search over all documents by a two-level quantised index.

A term's part in a document's score is w * impact, where impact = 10^9 tf div (1000 tf + 20 m) falls with the
document's length m. The index holds one row a document: its terms, their impacts as bytes rounded
upwards (level one) and their frequencies (level two). Level one bounds a score from both sides, since an
impact lies between its byte's step and the step below. The kth largest lower bound of an item over all
documents is a score that k documents reach; every document whose upper bound reaches it, and no other, is
scored anew from its frequencies in exact integers.

Spark side: the corpus is read once for a block of items (ITEM_TERMS terms, so that what a task holds of
the items doesn't grow). Tasks read narrow index rows in Arrow batches, keep the best k of each item, and
send those only: k rows an item and task, merged in two rounds. Common terms make no pairs that are sent.

Cases: null and empty texts have no term, count for nothing and are found by nothing; rows that share a
doc_id are ranked apart, in any order where their scores are equal; a null doc_id comes last among equal
scores; texts of one item_id (null as well) are one item; an item without terms has no rows; documents of
score 0 aren't returned; empty tables give an empty one; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.llm.common import staged, union
from skylot.llm.terms import slices, split

K = 50
#: Terms of a block of items, on average; index rows, and meetings of a posting and an item, scored at once; rounds' fan-in.
ITEM_TERMS, ROWS, MEETINGS, FAN_IN = 1 << 16, 512, 4_000_000, 64
#: Impacts are at most 10^6; a byte stands for so much of it.
STEP = -(-1_000_000 // 255)

POSTED = "doc_id long, n long, terms array<int>, tfs array<int>"
INDEXED = POSTED + ", bytes binary"
BEST = "item int, doc_id long, score long, task int"


@functools.lru_cache(1)
def _numbers(words: tuple[bytes, ...]) -> dict[bytes, int]:
    """The block's terms by number, made once a Python worker."""
    return {w: i for i, w in enumerate(words)}


def postings(docs: DataFrame, words: tuple[bytes, ...]) -> DataFrame:
    """(doc_id, text) -> POSTED: documents of at least one term; n counts all terms, the arrays hold the given ones."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers(words)
        for part, texts in slices(batches):
            found = [split(t) for t in texts]
            n = np.array([len(x) for x in found], np.int64)
            of = np.repeat(np.arange(len(found)), n)
            term = np.fromiter((number.get(w, -1) for x in found for w in x), np.int64, len(of))
            keys, tf = np.unique((of * len(words) + term)[term >= 0], return_counts=True)
            row, term = np.divmod(keys, max(1, len(words)))
            offsets = pa.array(np.searchsorted(row, np.arange(len(found) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(post, POSTED)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)


def frequencies(posted: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each of the block's terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch, "terms"), minlength=n_terms)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["term", "n"])

    df = np.zeros(n_terms, np.int64)
    for term, n in posted.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # the block's terms
        df[term] = n
    return df


def _impacts(n: np.ndarray, tf: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Of flat postings: n is the document's length at each."""
    m = 50 + (50 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def indexed(posted: DataFrame, documents: int, terms: int) -> DataFrame:
    """POSTED -> INDEXED: a byte a posting, its impact rounded upwards to steps."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = _sizes(batch)
            exact = _impacts(np.repeat(batch.column("n").to_numpy(), size), _flat(batch, "tfs").astype(np.int64), documents, terms)
            level = (-(-exact // STEP)).astype(np.uint8).tobytes()
            ends = np.cumsum(size).tolist()
            parts = pa.array([level[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "bytes"])

    return posted.mapInArrow(quantise, INDEXED)


class Items:
    """A block of items: which items hold a term, and what the term weighs."""

    def __init__(self, pairs: list[tuple[int, int]], n_items: int, n_terms: int, weight: np.ndarray):
        by_term = np.array(sorted(pairs, key=lambda p: p[::-1]), np.int64).reshape(-1, 2)
        self.items, self.weight, self.n = by_term[:, 0], weight, n_items
        self.starts = np.searchsorted(by_term[:, 1], np.arange(n_terms + 1))

    def sums(self, rows: np.ndarray, terms: np.ndarray, n_rows: int, *values: np.ndarray) -> list[np.ndarray]:
        """Of each row and item, the sum of weight * value over the row's postings that the item asks for.
        Sums are below 2^53, so exact as doubles."""
        first, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        ends = np.cumsum(size)
        item = self.items[np.repeat(first - ends + size, size) + np.arange(int(size.sum()))]
        cell = np.repeat(rows * self.n, size) + item
        w = self.weight[terms]
        return [np.bincount(cell, np.repeat((w * v).astype(float), size), n_rows * self.n).astype(np.int64).reshape(n_rows, self.n) for v in values]


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """Rows (item, doc, no doc_id, score), the k first of each item: high scores, then small doc_ids."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], -rows[:, 3], rows[:, 0]))]
    item = rows[:, 0]
    return rows[np.arange(len(rows)) - np.searchsorted(item, item) < k]


def _scan(index: DataFrame, items: Items, k: int, columns: list[str], cells: Callable) -> DataFrame:
    """The k best of each item in each task, BEST. cells(batch, rows) -> (rows, items, scores) of the cells that count."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept, waiting = np.empty((0, 4), np.int64), []
        reached = np.zeros(items.n, np.int64)  # k documents of this task have such scores
        rows = max(1, min(ROWS, MEETINGS // max(1, len(items.items))))  # a row meets an item once a term at most
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                row, item, score = cells(part, np.repeat(np.arange(part.num_rows), _sizes(part)))
                near = score >= reached[item]
                row, item, score = row[near], item[near], score[near]
                doc = part.column("doc_id")
                ids, null = doc.fill_null(0).to_numpy()[row], doc.is_null().to_numpy(zero_copy_only=False)[row]
                waiting.append(np.stack([item, ids, null.astype(np.int64), score], axis=1))
                if sum(map(len, waiting)) > 4 * k * items.n:
                    kept, waiting = _best([kept, *waiting], k), []
                    full = np.flatnonzero(np.bincount(kept[:, 0], minlength=items.n) == k)
                    reached[full] = kept[np.searchsorted(kept[:, 0], full, "right") - 1, 3]
        kept = _best([kept, *waiting], k)
        task = np.full(len(kept), TaskContext.get().partitionId() if TaskContext.get() else 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept[:, 0], pa.int32()), pa.array(kept[:, 1], mask=kept[:, 2] == 1), pa.array(kept[:, 3]), pa.array(task, pa.int32())],
            ["item", "doc_id", "score", "task"])

    return index.select("doc_id", "n", "terms", *columns).mapInArrow(scan, BEST)


def _first(best: DataFrame, k: int) -> DataFrame:
    """BEST of tasks -> the k first of each item, with rank: in groups of tasks, then all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = Window.partitionBy("item", F.floor(F.col("task") / FAN_IN)).orderBy(*order)
    some = best.withColumn("_at", F.row_number().over(near)).filter(F.col("_at") <= k).drop("_at")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def lower_bounds(index: DataFrame, items: Items, k: int) -> np.ndarray:
    """Each item's kth largest lower bound, by level one; 0 where fewer documents have one."""

    def cells(part, rows):
        level = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8).astype(np.int64)
        (low,) = items.sums(rows, _flat(part, "terms"), part.num_rows, np.maximum((level - 1) * STEP + 1, 0) * (level > 0))
        row, item = np.nonzero(low)
        return row, item, low[row, item]

    bound = np.zeros(items.n, np.int64)
    for item, score in _first(_scan(index, items, k, ["bytes"], cells), k).filter(F.col("rank") == k).select("item", "score").collect():  # the block's items
        bound[item] = score
    return bound


def rescored(index: DataFrame, items: Items, bound: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """Exact scores of all documents whose upper bound reaches the item's bound: the k first, with rank."""

    def cells(part, rows):
        level = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8).astype(np.int64)
        term = _flat(part, "terms")
        (high,) = items.sums(rows, term, part.num_rows, level * STEP)
        reaches = (high >= bound) & (high > 0)
        some = reaches.any(axis=1)  # level two of these only
        at = some[rows]
        n = part.column("n").to_numpy()[rows[at]]
        exact = _impacts(n, _flat(part, "tfs").astype(np.int64)[at], documents, terms)
        (score,) = items.sums(rows[at], term[at], part.num_rows, exact)
        row, item = np.nonzero(reaches & (score > 0))
        return row, item, score[row, item]

    return _first(_scan(index, items, k, ["bytes", "tfs"], cells), k)


FOUND = "item_id long, rank int, doc_id long, score long"


def _block(docs: DataFrame, block: list[tuple[int | None, bytes]], k: int) -> DataFrame:
    """FOUND of some items (item_id, text)."""
    spark = docs.sparkSession
    words = tuple(sorted({w for _, text in block for w in split(text)}))
    number = _numbers(words)
    ids = sorted({i for i, _ in block}, key=lambda i: (i is None, i or 0))
    place = {i: at for at, i in enumerate(ids)}
    pairs = list({(place[i], number[w]) for i, text in block for w in split(text)})
    posted = staged(postings(docs, words), "postings")
    documents, terms = posted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents or not words:
        return spark.createDataFrame([], FOUND)
    weight = np.array([math.floor(1000 * math.log((2.0 * documents + 2.0) / (2.0 * n + 1.0))) for n in frequencies(posted, len(words)).tolist()], np.int64)
    index = staged(indexed(posted, documents, terms), "index")
    items = Items(pairs, len(ids), len(words), weight)
    found = rescored(index, items, lower_bounds(index, items, k), documents, terms, k)
    # as many as the block's items
    known = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "item int, item_id long"))
    return found.join(known, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def searched(docs: DataFrame, items: DataFrame, k: int = K, item_terms: int = ITEM_TERMS) -> DataFrame:
    """(doc_id, text), (item_id, text) -> FOUND: each item's k documents of the highest scores above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    most = asked.agg(F.sum(F.length("text"))).first()[0] or 0  # bytes, so more than twice the terms
    blocks = max(1, math.ceil(most / (2 * item_terms)))
    if blocks == 1:
        return _block(docs, [(i, bytes(t)) for i, t in asked.collect()], k)
    dealt = staged(asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).repartition("block"), "items")
    found = [_block(docs, [(i, bytes(t)) for i, t in dealt.filter(F.col("block") == b).select("item_id", "text").collect()], k) for b in range(blocks)]
    return union(found) if found else spark.createDataFrame([], FOUND)
