"""Importance resampling of documents towards a target distribution.

A document's features are its words and pairs of neighbouring words, in buckets by CRC-32. How often
each bucket occurs in all documents and in all target texts gives an array of gains; a document's
weight is the floored mean of the gains of its features, looked up in that array. With Gumbel noise
from a hash of the document's id, the highest scores are a draw without replacement by weight.

Spark side: two scans of the texts in Arrow batches. The first sends one count a bucket and task, the
second narrow rows (id, weight, score). How many rows have each score (under 200,000 scores at any size,
see SCORES) tells the lowest score that can be drawn; what is above goes into runs that are
sorted in their partitions and written. Runs are cut by ranges of the order, of about RANGE rows, and in
each range a task merges its runs by tournament trees of at most FAN_IN runs each, one tree's winners
being a run of the next, and stops at the draw's count. A range's first rank is the count of the ranges
before, so no task sees all rows. Everything is decided by counts over all rows.

Cases: a null or empty text has no feature, weight 0, and can't be drawn below `least` words; a null
doc_id hashes as an empty one and comes last among equal scores; rows that share a doc_id are documents
of their own with equal noise, equal ones in any order; an empty target gives gains by the
documents' counts alone; an empty table gives an empty one; further columns are ignored, and kept by `drawn`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.llm.common import staged
from skylot.llm.terms import checks, slices, split

BUCKETS, LEAST, PERCENT, SEED = 10_000, 20, 25, 7
#: Weights are within 1000 * ln(2^63 * BUCKETS) = 53,000 either way, noise between -3,200 and 22,900: so many scores at most.
SCORES = 200_000
RANGE, FAN_IN = 1 << 17, 64

COUNTED = "bucket long, n long"
WEIGHED = "doc_id long, content long, n_words long, n_features long, weight long"


def _features(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket of each word, bucket of each pair, place of a pair's first word)."""
    words, sizes = [], []
    for text in texts:
        own = split(text)
        words += own
        sizes.append(len(own))
    n = np.array(sizes, np.int64)
    alone, pairs, first = checks().of(words, np.cumsum(n) - n)
    return n, alone.astype(np.int64) % buckets, pairs.astype(np.int64) % buckets, first


def counted(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """(text) -> how many features of all texts are in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, part in slices(batches):
            _, alone, pairs, _ = _features(part, buckets)
            total += np.bincount(alone, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, COUNTED).groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows
        total[bucket] = n
    return total


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain: 1000 times the logarithm of how much commoner it is in the target, floored."""
    s, t = counted(docs, buckets), counted(target, buckets)
    total_s, total_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * total_s / ((a + 1.0) * total_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, text) -> WEIGHED; content tells texts apart."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            n, alone, pairs, first = _features(texts, len(gain))
            ends = np.cumsum(n)
            mass = np.concatenate([[0], np.cumsum(gain[alone])])
            of_pair = np.zeros(len(alone) + 1, np.int64)
            of_pair[first + 1] = gain[pairs]
            mass += np.cumsum(of_pair)  # up to a word: its own gain and that of the pair it begins
            features = 2 * n - (n > 0)
            weight = (mass[ends] - mass[ends - n]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("content"), *(pa.array(x, pa.int64()) for x in (n, features, weight))],
                ["doc_id", "content", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("content"), "text").mapInArrow(weigh, WEIGHED)


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """WEIGHED with score: the weight and Gumbel noise by a hash of the doc_id."""
    word = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(word, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + noise)


END = (math.inf,)


def tournament(runs: list[list[tuple]], stop: int) -> list[tuple]:
    """The least `stop` rows of sorted runs, in order, by a tree of losers: the winner leaves, and its run's
    next row plays against the losers on the way to the root."""
    k = len(runs)
    rest = [iter(run) for run in runs]
    heads = [next(r, END) for r in rest]
    won, lost = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node], lost[node] = (b, a) if heads[b] < heads[a] else (a, b)
    top, out = won[1] if k > 1 else 0, []
    while len(out) < stop and heads[top] is not END:
        out.append(heads[top])
        heads[top] = next(rest[top], END)
        node = (top + k) // 2
        while node:
            if heads[lost[node]] < heads[top]:
                lost[node], top = top, lost[node]
            node //= 2
    return out


def merged(runs: list[list[tuple]], stop: int, fan_in: int = FAN_IN) -> list[tuple]:
    """tournament() over any number of runs: trees of at most fan_in, whose winners are runs of the next tree."""
    while len(runs) > fan_in:
        runs = [tournament(runs[at:at + fan_in], stop) for at in range(0, len(runs), fan_in)]
    return tournament(runs, stop) if runs else []


RANKED = "doc_id long, content long, n_features long, weight long, score long, rank long"


def ranked(rows: DataFrame, percent: int = PERCENT, least: int = LEAST, range_rows: int = RANGE) -> DataFrame:
    """What scored() gives, written -> RANKED, all rows: the floor(percent * N / 100) highest scores of the N
    documents of `least` words or more are ranked from 1, equal scores by doc_id; the others have no rank."""
    counts = rows.groupBy("score").agg(F.count_if(F.col("n_words") >= least).alias("n")).filter("n > 0").collect()  # SCORES rows at most
    assert len(counts) <= SCORES
    draw, above, low = percent * sum(n for _, n in counts) // 100, 0, None
    for score, n in sorted(counts, reverse=True):
        if above >= draw:
            break
        above, low = above + n, score
    names = [f.split()[0] for f in RANKED.split(", ")][:-1]
    if low is None:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    runs_for = (F.col("n_words") >= least) & (F.col("score") >= low)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    runs = staged(rows.filter(runs_for).select(*names).withColumn("run", F.spark_partition_id())
                  .sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "runs")
    ranges = max(1, math.ceil(above / range_rows))
    cut = staged(runs.repartitionByRange(ranges, *order, "run", "place").withColumn("range", F.spark_partition_id()), "cut")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("place", "ascending")])
        doc, score = table["doc_id"].to_pylist(), table["score"].to_pylist()
        rows = list(zip((-s for s in score), (d is None for d in doc), (d or 0 for d in doc),
                        table["n_features"].to_pylist(), table["weight"].to_pylist(), range(len(doc)), strict=True))
        ends = [*(np.flatnonzero(np.diff(table["run"].to_numpy())) + 1).tolist(), len(rows)]
        start = table["start"][0].as_py()
        drawn = merged([rows[a:b] for a, b in zip([0, *ends], ends, strict=False)], draw - start)
        rank = np.zeros(len(rows), np.int64)
        rank[[row[-1] for row in drawn]] = np.arange(start + 1, start + 1 + len(drawn))
        return table.select(names).append_column("rank", pa.array(rank, pa.int64(), mask=rank == 0))

    # as many rows as there are ranges, each of range_rows
    drawn = cut.join(F.broadcast(starts), "range").groupBy("range").applyInArrow(merge, RANKED)
    return rows.filter(~runs_for).select(*names, F.lit(None).cast("long").alias("rank")).unionByName(drawn)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """RANKED, one row a document."""
    return ranked(staged(scored(docs, target, buckets, seed), "scored"), percent, least)


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The draw itself: the columns of docs, and rank in place of one of that name. Of rows that share doc_id and
    text the first one's further columns stand for all."""
    ranks = resampled(docs, target, **how).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_d"), F.col("content").alias("_c"), "rank")
    whole = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_c"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    one = whole.groupBy("_d", "_c").agg(F.first("_row").alias("_row"))
    both = ranks.withColumnsRenamed({"_d": "_e", "_c": "_f"}).join(one, F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_c") == F.col("_f")))
    return both.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "rank"), "rank")
