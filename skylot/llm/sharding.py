"""Sharding by sampled splitters: contiguous ranges of the key, near equal in bytes.

All records are one range at first. A range that is overfull (more bytes than a part of a shard, or
more rows than a task should sort) is subdivided: records are drawn from it with a chance in proportion
to their bytes, the quantiles of the sample are its new boundaries, and its records are dealt out by
them. That is repeated until no range is overfull, so a bad sample costs a round, never a result. A
record's place is then its range's start, from exact sums over all ranges, plus what stands before it in
its range, and its shard follows from the bytes before it: shards differ by about one record's bytes.

Spark side: texts are read once, for their size and checksum; what goes on are narrow rows. Samples are of
bounded size a range (SAMPLE, in expectation) and stay on the executors; boundaries are joined back by
range. A tie-break by row makes all keys distinct, so one key that holds a third of all rows, or one
text, is cut like any other range.

Cases: a null text has no bytes and a size of 8; records are in the order of doc_id (null first), size and
checksum, equal ones in any order; shards that one large record covers are empty, as are some where
shards outnumber records; an empty table gives an empty one; further columns are ignored, and kept by `sharded`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.llm.common import staged

SHARDS, OVERHEAD = 24, 8
#: Records that a range may hold, parts of a shard that it may weigh, boundaries of a range, records drawn from it.
ROWS, PARTS, FAN, SAMPLE = 1 << 16, 2, 32, 1024
BROADCAST_RANGES, FILE_ROWS = 10_000, 50_000

KEY = ["doc_id", "size", "text_crc32", "tie"]


def records(docs: DataFrame, overhead: int = OVERHEAD, tie: Column | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, size, text_crc32, tie), one row a document. tie: tells rows apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), (F.monotonically_increasing_id() if tie is None else tie).alias("tie"))


def boundaries(rows: DataFrame, full: DataFrame, seed: int, fan: int = FAN, sample: int = SAMPLE) -> DataFrame:
    """(range, cuts): of each overfull range, keys at the quantiles of a sample drawn by size."""
    chance = F.col("size") * F.lit(float(sample)) / F.col("bytes")
    draw = F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = rows.join(full, "range").filter(draw < chance).withColumn("weight", F.greatest(F.lit(1.0), chance))
    by_key, whole = Window.partitionBy("range").orderBy(*KEY), Window.partitionBy("range")
    upto = F.sum("weight").over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    part = F.floor(upto * fan / F.sum("weight").over(whole) + F.lit(1e-9))
    # a cut before each record in which a quantile falls, but the first; the last one ends the last part, so two records make a cut
    marked = drawn.select("range", *KEY, part.alias("part")).withColumn("last", F.lag("part", 1).over(by_key)).filter("part > last")
    return marked.groupBy("range").agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("cuts"))  # fan at most


def _small(df: DataFrame) -> DataFrame:
    """A written frame of one row a range, broadcast if they are few; where they are more, each range is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_RANGES else df


def ranged(rows: DataFrame, shards: int = SHARDS, limit: int = ROWS, parts: int = PARTS, fan: int = FAN, sample: int = SAMPLE) -> DataFrame:
    """records() -> the same with range, written: ranges that follow one another by KEY, none overfull."""
    rows = staged(rows.withColumn("range", F.array(F.lit(0))), "records")
    total, level = rows.agg(F.sum("size")).first()[0] or 0, 0
    while True:
        heavy = F.col("bytes") * (shards * parts) > F.lit(total)
        sums = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        full = staged(sums.filter((F.col("n") > limit) | (F.col("n") > 1) & heavy).select("range", "bytes"), "full")
        if full.isEmpty():
            return rows
        cuts = staged(boundaries(rows, _small(full), level, fan, sample), "cuts")
        part = F.size(F.filter("cuts", lambda cut: cut <= F.struct(*KEY)))
        deeper = F.when(F.col("cuts").isNotNull(), F.concat("range", F.array(part))).otherwise(F.col("range"))
        rows, level = staged(rows.join(_small(cuts), "range", "left").withColumn("range", deeper).drop("cuts"), "ranges"), level + 1


def placed(rows: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """records() -> (doc_id, size, text_crc32, tie, shard int, slot long)."""
    found = ranged(rows, shards, **how)
    sums = found.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = staged(sums.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "n"))), "starts")
    total = found.agg(F.sum("size")).first()[0] or 1
    inside = Window.partitionBy("range").orderBy(*KEY)
    ahead = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    middle = 2 * ahead + F.col("size")
    at = staged(found.join(_small(starts), "range").select(
        *KEY, (F.col("n_before") + F.row_number().over(inside)).alias("at"),
        F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(2 * total))).cast("int").alias("shard")), "placed")
    first = at.groupBy("shard").agg(F.min("at").alias("first"))
    return at.join(F.broadcast(first), "shard").select(*KEY, "shard", (F.col("at") - F.col("first")).alias("slot"))  # one row a shard


def plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row a document."""
    return placed(records(docs), shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents themselves, with the columns of docs and shard and slot in place of such."""
    tied = staged(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.monotonically_increasing_id().alias("_tie")), "tied")
    own = tied.select("_row.doc_id", "_row.text", "_tie")
    found = placed(records(own, tie=F.col("_tie")), shards).select(F.col("tie").alias("_tie"), "shard", "slot")
    return tied.join(found, "_tie").select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS, file_rows: int = FILE_ROWS) -> None:
    """A folder a shard, its files in the order of slots, file_rows documents each."""
    found = sharded(docs, shards)
    part = F.floor(F.col("slot") / file_rows)
    found.withColumn("_part", part).repartition("shard", "_part").sortWithinPartitions("shard", "slot").drop("_part").write.partitionBy("shard").parquet(path)
