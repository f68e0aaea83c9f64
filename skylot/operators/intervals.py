"""Which entry of a schedule is active at a time.

An entry is active from its start to its end, both included within a tolerance; without an end it stays so. Of several active
entries the first in the schedule's order counts, and where none is active the schedule's last entry does.

Times are whole billionths of an hour, as the tolerance is, so nothing depends on the last bits. The schedule is resolved
once into pieces that don't overlap, in bins as wide as its entries are on average (so entries and pieces fall into few
bins each); after that a time is looked up by an equality join on its bin, without grouping, on tables and streams alike.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylot.sources.staging import staged

UNIT, EARLIEST, LATEST = 1_000_000_000, -(1 << 61), 1 << 61
#: Pieces that are broadcast at most; more are joined by a shuffle.
BROADCAST = 50_000
PIECES = "bin long, low long, high long, place long"


def units(hours: Column) -> Column:
    return F.floor(hours * UNIT + 0.5)


@dataclass
class Resolved:
    """A schedule's pieces (PIECES), the width of their bins, and its last place (None: it has no entry)."""

    pieces: DataFrame
    width: int
    last: int | None
    few: bool


def _swept(rows: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one bin, in each of which one place is the first: a sweep over starts with a heap of what is active."""
    rows = rows.sort_values("low", kind="stable")
    starts, out, active, at = list(zip(rows["low"], rows["high"], rows["place"], strict=True)), [], [], 0
    cuts = sorted({*rows["low"], *(rows["high"] + 1)})
    for low, after in zip(cuts, cuts[1:], strict=False):
        while at < len(starts) and starts[at][0] <= low:
            heapq.heappush(active, (starts[at][2], starts[at][1]))
            at += 1
        while active and active[0][1] < low:
            heapq.heappop(active)
        if active and out and out[-1][3] == active[0][0] and out[-1][2] == low - 1:
            out[-1][2] = after - 1
        elif active:
            out.append([rows["bin"].iloc[0], low, after - 1, active[0][0]])
    return pd.DataFrame(out, columns=["bin", "low", "high", "place"]).astype("int64")


def resolved(schedule: DataFrame, tolerance: int = 1) -> Resolved:
    """(place long, start_h, end_h or null) -> Resolved. Places are unique and give the order."""
    rows = schedule.select("place", (units(F.col("start_h")) - tolerance).alias("low"), (units(F.col("end_h")) + tolerance).alias("high"))
    rows = staged(rows.filter("high IS NULL OR high >= low"), "schedule")
    last = schedule.agg(F.max("place")).first()[0]
    # of entries without an end only those matter that start before all such entries of earlier places: each one until the one before it
    by_start = rows.filter("high IS NULL").groupBy("low").agg(F.min("place").alias("place"))
    steps, first = [], None
    for low, place in by_start.orderBy("place").toLocalIterator():  # a step down at a time
        if first is None or low < first:
            steps.append((place, low, LATEST if first is None else first))
            first = low
    closed = rows.filter("high IS NOT NULL")
    mean = closed.agg(F.avg(F.col("high") - F.col("low"))).first()[0] or UNIT
    spanned = closed.agg(F.min("low"), F.max("high")).first()
    low_all = min([x for x in (spanned[0], *(s[1] for s in steps)) if x is not None], default=0)
    high_all = max([x for x in (spanned[1], *(s[1] for s in steps)) if x is not None], default=0)
    width = max(1, int(mean), (high_all - low_all) // 1_000_000)
    open_ = schedule.sparkSession.createDataFrame(steps, "place long, low long, high long").withColumn("high", F.least("high", F.lit(high_all + 2 * width)))
    every = closed.select("place", "low", "high").unionByName(open_)
    binned = every.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    inside = binned.select("bin", F.greatest("low", F.col("bin") * width).alias("low"), F.least("high", (F.col("bin") + 1) * width - 1).alias("high"), "place")
    once = inside.groupBy("bin", "low", "high").agg(F.min("place").alias("place"))
    pieces = once.groupBy("bin").applyInPandas(_swept, PIECES)
    if steps:  # after all bins the open entry of the first place goes on
        beyond = (high_all + 2 * width) // width + 1
        pieces = pieces.unionByName(schedule.sparkSession.createDataFrame([(beyond, beyond * width, LATEST, steps[0][0])], PIECES))
    pieces = staged(pieces, "pieces")
    return Resolved(pieces, width, last, pieces.count() <= BROADCAST)


def active(times: DataFrame, time_h: str, found: Resolved, name: str = "active") -> DataFrame:
    """times, a table or a stream, with the place of the entry that is active at each; a null time has none."""
    beyond = found.pieces.filter(F.col("high") == LATEST).select("bin").first()
    at = units(F.col(time_h))
    bin_ = F.floor(F.col("_at") / found.width)
    rows = times.withColumn("_at", at).withColumn("_bin", F.least(bin_, F.lit(beyond[0])) if beyond else bin_)
    pieces = found.pieces.withColumnsRenamed({"bin": "_bin", "low": "_low", "high": "_high", "place": "_place"})
    pieces = F.broadcast(pieces) if found.few else pieces
    joined = rows.join(pieces, (rows["_bin"] == pieces["_bin"]) & F.col("_at").between(F.col("_low"), F.col("_high")), "left")
    place = F.when(F.col("_at").isNotNull(), F.coalesce("_place", F.lit(found.last).cast("long")))
    return joined.select(*(times[c] for c in times.columns), place.alias(name))
