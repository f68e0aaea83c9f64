"""Joins of flights with what stands along them, by cells of a grid.

Flights are cut into segments of bounded length, so that a segment meets a bounded number of cells whatever the flight's
length; a segment stays in one cell, and buildings go to the cells that they can be met in. Both joins are equality joins on cells, so a crowded cell is a key that
adaptive execution can split, and no pair is made of places that aren't near each other.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylot.functions.scalars import noise_db

AXES = ("x", "y", "z")


def pieces(step: float) -> Column:
    """Into how many pieces of at most `step` a flight is cut; one at least."""
    length = F.sqrt(sum((F.col(f"b{a}") - F.col(f"a{a}")) * (F.col(f"b{a}") - F.col(f"a{a}")) for a in AXES))
    return F.greatest(F.lit(1), F.ceil(length / step)).cast("int")


def way_points(flights: DataFrame, step: float) -> DataFrame:
    """Flights (flight_id, ax, ay, az, bx, by, bz) in metres -> their way points (flight_id, seq, n, x, y, z), at most `step`
    apart and evenly spaced; a flight that goes nowhere has two points at one place."""
    points = flights.withColumn("n", pieces(step)).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n"))))
    place = [(F.col(f"a{a}") + (F.col(f"b{a}") - F.col(f"a{a}")) * F.col("seq") / F.col("n")).alias(a) for a in AXES]
    return points.select("flight_id", "seq", "n", *place)


def segments(flights: DataFrame, step: float) -> DataFrame:
    """The same flights as segments (flight_id, seq, ax .. bz) between neighbouring way points."""
    part = lambda a, i: F.col(f"a{a}") + (F.col(f"b{a}") - F.col(f"a{a}")) * i / F.col("n")
    cut = flights.withColumn("n", pieces(step))
    cut = cut.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    ends = [part(a, F.col("seq") + i).alias(f"{end}{a}") for i, end in ((0, "a"), (1, "b")) for a in AXES]
    return cut.select("flight_id", "seq", *ends)


#: Cells that a segment's box is wide at most, or it is looked at in parts of so many.
REACH = 4


def _reach(cell: float, margin: float, step: float | None) -> int:
    """Cells that the box of a segment of at most `step` metres meets along an axis at most."""
    return REACH if step is None else math.floor((step + 2 * margin + 1e-3) / cell) + 2


def nearby(parts: DataFrame, obstacles: DataFrame, cell: float, margin: float, step: float | None = None) -> DataFrame:
    """Pairs of segments and obstacles (obstacle_id, x, y, z, radius) whose cell lies in the box round the segment, widened
    by margin, with the cell cx, cy that they met in. A segment stays in the first cell of its box (of a box wider than REACH, in every REACH-th
    one), and obstacles, which are fewer, go to all cells that they can be met in. step: how long segments are at most."""
    reach, walked = _reach(cell, margin, step), parts
    for a in AXES:
        walked = walked.withColumns({f"l{a}": F.floor((F.least(f"a{a}", f"b{a}") - margin) / cell), f"h{a}": F.floor((F.greatest(f"a{a}", f"b{a}") + margin) / cell)})
    for a in "xy":
        walked = walked.withColumn(f"c{a}", F.explode(F.sequence(f"l{a}", f"h{a}", F.lit(reach).cast("long"))) if step is None else F.col(f"l{a}"))
    placed = obstacles.withColumns({f"i{a}": F.floor(F.col(a) / cell) for a in AXES})
    for a in "xy":
        placed = placed.withColumn(f"c{a}", F.explode(F.sequence(F.col(f"i{a}") - (reach - 1), F.col(f"i{a}"))))
    inside = functools.reduce(Column.__and__, [F.col(f"i{a}").between(F.col(f"l{a}"), F.col(f"h{a}")) for a in AXES])
    # hint: what a flight's rows become isn't in their estimated size, by which they would be broadcast
    return walked.hint("merge").join(placed, ["cx", "cy"]).filter(inside).drop(*(f"{e}{a}" for e in "lhi" for a in AXES))


def clearance() -> Column:
    """How far the obstacle's centre is from the closest point of the segment; of a segment of no length, from its place."""
    ab, ac = [F.col(f"b{a}") - F.col(f"a{a}") for a in AXES], [F.col(a) - F.col(f"a{a}") for a in AXES]
    square = ab[0] * ab[0] + ab[1] * ab[1] + ab[2] * ab[2]
    dot = ac[0] * ab[0] + ac[1] * ab[1] + ac[2] * ab[2]
    along = F.when(square == 0, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / square)))
    off = [F.col(f"a{a}") + along * d - F.col(a) for a, d in zip(AXES, ab, strict=True)]
    return F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])


def blocked(parts: DataFrame, obstacles: DataFrame, cell: float, margin: float, step: float | None = None) -> DataFrame:
    """(flight_id, seq, n_near, n_blocking, clearance) of the segments that have an obstacle near: those whose clearance is
    less than their radius block it. Where step says how long segments are at most, each lies in one cell, and its counts need no
    further shuffle."""
    pairs = nearby(parts, obstacles, cell, margin, step).withColumn("clearance", clearance())
    keys = ["flight_id", "seq"] if step is None else ["cx", "cy", "flight_id", "seq"]
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_near"), F.count_if(F.col("clearance") < F.col("radius")).alias("n_blocking"),
                                    F.min("clearance").alias("clearance")).select("flight_id", "seq", "n_near", "n_blocking", "clearance")


def audible(spark: SparkSession, height: float, radius: float, threshold: float, source_db: float) -> float:
    """Metres, at most radius, beyond which a flight isn't heard above the threshold: noise falls with the distance."""
    heard = spark.range(math.ceil(radius) + 1).filter(noise_db(F.col("id").cast("double"), F.lit(height), source_db) > threshold).agg(F.max("id")).first()[0]
    return min(radius, 1.0 if heard is None else heard + 1.0)


def hearers(flights: DataFrame, residences: DataFrame, step: float, height: float, radius: float = 400.0, threshold: float = 45.0, source_db: float = 75.0, tile: float = 1000.0) -> DataFrame:
    """noise_impact() of the way points of flights (flight_id, ax .. bz), at most `step` apart, without a row a way point: a
    flight goes to the tiles that it can be heard in and a residence to its own, so that a pair is made once. Points on a line come nearer
    until the one nearest and go away from there, so the points round the foot of the perpendicular are enough."""
    reach = audible(flights.sparkSession, height, radius, threshold, source_db)
    ab = [F.col(f"b{a}") - F.col(f"a{a}") for a in AXES]
    part = lambda a, s: f"a{a} + (b{a} - a{a}) * {s} / m"
    cells = lambda a: f"sequence(floor((least({part(a, 's')}, {part(a, '(s + 1)')}) - {reach + 1}) / {tile}), floor((greatest({part(a, 's')}, {part(a, '(s + 1)')}) + {reach + 1}) / {tile}))"
    tiles = f"array_distinct(flatten(transform(sequence(0, m - 1), s -> flatten(transform({cells('x')}, i -> transform({cells('y')}, j -> struct(i AS tx, j AS ty)))))))"
    cut = flights.withColumns({"n": pieces(step), "m": pieces(tile)})
    sent = cut.select("flight_id", "n", *(f"{e}{a}" for e in "ab" for a in AXES), F.expr(f"inline({tiles})"))
    placed = residences.select("residence_id", *AXES, *(F.floor(F.col(a) / tile).alias(f"t{a}") for a in "xy"))
    square = ab[0] * ab[0] + ab[1] * ab[1] + ab[2] * ab[2]
    along = sum((F.col(a) - F.col(f"a{a}")) * d for a, d in zip(AXES, ab, strict=True)) / square
    pairs = sent.hint("merge").join(placed, ["tx", "ty"]).filter(clearance() <= reach + 1)
    foot = F.when(square == 0, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)) * F.col("n")).cast("int"))

    def apart(i: int) -> Column:
        seq = F.greatest(F.lit(0), F.least(F.col("n"), F.col("foot") + i))
        off = [F.col(f"a{a}") + d * seq / F.col("n") - F.col(a) for a, d in zip(AXES, ab, strict=True)]
        return F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])

    near = pairs.withColumn("foot", foot).select("flight_id", "residence_id", F.least(*map(apart, (-1, 0, 1, 2))).alias("d"))
    heard = near.filter((F.col("d") <= radius) & (noise_db(F.col("d"), F.lit(height), source_db) > threshold))
    return heard.groupBy("flight_id").agg(F.count_distinct("residence_id").alias("n_affected"))


def noise_impact(points: DataFrame, residences: DataFrame, height: float, radius: float = 400.0, threshold: float = 45.0, source_db: float = 75.0) -> DataFrame:
    """(flight_id, n_affected): residences (residence_id, x, y, z) that hear more than the threshold at one way point at least,
    each once a flight. Residences go to the nine cells round theirs; way points, of which there are more, stay in one."""
    cells = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = residences.select("residence_id", *(F.col(a).alias(f"r{a}") for a in AXES), F.inline(cells))
    spread = spread.withColumns({"ix": F.floor(F.col("rx") / radius) + F.col("dx"), "iy": F.floor(F.col("ry") / radius) + F.col("dy")}).drop("dx", "dy")
    placed = points.select("flight_id", *AXES, F.floor(F.col("x") / radius).alias("ix"), F.floor(F.col("y") / radius).alias("iy"))
    off = [F.col(a) - F.col(f"r{a}") for a in AXES]
    apart = F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
    heard = placed.join(spread, ["ix", "iy"]).withColumn("d", apart).filter((F.col("d") <= radius) & (noise_db(F.col("d"), F.lit(height), source_db) > threshold))
    return heard.groupBy("flight_id").agg(F.count_distinct("residence_id").alias("n_affected"))
