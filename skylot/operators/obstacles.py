"""Segments of flights held against the obstacles round them, a tile of the ground at a time.

A flight goes to each tile that its segments begin in as one row, and its segments are made there; an obstacle goes to the
tiles that it can be met in. No row is made of a pair: a tile's segments that share a box of cells are compared with the
obstacles of those cells as matrices. Those hold single floats, whose squares of distances are right within a bound; what lies
closer than that to a radius, or to the least of all, is computed again by the formula of spatial.clearance(). Tiles with
many segments are dealt to several groups, so what a task holds is bounded by LIMIT and the obstacles of a tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylot.operators.spatial import AXES, _reach, pieces
from skylot.sources.staging import staged

ENDS = [f"{e}{a}" for e in "ab" for a in AXES]
#: Cells that a tile is wide; segments of a group; pairs of a matrix, which stays in a core's cache.
TILE, LIMIT, PAIRS = 16, 500_000, 1 << 17


def _cut(rows: pa.Table, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row's `many` segments from `first` on -> (row, seq, starts, ends), the latter with three rows x, y, z, as spatial.segments()
    makes them."""
    row = np.repeat(np.arange(len(many)), many)
    seq = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
    held = {c: rows.column(c).to_numpy()[row] for c in (*ENDS, "n")}
    at = lambda i: np.array([held[f"a{a}"] + (held[f"b{a}"] - held[f"a{a}"]) * i / held["n"] for a in AXES])
    return row, seq, at(seq), at(seq + 1)


def _runs(cell: float, margin: float) -> Callable:
    """Flights -> a row for each run of segments whose boxes begin in one tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column("n").to_numpy().astype(np.int64)
            row, seq, a, b = _cut(pa.Table.from_batches([batch]), np.zeros(len(many), np.int64), many)
            tx, ty = np.floor(np.floor((np.minimum(a, b)[:2] - margin) / cell) / TILE).astype(np.int64)
            other = (np.diff(row) != 0) | (np.diff(tx) != 0) | (np.diff(ty) != 0)
            start = np.flatnonzero(np.concatenate([[len(row) > 0], other]))
            stop = np.append(start[1:], len(row)) - 1
            kept = batch.take(pa.array(row[start]))
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, (tx[start], ty[start], seq[start], seq[stop]))], [*batch.schema.names, "tx", "ty", "first", "last"])

    return run


def _met(flights: DataFrame, placed: DataFrame, step: float, cell: float, margin: float, found: Callable, schema: str) -> DataFrame:
    """found(runs, obstacles) of each tile. Equal rows of flights are one, with how often it came; placed: obstacles by tile."""
    spark, kind = flights.sparkSession, flights.schema["flight_id"].dataType.simpleString()
    cut = flights.groupBy("flight_id", *ENDS).agg(F.count(F.lit(1)).alias("times")).withColumn("n", pieces(step))
    runs = cut.mapInArrow(_runs(cell, margin), f"flight_id {kind}, {', '.join(f'{c} double' for c in ENDS)}, times long, n int, tx long, ty long, first long, last long")
    sizes = staged(runs.groupBy("tx", "ty").agg(F.sum(F.col("last") - F.col("first") + 1).alias("segments")), "sizes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sizes.agg(F.sum("segments")).first()[0] or 0) // LIMIT)
    shares, keys = sizes.select("tx", "ty", F.ceil(F.col("segments") / LIMIT).alias("shares")), ["tx", "ty", "share"]
    dealt = runs.join(shares, ["tx", "ty"]).withColumn("share", F.pmod(F.xxhash64("flight_id"), "shares")).drop("shares")
    spread = placed.join(shares, ["tx", "ty"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    return dealt.repartition(parts, *keys).groupBy(*keys).cogroup(spread.repartition(parts, *keys).groupBy(*keys)).applyInArrow(found, f"flight_id {kind}, {schema}")


def _tiled(obstacles: DataFrame, low: Callable[[str], Column], high: Callable[[str], Column]) -> DataFrame:
    """Obstacles in the tiles of the cells from low to high of each axis."""
    for a in "xy":
        obstacles = obstacles.withColumn(f"t{a}", F.explode(F.sequence(F.floor(low(a) / TILE), F.floor(high(a) / TILE))))
    return obstacles.select("tx", "ty", *AXES, "radius")


def _blocks(low: np.ndarray, high: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments whose boxes of cells begin in one block, block by block: (segments, which box each has, the boxes' low and high
    ends). Few segments and n obstacles are worth wide blocks, for a block costs about as much as 60,000 pairs; many go box by box (0)."""
    ends = np.concatenate([low, high])
    least, sizes = ends.min(axis=1, keepdims=True), np.ptp(ends, axis=1) + 1
    kinds, own = np.unique(np.ravel_multi_index(ends - least, sizes), return_inverse=True)
    boxes, axes = np.array(np.unravel_index(kinds, sizes)), len(low)
    wide = (boxes[axes:axes + 2] - boxes[:2] + least[axes:axes + 2] - least[:2]).max() + 1
    reached = lambda w: ((min(w, TILE) + wide - 1) / (TILE + wide - 1)) ** 2
    many = {w: math.prod(-(-sizes[:2] // w)) for w in (1, 2, 4, 8, TILE)}
    width = min((60_000 * many[w] + len(own) * n * reached(w), w) for w in many)
    if 60_000 * len(kinds) + len(own) * n * reached(1) / 2 < width[0]:
        block = np.arange(len(kinds))
    else:
        block = boxes[0] // width[1] * (sizes[1] // width[1] + 1) + boxes[1] // width[1]
    turn = np.argsort(block, kind="stable")
    place = np.empty_like(turn)
    place[turn] = np.arange(len(turn))
    own, boxes = place[own], boxes[:, turn] + least
    order, start = np.argsort(own, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(own))])
    edges = [0, *(np.flatnonzero(np.diff(block[turn])) + 1), len(turn)]
    for i, j in zip(edges, edges[1:], strict=False):
        segments = order[start[i]:start[j]]
        yield segments, own[segments] - i, boxes[:axes, i:j], boxes[axes:, i:j]


def _parts(segments: int, n: int) -> Iterator[slice]:
    """So many segments at a time as make PAIRS with n obstacles."""
    many = max(1, PAIRS // n)
    return (slice(i, i + many) for i in range(0, segments, many))


def _true(pairs: np.ndarray, start: int) -> np.ndarray:
    """np.nonzero() of a matrix, which is slow where it has few; its rows are counted from start."""
    i, j = np.divmod(np.flatnonzero(pairs), pairs.shape[1])
    return np.array([i + start, j])


class _Stood:
    """A tile's obstacles, in the order of their cells."""

    def __init__(self, rows: pa.Table, cell: float):
        place, radius = np.array([rows.column(a).to_numpy() for a in AXES]), rows.column("radius").to_numpy()
        cells = np.floor(place / cell).astype(np.int64)
        self.least, most = cells[:2].min(axis=1), cells[:2].max(axis=1)
        self.wide, self.deep = most - self.least + 1
        key = (cells[0] - self.least[0]) * self.deep + cells[1] - self.least[1]
        order = np.argsort(key, kind="stable")
        self.place, self.radius, self.cells = place[:, order], radius[order], cells[:, order]
        self.start = np.searchsorted(key[order], np.arange(self.wide * self.deep + 1))

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The obstacles whose cells lie between low and high along x and y."""
        x0, y0 = np.maximum(low[:2] - self.least, 0)
        x1, y1 = min(high[0] - self.least[0], self.wide - 1), min(high[1] - self.least[1], self.deep - 1)
        if x0 > x1 or y0 > y1:
            return np.zeros(0, np.int64)
        return np.concatenate([np.arange(self.start[x * self.deep + y0], self.start[x * self.deep + y1 + 1]) for x in range(x0, x1 + 1)])


def _off(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """spatial.clearance() of segments and obstacles side by side."""
    u, c = b - a, place - a
    square, dot = u[0] * u[0] + u[1] * u[1] + u[2] * u[2], c[0] * u[0] + c[1] * u[1] + c[2] * u[2]
    along = np.where(square == 0, 0.5, np.maximum(0.0, np.minimum(1.0, dot / np.where(square == 0, 1.0, square))))
    off = a + along * u - place
    return np.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])


class _Squares:
    """The squares of the clearances of a block's segments from its obstacles, as single floats, which may be wrong by slack:
    each is |c|^2 + |u|^2 t (t - 2 s) with c from the start to the obstacle, u along the segment, s = c u / |u|^2 and t = s held in 0 to 1.
    The matrices lie in arrays that all blocks of a tile share, since new ones cost more than what is done in them."""

    def __init__(self, obstacles: int):
        self.held, self.marked = np.empty((3, max(PAIRS, obstacles)), np.float32), np.empty((2, max(PAIRS, obstacles)), bool)

    def take(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> float:
        """The block to be looked at; returns slack."""
        middle = ((np.minimum(a, b).min(axis=1) + np.maximum(a, b).max(axis=1)) / 2)[:, None]
        p, q, u, o = a - middle, b - middle, b - a, place - middle
        pp, uu, oo, pu = (p * p).sum(axis=0), (u * u).sum(axis=0), (o * o).sum(axis=0), (p * u).sum(axis=0)
        over, none, one = np.where(uu > 1e-9, 1 / np.maximum(uu, 1e-9), 0.0), np.zeros(len(pp)), np.ones(len(pp))
        self.right = np.array([*o, oo, np.ones(len(oo))], np.float32)
        self.along, self.apart = np.array([*(u * over), none, -pu * over], np.float32).T.copy(), np.array([*(-2 * p), one, pp], np.float32).T.copy()
        self.length = uu.astype(np.float32)[:, None]
        largest = max(pp.max(), oo.max(), (q * q).sum(axis=0).max())
        return 1e-5 * largest + 1e-3 * math.sqrt(largest)

    def of(self, part: slice) -> np.ndarray:
        left, shape = self.along[part], (len(self.along[part]), self.right.shape[1])
        s, squares, t = (x[:shape[0] * shape[1]].reshape(shape) for x in self.held)
        np.matmul(left, self.right, out=s)
        np.matmul(self.apart[part], self.right, out=squares)
        np.clip(s, np.float32(0), np.float32(1), out=t)
        s *= np.float32(-2)
        s += t
        t *= self.length[part]
        t *= s
        squares += t
        return squares

    def beyond(self, squares: np.ndarray, rows: np.ndarray, which: np.ndarray) -> None:
        """Adds the row that each segment has of rows: infinite for the obstacles outside of its box."""
        squares += np.take(rows, which, axis=0, out=self.held[2][:squares.size].reshape(squares.shape), mode="clip")

    def below(self, squares: np.ndarray, *bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(np.less_equal(squares, x, out=m[:squares.size].reshape(squares.shape)) for x, m in zip(bounds, self.marked, strict=False))


def _bounds(radius: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Squares up to which an obstacle surely blocks, and above which it surely doesn't."""
    square = np.where(radius > 0, radius * radius, 0.0)  # a null is nan, and 0.0 here: radii are compared again
    return (square - slack).astype(np.float32), (square + slack).astype(np.float32)


def near(flights: DataFrame, obstacles: DataFrame, step: float, cell: float, margin: float) -> DataFrame:
    """spatial.blocked() of the segments of flights (flight_id, ax .. bz), at most `step` long: (flight_id, seq, n_near, n_blocking,
    clearance) of those that have an obstacle in the cells of their box, widened by margin."""

    def found(runs: pa.Table, rows: pa.Table) -> pa.Table:
        first = runs.column("first").to_numpy()
        row, seq, a, b = _cut(runs, first, runs.column("last").to_numpy() - first + 1)
        n_near, n_blocking, clearance = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row))
        if len(row) and rows.num_rows:
            low, high = (np.floor(e / cell).astype(np.int64) for e in (np.minimum(a, b) - margin, np.maximum(a, b) + margin))
            stood, squares = _Stood(rows, cell), _Squares(rows.num_rows)
            for block, own, lows, highs in _blocks(low, high, rows.num_rows):
                there = stood.within(lows.min(axis=1), highs.max(axis=1))
                cells = stood.cells[:, there]
                inside = np.logical_and.reduce([(c >= x[:, None]) & (c <= y[:, None]) for c, x, y in zip(cells, lows, highs, strict=True)])
                if len(inside) == 1:
                    there, inside = there[inside[0]], inside[:, inside[0]]
                number, beyond = inside.sum(axis=1), np.where(inside, np.float32(0), np.float32(np.inf))
                met = number[own] > 0
                block, own = block[met], own[met]
                n_near[block] = number[own]
                if len(block):
                    n_blocking[block], clearance[block] = counted(a[:, block], b[:, block], stood.place[:, there], stood.radius[there], own, beyond, squares)
        kept, times = np.flatnonzero(n_near), runs.column("times").to_numpy()
        times = times[row[kept]]
        return pa.table({"flight_id": runs.column("flight_id").combine_chunks().take(pa.array(row[kept])), "seq": seq[kept].astype(np.int32),
                         "n_near": n_near[kept] * times, "n_blocking": n_blocking[kept] * times, "clearance": clearance[kept]})

    def counted(a: np.ndarray, b: np.ndarray, place: np.ndarray, radius: np.ndarray, own: np.ndarray, beyond: np.ndarray, squares: _Squares) -> tuple[np.ndarray, np.ndarray]:
        n_blocking, slack = np.zeros(len(own), np.int64), squares.take(a, b, place)
        bounds, close, least = _bounds(radius, slack), [], []
        for part in _parts(len(own), len(radius)):
            found = squares.of(part)
            if len(beyond) > 1:
                squares.beyond(found, beyond, own[part])
            surely, maybe = squares.below(found, *bounds)
            n_blocking[part] = np.bitwise_count(np.packbits(surely, axis=1)).sum(axis=1, dtype=np.int64)
            close.append(_true(np.not_equal(surely, maybe, out=maybe), part.start))
            least.append(_true(squares.below(found, (found.min(axis=1) + np.float32(2 * slack))[:, None])[0], part.start))
        i, j = np.concatenate(close, axis=1)
        n_blocking += np.bincount(i[_off(a[:, i], b[:, i], place[:, j]) < radius[j]], minlength=len(own))
        i, j = np.concatenate(least, axis=1)
        return n_blocking, np.minimum.reduceat(_off(a[:, i], b[:, i], place[:, j]), np.flatnonzero(np.diff(i, prepend=-1)))

    reach = _reach(cell, margin, step)
    placed = _tiled(obstacles, lambda a: F.floor(F.col(a) / cell) - (reach - 1), lambda a: F.floor(F.col(a) / cell))
    return _met(flights, placed, step, cell, margin, found, "seq int, n_near long, n_blocking long, clearance double")


def blocking(flights: DataFrame, obstacles: DataFrame, step: float, cell: float) -> DataFrame:
    """(flight_id, blocked): how many segments of a flight, at most `step` long, have an obstacle whose clearance is less than its
    radius, wherever it stands. Each flight once, 0 or no row where it is free. The widest obstacles are looked at first, and of a segment no more than one that blocks it."""

    def found(runs: pa.Table, rows: pa.Table) -> pa.Table:
        first = runs.column("first").to_numpy()
        row, _, a, b = _cut(runs, first, runs.column("last").to_numpy() - first + 1)
        place, radius, hit = np.array([rows.column(x).to_numpy() for x in AXES]), rows.column("radius").to_numpy(), np.zeros(len(row), bool)
        order = np.argsort(-radius, kind="stable")
        place, radius = place[:, order], radius[order]
        squares, (low, high) = _Squares(len(radius)), (np.floor(e[:2] / cell).astype(np.int64) for e in (np.minimum(a, b), np.maximum(a, b)))
        for block, _, lows, highs in _blocks(low, high, len(radius)) if len(row) and len(radius) else ():
            (x, y), (dx, dy) = (lows.min(axis=1) + highs.max(axis=1) + 1) * cell / 2, (highs.max(axis=1) - lows.min(axis=1) + 1) * cell / 2 + 1e-3
            there = np.flatnonzero((np.abs(place[0] - x) < radius + dx) & (np.abs(place[1] - y) < radius + dy))
            start, many = 0, 64
            while len(block) and start < len(there):
                few = there[start:start + many]
                hit[block] = touched(a[:, block], b[:, block], place[:, few], radius[few], squares)
                block, start, many = block[~hit[block]], start + many, many * 2
        return pa.table({"flight_id": runs.column("flight_id").combine_chunks(), "blocked": np.bincount(row, weights=hit, minlength=runs.num_rows).astype(np.int64)})

    def touched(a: np.ndarray, b: np.ndarray, place: np.ndarray, radius: np.ndarray, squares: _Squares) -> np.ndarray:
        hit, bounds, close = np.zeros(a.shape[1], bool), _bounds(radius, squares.take(a, b, place)), []
        for part in _parts(len(hit), len(radius)):
            surely, maybe = squares.below(squares.of(part), *bounds)
            hit[part] = surely.any(axis=1)
            close.append(_true(np.not_equal(surely, maybe, out=maybe), part.start))
        i, j = np.concatenate(close, axis=1)
        i, j = i[~hit[i]], j[~hit[i]]
        hit[i[_off(a[:, i], b[:, i], place[:, j]) < radius[j]]] = True
        return hit

    reach, out = _reach(cell, 0.0, step), F.col("radius") + 1e-3
    placed = _tiled(obstacles.filter("radius > 0"), lambda a: F.floor((F.col(a) - out) / cell) - (reach - 1), lambda a: F.floor((F.col(a) + out) / cell))
    return _met(flights, placed, step, cell, 0.0, found, "blocked long").groupBy("flight_id").agg(F.sum("blocked").alias("blocked"))
