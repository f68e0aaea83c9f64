"""Near-duplicate embeddings by randomised-rotation binary codes.

Vectors are turned by random rotations and reduced to the signs: a code of one bit a dimension and
rotation, with the code's inner product with its own vector as correction factor. <code, other> over
that factor is an unbiased estimate of the inner product, with an error bound that falls with the
number of bits. The other vector takes part rounded to LEVELS steps, at random and so without bias. Code,
factors and rounded vector are computed once and stored: 148 bytes for 128 dimensions. Runs of code bits are also
the keys under which vectors meet: so many tables of them that a pair at the threshold shares one with
probability RECALL (closer pairs more surely). In a bucket of codes, estimates and bounds throw out what
can't be near, and earlier shared keys what has met before. Vectors are fetched only for what is left, and
recomputed in double precision; only that makes a link. Links found are never below the threshold; a pair
counts in the first table whose key it shares, so no list of pairs is made.

Spark side: rows of one label with equal vectors are a class, which is compared once and counts as many as
it has rows. Keys are counted narrow (id, key) before codes move, buckets of one are dropped, and
buckets of more than CHUNK classes are dealt in pairs of chunks, so a label or bucket with a third of
all rows is many tasks. Each label has the bits, and with them the tables, that its own number of classes needs.

Cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null label
or vec_id link with nothing; vectors of different lengths don't either; rows that repeat a vec_id are vectors
of their own: each links with all others near it, those of its own id too, and has its own component; ties
don't matter; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylot.llm.common import components, staged

THRESHOLD, RECALL = 0.93, 0.999
#: Vectors that a bucket has on average, and that a task compares with as many at most.
BUCKET, CHUNK = 192, 1024
#: Rotations in a code, and standard errors in a bound.
ROTATIONS, DEVIATIONS, SEED = 4, 4.0, 29
#: Steps of a rounded component (four bits), and what float32 sums may be off.
LEVELS, SLACK = 15, 1e-4
#: Labels whose sizes are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


@functools.lru_cache(64)
def rotation(dimension: int, number: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dimension, number]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def layout(most: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables, for a label's number of vectors."""
    bits = max(2, math.ceil(math.log2(max(1, most) / BUCKET)))
    hit = (1 - math.acos(threshold) / math.pi) ** bits  # two signs agree with 1 - angle / pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def codes(unit: np.ndarray, rotations: int = ROTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Signs (vectors, rotations, dimension) as -1 and 1, and correction factors (vectors, rotations)."""
    turned = np.stack([unit @ rotation(unit.shape[1], i).T for i in range(rotations)], 1)
    signs = np.where(turned >= 0, np.float32(1), np.float32(-1))
    return signs, np.abs(turned).sum(2) / math.sqrt(unit.shape[1])


def keys(sign: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Code bits (vectors, at least bits * tables) -> (vectors, tables): runs of them as numbers."""
    return (sign[:, :bits * tables].reshape(len(sign), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def turns(dimension: int, rotations: int, bits: int, tables: int) -> int:
    """Rotations in a stored code: those of the estimate, or more where keys need more bits."""
    return max(rotations, -(-bits * tables // dimension))


def stored(unit: np.ndarray, rotations: int, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, bytes) code bits, correction factors, largest component and components in four bits
    each, and the keys."""
    n, dimension = unit.shape
    signs, factor = codes(unit, rotations)
    more = [unit @ rotation(dimension, i).T >= 0 for i in range(rotations, turns(dimension, rotations, bits, tables))]
    sign = np.concatenate([signs.reshape(n, -1) > 0, *more], 1)
    top = np.abs(unit).max(1, keepdims=True)
    offset = np.random.default_rng([SEED, dimension]).random(dimension)  # randomised rounding: no bias
    level = np.floor((unit / top + 1) * (LEVELS / 2) + offset).astype(np.uint8)
    if dimension % 2:
        level = np.concatenate([level, np.zeros((n, 1), np.uint8)], 1)
    numbers = np.concatenate([factor, top], 1).astype(np.float32).view(np.uint8)
    return np.concatenate([np.packbits(sign, axis=1), numbers, level[:, ::2] << 4 | level[:, 1::2]], 1), keys(sign, bits, tables)


def opened(code: np.ndarray, dimension: int, rotations: int, bits: int, tables: int) -> tuple[np.ndarray, ...]:
    """What stored() holds: signs (vectors, rotations, dimension), factors, largest components, rounded vectors, keys."""
    total = turns(dimension, rotations, bits, tables) * dimension
    at, n = -(-total // 8), len(code)
    sign = np.unpackbits(code[:, :at], axis=1, count=total)
    numbers = np.ascontiguousarray(code[:, at:at + 4 * (rotations + 1)]).view(np.float32)
    pairs = code[:, at + 4 * (rotations + 1):]
    level = np.stack([pairs >> 4, pairs & 15], 2).reshape(n, -1)[:, :dimension]
    factor, top = numbers[:, :-1], numbers[:, -1:]
    signs = sign[:, :rotations * dimension].reshape(n, rotations, dimension).astype(np.float32) * 2 - 1
    return signs, factor, top, (level * np.float32(2 / LEVELS) - 1) * top, keys(sign, bits, tables)


def estimates(signs: np.ndarray, factor: np.ndarray, top: np.ndarray, rounded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of all vectors estimated by their codes, as the mean of both directions, and each
    vector's part in the variance: a pair's is at most the mean of its two."""
    n, rotations, dimension = signs.shape
    one_way = np.zeros((n, n), np.float32)
    for r in range(rotations):
        turned = rounded @ rotation(dimension, r).T.astype(np.float32)
        one_way += (signs[:, r] @ turned.T) / (factor[:, r, None] * np.float32(math.sqrt(dimension) * rotations))
    by_code = np.maximum(0, 1 / (factor * factor) - 1).mean(1) / max(1, dimension - 1) / rotations
    by_rounding = (top[:, 0] / LEVELS) ** 2 * (1 + (dimension - 1) * by_code)
    return (one_way + one_way.T) / 2, by_code + by_rounding


def unit_rows(vectors: list[np.ndarray]) -> np.ndarray:
    rows = np.array(vectors, np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)  # neither overflow nor underflow in the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def is_valid() -> Column:
    """Whether a row (vec_id, label, embedding) can link."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(there & fine & F.exists("embedding", lambda x: x != 0), F.lit(False))


#: A class in a chunk of a bucket.
PLACED = "class long, bits int, tables int, label string, dimension int, at int, band long, part int, low int, high int"


def _maybe(key: tuple, table: pa.Table, threshold: float, rotations: int, deviations: float, slack: float) -> np.ndarray:
    """(classes, classes), above the diagonal: whether a pair's bound reaches the threshold, and it meets here first."""
    at, dimension, low, high = (key[i].as_py() for i in (2, 1, 4, 5))
    code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(table), -1)
    signs, factor, top, rounded, bands = opened(code, dimension, rotations, table["bits"][0].as_py(), table["tables"][0].as_py())
    estimate, variance = estimates(signs, factor, top, rounded)
    maybe = estimate + deviations * np.sqrt((variance[:, None] + variance) / 2) + slack >= threshold
    if low != high:  # pairs within a chunk meet where low = high
        part = table["part"].to_numpy()
        maybe &= part[:, None] != part
    maybe = np.triu(maybe, 1)
    for i in np.flatnonzero(maybe.any(1)) if at else ():
        j = np.flatnonzero(maybe[i])
        maybe[i, j] = ~(bands[j, :at] == bands[i, :at]).any(1)
    return maybe


def _candidates(*how: float):
    """Of a chunk of codes, the classes that have a pair to be recomputed."""
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        maybe = _maybe(key, table, *how, SLACK)
        return table.select([f.split()[0] for f in PLACED.split(", ")]).filter(pa.array(maybe.any(0) | maybe.any(1)))

    return meet


def _neighbours(threshold: float, *how: float):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids, weight = table["class"].to_numpy(), table["n"].to_numpy()
        maybe = _maybe(key, table, threshold, *how, 2 * SLACK)  # no less than in the step before
        unit = unit_rows([np.asarray(v, np.float64) for v in table["embedding"].to_pylist()])
        near = np.zeros((len(ids), len(ids)), bool)
        n = np.zeros(len(ids), np.int64)
        for i in np.flatnonzero(maybe.any(1)):
            j = np.flatnonzero(maybe[i])
            j = j[unit[j] @ unit[i] >= threshold]
            near[i, j] = near[j, i] = True
            n[i] += weight[j].sum()
            n[j] += weight[i]
        root = np.arange(len(ids))
        for i in np.flatnonzero(near.any(1)):
            if root[i] == i and not near[i, :i].any():  # walk its component
                front, seen = np.array([i]), np.zeros(len(ids), bool)
                seen[i] = True
                while len(front):
                    front = np.flatnonzero(near[front].any(0) & ~seen)
                    seen[front] = True
                root[seen] = np.flatnonzero(seen)[np.argmin(ids[seen])]
        there = near.any(1)
        return pa.table({"class": ids[there], "n": n[there], "root": ids[root[there]]})

    return compare


def linked(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rotations: int = ROTATIONS,
           deviations: float = DEVIATIONS) -> DataFrame:
    """(vec_id, label, embedding) -> (vec_id, n_links, component_id, kept), one row a vector."""
    own = F.monotonically_increasing_id()
    rows = staged(vectors.select("vec_id", "label", "embedding").select(
        F.col("vec_id").cast("long"), F.when(is_valid(), F.col("label").cast("string")).alias("label"),
        F.when(is_valid(), F.col("embedding").cast("array<double>")).alias("embedding")), "rows")
    same = ["label", "digest", "proof"]
    keyed = rows.select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("digest"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("proof"))
    classes = staged(keyed.filter("label IS NOT NULL").groupBy(*same).agg(
        F.min("vec_id").alias("low_id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")).withColumn("class", own), "classes")
    sizes = staged(classes.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "sizes")
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_LABELS else sizes

    def encoded(batches):
        for batch in batches:
            embedded, sizes_ = batch.column("embedding").to_pylist(), batch.column("size").to_pylist()
            plans = [(len(v), *layout(n, threshold, recall)) for v, n in zip(embedded, sizes_, strict=True)]
            found, bands = [b""] * len(plans), [None] * len(plans)
            for plan in set(plans):
                own_ = [i for i, p in enumerate(plans) if p == plan]
                for i, code, band in zip(own_, *stored(unit_rows([embedded[i] for i in own_]), rotations, *plan[1:]), strict=True):
                    found[i], bands[i] = code.tobytes(), band
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("label"), *(pa.array([p[i] for p in plans], pa.int32()) for i in range(3)),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(found, pa.binary())],
                ["class", "label", "dimension", "bits", "tables", "bands", "code"])

    coded = staged(classes.join(few, "label").select("class", "label", "embedding", "size").mapInArrow(
        encoded, "class long, label string, dimension int, bits int, tables int, bands array<long>, code binary"), "codes")
    narrow = coded.select("class", "label", "dimension", "bits", "tables", F.posexplode("bands").alias("at", "band"))
    bucket = ["label", "dimension", "at", "band"]
    crowded = narrow.groupBy(*bucket).agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    chunks = F.ceil(F.col("crowd") / CHUNK).cast("int")
    placed = narrow.join(crowded, bucket).withColumn("part", F.pmod(F.hash("class"), chunks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    placed = placed.select("class", "bits", "tables", *bucket, "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    chunk, how = [*bucket, "low", "high"], (threshold, rotations, deviations)
    met = staged(placed.join(coded.select("class", "code"), "class").groupBy(*chunk).applyInArrow(_candidates(*how), PLACED), "met")
    wide = met.join(coded.select("class", "code"), "class").join(classes.select("class", "n", "embedding"), "class")
    compared = staged(wide.groupBy(*chunk).applyInArrow(_neighbours(*how), "class long, n long, root long"), "compared")
    links = compared.groupBy("class").agg(F.sum("n").alias("links"))
    connected = components(compared.select("class", "root")).withColumnRenamed("id", "class")
    known = staged(classes.select("class", *same, "n", "low_id").join(links, "class", "left").join(connected, "class", "left").select(
        *same, "low_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component")), "known")
    least = known.groupBy("component").agg(F.min("low_id").alias("component_id"))
    result = keyed.drop("embedding").join(known.join(least, "component").drop("component", "low_id"), same, "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
