"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words. A document of a source that is to give r times its words is
taken floor(r) times, and once more with probability r - floor(r). Those extra copies aren't drawn
one by one: pivotal rounding pairs two open documents and moves words from one to the other, at
random but without bias, until one of them is settled at 0 or 1. A source's words are kept exact in
every move, so its mix misses the target by less than the one document left open at the end. A unit
that outweighs the others of its block moves words to or from all of them at once, for the same odds.

Spark side: units are dealt to blocks of a source by a hash, each block is rounded in a task of its
own, and the one open unit that a block leaves goes on to a block of blocks, up a tree with a fixed
fan-in. A source with a third of all rows is many blocks. All draws come from hashes, so reruns agree.

Cases: null text has size 0; a null source is a source (last in order); rows that share doc_id and
source (null ids included) are one unit, taken or left together; texts of size 0 are taken as often
as drawn and bring no words; an empty table gives an empty one; columns beside the three stay.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylot.llm.common import globally_ranked, n_words, staged, union

#: Weights by the place of a source among the sources, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, BLOCK, FAN_IN, SEED = 1.5, 2.0, 1024, 64, 17
LARGE = 0.02
_OPEN = 1e-9


def targets(sized: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size) -> (source, source_size, source_rows, target), one row a source. All
    sources share `share` times all words by weight; none gets above `cap` times its size, and what
    it would get beyond goes to the others by weight, until none is above."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    ranked = globally_ranked(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.withColumn("weight", weight).withColumn("limit", F.lit(cap) * F.col("source_size")), "sources")
    words = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    full, level = -1, 0.0
    while True:  # few rounds: each one settles every source above its limit
        above = F.col("weight") * level > F.col("limit") if full >= 0 else F.lit(False)
        n, taken, open_weight = ranked.agg(
            F.count_if(above), F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not open_weight:
            break
        full, level = n, max(0.0, words - (taken or 0.0)) / open_weight
    target = F.least(F.col("weight") * F.lit(level), F.col("limit"))
    return ranked.select("source", "source_size", "source_rows", target.alias("target"))


def _rounded(level: int, last: bool, seed: int):
    def pivot(rows: pd.DataFrame) -> pd.DataFrame:
        # the longest first: what is open at the end is short then
        rows = rows.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], ignore_index=True)
        p, size = rows["p"].to_numpy(float, copy=True), rows["size"].to_numpy(float)
        name = f"{seed}|{level}|{rows['source'][0]}|{rows['block'][0]}"
        draws = np.random.default_rng(xxhash.xxh64_intdigest(name)).random(len(rows))
        for k in range(len(rows)):  # one that outweighs the others is settled against all of them at once
            if size[k] <= LARGE * size[k + 1:].sum() or not 0 < p[k] < 1:
                break
            rest = (p > 0) & (p < 1) & (np.arange(len(rows)) > k)
            most = np.where(rest, np.minimum(p * size / (1 - p[k]), (1 - p) * size / p[k]), 0.0)
            if most.sum() < size[k]:
                break
            part = most * (size[k] / most.sum())
            up = draws[k] < p[k]
            p[rest] += (part * (p[k] - 1 if up else p[k]))[rest] / size[rest]
            p[k] = up
        i = -1  # the open unit
        for j in range(len(rows)):
            if size[j] == 0:
                p[j] = draws[j] < p[j]
            if not _OPEN < p[j] < 1 - _OPEN:
                p[j] = round(p[j])
                continue
            if i < 0:
                i = j
                continue
            to_i = min((1 - p[i]) * size[i], p[j] * size[j])
            to_j = min(p[i] * size[i], (1 - p[j]) * size[j])
            words = to_i if draws[j] * (to_i + to_j) < to_j else -to_j
            p[i] += words / size[i]
            p[j] -= words / size[j]
            still = [k for k in (i, j) if _OPEN < p[k] < 1 - _OPEN]
            for k in (i, j):
                if k not in still:
                    p[k] = round(p[k])
            i = still[0] if still else -1
        if last and i >= 0:
            p[i] = draws[i] < p[i]
        rows["p"] = p
        return rows

    return pivot


def copies(sized: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS,
           seed: int = SEED) -> DataFrame:
    """(doc_id, source, size), one row a document -> one row a unit: (doc_id, source, source_size,
    target, copies int)."""
    by_source = targets(sized, share, cap, weights)
    most = by_source.agg(F.max("source_rows")).first()[0] or 0
    units = (sized.groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
             .join(by_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.xxhash64(F.lit(seed), "doc_id")
    n_blocks = F.ceil(F.col("source_rows") / BLOCK)
    rows = (units.withColumn("whole", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
            .withColumn("draw", draw).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), n_blocks))
            .drop("source_rows"))
    settled, blocks, level = [], math.ceil(most / BLOCK), 0
    while True:
        last = blocks <= 1
        done = staged(rows.groupBy("source", "block").applyInPandas(_rounded(level, last, seed), rows.schema), f"round{level}")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(done.filter(~is_open))
        if last:
            break
        rows = done.filter(is_open).withColumn("block", F.floor(F.col("block") / FAN_IN))
        blocks, level = math.ceil(blocks / FAN_IN), level + 1
    return union(settled).select("doc_id", "source", "source_size", "target", (F.col("whole") + F.col("p")).cast("int").alias("copies"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def _with_copies(rows: DataFrame, decided: DataFrame) -> DataFrame:
    right = decided.withColumnsRenamed({"doc_id": "_d", "source": "_s"})
    return rows.join(right, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_d", "_s")


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """One row a document: (doc_id, source, size, source_size, target, copies, taken)."""
    sized = staged(sizes(docs), "sizes")
    return _with_copies(sized, copies(sized, **how)).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns it has."""
    sized = staged(sizes(docs), "sizes")
    decided = copies(sized, **how).filter("copies > 0").select("doc_id", "source", F.col("copies").alias("_copies"))
    whole = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))  # its names clash with none
    repeated = _with_copies(whole, decided).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
