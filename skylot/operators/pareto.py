"""Skylines: plans that no other plan dominates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylot.sources.staging import staged

#: Fronts that a task merges; rows of fronts that one task may merge even if they don't shrink.
FAN_IN, ROWS = 16, 100_000


def dominates(objectives: tuple[str, ...], a: str, b: str) -> Column:
    """a is nowhere worse and somewhere better than b; a null objective neither wins nor loses."""
    no_worse, better = F.lit(True), F.lit(False)
    for o in objectives:
        no_worse, better = no_worse & (F.col(f"{a}.{o}") <= F.col(f"{b}.{o}")), better | (F.col(f"{a}.{o}") < F.col(f"{b}.{o}"))
    return no_worse & better


def _local(objectives: tuple[str, ...]):
    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front: pd.DataFrame | None = None
        for frame in frames:
            rows = frame if front is None else pd.concat([front, frame], ignore_index=True)
            rows = rows.sort_values(list(objectives), kind="stable", ignore_index=True)
            x, kept = rows[list(objectives)].to_numpy(float), []
            for i in range(len(x)):  # in this order no later row dominates an earlier one
                k = x[kept]
                if not len(kept) or not ((k <= x[i]).all(1) & (k < x[i]).any(1)).any():
                    kept.append(i)
            front = rows.iloc[np.array(kept, int)]
        if front is not None:
            yield front
    return keep


def frontier(rows: DataFrame, objectives: tuple[str, ...]) -> DataFrame:
    """Rows that none dominates, which is exact in any order because dominance is transitive. Each partition keeps its own front,
    and fronts are merged by FAN_IN, each in a task of its own, as long as that leaves fewer rows. Fronts that don't shrink any
    more are compared with each other once, as blocks. Rows with a null objective stay aside: they are never dominated."""
    whole = F.lit(True)
    for o in objectives:
        whole = whole & F.col(o).isNotNull()
    keep = _local(objectives)
    fronts = staged(rows.filter(whole).mapInPandas(keep, rows.schema), "front")
    parts, size = fronts.rdd.getNumPartitions(), fronts.count()
    while parts > 1 and size:
        parts = -(-parts // FAN_IN)
        merged = staged(fronts.coalesce(parts).mapInPandas(keep, rows.schema), "front")
        fronts, before, size = merged, size, merged.count()
        if size > ROWS and 2 * size > before and parts > 1:
            fronts = fronts.alias("x").join(fronts.alias("y"), dominates(objectives, "y", "x"), "left_anti")
            break
    return fronts.unionByName(rows.filter(~whole))


def normalized(rows: DataFrame, objectives: tuple[str, ...]) -> DataFrame:
    """Each objective from 0 (best) to 1 (worst); 0 if it is the same for all."""
    span = rows.agg(*(f(o).alias(f"{o}_{n}") for o in objectives for n, f in (("low", F.min), ("high", F.max))))
    scaled = [F.coalesce((F.col(o) - F.col(f"{o}_low")) / F.nullif(F.col(f"{o}_high") - F.col(f"{o}_low"), F.lit(0.0)), F.lit(0.0)).alias(o) for o in objectives]
    return rows.crossJoin(F.broadcast(span)).select(*(c for c in rows.columns if c not in objectives), *scaled)  # span is one row
