"""Greedy one-to-one matching of predictions with the truth of their group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_matches(said: DataFrame, truth: DataFrame, keys: list[str], equal: list[str], quantity: str, order: str, tolerance: float) -> DataFrame:
    """(keys, tp, fp, fn): each prediction, in order, takes the first truth that no other has, whose fields are equal and
    whose quantity is at most tolerance * max(quantity, 1) away. Only predictions and truths with equal fields can
    meet, so those are a task's groups, read in order and never held whole but for the truths still free."""
    columns = [*keys, *equal, quantity, order]
    both = truth.select(*columns, F.lit(0).alias("side")).unionByName(said.select(*columns, F.lit(1).alias("side")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*keys).schema.fields) + ", tp long, fp long, fn long"

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, free, counts = None, [], [0, 0, 0]
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                own = tuple(row[:len(keys) + len(equal)])
                if own != group:
                    if group is not None:
                        out.append((*group[:len(keys)], *counts[:2], len(free)))
                    group, free, counts = own, [], [0, 0, 0]
                value = row[len(own)]
                if row[-1] == 0:
                    free.append(value)
                    continue
                k = next((k for k, t in enumerate(free) if abs(value - t) <= tolerance * max(t, 1)), None)
                counts[0 if k is not None else 1] += 1
                if k is not None:
                    del free[k]
            yield pd.DataFrame(out, columns=[*keys, "tp", "fp", "fn"])
        if group is not None:
            yield pd.DataFrame([(*group[:len(keys)], *counts[:2], len(free))], columns=[*keys, "tp", "fp", "fn"])

    dealt = both.repartition(*keys, *equal).sortWithinPartitions(*keys, *equal, "side", order)
    return dealt.mapInPandas(match, schema).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
