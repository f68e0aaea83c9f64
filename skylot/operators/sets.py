"""Set operations over records: validation, intersections, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that doesn't hold (a null counts as not), or null."""
    reason = F
    for name, holds in rules:
        reason = reason.when(~F.coalesce(holds, F.lit(False)), name)
    return reason


def mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that only one of two sets has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_a = a.join(b, key, "left_anti").withColumn("side", F.lit("left"))
    return only_a.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
