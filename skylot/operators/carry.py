"""Running values along an order that is cut into blocks, so that no group is one task.

Each block is gone through apart; what a block hands on to the next is one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_START = Window.unboundedPreceding


def running(rows: DataFrame, group: list[str], block: str, order: list[str], what: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with running values, up to and with the row itself, of each group in the order of block, then order. what: name ->
    (kind, value); kinds: last (that isn't null), sum, min."""
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(_START, 0)
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(_START, -1)
    own, ends, carried, both = {}, [], [], {}
    for name, (kind, value) in what.items():
        if kind == "last":
            own[name] = F.last(value, ignorenulls=True).over(inside)
            ends.append(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(f"_{name}"))
            carried.append(F.last(f"_{name}", ignorenulls=True).over(before).alias(f"_{name}"))
            both[name] = F.coalesce(name, f"_{name}")
        else:
            how = {"sum": F.sum, "min": F.min}[kind]
            own[name] = how(value).over(inside)
            ends.append(how(value).alias(f"_{name}"))
            carried.append(how(F.col(f"_{name}")).over(before).alias(f"_{name}"))
            both[name] = F.coalesce(F.col(name) + F.coalesce(f"_{name}", F.lit(0)), f"_{name}") if kind == "sum" else F.least(name, f"_{name}")
    handed = rows.groupBy(*group, block).agg(*ends).select(*group, block, *carried)
    return rows.withColumns(own).join(handed, [*group, block]).withColumns(both).drop(*(f"_{n}" for n in what))


def with_halo(rows: DataFrame, place: str, size: int, before: int = 1, after: int = 1) -> DataFrame:
    """rows with block, place // size, and beside each block's own rows copies (halo true) of the nearest ones of the blocks next
    to it, so that windows over a block see their neighbours. place: whole numbers without gaps."""
    at, block = F.col(place) % size, F.floor(F.col(place) / size)
    goes = F.array(F.struct(block.alias("block"), F.lit(False).alias("halo")), F.struct(F.when(at < after, block - 1).alias("block"), F.lit(True).alias("halo")),
                   F.struct(F.when(at >= size - before, block + 1).alias("block"), F.lit(True).alias("halo")))
    return rows.select("*", F.inline(goes)).filter("block IS NOT NULL")
