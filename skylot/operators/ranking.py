"""Window ranks, pairs and keyed deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from skylot.sources.staging import staged

# Two orders that are never to be mixed: labels rank by priority first, rule configurations by score.
RANK_LABEL = ("priority", "-score", "demand_id")
RANK_RULE = ("-score", "priority", "demand_id")


def _order(by: tuple[str, ...]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in by]


def window(keys: list[str], by: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*_order(by))


def ranked(rows: DataFrame, keys: list[str], by: tuple[str, ...], name: str = "window_rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(window(keys, by)))


def first_wins(rows: DataFrame, keys: list[str], by: tuple[str, ...]) -> DataFrame:
    """Of rows with equal keys the first in the order given."""
    return ranked(rows, keys, by, "_place").filter("_place = 1").drop("_place")


def last_wins(rows: DataFrame, keys: list[str], by: tuple[str, ...]) -> DataFrame:
    turned = tuple(c[1:] if c.startswith("-") else f"-{c}" for c in by)
    return first_wins(rows, keys, turned)


#: Rows of a cell that are joined at once: what one key of the join gives is at most about the square of it.
BLOCK = 2048


def cells_met(rows: DataFrame, keys: list[str], cell: list[str], meets: Column) -> DataFrame:
    """Pairs of one window's cells (rows with equal cell) that meet: keys, cell and n, the cell's rows, and the other's with _b."""
    cells = rows.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(cells.withColumnsRenamed({c: f"{c}_b" for c in (*cell, "n")}), keys).filter(meets)


def paired(rows: DataFrame, keys: list[str], cell: list[str], meets: Column, block: int = BLOCK) -> DataFrame:
    """Pairs of rows of one window whose cells meet: the first row's columns, and the second's with _b. A row takes the number of
    each cell that it meets, so the join makes no pair of others. Large cells are joined in blocks of about `block` rows, dealt
    by demand_id to as many tasks as a shuffle has, however few the windows are."""
    rows = staged(rows, "paired")
    own, spark = [*keys, *(f"{c}_b" for c in cell)], rows.sparkSession
    parts = lambda n: F.ceil(n / block).cast("int")
    met = staged(cells_met(rows, keys, cell, meets).withColumns(
        {"_is": parts(F.sum("n").over(Window.partitionBy(*own))), "_js": parts(F.col("n_b"))}).drop("n", "n_b"), "met")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = rows.join(met, [*keys, *cell]).withColumns({"_i": dealt("demand_id", "_is"), "_j": every("_js")})
    second = rows.withColumnsRenamed({c: f"{c}_b" for c in rows.columns if c not in keys}).join(met.select(*own, "_is", "_js").distinct(), own)
    second = second.withColumns({"_i": every("_is"), "_j": dealt("demand_id_b", "_js")})
    at, tasks = [*own, "_i", "_j"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    first, second = (side.drop("_is", "_js").repartition(tasks, *at) for side in (first, second))
    return first.join(second, at).drop("_i", "_j")


def preferences(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Pairs of one window whose priorities differ: (keys, higher_id, lower_id, gap)."""
    pairs = paired(rows.select(*keys, "demand_id", "priority"), keys, ["priority"], F.col("priority") < F.col("priority_b"), block)
    return pairs.select(*keys, F.col("demand_id").alias("higher_id"), F.col("demand_id_b").alias("lower_id"), (F.col("priority_b") - F.col("priority")).alias("gap"))


def preference_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number and mean gap of those pairs (keys, n_pairs, avg_gap), from the rows that a window has of each priority."""
    rows = staged(rows.select(*keys, "priority"), "priorities")
    met = cells_met(rows, keys, ["priority"], F.col("priority") < F.col("priority_b")).withColumn("_n", F.col("n") * F.col("n_b"))
    gaps = F.sum(F.col("_n") * (F.col("priority_b") - F.col("priority")))
    return met.groupBy(*keys).agg(F.sum("_n").alias("n_pairs"), (gaps.cast("double") / F.sum("_n")).alias("avg_gap"))


def near_ties(rows: DataFrame, keys: list[str], most: int, block: int = BLOCK) -> DataFrame:
    """Pairs of one window whose priorities differ and whose scores are at most `most` apart: (keys, a, b, gap), a the smaller id.
    Cells are a priority's scores of most + 1 in a row, so such pairs lie in the same or in neighbouring ones."""
    c = F.col
    rows = rows.select(*keys, "demand_id", "score", "priority", F.floor(c("score") / (most + 1)).alias("bin"))
    pairs = paired(rows, keys, ["priority", "bin"], (c("priority") < c("priority_b")) & (F.abs(c("bin") - c("bin_b")) <= 1), block)
    gap, one, two = F.abs(c("score") - c("score_b")), c("demand_id"), c("demand_id_b")
    return pairs.filter((gap <= most) & (one != two)).select(*keys, F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), gap.alias("gap"))


def globally_ranked(rows: DataFrame, coarse: Column, by: tuple[str, ...], name: str = "place") -> DataFrame:
    """Rows with their number, from 1, in the order by over all rows. coarse: a value that never falls along that
    order. Each of its values is ranked apart; what goes through one task is a row a value."""
    marked = rows.withColumn("_coarse", coarse)
    before = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("_coarse").agg(F.count(F.lit(1)).alias("_n")).select("_coarse", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return marked.withColumn("_at", F.row_number().over(window(["_coarse"], by))).join(starts, "_coarse").withColumn(
        name, (F.col("_start") + F.col("_at")).cast("long")).drop("_coarse", "_at", "_start")


def merged(rows: DataFrame, keys: list[str], rule: str, model: str) -> DataFrame:
    """rows with merged, blended and window_rank: the rule's priority where it is 1, at most 1 away from the model's or
    the only one, else the model's; ranked by a blend of both."""
    r, m = F.col(rule), F.col(model)
    keep = m.isNull() | (r == 1) | (F.abs(r - m) <= 1)
    blend = (5 - r) * 20 + F.coalesce((5 - m) * 8, F.lit(0))
    return ranked(rows.withColumns({"merged": F.when(keep, r).otherwise(m), "blended": blend}), keys, ("-blended", "merged", "demand_id"))
