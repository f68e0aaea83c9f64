"""Choosing hard cases, samples and splits out of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.operators.carry import running, with_halo
from skylot.operators.ranking import globally_ranked
from skylot.sources.staging import staged

BLOCK = 1 << 15


def adjacent_pairs(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(priority, score, id string) -> (priority, place, left, right, gap, chosen): neighbours of one priority in the order of
    (score, id). chosen: those that a walk through all pairs by (gap, left, right) takes, which leaves out what shares a row
    with a pair taken before.

    That walk needs no order among distant pairs. A pair that is smaller than both its neighbours is taken; along a rise from
    it every second pair is, and on top of two rises the pair is taken if it is an even way from both feet. So a pair's choice
    follows from its distances to the last pair before it that doesn't rise and the first after it that doesn't fall, which
    are carried along blocks of rows."""
    coarse = F.struct("priority", "score", F.substring("id", 1, 2))
    placed = staged(globally_ranked(rows.select("priority", "score", "id"), coarse, ("priority", "score", "id")), "placed")
    w = Window.partitionBy("block").orderBy("place")
    ahead = lambda c, i: F.lead(c, i).over(w)
    key = lambda i: F.when(ahead("priority", i) == ahead("priority", i + 1), F.struct((ahead("score", i + 1) - ahead("score", i)).alias("gap"), ahead("id", i).alias("left"), ahead("id", i + 1).alias("right")))
    pairs = with_halo(placed, "place", size, 1, 2).select("block", "halo", "place", "priority", key(0).alias("own"), key(-1).alias("before"), key(1).alias("after")).filter("NOT halo")
    rises = F.coalesce(F.col("before") < F.col("own"), F.lit(False))
    falls = F.coalesce(F.col("after") < F.col("own"), F.lit(False))
    pairs = staged(pairs.withColumns({"rises": rises, "falls": falls, "back": -F.col("block"), "down": -F.col("place")}), "pairs")
    pairs = running(pairs, [], "block", ["place"], {"foot": ("last", F.when(~F.col("rises"), F.col("place")))})
    pairs = running(pairs, [], "back", ["down"], {"end": ("last", F.when(~F.col("falls"), F.col("place")))})
    way = lambda c, i: F.col(c) | ((F.col("place") - F.col(i)) % 2 == 0)
    pairs = pairs.withColumns({"steady": ~F.col("rises"), "level": ~F.col("falls")})
    return pairs.filter("own IS NOT NULL").select("priority", "place", "own.left", "own.right", "own.gap", (way("steady", "foot") & way("level", "end")).alias("chosen"))


def near_ties(rows: DataFrame, most: int = 6, per_priority: int = 2, size: int = BLOCK) -> DataFrame:
    """(priority, score, id) -> (number, priority, left, right, neighbour): windows of two rows of one priority that lie closest
    and the best of a priority next to it (one below, one above, or two below). Pairs don't overlap; so many a priority, so
    many in all, urgent priorities first."""
    chosen = adjacent_pairs(rows, size).filter("chosen")
    best = Window.partitionBy("priority").orderBy("gap", "left", "right")
    few = chosen.withColumn("_i", F.row_number().over(best)).filter(F.col("_i") <= per_priority)
    tops = rows.groupBy("priority").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("neighbour"))
    asked = rows.select("priority").distinct().select("priority", F.posexplode(F.array(F.lit(1), F.lit(-1), F.lit(2))).alias("turn", "delta"))
    beside = asked.join(tops.withColumnRenamed("priority", "other"), F.col("other") == F.col("priority") + F.col("delta")).groupBy("priority").agg(F.min_by("neighbour", "turn").alias("neighbour"))
    kept = few.join(beside, "priority").orderBy("priority", "_i").limit(most)  # per_priority rows a priority go in
    return kept.select(F.row_number().over(Window.orderBy("priority", "_i")).alias("number"), "priority", "left", "right", "neighbour")


def _ends(rows: DataFrame, by: list[Column], turned: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The first and the last rows, numbered from the outside: a bounded top of each partition is all that moves."""
    first, last = rows.orderBy(*by).limit(most), rows.orderBy(*turned).limit(most)
    return (first.withColumn("i", F.row_number().over(Window.orderBy(*by))), last.withColumn("i", F.row_number().over(Window.orderBy(*turned))))


def opposites(rows: DataFrame, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The i-th row by (priority, -score, id) and the i-th from behind, each with i; no row is in both."""
    half = rows.limit(2 * most).count() // 2
    p, s, d = F.col("priority"), F.col("score"), F.col("id")
    return _ends(rows, [p.asc(), s.desc(), d.asc()], [p.desc(), s.asc(), d.desc()], min(most, half))


def mixed(rows: DataFrame) -> DataFrame:
    """The first two and last two rows by (priority, id), with their places 1 to 4, where there are four."""
    if rows.limit(4).count() < 4:
        return rows.limit(0).withColumn("place", F.lit(0))
    p, d = F.col("priority"), F.col("id")
    first, last = _ends(rows, [p.asc(), d.asc()], [p.desc(), d.desc()], 2)
    return first.withColumn("place", F.col("i")).unionByName(last.withColumn("place", 5 - F.col("i"))).drop("i")


#: Labels in the order in which they choose their window (fixed values).
LABELS = ("priority_1", "urgent", "vulnerable", "near_tie", "dense", "routine")


def window_labels(demands: DataFrame, urgent: int = 2) -> DataFrame:
    """(label, priority, vulnerable) a demand -> (time_window, n_demands, labels) a window."""
    lowest, n = F.min("priority"), F.count(F.lit(1))
    counted = [F.count_if(F.col("priority") <= lim) for lim in (1, 2, 3, 4)]
    rows = demands.groupBy(F.col("label").alias("time_window")).agg(n.alias("n_demands"), lowest.alias("low"), F.max(F.col("vulnerable").cast("int")).alias("weak"),
                                                                    *(c.alias(f"upto{i}") for i, c in enumerate(counted, 1)))
    second = F.coalesce(*(F.when(F.col(f"upto{i}") >= 2, F.lit(i)) for i in (1, 2, 3, 4)))
    holds = dict(zip(LABELS, (F.col("low") == 1, F.col("low") <= urgent, F.col("weak") == 1, second - F.col("low") <= 1, F.col("n_demands") >= 5), strict=False))
    found = F.array_compact(F.array(*(F.when(h, F.lit(k)) for k, h in holds.items())))
    return rows.select("time_window", "n_demands", found.alias("labels")).withColumn("labels", F.when(F.size("labels") == 0, F.array(F.lit("routine"))).otherwise(F.col("labels")))


def covering_sample(windows: DataFrame, total: int, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(time_window, n_demands, labels), one row a window -> the sample, with the label that chose each (null: filled up). Label by
    label the window with most labels, then most demands, then the first by name, of those not yet chosen; what is left of
    `total` goes to the best of the rest. As a label can lose only windows that the labels before it took, its first
    len(labels) ones are enough to choose from, whatever the number of windows."""
    windows = windows.withColumn("n_labels", F.size("labels"))
    order = [F.col("n_labels").desc(), F.col("n_demands").desc(), F.col("time_window").asc()]
    each = windows.select("*", F.explode("labels").alias("label"))
    best = each.withColumn("_i", F.row_number().over(Window.partitionBy("label").orderBy(*order))).filter(F.col("_i") <= len(labels))
    by_label: dict[str, list[str]] = {}
    for label, name in best.orderBy("label", "_i").select("label", "time_window").collect():  # len(labels) rows a label
        by_label.setdefault(label, []).append(name)
    chosen: dict[str, str] = {}
    for label in labels:
        free = [name for name in by_label.get(label, []) if name not in chosen]
        if free and len(chosen) < total:
            chosen[free[0]] = label
    taken = windows.sparkSession.createDataFrame(list(chosen.items()), "time_window string, chosen_by string")
    marked = windows.join(F.broadcast(taken), "time_window", "left")  # len(labels) rows
    rest = marked.filter("chosen_by IS NULL").orderBy(*order).limit(max(0, total - len(chosen)))
    return marked.filter("chosen_by IS NOT NULL").unionByName(rest).select("time_window", "n_demands", "n_labels", "chosen_by")


#: Bits of a split's hash, and of one round's counts.
HASH_BITS, STEP_BITS = 60, 12


def split_size(n: int, ratio: float) -> int:
    """Rows held out of n: the nearest whole number (halves to even), but one at least and one less than all at most."""
    if not 0.0 <= ratio < 1.0:
        raise ValueError("the share must be in [0, 1)")
    return 0 if n <= 1 or ratio == 0.0 else min(max(1, round(n * ratio)), n - 1)


def exact_split(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """rows with held_out: exactly split_size of them, those with the smallest hashes of seed and key; whichever way they are
    partitioned, the same keys. The threshold is found by counts of ranges of hashes, each round within the range of the one
    before, so rows aren't sorted. Rows that share the key at the threshold are told apart by where they are written."""
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, HASH_BITS // 4)
    hashed = staged(rows.withColumn("_h", F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0))), "hashed")
    want = split_size(hashed.count(), ratio)
    if want == 0:
        return hashed.withColumn("held_out", F.lit(False)).drop("_h")
    prefix, below, bits = 0, 0, HASH_BITS
    while bits:
        bits -= STEP_BITS
        inside = hashed.filter(F.shiftright("_h", bits + STEP_BITS) == prefix)
        counts = dict(inside.groupBy(F.shiftright("_h", bits)).count().collect())  # 2 ** STEP_BITS rows at most
        for part in sorted(counts):
            if below + counts[part] >= want:
                prefix = part
                break
            below += counts[part]
    at = hashed.filter(F.col("_h") == prefix).withColumn("_file", F.col("_metadata.file_path"))
    need = want - below
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = at.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_file").orderBy(key))
    ties = at.withColumn("_i", nth).join(files, "_file").withColumn("held_out", F.col("_before") + F.col("_i") <= need).drop("_file", "_i", "_before")
    return hashed.filter(F.col("_h") != prefix).withColumn("held_out", F.col("_h") < prefix).unionByName(ties).drop("_h")
