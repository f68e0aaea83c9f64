"""Classification, rank correlation, fairness and latency metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(over: Column, under: Column) -> Column:
    """over / under, null where under is 0."""
    return over.cast("double") / F.nullif(under.cast("double"), F.lit(0.0))


def subset() -> list[Column]:
    """Count, served, service rate, mean and 90th percentile of served latency, on-time rate."""
    late = F.when(F.col("served"), F.col("latency"))
    return [F.count(F.lit(1)).alias("n"), F.count_if("served").alias("served"), ratio(F.count_if("served"), F.count(F.lit(1))).alias("service_rate"),
            F.avg(late).alias("mean_latency"), F.percentile(late, F.lit(0.9)).alias("p90_latency"),
            ratio(F.count_if("on_time"), F.count(F.lit(1))).alias("on_time_rate")]


def weighted_score(flag: str, priority: str = "true_priority") -> Column:
    """Share of the weight (4 for priority 1, 1 for priority 4) of the rows that have the flag."""
    weight = 5 - F.col(priority)
    return ratio(F.sum(F.when(F.col(flag), weight).otherwise(0)), F.sum(weight))


def gini(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """2 * sum(i * x) / (n * sum(x)) - (n + 1) / n over the sorted values. Values are counted first, so
    that a group's sort is over its distinct values; i * x of ties is summed in closed form."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("ranks", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)
    n, total = F.sum("c"), F.sum(F.col("c") * F.col(value))
    return placed.groupBy(*keys).agg((ratio(2 * F.sum(F.col("ranks") * F.col(value)), n * total) - (n + 1) / n).alias("gini"))


def jain(value: str) -> Column:
    x = F.col(value)
    return ratio(F.sum(x) * F.sum(x), F.count(x) * F.sum(x * x))


def confusion(rows: DataFrame, keys: list[str], labels: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(keys, true_priority, pred_priority, n), with a 0 for what doesn't occur."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(a, b) for a in labels for b in labels], "true_priority int, pred_priority int")
    seen = rows.groupBy(*keys, "true_priority", "pred_priority").agg(F.count(F.lit(1)).alias("n"))
    groups = seen.select(*keys).distinct() if keys else spark.range(1).select()
    grid = groups.crossJoin(F.broadcast(every))  # as many rows as there are labels, squared
    return grid.join(seen, [*keys, "true_priority", "pred_priority"], "left").select(*keys, "true_priority", "pred_priority", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each label, from confusion cells."""
    true = cells.groupBy(*keys, F.col("true_priority").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("true_priority") == F.col("pred_priority"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cells.groupBy(*keys, F.col("pred_priority").alias("label")).agg(F.sum("n").alias("predicted"))
    p, r = F.coalesce(ratio(F.col("tp"), F.col("predicted")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("support")), F.lit(0.0))
    return true.join(predicted, [*keys, "label"]).select(*keys, "label", p.alias("precision"), r.alias("recall"), F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support", "tp")


def binary(positive: Column, predicted: Column) -> list[Column]:
    """Support, predicted, precision, recall, F1 of a yes/no split; null without a true positive class row."""
    tp, support, guessed = F.count_if(positive & predicted), F.count_if(positive), F.count_if(predicted)
    p, r = F.coalesce(ratio(tp, guessed), F.lit(0.0)), ratio(tp, support)
    return [support.alias("support"), guessed.alias("predicted"), F.when(support > 0, p).alias("precision"), r.alias("recall"),
            F.when(support > 0, F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0))).alias("f1")]


def kendall_b(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Kendall's tau-b from the contingency table: cells are compared with cells, not rows with rows."""
    a = cells.select(*keys, F.col("true_priority").alias("t"), F.col("pred_priority").alias("p"), F.col("n").cast("double").alias("n"))
    b = cells.select(*keys, F.col("true_priority").alias("u"), F.col("pred_priority").alias("q"), F.col("n").cast("double").alias("m"))
    sign = F.signum(F.col("u") - F.col("t")) * F.signum(F.col("q") - F.col("p"))
    pairs = (a.join(b, keys) if keys else a.crossJoin(b)).groupBy(*keys).agg((F.sum(sign * F.col("n") * F.col("m")) / 2).alias("s"))
    n = F.sum("n")

    def ties(by: str) -> DataFrame:
        each = a.groupBy(*keys, by).agg(F.sum("n").alias("n"))
        return each.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"ties_{by}"), (n * (n - 1) / 2).alias(f"all_{by}"))

    joined = pairs.join(ties("t"), keys).join(ties("p"), keys)
    under = F.sqrt((F.col("all_t") - F.col("ties_t")) * (F.col("all_t") - F.col("ties_p")))
    return joined.select(*keys, ratio(F.col("s"), under).alias("tau"))


def spearman(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of average ranks, weighted by the contingency table's counts."""
    def ranks(by: str) -> DataFrame:
        each = cells.groupBy(*keys, by).agg(F.sum("n").alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return each.select(*keys, by, (before + (F.col("c") + 1) / 2).alias(f"rank_{by}"))

    x, y, n = F.col("rank_true_priority"), F.col("rank_pred_priority"), F.col("n").cast("double")
    rows = cells.join(ranks("true_priority"), [*keys, "true_priority"]).join(ranks("pred_priority"), [*keys, "pred_priority"])
    sums = rows.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    over = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    vx, vy = F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    return sums.select(*keys, F.when((vx == 0) & (vy == 0), 1.0).otherwise(ratio(over, F.sqrt(vx * vy))).alias("rho"))


def pairwise_accuracy(rows: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """Share of a window's pairs with different true priorities that the prediction orders alike. A predicted tie is
    wrong if strict, else right where the first listed of the two has the larger true value. Pairs are counted from
    cells of (true, predicted), those of tied predictions from running counts: no pair is made."""
    cells = rows.groupBy(*keys, "true_priority", "pred_priority").agg(F.count(F.lit(1)).alias("n"))
    a, b = (cells.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("true_priority", "pred_priority", "n"))) for s in "ab")
    n, apart = F.col("n_a") * F.col("n_b"), F.col("pred_priority_a") < F.col("pred_priority_b")
    pairs = a.join(b, keys).filter("true_priority_a < true_priority_b").groupBy(*keys).agg(F.sum(F.when(apart, n).otherwise(0)).alias("correct"), F.sum(n).alias("total"))
    if not strict:
        before = Window.partitionBy(*keys, "pred_priority").orderBy("demand_id").rowsBetween(Window.unboundedPreceding, -1)
        larger = sum((F.when(F.col("true_priority") < t, F.coalesce(F.count_if(F.col("true_priority") == t).over(before), F.lit(0))).otherwise(0) for t in (3, 4)),
                     F.when(F.col("true_priority") < 2, F.coalesce(F.count_if(F.col("true_priority") == 2).over(before), F.lit(0))).otherwise(0))
        tied = rows.withColumn("larger", larger).groupBy(*keys).agg(F.sum("larger").alias("tied"))
        pairs = pairs.join(tied, keys).withColumn("correct", F.col("correct") + F.col("tied")).drop("tied")
    return pairs.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def verdicts(rows: DataFrame, key: str, base: str, signs: dict[str, int]) -> DataFrame:
    """How many measures of each row are better and worse than the base row's (sign -1: better downwards), and which
    of the two is better: without a measure on the other side, or by two more."""
    plain = rows.filter(F.col(key) == base).select(*(F.col(m).alias(f"{m}_0") for m in signs))
    deltas = F.array(*((F.col(m) - F.col(f"{m}_0")) * w for m, w in signs.items()))
    counts = rows.filter(F.col(key) != base).crossJoin(F.broadcast(plain)).select(key, F.array_compact(deltas).alias("deltas"))  # plain is one row
    better, worse = (F.size(F.filter("deltas", f)).cast("long") for f in (lambda x: x >= 1e-9, lambda x: x <= -1e-9))
    counts = counts.select(key, better.alias("n_better"), worse.alias("n_worse"), F.size("deltas").alias("n"))
    b, w = F.col("n_better"), F.col("n_worse")
    overall = (F.when(F.col("n") == 0, "inconclusive").when((b > 0) & (w == 0), "post_better").when((w > 0) & (b == 0), "pre_better")
               .when(b >= w + 2, "post_better").when(w >= b + 2, "pre_better").otherwise("mixed"))
    return counts.select(key, "n_better", "n_worse", overall.alias("overall"))


#: Fixed values of the reward: the importance of priorities 1 to 4, and the parts' weights.
IMPORTANCE = (4.0, 3.0, 2.0, 1.0)
REWARD = {"json": 0.05, "balanced": 0.25, "exact": 0.25, "near": 0.05, "pairwise": 0.10, "topk": 0.05, "urgent_f1": 0.10, "p1_recall": 0.10, "distribution": 0.05}


def ranking_reward(rows: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """(keys, demand_id, true_priority, pred_priority) -> (keys, reward). A demand without prediction has a null one.
    Parts are sums over the cells of (true, predicted); pairs are pairs of cells."""
    t, p, n = F.col("t"), F.col("p"), F.col("n")
    placed = rows.withColumns({"tr": F.row_number().over(Window.partitionBy(*keys).orderBy("true_priority", "demand_id")),
                               "pr": F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("pred_priority", F.lit(99)), "demand_id"))})
    target = (F.col("tr") <= top) & (F.col("true_priority") <= 2)
    placed = placed.withColumn("k", F.count_if(target).over(Window.partitionBy(*keys)))
    tops = placed.groupBy(*keys).agg(ratio(F.count_if(target & (F.col("pr") <= F.col("k"))), F.max("k")).alias("topk"))

    cells = rows.groupBy(*keys, F.col("true_priority").alias("t"), F.col("pred_priority").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = F.element_at(F.array(*map(F.lit, IMPORTANCE)), t) * n
    total = lambda test, x: F.sum(F.when(test, x).otherwise(0.0))
    tp, fp, fn = total((t <= 2) & (p <= 2), w), total((t > 2) & (p <= 2), w), total((t <= 2) & ~F.coalesce(p <= 2, F.lit(False)), w)
    far = sum((F.abs(ratio(total(t == i, n), F.sum(n)) - ratio(total(p == i, n), total(p.isNotNull(), n))) for i in (2, 3, 4)),
              F.abs(ratio(total(t == 1, n), F.sum(n)) - ratio(total(p == 1, n), total(p.isNotNull(), n))))
    sums = cells.groupBy(*keys).agg(
        (total(p.isNotNull(), n) > 0).cast("double").alias("json"), ratio(total(t == p, w), F.sum(w)).alias("exact"),
        ratio(total(p.isNotNull(), w * (1 - F.abs(t - p) / 3)), F.sum(w)).alias("near"), F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("urgent_f1"),
        ratio(total((t == 1) & (p == 1), n), total(t == 1, n)).alias("p1_recall"), F.coalesce(1 - far / 2, F.lit(0.0)).alias("distribution"))
    balanced = cells.groupBy(*keys, "t").agg(ratio(total(t == p, n), F.sum(n)).alias("recall")).groupBy(*keys).agg(F.avg("recall").alias("balanced"))
    a, b = (cells.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in "tpn")) for s in "ab")
    weight = (F.col("t_b") - F.col("t_a") + (F.col("t_a") <= 2).cast("int") + (F.col("t_b") <= 2).cast("int") / 2) * F.col("n_a") * F.col("n_b")
    pairs = a.join(b, keys).filter("t_a < t_b").groupBy(*keys).agg(ratio(total(F.col("p_a") < F.col("p_b"), weight), F.sum(weight)).alias("pairwise"))
    parts = sums.join(balanced, keys).join(tops, keys).join(pairs, keys, "left")
    over = sum((F.coalesce(F.col(c) * x, F.lit(0.0)) for c, x in REWARD.items()), F.lit(0.0))
    under = sum((F.when(F.col(c).isNotNull(), x).otherwise(0.0) for c, x in REWARD.items()), F.lit(0.0))
    return parts.select(*keys, ratio(over, under).alias("reward"))


def set_f1(said: Column, truth: Column) -> Column:
    """F1 of two sets; null without a truth, 0 without a prediction or anything in common."""
    both = F.size(F.array_intersect(said, truth))
    f1 = F.coalesce(ratio(2 * both, F.size(F.array_distinct(said)) + F.size(F.array_distinct(truth))), F.lit(0.0))
    return F.when(F.size(truth) > 0, f1)


def weighted_mean(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The mean of the parts that aren't null, by their weights."""
    over = sum((F.coalesce(parts[c] * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return ratio(over, sum((F.when(parts[c].isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0)))
