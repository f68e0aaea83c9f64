"""Queries over delivery facts: service, latency, fairness, classification, rank agreement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.functions.scalars import q6
from skylot.operators import metrics, ranking
from skylot.operators.metrics import ratio
from skylot.plans.twins import q6 as q
from skylot.plans.twins import with_fact
from skylot.registry import query
from skylot.sources.lens import facts

_SUBSET = f"""count(*) AS n, count(*) FILTER (served) AS served, {q('count(*) FILTER (served) / count(*)::DOUBLE')} AS service_rate,
  {q('avg(latency) FILTER (served)')} AS mean_latency, {q('quantile_cont(latency, 0.9) FILTER (served)')} AS p90_latency,
  {q('count(*) FILTER (on_time) / count(*)::DOUBLE')} AS on_time_rate"""


def _subset(rows, *keys):
    out = rows.groupBy(*keys).agg(*metrics.subset())
    return out.withColumns({c: q6(F.col(c)) for c in ("service_rate", "mean_latency", "p90_latency", "on_time_rate")})


@query("method_summary", with_fact(f"SELECT method, {_SUBSET} FROM v_fact GROUP BY method"))
def method_summary(spark, d):
    return _subset(facts(spark, d), "method")


@query("method_by_priority", with_fact(f"SELECT method, true_priority, {_SUBSET} FROM v_fact GROUP BY method, true_priority"))
def method_by_priority(spark, d):
    return _subset(facts(spark, d), "method", "true_priority")


@query("grouping_sets_report", with_fact("SELECT method, true_priority, count(*) AS n, count(*) FILTER (served) AS served FROM v_fact GROUP BY GROUPING SETS ((method), (method, true_priority), ())"))
def grouping_sets_report(spark, d):
    rows = facts(spark, d)
    sets = [[F.col("method")], [F.col("method"), F.col("true_priority")], []]
    return rows.groupingSets(sets, "method", "true_priority").agg(F.count(F.lit(1)).alias("n"), F.count_if("served").alias("served"))


@query("vulnerable_slices", with_fact(f"SELECT method, 'vulnerable' AS slice, {_SUBSET} FROM v_fact WHERE vulnerable GROUP BY method UNION ALL SELECT method, 'urgent' AS slice, {_SUBSET} FROM v_fact WHERE true_priority <= 2 GROUP BY method"))
def vulnerable_slices(spark, d):
    """Overlapping slices in one pass: a row goes to each slice that it belongs to."""
    there = F.array_compact(F.array(F.when(F.col("vulnerable"), "vulnerable"), F.when(F.col("true_priority") <= 2, "urgent")))
    return _subset(facts(spark, d).withColumn("slice", F.explode(there)), "method", "slice")


@query("weighted_scores", with_fact(f"SELECT method, {q('sum(CASE WHEN served THEN 5 - true_priority ELSE 0 END) / sum(5 - true_priority)::DOUBLE')} AS service, {q('sum(CASE WHEN on_time THEN 5 - true_priority ELSE 0 END) / sum(5 - true_priority)::DOUBLE')} AS on_time FROM v_fact GROUP BY method"))
def weighted_scores(spark, d):
    return facts(spark, d).groupBy("method").agg(q6(metrics.weighted_score("served")).alias("service"), q6(metrics.weighted_score("on_time")).alias("on_time"))


@query("gini_latency", with_fact(f"SELECT method, {q('2 * sum(i * latency) / (count(*) * sum(latency)) - (count(*) + 1) / count(*)::DOUBLE')} AS gini FROM (SELECT method, latency, row_number() OVER (PARTITION BY method ORDER BY latency) AS i FROM v_fact WHERE served) GROUP BY method"))
def gini_latency(spark, d):
    return metrics.gini(facts(spark, d).filter("served"), ["method"], "latency").select("method", q6(F.col("gini")).alias("gini"))


_RATES = "SELECT method, true_priority, avg(CASE WHEN served THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate, 1 / nullif(avg(latency) FILTER (served), 0) AS speed FROM v_fact GROUP BY method, true_priority"


def _rates(spark, d):
    return facts(spark, d).groupBy("method", "true_priority").agg(
        F.avg(F.col("served").cast("double")).alias("rate"), ratio(F.lit(1.0), F.avg(F.when(F.col("served"), F.col("latency")))).alias("speed"))


@query("jain_rates", with_fact(f"SELECT method, {q('sum(rate) * sum(rate) / (count(rate) * sum(rate * rate))')} AS jain FROM ({_RATES}) GROUP BY method"))
def jain_rates(spark, d):
    return _rates(spark, d).groupBy("method").agg(q6(metrics.jain("rate")).alias("jain"))


@query("jain_tiers", with_fact(f"SELECT method, {q('sum(speed) * sum(speed) / (count(speed) * sum(speed * speed))')} AS jain FROM ({_RATES}) GROUP BY method"))
def jain_tiers(spark, d):
    """Fairness of the tiers' speeds, one over their mean latency."""
    return _rates(spark, d).groupBy("method").agg(q6(metrics.jain("speed")).alias("jain"))


@query("latency_gap", with_fact(f"SELECT method, {q('nullif(avg(latency) FILTER (true_priority = 4 AND served), 0) - nullif(avg(latency) FILTER (true_priority = 1 AND served), 0)')} AS gap FROM v_fact GROUP BY method"))
def latency_gap(spark, d):
    def mean(p):
        return F.nullif(F.avg(F.when((F.col("true_priority") == p) & F.col("served"), F.col("latency"))), F.lit(0.0))
    return facts(spark, d).groupBy("method").agg(q6(mean(4) - mean(1)).alias("gap"))


@query("running_distance", with_fact(f"""SELECT method, month, running, sum(running) OVER (PARTITION BY method) AS sum_of_running, max(running) OVER (PARTITION BY method) AS last_running
  FROM (SELECT method, month, sum(quantity) OVER (PARTITION BY method ORDER BY month) AS running FROM (SELECT method, month, sum(quantity) AS quantity FROM v_fact GROUP BY method, month))"""))
def running_distance(spark, d):
    """A window's distance is a running total: its sum over windows (as published) beside its last value."""
    months = facts(spark, d).groupBy("method", "month").agg(F.sum("quantity").alias("quantity"))
    w = Window.partitionBy("method")
    rows = months.select("method", "month", F.sum("quantity").over(w.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    return rows.select("*", F.sum("running").over(w).alias("sum_of_running"), F.max("running").over(w).alias("last_running"))


@query("impact_comparison", with_fact(f"SELECT a.method, b.method AS reference, {q('a.r - b.r')} AS on_time_gain, {q('(b.l - a.l) / nullif(b.l, 0)')} AS latency_improvement FROM (SELECT method, avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END) AS r, avg(latency) AS l FROM v_fact GROUP BY method) a JOIN (SELECT method, avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END) AS r, avg(latency) AS l FROM v_fact GROUP BY method) b ON b.method = 'N' AND a.method <> 'N'"))
def impact_comparison(spark, d):
    means = facts(spark, d).groupBy("method").agg(F.avg(F.col("on_time").cast("double")).alias("r"), F.avg("latency").alias("l"))
    base = means.filter("method = 'N'").select(F.col("method").alias("reference"), F.col("r").alias("r0"), F.col("l").alias("l0"))
    return means.filter("method <> 'N'").crossJoin(F.broadcast(base)).select(  # base is one row
        "method", "reference", q6(F.col("r") - F.col("r0")).alias("on_time_gain"), q6(ratio(F.col("l0") - F.col("l"), F.col("l0"))).alias("latency_improvement"))


_MEASURES = """SELECT method, avg(CASE WHEN true_priority = pred_priority THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy,
  count(*) FILTER (true_priority = 1 AND pred_priority = 1) / nullif(count(*) FILTER (true_priority = 1), 0)::DOUBLE AS p1_recall,
  count(*) FILTER (true_priority <= 2 AND pred_priority <= 2) / nullif(count(*) FILTER (true_priority <= 2), 0)::DOUBLE AS urgent_recall,
  avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END)::DOUBLE AS on_time, avg(latency) AS latency FROM v_fact GROUP BY method"""
_SIGNS = {"accuracy": 1, "p1_recall": 1, "urgent_recall": 1, "on_time": 1, "latency": -1}


@query("verdict", with_fact(f"""SELECT method, n_better, n_worse, CASE WHEN n_better + n_worse + n_same = 0 THEN 'inconclusive' WHEN n_better > 0 AND n_worse = 0 THEN 'post_better'
  WHEN n_worse > 0 AND n_better = 0 THEN 'pre_better' WHEN n_better >= n_worse + 2 THEN 'post_better' WHEN n_worse >= n_better + 2 THEN 'pre_better' ELSE 'mixed' END AS overall
  FROM (SELECT method, count(*) FILTER (delta >= 1e-9) AS n_better, count(*) FILTER (delta <= -1e-9) AS n_worse, count(*) FILTER (abs(delta) < 1e-9) AS n_same FROM (
  SELECT a.method, unnest([{', '.join(f"({w}) * (a.{m} - b.{m})" for m, w in _SIGNS.items())}]) AS delta FROM ({_MEASURES}) a JOIN ({_MEASURES}) b ON b.method = 'N' AND a.method <> 'N') GROUP BY method)"""))
def verdict(spark, d):
    """Is a method better than the reference one? By how many measures got better and worse, latency better downwards."""
    t, p = F.col("true_priority"), F.col("pred_priority")
    rows = facts(spark, d).groupBy("method").agg(
        F.avg((t == p).cast("double")).alias("accuracy"), ratio(F.count_if((t == 1) & (p == 1)), F.count_if(t == 1)).alias("p1_recall"),
        ratio(F.count_if((t <= 2) & (p <= 2)), F.count_if(t <= 2)).alias("urgent_recall"), F.avg(F.col("on_time").cast("double")).alias("on_time"), F.avg("latency").alias("latency"))
    return metrics.verdicts(rows, "method", "N", _SIGNS)


_GRID = "SELECT g.method, t AS true_priority, p AS pred_priority, coalesce(n, 0) AS n FROM (SELECT DISTINCT method FROM v_fact) g CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS t) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS p) LEFT JOIN (SELECT method, true_priority, pred_priority, count(*) AS n FROM v_fact GROUP BY ALL) c ON c.method = g.method AND true_priority = t AND pred_priority = p"


@query("confusion", with_fact(_GRID))
def confusion(spark, d):
    return metrics.confusion(facts(spark, d), ["method"])


_CLASS = """SELECT method, l AS label, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, support, tp FROM (
  SELECT method, l, count(*) FILTER (true_priority = l) AS support, count(*) FILTER (pred_priority = l) AS predicted, count(*) FILTER (true_priority = l AND pred_priority = l) AS tp
  FROM v_fact CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS l) GROUP BY method, l)"""
_F1 = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)"


@query("class_prf", with_fact(f"SELECT method, label, {q('precision')} AS precision, {q('recall')} AS recall, {q(_F1)} AS f1, support FROM ({_CLASS})"))
def class_prf(spark, d):
    rows = metrics.per_class(metrics.confusion(facts(spark, d), ["method"]), ["method"])
    return rows.select("method", "label", *(q6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("macro_weighted_f1", with_fact(f"SELECT method, {q('sum(tp) / sum(support)::DOUBLE')} AS accuracy, {q(f'avg({_F1})')} AS macro_f1, {q(f'sum(support * {_F1}) / sum(support)::DOUBLE')} AS weighted_f1 FROM ({_CLASS}) GROUP BY method"))
def macro_weighted_f1(spark, d):
    rows = metrics.per_class(metrics.confusion(facts(spark, d), ["method"]), ["method"])
    return rows.groupBy("method").agg(q6(ratio(F.sum("tp"), F.sum("support"))).alias("accuracy"), q6(F.avg("f1")).alias("macro_f1"), q6(ratio(F.sum(F.col("support") * F.col("f1")), F.sum("support"))).alias("weighted_f1"))


@query("pooled_accuracy", with_fact(f"SELECT {q('avg(CASE WHEN true_priority = pred_priority THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM v_fact"))
def pooled_accuracy(spark, d):
    return facts(spark, d).agg(q6(F.avg((F.col("true_priority") == F.col("pred_priority")).cast("double"))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def _binary(name, test):
    c = ["true_priority", "pred_priority"]
    tp, s, g = f"count(*) FILTER ({c[0]} {test} AND {c[1]} {test})", f"count(*) FILTER ({c[0]} {test})", f"count(*) FILTER ({c[1]} {test})"
    sql = f"SELECT method, support, predicted, {q('precision')} AS precision, {q('recall')} AS recall, {q(_F1)} AS f1 FROM (SELECT method, {s} AS support, {g} AS predicted, coalesce({tp} / nullif({g}, 0)::DOUBLE, 0) AS precision, {tp} / nullif({s}, 0)::DOUBLE AS recall FROM v_fact GROUP BY method)"

    @query(name, with_fact(sql))
    def run(spark, d):
        rows = facts(spark, d).groupBy("method").agg(*metrics.binary(F.expr(f"{c[0]} {test}"), F.expr(f"{c[1]} {test}")))
        return rows.withColumns({x: q6(F.col(x)) for x in ("precision", "recall", "f1")})


_binary("binary_p1", "= 1")
_binary("binary_urgent", "<= 2")


@query("spearman", with_fact(f"SELECT method, {q('corr(rt, rp)')} AS rho FROM (SELECT method, rank() OVER (PARTITION BY method ORDER BY true_priority) + (count(*) OVER (PARTITION BY method, true_priority) - 1) / 2.0::DOUBLE AS rt, rank() OVER (PARTITION BY method ORDER BY pred_priority) + (count(*) OVER (PARTITION BY method, pred_priority) - 1) / 2.0::DOUBLE AS rp FROM v_fact) GROUP BY method"))
def spearman(spark, d):
    cells = metrics.confusion(facts(spark, d), ["method"])
    return metrics.spearman(cells, ["method"]).select("method", q6(F.col("rho")).alias("rho"))


_CELLS = "cells AS (SELECT method, true_priority AS t, pred_priority AS p, count(*)::DOUBLE AS n FROM v_fact GROUP BY ALL)"


@query("kendall_b", f"""WITH {with_fact('')[5:]}, {_CELLS},
s AS (SELECT a.method, sum(sign(b.t - a.t) * sign(b.p - a.p) * a.n * b.n) / 2 AS s FROM cells a JOIN cells b ON a.method = b.method GROUP BY a.method),
x AS (SELECT method, sum(n * (n - 1) / 2) AS ties, sum(n) * (sum(n) - 1) / 2 AS total FROM (SELECT method, t, sum(n) AS n FROM cells GROUP BY method, t) GROUP BY method),
y AS (SELECT method, sum(n * (n - 1) / 2) AS ties FROM (SELECT method, p, sum(n) AS n FROM cells GROUP BY method, p) GROUP BY method)
SELECT s.method, {q('s / sqrt((total - x.ties) * (total - y.ties))')} AS tau FROM s JOIN x ON s.method = x.method JOIN y ON s.method = y.method""")
def kendall_b(spark, d):
    cells = metrics.confusion(facts(spark, d), ["method"])
    return metrics.kendall_b(cells, ["method"]).select("method", q6(F.col("tau")).alias("tau"))


_DEMANDS = "SELECT month, demand_id, max(true_priority) AS true_priority, min(pred_priority) AS pred_priority FROM v_fact GROUP BY month, demand_id"


def _window_rows(spark, d):
    return facts(spark, d).groupBy("month", "demand_id").agg(F.max("true_priority").alias("true_priority"), F.min("pred_priority").alias("pred_priority"))


def _pairwise(name, strict):
    tie = "AND a.pred_priority <> b.pred_priority" if strict else ""
    right = f"count(*) FILTER ((a.true_priority < b.true_priority) = (a.pred_priority < b.pred_priority) {tie})"

    @query(name, with_fact(f"SELECT a.month, {right} AS correct, count(*) AS total, {q(f'{right} / count(*)::DOUBLE')} AS accuracy FROM ({_DEMANDS}) a JOIN ({_DEMANDS}) b ON a.month = b.month AND a.demand_id < b.demand_id AND a.true_priority <> b.true_priority GROUP BY a.month"))
    def run(spark, d):
        return metrics.pairwise_accuracy(_window_rows(spark, d), ["month"], strict).withColumn("accuracy", q6(F.col("accuracy")))


_pairwise("pairwise_acc_strict", True)
_pairwise("pairwise_acc_listed", False)


@query("topk_hit", with_fact(f"""SELECT k, count(*) FILTER (true_priority = 1) AS hits, {q('count(*) FILTER (true_priority = 1) / k::DOUBLE')} AS rate FROM (
  SELECT demand_id, true_priority, row_number() OVER (ORDER BY pred_priority, demand_id) AS place, count(*) FILTER (true_priority = 1) OVER () AS k FROM ({_DEMANDS})) WHERE place <= k GROUP BY k"""))
def topk_hit(spark, d):
    """Of as many predictions as there are urgent demands, how many are: a global top-k."""
    rows = ranking.globally_ranked(_window_rows(spark, d), F.struct("pred_priority", F.floor(F.col("demand_id") / 4096)), ("pred_priority", "demand_id"))
    k = rows.agg(F.count_if(F.col("true_priority") == 1).alias("k"))
    hits = F.count_if(F.col("true_priority") == 1)
    top = rows.crossJoin(F.broadcast(k)).filter("place <= k")  # k is one row
    return top.groupBy("k").agg(hits.alias("hits"), q6(ratio(hits, F.col("k"))).alias("rate"))


@query("timing_summary", with_fact(f"SELECT method, count(*) AS n, {q('avg(latency)')} AS mean, {q('stddev_samp(latency)')} AS sd, min(latency) AS low, max(latency) AS high, {q('quantile_cont(latency, 0.5)')} AS p50, {q('quantile_cont(latency, 0.9)')} AS p90 FROM v_fact GROUP BY method"))
def timing_summary(spark, d):
    x = F.col("latency")
    return facts(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), q6(F.avg(x)).alias("mean"), q6(F.stddev_samp(x)).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"), q6(F.percentile(x, F.lit(0.5))).alias("p50"), q6(F.percentile(x, F.lit(0.9))).alias("p90"))


@query("per_drone_rollup", with_fact("SELECT month, carrier, count(*) AS n, count(DISTINCT part) AS parts, sum(quantity) AS quantity FROM v_fact WHERE served GROUP BY month, carrier"))
def per_drone_rollup(spark, d):
    return facts(spark, d).filter("served").groupBy("month", "carrier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts"), F.sum("quantity").alias("quantity"))


@query("case_study_top", with_fact("SELECT demand_id, errors, worst FROM (SELECT demand_id, sum(abs(true_priority - pred_priority))::BIGINT AS errors, max(latency) AS worst FROM v_fact GROUP BY demand_id) ORDER BY errors DESC, worst DESC, demand_id LIMIT 20"))
def case_study_top(spark, d):
    rows = facts(spark, d).groupBy("demand_id").agg(F.sum(F.abs(F.col("true_priority") - F.col("pred_priority"))).alias("errors"), F.max("latency").alias("worst"))
    return rows.orderBy(F.desc("errors"), F.desc("worst"), "demand_id").limit(20)


_PARTS = ("p1_recall", "topk", "urgent_f1", "macro_f1", "accuracy")
_COMPOSITE = "100 * {} + 10 * {} + {} + 0.1 * {} + 0.01 * {}"
_LABEL_F1 = " + ".join(f"coalesce(2.0::DOUBLE * count(*) FILTER (t = {i} AND p = {i}) / nullif(count(*) FILTER (t = {i}) + count(*) FILTER (p = {i}), 0), 0)" for i in (1, 2, 3, 4))


@query("leaderboard", with_fact(f"""SELECT CAST(row_number() OVER (ORDER BY {', '.join(f'{c} DESC' for c in _PARTS)}, carrier) AS BIGINT) AS place, carrier, {', '.join(_PARTS)}, {q(_COMPOSITE.format(*_PARTS))} AS composite FROM (
  SELECT carrier, {q('coalesce(count(*) FILTER (t = 1 AND p = 1) / nullif(count(*) FILTER (t = 1), 0)::DOUBLE, 0)')} AS p1_recall,
  {q('coalesce(count(*) FILTER (t <= 2 AND r <= k) / nullif(max(k), 0)::DOUBLE, 0)')} AS topk,
  {q('coalesce(2.0::DOUBLE * count(*) FILTER (t <= 2 AND p <= 2) / nullif(count(*) FILTER (t <= 2) + count(*) FILTER (p <= 2), 0), 0)')} AS urgent_f1,
  {q(f'({_LABEL_F1}) / 4')} AS macro_f1, {q('avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END)')} AS accuracy
  FROM (SELECT carrier, true_priority AS t, pred_priority AS p, row_number() OVER (PARTITION BY carrier ORDER BY pred_priority, demand_id) AS r,
  count(*) FILTER (true_priority <= 2) OVER (PARTITION BY carrier) AS k FROM v_fact) GROUP BY carrier)"""))
def leaderboard(spark, d):
    """Carriers by recall of priority 1, share of urgent demands among as many first predictions, urgent F1, macro F1 and
    accuracy, in this order; the composite weighs them 100, 10, 1, 0.1 and 0.01."""
    rows = facts(spark, d).select("carrier", "demand_id", F.col("true_priority").alias("t"), F.col("pred_priority").alias("p"))
    own = Window.partitionBy("carrier")
    rows = rows.withColumns({"r": F.row_number().over(own.orderBy("p", "demand_id")), "k": F.count_if(F.col("t") <= 2).over(own)})
    t, p = F.col("t"), F.col("p")
    f1 = lambda a, b: F.coalesce(ratio(2 * F.count_if(a & b), F.count_if(a) + F.count_if(b)), F.lit(0.0))
    macro = sum((f1(t == i, p == i) for i in (2, 3, 4)), f1(t == 1, p == 1)) / 4
    parts = rows.groupBy("carrier").agg(
        q6(F.coalesce(ratio(F.count_if((t == 1) & (p == 1)), F.count_if(t == 1)), F.lit(0.0))).alias("p1_recall"),
        q6(F.coalesce(ratio(F.count_if((t <= 2) & (F.col("r") <= F.col("k"))), F.max("k")), F.lit(0.0))).alias("topk"),
        q6(f1(t <= 2, p <= 2)).alias("urgent_f1"), q6(macro).alias("macro_f1"), q6(F.avg((t == p).cast("double"))).alias("accuracy"))
    ranked = ranking.globally_ranked(parts, -F.floor(F.col("p1_recall") * 1000), (*(f"-{c}" for c in _PARTS), "carrier"))
    return ranked.select("place", "carrier", *_PARTS, q6(F.expr(_COMPOSITE.format(*_PARTS))).alias("composite"))


@query("relative_trend", with_fact(f"SELECT month, {q('v / first_value(v) OVER (ORDER BY month)')} AS rel, {q('v - lag(v) OVER (ORDER BY month)')} AS step FROM (SELECT month, avg(latency) AS v FROM v_fact GROUP BY month)"))
def relative_trend(spark, d):
    months, w = facts(spark, d).groupBy("month").agg(F.avg("latency").alias("v")), Window.orderBy("month")
    return months.select("month", q6(ratio(F.col("v"), F.first("v").over(w))).alias("rel"), q6(F.col("v") - F.lag("v").over(w)).alias("step"))


_IMPORTANCE = "CASE t WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} ELSE {} END".format(*metrics.IMPORTANCE)
_PAIR = "(b.t - a.t + CASE WHEN a.t <= 2 THEN 1 ELSE 0 END + CASE WHEN b.t <= 2 THEN 0.5 ELSE 0 END) * a.n * b.n"


@query("ranking_reward", f"""WITH {with_fact('')[5:]}, r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY true_priority, demand_id) AS tr, row_number() OVER (PARTITION BY month ORDER BY pred_priority, demand_id) AS pr FROM ({_DEMANDS})),
k AS (SELECT month, count(*) FILTER (tr <= 3 AND true_priority <= 2) AS k FROM r GROUP BY month),
top AS (SELECT r.month, count(*) FILTER (tr <= 3 AND true_priority <= 2 AND pr <= k) / nullif(max(k), 0)::DOUBLE AS topk FROM r JOIN k ON r.month = k.month GROUP BY r.month),
c AS (SELECT month, true_priority AS t, pred_priority AS p, count(*)::DOUBLE AS n FROM r GROUP BY ALL),
w AS (SELECT *, ({_IMPORTANCE})::DOUBLE AS w FROM c),
s AS (SELECT month, sum(w * n) FILTER (t = p) / sum(w * n) AS exact, sum(w * n * (1 - abs(t - p) / 3.0)) / sum(w * n) AS near,
  sum(w * n) FILTER (t <= 2 AND p <= 2) AS tp, sum(w * n) FILTER (t > 2 AND p <= 2) AS fp, sum(w * n) FILTER (t <= 2 AND p > 2) AS fn,
  sum(n) FILTER (t = 1 AND p = 1) AS p1, sum(n) FILTER (t = 1) AS n1,
  1 - ({' + '.join(f"abs(coalesce(sum(n) FILTER (t = {i}), 0) - coalesce(sum(n) FILTER (p = {i}), 0))" for i in (1, 2, 3, 4))}) / sum(n) / 2 AS dist FROM w GROUP BY month),
bal AS (SELECT month, avg(recall) AS balanced FROM (SELECT month, t, coalesce(sum(n) FILTER (t = p), 0) / sum(n) AS recall FROM c GROUP BY month, t) GROUP BY month),
pw AS (SELECT a.month, coalesce(sum({_PAIR}) FILTER (a.p < b.p), 0) / sum({_PAIR}) AS pairwise FROM c a JOIN c b ON a.month = b.month AND a.t < b.t GROUP BY a.month)
SELECT s.month, {q('''(0.05 + 0.25 * balanced + 0.25 * coalesce(exact, 0) + 0.05 * near + coalesce(0.1 * pairwise, 0) + coalesce(0.05 * topk, 0)
  + 0.1 * coalesce(2 * tp / nullif(2 * tp + coalesce(fp, 0) + coalesce(fn, 0), 0), 0) + CASE WHEN n1 > 0 THEN 0.1 * coalesce(p1, 0) / n1 ELSE 0 END + 0.05 * dist)
  / (0.75 + CASE WHEN pairwise IS NULL THEN 0 ELSE 0.1 END + CASE WHEN topk IS NULL THEN 0 ELSE 0.05 END + CASE WHEN n1 > 0 THEN 0.1 ELSE 0 END)''')} AS reward
  FROM s JOIN bal ON s.month = bal.month JOIN top ON s.month = top.month LEFT JOIN pw ON s.month = pw.month""")
def ranking_reward(spark, d):
    """A window's predictions by nine weighted parts; what a window lacks is left out of the weights."""
    return metrics.ranking_reward(_window_rows(spark, d), ["month"]).withColumn("reward", q6(F.col("reward")))


@query("s1_group_rates", with_fact(f"SELECT method, " + ", ".join(q(f"avg(CASE WHEN served THEN 1.0 ELSE 0.0 END) FILTER (true_priority = {p})") + f" AS p{p}_rate" for p in (1, 2, 3, 4)) + " FROM v_fact GROUP BY method"))
def s1_group_rates(spark, d):
    rows = facts(spark, d).groupBy("method").pivot("true_priority", [1, 2, 3, 4]).agg(F.avg(F.col("served").cast("double")))
    return rows.select("method", *(q6(F.col(str(p))).alias(f"p{p}_rate") for p in (1, 2, 3, 4)))


@query("long_metrics", with_fact(f"SELECT method, metric, value FROM (SELECT method, {q('avg(latency)')} AS mean_latency, {q('avg(CASE WHEN served THEN 1.0 ELSE 0.0 END)')} AS service_rate FROM v_fact GROUP BY method) UNPIVOT (value FOR metric IN (mean_latency, service_rate))"))
def long_metrics(spark, d):
    wide = facts(spark, d).groupBy("method").agg(q6(F.avg("latency")).alias("mean_latency"), q6(F.avg(F.col("served").cast("double"))).alias("service_rate"))
    return wide.unpivot("method", ["mean_latency", "service_rate"], "metric", "value")


@query("last_wins_fact", with_fact("SELECT demand_id, carrier, latency FROM (SELECT demand_id, carrier, latency, row_number() OVER (PARTITION BY demand_id ORDER BY latency DESC, carrier DESC, part DESC, price DESC) AS r FROM v_fact) WHERE r = 1"))
def last_wins_fact(spark, d):
    """Of several rows with one key the last one in order stays, as in a dictionary that is written over."""
    return ranking.last_wins(facts(spark, d), ["demand_id"], ("latency", "carrier", "part", "price")).select("demand_id", "carrier", "latency")
