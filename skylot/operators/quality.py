"""The audit of ranking data: what is wrong with each window, how often, and the first examples of each fault.

Windows come as JSON texts, whose fields may be of any kind, and are read as variants. All faults of a window are found by
functions over its own lists, in one pass over the rows and in time and memory that grow with the lists: that all pairs of a window are there
is known by their number, unless it is right. Counts and examples are combined in each task before anything
moves: a task sends at most `limit` examples of a fault.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.sources.staging import staged

#: What is counted: faults of windows and their lists (fixed names).
ISSUES = ("demands_not_list", "priority_labels_not_list", "pairwise_preferences_not_list", "critical_topk_targets_not_list", "demand_not_dict", "missing_demand_id", "duplicate_demand_id",
          "priority_label_id_set_mismatch", "invalid_priority_value", "invalid_window_rank", "window_ranks_not_contiguous", "pairwise_unknown_demand_id", "pairwise_priority_conflict",
          "pairwise_gap_mismatch", "topk_unknown_demand_id", "topk_mismatch_vs_priority_labels", "priority_labels_mismatch_vs_demands", "pairwise_mismatch_vs_demands", "topk_mismatch_vs_demands",
          "failed_to_recompute_targets")
KINDS = {"context_signals": "ARRAY", "priority_evaluation_signals": "OBJECT", "special_handling": "ARRAY", "population_vulnerability": "OBJECT"}
FAN_IN = 64


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _is(v: Column, kind: str) -> Column:
    """Is a variant of a kind? A field that isn't there has none."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _listed(v: Column, name: str) -> Column:
    """A list's elements; a field that isn't there is an empty list, one that is no list is null."""
    field = _get(v, name)
    return F.when(field.isNull(), F.array().cast("array<variant>")).when(_is(field, "ARRAY"), _get(v, name, "array<variant>"))


def _text(v: Column, name: str) -> Column:
    """A field's text without the spaces round it; JSON's null reads None, a field that isn't there is empty."""
    field = _get(v, name)
    return F.when(field.isNull(), "").when(_is(field, "VOID"), "None").otherwise(F.trim(F.coalesce(_get(v, name, "string"), F.lit(""))))


def windows(rows: DataFrame) -> DataFrame:
    """(source, line, value) -> the lists of each window as typed arrays; null where there is no list."""
    v = rows.withColumn("v", F.try_parse_json("value"))
    lists = v.select("source", "line", F.coalesce(_get(F.col("v"), "time_window", "string"), F.lit("")).alias("time_window"), *(
        _listed(F.col("v"), n).alias(n) for n in ("demands", "priority_labels", "pairwise_preferences", "critical_topk_targets")))
    whole = lambda d, n: F.coalesce(_get(_get(d, "labels"), n, "int"), F.lit(4 if n.endswith("priority") else 0))

    def demand(d: Column) -> Column:
        signals = _get(d, "priority_evaluation_signals")
        inner = F.when(_is(signals, "OBJECT"), signals)
        fields = {"context_signals": _get(d, "context_signals"), "priority_evaluation_signals": signals, "special_handling": _get(inner, "special_handling"), "population_vulnerability": _get(inner, "population_vulnerability")}
        nothing = {n: f.isNull() | _is(f, "VOID") for n, f in fields.items()}
        return F.struct(_is(d, "OBJECT").alias("fine"), _text(d, "demand_id").alias("id"), whole(d, "extraction_observable_priority").alias("priority"), whole(d, "extraction_observable_score").alias("score"),
                        *(nothing[n].alias(f"none_{n}") for n in fields), *((~nothing[n] & ~_is(f, KINDS[n])).alias(f"kind_{n}") for n, f in fields.items()))

    def label(r: Column) -> Column:
        given, value = _get(r, "priority"), _get(r, "priority", "double")
        fine = ~_is(given, "STRING") & F.coalesce(value.isin(1.0, 2.0, 3.0, 4.0), F.lit(False))
        return F.struct(_text(r, "demand_id").alias("id"), fine.alias("fine"), F.coalesce(_get(r, "priority", "int"), F.lit(4)).alias("priority"), _get(r, "window_rank", "int").alias("rank"))

    pair = lambda p: F.struct(_text(p, "higher_priority_demand_id").alias("high"), _text(p, "lower_priority_demand_id").alias("low"), _get(p, "priority_gap", "int").alias("gap"))
    return lists.select("source", "line", "time_window", F.transform("demands", demand).alias("demands"), F.transform("priority_labels", label).alias("labels"),
                        F.transform("pairwise_preferences", pair).alias("pairs"), F.transform("critical_topk_targets", lambda t: F.coalesce(t.try_cast("string"), F.lit("None"))).alias("targets"))


LOOK = "named array<string>, urgent array<string>, high array<struct<known: boolean, priority: int>>, low array<struct<known: boolean, priority: int>>, unknown array<string>"


def _looked_up(urgent: int):
    """Of a window's lists: the ids that labels name (the last label of an id counts), the urgent ones of them, what is known of each
    pair's ends, and the targets that no demand is. Arrays know no lookup that doesn't read them whole."""

    @F.udf(LOOK, useArrow=True)
    def look(ids, labels, priorities, high, low, targets):
        if ids is None or labels is None:
            return None
        known, of = set(ids), {i: int(p) for i, p in zip(labels, priorities, strict=True) if i != ""}
        ends = lambda names: None if names is None else [{"known": n in known, "priority": of.get(n)} for n in names]
        return {"named": list(of), "urgent": [i for i, p in of.items() if p <= urgent], "high": ends(high), "low": ends(low),
                "unknown": None if targets is None else [t for t in targets if t not in known]}

    return look


def faults(found: DataFrame, urgent: int = 2) -> DataFrame:
    """windows() -> (issue, n, source, line, example), one row a window and fault that it has; example: the first of its kind
    in the window."""
    c = F.col
    found = found.withColumn("ids", F.transform(F.filter("demands", lambda d: d["fine"] & (d["id"] != "")), lambda d: d["id"]))
    found = found.withColumn("look", _looked_up(urgent)("ids", F.transform("labels", lambda r: r["id"]), F.transform("labels", lambda r: r["priority"]), F.transform("pairs", lambda p: p["high"]), F.transform("pairs", lambda p: p["low"]), "targets"))
    found = found.withColumns({"high": c("look.high"), "low": c("look.low")}).withColumn("seen", F.arrays_zip("pairs", "high", "low"))
    both_known = lambda s: s["high"]["known"] & s["low"]["known"]
    judged = F.filter("seen", lambda s: both_known(s) & s["high"]["priority"].isNotNull() & s["low"]["priority"].isNotNull())
    ranks = F.transform(F.filter("labels", lambda r: r["rank"].isNotNull()), lambda r: r["rank"])
    named, urgent_ids = F.array_sort("look.named"), F.array_sort("look.urgent")
    by_rank = F.transform(F.array_sort(F.transform("demands", lambda d: F.struct(d["priority"].alias("priority"), (-d["score"]).alias("s"), d["id"].alias("id")))), lambda d, i: F.struct(d["id"].alias("id"), d["priority"].alias("priority"), (i + 1).alias("rank")))
    found = found.withColumn("want", by_rank)
    # in the order of want priorities rise, so runs of equal ones tell how many pairs differ
    runs = F.aggregate("want", F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("alike")), lambda a, w: F.struct(
        w["priority"].alias("p"), F.when(w["priority"] == a["p"], a["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), F.when(w["priority"] == a["p"], a["alike"] + a["run"]).otherwise(a["alike"]).alias("alike")), lambda a: a["alike"])
    found = found.withColumn("n_mixed", F.size("want").cast("long") * (F.size("want") - 1) / 2 - runs).withColumn("n_mixed", c("n_mixed").cast("long"))
    mixed = F.transform("want", lambda h: F.transform(F.filter("want", lambda w: (w["rank"] > h["rank"]) & (w["priority"] != h["priority"])), lambda w: F.struct(h["id"].alias("high"), w["id"].alias("low"), (w["priority"] - h["priority"]).alias("gap"))))
    whole = F.forall("demands", lambda d: d["fine"])
    both = c("demands").isNotNull() & c("labels").isNotNull()
    one = lambda test, example: F.when(test, F.array(example.cast("string"))).otherwise(F.array().cast("array<string>"))
    told = lambda rows, test, say: F.transform(F.filter(rows, test), say)
    joined = lambda a: F.array_join(a, ",")
    seen_text = lambda s: F.concat_ws(">", s["pairs"]["high"], s["pairs"]["low"], s["pairs"]["gap"].cast("string"))
    lists = {
        "demands_not_list": one(c("demands").isNull(), c("time_window")), "priority_labels_not_list": one(c("demands").isNotNull() & c("labels").isNull(), c("time_window")),
        "pairwise_preferences_not_list": one(both & c("pairs").isNull(), c("time_window")), "critical_topk_targets_not_list": one(both & c("targets").isNull(), c("time_window")),
        "demand_not_dict": F.filter(F.transform("demands", lambda d, i: F.when(~d["fine"], i.cast("string"))), lambda x: x.isNotNull()),
        "missing_demand_id": F.filter(F.transform("demands", lambda d, i: F.when(d["fine"] & (d["id"] == ""), i.cast("string"))), lambda x: x.isNotNull()),
        "duplicate_demand_id": one(F.size("ids") != F.size(F.array_distinct("ids")), joined("ids")),
        "priority_label_id_set_mismatch": one(F.array_sort(F.array_distinct("ids")) != named, F.concat(joined(F.array_sort(F.array_except("ids", named))), F.lit("|"), joined(F.array_except(named, "ids")))),
        "invalid_priority_value": told("labels", lambda r: ~r["fine"], lambda r: r["id"]), "invalid_window_rank": told("labels", lambda r: r["rank"].isNull(), lambda r: r["id"]),
        "window_ranks_not_contiguous": one((F.size(ranks) > 0) & (F.array_sort(ranks) != F.sequence(F.lit(1), F.greatest(F.size("labels"), F.lit(1)))), joined(F.transform(F.array_sort(ranks), lambda x: x.cast("string")))),
        "pairwise_unknown_demand_id": told("seen", lambda s: ~both_known(s), seen_text), "pairwise_priority_conflict": F.transform(F.filter(judged, lambda s: s["high"]["priority"] >= s["low"]["priority"]), seen_text),
        "pairwise_gap_mismatch": F.transform(F.filter(judged, lambda s: s["pairs"]["gap"].isNotNull() & (s["pairs"]["gap"] != s["low"]["priority"] - s["high"]["priority"])), seen_text),
        "topk_unknown_demand_id": c("look.unknown"), "topk_mismatch_vs_priority_labels": one(F.array_sort("targets") != urgent_ids, joined(F.array_sort("targets"))),
        "priority_labels_mismatch_vs_demands": one(whole & (F.transform("labels", lambda r: F.struct(r["id"].alias("id"), r["priority"].alias("priority"), r["rank"].alias("rank"))) != c("want")), joined(F.transform(F.slice("want", 1, 3), lambda w: w["id"]))),
        "pairwise_mismatch_vs_demands": one(whole & c("pairs").isNotNull() & F.when(F.size("pairs") != c("n_mixed"), True).otherwise(c("pairs") != F.flatten(mixed)), F.concat_ws(":", F.size("pairs").cast("string"), c("n_mixed").cast("string"))),
        "topk_mismatch_vs_demands": one(whole & (c("targets") != F.transform(F.filter("want", lambda w: w["priority"] <= urgent), lambda w: w["id"])), joined("targets")),
        "failed_to_recompute_targets": one(~whole, c("time_window"))}
    first = {"demands_not_list", "priority_labels_not_list"}
    every = [F.struct(F.lit(n).alias("issue"), F.when(both | F.lit(n in first), e).alias("told")) for n, e in lists.items()]
    for n in KINDS:
        for kind, name in (("none", f"{n}_none"), ("kind", f"{n}_not_{'list' if KINDS[n] == 'ARRAY' else 'dict'}")):
            has = (lambda field: lambda d: d["fine"] & d[field])(f"{kind}_{n}")
            every.append(F.struct(F.lit(name).alias("issue"), F.when(both, told("demands", has, lambda d: d["id"])).alias("told")))
    rows = found.select("source", "line", F.inline(F.array(*every))).filter("size(told) > 0")
    return rows.select("issue", F.size("told").cast("long").alias("n"), "source", "line", F.get("told", 0).alias("example"))


PARTIAL = "issue string, n long, source string, line long, example string, task int"


def _combined(limit: int):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[str, int] = {}
        first: dict[str, list] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("issue", "n", "source", "line", "example")), strict=True):
                total[row[0]] = total.get(row[0], 0) + row[1]
                kept = first.setdefault(row[0], [])
                kept.append(row[2:])
                if len(kept) > 8 * limit:
                    first[row[0]] = sorted(kept)[:limit]
        task, out = TaskContext.get().partitionId(), []
        for issue, kept in first.items():
            out += [(issue, total[issue] if i == 0 else 0, *row, task) for i, row in enumerate(sorted(kept)[:limit])]
        yield pa.RecordBatch.from_pylist([dict(zip(("issue", "n", "source", "line", "example", "task"), r, strict=True)) for r in out],
                                         pa.schema([("issue", pa.string()), ("n", pa.int64()), ("source", pa.string()), ("line", pa.int64()), ("example", pa.string()), ("task", pa.int32())]))

    return combine


def audited(rows: DataFrame, limit: int = 5, urgent: int = 2) -> DataFrame:
    """(source, line, value) -> (issue, n, place, source, line, example): how often each fault occurs, in all rows, and the windows
    with the first ones, by source and line."""
    parts = staged(faults(windows(rows), urgent).mapInArrow(_combined(limit), PARTIAL), "faults")
    order = ["source", "line"]
    near = Window.partitionBy("issue", F.floor(F.col("task") / FAN_IN)).orderBy(*order)
    some = parts.withColumn("_i", F.row_number().over(near)).filter(F.col("_i") <= limit)
    best = some.withColumn("place", F.row_number().over(Window.partitionBy("issue").orderBy(*order))).filter(F.col("place") <= limit)
    counts = parts.groupBy("issue").agg(F.sum("n").alias("n"))  # a row a fault
    return best.drop("n").join(F.broadcast(counts), "issue").select("issue", "n", "place", "source", "line", "example")


def missing_files(spark, folders: list[str], name: str) -> list[str]:
    """The run folders without their file, on whatever file system they are."""
    paths = {f: spark._jvm.org.apache.hadoop.fs.Path(f"{f}/{name}") for f in folders}
    return [f for f, p in paths.items() if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
