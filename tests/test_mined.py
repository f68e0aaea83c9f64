"""Choices, splits and logs against plain loops."""

import random
import re

import pytest

from skylot.operators import carry, mining
from skylot.sources import logs


def walked(rows, limit=None):
    """The pairs that a walk by (gap, ids) takes, within one priority."""
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    pairs = sorted(((order[i + 1][1] - order[i][1], order[i][2], order[i + 1][2], i) for i in range(len(order) - 1)))
    used, taken = set(), []
    for gap, a, b, i in pairs:
        if not {i, i + 1} & used and (limit is None or len(taken) < limit):
            used |= {i, i + 1}
            taken.append((a, b, gap))
    return taken


def needs(rng, n):
    return [(rng.randrange(1, 5), rng.randrange(rng.choice([3, 200])), f"D{i:04d}" if rng.random() < 0.5 else str(i)) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 300])
def test_pairs_are_those_of_a_greedy_walk(spark, n):
    rng = random.Random(n)
    rows = needs(rng, n)
    got = [tuple(r) for r in mining.adjacent_pairs(spark.createDataFrame(rows, "priority int, score int, id string"), size=7).filter("chosen").select("priority", "left", "right", "gap").collect()]
    assert sorted(got) == sorted((p, *pair) for p in {r[0] for r in rows} for pair in walked([r for r in rows if r[0] == p]))


def test_runs_that_rise_or_fall_over_many_blocks(spark):
    rows = [(1, 7, f"{i:03d}") for i in range(60)] + [(2, i * i, f"{i:03d}") for i in range(40)] + [(3, 10_000 - i * i, f"{i:03d}") for i in range(41)]
    got = {tuple(r) for r in mining.adjacent_pairs(spark.createDataFrame(rows, "priority int, score int, id string"), size=5).filter("chosen").select("priority", "left", "right", "gap").collect()}
    assert got == {(p, *pair) for p in (1, 2, 3) for pair in walked([r for r in rows if r[0] == p])}


def plain_ties(rows, most=6, per=2):
    by, out = {}, []
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for p in sorted(by):
        other = next((p + d for d in (1, -1, 2) if p + d in by), None)
        if other is None:
            continue
        top = min(by[other], key=lambda r: (-r[1], r[2]))[2]
        out += [(p, a, b, top) for a, b, _ in walked(by[p], per)]
    return [(i, *w) for i, w in enumerate(out[:most], 1)]


def test_near_ties_have_caps_and_neighbours(spark):
    rng = random.Random(8)
    for rows in (needs(rng, 40), needs(rng, 5), [(1, 5, "a"), (1, 6, "b"), (3, 1, "c")], [(2, 1, "a"), (2, 1, "b")]):
        got = mining.near_ties(spark.createDataFrame(rows, "priority int, score int, id string"), size=6).collect()
        assert sorted(map(tuple, got)) == plain_ties(rows)


def test_ends_of_all_rows(spark):
    for n in (0, 1, 3, 4, 5, 30):
        rows = needs(random.Random(n), n)
        frame = spark.createDataFrame(rows, "priority int, score int, id string")
        order = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
        k = min(6, n // 2)
        high, low = (sorted((r["i"], r["id"]) for r in f.collect()) for f in mining.opposites(frame))
        assert high == [(i + 1, order[i][2]) for i in range(k)] and low == [(i + 1, order[-i - 1][2]) for i in range(k)]
        by_id = sorted(rows, key=lambda r: (r[0], r[2]))
        want = [by_id[i][2] for i in (0, 1, -2, -1)] if n >= 4 else []
        assert [r["id"] for r in sorted(mining.mixed(frame).collect(), key=lambda r: r["place"])] == want


def plain_cover(windows, total):
    chosen = {}
    order = lambda w: (-len(w[2]), -w[1], w[0])
    for label in mining.LABELS:
        free = sorted((w for w in windows if label in w[2] and w[0] not in chosen), key=order)
        if free and len(chosen) < total:
            chosen[free[0][0]] = label
    rest = sorted((w for w in windows if w[0] not in chosen), key=order)[:max(0, total - len(chosen))]
    return chosen | {w[0]: None for w in rest}


def test_covering_sample_against_the_loop(spark):
    rng = random.Random(1)
    for total in (1, 4, 9, 50):
        windows = [(f"w{i:02d}", rng.randrange(1, 8), [k for k in mining.LABELS[:-1] if rng.random() < 0.3] or ["routine"]) for i in range(30)]
        got = mining.covering_sample(spark.createDataFrame(windows, "time_window string, n_demands long, labels array<string>"), total).collect()
        assert {r["time_window"]: r["chosen_by"] for r in got} == plain_cover(windows, total) and len(got) == min(total, 30)


def test_window_labels(spark):
    rows = [("a", 1, False), ("a", 3, False), ("b", 3, True), ("c", 4, False), ("d", 2, False), ("d", 3, False)] + [("e", 4, False)] * 5
    got = {r["time_window"]: (r["n_demands"], r["labels"]) for r in mining.window_labels(spark.createDataFrame(rows, "label string, priority int, vulnerable boolean")).collect()}
    assert got == {"a": (2, ["priority_1", "urgent"]), "b": (1, ["vulnerable"]), "c": (1, ["routine"]), "d": (2, ["urgent", "near_tie"]), "e": (5, ["near_tie", "dense"])}


@pytest.mark.parametrize("n,ratio", [(0, 0.5), (1, 0.5), (2, 0.01), (3, 0.99), (5, 0.5), (7, 0.5), (1000, 0.15), (1000, 0.0)])
def test_split_sizes_are_exact_and_the_same_for_any_partitioning(spark, n, ratio):
    want = 0 if n <= 1 or ratio == 0 else min(max(1, round(n * ratio)), n - 1)
    rows = spark.createDataFrame([(i,) for i in range(n)], "id long")
    held = {r["id"] for r in mining.exact_split(rows, "id", ratio).filter("held_out").collect()}
    assert len(held) == want == mining.split_size(n, ratio)
    if n == 1000:
        assert held == {r["id"] for r in mining.exact_split(rows.repartition(7), "id", ratio).filter("held_out").collect()}


def test_a_split_of_rows_that_share_a_key_is_exact(spark):
    rows = spark.createDataFrame([(7,)] * 90 + [(i,) for i in range(10)] + [(None,)] * 20, "id long").repartition(5)
    found = mining.exact_split(rows, "id", 0.5)
    assert found.count() == 120 and found.filter("held_out").count() == 60


def plain_trace(lines):
    number = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[Ee][+-]?\d+)?"
    trace, last, seen = [], 0.0, set()
    for line in map(str.strip, lines):
        if m := re.search(rf"found incumbent of value\s+({number}).*?after\s+({number})\s+sec", line, re.I):
            value, at = float(m[1]), float(m[2])
            if (round(at, 6), round(value, 6)) not in seen:
                seen.add((round(at, 6), round(value, 6)))
                last = at
                trace.append((round(at, 6), value))
            continue
        if m := re.search(r"time\s*=\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))", line, re.I):
            last = float(m[1])
        if (m := re.match(rf"\*\s+\S+\s+\S+\s+({number})", line)) and (round(last, 6), round(float(m[1]), 6)) not in seen:
            seen.add((round(last, 6), round(float(m[1]), 6)))
            trace.append((round(last, 6), float(m[1])))
    return sorted(trace)


def a_log(rng, n):
    kinds = [lambda: f"Found incumbent of value {rng.randrange(4)}.5 after {rng.randrange(5)}.0 sec. (9 ticks)", lambda: f"  Elapsed Time = {rng.randrange(5)}.00 sec.",
             lambda: f"*  {rng.randrange(9)}+  0  {rng.randrange(4)}.5e0  7", lambda: "", lambda: f"* 1 2 {rng.randrange(4)}.5 time = {rng.randrange(5)}", lambda: "x * 1 2 3"]
    return [rng.choice(kinds)() for _ in range(n)]


def test_traces_of_logs_cut_in_ranges(spark, tmp_path):
    rng = random.Random(6)
    told = {f"log{i}": a_log(rng, 5 + 25 * i) for i in range(6)}
    rows = [(name, i // 9, i, line) for name, lines in told.items() for i, line in enumerate(lines)]
    got = logs.incumbents(spark.createDataFrame(rows, "log string, block long, at long, value string").repartition(5)).collect()
    for name, lines in told.items():
        assert sorted((r[1], r[2]) for r in got if r[0] == name) == plain_trace(lines), name
    for name, lines in told.items():
        (tmp_path / f"{name}.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = logs.log_lines(spark, str(tmp_path))
        assert lines.select("log", "block").distinct().count() > len(told) + 3
        got = logs.incumbents(lines).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, lines in told.items():
        assert sorted((r[1], r[2]) for r in got if r[0].endswith(f"{name}.log")) == plain_trace(lines), name


def test_convergence_against_the_loop(spark):
    rng = random.Random(9)
    trace = [(f"r{rng.randrange(5)}", rng.randrange(60) / 2, rng.randrange(100) * 1.0) for _ in range(120)]
    times = sorted({t for _, t, _ in trace})
    want, before = [], {}
    for t in times:
        best = {}
        for run, at, v in trace:
            if at <= t:
                best[run] = min(v, best.get(run, v))
        if best != before:
            want.append((t, len(best), min(best.values()), sum(best.values()) / len(best)))
        before = best
    got = sorted(map(tuple, logs.convergence(spark.createDataFrame(trace, "log string, elapsed_time_s double, objective_value double"), 4.0).collect()))
    assert len(got) == len(want) and all(g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want, strict=True))


def test_halos_and_running_values(spark):
    rows = [(i, None if i % 4 else i, i % 3) for i in range(23)]
    frame = spark.createDataFrame(rows, "place long, v long, s long")
    seen = carry.with_halo(frame, "place", 5, 1, 2).collect()
    assert sorted(r["place"] for r in seen if r["block"] == 1) == [4, 5, 6, 7, 8, 9, 10, 11] and sum(not r["halo"] for r in seen) == 23
    from pyspark.sql import functions as F
    run = carry.running(frame.withColumn("b", F.floor(F.col("place") / 5)), [], "b", ["place"], {"l": ("last", F.col("v")), "t": ("sum", F.col("s")), "m": ("min", F.col("v"))})
    assert [(r["l"], r["t"], r["m"]) for r in run.orderBy("place").collect()] == [(i // 4 * 4, sum(j % 3 for j in range(i + 1)), 0) for i in range(23)]
