"""Flights and schedules against plain loops, tables against streams."""

import math
import random

from pyspark.sql import functions as F

from skylot.operators import intervals, obstacles, spatial
from skylot.plans import flights as plans
from skylot.streaming.windows import event_stream, to_table

SCHEDULE = "place long, start_h double, end_h double"


def first_active(t, schedule):
    if t is None or not schedule:
        return None
    for place, start, end in sorted(schedule):
        if t + 1e-9 >= start and (end is None or t <= end + 1e-9):
            return place
    return max(schedule)[0]


def looked_up(spark, times, schedule):
    rows = spark.createDataFrame(list(enumerate(times)), "i long, t double")
    found = intervals.resolved(spark.createDataFrame(schedule, SCHEDULE))
    return [r["active"] for r in intervals.active(rows, "t", found).orderBy("i").collect()]


def test_overlaps_gaps_and_open_ends(spark):
    rng = random.Random(2)
    for n in (0, 1, 12, 60):
        schedule = []
        for place in rng.sample(range(1000), n):
            start = rng.randrange(200) / 8
            schedule.append((place, start, None if rng.random() < 0.1 else start + rng.choice([0.0, 0.125, 0.5, 3.0, -1.0, 40.0])))
        times = [None, -5.0, 1e5] + [rng.randrange(250) / 8 + rng.choice([0.0, 0.05]) for _ in range(200)]
        assert looked_up(spark, times, schedule) == [first_active(t, schedule) for t in times]


def test_both_ends_are_included_within_the_tolerance(spark):
    schedule = [(1, 1.0, 2.0), (2, 2.0, 3.0)]
    assert looked_up(spark, [1 - 1e-9, 1.0, 2.0, 2 + 1e-9, 2 + 3e-9, 3 + 1e-9, 3 + 3e-9, 0.5], schedule) == [1, 1, 1, 1, 2, 2, 2, 2]
    assert looked_up(spark, [0.0, 5.0, 1e6], [(4, 1.0, None), (9, 0.0, None)]) == [9, 4, 4]


def test_a_stream_is_looked_up_like_a_table(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    found = intervals.resolved(plans.schedule(spark, folder))
    hours = F.unix_micros("ts") / F.lit(3.6e9)
    stream = intervals.active(event_stream(spark, folder).select("event_id", hours.alias("t")), "t", found)
    got = to_table(stream, "active_now", "append", str(tmp_path)).select("event_id", "active").collect()
    want = plans.active_weights(spark, folder).collect()
    assert len(got) == len(want) > 0 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_segments_and_obstacles_against_all_pairs(spark):
    rng = random.Random(4)
    place = lambda: [rng.uniform(-900, 900), rng.uniform(-900, 900), rng.uniform(0, 250)]
    flown = [(i, *place(), *place()) for i in range(15)] + [(90, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0)]
    stood = [(i, *place(), rng.uniform(5, 150)) for i in range(200)] + [(900, 5.0, 5.0, 105.0, 101.0)]
    flights = spark.createDataFrame(flown, "flight_id int, ax double, ay double, az double, bx double, by double, bz double")
    obstacles = spark.createDataFrame(stood, "obstacle_id int, x double, y double, z double, radius double")
    parts = spatial.segments(flights, 120.0)
    cell, margin, want = 100.0, 30.0, {}
    listed = parts.collect()
    for s in listed:
        a, b = (s["ax"], s["ay"], s["az"]), (s["bx"], s["by"], s["bz"])
        for _, *c, radius in stood:
            if all(min(p, q) - margin < (x // cell + 1) * cell and x // cell <= (max(p, q) + margin) // cell for p, q, x in zip(a, b, c, strict=True)):
                ab = [q - p for p, q in zip(a, b, strict=True)]
                square = sum(x * x for x in ab)
                t = max(0.0, min(1.0, sum((x - p) * u for x, p, u in zip(c, a, ab, strict=True)) / square)) if square else 0.5
                want.setdefault((s["flight_id"], s["seq"]), []).append((math.dist([p + t * u for p, u in zip(a, ab, strict=True)], c), radius))
    got = {(r["flight_id"], r["seq"]): (r["n_near"], r["n_blocking"], r["clearance"]) for r in spatial.blocked(parts, obstacles, cell, margin).collect()}
    assert got.keys() == want.keys() and (90, 0) in got
    for k, pairs in want.items():
        assert got[k][:2] == (len(pairs), sum(d < r for d, r in pairs)) and abs(got[k][2] - min(pairs)[0]) < 1e-9
    ends = {}
    for s in sorted(listed, key=lambda s: (s["flight_id"], s["seq"])):
        assert math.dist((s["ax"], s["ay"], s["az"]), (s["bx"], s["by"], s["bz"])) <= 120.0 + 1e-9
        ends[s["flight_id"]] = (s["bx"], s["by"], s["bz"])
    assert all(math.dist(ends[f[0]], f[4:]) < 1e-9 for f in flown)


def test_noise_counts_each_home_once(spark):
    points = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 0.0), (1, 1, 1, 10.0, 0.0, 0.0), (2, 0, 1, 5000.0, 0.0, 0.0)], "flight_id int, seq int, n int, x double, y double, z double")
    homes = spark.createDataFrame([(7, 5.0, 3.0, 0.0), (8, 300.0, 0.0, 0.0), (9, -8.0, -1.0, 4.0)], "residence_id int, x double, y double, z double")
    assert [tuple(r) for r in spatial.noise_impact(points, homes, 120.0).collect()] == [(1, 2)]


def test_hearers_are_those_of_all_way_points(spark):
    rng = random.Random(9)
    place = lambda: [rng.uniform(-2500, 2500), rng.uniform(-2500, 2500), rng.uniform(20, 60)]
    flights = spark.createDataFrame([(i, *place(), *place()) for i in range(40)] + [(90, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0)], "flight_id int, ax double, ay double, az double, bx double, by double, bz double")
    homes = spark.createDataFrame([(i, *place()) for i in range(1500)] + [(9000, 5.0, 6.0, 5.0)], "residence_id int, x double, y double, z double")
    for height in (120.0, 20.0):
        want = spatial.noise_impact(spatial.way_points(flights, 50.0), homes, height).collect()
        assert sorted(map(tuple, spatial.hearers(flights, homes, 50.0, height).collect())) == sorted(map(tuple, want)) and len(want) > 9


def test_a_segment_is_sent_once(spark):
    flights = spark.createDataFrame([(i, 0.0, 0.0, 100.0, 900.0 * i, 700.0, 30.0) for i in range(1, 9)], "flight_id int, ax double, ay double, az double, bx double, by double, bz double")
    obstacles = spark.createDataFrame([(i, 400.0 * i, 90.0 * i, 50.0, 99.0) for i in range(20)], "obstacle_id int, x double, y double, z double, radius double")
    parts = spatial.segments(flights, 500.0)
    want = sorted(map(tuple, spatial.blocked(parts, obstacles, 250.0, 100.0).collect()))
    found = spatial.blocked(parts, obstacles, 250.0, 100.0, 500.0)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 20
    pairs = spatial.nearby(parts, obstacles, 250.0, 100.0, 500.0)
    assert pairs.select("flight_id", "seq", "cx", "cy").distinct().count() == pairs.select("flight_id", "seq").distinct().count()


def _ground(spark, seed, span):
    rng = random.Random(seed)
    place = lambda: [rng.uniform(-span, span), rng.uniform(-span, span), rng.uniform(0, 250)]
    flown = [(i, *place(), *place()) for i in range(15)] + [(90, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0)] * 2 + [(91, 250.0, 0.0, 5.0, 250.0, 1000.0, 5.0)]
    stood = [(i, *place(), rng.uniform(5, 400)) for i in range(300)]
    stood += [(900, 5.0, 5.0, 105.0, 101.0), (901, 5.0, 5.0, 105.0, 100.0), (902, 250.0, 500.0, 5.0, None), (903, 450.0, 500.0, 5.0, 200.0)]
    flights = spark.createDataFrame(flown, "flight_id int, ax double, ay double, az double, bx double, by double, bz double")
    return flights, spark.createDataFrame(stood, "obstacle_id int, x double, y double, z double, radius double")


def test_tiles_give_what_the_pairs_of_segments_and_obstacles_give(spark, monkeypatch):
    for span, tile, limit in ((900, 16, 500_000), (900, 3, 7), (15000, 16, 500_000)):
        flights, stood = _ground(spark, span, span)
        monkeypatch.setattr(obstacles, "TILE", tile)
        monkeypatch.setattr(obstacles, "LIMIT", limit)
        want = sorted(map(tuple, spatial.blocked(spatial.segments(flights, 500.0), stood, 250.0, 100.0, 500.0).collect()))
        assert sorted(map(tuple, obstacles.near(flights, stood, 500.0, 250.0, 100.0).collect())) == want and len(want) > 9


def test_segment_obstacles_makes_no_row_of_a_pair(spark):
    plan = plans.segment_obstacles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "[cx" not in plan


def test_an_obstacle_wider_than_the_margin_blocks_from_beyond_it(spark, monkeypatch):
    flights = spark.createDataFrame([(1, 0.0, 10.0, 50.0, 400.0, 10.0, 50.0), (2, 0.0, 10.0, 50.0, 900.0, 10.0, 50.0)], "flight_id int, ax double, ay double, az double, bx double, by double, bz double")
    stood = spark.createDataFrame([(1, 200.0, 300.0, 50.0, 300.0), (2, 800.0, -290.0, 50.0, 300.0), (3, 800.0, 300.0, 50.0, 290.0)], "obstacle_id int, x double, y double, z double, radius double")
    assert sorted(map(tuple, obstacles.blocking(flights, stood, 500.0, 250.0).collect())) == [(1, 1), (2, 1)]  # at 290 m only 1 blocks, 2 is as far as its radius
    for span, tile, limit in ((900, 3, 7), (15000, 16, 500_000)):
        flights, stood = _ground(spark, span, span)
        monkeypatch.setattr(obstacles, "TILE", tile)
        monkeypatch.setattr(obstacles, "LIMIT", limit)
        parts = spatial.segments(flights.distinct(), 500.0).crossJoin(stood).withColumn("clearance", spatial.clearance())
        hit = parts.groupBy("flight_id", "seq").agg(F.max(F.coalesce(F.col("clearance") < F.col("radius"), F.lit(False)).cast("long")).alias("hit"))
        want = {r["flight_id"]: r["blocked"] for r in hit.groupBy("flight_id").agg(F.sum("hit").alias("blocked")).collect()}
        got = {r["flight_id"]: r["blocked"] for r in obstacles.blocking(flights, stood, 500.0, 250.0).collect()}
        assert {k: got.get(k, 0) for k in want} == want and sum(want.values()) > 9
