"""Rules, routing, streams and readers on small inputs with known results."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skylot.functions.scalars import window_label
from skylot.operators import pareto
from skylot.plans import space
from skylot.plans.streams import stream_window_counts
from skylot.sources import files, lens, sinks
from skylot.streaming import windows

SF = "/root/testdata/sf0.001"
DEMAND = ("id int, tier string, deadline int, hard boolean, cargo string, text string, role string, children boolean, elderly boolean, "
          "vulnerable boolean, handling string, destination string, ready boolean")


def test_scores_of_known_demands(spark):
    rows = [(1, "consumer", 90, False, "otc_drug", "child with fever", "consumer", True, False, False, None, "residential_area", None),
            (2, "critical", 20, True, "ventilator", "icu ventilator needed", "icu_nurse", False, False, False, "shock_protection", "hospital", None)]
    found = {r["id"]: (r["score"], r["priority"]) for r in lens.scored(spark.createDataFrame(rows, DEMAND)).collect()}
    assert found[1][1] == 3 and found[2][1] == 2 and found[2][0] > found[1][0]


def test_windows_count_from_midnight(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-05 00:08:00' AS a, TIMESTAMP_NTZ '2024-01-05 23:59:59' AS b")
    row = rows.select(window_label(F.col("a"), 7), window_label(F.col("b"), 5), window_label(F.col("b"), 7)).first()
    assert tuple(row) == ("2024-01-05T00:07-00:14", "2024-01-05T23:55-24:00", "2024-01-05T23:55-24:00")


def test_frontier_against_all_pairs(spark):
    draw = random.Random(4)
    points = [(i, *(float(draw.randrange(12)) for _ in range(3))) for i in range(300)] + [(300, None, 0.0, 0.0)]

    def dominated(p):
        return None not in p and any(None not in q and all(x <= y for x, y in zip(q[1:], p[1:])) and q[1:] != p[1:] for q in points)

    rows = pareto.frontier(spark.createDataFrame(points, "i int, a double, b double, c double"), ("a", "b", "c"))
    assert sorted(r["i"] for r in rows.collect()) == [p[0] for p in points if not dominated(p)]


def test_stream_gives_the_batch_counts(spark, tmp_path):
    stream = windows.tumbling(windows.event_stream(spark, SF), late="0 seconds")
    got = windows.to_table(stream, "tumbled", "complete", str(tmp_path / "a"))
    batch = stream_window_counts(spark, SF)
    assert {(str(r["start"]), r["event_type"], r["n"]) for r in got.collect()} == {(r["start"], r["event_type"], r["n"]) for r in batch.collect()}


def test_fleet_state_counts_trips(spark, tmp_path):
    events = windows.event_stream(spark, SF)
    got = windows.to_table(windows.fleet(events), "fleet_state", "update", str(tmp_path / "b")).groupBy("user_id").agg(F.max("trips").alias("trips"))
    counts = {r["user_id"]: r["count"] for r in lens.table(spark, SF, "events").groupBy("user_id").count().collect()}
    assert {r["user_id"]: r["trips"] for r in got.collect()} == {u: n // 4 for u, n in counts.items()}


def test_readers(spark, tmp_path):
    record = StructType.fromDDL("event_id string, time_slot int")
    rows = [{"event_id": "a", "time_slot": 1}, {"event_id": "b", "time_slot": None}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "x.json").write_text(json.dumps(rows))
    (tmp_path / "y.json").write_text(json.dumps({"event_manifest": rows}))
    for name in ("x.jsonl", "x.json", "y.json"):
        assert sorted(map(tuple, files.event_manifest(spark, str(tmp_path / name), record).collect())) == [("a", 1), ("b", None)]
    with pytest.raises(ValueError):
        files.event_manifest(spark, "x.txt", record)
    (tmp_path / "bad.jsonl").write_text('{"event_id": "a", "time_slot": 1}\n{oops\n')
    assert files.json_lines(spark, str(tmp_path / "bad.jsonl"), record, strict=False).cache().filter("_corrupt_record IS NOT NULL").count() == 1
    table = spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b")
    assert sinks.markdown(table).splitlines() == ["| a | b |", "|---|---|", "| 1 |  |"]
    for report in (sinks.markdown, sinks.json_report):
        with pytest.raises(ValueError):
            report(spark.range(4), limit=3)


def test_rings_of_cells_do_not_grow_the_plan(spark):
    """Places round the world need many rings; each reads what the one before left."""
    draw = random.Random(1)
    s = spark.createDataFrame([(i, draw.uniform(-170, 170), draw.uniform(-70, 70)) for i in range(60)], "site_id int, lon double, lat double")
    t = spark.createDataFrame([(i, draw.uniform(-170, 170), draw.uniform(-70, 70)) for i in range(8)], "station_id int, lon_t double, lat_t double")
    found = space.nearest(s, t)
    assert found.count() == 60 and len(found.inputFiles()) < 200 and found._jdf.queryExecution().toString().count("Relation") < 80


def test_fronts_that_do_not_shrink(spark):
    """All on one front, over many partitions, and few rows a task."""
    rows = [(i, float(i), float(400 - i)) for i in range(400)] + [(500, 200.0, 201.0)]
    found = pareto.frontier(spark.createDataFrame(rows, "i int, a double, b double").repartition(40), ("a", "b"))
    assert sorted(r["i"] for r in found.collect()) == list(range(400))


def test_places_within_a_distance_against_all_pairs(spark):
    from skylot.functions.scalars import haversine_m
    spot = lambda i, a, b: (i, 113.8 + i * a % 997 / 997 * 0.06, 22.4 + i * b % 991 / 991 * 0.06)
    s = spark.createDataFrame([spot(i, 71, 113) for i in range(700)], "site_id int, lon double, lat double")
    t = spark.createDataFrame([spot(i, 37, 59) for i in range(90)], "station_id int, lon_t double, lat_t double")
    for metres, parts in ((2000.0, 2), (1000.0, 4)):
        cm = F.floor(haversine_m(F.col("lon_t"), F.col("lat_t"), F.col("lon"), F.col("lat")) * 100 + 0.5)
        want = s.crossJoin(t).filter(cm <= metres * 100).select("site_id", "station_id").collect()
        assert sorted(map(tuple, space.within(s, t, metres, parts).select("site_id", "station_id").collect())) == sorted(map(tuple, want)) and len(want) > 500


def test_pairs_of_a_radius_are_counted_where_they_are_made(spark):
    plan = space.radius_impact(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "keys=[station_id" in plan and not any("station_id" in k and "site_id" in k for k in re.findall(r"hashpartitioning\(([^)]*)\)", plan))


def test_of_stations_at_one_place_the_first_is_nearest(spark):
    s = spark.createDataFrame([(i, 113.8 + i * 0.01, 22.4) for i in range(30)], "site_id int, lon double, lat double")
    t = spark.createDataFrame([(i, 113.8 + i % 5 * 0.05, 22.4) for i in range(50)], "station_id int, lon_t double, lat_t double")
    found = {r["site_id"]: (r["station_id"], r["cm"]) for r in space.nearest(s, t).collect()}
    assert len(found) == 30 and {i: found[i] for i in (0, 5, 20)} == {0: (0, 0), 5: (1, 0), 20: (4, 0)} and found[29][0] == 4
