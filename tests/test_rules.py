"""Rules on hand-made cases with known answers, and readers and writers by round trip."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skylot.functions import extraction
from skylot.functions.scalars import noise_db
from skylot.operators import matching, metrics, ranking
from skylot.plans import space
from skylot.sources import files, sinks


def reward(spark, rows):
    df = spark.createDataFrame(rows, "w string, demand_id string, true_priority int, pred_priority int")
    return {r["w"]: r["reward"] for r in metrics.ranking_reward(df, ["w"]).collect()}


def test_ranking_reward_of_known_windows(spark):
    found = reward(spark, [("ok", "A", 1, 1), ("ok", "B", 2, 2), ("ok", "C", 4, 4), ("bad", "A", 1, 4), ("bad", "B", 2, 4), ("bad", "C", 4, 4)])
    assert found["ok"] == pytest.approx(1.0) and found["bad"] == pytest.approx(0.24375)


def test_merge_keeps_near_rules_and_takes_far_models(spark):
    rows = spark.createDataFrame([("w", 1, 1, 4), ("w", 2, 2, 3), ("w", 3, 2, 4), ("w", 4, 3, None), ("w", 5, 4, 1)], "label string, demand_id int, rule int, model int")
    out = {r["demand_id"]: (r["merged"], r["blended"], r["window_rank"]) for r in ranking.merged(rows, ["label"], "rule", "model").collect()}
    assert out == {1: (1, 88, 1), 2: (2, 76, 2), 3: (4, 68, 3), 4: (3, 40, 5), 5: (1, 52, 4)}


def test_verdicts_by_balance(spark):
    rows = spark.createDataFrame([("N", 0.5, 0.5, 10.0), ("A", 0.6, 0.5, 9.0), ("B", 0.6, 0.4, 10.0), ("C", 0.4, 0.4, 11.0)], "m string, a double, b double, late double")
    found = {r["m"]: r["overall"] for r in metrics.verdicts(rows, "m", "N", {"a": 1, "b": 1, "late": -1}).collect()}
    assert found == {"A": "post_better", "B": "mixed", "C": "pre_better"}


def test_noise_loses_a_step_with_height(spark):
    row = spark.range(1).select(noise_db(F.lit(100.0), F.lit(150.0)).alias("a"), noise_db(F.lit(0.0), F.lit(10.0)).alias("b"), noise_db(F.lit(1.0), F.lit(75.0)).alias("c")).first()
    assert row["a"] == pytest.approx(75 - 36 - 0.1 - 8) and row["b"] == 75.0 and row["c"] == pytest.approx(75 - 0.001 - 0.15 - 4)


def test_a_consumer_dialogue_is_read_by_the_rules(spark):
    said = "[10:05] Customer: I need OTC medication for a child with fever, please bring it to the community locker, within 120 min.\n[10:06] Dispatcher: noted"
    rows = [(said, "emergency_doctor", "aed", 15), ("", None, "vaccine", None), ("[09:00] ER Physician: code red, an AED within 10 min, team standing by", None, None, None)]
    a, b, c = extraction.extracted(spark.createDataFrame(rows, "conversation string, default_role string, default_cargo string, default_deadline int")).collect()
    # the first needle of the table counts: 'medication' stands before 'otc medication'
    assert (a["x_role"], a["x_cargo"], a["x_deadline"], a["x_children"], a["x_destination"]) == ("consumer", "medicine", 120, True, "residential_area")
    assert (b["x_role"], b["x_cargo"], b["x_deadline"], b["x_tier"], b["x_condition"]) == ("community_health_worker", "vaccine", 90, "regular", "Routine supply request")
    assert (c["x_role"], c["x_cargo"], c["x_deadline"], c["x_tier"], c["x_sensitivity"]) == ("emergency_doctor", "aed", 10, "life_support", "Immediate action required")
    assert c["x_readiness"].startswith("Receiver is ready")


def test_greedy_matching_against_a_loop(spark):
    draw = random.Random(8)
    make = lambda n: [(draw.choice("xy"), i, draw.choice("ab"), float(draw.randint(0, 6))) for i in range(n)]
    said, truth = make(60), make(60)
    schema = "g string, i int, item string, q double"
    found = {r["g"]: (r["tp"], r["fp"], r["fn"]) for r in matching.greedy_matches(spark.createDataFrame(said, schema), spark.createDataFrame(truth, schema), ["g"], ["item"], "q", "i", 0.3).collect()}
    for g in "xy":
        free, tp = [t for t in truth if t[0] == g], 0
        for p in (p for p in said if p[0] == g):
            hit = next((t for t in free if t[2] == p[2] and abs(p[3] - t[3]) <= 0.3 * max(t[3], 1)), None)
            if hit:
                free.remove(hit)
                tp += 1
        assert found[g] == (tp, sum(p[0] == g for p in said) - tp, len(free))


def test_pairwise_accuracy_against_all_pairs(spark):
    draw = random.Random(2)
    rows = [("w", i, draw.randint(1, 4), draw.randint(1, 4)) for i in range(80)]
    df = spark.createDataFrame(rows, "w string, demand_id int, true_priority int, pred_priority int")
    pairs = [(a, b) for a in rows for b in rows if a[1] < b[1] and a[2] != b[2]]
    for strict in (True, False):
        right = sum((a[2] < b[2]) == (a[3] < b[3]) and not (strict and a[3] == b[3]) for a, b in pairs)
        row = metrics.pairwise_accuracy(df, ["w"], strict).first()
        assert (row["correct"], row["total"]) == (right, len(pairs))


def test_nearest_in_rings_finds_far_sites_too(spark):
    draw = random.Random(3)
    sites = [(i, draw.uniform(100, 130), draw.uniform(-40, 60)) for i in range(200)] + [(200, 114.0, 22.5)]
    stations = [(i, draw.uniform(113, 115), draw.uniform(22, 23)) for i in range(40)]
    s, t = spark.createDataFrame(sites, "site_id int, lon double, lat double"), spark.createDataFrame(stations, "station_id int, lon_t double, lat_t double")
    found = {r["site_id"]: r["cm"] for r in space.nearest(s, t).collect()}
    pairs = s.crossJoin(t).select("site_id", F.floor(space.haversine_m(F.col("lon_t"), F.col("lat_t"), F.col("lon"), F.col("lat")) * 100 + 0.5).alias("cm"))
    assert found == {r["site_id"]: r["cm"] for r in pairs.groupBy("site_id").agg(F.min("cm").alias("cm")).collect()}


def test_global_ranks_against_one_sort(spark):
    draw = random.Random(9)
    rows = [(i, draw.randint(0, 50)) for i in range(500)]
    out = ranking.globally_ranked(spark.createDataFrame(rows, "i int, v int"), -F.floor(F.col("v") / 10), ("-v", "i")).collect()
    assert [(r["i"], r["v"]) for r in sorted(out, key=lambda r: r["place"])] == sorted(rows, key=lambda r: (-r[1], r[0]))


def crowd(seed):
    draw = random.Random(seed)
    some = lambda v: None if draw.random() < 0.05 else v
    return [(some(draw.choice("aaab")), some(draw.randint(0, 150)), some(draw.randint(1, 4)), some(draw.randint(-40, 40))) for _ in range(200)]


DEMANDS = "label string, demand_id long, priority int, score int"


@pytest.mark.parametrize("block", [9, 2048])
def test_pairs_of_a_window_against_a_loop(spark, block):
    rows, known = crowd(block), lambda *x: None not in x
    df = spark.createDataFrame(rows, DEMANDS)
    pairs = [(a, b) for a in rows for b in rows if known(a[0], a[2], b[2]) and a[0] == b[0]]
    key = lambda r: tuple((x is None, x) for x in r)
    prefs = [(a[0], a[1], b[1], b[2] - a[2]) for a, b in pairs if a[2] < b[2]]
    assert sorted(map(tuple, ranking.preferences(df, ["label"], block).collect()), key=key) == sorted(prefs, key=key)
    counts = {r["label"]: (r["n_pairs"], r["avg_gap"]) for r in ranking.preference_counts(df, ["label"]).collect()}
    assert counts == {w: (len(g), sum(g) / len(g)) for w in "ab" for g in [[p[3] for p in prefs if p[0] == w]]}
    ties = [(a[0], a[1], b[1], abs(a[3] - b[3])) for a, b in pairs if known(a[1], b[1], a[3], b[3]) and a[1] < b[1] and a[2] != b[2] and abs(a[3] - b[3]) <= 6]
    assert sorted(map(tuple, ranking.near_ties(df, ["label"], 6, block).collect())) == sorted(ties)


@pytest.mark.parametrize("pairs", [lambda df: ranking.preferences(df, ["label"], 50), lambda df: ranking.near_ties(df, ["label"], 6, 50)])
def test_pairs_of_one_window_go_to_several_tasks(spark, pairs):
    df = spark.createDataFrame([("w", i, i % 4 + 1, i * 7919 % 100) for i in range(2000)], DEMANDS)
    shares = [r["count"] for r in pairs(df).groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 4 and max(shares) < 0.5 * sum(shares)


def test_preferences_of_a_large_window_are_counted_without_pairs(spark):
    df = spark.range(2_000_000).select(F.lit("w").alias("label"), (F.col("id") % 4 + 1).cast("int").alias("priority"))
    assert tuple(ranking.preference_counts(df, ["label"]).first()) == ("w", 6 * 500_000 ** 2, 10 / 6)


def test_tolerant_json_of_known_answers(spark):
    said = ['{"a": 1}', '```json\n[1, 2,]\n```', 'Look: {"a": [1,],} and so on', "nothing", "", "[broken"]
    rows = files.with_json(spark.createDataFrame([(x,) for x in said[:1] + ["[1, 2,]"] + said[2:]], "x string"), "x", "body").collect()
    assert [r["body"] and json.loads(r["body"]) for r in rows] == [{"a": 1}, [1, 2], {"a": [1]}, None, None, None]


def test_records_survive_a_round_trip(spark, tmp_path):
    schema = StructType.fromDDL("time_window string, demands array<struct<demand_id:string,priority:int>>")
    rows = spark.createDataFrame([("w1", [("a", 1), ("b", 2)]), ("w2", [])], schema)
    files.write_json_lines(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, files.windows(files.json_lines(spark, str(tmp_path / "j"), schema)).collect())) == [("w1", 0, "a", 1), ("w1", 1, "b", 2)]
    files.write_parquet(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert json.loads(sinks.json_report(rows.select("time_window").orderBy("time_window"))) == [{"time_window": "w1"}, {"time_window": "w2"}]
    for run, value in (("run_1", 1), ("run_2", 2)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "summary.json").write_text(json.dumps({"v": value}))
    assert files.latest_run(spark, str(tmp_path / "runs" / "*" / "summary.json"), StructType.fromDDL("v int")).first()["v"] == 2
    sinks.csv_report(spark.createDataFrame([("a,b", None), ("ü", 2)], "x string, y int").orderBy("x"), str(tmp_path / "c.csv"))
    assert (tmp_path / "c.csv").read_bytes().decode("utf-8-sig").splitlines() == ["x,y", '"a,b",', "ü,2"]


def test_weight_files_and_per_demand_results(spark, tmp_path):
    schema = StructType.fromDDL("time_window string, v int")
    for name, value in (("a.json", 1), ("b.json", 2)):
        (tmp_path / name).write_text(json.dumps({"time_window": "w", "v": value}))
    assert [(r["time_window"], r["v"]) for r in files.weight_files(spark, str(tmp_path), schema).collect()] == [("w", 2)]
    results = spark.createDataFrame([("w", [("d", True)])], "time_window string, per_demand_results array<struct<demand_id:string,is_served:boolean>>")
    assert tuple(files.per_demand_results(results).first()) == ("w", "d", True)


def test_plans_over_model_answers_stay_short(spark):
    from skylot.plans import records as plans

    for rows in (plans.answered(spark, "/root/testdata/sf0.001").filter("body IS NOT NULL"), plans.model_rows(spark, "/root/testdata/sf0.001")):
        assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 100_000  # 2,814,772 characters where each step repeated the one before
