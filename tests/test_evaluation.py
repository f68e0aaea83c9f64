"""Alignment, extraction metrics and gates against plain loops and hand-made cases."""

import random

import pytest

from skylot.operators import evaluation


def frames(spark, weights, demands, dialogues, truth, fixed):
    return (spark.createDataFrame(weights, "time_window string, demand_id string, priority int"),
            spark.createDataFrame(demands, "time_window string, demand_id string, source_event_id string, source_dialogue_id string, observable int"),
            spark.createDataFrame(dialogues, "dialogue_id string, event_id string"), spark.createDataFrame(truth, "event_id string, latent int"),
            spark.createDataFrame(fixed, "time_window string, demand_id string, observable int"))


@pytest.mark.parametrize("source", evaluation.SOURCES)
def test_each_source_of_truth(spark, source):
    rng = random.Random(5)
    names = [(f"w{i % 4}", f"d{i}") for i in range(40)]
    demands = [(w, i, rng.choice([None, " ", "e1", "e2", "e9", " e3 "]), rng.choice(["", "x1", "x2", "x9", None]), rng.choice([None, 1, 2])) for w, i in names if rng.random() < 0.8]
    weights = [(*rng.choice(names), rng.choice([None, 1, 2, 3])) for _ in range(120)] + [("w9", "d1", 2)]
    dialogues, truth = [("x1", "e2"), ("x2", " "), ("x3", "e1")], [("e1", 3), ("e2", 4), ("e3", 1)]
    fixed = [(w, i, rng.choice([None, 3, 4])) for w, i in names if rng.random() < 0.6]
    own, pinned, told, latent = {d[:2]: d for d in demands}, {f[:2]: f[2] for f in fixed}, dict(dialogues), dict(truth)
    want = []
    for w, i, p in weights:
        d = own.get((w, i))
        if d is None:
            continue
        event = (d[2] or "").strip() or (told.get((d[3] or "").strip()) or "").strip()
        true = {"auto": d[4], "run_extracted": d[4], "fixed_demands": pinned.get((w, i)), "ground_truth_manifest": None}[source]
        true = latent.get(event) if true is None else true
        if event and true is not None:
            want.append((w, i, event, true, 4 if p is None else p))
    got = [tuple(r) for r in evaluation.aligned(*frames(spark, weights, demands, dialogues, truth, fixed)[:4], source, frames(spark, weights, demands, dialogues, truth, fixed)[4]).collect()]
    assert sorted(got) == sorted(want) and want


def test_unknown_sources_are_refused(spark):
    empty = frames(spark, [], [], [], [], [])
    with pytest.raises(ValueError):
        evaluation.aligned(*empty[:4], "guess")
    with pytest.raises(ValueError):
        evaluation.aligned(*empty[:4], "fixed_demands")


def plain_matches(said, dialogues, truth, slots):
    known = {t[0]: t[1:] for t in truth}
    told = {d: e for d, e, slot in dialogues if slot in slots and d.strip() and e in known}
    wanted, taken, out = set(told.values()), set(), []
    for place, event, dialogue, origin, destination, weight in sorted(said):
        event = (event or "").strip() or told.get((dialogue or "").strip())
        kind = "unresolved" if not event else "out_of_scope" if event not in wanted else "duplicate" if event in taken else "tp"
        hits = (False,) * 3
        if kind == "tp":
            taken.add(event)
            o, t, w = known[event]
            hits = (origin == o, destination == t, weight is not None and abs(weight - w) <= 1e-6)
        out.append((place, kind, *hits))
    return out, len(wanted)


def test_extractions_against_the_loop(spark):
    rng = random.Random(2)
    for n in (0, 3, 200):
        truth = [(f"e{i}", f"o{i % 3}", f"t{i % 2}", i / 2) for i in range(20)]
        dialogues = [(f"x{i}", f"e{rng.randrange(25)}", rng.randrange(4)) for i in range(30)]
        said = [(i, rng.choice([None, " ", f"e{rng.randrange(30)}"]), rng.choice([None, f"x{rng.randrange(40)}"]), f"o{rng.randrange(3)}", f"t{rng.randrange(2)}", rng.choice([None, rng.randrange(40) / 2])) for i in range(n)]
        found = evaluation.matched(spark.createDataFrame(said, "place int, source_event_id string, source_dialogue_id string, origin string, destination string, weight double"),
                                   spark.createDataFrame(dialogues, "dialogue_id string, event_id string, slot int"), spark.createDataFrame(truth, "event_id string, origin string, destination string, weight double"), [1, 2])
        want, n_true = plain_matches(said, dialogues, truth, {1, 2})
        assert sorted((r["place"], r["match"], r["origin_hit"], r["destination_hit"], r["weight_hit"]) for r in found[0].collect()) == want
        row = evaluation.extraction_summary(found).first()
        tp = sum(w[1] == "tp" for w in want)
        assert (row["n_true"], row["tp"], row["fp"], row["fn"]) == (n_true, tp, n - tp, n_true - tp)
        assert row["unresolved"] == sum(w[1] == "unresolved" for w in want) and row["duplicates"] == sum(w[1] == "duplicate" for w in want)
        if tp:
            precision, recall = tp / n, tp / n_true
            assert abs(row["f1"] - 2 * precision * recall / (precision + recall)) < 1e-9 and abs(row["exact_rate"] - sum(all(w[2:]) for w in want) / tp) < 1e-9
        else:
            assert row["exact_rate"] is None and row["precision"] is (None if n == 0 else row["precision"])


def gates(spark, dialogues, roles, hard):
    return evaluation.gate_checks(spark.createDataFrame(dialogues, "priority int, passed boolean, needed array<string>, missing array<string>"),
                                  spark.createDataFrame(roles, "expected string, observed string"), spark.createDataFrame([(h,) for h in hard], "name string"))


def test_gates_of_known_shards(spark):
    need = ["scenario_context"]
    good = [(1, True, need, [])] * 9 + [(1, False, need, need)] + [(4, True, need, [])] * 30
    hard = ["w::surface_contradiction_1"] * 3 + ["w::near_tie_2"] * 3 + ["w::counterfactual"] * 9
    checks = gates(spark, good, [("icu_nurse", " ICU nurse ")] * 19 + [("icu_nurse", "")], hard)
    found = {r["gate"]: r for r in checks.collect()}
    assert found["audit_pass_rate"]["value"] == 0.975 and found["priority_1_audit_pass_rate"]["value"] == 0.9 and found["priority_gap_vs_p4"]["value"] == 0.1
    assert found["priority_2_audit_pass_rate"]["skipped"] and found["priority_2_audit_pass_rate"]["passed"] and all(r["passed"] for r in found.values())
    assert (found["requester_role_missing_rate"]["value"], found["requester_role_match_rate"]["value"], found["near_tie_ratio"]["value"]) == (0.05, 0.95, 0.2)
    windows = spark.createDataFrame([("w",)], "w string")
    assert tuple(evaluation.release(checks, windows).first()) == ("accepted", "llm3_sft_clean,llm2_sft,llm3_sft_pipeline,llm3_grpo_hard", "")
    assert evaluation.release(checks, windows.limit(0)).first()["status"] == "debug_only"
    few = gates(spark, good, [("a", "a")], hard[:5])
    assert tuple(evaluation.release(few, windows).first()) == ("needs_regen", "llm3_sft_clean,llm2_sft,llm3_sft_pipeline", "near_tie_count")
    bad = gates(spark, [(1, False, need, need), (2, True, [], []), (4, True, [], [])], [("a", "b")], hard)
    row = evaluation.release(bad, windows).first()
    assert row["files"] == "llm3_sft_clean" and row["failed"] == "audit_pass_rate,priority_1_audit_pass_rate,priority_gap_vs_p4,requester_role_match_rate,scenario_context_missing_rate"
    assert {r["gate"]: r["value"] for r in gates(spark, [], [], []).collect()}["audit_pass_rate"] == 0.0


EDITED = "demand_id int, deadline int, hard boolean, role string, handling string, ready boolean, vulnerable boolean, children boolean, elderly boolean, destination string"


def test_edits_apply_where_they_change_something(spark):
    rows = [(1, None, False, "consumer", None, True, False, False, False, "office"), (2, 15, True, "emergency_doctor", "cold_chain", False, True, False, False, "clinic"), (3, 0, False, "icu_nurse", "shock_protection", None, None, True, False, None)]
    found = {(r["demand_id"], r["variant"]): r for r in evaluation.edited(spark.createDataFrame(rows, EDITED)).collect()}
    assert {v for i, v in found if i == 1} == {"deadline15", "emergency_role", "cold_chain", "not_ready", "vulnerable", "clinic"} and not [1 for i, _ in found if i == 2]
    assert {v for i, v in found if i == 3} == {"deadline15", "emergency_role", "cold_chain", "vulnerable", "clinic"}
    one = found[1, "deadline15"]
    assert (one["deadline"], one["hard"], one["role"], one["handling"], one["destination"]) == (15, True, "consumer", None, "office")
    assert found[1, "vulnerable"]["elderly"] and found[1, "cold_chain"]["handling"] == "cold_chain" and found[1, "not_ready"]["ready"] is False


def test_extractions_without_an_event_are_spread(spark):
    """All that the joins by event shuffle goes by a second key too, by which rows without an event part."""
    import re

    from skylot.plans import evaluation as plans

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.event_extraction(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [x for x in re.findall(r"SortMergeJoin \[([^\]]*)\][^\n]*LeftOuter", plan) if "event_id" in x]
    assert len(joins) == 2 and all("_spread" in x for x in joins)
