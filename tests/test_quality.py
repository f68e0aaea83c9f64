"""The audit of ranking data against a loop over its windows."""

import json
import random
from collections import Counter, defaultdict

from skylot.operators import quality


def plain(lines, limit=5, urgent=2):
    counts, examples = Counter(), defaultdict(list)

    def add(issue, at, n=1):
        if n:
            counts[issue] += n
            if len(examples[issue]) < limit and (not examples[issue] or examples[issue][-1] != at):
                examples[issue].append(at)

    for source, line, text in sorted(lines):
        s, at = json.loads(text), (source, line)
        demands, labels, pairs, targets = (s.get(k, []) for k in ("demands", "priority_labels", "pairwise_preferences", "critical_topk_targets"))
        if not isinstance(demands, list):
            add("demands_not_list", at)
            continue
        if not isinstance(labels, list):
            add("priority_labels_not_list", at)
            continue
        add("pairwise_preferences_not_list", at, not isinstance(pairs, list))
        add("critical_topk_targets_not_list", at, not isinstance(targets, list))
        ids = []
        for d in demands:
            if not isinstance(d, dict):
                add("demand_not_dict", at)
                continue
            name = str(d.get("demand_id", "")).strip()
            add("missing_demand_id", at, not name)
            ids += [name] if name else []
            signals = d.get("priority_evaluation_signals")
            inner = signals if isinstance(signals, dict) else {}
            for k, v, kind in (("context_signals", d.get("context_signals"), list), ("priority_evaluation_signals", signals, dict), ("special_handling", inner.get("special_handling"), list), ("population_vulnerability", inner.get("population_vulnerability"), dict)):
                add(f"{k}_none", at, v is None)
                add(f"{k}_not_{kind.__name__}", at, v is not None and not isinstance(v, kind))
        add("duplicate_demand_id", at, len(ids) != len(set(ids)))
        known = {str(r.get("demand_id", "")).strip(): r for r in labels if str(r.get("demand_id", "")).strip()}
        add("priority_label_id_set_mismatch", at, set(known) != set(ids))
        ranks = []
        for r in labels:
            add("invalid_priority_value", at, r.get("priority") not in (1, 2, 3, 4))
            if r.get("window_rank") is None:
                add("invalid_window_rank", at)
            else:
                ranks.append(int(r["window_rank"]))
        add("window_ranks_not_contiguous", at, bool(ranks) and sorted(ranks) != list(range(1, len(labels) + 1)))
        value = lambda r: int(r["priority"]) if str(r.get("priority", "")).isdigit() else 4
        if isinstance(pairs, list):
            for p in pairs:
                h, low = (str(p.get(k, "")).strip() for k in ("higher_priority_demand_id", "lower_priority_demand_id"))
                if h not in ids or low not in ids:
                    add("pairwise_unknown_demand_id", at)
                elif h in known and low in known:
                    add("pairwise_priority_conflict", at, value(known[h]) >= value(known[low]))
                    add("pairwise_gap_mismatch", at, p.get("priority_gap") is not None and p["priority_gap"] != value(known[low]) - value(known[h]))
        if isinstance(targets, list):
            for t in targets:
                add("topk_unknown_demand_id", at, str(t) not in ids)
            add("topk_mismatch_vs_priority_labels", at, sorted(map(str, targets)) != sorted(i for i, r in known.items() if value(r) <= urgent))
        if not all(isinstance(d, dict) for d in demands):
            add("failed_to_recompute_targets", at)
            continue
        get = lambda d, k, other: d.get("labels", {}).get(f"extraction_observable_{k}", other)
        order = sorted(demands, key=lambda d: (get(d, "priority", 4), -get(d, "score", 0), str(d.get("demand_id", "")).strip()))
        want = [(str(d.get("demand_id", "")).strip(), get(d, "priority", 4)) for d in order]
        add("priority_labels_mismatch_vs_demands", at, [(str(r.get("demand_id", "")).strip(), value(r), r.get("window_rank")) for r in labels] != [(*w, i) for i, w in enumerate(want, 1)])
        if isinstance(pairs, list):
            add("pairwise_mismatch_vs_demands", at, [(str(p.get("higher_priority_demand_id", "")).strip(), str(p.get("lower_priority_demand_id", "")).strip(), p.get("priority_gap")) for p in pairs] != [
                (a, b, q - p) for i, (a, p) in enumerate(want) for b, q in want[i + 1:] if p != q])
        if isinstance(targets, list):
            add("topk_mismatch_vs_demands", at, targets != [i for i, p in want if p <= urgent])
    return counts, examples


def window(rng, faulty):
    bad = lambda: faulty and rng.random() < 0.12
    demands = []
    for i in range(rng.randrange(1, 6)):
        signals = {"special_handling": None if bad() else "cold" if bad() else [], "population_vulnerability": [] if bad() else {}}
        d = {"demand_id": f" D{i} " if bad() else "" if bad() else f"D{i - bad()}", "labels": {"extraction_observable_priority": rng.randrange(1, 5), "extraction_observable_score": rng.randrange(3)},
             "context_signals": {} if bad() else [], "priority_evaluation_signals": None if bad() else 3 if bad() else signals}
        demands.append(rng.choice([7, None, "x", ["y"]]) if bad() else d)
    get = lambda d, k: d["labels"][f"extraction_observable_{k}"]
    order = sorted((d for d in demands if isinstance(d, dict)), key=lambda d: (get(d, "priority"), -get(d, "score"), d["demand_id"].strip()))
    rows = [(d["demand_id"].strip(), get(d, "priority")) for d in order]
    s = {"time_window": "w", "demands": demands,
         "priority_labels": [{"demand_id": "ghost" if bad() else i, "priority": 9 if bad() else "2" if bad() else p, "window_rank": None if bad() else at + bad()} for at, (i, p) in enumerate(rows, 1)],
         "pairwise_preferences": [{"higher_priority_demand_id": "ghost" if bad() else a, "lower_priority_demand_id": a if bad() else b, "priority_gap": None if bad() else q - p + bad()} for i, (a, p) in enumerate(rows) for b, q in rows[i + 1:] if p != q],
         "critical_topk_targets": [i for i, p in rows if p <= 2 and not bad()] + ["ghost"] * bad()}
    for k in ("demands", "priority_labels", "pairwise_preferences", "critical_topk_targets"):
        if faulty and rng.random() < 0.06:
            s[k] = rng.choice(["[text", None, 4, {}])
        elif faulty and rng.random() < 0.03:
            del s[k]
    return json.dumps(s)


def test_counts_and_first_examples_of_each_fault(spark):
    rng = random.Random(11)
    lines = [(f"seed{i % 7}", i, window(rng, i % 3 > 0)) for i in range(600)]
    counts, examples = plain(lines)
    got = quality.audited(spark.createDataFrame(lines, "source string, line long, value string").repartition(9)).collect()
    assert {r["issue"]: r["n"] for r in got} == dict(counts)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["place"]):
        found[r["issue"]].append((r["source"], r["line"]))
    assert found == examples and set(quality.ISSUES) <= set(counts)


def test_sound_windows_have_no_faults(spark):
    lines = [("s", i, window(random.Random(i), False)) for i in range(40)]
    assert quality.audited(spark.createDataFrame(lines, "source string, line long, value string")).count() == 0
    assert quality.audited(spark.createDataFrame([], "source string, line long, value string")).count() == 0


def test_pairs_of_a_large_window_are_not_made(spark):
    """3,000 demands have 4.5 million pairs, of which the window lists none: their number alone tells."""
    import json

    from skylot.operators import quality

    demands = [{"demand_id": f"D{i}", "labels": {"extraction_observable_priority": 1 + i % 4, "extraction_observable_score": i}} for i in range(3000)]
    labels = [{"demand_id": f"D{i}", "priority": 1 + i % 4, "window_rank": 1} for i in range(3000)]
    text = json.dumps({"time_window": "w", "demands": demands, "priority_labels": labels, "pairwise_preferences": [], "critical_topk_targets": []})
    rows = quality.faults(quality.windows(spark.createDataFrame([("a", 1, text)], "source string, line long, value string")))
    found = {r["issue"]: r["example"] for r in rows.collect()}
    assert found["pairwise_mismatch_vs_demands"] == f"0:{6 * 750 * 750}"
