"""What dialogues mention, against a plain version; nested records against walks over values."""

import itertools
import random
import re

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from skylot.functions import extraction, nested, records
from skylot.operators import factors
from skylot.plans.audits import constraints

DEMAND = "id int, conversation string, text string, deadline int, role string, handling array<string>, ready boolean, destination string, children boolean, elderly boolean, vulnerable boolean, tier string, hard boolean"


def specs(r):
    told = (r["text"] or "").strip().lower()
    words = [told] if told else []
    words += [c for c in (x.strip(" .,:;") for x in re.split(r"[.;]| and | before | while ", told)) if c] if told else []
    words += [t for t in re.findall(r"[a-z0-9_]+", told) if len(t) >= 6 and t not in factors.STOP_WORDS]
    must = {"scenario_context": [*words, "cpr", "cardiac arrest", "transfusion", "stroke", "backup ventilator", "vaccination", "same-day"],
            "deadline_minutes": [f"{r['deadline']} min", f"{r['deadline']}-minute", f"within {r['deadline']} minutes"], "requester_role": [r["role"].replace("_", " ")]}
    if r["handling"]:
        must["special_handling"] = [*r["handling"], "cold-chain", "shock-proof", "insulated"]
    if r["ready"]:
        must["receiver_ready"] = ["landing zone", "standing by", "ready for handoff", "team waiting"]
    may = {"destination_type": [r["destination"].replace("_", " "), "receiving point"]}
    if r["children"] or r["elderly"]:
        may["population_vulnerability"] = ["child", "children", "elderly", "senior", "vulnerable community"]
    return must, may


def plain(r):
    must, may = specs(r)
    said = " ".join((r["conversation"] or "").lower().split())
    seen = [n for n, words in (must | may).items() if any(w in said for w in words)]
    missing = [n for n in must if n not in seen]
    optional = sum(n in seen for n in may)
    return seen, missing, round(min(1.0, (len(must) - len(missing) + 0.5 * optional) / max(len(must) + max(len(may), 1) * 0.5, 1.0)), 4)


def some(n=300):
    rng = random.Random(3)
    says = ["[10:00] ER Physician: CPR is under way.", "within 15  minutes", "30-minute slot", "the Landing\nZone is clear", "Receiving POINT is the clinic", "an elderly man", "keep it insulated",
            "emergency doctor here", "cold-chain", "transfusion and plasma", "a child", "nothing", "the local AED cabinet is empty"]
    texts = ["CPR is already in progress and the local AED cabinet is empty.", "", None, "An active transfusion case; needs plasma before noon", "routine refill", "  Icu. "]
    return [(i, " ".join(rng.sample(says, rng.randrange(8))) or None, rng.choice(texts), rng.choice([15, 30, 120]), rng.choice(["emergency_doctor", "consumer"]),
             rng.choice([[], ["cold_chain"], ["shock_protection", "cold_chain"]]), rng.random() < 0.5, rng.choice(["clinic", "residential_area"]), rng.random() < 0.3, rng.random() < 0.3, rng.random() < 0.3,
             rng.choice(["consumer", "critical"]), rng.random() < 0.5) for i in range(n)]


def test_audits_of_dialogues(spark):
    rows = spark.createDataFrame(some(), DEMAND)
    for r in factors.audited(rows).collect():
        assert (r["observed"], r["missing"], r["observability"]) == plain(r.asDict()), r


def test_masks_leave_only_what_is_observed(spark):
    known = {r["id"]: r for r in spark.createDataFrame(some(), DEMAND).collect()}
    for m in factors.masked(factors.audited(spark.createDataFrame(some(), DEMAND))).collect():
        r, seen = known[m["id"]], set(m["observed"])
        assert m["deadline"] == (r["deadline"] if "deadline_minutes" in seen else max(120, r["deadline"] or 120))
        assert m["hard"] == ("deadline_minutes" in seen and r["hard"]) and m["ready"] == ("receiver_ready" in seen and r["ready"])
        assert m["text"] == (r["text"] if "scenario_context" in seen else "Routine supply request")
        assert m["role"] == (r["role"] if "requester_role" in seen else "consumer" if r["tier"] == "consumer" else "community_health_worker")
        assert m["handling"] == (r["handling"] if "special_handling" in seen else [])
        assert (m["children"], m["elderly"], m["vulnerable"]) == ((r["children"], r["elderly"], r["vulnerable"]) if "population_vulnerability" in seen else (False,) * 3)


def test_known_scenario_words(spark):
    rows = spark.createDataFrame([("The ICU team needs a refill before the next administration round.",), ("",), (None,)], "t string")
    first, *none = [r[0] for r in rows.select(factors.scenario_keywords(F.col("t"))).collect()]
    assert first == ["the icu team needs a refill before the next administration round.", "the icu team needs a refill", "the next administration round", "refill", "administration"]
    assert none == [[], []]


def test_first_speaker_is_read_line_by_line(spark):
    said = ["[10:00] (line noise)\n[10:01] Paramedic: cardiac arrest", "hello\n  [09:30]  ER Physician : send it", "[1:00] Nurse: no", "[10:00] Volunteer\nPharmacist: x", None, "[10:00] Customer: a\n[10:01] Paramedic: b"]
    rows = spark.createDataFrame([(i, s, None, None, None) for i, s in enumerate(said)], "i int, conversation string, default_role string, default_cargo string, default_deadline int")
    assert [r["speaker"] for r in extraction.extracted(rows).orderBy("i").collect()] == ["paramedic", "er physician", "", "", "", "customer"]


def test_constraints_are_made_once(spark):
    rows = [("w", 1, "near the school", "P1", 5, 6, "cold_chain"), ("w", 2, "a kindergarten and a school", "P1", 5, 6, None), ("w", 3, "office", "P2", 1, 1, "shock_protection"), ("v", 4, "school", "P1", 5, 6, None)]
    found = constraints(spark.createDataFrame(rows, "label string, demand_id long, evidence string, fid string, x_mm long, y_mm long, handling string"))
    assert found.count() == 4
    assert sorted((r["label"], r["kind"], r["radius_m"] or 0) for r in found.distinct().collect()) == [("v", "noise_avoidance", 300), ("w", "noise_avoidance", 300), ("w", "speed_override", 0)]


NESTED = """labels string, a struct<urgency:int, b:array<struct<c:struct<latent_priority:int, d:map<string,struct<labels:int, e:int>>>, only:struct<labels:int>>>, x:int>,
            m map<string,int>, `odd.name` struct<labels:int, k:int>, gone struct<urgency:int>, gone_list array<struct<labels:int>>"""


def walked(value, kind):
    if isinstance(kind, StructType):
        out = {}
        for f in kind.fields:
            kept = nested.pruned(f.dataType, frozenset(records.LEAKS))
            if f.name not in records.LEAKS and kept is not None:
                out[f.name] = None if value[f.name] is None else walked(value[f.name], f.dataType)
        return out
    if isinstance(kind, ArrayType):
        return [None if v is None else walked(v, kind.elementType) for v in value]
    if isinstance(value, dict):
        return {k: None if v is None else walked(v, kind.valueType) for k, v in value.items() if k not in records.LEAKS}
    return value


def test_fields_and_keys_go_at_any_depth(spark):
    rows = [("x", (1, [((2, {"k": (3, 4), "urgency": (5, 6), "n": None}), (7,)), None, (None, None)], 8), {"labels": 1, "z": 2}, (1, 2), (3,), [(4,)]), (None, None, None, None, None, None), ("y", (1, None, None), {}, (None, None), None, [])]
    df = spark.createDataFrame(rows, NESTED)
    found = nested.sanitized(df, records.LEAKS)
    assert found.columns == ["a", "m", "odd.name"]
    assert [r.asDict(True) for r in found.collect()] == [walked(r, df.schema) for r in df.collect()]
    assert found.schema["a"].dataType.simpleString() == "struct<b:array<struct<c:struct<d:map<string,struct<e:int>>>>>,x:int>"


def test_records_are_laid_over_one_another(spark):
    schema = "rules struct<id:string, tier:string, cargo:struct<type:string, cold:boolean>, signals:array<string>>, model struct<id:string, tier:string, cargo:struct<cold:boolean, note:string>, signals:array<string>>"
    tiers, cargos, lists = [None, " ", "high"], [None, (None, "n"), (True, None)], [None, [], ["b", "a", "b"]]
    rows = [(("r", "low", ("aed", False), ["a", "c"]), ("m", t, c, s)) for t, c, s in itertools.product(tiers, cargos, lists)]
    df = spark.createDataFrame(rows, schema)
    got = df.select("model", *nested.merged(df, "model", "rules", prefer=("tier",), overlay=("cargo",), unite=("signals",), keep=("id",))).collect()
    for r in got:
        t, c, s = r["model"]["tier"], r["model"]["cargo"], r["model"]["signals"] or []
        assert r["id"] == "r" and r["tier"] == ("high" if t == "high" else "low")
        assert r["cargo"].asDict() == {"type": "aed", "cold": True if c and c["cold"] else False, "note": c["note"] if c else None}
        assert r["signals"] == ["a", "c"] + (["b"] if s else [])
