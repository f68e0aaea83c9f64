"""Lookup tables of demand records, and what is read from loose texts: model output, names, dates, keys."""

from __future__ import annotations

#: Fixed values of the rules.
TIER = {1: "life_support", 2: "critical", 3: "regular", 4: "consumer"}
DEADLINE = {1: 15, 2: 30, 3: 60, 4: 120}
LABELS = {"aed": "AED defibrillator", "blood_product": "blood product", "cardiac_drug": "cardiac emergency drug", "thrombolytic": "thrombolytic agent", "ventilator": "ventilator",
          "icu_drug": "ICU medication", "vaccine": "vaccine", "medicine": "medication", "protective_suit": "protective suit", "mask": "face mask",
          "disinfectant": "disinfectant solution", "food": "food/meal", "otc_drug": "OTC medication", "daily_supply": "daily supplies"}
UNITS = {"aed": "unit", "blood_product": "pack", "cardiac_drug": "dose", "thrombolytic": "dose", "ventilator": "unit", "icu_drug": "kit", "vaccine": "dose", "medicine": "box",
         "protective_suit": "set", "mask": "pack", "disinfectant": "bottle", "food": "meal", "otc_drug": "box", "daily_supply": "package"}
UNIT_KG = {"aed": 2.0, "blood_product": 0.25, "cardiac_drug": 0.05, "thrombolytic": 0.05, "ventilator": 8.0, "icu_drug": 0.1, "vaccine": 0.3, "medicine": 0.5,
           "protective_suit": 0.8, "mask": 0.05, "disinfectant": 1.0, "food": 0.5, "otc_drug": 0.1, "daily_supply": 0.3}
SCENARIOS = {(1, "aed"): "CPR is already in progress and the local AED cabinet is empty.", (1, "blood_product"): "An active transfusion case needs immediate blood product support.",
             (1, "cardiac_drug"): "The emergency cart is short on the cardiac rescue dose.", (1, "thrombolytic"): "The stroke treatment window is closing quickly.",
             (2, "ventilator"): "A critical patient needs a backup ventilator before the next procedure.", (2, "icu_drug"): "The ICU team needs a refill before the next administration round.",
             (3, "vaccine"): "The afternoon vaccination block starts soon and stock is running low.", (4, "otc_drug"): "A same-day home-care order needs symptom relief medication."}
STYLES = {"plain": "direct", "direct": "direct", "technical": "technical", "term_heavy": "technical", "colloquial": "conversational", "spoken": "conversational",
          "conversational": "conversational", "dispatch": "dispatch_brief", "dispatch_brief": "dispatch_brief", "dispatch_style": "dispatch_brief"}
#: Keys that would give a ranking's answer away.
LEAKS = ("labels", "gold_extraction", "latent_priority", "dialogue_observable_priority", "extraction_observable_priority", "extraction_observable_score",
         "extraction_observable_reasoning", "solver_useful_priority", "solver_useful_score", "solver_useful_reasoning", "priority_policy_version", "priority_labels",
         "pairwise_preferences", "critical_topk_targets", "demand_tier", "urgency")
#: Keys under which a model's rows may stand; the first that there is counts.
ROW_KEYS = ("demand_configs", "priority_labels", "ranked_demands", "demands", "labels")


def lookup(column: str, table: dict, other: str) -> str:
    """A table as an SQL expression."""
    write = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {write(k)} THEN {write(v)}" for k, v in table.items()) + f" ELSE {other} END"


def scenario(priority: str, material: str, destination: str) -> str:
    exact = " ".join(f"WHEN {priority} = {p} AND {material} = '{m}' THEN '{t}'" for (p, m), t in SCENARIOS.items())
    return (f"CASE {exact} WHEN {destination} IN ('hospital', 'clinic', 'community_health_center') THEN 'The local care team has a time-bound replenishment need.' "
            "ELSE 'The receiver requested a same-day drone delivery.' END")


def readiness(ready: str, priority: str) -> str:
    return (f"CASE WHEN {ready} AND {priority} <= 2 THEN 'Landing zone cleared; team waiting for immediate handoff' WHEN {ready} THEN 'Receiver confirmed and ready for handoff' "
            "ELSE 'Standard handoff readiness' END")


def let(value: str, body: str) -> str:
    """body, in which x stands for value: however often it names x, value is written once, so that steps on steps stay as long as
    their sum when the optimizer merges them into one expression."""
    return f"get(transform(array({value}), x -> {body}), 0)"


#: A model's answer, step by step: without its code fence, the outermost brackets' slice, without trailing commas.
UNFENCED = ["CASE WHEN contains({x}, '```json') THEN substr({x}, instr({x}, '```json') + 7) ELSE {x} END", "CASE WHEN contains({x}, '```') THEN substr({x}, 1, instr({x}, '```') - 1) ELSE {x} END", "trim({x})"]
FIRST_BRACKET = "least(CASE WHEN contains({x}, '{{') THEN instr({x}, '{{') ELSE 1000000000 END, CASE WHEN contains({x}, '[') THEN instr({x}, '[') ELSE 1000000000 END)"
LAST_BRACKET = "greatest(CASE WHEN contains({x}, '}}') THEN length({x}) - instr(reverse({x}), '}}') + 1 ELSE 0 END, CASE WHEN contains({x}, ']') THEN length({x}) - instr(reverse({x}), ']') + 1 ELSE 0 END)"
SLICED = f"CASE WHEN {LAST_BRACKET} >= {FIRST_BRACKET} THEN trim(substr({{x}}, {FIRST_BRACKET}, {LAST_BRACKET} - {FIRST_BRACKET} + 1)) END"
