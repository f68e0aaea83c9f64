"""Reading demands from dialogue texts by rules, as SQL expressions over a text column.

Both engines read the same expressions; what differs is how a backslash is written (see spark()).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rules, in their order: of several that stand in a text the first counts.
CARGO = {"aed defibrillator": "aed", "aed": "aed", "blood product": "blood_product", "cardiac emergency drug": "cardiac_drug",
         "thrombolytic agent": "thrombolytic", "ventilator": "ventilator", "icu medication": "icu_drug", "vaccine": "vaccine",
         "medication": "medicine", "medicine": "medicine", "protective suit": "protective_suit", "face mask": "mask", "mask": "mask",
         "disinfectant solution": "disinfectant", "disinfectant": "disinfectant", "food/meal": "food", "meal": "food",
         "otc medication": "otc_drug", "daily supplies": "daily_supply"}
ROLES = {"er physician": "emergency_doctor", "emergency": "emergency_doctor", "paramedic": "paramedic", "triage nurse": "triage_nurse",
         "icu nurse": "icu_nurse", "clinical pharmacist": "clinical_pharmacist", "ward coordinator": "ward_coordinator",
         "community health worker": "community_health_worker", "clinic manager": "clinic_manager", "pharmacy staff": "pharmacy_staff",
         "customer": "consumer", "family caregiver": "family_caregiver", "office administrator": "office_administrator", "user": "consumer"}
EXTREME = ("code red", "cardiac arrest", "cpr", "resuscitation", "life-threatening", "immediate support", "golden rescue window", "stroke window", "active transfusion")
CRITICAL = ("urgent", "icu", "critical clinical", "post-exposure", "biomedical", "serious", "backup unit")
CHILDREN = ("child", "children", "pediatric", "infant", "school")
ELDERLY = ("elderly", "senior", "older", "72-year-old", "80-year-old", "grandparent")
READY = ("landing zone", "standing by", "ready for handoff", "receive the payload", "receive it at", "sign for it", "notification")
COLD, SHOCK = ("cold-chain", "insulated", "temperature", "vaccine box"), ("shock-proof", "reinforced brackets", "secure the unit")
LIFE_CARGO, CRITICAL_CARGO, TEMPERATURE_CARGO = ("aed", "blood_product", "cardiac_drug", "thrombolytic"), ("ventilator", "icu_drug"), ("vaccine", "blood_product", "thrombolytic")
PRIVATE_ROLES = ("consumer", "family_caregiver", "office_administrator")


def _has(text: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


def _in(column: str, names: tuple[str, ...]) -> str:
    return f"{column} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def _first(text: str, table: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{k}') THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


NORMAL = r"trim(lower(regexp_replace(conversation, '[ \n\t\r]+', ' '{all})))"
FIRST_ROLE = r"lower(trim(regexp_extract(conversation, '(?:^|[\n\r])[ \t]*\[[0-9][0-9]:[0-9][0-9]\][ \t]*([^:\n\r]+):', 1)))"
_MINUTES = [r"(?:eta|arrival(?:\s+within)?|within|under|in)\s*(?:about\s*)?(?:<=\s*)?([0-9]{1,3})\s*min", r"([0-9]{1,3})\s*minutes?"]
DEADLINE = "greatest(5, least(240, coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract(said, '{p}', 1), '') AS INT)" for p in _MINUTES) + ", coalesce(nullif(default_deadline, 0), 90))))"

#: Steps of the extraction: each may use the columns of those before it.
STEPS: list[dict[str, str]] = [
    {"said": NORMAL, "speaker": FIRST_ROLE},
    {"x_role": _first("speaker", ROLES, "coalesce(default_role, 'community_health_worker')"), "x_cargo": _first("said", CARGO, "coalesce(default_cargo, 'medicine')"), "x_deadline": DEADLINE,
     "x_children": _has("said", CHILDREN), "x_elderly": _has("said", ELDERLY),
     "x_readiness": f"CASE WHEN {_has('said', READY)} THEN 'Receiver is ready and handoff can happen immediately' ELSE 'Standard handoff readiness' END",
     "x_handling": f"concat_ws(', ', CASE WHEN {_has('said', COLD)} THEN 'cold_chain' END, CASE WHEN {_has('said', SHOCK)} THEN 'shock_protection' END)"},
    {"x_temperature": _in("x_cargo", TEMPERATURE_CARGO), "x_vulnerable": "(x_children OR x_elderly)",
     "x_condition": f"""CASE WHEN {_has('said', EXTREME)} THEN CASE WHEN {_has('said', ('cpr', 'cardiac arrest'))} THEN 'Cardiac arrest response in progress'
       WHEN contains(said, 'stroke window') THEN 'Acute stroke treatment window is closing' ELSE 'Life-threatening condition with immediate intervention needed' END
     WHEN {_has('said', CRITICAL)} THEN CASE WHEN x_cargo = 'ventilator' THEN 'Respiratory support risk; backup ventilator needed'
       WHEN contains(said, 'post-exposure') THEN 'Post-exposure prophylaxis window is narrow' ELSE 'Serious clinical condition requiring urgent support' END
     WHEN x_cargo = 'otc_drug' AND contains(said, 'fever') THEN 'Home symptom relief request with elevated urgency' ELSE 'Routine supply request' END""",
     "x_tier": f"""CASE WHEN {_in('x_cargo', LIFE_CARGO)} OR {_has('said', EXTREME)} THEN 'life_support' WHEN {_in('x_cargo', CRITICAL_CARGO)} THEN 'critical'
     WHEN {_has('said', CRITICAL)} OR x_deadline <= 30 THEN 'critical'
     WHEN {_in('x_role', PRIVATE_ROLES)} OR contains(said, 'locker') THEN CASE WHEN x_cargo = 'otc_drug' AND {_has('said', ('fever', 'pain spike', 'child'))} THEN 'regular' ELSE 'consumer' END
     WHEN {_in('x_cargo', ('food', 'daily_supply', 'otc_drug'))} THEN 'consumer' ELSE 'regular' END""",
     "x_destination": f"""CASE WHEN {_has('said', ('icu', 'er ', 'emergency', 'ward', 'hospital'))} THEN 'hospital' WHEN {_has('said', ('clinic', 'community health', 'vaccination'))} THEN 'clinic'
     WHEN contains(said, 'pharmacy') THEN 'pharmacy' WHEN {_in('x_role', PRIVATE_ROLES)} THEN CASE WHEN contains(said, 'office') THEN 'office' ELSE 'residential_area' END ELSE 'public_space' END"""},
    {"x_facility": """CASE WHEN contains(said, 'school') THEN 'school' WHEN contains(said, 'community locker') OR x_destination = 'residential_area' THEN 'residential_area'
     WHEN x_destination IN ('hospital', 'clinic', 'pharmacy') THEN x_destination END""",
     "x_sensitivity": """CASE WHEN x_deadline <= 15 OR x_tier = 'life_support' THEN 'Immediate action required' WHEN x_deadline <= 30 OR x_tier = 'critical' THEN 'Urgent same-window delivery required'
     WHEN x_deadline <= 90 THEN 'Timely delivery needed within the service window' ELSE 'Flexible same-day delivery' END""",
     "x_signals": """concat_ws('; ', concat('Tier inferred from dialogue: ', x_tier), concat('Patient or service context: ', x_condition),
     concat('Delivery target mentioned in dialogue: ', CAST(x_deadline AS STRING), ' min'), concat('Requester role inferred from dialogue: ', x_role), x_readiness,
     CASE WHEN x_handling <> '' THEN concat('Special handling: ', x_handling) END, CASE WHEN x_children THEN 'Children are explicitly mentioned in the dialogue' END,
     CASE WHEN x_elderly THEN 'An elderly beneficiary is explicitly mentioned in the dialogue' END)"""},
]
COLUMNS = [c for step in STEPS for c in step if c.startswith("x_")]


def spark(expression: str) -> Column:
    return F.expr(expression.replace("{all}", "").replace("\\", "\\\\"))


def extracted(dialogues):
    """(conversation, default_role, default_cargo, default_deadline, ...) with what the rules read from the conversation. A
    null conversation is an empty one."""
    rows = dialogues.withColumn("conversation", F.coalesce("conversation", F.lit("")))
    for step in STEPS:
        rows = rows.withColumns({name: spark(e) for name, e in step.items()})
    return rows


def sql(source: str) -> str:
    """The twin of extracted(): a chain of subqueries."""
    for step in STEPS:
        listed = ", ".join(f"{e} AS {name}" for name, e in step.items()).replace("{all}", ", 'g'")
        source = f"(SELECT *, {listed} FROM {source})"
    return source
