"""The priority rule engine as column functions: evidence score, priority, reasons, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rules.
TIERS = {"life_support": (1, 100), "critical": (2, 72), "regular": (3, 42), "consumer": (4, 12)}
URGENCY_TIERS = {"extreme": "life_support", "urgent": "critical", "express": "regular", "normal": "regular"}
EXTREME_EVIDENCE = ("cardiac arrest", "cpr", "life-threatening", "code red", "stroke", "hemorrhage", "active transfusion", "golden rescue window")
CRITICAL_EVIDENCE = ("icu", "ventilator", "urgent", "serious clinical", "post-exposure", "backup unit", "urgent same-window")
EMERGENCY_ROLES, CRITICAL_ROLES = ("emergency_doctor", "paramedic", "triage_nurse"), ("icu_nurse", "clinical_pharmacist", "ward_coordinator")
LIFE_CARGO, CRITICAL_CARGO = ("aed", "blood_product", "cardiac_drug", "thrombolytic"), ("ventilator", "icu_drug")


def normalized_priority(value: Column, default: int = 4) -> Column:
    """Whole numbers from 1 to 4; what can't be read is the default."""
    return F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce(value.try_cast("int"), F.lit(default))))


def resolved_tier(tier: Column, cargo_tier: Column, urgency: Column) -> Column:
    """The first that names a tier, of the demand's own, the cargo's and what the urgency implies."""
    known = [F.when(c.isin(*TIERS), c) for c in (tier, cargo_tier)]
    implied = reduce(lambda c, kv: c.when(urgency == kv[0], kv[1]), URGENCY_TIERS.items(), F)
    return F.coalesce(*known, implied, F.lit("regular"))


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    """Raw substrings, without word borders."""
    return reduce(Column.__or__, (text.contains(n) for n in needles))


def _tier_value(tier: Column, which: int, other: int) -> Column:
    return reduce(lambda c, kv: c.when(tier == kv[0], kv[1][which]), TIERS.items(), F).otherwise(other)


def factors(tier: Column, deadline: Column, hard: Column, cargo: Column, text: Column, role: Column, children: Column,
            elderly: Column, vulnerable: Column, handling: Column, destination: Column, ready: Column | None = None) -> list[tuple[Column, Column]]:
    """(bonus, reason) of each family of rules; of a family the first that holds counts. A missing
    deadline is 0 and earns nothing. ready: given in solver mode."""
    d = F.coalesce(deadline, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))

    def family(*cases: tuple[Column, int, Column | str]) -> tuple[Column, Column]:
        bonus, reason = F, F
        for test, value, name in cases:
            test = yes(test)
            bonus = bonus.when(test, value)
            reason = reason.when(test, F.lit(name) if isinstance(name, str) else name)
        return bonus.otherwise(0), reason

    found = [
        family(((d > 0) & (d <= 15), 30, "deadline<=15m"), ((d > 0) & (d <= 30), 20, "deadline<=30m"), ((d > 0) & (d <= 60), 10, "deadline<=60m")),
        family((hard, 6, "hard_deadline")),
        family((cargo.isin(*LIFE_CARGO), 24, F.concat(F.lit("cargo="), cargo)), (cargo.isin(*CRITICAL_CARGO), 14, F.concat(F.lit("cargo="), cargo))),
        family((_any(text, EXTREME_EVIDENCE), 34, "life_threatening_context"), (_any(text, CRITICAL_EVIDENCE), 18, "critical_clinical_context")),
        family((role.isin(*EMERGENCY_ROLES), 12, F.concat(F.lit("role="), role)), (role.isin(*CRITICAL_ROLES), 8, F.concat(F.lit("role="), role))),
        family((children, 10, "children_involved")), family((elderly, 8, "elderly_involved")), family((vulnerable, 6, "vulnerable_community")),
        family((_any(text, ("ready", "standing by", "handoff")), 4, "handoff_ready")),
        family((handling.isin("cold_chain", "shock_protection"), 4, "special_handling")),
        family((destination.isin("hospital", "clinic") & tier.isin("life_support", "critical"), 4, F.concat(F.lit("destination="), destination))),
    ]
    if ready is not None:
        found += [family((yes(ready) | text.contains("landing zone cleared"), 6, "solver_ready_receiver")), family((F.lit(True), 2, "solver_routeable"))]
    return found


def score(tier: Column, found: list[tuple[Column, Column]]) -> Column:
    return reduce(Column.__add__, (b for b, _ in found), _tier_value(tier, 1, 42)).cast("int")


def reasons(tier: Column, found: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("tier="), tier), *(r for _, r in found)))


def priority(score_: Column, tier: Column, deadline: Column, cargo: Column, text: Column) -> Column:
    """The score's priority, held in its tier: life support and critical have their own; a regular
    demand without a deadline counts as if it had one of 0 minutes."""
    by_score = F.when(score_ >= 125, 1).when(score_ >= 82, 2).when(score_ >= 42, 3).otherwise(4)
    soon = text.contains("post-exposure") | (F.coalesce(deadline, F.lit(0)) <= 30)
    frail = (cargo == "otc_drug") & _any(text, ("fever", "child", "pediatric", "elderly"))
    return (F.when(tier == "life_support", 1).when(tier == "critical", 2)
            .when((tier == "regular") & soon, F.least(by_score, F.lit(2))).when(tier == "regular", F.greatest(by_score, F.lit(3)))
            .when((tier == "consumer") & frail, F.least(by_score, F.lit(3))).otherwise(4)).cast("int")
