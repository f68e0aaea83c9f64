"""What a dialogue has to mention so that its demand's priority can be told from it, and whether it does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rules.
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "into", "while", "needs", "need", "soon", "before", "after", "local", "team", "case",
              "order", "requested", "request", "delivery", "drone", "support")
SCENARIO_WORDS = ("cpr", "cardiac arrest", "transfusion", "stroke", "backup ventilator", "vaccination", "same-day")
HANDLING_WORDS = ("cold-chain", "shock-proof", "insulated")
READY_WORDS = ("landing zone", "standing by", "ready for handoff", "team waiting")
VULNERABLE_WORDS = ("child", "children", "elderly", "senior", "vulnerable community")
ROUTINE = "Routine supply request"

MUST = ("scenario_context", "deadline_minutes", "requester_role", "special_handling", "receiver_ready")
MAY = ("destination_type", "population_vulnerability")


def _words(*values: Column | str) -> Column:
    return F.array(*(F.lit(v) if isinstance(v, str) else v for v in values))


def scenario_keywords(text: Column) -> Column:
    """A scenario in whole, its clauses, and its long words but for the usual ones; each once."""
    told = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    clauses = F.filter(F.transform(F.split(told, "[.;]| and | before | while "), lambda x: F.btrim(x, F.lit(" .,:;"))), lambda x: x != "")
    tokens = F.filter(F.regexp_extract_all(told, F.lit("([a-z0-9_]+)")), lambda x: (F.length(x) >= 6) & ~x.isin(*STOP_WORDS))
    return F.when(told == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(told), clauses, tokens)))


def keywords() -> dict[str, Column]:
    """Each factor's keywords, from the columns of a demand (text, deadline, role, handling array, ready, destination, children,
    elderly); null where the factor isn't asked for."""
    spoken = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    minutes = F.col("deadline").cast("string")
    return {
        "scenario_context": F.array_distinct(F.concat(scenario_keywords(F.col("text")), _words(*SCENARIO_WORDS))),
        "deadline_minutes": _words(F.concat(minutes, F.lit(" min")), F.concat(minutes, F.lit("-minute")), F.concat(F.lit("within "), minutes, F.lit(" minutes"))),
        "requester_role": _words(spoken("role")),
        "special_handling": F.when(F.size("handling") > 0, F.array_distinct(F.concat("handling", _words(*HANDLING_WORDS)))),
        "receiver_ready": F.when(F.col("ready"), _words(*READY_WORDS)),
        "destination_type": _words(spoken("destination"), "receiving point"),
        "population_vulnerability": F.when(F.col("children") | F.col("elderly"), _words(*VULNERABLE_WORDS)),
    }


def audited(rows: DataFrame) -> DataFrame:
    """Demands with a conversation -> with observed and missing (names), needed (names of what is asked for) and observability."""
    said = F.btrim(F.regexp_replace(F.lower(F.coalesce("conversation", F.lit(""))), r"\s+", " "))
    rows = rows.withColumn("_said", said)
    found = {n: k for n, k in keywords().items()}
    seen = {n: F.coalesce(F.exists(k, lambda w: F.contains(F.col("_said"), F.lower(F.trim(w)))), F.lit(False)) for n, k in found.items()}
    rows = rows.withColumns({f"_need_{n}": k.isNotNull() for n, k in found.items()} | {f"_seen_{n}": c for n, c in seen.items()})
    names = lambda which, test: F.array_compact(F.array(*(F.when(test(n), F.lit(n)) for n in which)))
    count = lambda which, kind: reduce(Column.__add__, (F.col(f"_{kind}_{n}").cast("int") for n in which))
    denominator = F.greatest(count(MUST, "need") + F.greatest(count(MAY, "need"), F.lit(1)) * 0.5, F.lit(1.0))
    score = F.least(F.lit(1.0), (count(MUST, "seen") + count(MAY, "seen") * 0.5) / denominator)
    return rows.withColumns({
        "observed": names((*MUST, *MAY), lambda n: F.col(f"_seen_{n}")), "missing": names(MUST, lambda n: F.col(f"_need_{n}") & ~F.col(f"_seen_{n}")),
        "needed": names((*MUST, *MAY), lambda n: F.col(f"_need_{n}")), "observability": F.round(score, 4)}).drop(*(c for c in rows.columns if c.startswith("_")))


def masked(rows: DataFrame) -> DataFrame:
    """audited() demands as they would look if only what is observed were known: defaults in place of the rest."""
    seen = lambda n: F.array_contains("observed", n)
    known = lambda n, c, other: F.when(seen(n), F.col(c)).otherwise(other)
    later = F.greatest(F.lit(120), F.coalesce(F.nullif("deadline", F.lit(0)), F.lit(120)))
    role = F.when(F.col("tier") == "consumer", "consumer").otherwise("community_health_worker")
    frail = {c: known("population_vulnerability", c, F.lit(False)) for c in ("children", "elderly", "vulnerable")}
    return rows.withColumns({
        "text": known("scenario_context", "text", F.lit(ROUTINE)), "deadline": known("deadline_minutes", "deadline", later), "hard": seen("deadline_minutes") & F.col("hard"),
        "role": known("requester_role", "role", role), "handling": known("special_handling", "handling", F.array().cast("array<string>")),
        "ready": known("receiver_ready", "ready", F.lit(False)), **frail})
