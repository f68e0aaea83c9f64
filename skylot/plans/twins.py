"""SQL of the lens, for the twins of the queries."""

from __future__ import annotations

from skylot.functions import rules
from skylot.sources import lens


def _pick(names: tuple[str, ...], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(names)} = {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _has(needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(text, '{n}')" for n in needles) + ")"


def _in(column: str, names: tuple[str, ...]) -> str:
    return f"{column} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def q6(x: str) -> str:
    return f"CAST(FLOOR(({x}) * 1e6 + 5e-1) AS DOUBLE) / 1e6"


def label(ts: str, width: int) -> str:
    start = f"(CAST(FLOOR((hour({ts}) * 60 + minute({ts})) / {width}.0) AS INT) * {width})"
    stop = f"least({start} + {width}, 1440)"

    def clock(m: str) -> str:
        return f"lpad(CAST(CAST(FLOOR({m} / 60.0) AS INT) AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0')"

    return f"substr(CAST({ts} AS VARCHAR), 1, 10) || 'T' || {clock(start)} || '-' || {clock(stop)}"


def score() -> str:
    d = "coalesce(deadline, 0)"
    return f"""CASE tier WHEN 'life_support' THEN 100 WHEN 'critical' THEN 72 WHEN 'regular' THEN 42 ELSE 12 END
    + CASE WHEN {d} > 0 AND {d} <= 15 THEN 30 WHEN {d} > 0 AND {d} <= 30 THEN 20 WHEN {d} > 0 AND {d} <= 60 THEN 10 ELSE 0 END
    + CASE WHEN hard THEN 6 ELSE 0 END
    + CASE WHEN {_in('cargo', rules.LIFE_CARGO)} THEN 24 WHEN {_in('cargo', rules.CRITICAL_CARGO)} THEN 14 ELSE 0 END
    + CASE WHEN {_has(rules.EXTREME_EVIDENCE)} THEN 34 WHEN {_has(rules.CRITICAL_EVIDENCE)} THEN 18 ELSE 0 END
    + CASE WHEN {_in('role', rules.EMERGENCY_ROLES)} THEN 12 WHEN {_in('role', rules.CRITICAL_ROLES)} THEN 8 ELSE 0 END
    + CASE WHEN children THEN 10 ELSE 0 END + CASE WHEN elderly THEN 8 ELSE 0 END + CASE WHEN vulnerable THEN 6 ELSE 0 END
    + CASE WHEN {_has(('ready', 'standing by', 'handoff'))} THEN 4 ELSE 0 END
    + CASE WHEN {_in('handling', ('cold_chain', 'shock_protection'))} THEN 4 ELSE 0 END
    + CASE WHEN {_in('destination', ('hospital', 'clinic'))} AND {_in('tier', ('life_support', 'critical'))} THEN 4 ELSE 0 END"""


def priority() -> str:
    by_score = "CASE WHEN score >= 125 THEN 1 WHEN score >= 82 THEN 2 WHEN score >= 42 THEN 3 ELSE 4 END"
    return f"""CASE WHEN tier = 'life_support' THEN 1 WHEN tier = 'critical' THEN 2
      WHEN tier = 'regular' AND (contains(text, 'post-exposure') OR coalesce(deadline, 0) <= 30) THEN least({by_score}, 2)
      WHEN tier = 'regular' THEN greatest({by_score}, 3)
      WHEN cargo = 'otc_drug' AND {_has(('fever', 'child', 'pediatric', 'elderly'))} THEN least({by_score}, 3) ELSE 4 END"""


def demand(width: int = 5) -> str:
    return f"""v_event AS (
  SELECT event_id AS demand_id, ts, user_id, event_type, value AS weight_kg, CAST(props->>'$.k' AS INT) AS k FROM events),
v_field AS (
  SELECT *, {label('ts', width)} AS label, CAST(FLOOR((hour(ts) * 60 + minute(ts)) / 5.0) AS INT) AS slot,
    CASE event_type WHEN 'error' THEN 'life_support' WHEN 'purchase' THEN 'critical' WHEN 'signup' THEN 'regular' ELSE 'consumer' END AS tier,
    CASE WHEN k < 10 THEN 15 WHEN k < 25 THEN 30 WHEN k < 50 THEN 60 WHEN k < 80 THEN 120 END AS deadline,
    {_pick(lens.ROLES, 'user_id')} AS role, {_pick(lens.CARGO, 'demand_id')} AS cargo,
    {_pick(lens.PLACES, 'user_id')} AS destination, {_pick(lens.TEXTS, 'k')} AS text,
    k % 11 = 0 AS children, k % 13 = 0 AS elderly, k % 7 = 0 AS vulnerable,
    CASE k % 3 WHEN 0 THEN 'cold_chain' WHEN 1 THEN 'shock_protection' END AS handling, k % 2 = 0 AS ready FROM v_event),
v_hard AS (SELECT *, coalesce(deadline <= 30, false) OR tier IN ('life_support', 'critical') AS hard FROM v_field),
v_score AS (SELECT *, {score()} AS score FROM v_hard),
v_demand AS (
  SELECT *, score + CASE WHEN ready THEN 6 ELSE 0 END + 2 AS solver_score,
    {priority()} AS priority
  FROM v_score)"""


FACT = """v_row AS (
  SELECT l_returnflag AS method, l_orderkey AS demand_id, l_suppkey AS carrier, l_partkey AS part,
    least(4, CAST(substr(o_orderpriority, 1, 1) AS INT)) AS true_priority,
    CASE WHEN l_quantity <= 12 THEN 1 WHEN l_quantity <= 25 THEN 2 WHEN l_quantity <= 38 THEN 3 ELSE 4 END AS pred_priority,
    CAST(greatest(0, datediff('day', o_orderdate, l_shipdate)) AS DOUBLE) AS latency, l_linestatus = 'F' AS served,
    o_custkey % 5 = 0 AS vulnerable, substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS month,
    l_quantity AS quantity, l_tax AS tax, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v_fact AS (SELECT *, true_priority * 300.0 AS deadline, served AND latency <= true_priority * 300 AS on_time FROM v_row)"""

CANDIDATE = FACT + """,
v_candidate AS (
  SELECT carrier AS solution_id, sum(quantity) AS distance, sum(latency) / count(*) AS delivery_time,
    CAST(sum(CAST(FLOOR(tax * 100 + 5e-1) AS BIGINT)) AS DOUBLE) AS noise, 1 - avg(CASE WHEN served THEN 1.0 ELSE 0.0 END) AS service_loss,
    CAST(count(DISTINCT part) AS DOUBLE) AS drones FROM v_fact GROUP BY carrier)"""


def place(key: str, a: int, b: int) -> str:
    return (f"CAST(113.8 AS DOUBLE) + CAST({key} * {a} % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS lon, "
            f"CAST(22.4 AS DOUBLE) + CAST({key} * {b} % 10009 AS DOUBLE) / CAST(10009 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS lat")


SITE = f"""v_site AS (SELECT c_custkey AS site_id, {place('c_custkey', 7919, 104729)} FROM customer),
v_station AS (SELECT s_suppkey AS station_id, {place('s_suppkey', 6101, 9973)} FROM supplier)"""


def with_demand(sql: str, width: int = 5) -> str:
    return f"WITH {demand(width)} {sql}"


def with_fact(sql: str) -> str:
    return f"WITH {FACT} {sql}"


def with_candidate(sql: str) -> str:
    return f"WITH {CANDIDATE} {sql}"


def with_site(sql: str) -> str:
    return f"WITH {SITE} {sql}"
