"""Queries over single records: lookups, structured demands, loose texts, keys, names, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylot.functions import records
from skylot.functions.scalars import q6
from skylot.plans.twins import q6 as q
from skylot.plans.twins import with_demand
from skylot.registry import query
from skylot.sources import files, lens, places


def _twin(name, columns: dict[str, str], width=5, source="v_demand"):
    """A query that is one projection of SQL expressions that both engines read alike."""
    listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())

    @query(name, with_demand(f"SELECT demand_id, {listed} FROM {source}", width))
    def run(spark, d):
        return lens.demands(spark, d, width).select("demand_id", *(F.expr(e).alias(c) for c, e in columns.items()))

    return run


_twin("lookup_tables", {"p_tier": records.lookup("priority", records.TIER, "'consumer'"), "p_deadline": records.lookup("priority", records.DEADLINE, "120"),
                        "label_en": records.lookup("cargo", records.LABELS, "cargo"), "unit": records.lookup("cargo", records.UNITS, "'unit'")})
_twin("scenario_texts", {"scenario": records.scenario("priority", "cargo", "destination")})
_twin("readiness_texts", {"readiness": records.readiness("ready", "priority")})
_twin("dialogue_styles", {"style": records.lookup("replace(replace(lower(trim(CASE k % 5 WHEN 0 THEN ' Plain' WHEN 1 THEN 'Term-Heavy' WHEN 2 THEN 'spoken' WHEN 3 THEN 'dispatch style' ELSE 'haiku' END)), '-', '_'), ' ', '_')", records.STYLES, "'direct'")})
_QUANTITY = f"greatest(1, CAST(floor(weight_kg / {records.lookup('cargo', records.UNIT_KG, '0.5')} + 5e-1) AS BIGINT))"
_MINUTES = f"coalesce(deadline, {records.lookup('priority', records.DEADLINE, '120')})"
_twin("structured_demand", {
    "quantity": _QUANTITY, "quantity_unit": records.lookup("cargo", records.UNITS, "'unit'"), "temperature_sensitive": "cargo IN ('blood_product', 'thrombolytic', 'vaccine')",
    "kind": f"CASE WHEN {_MINUTES} <= 30 OR tier IN ('life_support', 'critical') THEN 'hard' ELSE 'soft' END", "description": f"concat('Delivery target within ', CAST({_MINUTES} AS STRING), ' minutes')",
    "sensitivity": f"CASE WHEN {_MINUTES} <= 15 THEN 'Immediate action required' WHEN {_MINUTES} <= 30 THEN 'Urgent same-window delivery required' WHEN {_MINUTES} <= 90 THEN 'Timely delivery needed within the service window' ELSE 'Flexible same-day delivery' END",
    "signals": f"concat_ws('; ', {records.scenario('priority', 'cargo', 'destination')}, concat('Structured deadline: ', CAST({_MINUTES} AS STRING), ' minutes'), concat('Requester role: ', role), {records.readiness('ready', 'priority')})"})
_twin("manifest_events", {
    "fid": "coalesce(CASE WHEN k % 2 = 0 THEN concat('F', CAST(user_id AS STRING)) END, CASE WHEN k % 3 = 0 THEN concat('N', CAST(user_id AS STRING)) END, '')",
    "slot": "coalesce(CASE WHEN k % 4 = 0 THEN slot END, CAST(floor((hour(ts) + minute(ts) / 60.0) * 12 + 5e-1) AS INT))", "tier_given": "coalesce(CASE WHEN k % 5 = 0 THEN tier END, CASE WHEN k % 7 = 0 THEN 'critical' END, 'regular')"})
_twin("point_keys", {"point": "CASE WHEN k % 3 = 0 THEN concat('fid:', trim(concat(' ', CAST(user_id AS STRING)))) WHEN k % 3 = 1 THEN concat('coords:', CAST(CAST(floor((113.8 + user_id / 1000.0) * 1e7 + 5e-1) AS BIGINT) AS STRING), ':', CAST(CAST(floor((22.4 + k / 1000.0) * 1e7 + 5e-1) AS BIGINT) AS STRING)) ELSE concat('point_', CAST(demand_id AS STRING)) END"})
_twin("service_scores", {"service_score": "4 + 1 - greatest(1, least(4, priority))"})
_twin("priority_modes", {
    "rule_only": "priority", "llm_only": "coalesce(CASE WHEN k % 5 < 4 THEN k % 4 + 1 END, priority)",
    "hybrid": "CASE WHEN k % 5 = 4 OR priority = 1 OR abs(priority - (k % 4 + 1)) <= 1 THEN priority ELSE k % 4 + 1 END", "uniform": "2", "hashed": "CAST((demand_id * 48271 + 7) % 2147483647 % 4 + 1 AS INT)"})
_RUNS = "concat('runs/seed_', CAST(k % 9 AS STRING), '/run_20240101_1203', lpad(CAST(k % 60 AS STRING), 2, '0'), '_post-expa-gs', CAST(user_id AS STRING), '_noise')"
_twin("run_names", {"model": f"regexp_extract({_RUNS}, 'run_[0-9]{{8}}_[0-9]{{6}}_(.+?)_noise', 1)", "step": f"CAST(regexp_extract({_RUNS}, 'gs([0-9]+)', 1) AS INT)", "seed": f"regexp_extract({_RUNS}, 'seed_?([0-9]+)', 1)",
                    "target": f"contains(lower({_RUNS}), 'post-expa')"})
_twin("window_selection", {"by_label": "label LIKE '%T00:%'", "by_slot": "slot IN (0, 12, 100)", "chosen": "CASE WHEN label LIKE '%T00:%' THEN 'label' WHEN slot IN (0, 12, 100) THEN 'slot' ELSE 'none' END"})
_twin("prompt_texts", {"prompt": "concat('Rank these demands. ', 'id=', CAST(demand_id AS STRING), ' cargo=', cargo, ' tier=', tier, CASE WHEN deadline IS NULL THEN '' ELSE concat(' within ', CAST(deadline AS STRING), ' min') END, '. Answer as JSON.')",
                       "answer": "concat('{\"priority_labels\": [{\"demand_id\": \"', CAST(demand_id AS STRING), '\", \"priority\": ', CAST(priority AS STRING), '}]}')"})
_ORDERED = [("Customer#", "Station "), ("00000", ""), ("Station 0", "Depot 0")]


@query("translated_names", "SELECT c_custkey, " + "replace(" * len(_ORDERED) + "c_name" + "".join(f", '{a}', '{b}')" for a, b in _ORDERED) + " AS name FROM customer")
def translated_names(spark, d):
    """Names by an ordered list of replacements, each on what the one before has left."""
    name = F.col("c_name")
    for a, b in _ORDERED:
        name = F.replace(name, F.lit(a), F.lit(b))
    return lens.table(spark, d, "customer").select("c_custkey", name.alias("name"))


_PERIOD = "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(44000 + k AS STRING) WHEN 2 THEN concat('2021年', CAST(k % 12 + 1 AS STRING), '月', CAST(k % 28 + 1 AS STRING), '日？-2023年1月2日') WHEN 3 THEN concat('-', CAST(45000 + k AS STRING), '.0') ELSE '2020年12月5日' END"


def _date_sql(token: str) -> str:
    y, m, d = (f"regexp_extract({token}, '([0-9]{{4}})年([0-9]{{1,2}})月([0-9]{{1,2}})日', {i})" for i in (1, 2, 3))
    return (f"CASE WHEN regexp_matches({token}, '^[0-9]+([.][0-9]+)?$') THEN CAST(DATE '1899-12-30' + CAST(floor(CAST({token} AS DOUBLE)) AS INT) AS VARCHAR) "
            f"WHEN {y} <> '' THEN {y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') ELSE '' END")


_HALVES = f"SELECT demand_id, trim(CASE WHEN contains(t, '-') THEN substr(t, 1, instr(t, '-') - 1) ELSE t END) AS a, trim(CASE WHEN contains(t, '-') THEN substr(t, instr(t, '-') + 1) ELSE '' END) AS b FROM (SELECT demand_id, {_PERIOD} AS t FROM v_demand)"


@query("service_periods", with_demand(f"SELECT demand_id, {_date_sql('a')} AS starts, {_date_sql('b')} AS ends, contains(a, '？') AS start_estimated, contains(b, '？') AS end_estimated FROM ({_HALVES})"))
def service_periods(spark, d):
    """Service periods of several notations: a spreadsheet's day number, a dated text, or two of them with a dash."""
    text = F.expr(_PERIOD)
    parts = F.split(text, "-", 2)
    rows = lens.demands(spark, d).select("demand_id", F.trim(F.get(parts, 0)).alias("a"), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("b"))
    return rows.select("demand_id", places.service_date(F.col("a")).alias("starts"), places.service_date(F.col("b")).alias("ends"), F.contains("a", F.lit("？")).alias("start_estimated"), F.contains("b", F.lit("？")).alias("end_estimated"))


_ROWS = "concat('{\"', CASE WHEN k % 2 = 0 THEN 'demand_configs' ELSE 'priority_labels' END, '\": [{\"demand_id\": \"D', CAST(demand_id AS STRING), '\", \"priority\": ', CAST(k % 6 AS STRING), '}, {\"demand_id\": \" E \", \"priority\": \"x\", \"window_rank\": 7}]}')"
_SAID = f"CASE k % 5 WHEN 0 THEN {_ROWS} WHEN 1 THEN concat('Sure:\n```json\n', {_ROWS}, '\n```\nDone.') WHEN 2 THEN concat('Here it is: ', replace({_ROWS}, '}}]', '}},]'), ' Bye.') WHEN 3 THEN concat('  ', {_ROWS}, ' as asked') ELSE 'There is no answer [yet' END"
_CLEAN_SQL = f"(SELECT demand_id, label, {_SAID} AS x0 FROM v_demand)"
for _i, _e in enumerate(records.UNFENCED):
    _CLEAN_SQL = f"(SELECT demand_id, label, {_e.format(x=f'x{_i}')} AS x{_i + 1} FROM {_CLEAN_SQL})"
_CLEAN_SQL = f"(SELECT *, {records.SLICED.format(x='x3')} AS slice FROM {_CLEAN_SQL})"
_TRAILING = r",\s*([}\]])"
_PARSED_SQL = (f"(SELECT *, coalesce(CASE WHEN json_valid(x3) THEN x3 END, CASE WHEN json_valid(slice) THEN slice END, CASE WHEN json_valid(regexp_replace(x3, '{_TRAILING}', '\\1', 'g')) THEN regexp_replace(x3, '{_TRAILING}', '\\1', 'g') END, "
               f"CASE WHEN json_valid(regexp_replace(slice, '{_TRAILING}', '\\1', 'g')) THEN regexp_replace(slice, '{_TRAILING}', '\\1', 'g') END) AS body FROM {_CLEAN_SQL})")


def answered(spark, d):
    """Model answers with the JSON that they hold, or null: as it is, the outermost brackets, or either without trailing commas."""
    said = _SAID
    for e in records.UNFENCED:
        said = records.let(said, e.format(x="x"))
    return files.with_json(lens.demands(spark, d).select("demand_id", "label", F.expr(said).alias("x")), "x", "body")


@query("tolerant_json", with_demand(f"SELECT demand_id, body IS NOT NULL AS parsed, CAST(coalesce(body->>'$.demand_configs[0].priority', body->>'$.priority_labels[0].priority') AS INT) AS first_priority FROM {_PARSED_SQL}"))
def tolerant_json(spark, d):
    first = F.coalesce(*(F.get_json_object("body", f"$.{k}[0].priority") for k in records.ROW_KEYS))
    return answered(spark, d).select("demand_id", F.col("body").isNotNull().alias("parsed"), first.cast("int").alias("first_priority"))


@query("model_rows", with_demand(f"""SELECT demand_id, trim(row->>'$.demand_id') AS row_id, greatest(1, least(4, coalesce(try_cast(row->>'$.priority' AS INT), 4))) AS priority, coalesce(try_cast(row->>'$.window_rank' AS INT), i) AS window_rank FROM (
  SELECT demand_id, unnest(coalesce(json_extract(body, '$.demand_configs[*]'), [])  || coalesce(json_extract(body, '$.priority_labels[*]'), [])) AS row, unnest([1, 2]) AS i FROM {_PARSED_SQL} WHERE body IS NOT NULL)"""))
def model_rows(spark, d):
    """A model's rows under any of their keys, with ids trimmed, priorities from 1 to 4 and ranks by place where none is given."""
    kind = "array<struct<demand_id:string,priority:string,window_rank:string>>"
    lists = records.let("body", f"coalesce({', '.join(f"from_json(get_json_object(x, '$.{k}'), '{kind}')" for k in records.ROW_KEYS)})")
    # the outer form, so that the optimizer makes no filters that read the answer's JSON again
    rows = answered(spark, d).select("demand_id", F.posexplode_outer(F.expr(lists)).alias("i", "row")).filter("i IS NOT NULL")
    return rows.select("demand_id", F.trim("row.demand_id").alias("row_id"), F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce(F.col("row.priority").try_cast("int"), F.lit(4)))).alias("priority"),
                       F.coalesce(F.col("row.window_rank").try_cast("int"), F.col("i") + 1).alias("window_rank"))


_LINE = "CASE k % 4 WHEN 0 THEN concat('step:', CAST(slot AS STRING), ' loss: ', CAST(k AS STRING), '.5 acc=0.', CAST(k AS STRING)) WHEN 1 THEN concat('loss: ', CAST(k AS STRING), '.25') WHEN 2 THEN '[Path Cache] (disk)' ELSE '[Path Cache 3] computing' END"


@query("log_scalars", with_demand(f"""SELECT label, key, step, value FROM (SELECT label, key, step, value, count(*) OVER (PARTITION BY label, key) AS n FROM (
  SELECT label, key, coalesce(try_cast(nullif(regexp_extract(line, 'step[:=]([0-9]+)', 1), '') AS INT), line_no) AS step, try_cast(nullif(regexp_extract(line, key || '[:=] ?([0-9.]+)', 1), '') AS DOUBLE) AS value FROM (
  SELECT label, {_LINE} AS line, CAST(row_number() OVER (PARTITION BY label ORDER BY demand_id) AS INT) AS line_no FROM v_demand) CROSS JOIN (SELECT unnest(['loss', 'acc']) AS key)) WHERE value IS NOT NULL) WHERE n >= 2""", 60))
def log_scalars(spark, d):
    """Steps and values of a log's lines; a line without a step counts by its number; series of one value are left out."""
    rows = lens.demands(spark, d, 60).select(F.col("label").alias("log"), F.expr(_LINE).alias("value"), "demand_id")
    return files.log_scalars(files.numbered(rows, "log", "demand_id")).filter("key <> 'step'").withColumnRenamed("log", "label")


@query("cache_counters", with_demand(f"SELECT label, count(*) FILTER (contains(line, '[Path Cache] (disk)')) AS hits, count(*) FILTER (regexp_matches(line, '.Path Cache [0-9]+. computing')) AS misses, {q('100 * count(*) FILTER (contains(line, ' + chr(39) + '[Path Cache] (disk)' + chr(39) + ')) / nullif(count(*) FILTER (contains(line, ' + chr(39) + 'Path Cache' + chr(39) + ')), 0)::DOUBLE')} AS hit_rate FROM (SELECT label, {_LINE} AS line FROM v_demand) GROUP BY label", 60))
def cache_counters(spark, d):
    return files.cache_counters(lens.demands(spark, d, 60).select(F.col("label").alias("log"), F.expr(_LINE).alias("value"))).select(F.col("log").alias("label"), "hits", "misses", q6(F.col("hit_rate")).alias("hit_rate"))


@query("step_timings", with_demand("SELECT label, CAST(max(epoch(ts)) FILTER (k % 4 = 3) - max(epoch(ts)) FILTER (k % 4 = 2) AS BIGINT) AS seconds FROM (SELECT label, date_trunc('second', ts) AS ts, k FROM v_demand) GROUP BY label", 60))
def step_timings(spark, d):
    """Seconds between the last marks of two steps in a log."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO Step "), (F.col("k") % 4).cast("string"), F.lit(" begins"))
    return files.step_timings(lens.demands(spark, d, 60).select(F.col("label").alias("log"), line.alias("value")), 2, 3).withColumnRenamed("log", "label")
