"""Queries over texts and records: audits, gates, set operations, text rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.functions.scalars import q6
from skylot.operators import ranking, sets
from skylot.operators.metrics import ratio
from skylot.plans.twins import q6 as q
from skylot.registry import query
from skylot.sources.lens import table

_AUDIT = "WITH v_audit AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def audits(spark, d):
    """Documents with their labels, where they have any."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


@query("audit_pass_by_slice", f"{_AUDIT} SELECT lang AS slice, count(*) FILTER (quality = 1) AS passed, count(quality) AS total, {q('count(*) FILTER (quality = 1) / nullif(count(quality), 0)::DOUBLE')} AS rate FROM v_audit GROUP BY lang")
def audit_pass_by_slice(spark, d):
    passed, total = F.count_if(F.col("quality") == 1), F.count("quality")
    return audits(spark, d).groupBy(F.col("lang").alias("slice")).agg(passed.alias("passed"), total.alias("total"), q6(ratio(passed, total)).alias("rate"))


@query("accepted_only", f"{_AUDIT} SELECT doc_id, lang FROM v_audit WHERE coalesce(quality = 1, false)")
def accepted_only(spark, d):
    return audits(spark, d).filter(F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id", "lang")


@query("observability_stats", f"SELECT lang, {q('avg(n_chars)')} AS mean, {q('median(n_chars)')} AS median, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY lang")
def observability_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(q6(F.avg("n_chars")).alias("mean"), q6(F.median("n_chars")).alias("median"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query("length_stats", f"SELECT lang, source, count(*) AS n, min(n_chars) AS low, {q('quantile_cont(n_chars, 0.5)')} AS p50, {q('quantile_cont(n_chars, 0.95)')} AS p95, max(n_chars) AS high, {q('avg(CASE WHEN n_chars > 4000 THEN 1.0 ELSE 0.0 END)')} AS over_limit FROM documents GROUP BY lang, source")
def length_stats(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("low"), q6(F.percentile(n, F.lit(0.5))).alias("p50"), q6(F.percentile(n, F.lit(0.95))).alias("p95"),
        F.max(n).alias("high"), q6(F.avg((n > 4000).cast("double"))).alias("over_limit"))


_METRICS = f"{_AUDIT}, m AS (SELECT count(*) FILTER (quality = 1) / count(quality)::DOUBLE AS pass_rate, avg(toxic)::DOUBLE AS toxic_share, count(*) FILTER (quality IS NULL) / count(*)::DOUBLE AS unlabelled FROM v_audit)"
_CHECKS = "SELECT 'pass_rate' AS name, pass_rate AS value, 0.8::DOUBLE AS low, NULL::DOUBLE AS high FROM m UNION ALL SELECT 'toxic_share', toxic_share, NULL, 0.1 FROM m UNION ALL SELECT 'unlabelled', unlabelled, NULL, 0.7 FROM m UNION ALL SELECT 'contradictions', NULL, 2, NULL FROM m"


def gate_rows(spark, d):
    m = audits(spark, d).agg(ratio(F.count_if(F.col("quality") == 1), F.count("quality")).alias("pass_rate"), F.avg("toxic").alias("toxic_share"),
                             ratio(F.count_if(F.col("quality").isNull()), F.count(F.lit(1))).alias("unlabelled"))
    checks = [("pass_rate", F.col("pass_rate"), 0.8, None), ("toxic_share", F.col("toxic_share"), None, 0.1), ("unlabelled", F.col("unlabelled"), None, 0.7), ("contradictions", F.lit(None), 2.0, None)]
    rows = F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high")) for n, v, lo, hi in checks))
    c = m.select(F.inline(rows))
    passed = F.coalesce(F.col("value") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("high"), F.lit(True))
    return c.withColumn("skipped", F.col("value").isNull()).withColumn("passed", passed)


@query("gate_checks", f"{_METRICS} SELECT name, {q('value')} AS value, low, high, value IS NULL AS skipped, coalesce(value >= low, true) AND coalesce(value <= high, true) AS passed FROM ({_CHECKS})")
def gate_checks(spark, d):
    return gate_rows(spark, d).withColumn("value", q6(F.col("value")))


@query("release_status", f"""{_METRICS} SELECT CASE WHEN bool_and(ok) THEN 'accepted' WHEN bool_or(ok) THEN 'needs_regen' ELSE 'debug_only' END AS status, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok), '') AS failed
  FROM (SELECT name, coalesce(value >= low, true) AND coalesce(value <= high, true) AS ok FROM ({_CHECKS}))""")
def release_status(spark, d):
    """Accepted if every check passes; else which ones failed."""
    failed = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name")))), ",")
    return gate_rows(spark, d).agg(F.when(F.bool_and("passed"), "accepted").when(F.bool_or("passed"), "needs_regen").otherwise("debug_only").alias("status"), failed.alias("failed"))


@query("shard_rollup", f"""{_AUDIT}, s AS (SELECT source, CASE WHEN count(*) FILTER (quality = 1) >= 0.85 * count(quality) THEN 'accepted' ELSE 'needs_regen' END AS status FROM v_audit GROUP BY source)
SELECT status, count(*) AS n, string_agg(source, ',' ORDER BY source) AS files FROM s GROUP BY status""")
def shard_rollup(spark, d):
    passed, total = F.count_if(F.col("quality") == 1), F.count("quality")
    shards = audits(spark, d).groupBy("source").agg(F.when(passed >= 0.85 * total, "accepted").otherwise("needs_regen").alias("status"))
    return shards.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("files"))


@query("null_type_audit", f"""{_AUDIT} SELECT issue, n FROM (SELECT count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (quality IS NULL) AS no_quality, count(*) FILTER (n_chars <> length(text)) AS wrong_length, count(*) FILTER (trim(text) = '') AS blank FROM v_audit)
UNPIVOT (n FOR issue IN (null_text, no_quality, wrong_length, blank))""")
def null_type_audit(spark, d):
    issues = {"null_text": F.col("text").isNull(), "no_quality": F.col("quality").isNull(), "wrong_length": F.col("n_chars") != F.length("text"), "blank": F.trim("text") == ""}
    return audits(spark, d).agg(*(F.count_if(c).alias(k) for k, c in issues.items())).unpivot([], list(issues), "issue", "n")


@query("issue_examples", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE n_chars < 200) WHERE r <= 3")
def issue_examples(spark, d):
    short = table(spark, d, "documents").filter("n_chars < 200")
    return ranking.ranked(short, ["lang"], ("doc_id",), "r").filter("r <= 3").select("lang", "doc_id")


@query("first_wins_dedupe", "SELECT doc_id, copies FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents) WHERE r = 1")
def first_wins_dedupe(spark, d):
    """One record of each text: a grouped minimum, so copies are combined before the shuffle."""
    rows = table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return rows.select("doc_id", "copies")


@query("id_set_mismatch", "SELECT 'left' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def id_set_mismatch(spark, d):
    sides = spark.createDataFrame([("left",), ("right",)], "side string")
    n = sets.mismatch(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    return sides.join(n, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


@query("record_validation", f"""{_AUDIT} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'no_text' WHEN n_chars < 100 THEN 'too_short' WHEN n_chars > 20000 THEN 'too_long' WHEN NOT coalesce(quality = 1, false) THEN 'not_good' END AS reason FROM v_audit) GROUP BY 1""")
def record_validation(spark, d):
    rules = [("no_text", F.col("text").isNotNull()), ("too_short", F.col("n_chars") >= 100), ("too_long", F.col("n_chars") <= 20000), ("not_good", F.col("quality") == 1)]
    return audits(spark, d).groupBy(F.coalesce(sets.first_failing(rules), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("common_ids", "SELECT d.doc_id FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)")
def common_ids(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("union_sources", "SELECT kind, count(*) AS n FROM (SELECT 'document' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages UNION ALL SELECT 'benchmark', item_id FROM benchmark) GROUP BY kind")
def union_sources(spark, d):
    parts = (("document", "documents", "doc_id"), ("page", "pages", "page_id"), ("benchmark", "benchmark", "item_id"))
    a, b, c = (table(spark, d, t).select(F.lit(k).alias("kind"), F.col(i).alias("id")) for k, t, i in parts)
    return a.unionByName(b).unionByName(c).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("profile_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def profile_counts(spark, d):
    return table(spark, d, "documents").groupingSets([[F.col("lang")], [F.col("source")]], "lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("first_speaker_role", "SELECT conv_id, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id")
def first_speaker_role(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"))


@query("conv_concat", "SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS body FROM conversations GROUP BY conv_id")
def conv_concat(spark, d):
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.concat(s["role"], F.lit(": "), s["text"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("body"))


@query("role_alternation", "SELECT conv_id, count(*) FILTER (role = before) AS repeats FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id")
def role_alternation(spark, d):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").select("conv_id", "role", before.alias("before"))
    return rows.groupBy("conv_id").agg(F.count_if(F.col("role") == F.col("before")).alias("repeats"))


@query("requester_role_drift", "SELECT coalesce(a.role, '-') AS first_role, coalesce(b.role, '-') AS second_role, count(*) AS n FROM (SELECT conv_id, role FROM conversations WHERE turn = 0) a FULL JOIN (SELECT conv_id, role FROM conversations WHERE turn = 1) b ON a.conv_id = b.conv_id GROUP BY 1, 2")
def requester_role_drift(spark, d):
    c = table(spark, d, "conversations")
    a, b = (c.filter(F.col("turn") == t).select("conv_id", F.col("role").alias(n)) for t, n in ((0, "a"), (1, "b")))
    return a.join(b, "conv_id", "full").groupBy(F.coalesce("a", F.lit("-")).alias("first_role"), F.coalesce("b", F.lit("-")).alias("second_role")).agg(F.count(F.lit(1)).alias("n"))


@query("regex_scalars", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS n_links FROM pages")
def regex_scalars(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"))


@query("safe_names", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'artifact') AS name FROM pages")
def safe_names(spark, d):
    name = F.btrim(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "_"), F.lit("_"))
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(name, F.lit("")), F.lit("artifact")).alias("name"))


@query("keyword_tokens", r"SELECT item_id, n FROM (SELECT item_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 6))) AS n FROM benchmark)")
def keyword_tokens(spark, d):
    """Distinct scenario keywords of six letters and more."""
    tokens = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 6)
    return table(spark, d, "benchmark").select("item_id", F.size(F.array_distinct(tokens)).cast("long").alias("n"))


@query("compact_text", r"SELECT item_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS short FROM (SELECT item_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS t FROM benchmark)")
def compact_text(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.trim(F.regexp_replace("text", "[ \t\n\r]+", " ")).alias("t"))
    return rows.select("item_id", F.when(F.length("t") > 120, F.concat(F.substring("t", 1, 117), F.lit("..."))).otherwise(F.col("t")).alias("short"))


@query("json_props", "SELECT CAST(props->>'$.k' AS INT) // 25 AS bucket, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS INT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy(F.floor(k / 25).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("tolerant_numbers", "SELECT lang, count(TRY_CAST(source AS INT)) AS whole, count(TRY_CAST(substr(source, 4) AS INT)) AS suffixes, greatest(1, least(4, coalesce(max(TRY_CAST(substr(source, 4) AS INT)), 4))) AS clamped FROM documents GROUP BY lang")
def tolerant_numbers(spark, d):
    suffix = F.substring("source", 4, 9).try_cast("int")
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.col("source").try_cast("int")).alias("whole"), F.count(suffix).alias("suffixes"), F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce(F.max(suffix), F.lit(4)))).alias("clamped"))


@query("seed_specs", "SELECT unnest([4101, 4102, 4103, 4104, 4110])::INT AS seed")
def seed_specs(spark, d):
    """A list of seeds and ranges of seeds as rows."""
    spec = spark.createDataFrame([("4101-4104,4110",)], "spec string").select(F.explode(F.split("spec", ",")).alias("part"))
    ends = F.split("part", "-")
    return spec.select(F.explode(F.sequence(ends[0].cast("int"), F.element_at(ends, -1).cast("int"))).alias("seed")).distinct()


@query("parameter_grid", "SELECT lr, rank, seed FROM (SELECT unnest([1e-5, 5e-5, 1e-4]::DOUBLE[]) AS lr) CROSS JOIN (SELECT unnest([8, 16]) AS rank) CROSS JOIN (SELECT unnest([1, 2, 3]) AS seed)")
def parameter_grid(spark, d):
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, (1e-5, 5e-5, 1e-4)))).alias("lr"))
    grid = grid.select("lr", F.explode(F.array(F.lit(8), F.lit(16))).alias("rank"))
    return grid.select("lr", "rank", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seed"))


@query("stable_seeds", "SELECT doc_id, md5(least(source, lang) || '__' || greatest(source, lang)) AS pair_key FROM documents")
def stable_seeds(spark, d):
    """A key of an unordered pair."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat(F.least("source", "lang"), F.lit("__"), F.greatest("source", "lang")).cast("binary")).alias("pair_key"))


@query("label_field_breakdown", f"{_AUDIT} SELECT lang, {q('avg(quality)')} AS quality, {q('avg(toxic)')} AS toxic, {q('avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality IS NULL THEN NULL ELSE 0.0 END)')} AS usable FROM v_audit GROUP BY lang")
def label_field_breakdown(spark, d):
    usable = F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double"))
    return audits(spark, d).groupBy("lang").agg(q6(F.avg("quality")).alias("quality"), q6(F.avg("toxic")).alias("toxic"), q6(F.avg(usable)).alias("usable"))


@query("set_f1", """SELECT conv_id, CAST(2.0 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0) AS DOUBLE) AS f1 FROM (
  SELECT conv_id, list(DISTINCT role) FILTER (turn < 2) AS a, list(DISTINCT role) FILTER (turn >= 2) AS b FROM conversations GROUP BY conv_id) WHERE a IS NOT NULL AND b IS NOT NULL""")
def set_f1(spark, d):
    """Overlap of the roles in a conversation's beginning and its rest."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") < 2, F.col("role"))).alias("a"), F.collect_set(F.when(F.col("turn") >= 2, F.col("role"))).alias("b"))
    rows = rows.filter((F.size("a") > 0) & (F.size("b") > 0))
    return rows.select("conv_id", (2.0 * F.size(F.array_intersect("a", "b")) / (F.size("a") + F.size("b"))).cast("double").alias("f1"))
