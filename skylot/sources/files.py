"""Readers and writers for the record files: JSON lines, windows of demands, weight files, logs, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

_BAD = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """Records of a JSON-lines file. Strict: a malformed line fails; else it is kept in _corrupt_record,
    to be counted and dropped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = StructType([*schema.fields, StructField(_BAD, StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)


def event_manifest(spark: SparkSession, path: str, record: StructType) -> DataFrame:
    """Events of a .jsonl file, or of a .json file that is a list or holds one under event_manifest."""
    if path.endswith(".jsonl"):
        return json_lines(spark, path, record)
    if not path.endswith(".json"):
        raise ValueError(f"neither .json nor .jsonl: {path}")
    text = spark.read.text(path, wholetext=True)
    array = f"array<{record.simpleString()}>"
    listed = F.from_json("value", array)
    held = F.from_json("value", f"event_manifest {array}")["event_manifest"]
    return text.select(F.inline(F.when(F.trim("value").startswith("["), listed).otherwise(held)))


def weight_files(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Weight configurations of a folder, a file each; of a window's files the last by name counts."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(f"{folder}/*.json").withColumn("file", F.col("_metadata.file_name"))
    newest = Window.partitionBy("time_window").orderBy(F.desc("file"))
    return rows.withColumn("_place", F.rank().over(newest)).filter("_place = 1").drop("_place")


def per_demand_results(results: DataFrame) -> DataFrame:
    """The fact table: a row a window and demand."""
    return results.select("time_window", F.inline("per_demand_results"))


def windows(rows: DataFrame) -> DataFrame:
    """Windows of demands as rows (time_window, place, demand fields)."""
    return rows.select("time_window", F.posexplode("demands").alias("place", "d")).select("time_window", "place", "d.*")


def latest_run(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """The records of the run folders that a pattern names, of the last folder by name."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(pattern).withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    last = rows.agg(F.max("run").alias("run"))
    return rows.join(F.broadcast(last), "run", "left_semi")  # last is one row


#: A comma before a closing bracket.
TRAILING = r",\s*([}\]])"


def with_json(rows: DataFrame, said: str, name: str) -> DataFrame:
    """rows with the JSON text in a column said, without code fences: as it is, from its first bracket to its last, or either
    without trailing commas; null if none of them is JSON."""
    from skylot.functions.records import SLICED, let

    forms = let(f"struct(x AS whole, {SLICED.format(x='x')} AS slice)", rf"array(x.whole, x.slice, regexp_replace(x.whole, r'{TRAILING}', '$1'), regexp_replace(x.slice, r'{TRAILING}', '$1'))")
    return rows.withColumn(name, F.expr(let(said, f"get(filter({forms}, f -> try_parse_json(f) IS NOT NULL), 0)")))


def numbered(lines: DataFrame, log: str, order: str) -> DataFrame:
    """lines with line_no, from 1 in each log."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(log).orderBy(order)))


def log_scalars(lines: DataFrame) -> DataFrame:
    """(log, line_no, value) -> (log, key, step, value): the numbers of a training log's lines, by series; a line without a
    step counts by its number; series of one value are left out."""
    step = F.coalesce(F.nullif(F.regexp_extract("value", "step[:=]([0-9]+)", 1), F.lit("")).try_cast("int"), F.col("line_no"))
    found = F.arrays_zip(F.regexp_extract_all("value", F.lit("([A-Za-z_]+)[:=] ?([0-9.]+)"), F.lit(1)).alias("key"), F.regexp_extract_all("value", F.lit("([A-Za-z_]+)[:=] ?([0-9.]+)"), F.lit(2)).alias("number"))
    rows = lines.select("log", step.alias("step"), F.explode(found).alias("f")).select("log", F.lower("f.key").alias("key"), "step", F.col("f.number").try_cast("double").alias("value")).filter("value IS NOT NULL")
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("log", "key"))).filter("_n >= 2").drop("_n")


def cache_counters(lines: DataFrame) -> DataFrame:
    """(log, value) -> hits, misses and hit rate in per cent of each log's path cache."""
    hit, miss = F.count_if(F.contains("value", F.lit("[Path Cache] (disk)"))), F.count_if(F.col("value").rlike("\\[Path Cache [0-9]+\\] computing"))
    return lines.groupBy("log").agg(hit.alias("hits"), miss.alias("misses")).withColumn(
        "hit_rate", F.when(F.col("hits") + F.col("misses") > 0, 100.0 * F.col("hits") / (F.col("hits") + F.col("misses"))))


def step_timings(lines: DataFrame, first: int, second: int) -> DataFrame:
    """(log, value) -> (log, seconds): from the last mark of a step to that of another."""
    at = F.unix_timestamp(F.nullif(F.regexp_extract("value", "^([0-9-]+ [0-9:]+)", 1), F.lit("")))
    step = F.regexp_extract("value", "Step ([0-9]+)", 1)
    mark = lambda n: F.max(F.when(step == str(n), at))
    return lines.groupBy("log").agg((mark(second) - mark(first)).cast("long").alias("seconds"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
