"""Logs of solver runs, read in ranges of lines: a long log is many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylot.operators.carry import running
from skylot.sources.staging import staged

_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[Ee][+-]?\d+)?"
FOUND = rf"(?i)Found incumbent of value\s+({_NUMBER}).*?after\s+({_NUMBER})\s+sec"
CLOCK = r"(?i)Time\s*=\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))"
NODE = rf"^\s*\*\s+\S+\s+\S+\s+({_NUMBER})"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, block, at, value): a range of a file as the reader cuts it is a block, and at counts up in it."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("at"), "value")


def _number(pattern: str, i: int = 1):
    return F.nullif(F.regexp_extract("value", pattern, i), F.lit("")).try_cast("double")


def incumbents(lines: DataFrame) -> DataFrame:
    """(log, block, at, value) -> (log, elapsed_time_s, objective_value): the solutions a run found, at the time a line gives or
    else at the last time before it. A pair of time and value (to six places) counts once, where it comes first, and a line
    that repeats one leaves the clock alone. Whether a line repeats one depends on the clock at the lines before, so it is
    worked out anew until nothing changes; logs without such knots need one round."""
    rows = lines.select("log", "block", "at", _number(FOUND).alias("value_found"), _number(FOUND, 2).alias("second"), _number(CLOCK).alias("clock"), _number(NODE).alias("value_node"))
    rows = rows.withColumns({c: F.when(F.col("value_found").isNull(), F.col(c)) for c in ("clock", "value_node")})
    rows = rows.filter("value_found IS NOT NULL OR clock IS NOT NULL OR value_node IS NOT NULL")
    first = F.min(F.struct("block", "at"))
    rounded = lambda c: F.round(c, 6)
    objective = F.coalesce("value_found", "value_node")
    known = rows.filter("value_found IS NOT NULL").groupBy("log", rounded("second").alias("s"), rounded("value_found").alias("o")).agg(first.alias("f"))
    new = known.select("log", "f.block", "f.at", F.lit(True).alias("new"))
    rows = staged(rows.join(new, ["log", "block", "at"], "left").withColumn("new", F.coalesce("new", F.lit(False))), "lines")
    while True:
        timed = running(rows, ["log"], "block", ["at"], {"last": ("last", F.coalesce("clock", F.when(F.col("new"), F.col("second"))))})
        found = timed.filter("value_found IS NOT NULL OR value_node IS NOT NULL").withColumn("time", F.when(F.col("value_found").isNotNull(), F.col("second")).otherwise(F.coalesce("last", F.lit(0.0))))
        keyed = staged(found.select("log", "block", "at", rounded("time").alias("time"), objective.alias("objective"), "new", F.col("value_found").isNotNull().alias("found")), "found")
        of_key = keyed.groupBy("log", "time", rounded("objective").alias("o")).agg(F.min_by(F.struct("block", "at", "objective"), F.struct("block", "at")).alias("f"))
        firsts = staged(of_key.select("log", "f.block", "f.at", "time", "f.objective"), "firsts")
        seen = keyed.filter("found").join(firsts.select("log", "block", "at", F.lit(True).alias("is_first")), ["log", "block", "at"], "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))
        changed = seen.filter("is_first <> new").select("log", "block", "at", "is_first")
        if changed.isEmpty():
            return firsts.select("log", F.col("time").alias("elapsed_time_s"), F.col("objective").alias("objective_value"))
        rows = staged(rows.join(changed, ["log", "block", "at"], "left").withColumn("new", F.coalesce("is_first", "new")).drop("is_first"), "lines")


def convergence(trace: DataFrame, width: float) -> DataFrame:
    """(log, elapsed_time_s, objective_value) -> (time, n_runs, best, mean_best): at each time at which some run finds a better
    solution, how many runs have one, the best of all and the mean of the runs' best; each run's last value is carried on.
    Runs aren't spread over all times: each improvement adds what it changes, and the changes are summed along the one axis.
    width: seconds of a block."""
    cut = trace.withColumn("block", F.floor(F.col("elapsed_time_s") / width))
    cut = cut.groupBy("log", "block", "elapsed_time_s").agg(F.min("objective_value").alias("value"))
    best = running(cut, ["log"], "block", ["elapsed_time_s"], {"best": ("min", F.col("value"))})
    before = running(best.withColumn("next_to", F.col("best")), ["log"], "block", ["elapsed_time_s"], {"n": ("sum", F.lit(1))})
    # the best before a row: that of the row before, in its block or carried
    steps = staged(before.select("log", "block", "elapsed_time_s", "best", "n"), "steps")
    last = steps.select("log", (F.col("n") + 1).alias("n"), F.col("best").alias("was"))
    better = steps.join(last, ["log", "n"], "left").filter("was IS NULL OR best < was")
    changes = better.groupBy("block", F.col("elapsed_time_s").alias("time")).agg(F.count_if(F.col("was").isNull()).alias("runs"), F.sum(F.col("best") - F.coalesce("was", F.lit(0.0))).alias("by"), F.min("best").alias("least"))
    along = running(changes, [], "block", ["time"], {"n_runs": ("sum", F.col("runs")), "total": ("sum", F.col("by")), "low": ("min", F.col("least"))})
    return along.select("time", "n_runs", F.col("low").alias("best"), (F.col("total") / F.col("n_runs")).alias("mean_best"))
