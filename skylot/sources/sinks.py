"""Split datasets with a manifest, and small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on whatever file system the path is of, in place of one that is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def split_json(rows: DataFrame, path: str, by: str, parts: tuple[str, ...], source: str = "") -> dict:
    """One folder of JSON lines a part (path/by=part), and path/manifest.json with each part's count, 0 for one without rows. Rows
    are gone through once: what is counted is what is written, and the manifest comes last, so that where it is, all is."""
    spark, seen = rows.sparkSession, Observation("split")
    part = F.col(by)
    counted = [F.count_if(part == p).alias(f"n{i}") for i, p in enumerate(parts)]
    rows.observe(seen, F.count(F.lit(1)).alias("total"), *counted).write.mode("overwrite").partitionBy(by).json(path)
    found = seen.get
    manifest = {"source_file": source, "output_dir": path, "counts": {p: found[f"n{i}"] for i, p in enumerate(parts)},
                "files": {p: f"{path}/{by}={p}" for p in parts}, "total_windows": found["total"]}
    if sum(manifest["counts"].values()) != manifest["total_windows"]:
        raise ValueError(f"some rows have a {by} that isn't one of {', '.join(parts)}")
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2) + "\n")
    return manifest


def _few(rows: DataFrame, limit: int) -> list:
    """All rows of a report; more than limit of them fail, for nothing may be left out of it."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return found


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A report's rows as a Markdown table."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in _few(rows, limit))])


def json_report(rows: DataFrame, limit: int = 1000) -> str:
    """A report's rows as one indented JSON list."""
    found = _few(rows.select(F.to_json(F.struct("*")).alias("row")), limit)
    return json.dumps([json.loads(r["row"]) for r in found], ensure_ascii=False, indent=2)


def csv_report(rows: DataFrame, path: str, limit: int = 100_000) -> None:
    """A report as one CSV file with a header and a byte order mark, which spreadsheets read as UTF-8."""
    quote = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"' if any(c in str(v) for c in ',"\n\r') else str(v)
    lines = [",".join(map(quote, r)) for r in [rows.columns, *_few(rows, limit)]]
    write_text(rows.sparkSession, path, "\ufeff" + "\r\n".join(lines) + "\r\n")
