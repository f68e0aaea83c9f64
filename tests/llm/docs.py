"""Small document tables with every odd case, shared by the tests."""

from __future__ import annotations

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside, and one that clashes with a Spark function.
ODD = "doc_id long, text string, lang string, source string, n_chars long, spans string, base string, _s string, _copies int, `a.b` int, size int"


def table(name: str, sf: str = "sf0.001") -> list[dict]:
    return pq.read_table(f"/root/testdata/{sf}/{name}.parquet").to_pylist()


def frame(spark, texts, ids=None, sources=None):
    ids = ids or list(range(1, len(texts) + 1))
    sources = sources or ["web"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


def odd(spark, text):
    """Rows with nulls everywhere, repeated rows, and further columns with clashing names."""
    rows = [(1, text, "en", "web", 3, "x", "y", "z", 7, 1, 2), (1, text, "en", "web", 3, "x", "y", "z", 7, 1, 2),
            (2, None, None, None, None, None, None, None, None, None, None), (3, "", "en", "web", 0, "", "", "", 0, 0, 0),
            (None, text, None, None, None, None, None, None, None, None, None), (4, " \t\n", "en", None, 3, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
