"""Ranked search against scoring all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylot.llm import search
from tests.llm.docs import empty, frame, odd, table

ITEMS = "item_id long, text string"


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in found]


def plain(docs, items, k=50):
    held = [(d, Counter(w)) for d, t in docs if (w := terms(t))]
    count, total, df = len(held), sum(c.total() for _, c in held), Counter(x for _, c in held for x in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    rows = []
    for i, words in asked.items():
        scores = []
        for d, c in held:
            m = 50 + 50 * c.total() * count // total
            scores.append((sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x in words if x in c), d))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        rows += [(i, at, d, s) for at, (s, d) in enumerate(best, 1)]
    return sorted(rows, key=str)


def result(spark, docs, items, **how):
    return sorted(map(tuple, search.searched(docs, spark.createDataFrame(items, ITEMS), **how).collect()), key=str)


@pytest.mark.parametrize("k", [50, 3])
def test_against_scoring_all_documents(spark, k):
    items = [(r["item_id"], r["text"]) for r in table("benchmark")] + [(-1, None), (-2, "?!"), (-3, "Éa nowhere"), (None, "the the THE")]
    texts = [r["text"] for r in table("documents")] + [None, "", "...", "Éa éA the", "the " * 3000, *["copy of one passage"] * 60]
    docs = frame(spark, texts)
    assert result(spark, docs, items, k=k) == plain(list(enumerate(texts, 1)), items, k)


def test_blocks_of_items_and_many_tasks(spark):
    items = [(i % 17, f"w{i % 13} w{i % 7} w{i % 29}") for i in range(60)]
    texts = [" ".join(f"w{i * j % 31}" for j in range(1 + i % 23)) for i in range(700)]
    docs = frame(spark, texts).repartition(70)
    assert result(spark, docs, items, k=5, item_terms=60) == result(spark, docs, items, k=5) == plain(list(enumerate(texts, 1)), items, 5)


def test_bytes_bound_impacts_from_above_by_less_than_a_step(spark):
    posted = search.postings(frame(spark, ["a b a", "b " * 400, "c", "a " * 9]), (b"a", b"b"))
    documents, n = posted.agg(F.count(F.lit(1)), F.sum("n")).first()
    for r in search.indexed(posted, documents, n).collect():
        exact = search._impacts(np.full(len(r["tfs"]), r["n"]), np.array(r["tfs"], np.int64), documents, n)
        level = np.frombuffer(bytes(r["bytes"]), np.uint8).astype(int) * search.STEP
        assert ((exact <= level) & (level < exact + search.STEP)).all() and len(level) == len(r["terms"])


def test_odd_rows(spark):
    docs = odd(spark, "One two")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "two"), (1, "two one"), (2, "")]
    assert result(spark, docs, items) == plain(rows, items)
    assert result(spark, empty(spark), items) == result(spark, docs, []) == result(spark, docs, [(1, None)]) == []
