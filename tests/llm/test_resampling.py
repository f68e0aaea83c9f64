"""Importance resampling against a plain version, and merges against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skylot.llm import resampling, terms
from tests.llm.docs import ODD, empty, frame, odd, table

AIMS = "item_id long, text string"


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain(docs, aims, least=20, percent=25):
    s = Counter(b for _, t in docs for b in features(t)[1])
    t = Counter(b for x in aims for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    rows = []
    for doc, text in docs:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    place = {id(r): i for i, r in enumerate(fit[:percent * len(fit) // 100], 1)}
    return sorted(((*r[:4], place.get(id(r))) for r in rows), key=str)


def result(spark, docs, aims, **how):
    aims = spark.createDataFrame(list(enumerate(aims)), AIMS)
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resampling.resampled(docs, aims, **how).collect()), key=str)


def test_against_a_plain_version(spark):
    aims = [r["text"] for r in table("benchmark")] + [None, ""]
    texts = [r["text"] for r in table("documents")] + [None, "", "É é Straße " * 30, "x" * 70 + " " + "y" * 200 + " z", "a b " * 500]
    docs = frame(spark, texts)
    expected = plain(list(enumerate(texts, 1)), aims)
    assert result(spark, docs, aims) == expected
    assert result(spark, docs.repartition(9), aims) == expected  # reruns agree


def test_many_ranges_runs_and_trees_give_the_ranks_of_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(400)]), 0, rng.randrange(15, 40), rng.randrange(5), 0, rng.randrange(-30, 30)) for _ in range(3000)]
    scored = spark.createDataFrame(rows, resampling.WEIGHED + ", score long").repartition(16)
    fit = sorted((r for r in rows if r[2] >= 20), key=lambda r: (-r[5], r[0] is None, r[0] or 0, r[3]))
    want = [(r[5], r[0], r[3]) for r in fit[:40 * len(fit) // 100]]
    got = resampling.ranked(scored, percent=40, range_rows=100).collect()
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert len(got) == 3000 and [r["rank"] for r in drawn] == list(range(1, len(want) + 1))
    assert [(r["score"], r["doc_id"], r["n_features"]) for r in drawn] == want


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64, 65, 300])
def test_trees_of_losers_merge_as_sorting_does(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50), i) for i in range(rng.randrange(20))) for _ in range(k)]
    for stop in (0, 1, 17, 10_000):
        assert resampling.merged(runs, stop, fan_in=4) == sorted(x for r in runs for x in r)[:stop]


def test_checks_of_pairs_are_those_of_joined_words():
    words = [b"a", b"b" * 46, b"c" * 47, b"d" * 48, b"e" * 300, b"\xc3\xa9", b"zz"]
    alone, pairs, first = terms.Checks().of(words, np.array([0, 5]))
    assert alone.tolist() == [zlib.crc32(w) for w in words]
    assert first.tolist() == [0, 1, 2, 3, 5]
    assert pairs.tolist() == [zlib.crc32(words[i] + b" " + words[i + 1]) for i in first]


def test_odd_rows(spark):
    text = "one two three " * 10
    docs = odd(spark, text)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(spark, docs, ["two three four"], percent=50) == plain(rows, ["two three four"], percent=50)
    assert result(spark, docs, []) == plain(rows, [])
    assert result(spark, empty(spark), ["a"]) == []
    aims = spark.createDataFrame([(1, "two")], AIMS)
    kept = resampling.drawn(docs, aims, percent=100)
    assert kept.columns == [*docs.columns, "rank"] and sorted(r["rank"] for r in kept.collect()) == [1, 2, 3]
    assert {r["text"] for r in kept.collect()} == {text} and ODD.count(",") + 2 == len(kept.columns)
