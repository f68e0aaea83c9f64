"""Shards against running sums over all records in order."""

import random
import zlib
from collections import Counter

from skylot.llm import sharding
from tests.llm.docs import empty, frame, odd, table


def plain(docs, shards=24):
    rows = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, before, out, slots = sum(r[1] for r in rows), 0, [], Counter()
    for r in rows:
        shard = min(shards - 1, (2 * before + r[1]) * shards // (2 * total))
        out.append((*r, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += r[1]
    return sorted(out, key=str)


def result(docs, **how):
    return sorted(map(tuple, sharding.plan(docs, **how).collect()), key=str)


def test_against_running_sums(spark):
    texts = [r["text"] for r in table("documents", "sf0.01")] + [None, "", "é" * 100, "x" * 300_000]
    docs = frame(spark, texts)
    rows = result(docs)
    assert rows == plain(list(enumerate(texts, 1)))
    bytes_of = Counter()
    for r in rows:
        bytes_of[r[4]] += r[1]
    docs = frame(spark, [t for t in texts if t is None or len(t) < 300_000])
    bytes_of = Counter()
    for r in (rows := result(docs.repartition(5))):
        bytes_of[r[4]] += r[1]
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 2 * max(r[1] for r in rows)


def test_overfull_ranges_are_subdivided(spark):
    """One key holds most rows, one text too, sizes differ widely: no range stays overfull, and they follow one another."""
    rng = random.Random(5)
    ids = [7] * 2000 + [None] * 300 + [rng.randrange(1000) for _ in range(700)]
    texts = ["same"] * 1500 + ["x" * int(10 ** rng.uniform(0, 4)) for _ in range(1500)]
    docs = frame(spark, texts, ids=ids)
    assert result(docs) == plain(list(zip(ids, texts, strict=True)))
    found = sharding.ranged(sharding.records(docs), shards=8, limit=50, fan=4, sample=16).collect()
    counts = Counter(tuple(r["range"]) for r in found)
    weight, total = Counter(), sum(r["size"] for r in found)
    for r in found:
        weight[tuple(r["range"])] += r["size"]
    assert len(found) == 3000 and max(counts.values()) <= 50
    assert all(n == 1 or weight[k] * 16 <= total for k, n in counts.items())
    ordered = sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["tie"]))
    assert [tuple(r["range"]) for r in ordered] == sorted(tuple(r["range"]) for r in found)


def test_odd_rows_and_files(spark, tmp_path):
    docs = odd(spark, "One two")
    assert result(docs) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert result(empty(spark)) == [] and sharding.sharded(empty(spark)).count() == 0
    own = sharding.sharded(docs, shards=2)
    assert own.columns == [*docs.columns, "shard", "slot"]
    assert Counter(map(str, own.select(*(f"`{c}`" for c in docs.columns)).collect())) == Counter(map(str, docs.collect()))
    docs = frame(spark, [r["text"] for r in table("documents")])
    sharding.write(docs, str(tmp_path / "shards"), shards=3, file_rows=20)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in back.collect()) == sorted(
        (r["doc_id"], r["shard"], r["slot"]) for r in sharding.plan(docs, shards=3).collect())
