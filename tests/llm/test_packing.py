import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skylot.llm import packing
from skylot.llm.queries import vocabulary
from tests.llm.docs import empty, frame, odd, table


def check(rows, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in docs}
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(parts):
            assert start == at and total == len(ids[doc]) and crc == zlib.crc32(np.array(ids[doc][at:at + length], "<u4").tobytes())
            at += length
        assert at == len(ids[doc])
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    tokens = sum(map(len, ids.values()))
    return 1 - tokens / (len(windows) * packing.WINDOW), tokens


def test_every_id_lies_in_one_piece_with_little_padding(spark):
    docs = [(r["doc_id"], r["text"]) for r in table("documents", "sf0.01")]
    padding, tokens = check(packing.pack(frame(spark, [t for _, t in docs], [i for i, _ in docs]), vocabulary()).collect(), docs)
    assert padding * tokens < packing.WINDOW + 0.01 * tokens


def test_ids_of_odd_texts(spark):
    texts = ["", None, " \n\t", "It's 2024’s “naïve” test… ½ ² ª", "<|endoftext|> x <|startoftext|>", "\x00a\x00", "日本語 text 😀", "don't WE'LL i'm", "a" * 3000, "\x85\xa0x", "ß ẞ İ ǅ",
             "x " * 9000, "é ­ soft", "''' ``", "µ º 9¾"]
    check(packing.pack(frame(spark, texts), vocabulary()).collect(), list(enumerate(texts, 1)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4096), min_size=1, max_size=60))
def test_fill_packs_each_piece_once(lengths):
    windows = packing.fill(np.array(lengths))
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in w) <= packing.WINDOW for w in windows)
    light = [sum(lengths[i] for i in w) for w in windows]
    assert sum(x <= packing.WINDOW // 2 for x in light) <= 1  # two half-empty ones would have been one


def test_each_tier_is_packed_into_contexts_of_its_own_size(spark):
    rows = packing.pack(frame(spark, ["w " * (50 + 37 * i % 3000) for i in range(400)]), vocabulary()).collect()
    found, windows = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["tier"] <= r["context"] and r["context_start"] % r["context"] == 0
        found[r["sequence_id"], r["context_start"], r["context"]].append((r["context_offset"], r["length"], r["tier"]))
        windows[r["sequence_id"]].add((r["context_start"], r["context"]))
    assert {size for _, _, size in found} >= {1024, 2048, 4096}
    for (_, _, size), parts in found.items():
        parts.sort()
        assert parts[0][2] == size  # the piece that opens a context is of its tier
        assert [at for at, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n, _ in parts) <= size
    for tiles in windows.values():
        assert all(a + size <= b for (a, size), (b, _) in zip(sorted(tiles), sorted(tiles)[1:]))
        assert max(a + size for a, size in tiles) <= packing.WINDOW


def test_step_groups_cost_alike(spark):
    rows = packing.pack(frame(spark, ["w " * (50 + 37 * i % 3000) for i in range(400)]), vocabulary()).collect()
    cost = defaultdict(int)
    for r in rows:
        cost[r["step_group"]] += r["length"]
    assert max(cost.values()) - min(cost.values()) <= packing.WINDOW


def test_equal_rows_spread_over_blocks(spark):
    copies = 100_000
    found = spark.range(copies).selectExpr("CAST(NULL AS long) doc_id", "0L start", "1L length", "7L ids_crc32", "1L doc_tokens")
    found = found.union(spark.range(3000).selectExpr("id", "0L", "id + 1", "id", "id + 1"))
    parts = packing.dealt(found)
    sizes = {r["block"]: r["n"] for r in parts.groupBy("block").agg({"copies": "sum"}).toDF("block", "n").collect()}
    assert sum(sizes.values()) == copies + 3000 and len(sizes) == 26 and max(sizes.values()) < 4 * packing.BLOCK
    rows = packing.packed(found).collect()
    assert len(rows) == copies + 3000 and sum(r["doc_id"] is None for r in rows) == copies
    windows, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        groups[r["step_group"]].add(r["sequence_id"])
    assert {s % 26 for s in windows} == set(sizes) and max(map(len, groups.values())) <= packing.STEPS
    for parts in windows.values():
        parts.sort()
        assert [at for at, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= packing.WINDOW


def test_odd_rows(spark):
    rows = packing.pack(odd(spark, "one two"), vocabulary()).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 3), (1, 3), (1, 3), (2, 1), (3, 1), (4, 1)]
    assert packing.pack(empty(spark), vocabulary()).count() == 0
