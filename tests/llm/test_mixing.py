import re
from collections import Counter, defaultdict

from skylot.llm import mixing
from tests.llm.docs import empty, frame, odd, table

WEIGHTS = (3, 1, 2)


def targets(sizes):
    """By source: water filling, one source settled at a time."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, left, full = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        level = max(0.0, left - sum(full.values())) / sum(weight[s] for s in open_) if open_ else 0
        above = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not above:
            return {s: full.get(s, weight[s] * level) for s in order}
        full |= {s: 2 * sizes[s] for s in above}


def check(rows, docs):
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t, _ in docs]
    total, taken, longest = Counter(), Counter(), defaultdict(int)
    for n, (_, s) in zip(count, docs, strict=True):
        total[s] += n
        longest[s] = max(longest[s], n)
    expected = targets(total)
    assert sorted(r["size"] for r in rows) == sorted(count)
    for r in rows:
        assert r["source_size"] == total[r["source"]] and abs(r["target"] - expected[r["source"]]) <= 1e-6 * max(1, expected[r["source"]])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - expected[s]) <= max(longest[s], 0.02 * expected[s]), (s, n, expected[s])


def test_all_documents_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_plan(docs).collect()
    check(rows, [(r["text"], r["source"]) for r in table("documents", "sf0.01")])
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_plan(docs.repartition(7)).collect()), key=str)  # reruns agree


def test_many_blocks_and_a_tree_of_residuals(spark):
    texts = ["w " * (1 + i * i % 37) for i in range(5000)]
    sources = ["a" if i % 3 else "b" if i % 2 else None for i in range(5000)]
    rows = mixing.mix_plan(frame(spark, texts, sources=sources)).collect()
    check(rows, list(zip(texts, sources, strict=True)))


def test_copies_are_drawn_without_bias(spark):
    texts = ["w " * (5 + i % 9) for i in range(60)]
    docs = frame(spark, texts, sources=["a" if i % 2 else "b" for i in range(60)])
    sized = mixing.sizes(docs).cache()
    mean = Counter()
    for seed in range(12):
        for r in mixing.copies(sized, seed=seed).collect():
            mean[r["source"]] += r["copies"] / 12
    plan = {r["source"]: r["target"] / r["source_size"] for r in mixing.mix_plan(docs).collect()}
    for s, rate in plan.items():
        assert abs(mean[s] / 30 - rate) < 0.1


def test_odd_rows(spark):
    docs = odd(spark, "one two")
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == 6 and {r["source"] for r in rows} == {"web", None}
    twice = [r["taken"] for r in rows if r["doc_id"] == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_plan(empty(spark)).count() == mixing.mixed(empty(spark)).count() == 0
