import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylot.llm import shingles
from tests.llm.docs import empty, frame, odd, table


def sets_of(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n=4, percent=85):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    found = [(i, sets_of(t, n)) for i, t in rows]
    root = list(range(len(found)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][1], found[b][1]
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(found):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i, len(s), least[top(k)]) for k, (i, s) in enumerate(found))


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_all_documents_against_brute_force(spark, n, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(shingles.joined(docs, n, percent)) == brute([(r["doc_id"], r["text"]) for r in table("documents")], n, percent)


def test_chains_and_edited_copies_at_the_threshold(spark):
    draw, words = random.Random(3), [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        text = [draw.choice(words) for _ in range(draw.randint(3, 260))]
        texts.append(" ".join(text))
        for _ in range(8):  # each copy edits the one before: links form chains
            text = list(text)
            for _ in range(draw.randint(0, 1 + len(text) // 40)):
                text[draw.randrange(len(text))] = draw.choice(words)
            texts.append(" ".join(text).upper())
    rows = list(enumerate(texts, 10))
    assert got(shingles.joined(frame(spark, texts, [i for i, _ in rows]))) == brute(rows)


def test_one_large_group_of_near_copies_and_a_common_passage(spark):
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    core = [f"c{i}" for i in range(120)]
    texts = []
    for k in range(120):
        near = list(core)
        near[draw.randrange(120)] = f"x{k}"
        texts.append(" ".join(near))
        texts.append(passage + " " + " ".join(f"o{draw.randrange(10**6)}" for _ in range(40)))
    rows = list(enumerate(texts, 1))
    assert got(shingles.joined(frame(spark, texts))) == brute(rows)


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingles.joined(odd(spark, "one two Three four five")).collect()]
    assert sorted(rows, key=str) == sorted([(1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 2, None)], key=str)
    assert shingles.joined(empty(spark)).count() == 0


def test_a_document_of_several_texts_links_with_what_any_of_them_links_with(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = frame(spark, [a, a, b, b, a + " more", None, "c d e f g"], [3, 5, 5, 7, 9, 9, None])
    rows = sorted(((r["doc_id"], r["component_id"]) for r in shingles.joined(docs).collect()), key=str)
    assert rows == sorted([(3, 3), (5, 3), (5, 3), (7, 3), (9, 3), (9, 3), (None, None)], key=str)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_no_block_of_random_sets_is_crowded(n, percent):
    draw, seen = np.random.default_rng(4), {}
    for size in (40, 50, 85, 100, 500):
        for _ in range(400):
            for key in shingles.block_keys(np.unique(draw.integers(0, 2**64, size, np.uint64)), percent).tolist():
                seen[key] = seen.get(key, 0) + 1
    assert max(seen.values()) <= 40, max(seen.values())


def test_long_sets_have_long_sketches():
    draw = np.random.default_rng(5)
    a, b = (np.unique(draw.integers(0, 2**64, k, np.uint64)) for k in (9000, 7900))
    near = np.unique(np.concatenate([a[:8600], b[:100]]))
    far = shingles.apart([shingles.sketch(a)] * 2, [shingles.sketch(b), shingles.sketch(near)])
    assert far[0] > 15 * (len(a) + len(b)) / 185 and far[1] <= len(np.setxor1d(a, near))
    small = shingles.sketch(a[:3000])
    assert shingles.apart([small], [shingles.sketch(a[:5000])])[0] <= 2000


def test_deduplicated_keeps_one_of_each_component_and_all_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = shingles.deduplicated(docs)
    expected = [i for i, _, c in brute([(r["doc_id"], r["text"]) for r in table("documents")]) if i == c]
    assert sorted(r["doc_id"] for r in kept.collect()) == expected
    assert kept.columns == docs.columns
    assert shingles.deduplicated(odd(spark, "a b c d e f")).count() == 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=300, unique=True), st.integers(0, 40))
def test_a_linked_pair_shares_a_block(base, cut):
    """Pigeonhole: sets that link have a common key, whatever their sizes."""
    full = shingles.mixed_bits(np.array(sorted(base), np.uint64))
    less = np.unique(full[min(cut, len(full) - 1):])
    full = np.unique(full)
    if 100 * len(less) >= 85 * len(full) and len(less) < len(full):
        assert np.intersect1d(shingles.block_keys(full), shingles.block_keys(less)).size


def test_sketches_bound_the_symmetric_difference():
    a = shingles.shingles(" ".join(map(str, range(300))))
    b = shingles.shingles(" ".join(map(str, range(20, 330))))
    assert 0 < shingles.apart([shingles.sketch(a)], [shingles.sketch(b)])[0] <= len(np.setxor1d(a, b))


def prefixes(spark, texts, percent=85):
    """Pairs that meet in a key of the rarest blocks, as places of texts, and in all shared blocks."""
    found = shingles.sets(frame(spark, texts), 4, percent).cache()
    of = {r["class"]: r["doc_id"] - 1 for r in found.collect()}
    shared = shingles.shared_blocks(found).cache()
    meet = []
    for rows in (shingles.rarest(shared, found), shared):
        by = {}
        for r in rows.collect():
            by.setdefault(r["key"], set()).add(of[r["class"]])
        meet.append(sum(len(v) * (len(v) - 1) // 2 for v in by.values()))
        pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
        meet.append(pairs)
    return meet


def test_linked_pairs_meet_in_their_rarest_blocks(spark):
    draw, texts = random.Random(12), []
    for _ in range(10):
        text = [f"w{draw.randrange(3000)}" for _ in range(draw.randint(5, 200))]
        for _ in range(7):
            text = list(text)
            for _ in range(draw.randint(0, len(text) // 30)):
                text[draw.randrange(len(text))] = f"w{draw.randrange(3000)}"
            texts.append(" ".join([*text, *(f"z{draw.randrange(99)}" for _ in range(draw.randint(0, 3)))]))
    texts = list(dict.fromkeys(texts))
    for percent in (85, 80):
        _, few, _, every = prefixes(spark, texts, percent)
        sets = [sets_of(t, 4) for t in texts]
        linked = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert linked and linked <= few <= every


def test_a_shared_passage_brings_pairs_in_proportion(spark):
    """60 % in common (similarity 0.43): nothing links, and twice the texts bring about twice the pairs, not four times."""
    draw, counts = random.Random(6), {}
    passage = [f"p{i}" for i in range(120)]
    for n in (150, 300):
        texts = [" ".join([*passage, *(f"o{draw.randrange(10**7)}" for _ in range(80))]) for _ in range(n)]
        few, _, every, _ = prefixes(spark, texts)
        counts[n] = few
        assert every > 20 * n and few <= every / 20
    assert counts[300] <= 2.5 * counts[150] + 100


def test_crowded_blocks_keep_links_and_make_no_other_pairs(spark, monkeypatch):
    """Many texts share most of a passage (similarity 0.7 to 0.85, so no link), among them pairs that do link; small pieces."""
    monkeypatch.setattr(shingles, "CROWD", 3)
    monkeypatch.setattr(shingles, "SPLIT", 16)
    draw = random.Random(21)
    passage = [f"p{i}" for i in range(150)]
    texts = []
    for k in range(110):
        own = [f"o{draw.randrange(10**7)}" for _ in range(draw.randint(16, 30))]
        texts.append(" ".join(passage + own))
        if k % 10 == 0:
            own[draw.randrange(len(own))] = "changed"
            texts.append(" ".join(passage[2:] + own))
    rows = list(enumerate(texts, 1))
    assert got(shingles.joined(frame(spark, texts))) == brute(rows)
