import numpy as np

from skylot.llm import vectors
from tests.llm.docs import table

SCHEMA = "vec_id long, embedding array<float>, label int, bands string, part int"


def brute(rows, threshold=0.93):
    fine = [(i, np.array(v, float), g) for i, v, g in rows
            if v is not None and g is not None and i is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    links = {i: set() for i, _, _ in rows}
    for k, (i, v, g) in enumerate(fine):
        for j, w, h in fine[:k]:
            if g == h and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, front = {i}, [i]
        while front:
            front = [y for x in front for y in links[x] if y not in seen and not seen.add(y)]
        out[i] = (len(links[i]), min(seen, key=lambda x: (x is None, x)))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, v, g, "b", 1) for i, v, g in rows], SCHEMA)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.linked(df).collect()}


def test_all_vectors_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table("embeddings", "sf0.01")]
    assert check(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(1, a, 1), (2, b, 1), (3, a, 2), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 2.0], 1), (7, [float("nan"), 1.0, 1.0], 1),
            (8, [float("inf"), 1.0, 1.0], 1), (9, a, None), (10, [1.0, 2.0], 1), (11, [], 1), (12, a, 1), (13, [1e-30, 2e-30, 3e-30], 1), (None, a, 1)]
    assert check(spark, rows) == brute(rows)
    assert vectors.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_are_vectors_of_their_own(spark):
    a, b, c = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [-3.0, 1.0, 0.5]
    rows = [(1, a, 0), (1, a, 0), (1, b, 0), (2, a, 0), (3, b, 0), (1, c, 0), (4, c, 0), (5, c, 1)]
    df = spark.createDataFrame([(i, v, g, "b", 1) for i, v, g in rows], SCHEMA)
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.linked(df).collect())
    assert found == [(1, 1, 1, True), (1, 4, 1, True), (1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 1, 1, False), (5, 0, 5, True)]


def test_a_third_of_equal_vectors_is_compared_once(spark):
    draw = np.random.default_rng(7)
    other = [(i, draw.standard_normal(8).tolist(), 0) for i in range(1000, 2000)]
    rows = [(i, [1.0] * 8, 0) for i in range(500)] + other
    found = check(spark, rows)
    assert all(found[i] == (499, 0) or found[i][0] > 499 for i in range(500)) and found == brute(rows)


def test_recall_in_a_label_of_many_vectors(spark):
    """Random directions with near copies about the threshold: buckets, chunks and tables are at work."""
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((900, 24))
    copies = np.concatenate([centres + draw.standard_normal(centres.shape) * s for s in (0.0, 0.2, 0.27, 0.33)]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(copies)]
    found, expected = check(spark, rows), {}
    unit = copies.astype(float) / np.linalg.norm(copies.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    expected = {i: int(near[i].sum()) - 1 for i in range(len(rows))}
    assert all(found[i][0] <= n for i, n in expected.items())
    assert sum(x[0] for x in found.values()) >= 0.995 * sum(expected.values())


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(2)
    a = vectors.unit_rows(list(draw.standard_normal((300, 64))))
    b = vectors.unit_rows(list(a + 0.05 * draw.standard_normal(a.shape)))
    signs, factor = vectors.codes(a)
    estimate = np.mean([(signs[:, r] * (b @ vectors.rotation(64, r).T)).sum(1) / (factor[:, r] * 8) for r in range(vectors.ROTATIONS)], 0)
    true = (a * b).sum(1)
    assert abs((estimate - true).mean()) < 0.01
    spread = np.sqrt(np.maximum(0, 1 / (factor * factor) - 1).mean(1) / 63 / vectors.ROTATIONS)
    assert (np.abs(estimate - true) <= vectors.DEVIATIONS * spread).mean() > 0.99


def test_stored_codes_estimate_as_well_as_their_bound_says():
    """Through the stored bytes: four bits a component, odd dimensions, and keys that need more rotations."""
    draw = np.random.default_rng(3)
    for dimension, bits, tables in ((64, 4, 9), (33, 3, 80)):
        a = draw.standard_normal((200, dimension))
        unit = vectors.unit_rows(list(np.concatenate([a, a + 0.3 * draw.standard_normal(a.shape)])))
        code, bands = vectors.stored(unit, vectors.ROTATIONS, bits, tables)
        assert code.shape[1] == -(-vectors.turns(dimension, vectors.ROTATIONS, bits, tables) * dimension // 8) + 4 * (vectors.ROTATIONS + 1) + -(-dimension // 2)
        *parts, again = vectors.opened(code, dimension, vectors.ROTATIONS, bits, tables)
        assert (again == bands).all() and bands.shape == (400, tables)
        estimate, variance = vectors.estimates(*parts)
        off = (estimate - unit @ unit.T)[np.triu_indices(400, 1)]
        bound = vectors.DEVIATIONS * np.sqrt((variance[:, None] + variance) / 2)[np.triu_indices(400, 1)]
        assert abs(off.mean()) < 0.01 and (np.abs(off) <= bound).mean() > 0.999


def test_vectors_are_fetched_for_candidates_only(spark, monkeypatch):
    """Of random directions with few near pairs, most classes never leave the buckets of codes."""
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((1500, 96))
    rows = np.concatenate([centres, centres[:30] + 0.1 * draw.standard_normal((30, 96))])
    kept, staged = {}, vectors.staged
    monkeypatch.setattr(vectors, "staged", lambda df, name: kept.setdefault(name, staged(df, name)))
    found = check(spark, [(i, v.tolist(), 0) for i, v in enumerate(rows)])
    assert all(found[i][0] == 1 and found[1500 + i] == (1, i) for i in range(30)) and sum(x[0] for x in found.values()) == 60
    assert kept["codes"].count() == 1530 and kept["met"].select("class").distinct().count() == 60
