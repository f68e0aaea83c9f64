"""Each stage of the pipeline against a plain version, and the queries that SQL can express."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skylot.llm import queries, toxicity
from skylot.llm.common import components, globally_ranked, read
from tests.llm.docs import table
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_packing import check as check_packing
from tests.llm.test_shingles import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    model = toxicity.trained(docs, read(spark, SF, "labels"))
    kept = stages["toxicity"](spark, docs, SF).cache()
    assert kept.columns == columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in table("documents") if model.score(r["text"] or "") < toxicity.THRESHOLD)

    single = stages["near_duplicates"](spark, kept, SF).cache()
    found = brute([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == [i for i, _, c in found if i == c]

    clean = stages["secrets"](spark, single, SF).cache()
    assert clean.columns == columns and clean.count() == single.count()
    assert queries.secrets.findings(clean).filter("n_access + n_hex > 0").count() == 0

    mixed = stages["mixing"](spark, clean, SF).cache()
    assert mixed.columns == columns
    taken = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    plan = queries.mixing.mix_plan(clean).collect()
    assert {r["doc_id"]: r["copies"] for r in plan if r["copies"]} == taken
    check_mix(plan, [(r["text"], r["source"]) for r in clean.collect()])

    rows = stages["packing"](spark, mixed, SF)
    total = sum(r["length"] for r in rows.collect())
    one = stages["packing"](spark, clean, SF).collect()
    check_packing(one, [(r["doc_id"], r["text"]) for r in clean.collect()])
    assert total == sum(r["length"] * taken.get(r["doc_id"], 0) for r in one)


def test_run_and_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for name in ("labels", "documents"):
        (read(spark, SF, name).limit(0) if name == "documents" else read(spark, SF, name)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rows = queries.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, rows.select(*columns).collect()))) == sorted(map(str, expected))


def test_components_and_ranks(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7), (201, 200)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    ranked = globally_ranked(spark.range(500).selectExpr("id * 37 % 500 AS x"), [F.col("x")], "place")
    assert all(r["x"] == r["place"] for r in ranked.collect())


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    chain = rng.sample(range(80), 80)
    for edges in (list(zip(chain, chain[1:])), [(99, i) for i in range(40)], [(rng.randrange(100), rng.randrange(100)) for _ in range(70)], [(1, 1)]):
        least = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in least:  # as often as a chain is long
            for a, b in edges:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        rows = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
        assert len(rows) == len(least) and dict(rows) == least
