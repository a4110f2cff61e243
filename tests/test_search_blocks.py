import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.operators import search, text, vectors
from mirador.session import scratch_path

SCHEMA = "id string, catalog_id string, title string, description string, organization string, tags array<string>"


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)
    words = ["".join(c) for c in ("abc", "bcd", "cde", "def", "efg", "fgh", "ghi", "hij")] + [f"rare{chr(97 + i)}" for i in range(12)]
    pick = lambda n: " ".join(rng.choices(words, [40, 30, 20, 10, 5, 4, 3, 2] + [1] * 12, k=n))
    return spark.createDataFrame([(f"{c}:{i:04d}", c, pick(4), pick(rng.randrange(0, 40)), pick(1), [pick(1)])
                                  for c in ("a", "b") for i in range(700)], SCHEMA)


QTERMS = [(1, "abc"), (2, "abc"), (2, "rarea"), (3, "bcd"), (3, "cde"), (3, "rareb"), (4, "nothing"), (5, "rarec"), (5, "rared")]


def files_read(df):
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if "AdaptiveSparkPlan" in p.getClass().getSimpleName():
            return walk(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(p.plan())
        if "FileSourceScan" in p.getClass().getSimpleName():
            out.append(p.metrics().apply("numFiles").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))
    walk(plan)
    return sum(out)


def test_blocks_give_the_full_search(spark, records, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 16)
    index = search.fts_build(records)
    built = search.write_impacts(index, scratch_path(spark, "impacts"))
    q = spark.createDataFrame([(i, c, t) for i, t in QTERMS for c in ("a", "b")], "query_id int, catalog_id string, term string")
    for limit in (1, 5, 16, 40):
        want = {(r.query_id, r.catalog_id, r.rank): (r.id, round(r.score, 6)) for r in search.bm25_search(index, q, limit).collect()}
        got = {(r.query_id, r.catalog_id, r.rank): (r.id, round(r.score, 6)) for r in search.bm25_topk(built, q, limit).collect()}
        assert got == want and len(got) > 6
    used = search.useful_blocks(built["blocks"], q, 5).count()
    every = built["blocks"].join(q, ["catalog_id", "term"]).count()
    assert used < 0.8 * every                                   # blocks of low impacts are left out
    assert built["blocks"].agg(F.max("n")).first()[0] <= 16


def test_fewer_terms_read_fewer_files(spark, records):
    built = search.write_impacts(search.fts_build(records), scratch_path(spark, "impacts"))
    few = spark.createDataFrame([(1, "a", "rarea")], "query_id int, catalog_id string, term string")
    many = spark.createDataFrame([(i, c, t) for i, t in QTERMS for c in ("a", "b")], "query_id int, catalog_id string, term string")
    assert files_read(search.bm25_topk(built, few, 5)) < files_read(search.bm25_topk(built, many, 5))


def test_fallback_looks_only_for_pairs_without_hits(spark, records):
    queries = [(1, "abc"), (2, "are"), (3, "zzz")]
    index = search.fts_build(records)
    q = spark.createDataFrame([(1, "a", "abc"), (1, "b", "abc"), (2, "a", "are")], "query_id int, catalog_id string, term string")
    got = search.fts_search(records, index, q, queries, 3).collect()
    kinds = {(r.query_id, r.catalog_id): r.score for r in got}
    assert set(kinds) == {(1, "a"), (1, "b"), (2, "a"), (2, "b")} and kinds[2, "a"] == 1.0     # the substring's score
    one = search.fts_search(search.in_catalog(records, "b"), index, search.in_catalog(q, "b"), queries, 3,
                            spark.createDataFrame([("b",)], "catalog_id string")).collect()
    assert {r.catalog_id for r in one} == {"b"}


def test_encoder_by_hand(spark):
    df = spark.createDataFrame([(1, "Budget of the budget"), (2, None)], "id long, t string")
    rows = {r["id"]: np.array(r["vector"]) for r in vectors.embed_text(df, "id", "t").collect()}
    want = np.zeros(L.EMBEDDING_DIM)
    for w in ("budget", "of", "the", "budget"):
        at, sign = vectors.token_place(w, L.EMBEDDING_DIM)
        want[at] += sign
    assert np.allclose(rows[1], want / np.linalg.norm(want)) and not rows[2].any()
    own = vectors.embed_text(df.where("id = 1"), "id", "t", encoder=lambda texts: np.array([[len(t)] for t in texts]))
    assert own.first()["vector"] == [20.0]


def test_all_packs_expand(spark):
    rows = [(c, w) for c, pack in L.ACRONYMS.items() for w in pack]
    df = spark.createDataFrame(rows, "country string, word string")
    got = {(r.country, r.word): r.e for r in df.select("*", text.expand_acronyms(F.lower("word"), F.col("country")).alias("e")).collect()}
    assert len(L.ACRONYMS) == 8 and len(got) == len(rows)
    for (country, word), expanded in got.items():
        # an acronym in mixed case never equals a token's upper form
        want = [word.lower()] + (text.acronym_expansions(country)[word] if word.isupper() else [])
        assert expanded.split(" ") == want


def plan(df):
    return df._jdf.queryExecution().explainString(spark_mode(df, "simple"))


def spark_mode(df, name):
    return df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(name)


def test_postings_are_counted_without_a_shuffle(spark, records):
    index = search.fts_build(records.coalesce(2))
    assert "Exchange" not in plan(index["postings"])
    # rows that share an id and a length are one document's, others are told apart by length
    rows = [("a:1", "a", "abc abc", "", "", []), ("a:1", "a", "abc bcd", "abc", "", []), ("a:1", "a", "abc", "bcd", "", []),
            ("a:2", "a", "abc", "", "abc", ["abc"]), (None, "a", "abc", None, None, None), (None, "a", "abc", None, None, None)]
    got = sorted((r.id or "", r.field, r.term, r.len, r.tf) for r in search.fts_build(spark.createDataFrame(rows, SCHEMA))["postings"].collect())
    assert got == sorted([("a:1", "title", "abc", 2, 3), ("a:1", "title", "abc", 3, 1), ("a:1", "title", "bcd", 3, 1),
                          ("a:1", "description", "abc", 3, 1), ("a:1", "description", "bcd", 2, 1), ("a:2", "title", "abc", 3, 1),
                          ("a:2", "organization", "abc", 3, 1), ("a:2", "tags", "abc", 3, 1), ("", "title", "abc", 1, 2)])


def test_common_terms_and_shared_ids_in_slices(spark, records, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 16)
    monkeypatch.setattr(search, "SLICE_POSTINGS", 50)
    monkeypatch.setattr(search, "SALT_POSTINGS", 100)
    twice = records.unionByName(records.where("id LIKE '%:00%'")).unionByName(records.where("id = 'a:0007'").withColumn("title", F.lit("abc")))
    index = search.fts_build(twice)
    built = search.write_impacts(index, scratch_path(spark, "impacts"))
    q = spark.createDataFrame([(i, c, t) for i, t in QTERMS for c in ("a", "b")], "query_id int, catalog_id string, term string")
    want = {(r.query_id, r.catalog_id, r.rank): (r.id, round(r.score, 6)) for r in search.bm25_search(index, q, 10).collect()}
    got = {(r.query_id, r.catalog_id, r.rank): (r.id, round(r.score, 6)) for r in search.bm25_topk(built, q, 10).collect()}
    assert got == want and len(got) > 6


def test_a_block_of_queries_does_not_shuffle_the_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, "ab"[i % 2], rng.normal(size=4).tolist()) for i in range(60)], "id long, cat string, vector array<double>")
    q = spark.createDataFrame([(j, rng.normal(size=4).tolist()) for j in range(5)], "query_id long, vector array<double>")
    for per in (False, True):
        one = vectors.vector_topk(v, q, 3, catalog_col="cat", per_catalog=per)
        assert "CoGroup" not in plan(one)
        monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
        many = vectors.vector_topk(v, q, 3, catalog_col="cat", per_catalog=per)
        assert "CoGroup" in plan(many)
        rows = [sorted((r.query_id, r.cat, r["rank"], r.id, round(r.score, 9)) for r in df.collect()) for df in (one, many)]
        assert rows[0] == rows[1] and len(rows[0]) == 15 * (1 + per)
        monkeypatch.setattr(vectors, "QUERY_BLOCK", 512)
