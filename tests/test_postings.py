"""The text index from packed records: tokens cut from bytes, postings dealt and cut to blocks."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions import words
from mirador.functions.columns import fts_tokens
from mirador.operators import postings, search, vectors
from mirador.session import scratch_path

SCHEMA = "id string, catalog_id string, title string, description string, organization string, tags array<string>"


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def test_tokens_cut_from_bytes_are_the_index_tokens(spark, monkeypatch):
    rng = random.Random(7)
    signs = "abzAZ .-\n1" + L.ACCENTED + L.ACCENTED.upper() + "ßŁłİıKſ中́😀"
    texts = ["", None, "ÁÉ", "x", "é", "aéb", "É" * 40, "Kelvin"] + ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    rows = df.select(F.lower(F.coalesce("t", F.lit(""))).alias("low"), fts_tokens(F.col("t")).alias("toks")).collect()
    low = pa.array([r.low for r in rows])
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(words, "CUT_BYTES", most)
        got = []
        for lo, hi in words.pieces([low]):
            found, at = words.cut(low.slice(lo, hi - lo))
            mine = [[] for _ in range(lo, hi)]
            for word, n in zip(found.to_pylist(), at, strict=True):
                mine[n].append(word)
            got += mine
        assert got == [r.toks for r in rows]


def records(spark, n=900):
    rng = random.Random(11)
    pick = lambda k: " ".join(f"w{'abcdefgh'[min(7, int(rng.expovariate(1)))]} Ñandú"[:rng.choice([2, 8])] for _ in range(k))
    rows = [(f"{c}:{i:04d}", c, pick(3), pick(rng.randrange(20)), pick(1), [pick(1), "t"]) for c in ("a", "b") for i in range(n)]
    rows += rows[:40] + [("a:0003", "a", "wa wa", None, None, None), (None, "a", "wa", "wb", None, None), (None, "a", "wa", "wb", "wa", []),
                         (None, None, "wa", "wb", None, None), ("a:x", "a", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "title")


def test_postings_cross_the_shuffle_packed(spark):
    index = search.fts_build(records(spark))
    n = index["postings"].select("catalog_id", "id", "term").distinct().count()
    dealt = search.dealt_postings(index, 2, {})
    assert dealt.count() < 0.5 * n                              # a row per slice and batch, not per posting
    assert "Exchange" not in plan(search.token_table(records(spark).coalesce(1))).split("Arrow")[0]


def test_impacts_with_nulls_shared_ids_and_common_terms(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 8)
    monkeypatch.setattr(search, "SLICE_POSTINGS", 60)
    monkeypatch.setattr(search, "SALT_POSTINGS", 150)
    monkeypatch.setattr(postings, "DEAL_POSTINGS", 100)
    index = search.fts_build(records(spark))
    built = search.write_impacts(index, scratch_path(spark, "impacts"))
    q = spark.createDataFrame([(i, c, t) for i, t in [(1, "wa"), (2, "w"), (2, "nandu"), (3, "wb"), (3, "wc"), (4, "t"), (5, "zz")] for c in ("a", "b")],
                              "query_id int, catalog_id string, term string")
    want = search.bm25_search(index, q, 2000).collect()
    got = search.bm25_topk(built, q, 2000).collect()
    key = lambda rows: sorted((r.query_id, r.catalog_id, r.id or "", round(r.score, 9)) for r in rows)
    assert key(got) == key(want) and len(got) > 2000 and any(r.id is None for r in got)
    counts = built["blocks"].groupBy("catalog_id", "term").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    ids = index["postings"].where("catalog_id IS NOT NULL").groupBy("catalog_id", "term").agg(F.countDistinct(F.coalesce("id", F.lit(""))).alias("n"))
    assert counts.select("catalog_id", "term", "n").exceptAll(ids).count() == 0 and counts.count() == ids.count()
    assert counts.agg(F.max("most")).first()[0] <= 8


def test_only_terms_asked_for_leave_the_blocks(spark):
    index = search.fts_build(records(spark, 60))
    built = search.write_impacts(index, scratch_path(spark, "impacts"))
    q = spark.createDataFrame([(1, "a", "wa"), (1, "a", "wb")], "query_id int, catalog_id string, term string")
    scans = [line for line in plan(search.bm25_topk(built, q, 5)).splitlines() if "FileScan" in line and "block" in line]
    assert scans and all("In(term, [wa,wb])" in line for line in scans)
    # the lists are made once, though the fallback looks at them as well
    both = search.fts_search(records(spark, 60), {**built, "stats": index["stats"]}, q, [(1, "wa wb"), (2, "nd")], 5)
    assert "FileScan parquet" not in plan(both) and {r.query_id for r in both.collect()} == {1, 2}


def test_encoder_takes_texts_not_token_lists(spark):
    df = spark.createDataFrame([(1, "a", "Año de Salud, salud"), (2, "b", ""), (3, "a", None), (4, None, "x " * 50)], "id long, c string, t string")
    out = vectors.embed_text(df, "id", "t", extra_cols=("c",))
    assert "MapInArrow" in plan(out) and "regexp_replace" not in plan(out)
    got = {r["id"]: (r["c"], np.array(r["vector"])) for r in out.collect()}
    want = np.zeros(L.EMBEDDING_DIM)
    for w in ("ano", "de", "salud", "salud"):
        at, sign = vectors.token_place(w, L.EMBEDDING_DIM)
        want[at] += sign
    assert np.allclose(got[1][1], want / np.linalg.norm(want)) and not got[2][1].any() and not got[3][1].any()
    assert got[4][0] is None and np.abs(got[4][1]).sum() == 1.0 and got[1][0] == "a"
