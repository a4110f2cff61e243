import math
import random

import duckdb
import pytest

from mirador.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=10, low=30, high=90, every=100):
    ok = {(i, label, tuple(math.floor(256 * x) if math.isfinite(256 * x) else x for x in v)) for i, label, v in rows
          if None not in (i, label, v) and None not in v and all(map(math.isfinite, v))}
    ok = [r for r in ok if sum(float(x) * float(x) for x in r[2]) < hn.SQUARES]
    out = []
    for a in ok:
        if a[0] % every:
            continue
        score = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in ok if b != a and len(a[2]) == len(b[2])]
        for p, pid, _ in sorted(s for s in score if s[2] == a[1])[:positives]:
            inside = sorted((s, i) for s, i, label in score if label != a[1] and low * -p <= 100 * -s <= high * -p)
            out += [(a[0], pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(inside[:negatives])]
    return sorted(out)


def mined(df, **kw):
    return sorted(map(tuple, hn.hard_negatives(df, **kw).collect()))


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(12)
    rows = [(i, rng.randrange(3), [rng.randrange(-4, 9) / 16 for _ in range(4)]) for i in range(800)]
    rows += [(1000 + i, rng.randrange(3), [0.5, 0.25, 0.5, 0.5]) for i in range(120)]           # ties
    rows += [(2000, None, [0.1] * 4), (None, 1, [0.1] * 4), (2100, 1, None), (2200, 1, [0.1, None, 0.1, 0.1]),
             (2300, 1, [float("nan")] * 4), (2400, 1, [float("inf")] * 4), (2500, 1, [1e308] * 4), (2600, 1, []),
             (2700, 2, [0.5] * 3), (2701, 2, [0.5] * 3), (2702, 1, [0.25] * 3), rows[100], rows[100], rows[3],
             (200, 0, [0.25, 0.5, 0.25, 0.5]), (300, 7, [0.5] * 4), (2800, 1, [0.0] * 4), (2801, 1, [0.0] * 4)]
    return rows


def test_equal_to_brute_force(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")
    want = brute(vectors)
    assert len(want) > 300 and mined(df) == want
    assert mined(df, positives=2, negatives=3, low=0, high=100) == brute(vectors, 2, 3, 0, 100)
    monkeypatch.setattr(hn, "ROW_BLOCK", 100)                   # many cells
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 3)
    assert mined(df) == want


def test_large_integers_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(2), [rng.randrange(2 ** 29) * rng.choice([1, 1, -1]) / 256 * 2, 3 + rng.random()]) for i in range(120)]
    rows += [(200, 0, [1e18, 1.0]), (201, 0, [1e18, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = mined(df, is_anchor="vec_id % 10 = 0")
    assert got == brute(rows, every=10) and max(r[4] for r in got) > 2 ** 53


def test_sql(spark, vectors, tmp_path):
    plain = [r for r in vectors if r[0] not in (200, 300, 2500) or r[1] is None]
    spark.createDataFrame(plain, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, hn.op12_hard_negatives(spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(c.execute(hn.OP12_SQL).fetchall()) and got


def test_awkward_tables(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")
    odd = df.selectExpr("*", "1 AS v", "2 AS row", "3 AS score", "4 AS dim", "5 AS kind", "6 AS anchor", "7 AS `odd.name`")
    assert mined(odd) == brute(vectors)
    assert mined(df.limit(0)) == []
    assert mined(df, is_anchor="vec_id = 9999999") == []
    with pytest.raises(ValueError):
        hn.hard_negatives(df, high=120)
