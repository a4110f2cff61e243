import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirador.llm import periodic

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(x, shortest=6, exponent=4):
    """All runs, from every period on its own; a stretch with a smaller period is left out."""
    out = set()
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, exponent * q):
                part = x[i:i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("letters, shortest, exponent", [(1, 6, 4), (2, 6, 4), (3, 6, 4), (2, 2, 2), (2, 7, 3), (2, 12, 5)])
def test_runs_equal_brute_force(letters, shortest, exponent):
    rng = random.Random(letters * 100 + exponent)
    for _ in range(300):
        x = [rng.randrange(letters) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):                       # planted repeats
            k, w = rng.randrange(len(x) + 1), [rng.randrange(letters) for _ in range(rng.randrange(1, 7))]
            x[k:k] = (w * 9)[:rng.randrange(len(w), 9 * len(w) + 1)]
        assert periodic.runs_of(np.array(x, np.int64), shortest, exponent) == brute(x, shortest, exponent), x


def test_no_run_is_lost_in_long_texts():
    for x in ([0] * 3000, [0, 1, 2] * 1000 + [5] + [0, 1, 2] * 7, list(range(2000)) + list(range(2000))):
        assert periodic.runs_of(np.array(x, np.int64)) == (brute(x) if x[-1] != 1999 else [])
    fib = [0], [0, 1]
    while len(fib[1]) < 1500:
        fib = fib[1], fib[1] + fib[0]
    assert periodic.runs_of(np.array(fib[1], np.int64), 2, 2) == brute(fib[1], 2, 2)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " \n\t".join(rng.choice(["a", "B", "é", "東京", "x y"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "a " * 9), (302, " \n "), (303, "z " * 50), (303, "z " * 50), (-7, "q r " * 12)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("top", F.lit("x")) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op11_periodic_runs(spark, str(tmp_path))
    key = lambda r: tuple((v is None, v) if not isinstance(v, str) else v for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((brute_row(*r) for r in rows), key=key)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in rows)


def test_awkward_documents(spark, documents, clashing):
    got = periodic.periodic_runs(clashing)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"] and got.count() == documents.count()
    assert periodic.periodic_runs(clashing.limit(0)).count() == 0
    texts = {r.doc_id: r for r in got.collect()}
    assert (texts[20].n_words, texts[20].runs, texts[20].collapsed) == (0, [], "")
    assert texts[27].runs and texts[24].n_words == sum(len((r.text or "").split()) for r in documents.filter("doc_id = 24").collect())
    with pytest.raises(ValueError):
        periodic.periodic_runs(documents, exponent=1)
