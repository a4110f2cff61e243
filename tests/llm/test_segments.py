import hashlib
import random
import re

import pytest

from mirador.llm import passages, segments

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_units(text, every):
    out, own, prev = [], [], 0
    for m in WORD.finditer(text or ""):
        w = re.sub("[A-Z]", lambda c: c.group().lower(), m.group()).encode()
        top = hashlib.md5(w).digest()[0]
        own.append((w, *m.span()))
        if (3 * prev + top) % every == 0:
            out.append(own)
            own = []
        prev = top
    return out + [own] if own else out


def brute(rows, min_words=20, every=6):
    """Passages by (doc_id, start), documents told apart by id and text."""
    docs = {(i is not None, i or 0, t): i for i, t in rows}
    first, units = {}, {}
    for d in sorted(docs, key=lambda d: (d[0], d[1], d[2] or "")):
        units[d] = brute_units(d[2], every)
        for k, u in enumerate(units[d]):
            first.setdefault(tuple(w for w, _, _ in u), (d, k))
    out = []
    for d, us in units.items():
        run, word = [], 0
        for k, u in enumerate([*us, None]):
            f = u and first[tuple(w for w, _, _ in u)]
            if u and f != (d, k):
                run.append((u, word, f))
            else:
                n = sum(len(u) for u, _, _ in run)
                if n and n >= min_words:
                    (fd, fk), head = run[0][2], run[0][0]
                    out.append((docs[d], head[0][1], run[-1][0][-1][2], run[0][1], n, len(run), docs[fd], units[fd][fk][0][1]))
                run = []
            word += len(u or ())
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted((tuple(r) for r in segments.repeated_passages(df, **kw).drop("th").collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    word = lambda: rng.choice(["a", "É", "Word", "東京", "x"]) + str(rng.randrange(400))
    shared = [[word() for _ in range(n)] for n in (60, 51, 90, 15, 30)]
    rows = []
    for i in range(150):
        body = [word() for _ in range(rng.randrange(0, 200))]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            k = rng.randrange(len(body) + 1)
            body[k:k] = [w.encode().upper().decode() for w in s] if rng.randrange(2) else s
        rows.append((i, "".join(w + rng.choice([" ", "\n", " \t"]) for w in body)))
    return rows + [(500, None), (501, ""), (502, " \n "), (503, rows[7][1]), (None, rows[9][1]), (504, "same words again " * 60)]


def test_equal_to_brute_force(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want = brute(texts)
    assert len(want) > 60 and found(df) == want
    assert found(df, min_words=1, every=2) == brute(texts, 1, 2)
    monkeypatch.setattr(segments, "CHUNK_UNITS", 50)
    monkeypatch.setattr(segments, "ROWS_PER_BUCKET", 3)
    assert found(df) == want


def test_passages_of_over_fifty_words_are_caught(spark):
    """Planted passages in otherwise unrelated documents, over lines cut anywhere."""
    rng = random.Random(50)
    word = lambda: "w" + str(rng.randrange(10 ** 6))
    rows, planted = [], set()
    for i in range(400):
        body = [word() for _ in range(rng.randrange(60, 200))]
        if i % 4 < 2:
            if i % 4 == 0:
                passage = [word() for _ in range(rng.randrange(51, 60))]
            else:
                planted.add(i)
            k = rng.randrange(len(body))
            body[k:k] = passage
        rows.append((i, " ".join(w + "\n" * (rng.randrange(9) == 0) for w in body)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0] for r in found(df)}
    assert got <= planted and len(got) >= 0.93 * len(planted)


def test_repeated_rows_and_ids(spark):
    rng = random.Random(2)
    a, b = (" ".join(f"{x}{rng.randrange(999)}" for _ in range(80)) for x in "ab")
    rows = [(1, a), (1, a), (1, a), (1, b), (2, a + " end"), (None, b), (None, b), (3, "x " + b)] * 2
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    ids = {r[0] for r in got}
    assert ids == {1, 2, 3} and len([r for r in got if r[0] == 1]) == 1    # the null id's text is the earliest
    assert {r[6] for r in got if r[0] in (1, 3)} == {None}


def test_cut_repeats(spark, texts, documents, clashing):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    left = {r.doc_id: r.text for r in segments.cut_repeats(df).collect()}
    spans = {}
    for i, start, end, *_ in brute(texts):
        spans.setdefault(i, []).append((start, end))
    for i, t in texts:
        for start, end in sorted(spans.get(i, []), reverse=True):
            t = t[:start] + t[end:]
        assert left[i] == t
    out = segments.cut_repeats(clashing, min_words=8)
    assert out.columns == clashing.columns and out.count() == documents.count()
    assert segments.repeated_passages(clashing.limit(0)).count() == 0


def test_lines_alone_miss_what_units_catch(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
    rows = [(1, " ".join(w[:100])), (2, "\n".join(" ".join(w[i:i + 7]) for i in range(20, 120, 7)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not passages.repeated_units(df).count() and [r[0] for r in found(df)] == [2]


def test_a_task_holds_few_buckets_however_small(spark, texts, monkeypatch):
    monkeypatch.setattr(segments, "ROWS_PER_BUCKET", 3)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    placed = segments.placed(df, 6, "doc_id", "text")
    assert placed.rdd.getNumPartitions() == len(texts) // 3 > segments.MIN_BUCKETS
