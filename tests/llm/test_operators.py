import binascii
import random

import numpy as np
import pytest

from mirador.llm import mixing, nearest, passages, quality, sharding, urls


def words(text):
    return (text or "").encode().split()


# ---------------------------------------------------------------- mixing
def brute_targets(sizes, epochs=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, free, target = {s: i % 3 + 1 for i, s in enumerate(order)}, set(sizes), {}
    left = float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > epochs * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            free.discard(s)
        left = sum(sizes.values()) - sum(target.values())


def test_mix_targets_and_takes(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["a", "b", "é", "Z", None]) if i % 3 else "hot") for i in range(3000)]
    rows += [(9000 + i, "w " * 5, "tiny") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.size == len(words(dict((i, t) for i, t, _ in rows)[r.doc_id])) if r.doc_id < 20 else True
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    again = {(r.doc_id, r.taken) for r in mixing.mix_sizes(df).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_awkward_rows(spark, documents, clashing):
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns
    by = {}
    for r in mixing.mix_sizes(clashing).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[20][0].size == by[21][0].size == by[26][0].taken == 0 and len(by[4]) == 3
    assert len({r.taken for r in by[4]}) == 1
    assert out.filter("doc_id = 4").count() == sum(r.repetitions for r in by[4])
    # a source at its three epochs is taken three times, its documents without words too
    few = spark.createDataFrame([(i, "", "a") for i in range(50)] + [(50, "one two", "a")]
                                + [(100 + i, "w " * 50, "b") for i in range(9)], "doc_id long, text string, source string")
    assert {r.repetitions for r in mixing.mix_sizes(few).filter("source = 'a'").collect()} == {3}
    none = clashing.limit(0)
    assert mixing.mix(none).count() == 0 and mixing.mix_sizes(none).count() == 0


# ---------------------------------------------------------------- sharding
def test_shards_balance_and_number(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é\n") for _ in range(rng.randrange(1, 300))) for _ in range(3000)]
    texts += ["the same text of a hot group " * 4] * 1500 + ["a small group"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.kd_shards(df, shards=7).collect()
    size, slots, of = {}, {}, {}
    for r in got:
        data = texts[r.doc_id].encode()
        assert r.size == len(data) + 8 and r.text_crc32 == binascii.crc32(data)
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        of.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(got) == len(texts) and set(size) == set(range(7))
    assert max(size.values()) < 1.05 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(of["a small group"]) == 1


def brute_leaves(rows, leaves, dims):
    """Leaf per row by exact weighted medians; rows are (size, h, key per dimension)."""
    extent = [max(r[2 + d] for r in rows) - min(r[2 + d] for r in rows) for d in range(dims)]
    out = {}

    def split(at, n, first):
        if n == 1:
            out.update(dict.fromkeys(at, first))
            return
        if not at:
            return
        wide = [max(rows[i][2 + d] for i in at) - min(rows[i][2 + d] for i in at) for d in range(dims)]
        d = max(range(dims), key=lambda d: wide[d] / max(1, extent[d]))
        goal, below = sum(rows[i][0] for i in at) * (n // 2) / n, 0
        for key in sorted({rows[i][2 + d] for i in at}):
            here = sum(rows[i][0] for i in at if rows[i][2 + d] == key)
            if below + here >= goal:
                cut = key if below + here - goal <= goal - below else key - 1
                break
            below += here
        split([i for i in at if rows[i][2 + d] <= cut], n // 2, first)
        split([i for i in at if rows[i][2 + d] > cut], n - n // 2, first + n // 2)

    split(list(range(len(rows))), leaves, 0)
    return out


@pytest.mark.parametrize("leaves, most", [(1, 9), (2, 9), (7, 9), (24, 9), (24, -1)])
def test_shards_equal_brute_force(spark, monkeypatch, leaves, most):
    rng = random.Random(leaves)
    rows = [(rng.randrange(1, 50), i, rng.randrange(40), rng.randrange(10 ** 6), rng.choice([0, 0, 0, 5])) for i in range(700)]
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    monkeypatch.setattr(sharding, "WHOLE_GROUP", 1e9)           # no value is cut
    monkeypatch.setattr(sharding, "BINS", 8)
    monkeypatch.setattr(sharding, "BROADCAST_NODES", most)
    meta = spark.createDataFrame(rows, "size long, h long, a long, b long, c long").repartition(3)
    got = {r.h: r.leaf for r in sharding.kd_leaves(meta, ["a", "b", "c"], leaves, sum(r[0] for r in rows)).collect()}
    assert got == brute_leaves(rows, leaves, 3)


def test_shards_awkward_rows(spark, documents, clashing):
    got = sharding.kd_shards(clashing, shards=3).collect()
    assert len(got) == documents.count()
    by = {r.doc_id: r for r in got}
    assert (by[20].size, by[20].text_crc32, by[21].size) == (8, 0, 8)
    assert sharding.kd_shards(clashing.limit(0), shards=3).count() == 0
    assert len({r.shard for r in sharding.kd_shards(documents, target_bytes=50_000).collect()}) >= 2


# ---------------------------------------------------------------- quality
def test_base_rules():
    w = [str(i).encode() for i in range(10)]
    assert quality.repeated_words(w) == 0 and quality.repeated_words(w + w[:3]) == 6
    assert quality.repeated_words([b"a"] * 5) == 5 and quality.repeated_words(w[:2]) == 0
    assert quality.duplicate_lines("a\n\n \na\nb\na") == 2


def test_bands(spark, documents, clashing):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(3000))
    noise = " ".join("".join(rng.choice([chr(c) for c in range(33, 0x250)]) for _ in range(12)) for _ in range(900))
    half = prose[:12_000] + " " + " ".join(f"{chr(97 + i % 5)}{'x' * (i % 7)}" for i in range(9000))
    rows = [(1, prose), (2, noise), (3, half), (4, "same words again " * 300), (5, "too short"), (6, None), (7, "")]
    got = {r.doc_id: r for r in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(1, 8)] == [True, False, False, False, False, False, False]
    assert got[4].base_failed and got[1].n_words == 3000 and not got[2].base_failed
    kept = quality.quality_filter(clashing)
    assert kept.columns == clashing.columns and kept.filter("doc_id = 21 or doc_id = 20").count() == 0
    assert quality.quality_scores(clashing).count() == documents.count()
    assert quality.quality_filter(clashing.limit(0)).count() == 0


# ---------------------------------------------------------------- passages
def test_repeated_units(spark, documents, clashing):
    p = " ".join(f"w{i}" for i in range(25))
    rows = [(3, f"é start\n{p}\nend"), (1, f"x\n\n{p.upper()}"), (2, f"{p}\n{p}  "), (2, f"{p}\n{p}  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.unit, r.start, r.end, r.first_doc_id, r.first_unit) for r in passages.repeated_units(df).collect()}
    n = len(p)
    assert got == {(2, 0, 0, n, 1, 2), (2, 1, n + 1, 2 * n + 3, 1, 2), (3, 1, 8, 8 + n, 1, 2)}
    left = {(r.doc_id, r.text) for r in passages.remove_repeats(df).collect()}
    assert left == {(3, "é start\nend"), (1, rows[1][1]), (2, "")}
    out = passages.remove_repeats(clashing, min_words=4)
    assert out.columns == clashing.columns and out.count() == documents.count()
    assert passages.repeated_units(clashing.limit(0)).count() == 0


# ---------------------------------------------------------------- nearest
def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATE_ROWS", 100)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(600, 8)), 2)
    v[300:340] = v[100]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(600)] + [(50, [float(x) for x in v[50]], 0)]
    rows += [(700, None, 1), (750, [1.0, None] + [0.0] * 6, 1), (800, [float("nan")] * 8, 1), (None, [1.0] * 8, 1), (850, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest.top_k(df).collect()}
    x = np.floor(256 * v).astype(int)
    want = {}
    for q in range(0, 600, 50):
        best = sorted(((-int(x[q] @ x[i]), i) for i in range(600) if i != q))[:5]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert got == want
    assert nearest.top_k(df.limit(0)).count() == 0


def test_bound_order_stops_early():
    import pandas as pd
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, size=(20, 16)).astype(float)
    x = np.vstack([c + rng.integers(-3, 4, size=(400, 16)) for c in centres])
    pivots = centres
    rows = pd.DataFrame({"vec_id": range(len(x)), "v": list(x), "d": [np.linalg.norm(pivots - r, axis=1) for r in x]})
    got = nearest.search_block(rows.iloc[:3], rows, 5)
    for q in range(3):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(len(x)) if i != q)[:5]
        assert [(a, -s) for b, a, s in got if b == q] == [(i, s) for s, i in best]


# ---------------------------------------------------------------- urls
CASES = [("https://a.com/x", "com/"), ("https://A.COM", None), ("http://example.com/en/1", "example.com/en/"),
         ("http://www.example.com/en/1?x=/#y", "www.example.com/en/"), ("http://x.www.example.com/en/", "www.example.com/en/"),
         ("http://notexample.com/en/", "com/"), ("http://b.net/fr/2", "net/fr/"), ("http://b.net/en/2", None),
         ("no scheme.com/", None), (None, None), ("http://net/es/#t", "net/es/"), ("ftp://c.org?x/y", None)]


def test_rules_and_model(spark):
    good = [(i, f"https://news{i}.example.org/en/{i}") for i in range(60)]
    bad = [(100 + i, f"https://casino-{i}.example.org/en/{i}") for i in range(60)]
    extra = [(200 + i, u) for i, (u, _) in enumerate(CASES)] + [(300, "http://mycasino7.example.org/en/9")]
    pages = spark.createDataFrame(good + bad + extra, "page_id long, url string").selectExpr("*", "1 as host", "2 as grams", "3 as r")
    labelled = urls.labelled_by_words(pages).filter("id < 200")
    got = {r.page_id: r for r in urls.judge(pages, labelled).collect()}
    assert len(got) == len(good + bad + extra)
    for i, (_, rule) in enumerate(CASES):
        assert got[200 + i].rule == rule, CASES[i]
    assert got[200].verdict == "allow" and got[202].verdict == "block" and got[203].verdict == "allow"
    assert (got[209].host, got[209].path) == ("", "") and (got[201].host, got[201].path) == ("a.com", "")
    assert (got[203].host, got[203].path) == ("www.example.com", "/en/1") and got[211].host == "c.org"
    assert all(got[i].verdict == "allow" for i, _ in good) and all(got[i].verdict == "block" for i, _ in bad)
    assert got[300].verdict == "block"
    one_class = urls.judge(pages, labelled.filter("verdict = 'allow'")).filter("page_id = 300").first()
    assert one_class.verdict == "allow"
    assert urls.judge(pages.limit(0), labelled.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    last = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, last, SF_SMALL), f"test-{name}")
        assert out.dtypes == docs.dtypes and 0 < out.count()
        if name == "quality_rules":
            one = quality._judge(quality.Bands())
            assert {r.doc_id for r in out.collect()} == {i for i, t in text.items() if one(t)[-1]}
        last = out
    final = corpus_pipeline.STAGES[-1][1](spark, last, SF_SMALL)
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in last.collect())
    assert final.filter("n_tokens = 0").count() == 0


# ---------------------------------------------------------------- exactness and cuts
def test_scores_are_exact_beyond_doubles(spark):
    a, b = [1e6, 1e6 + 1 / 256, 3.0], [1e6 + 1 / 256, 1e6 + 3 / 256, 1 / 256]
    rows = [(0, a), (1, b), (50, [1e18, 1.0]), (51, [1e18, 1.0])]
    got = nearest.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5).collect()
    ints = [[int(256 * x) for x in v] for v in (a, b)]
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, sum(x * y for x, y in zip(*ints)))]
    assert got[0].score == 131072001280000771


def test_every_byte_is_in_a_chunk():
    import zstandard

    bands, seen = quality.Bands(), []
    compress = zstandard.ZstdCompressor(level=3).compress

    def counted(data):
        seen.append(len(data))
        return compress(data)

    for n in (0, 1, 50, 4095, 4096, 4097, 8191, 8192, 50_001):
        seen.clear()
        whole, chunks, bad, bad_bytes = quality.ratios(b"x" * n, bands, counted)
        assert chunks == -(-n // 4096) and sum(seen) == (n if n <= 4096 else 2 * n)
        assert bad_bytes <= n and (bad == 0) == (bad_bytes == 0)


def brute_quality(text):
    """Counts of the base rules, by their own words."""
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeat = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(repeat), len(words) < 50 or 100 * len(repeat) > 50 * len(words))


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(77)
    texts = ["".join(rng.choice(["a", "b ", "é", "\n", "# ", " c d e ", "東 ", "\t", "$"]) for _ in range(rng.randrange(0, 300))) for _ in range(200)]
    texts += [None, "", " \n ", "one\ntwo\none\n\none", "w " * 49, "w%d " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_scores(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
        assert not (r.base_failed and r.kept)
