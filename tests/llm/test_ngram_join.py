import random

import numpy as np
import pytest

from mirador.llm import ngram_join as nj
from mirador.llm.components import components


def shingles(text, n=4):
    words = [w for w in (text or "").encode().lower().split()]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, percent=85, n=4):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10 ** 6)}"
    return out


@pytest.fixture(scope="module")
def family():
    """Families of copies with few to many edits, all sharing one common line."""
    rng, rows = random.Random(5), []
    for f, size in enumerate([6, 9, 14, 22, 40, 80, 150, 400]):
        base = [f"w{f}x{rng.randrange(10 ** 6)}" for _ in range(size)]
        rows += [" ".join(base)] + [" ".join(edited(rng, base, rng.randrange(1, 1 + max(1, size // 25)))
                                             + ["the common line of words that all share"] * rng.randrange(2))
                                    for _ in range(24)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark, family):
    df = spark.createDataFrame(family, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df).collect()}
    assert got == brute(family)


def test_one_per_group_takes_five_words_and_four_fifths(spark, family):
    df = spark.createDataFrame(family, "doc_id long, text string")
    want = brute(family, 80, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df, 5, 80).collect()}
    assert got == want
    assert {r.doc_id for r in nj.one_per_group(df).collect()} == {c for _, c in want.values()}


def test_split_clusters_give_the_same_components(spark, family, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SETS", 5)
    df = spark.createDataFrame(family, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df).collect()}
    assert got == brute(family)


@pytest.mark.parametrize("chunk", [1, 300, 10 ** 9])
def test_chunks_of_keys_give_the_same_components(spark, family, monkeypatch, chunk):
    monkeypatch.setattr(nj, "CHUNK_KEYS", chunk)
    df = spark.createDataFrame(family, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df).collect()}
    assert got == brute(family)


def test_a_chunk_sends_each_key_once():
    rng = np.random.default_rng(2)
    key, sid = rng.integers(-50, 50, 900), rng.integers(-2 ** 62, 2 ** 62, 900)
    key[:300] = 7
    k, s, n = nj.stars_of(key, sid)
    least = {x: sid[key == x].min() for x in set(key.tolist())}
    assert n == len(least) and dict(zip(k[:n].tolist(), s[:n].tolist())) == least
    a, b = np.split(s[n:], 2)
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist())} == \
        {(int(least[x]), y) for x, y in zip(key.tolist(), sid.tolist()) if y != least[x]}
    assert (k[n:n + len(a)] == k[n + len(a):]).all() and len(set(k[n:].tolist())) == len(a)


def test_joins_without_broadcast_give_the_same(spark, family, monkeypatch):
    monkeypatch.setattr(nj, "BROADCAST_ROWS", -1)
    df = spark.createDataFrame(family, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df).collect()}
    assert got == brute(family)


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("size", [5, 6, 11, 30, 60, 95, 100, 200, 290, 1000, 4000])
def test_no_similar_pair_without_a_common_key(size, percent):
    rng = np.random.default_rng(size)
    for _ in range(30):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        worst = len(a) * (100 - percent) // percent
        drop = int(rng.integers(0, worst + 1))
        # the smaller set lacks ``drop`` elements or swaps them, at the border of ``percent``
        b = a[drop:]
        if rng.integers(2) and drop:
            swap = max(0, int(len(a) * (100 - percent) / (100 + percent)))
            b = np.unique(np.concatenate([a[swap:], rng.integers(0, 1 << 63, swap, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) == len(a) == common or 100 * common < percent * (len(a) + len(b) - common):
            continue
        assert set(nj.band_keys(a, percent).tolist()) & set(nj.band_keys(b, percent).tolist()), (size, drop)


def test_awkward_rows(spark, documents, clashing):
    got = nj.jaccard_components(clashing).collect()
    assert len(got) == documents.count()
    by = {r.doc_id: r for r in got}
    assert by[20].n_shingles == by[21].n_shingles == by[26].n_shingles == 0
    assert by[20].component_id == 20 and by[25].component_id == 3 and by[4].component_id == 4
    assert by[None].n_shingles == 3
    kept = nj.one_per_group(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 25 not in ids and ids.count(4) == 3 and None in ids


@pytest.fixture(scope="module")
def repeated_ids(family):
    """The families' texts with few ids: null for a third, one id for many different texts."""
    rng = random.Random(6)
    rows = [(None if i % 3 == 0 else i % 7 if i % 3 == 1 else 100 + i, t) for i, t in family]
    rows += [(None, t) for _, t in family[:9]]
    rng.shuffle(rows)
    return rows


def test_repeated_and_null_ids_equal_brute_force(spark, repeated_ids):
    groups = brute(list(enumerate(t for _, t in repeated_ids)), 80, 5)
    members = {}
    for k, (_, root) in groups.items():
        members.setdefault(root, []).append(k)
    want, heads = [], {}
    for ks in members.values():
        ids = [repeated_ids[k][0] for k in ks if repeated_ids[k][0] is not None]
        least = min(ids, default=None)
        want += [(repeated_ids[k][0], groups[k][0], least) for k in ks]
        heads[frozenset(repeated_ids[k][1] for k in ks)] = least

    def key(r):
        return tuple((x is None, x) for x in r)

    df = spark.createDataFrame(repeated_ids, "doc_id long, text string")
    got = [tuple(r) for r in nj.jaccard_components(df, 5, 80).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = {(r.doc_id, r.text) for r in nj.one_per_group(df).collect()}
    assert len(kept) == len(heads)                          # one document a group
    for texts, least in heads.items():
        assert [i for i, t in kept if t in texts] == [least]
    assert kept == {(r.doc_id, r.text) for r in nj.one_per_group(df.orderBy(df.text.desc())).collect()}


def test_two_classes_without_ids(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(None, " ".join(w[:60 - k])) for w in (a, b) for k in range(3)] + [(7, " ".join(a)), (7, "other words " + " ".join(b))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = nj.jaccard_components(df, 5, 80).collect()
        assert {r.component_id for r in got} == {7}
        assert sorted(r.text for r in nj.one_per_group(df).collect()) == [rows[6][1], rows[7][1]]
    alone = spark.createDataFrame(rows[:6], "doc_id long, text string")
    kept = [r.text[0] for r in nj.one_per_group(alone).collect()]
    assert sorted(kept) == ["a", "b"]


def test_empty_table(spark, documents):
    none = documents.limit(0)
    assert nj.jaccard_components(none).count() == 0 and nj.one_per_group(none).count() == 0


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, **{200 + i: 200 for i in range(7)}}


def test_low_threshold_equals_brute_force(spark, family):
    df = spark.createDataFrame(family[:120], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df, 3, 50).collect()}
    assert got == brute(family[:120], 50, 3)


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 95])
def test_sets_with_empty_parts_share_keys(percent):
    """The border of a threshold for many sizes, with a third of the elements in one part."""
    rng = np.random.default_rng(percent)
    for size in [*range(2, 40), 64, 100, 150, 300]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = len(a) * (100 - percent) // 100
            b = a[drop:]
            if 0 < drop and 100 * len(b) >= percent * len(a):
                assert set(nj.band_keys(a, percent).tolist()) & set(nj.band_keys(b, percent).tolist()), size


def test_no_key_without_elements():
    """Unrelated sets of one size share no key, whatever their empty parts."""
    rng = np.random.default_rng(4)
    for percent in (70, 80, 85):
        for size in (4, 8, 16, 30, 50, 100, 150, 200, 400):
            sets = [rng.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(60)]
            keys = np.concatenate([np.unique(nj.band_keys(s, percent)) for s in sets])
            assert len(np.unique(keys)) == len(keys), (percent, size)


def test_plans_hold_the_pigeonhole():
    for percent in (70, 80, 85, 90):
        borders = nj.edges_of(percent, 5000)
        for low, high in zip(borders, borders[1:]):
            d, parts, groups, slack = nj.band_plan(percent, low, high)
            assert d == (high - 1) * (100 - percent) // percent
            assert not parts or parts - d - slack == groups + 1


def test_keys_of_one_bucket_come_back(spark):
    rng = np.random.default_rng(9)
    key, sid = rng.integers(-2 ** 62, 2 ** 62, 5000), rng.integers(-2 ** 62, 2 ** 62, 5000)
    key[:1000], sid[::3] = key[0], sid[0]
    rows = nj.packed_keys(key, sid, 7)
    got = []
    for p in rows.column(5).to_pylist():
        k, at, own = nj.unpack(p, np.uint64, np.uint32, np.int64)
        got += zip(np.cumsum(k, dtype=np.uint64).view(np.int64).tolist(), own[at].tolist())
    assert sorted(got) == sorted(zip(key.tolist(), sid.tolist())) and rows.num_rows == 7
