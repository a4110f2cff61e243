"""Each stage of the corpus pipeline on its own input against an independent brute-force version."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
import zstandard

import corpus_pipeline
from mirador.llm import bpe
from mirador.llm import line_dedup as ld
from mirador.llm.quality import Bands
from tests.llm.test_line_dedup import distance
from tests.llm.test_ngram_join import brute as jaccard
from tests.llm.test_operators import brute_quality, brute_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with copies, near copies, shared and nearly shared lines, junk and odd rows."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("etaoinshrdlucmf") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common = [line(12) for _ in range(5)]
    texts = []
    for _ in range(60):
        lines = [line(rng.randrange(4, 14)) for _ in range(rng.randrange(8, 25))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(common)
            k = rng.randrange(len(s))
            lines.insert(rng.randrange(len(lines)), rng.choice([s, s[:k] + "x" + s[k + 1:], s[:k] + s[k + 1:]]))
        texts.append("\n".join(lines))
    for t in rng.sample(texts, 15):                              # near copies: some words differ
        words = t.split(" ")
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "new" + str(rng.randrange(10 ** 6))
        texts.append(" ".join(words))
    texts += [texts[3], texts[5], "same words again " * 200, line(20), None, "", " \n ",
              " ".join("".join(rng.choice([chr(c) for c in range(33, 0x250)]) for _ in range(12)) for _ in range(400))]
    rows = [(i, t, "en", None if i % 19 == 0 else "hot" if i % 3 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=repr)


def test_quality_rules(spark, corpus):
    got = STAGES["quality_rules"](spark, corpus, "")
    compress, bands, want = zstandard.ZstdCompressor(level=3).compress, Bands(), []
    fits = lambda part, table: next(lo <= len(compress(part)) / len(part) <= hi for top, lo, hi in table if len(part) < top)
    for r in corpus.collect():
        data = (r.text or "").encode()
        if brute_quality(r.text)[-1] or not fits(data, bands.whole):
            continue
        parts = [data[i:i + 4096] for i in range(0, len(data), 4096)]
        if sum(len(p) for p in parts if not fits(p, bands.chunk)) * 4 <= len(data):
            want.append(r)
    assert rows_of(got) == sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in want), key=repr)
    assert 60 < len(want) < corpus.count() - 4


def brute_lines(rows):
    """Documents without the lines that are not the first of their class of equal and near lines."""
    place = {}
    for i, t, *_ in sorted(r for r in rows if r[1] is not None):
        for k, x in enumerate(t.split("\n")):
            if len(x.strip(" ")) >= ld.MIN_CHARS:
                place.setdefault(x.strip(" "), []).append((i, k))
    lines = list(place)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(lines):
        for y in lines[a + 1:]:
            if abs(len(x) - len(y)) <= ld.TAU and find(x) != find(y) and distance(x, y) <= ld.TAU:
                root[find(y)] = find(x)
    first = {}
    for x in lines:
        first[find(x)] = min(first.get(find(x), place[x][0]), place[x][0])
    out = []
    for i, t, lang, source, _ in rows:
        if t is not None:
            own = t.split("\n")
            left = [x for k, x in enumerate(own) if len(x.strip(" ")) < ld.MIN_CHARS or first[find(x.strip(" "))] == (i, k)]
            changed = len(left) < len(own)
            t = "\n".join(left)
            if changed and not re.search("[^\x20\x09-\x0d]", t):
                continue
        out.append((i, t, lang, source, None if t is None else len(t)))
    return sorted(out, key=repr)


def test_line_dedup(spark, corpus):
    some = corpus.where("doc_id < 30 or doc_id > 74")
    want = brute_lines([tuple(r) for r in some.collect()])
    got = rows_of(STAGES["line_dedup"](spark, some, ""))
    assert got == want and sum(len(r[1] or "") for r in want) < sum(len(r.text or "") for r in some.collect()) - 100


def test_ngram_jaccard(spark, corpus):
    rows = [tuple(r) for r in corpus.collect()]
    groups = jaccard([(r[0], r[1]) for r in rows], 80, 5)
    got = rows_of(STAGES["ngram_jaccard"](spark, corpus, ""))
    assert got == sorted((r for r in rows if groups[r[0]][1] == r[0]), key=repr)
    assert len(got) <= len(rows) - 10


def test_mixing(spark, corpus):
    size = {r.doc_id: len((r.text or "").split()) for r in corpus.collect()}
    source = {r.doc_id: r.source for r in corpus.collect()}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    got = STAGES["mixing"](spark, corpus, "").collect()
    want, text = brute_targets(sizes), {r.doc_id: r.text for r in corpus.collect()}
    times, taken = {}, dict.fromkeys(sizes, 0)
    for r in got:
        assert r.text == text[r.doc_id] and r.source == source[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        taken[r.source] += size[r.doc_id]
    assert max(times.values()) <= 3
    assert all(abs(taken[s] - want[s]) <= max(size[i] for i in size if source[i] == s) + 1 for s in sizes)


def test_byte_bpe(spark, corpus):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))
            for r in corpus.collect() for ids in [own.encode_ordinary(r.text or "")]]
    assert sorted(map(tuple, STAGES["byte_bpe"](spark, corpus, "").collect())) == sorted(want)


def test_stages_keep_the_columns(spark, corpus):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, corpus.limit(0), "").dtypes == corpus.dtypes, name
