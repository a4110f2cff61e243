import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mirador.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def one_by_one(lengths, capacity):
    """Best-two-fit bin by bin over single documents, with every pair tried."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        for x in list(left):
            if x <= gap:
                own.append(x)
                left.remove(x)
                gap -= x
        if gap and len(own) > 1:
            small = own[-1]
            pairs = [(x + y, x, y) for i, x in enumerate(left) for y in left[i + 1:] if small < x + y <= gap + small]
            if pairs:
                _, x, y = max(pairs)
                own[-1:] = [x, y]
                left.remove(x)
                left.remove(y)
                left.append(small)
                left.sort(reverse=True)
        bins.append(sorted(own))
    return sorted(bins)


def by_plan(lengths, capacity):
    return sorted(sorted(x for x, c in use for _ in range(c))
                  for times, use in packing.best_two_fit(Counter(lengths), capacity) for _ in range(times))


@pytest.mark.parametrize("capacity, kinds", [(10, 10), (30, 8), (64, 40), (100, 100)])
def test_plan_is_best_two_fit(capacity, kinds):
    rng = random.Random(capacity)
    for _ in range(60):
        of = rng.sample(range(1, capacity + 1), min(kinds, capacity))
        lengths = [rng.choice(of) for _ in range(rng.randrange(0, 80))]
        assert by_plan(lengths, capacity) == one_by_one(lengths, capacity)


def test_plan_stays_small():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.lognormal(6, 1.2, 2_000_000).astype(int) + 1)
    counts = dict(zip(*np.unique(lengths, return_counts=True)))
    plan = packing.best_two_fit({int(a): int(b) for a, b in counts.items()}, 2048)
    assert len(plan) < sum(2048 // x for x in range(1, 2049))
    assert sum(t for t, _ in plan) <= 1.001 * lengths.sum() / 2048 + 1


def check(rows, texts, capacity=2048, end=0):
    """The contract's rules for (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(JSON)
    want = Counter()
    for i, text in texts:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        cut = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(ids)])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for s in held.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packed_documents(spark, documents, clashing):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    for keep in (True, False):
        got = packing.pack_documents(clashing, JSON, keep_ids=keep, ranks_path=RANKS, pattern=public_tokenizers.PATTERN)
        rows = got.collect()
        n = check(rows, texts)
        assert n <= sum(r.length for r in rows) // 2048 + 2
    slow = packing.pack_documents(documents, JSON, capacity=16, end_id=7)
    check(slow.collect(), texts, 16, 7)
    whole = packing.sequences(slow).collect()
    assert all(len(r.ids) <= 16 and r.ids[-1] in (7, *r.ids) for r in whole)
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in slow.collect())
    assert packing.pack_documents(clashing.limit(0), JSON).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["word", "Straße", "東京🙂", "x1", "\n"]) for _ in range(rng.randrange(0, 900)))) for i in range(150)]
    texts += [(200, "a <|endoftext|> b"), (201, None), (202, "x" * 50_000), (None, "no id"), (5, "again"), (5, "again")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(5).withColumn("length", F.lit(1)) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op13_best_two_fit(spark, str(tmp_path)).collect()
    n = check(rows, texts)
    assert n == -(-sum(r.length for r in rows) // 2048)


def test_both_libraries_agree_on_every_character():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(JSON)
    with open(JSON, encoding="utf-8") as f:
        quick = packing.encoder(f.read(), packing.read_ranks(RANKS), public_tokenizers.PATTERN)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(chars), 50_000):
        text = "".join(f"a{c}a {c}{c} 1{c}1 !{c}! {c} \n{c}b{c} |" for c in chars[lo:lo + 50_000])
        assert quick(text).tolist() == t.encode(text, add_special_tokens=False).ids
