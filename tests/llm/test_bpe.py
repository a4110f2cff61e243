import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from mirador.llm import attribution, bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def texts(documents):
    odd = ["it's  we'll\tI'd\r\n\r\n x", "\x1c\x1d a\x85b\xa0 c  d　e​f", "a" * 50_000, " " * 3_000 + "x",
           "½ ² Ⅷ ٣ 漢字かな 한국어 עברית हिन्दी", "é 🙂👩‍👩‍👧 ퟿", "#*$%&|<>" * 9, "\n\n\n", "1,234.56"]
    return odd


def test_equal_to_the_tokenizer_library(spark, documents, texts, reference):
    extra = spark.createDataFrame([(100 + i, t, "en", "s0", 1) for i, t in enumerate(texts)], documents.schema)
    got = [(r.doc_id, r.ids, bytes(r.bytes)) for r in
           bpe.decode(bpe.encode(documents.unionByName(extra), PATH, PATTERN), PATH).collect()]
    want = [(r.doc_id, reference(r.text or ""), (r.text or "").encode()) for r in documents.collect()]
    want += [(100 + i, reference(t), t.encode()) for i, t in enumerate(texts)]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_small_blocks_give_the_same(spark, documents, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MIN_BUCKETS", 3)
    split = documents.selectExpr("doc_id", "text").select(
        "doc_id", bpe.pretokens(documents["text"], PATTERN).alias("tokens"))
    words, docs = (bpe.pack_blocks(split, 3, words_only, block_tokens=50) for words_only in (True, False))
    assert words.select("block").distinct().count() > 1
    ranks = bpe.share_ranks(spark, PATH)
    got = {r.doc_id: r.ids for r in bpe.reassemble(docs, bpe.encode_buckets(words, ranks)).collect()}
    assert got == {r.doc_id: reference(r.text or "") for r in documents.collect()}


def test_documents_that_change_between_the_passes_end_the_job(spark, documents):
    split, other = (documents.select("doc_id", bpe.pretokens(t, PATTERN).alias("tokens"))
                    for t in (documents["text"], F.concat(documents["text"], F.lit(" more"))))
    encoded = bpe.encode_buckets(bpe.pack_blocks(split, 3, True), bpe.share_ranks(spark, PATH))
    with pytest.raises(Exception, match="changed between"):
        bpe.reassemble(bpe.pack_blocks(other, 3, False), encoded).collect()


def test_copies_in_blocks_of_their_own(spark, documents, reference):
    same = documents.filter("doc_id = 1").select("text").limit(1).crossJoin(spark.range(0, 40, 1, 4)) \
        .selectExpr("id AS doc_id", "text")
    got = {r.doc_id: r.ids for r in bpe.encode(same, PATH, PATTERN).collect()}
    assert len(got) == same.count() and len(set(map(tuple, got.values()))) <= 1


def test_digests(spark, documents, clashing, reference):
    rows = bpe.digests(bpe.decode(bpe.encode(clashing, PATH, PATTERN), PATH)).collect()
    assert len(rows) == documents.count()
    text = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in rows:
        ids = reference(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_empty_table(spark, documents):
    assert bpe.encode(documents.limit(0), PATH, PATTERN).count() == 0


def test_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="vocabulary|out of bounds"):
        bpe.decode(spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>"), PATH).collect()


def test_packing_round_trip():
    a, b = np.array([1, 70_000, 3], np.int32), np.array([5, 2 ** 40], np.int64)
    x, y, z = bpe.unpack(bpe.pack(a, b, np.zeros(0, np.uint8)), np.int32, np.int64, np.uint8)
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist() and len(z) == 0


@pytest.mark.parametrize("rule,want", [("first", [2, 1]), ("last", [1, 2]), ("most", [1, 2])])
def test_boundary_rules(rule, want):
    # tokens [0, 2) [2, 6) [6, 7); sections [0, 3) [3, 7)
    section, crosses = attribution.allocate(np.array([2, 6, 7]), np.array([3, 7]), rule)
    assert np.bincount(section).tolist() == want and crosses.tolist() == [False, True, False]


def test_sections_add_up(spark, documents, clashing, texts, reference):
    extra = spark.createDataFrame([(100 + i, t, "en", "s0", 1) for i, t in enumerate(texts)], documents.schema)
    all_rows = clashing.select(*documents.columns).unionByName(extra)
    for rule in attribution.RULES:
        got = attribution.token_counts(all_rows, PATH, PATTERN, rule).collect()
        per, spans = {}, {}
        for r in got:
            per[r.doc_id] = per.get(r.doc_id, 0) + r.n_tokens
            spans.setdefault(r.doc_id, set()).add((r.start, r.end))
        for r in all_rows.collect():
            if r.text is None:
                assert r.doc_id not in per
            elif r.doc_id != 4:           # repeated rows
                assert per[r.doc_id] == len(reference(r.text))
                assert max(e for _, e in spans[r.doc_id]) == len(r.text)
    assert attribution.token_counts(documents.limit(0), PATH, PATTERN).count() == 0
    with pytest.raises(ValueError):
        attribution.token_counts(documents, PATH, PATTERN, "none")


def test_every_character_is_split_as_the_library_does(spark):
    """Letters and numbers newer than the JVM's Unicode included."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [(k, "".join(f"a{c}a {c}{c} 1{c}1 !{c}! {c}" for c in chars[lo:lo + 4000])) for k, lo in enumerate(range(0, len(chars), 4000))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {i: own.encode_ordinary(t) for i, t in texts}
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df, path, PATTERN).collect()}
    assert [i for i in want if got[i] != want[i]] == []


def test_letters_newer_than_the_jvm(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [(1, "a\U000105a7a"), (2, "xࡰy \U00010d40\U00010d41 z"), (3, "plain text 12")]
    got = {r.doc_id: list(r.ids) for r in bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), path, PATTERN).collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in texts} and got[1] == [64, 172, 238, 244, 11898]


def test_classes_are_the_library_s(spark):
    letters, numbers = bpe.library_class("L"), bpe.library_class("N")
    assert {0x41, 0xe9, 0x4e00, 0x105a7} <= letters and {0x30, 0xb2, 0x10d40} <= numbers and not letters & numbers
    assert bpe.ranges({1, 2, 3, 9}) == r"\x{1}-\x{3}\x{9}-\x{9}"
