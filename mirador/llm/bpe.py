"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

Encoding
1. Spark splits every text into pre-tokens (``regexp_extract_all``). Each task packs its
   documents into blocks of about two million pre-tokens and sends off, per block, the
   block's distinct words by hash bucket (pre-aggregation: a word leaves a block once,
   however often it occurs).
2. One group sees all blocks' words of its bucket and encodes each distinct word once.
3. The ids are shuffled back to their blocks. The documents are split once more, now into
   positions -> block word numbers, joined to the ids of their block, and put together
   again in order.
Decoding joins ids with the token-byte table (the vocabulary, bounded and shipped to the
tasks) and concatenates the bytes.

Splitting twice costs less than keeping the documents' positions on disk between the steps.
A block is named by its partition, its place there and a hash of its pre-tokens, so both
passes and any repeated task give it the same name; ``docs`` must return the same rows in
the same order when read again, as a table does. If it doesn't, names differ and the job
fails instead of mixing blocks up. A block is bounded by its pre-tokens, a bucket by the
number of buckets, which grows with the rows.

The vocabulary file is a parameter (a path that the driver can read). Defined results: a
null or empty text has no ids; repeated rows and repeated or null ids stay rows of their
own; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm.common import lean, read_table

# Java's \s is ASCII: Unicode white space is spelt out.
UNICODE_SPACE = r"\t-\r\x20\x85\xa0  -     　"
BLOCK_TOKENS = 2_000_000
ROWS_PER_BUCKET = 4_000        # documents per hash bucket of words
MIN_BUCKETS = 16


def library_class(prop: str) -> set[int]:
    """The code points that the tokenizer library's regex counts as \\p{prop}."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = tiktoken.Encoding("class", pat_str=rf"\p{{{prop}}}+", special_tokens={},
                              mergeable_ranks={bytes([i]): i for i in range(256)})
    return set(map(ord, bytes(found.encode_ordinary(every)).decode()))


def jvm_class(spark: SparkSession, prop: str) -> set[int]:
    """The same of the JVM's regex, whose Unicode version may be older."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kept = spark._jvm.java.util.regex.Pattern.compile(rf"\P{{{prop}}}+").matcher(every).replaceAll("")
    return set(map(ord, kept))


def ranges(points: set[int]) -> str:
    """Code points as the inside of a Java character class."""
    out, last = [], None
    for c in sorted(points):
        if last is not None and c == last + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
        last = c
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


_DIFFERENCES: dict[str, dict[str, tuple[set[int], set[int]]]] = {}


def class_differences(spark: SparkSession) -> dict[str, tuple[set[int], set[int]]]:
    """Per class, the code points that only the library has, and those that only the JVM has."""
    app = spark.sparkContext.applicationId
    if app not in _DIFFERENCES:
        both = {p: (library_class(p), jvm_class(spark, p)) for p in "LN"}
        _DIFFERENCES[app] = {p: (a - b, b - a) for p, (a, b) in both.items()}
    return _DIFFERENCES[app]


def java_pattern(pattern: str, differences: dict | None = None) -> str:
    """The pre-token pattern with Unicode white space, and the library's classes, for Java's regex engine."""
    out = pattern.replace(r"[^\s", f"[^{UNICODE_SPACE}")
    out = out.replace(r"\S", f"[^{UNICODE_SPACE}]").replace(r"\s", f"[{UNICODE_SPACE}]")
    for p, (more, fewer) in (differences or {}).items():
        own = rf"[\p{{{p}}}&&[^{ranges(fewer)}]]" if fewer else rf"\p{{{p}}}"
        out = out.replace(rf"\p{{{p}}}", f"[{own}{ranges(more)}]")
    return out


def pretokens(text: Column, pattern: str) -> Column:
    """Array of pre-tokens in order; empty for null. Texts that hold no code point beyond the first
    on which the JVM and the library differ take the plain, quicker pattern."""
    spark = SparkSession.getActiveSession()
    differences = {p: d for p, d in class_differences(spark).items() if d[0] or d[1]}
    out = F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))
    if differences:
        lowest = min(min(more | fewer) for more, fewer in differences.values())
        exact = F.regexp_extract_all(text, F.lit(java_pattern(pattern, differences)), F.lit(0))
        out = F.when(F.rlike(text, F.lit(rf"[\x{{{lowest:x}}}-\x{{10ffff}}]")), exact).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def share_ranks(spark: SparkSession, path: str):
    """The vocabulary (fixed size, some 50,000 entries) as a broadcast variable."""
    return spark.sparkContext.broadcast(read_ranks(path))


def word_encoder(ranks: dict[bytes, int]):
    """word -> ids; the whole word is one piece, whatever it holds."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_table(ranks: dict[bytes, int]) -> pa.Array:
    """Token bytes by id (null where an id is free)."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return pa.array(table, type=pa.large_binary())


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray):
    """Concatenate flat[starts[i]:starts[i] + lens[i]] for i in ``which``; and the lengths."""
    n = lens[which]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return flat[at + np.repeat(starts[which] - (ends - n), n)], n


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed bytes of arrays; equal places of the numbers' bytes lie together, which
    compresses small numbers well."""
    import zstandard

    planes = [a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    head = np.array([len(x) for x in planes], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def unpack(data: bytes, *types) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for size, t in zip(sizes, types):
        width = np.dtype(t).itemsize
        plane = np.frombuffer(raw, np.uint8, size, at).reshape(width, -1)
        out.append(np.ascontiguousarray(plane.T).view(t).ravel())
        at += int(size)
    return out


PACKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("first", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
PACKED_DDL = "block long, bucket int, first long, doc_ids array<long>, payload binary"
DOCS_PER_ROW = 32
COMMON = (3, 30, 1000)         # occurrences in a block from which a word gets a smaller number


def block_name(partition: int, place: int, words: list[bytes], at: np.ndarray) -> int:
    """The same number for the same pre-tokens at the same place."""
    import xxhash

    h = xxhash.xxh3_64(np.array([partition, place, len(words)], np.int64).tobytes())
    h.update(np.array([len(w) for w in words], np.int32).tobytes())
    h.update(b"".join(words))
    h.update(at.astype(np.int32).tobytes())
    return h.intdigest() >> 1


def _pack_block(name, ids: list, tokens: pa.ChunkedArray, lens: list, buckets: int, words_only: bool) -> pa.RecordBatch:
    """The distinct words by bucket, or the documents (bucket -1), of one block.

    Block numbers run by (how common, bucket), so each row of words is one run of numbers."""
    coded = tokens.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy(zero_copy_only=False) if words else np.zeros(0, np.int32)
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    rare = len(COMMON) - np.digitize(np.bincount(at, minlength=len(words)), COMMON)
    run = rare * buckets + bucket
    order = np.argsort(run, kind="stable")
    number = np.empty(len(words), np.int32)
    number[order] = np.arange(len(words), dtype=np.int32)
    block, rows, start, first = block_name(*name, words, at), [], 0, 0
    if words_only:
        for r, n in zip(*np.unique(run, return_counts=True)):
            own = [words[j] for j in order[first:first + n]]
            rows.append((block, int(r) % buckets, first, None,
                         pack(np.array([len(w) for w in own], np.int32), np.frombuffer(b"".join(own), np.uint8))))
            first += int(n)
    else:
        for lo in range(0, len(ids), DOCS_PER_ROW):
            n = np.array(lens[lo:lo + DOCS_PER_ROW], np.int64)
            end = start + int(n.sum())
            rows.append((block, -1, len(words), ids[lo:lo + DOCS_PER_ROW], pack(n, number[at[start:end]])))
            start = end
    if not rows:
        return pa.RecordBatch.from_pylist([], schema=PACKED)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)


def pack_blocks(split: DataFrame, buckets: int, words_only: bool, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, tokens array<string>) -> the words or the documents of packed blocks."""
    def run(batches):
        partition, place = TaskContext.get().partitionId(), 0
        ids, lens, tokens, held = [], [], [], 0

        def packed():
            return _pack_block((partition, place), ids, pa.chunked_array(tokens, type=pa.string()), lens, buckets,
                               words_only)

        for b in batches:
            col = b.column(1)
            n = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, start = col.flatten(), 0
            for lo in range(0, len(n), 100):       # a block may end within a batch
                hi = min(lo + 100, len(n))
                size = int(n[lo:hi].sum())
                ids += b.column(0).slice(lo, hi - lo).to_pylist()
                lens += n[lo:hi].tolist()
                tokens.append(flat.slice(start, size))
                start, held = start + size, held + size
                if held >= block_tokens:
                    yield packed()
                    place += 1
                    ids, lens, tokens, held = [], [], [], 0
        if ids:
            yield packed()

    return split.mapInArrow(lean(run), PACKED_DDL)


def encode_buckets(words: DataFrame, ranks) -> DataFrame:
    """Encode each distinct word of a bucket once; answer every block with its ids."""
    def run(table: pa.Table) -> pa.Table:
        encode, known, out = word_encoder(ranks.value), {}, []
        for payload in table.column("payload"):
            lens, raw = unpack(payload.as_py(), np.int32, np.uint8)
            text, at, answer, counts = raw.tobytes(), 0, [], []
            for n in lens.tolist():
                w = text[at:at + n]
                at += n
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = encode(w.decode())
                answer += ids
                counts.append(len(ids))
            out.append(pack(np.array(counts, np.int32), np.array(answer, np.int32)))
        return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(out, pa.binary()))

    return words.groupBy("bucket").applyInArrow(run, PACKED_DDL)


def reassemble(packed_docs: DataFrame, encoded: DataFrame) -> DataFrame:
    """Join ids back to their block and put every document together by position."""
    def run(table: pa.Table) -> pa.Table:
        words = table.filter(pc.greater_equal(table.column("bucket"), 0)).sort_by("first")
        docs = table.filter(pc.equal(table.column("bucket"), -1))
        parts = [unpack(p.as_py(), np.int32, np.int32) for p in words.column("payload")]
        lens = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int32)]).astype(np.int64)
        flat = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int32)])
        if len(lens) != (docs.column("first")[0].as_py() if docs.num_rows else -1):
            raise ValueError("the documents changed between the two passes")
        starts = np.cumsum(lens) - lens
        ids, counts = [], []
        for p in docs.column("payload"):
            n, at = unpack(p.as_py(), np.int64, np.int32)
            got, per_word = ragged_take(flat, starts, lens, at)
            upto = np.concatenate([[0], np.cumsum(per_word)])
            stop = np.cumsum(n)
            ids.append(got)
            counts += (upto[stop] - upto[stop - n]).tolist()
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        values = pa.array(np.concatenate(ids or [np.zeros(0, np.int32)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
        doc_ids = docs.column("doc_ids").combine_chunks()
        return pa.table({"doc_id": doc_ids.flatten(), "ids": lists})

    return packed_docs.unionByName(encoded).groupBy("block") \
        .applyInArrow(run, "doc_id long, ids array<int>")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row of ``docs``."""
    ranks = share_ranks(docs.sparkSession, ranks_path)
    buckets = max(MIN_BUCKETS, docs.count() // ROWS_PER_BUCKET)
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), pretokens(F.col(text_col), pattern).alias("tokens"))
    words, packed_docs = pack_blocks(split, buckets, True), pack_blocks(split, buckets, False)
    return reassemble(packed_docs, encode_buckets(words, ranks))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, bytes): the ids' bytes from the token table."""
    ranks = share_ranks(encoded.sparkSession, ranks_path)

    def run(batches):
        table = token_table(ranks.value)
        for b in batches:
            ids = b.column(1)
            flat = table.take(ids.flatten())
            if flat.null_count:
                raise ValueError("an id is not in the vocabulary")
            n = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            lists = pa.LargeListArray.from_arrays(pa.array(ends), flat)
            joined = pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, joined.cast(pa.binary())],
                                             names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids array<int>, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(decode(encode(docs, path, public_tokenizers.PATTERN), path))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode every text of ``documents``, then decode the ids."""
    return round_trip(read_table(spark, sf_dir, "documents"))
