"""Quality rules: compression bands over whole documents and fixed chunks.

A text is compressed with zstandard as a whole and in fixed chunks. Its ratio
(compressed / plain bytes) must lie in a band that depends on its length: below it the
text repeats itself, above it it is noise that does not compress (keys, base64). A
document also goes if too large a share of its bytes lies in chunks out of the band for the
chunk's length, so a long document cannot hide a repetitive half behind a clean one. Every text
is cut, the last chunk being what is left; a text of one chunk is that chunk.

Before the bands come the base rules: at least 50 words, and at most half of the words
in three-word windows that occur twice or more.

The work is one pass over Arrow batches without a shuffle. Words and windows are counted
per text; memory follows the longest text of a batch.

Defined results: a null or empty text has zeros, fails the base rules and is not kept.
Rows are judged one by one, so repeated rows get repeated results. Extra columns pass
through ``quality_filter``; ``quality_scores`` returns only its own columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.common import lean, read_table

SPACE = " \t\n\x0b\x0c\r"
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


@dataclass(frozen=True)
class Bands:
    """Allowed ratios by length in bytes: (shorter than, lowest, highest)."""

    level: int = 3
    whole: tuple = ((300, 0.45, 1.60), (1_000, 0.47, 0.85), (3_000, 0.445, 0.70),
                    (10_000, 0.41, 0.66), (float("inf"), 0.38, 0.64))
    chunk_bytes: int = 4096
    chunk: tuple = ((300, 0.40, 1.70), (1_000, 0.42, 0.95), (3_000, 0.42, 0.74), (float("inf"), 0.40, 0.68))
    bad_chunks: float = 0.25       # of a text's bytes, at most, in chunks out of their band
    symbols: str = "#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n, seen, repeated = len(words), {}, bytearray(len(words))
    for i in range(n - 2):
        w = (words[i], words[i + 1], words[i + 2])
        first = seen.setdefault(w, i)
        if first != i:
            repeated[first:first + 3] = b"\1\1\1"
            repeated[i:i + 3] = b"\1\1\1"
    return sum(repeated)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if HAS_WORD.search(x)]
    return len(lines) - len(set(lines))


def inside(ratio: float, size: int, bands: tuple) -> bool:
    """Whether the ratio lies in the band for the size."""
    low, high = next((lo, hi) for limit, lo, hi in bands if size < limit)
    return low <= ratio <= high


def ratios(data: bytes, bands: Bands, compress) -> tuple[float, int, int, int]:
    """(ratio of the whole, chunks, chunks out of their band, bytes in those)."""
    if not data:
        return 0.0, 0, 0, 0
    whole = len(compress(data)) / len(data)
    chunks, bad, bad_bytes = 0, 0, 0
    for i in range(0, len(data), bands.chunk_bytes):
        part = data[i:i + bands.chunk_bytes]
        ratio = whole if len(part) == len(data) else len(compress(part)) / len(part)
        chunks += 1
        if not inside(ratio, len(part), bands.chunk):
            bad, bad_bytes = bad + 1, bad_bytes + len(part)
    return whole, chunks, bad, bad_bytes


def judge(text: str | None, bands: Bands, compress) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()           # ASCII white space, as in the word rule
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in bands.symbols)
    repeats = repeated_words(words)
    base_failed = n < 50 or 100 * repeats > 50 * n
    ratio, chunks, bad, bad_bytes = ratios(data, bands, compress)
    kept = not base_failed and inside(ratio, len(data), bands.whole) and bad_bytes <= bands.bad_chunks * len(data)
    return n, chars, symbols, duplicate_lines(text), repeats, base_failed, ratio, chunks, bad, kept


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean")
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _judge(bands: Bands):
    import zstandard

    compress = zstandard.ZstdCompressor(level=bands.level).compress
    return lambda text: judge(text, bands, compress)


def quality_scores(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, ratio, verdict) per row."""
    def run(batches):
        one = _judge(bands)
        for b in batches:
            rows = [one(t.as_py()) for t in b.column(1)]
            cols = list(zip(*rows)) if rows else [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, type=t) for c, t in zip(cols, TYPES))], names=["doc_id", *NAMES])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(lean(run), f"doc_id long, {SCHEMA}")


TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]


def quality_filter(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The documents that pass, columns unchanged."""
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])     # names may hold dots

    def run(batches):
        one = _judge(bands)
        for b in batches:
            yield b.filter(pa.array([one(t.as_py())[-1] for t in b.column(at)], type=pa.bool_()))

    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)


def op3_compression_bands(spark, sf_dir: str) -> DataFrame:
    """Base rules and compression bands over every text of ``documents``."""
    return quality_scores(read_table(spark, sf_dir, "documents"))
