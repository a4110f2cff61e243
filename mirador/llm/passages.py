"""Substring dedup by line or paragraph hashing.

A text is cut into units at a separator (lines by default, blank lines for paragraphs).
Units of enough words are normalised (A-Z lower-cased, white space collapsed) and
digested (128 bits). Digests are grouped globally with partial aggregation, so a unit
that a third of all documents hold travels as one row per task; the earliest occurrence
by (doc_id, unit number) stays, every other one is removed. Only digests, numbers and
offsets are shuffled, never texts. Digests seen twice or more are written before they
are joined back, so the join shuffles afresh and AQE can split a hot digest.

Offsets count code points of the original text: ``text[start:end]`` is the unit.

Defined results: null and empty texts have no units; a null id ranks first; documents
are told apart by id and text, so rows that repeat both keep and lose the same units; units of
fewer than ``min_words`` words are left alone; an empty table removes nothing. Extra
columns pass through ``remove_repeats``.

A line is a unit only as it is cut: a passage that fills a part of a line, or runs over lines
cut elsewhere, has no digest in common with its other occurrence. ``repeated_passages``
finds those, over the words of a text whatever its lines. Every window of ``n_words`` words
chooses the run of ``gram`` words with the least hash (winnowing), so equal windows choose
equal runs. Only chosen runs are grouped globally, some six in a hundred words. Windows whose
chosen run was seen twice or more are digested (128 bits) and grouped as lines are; the
earliest occurrence by (doc_id, text, word number) stays. No pairs are built, and no
repeated window is lost. Consecutive windows with their first occurrences at one distance
are one passage. Texts of fewer than ``n_words`` words have none.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirador.llm.common import WORD, join_small, read_table, temporary_name, written
from mirador.llm.ngram_join import KNOWN_WORDS, U64, mix

MIN_WORDS = 20
PASSAGE_WORDS = 50
GRAM_WORDS = 20
BROADCAST_PRINTS = 1_000_000   # run hashes, 8 bytes each
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
WORDS = re.compile(WORD)
UNITS_DDL = "doc_id long, th long, unit long, start long, end long, n_words long, digest binary"


def units(docs: DataFrame, separator: str = "\n", min_words: int = MIN_WORDS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, unit, start, end, n_words, digest) of every unit of enough words."""
    def run(batches):
        for b in batches:
            rows = []
            for i, th, text in zip(*(c.to_pylist() for c in b.columns)):
                start = 0
                for k, unit in enumerate((text or "").split(separator)):
                    words = unit.encode().lower().split()
                    if len(words) >= min_words:
                        digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                        rows.append((i, th, k, start, start + len(unit), len(words), digest))
                    start += len(unit) + len(separator)
            for lo in range(0, len(rows), 10_000):
                cols = list(zip(*rows[lo:lo + 10_000]))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())],
                    names=["doc_id", "th", "unit", "start", "end", "n_words", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"),
                       F.col(text_col).alias("text")).mapInArrow(run, UNITS_DDL)


def repeated_units(docs: DataFrame, separator: str = "\n", min_words: int = MIN_WORDS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The units to remove, with their offsets and the place of the occurrence that stays."""
    u = written(units(docs, separator, min_words, id_col, text_col), "units")
    place = F.struct("doc_id", "th", "unit")
    firsts = u.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = written(firsts.filter(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first"), "unit-firsts")
    return u.join(firsts, "digest").filter(~place.eqNullSafe(F.col("first"))).distinct() \
        .select("doc_id", "th", "unit", "start", "end", "n_words",
                F.col("first.doc_id").alias("first_doc_id"), F.col("first.unit").alias("first_unit"))


def remove_repeats(docs: DataFrame, separator: str = "\n", min_words: int = MIN_WORDS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated units, columns unchanged (a document's removed unit
    numbers are one row, bounded by its own units)."""
    key, of, drop = (temporary_name(x, docs.columns) for x in ("repeat_id", "repeat_text", "repeat_units"))
    gone = repeated_units(docs, separator, min_words, id_col, text_col) \
        .groupBy(F.col("doc_id").alias(key), F.col("th").alias(of)).agg(F.collect_set(F.col("unit").cast("int")).alias(drop))
    parts = F.split(F.col(text_col), f"\\Q{separator}\\E", -1)
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop)))
    left = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), separator)
    out = docs.join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(of)), "left")
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(left)
    return out.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_line_hashing(spark, sf_dir: str) -> DataFrame:
    """Repeated lines of 20 words or more over all ``documents``."""
    return repeated_units(read_table(spark, sf_dir, "documents")).drop("th")


OP5_SQL = r"""
WITH lines AS (
 SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
units AS (
 SELECT doc_id, CAST(k - 1 AS BIGINT) AS unit, parts[k] AS line,
  CAST(coalesce(list_sum(list_transform(parts[1:k-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start
 FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM lines)),
words AS (
 SELECT doc_id, unit, start, start + length(line) AS "end",
  regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x20\x09-\x0D]+') AS w FROM units),
kept AS (SELECT doc_id, unit, start, "end", CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, ' ') AS norm
 FROM words WHERE len(w) >= 20),
ranked AS (SELECT *, first_value(doc_id) OVER o AS first_doc_id, first_value(unit) OVER o AS first_unit FROM kept
 WINDOW o AS (PARTITION BY norm ORDER BY doc_id, unit))
SELECT doc_id, unit, start, "end", n_words, first_doc_id, first_unit FROM ranked
WHERE doc_id <> first_doc_id OR unit <> first_unit
"""


# ------------------------------------------------------------------ passages of words
def _hashes(words: list[bytes], known: dict, hash_word) -> np.ndarray:
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = hash_word(w)
    return np.array(list(map(known.__getitem__, words)), U64)


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes mod 2^64 of all runs of ``n`` values; ``base`` is odd."""
    m = len(h) - n + 1
    power = np.ones(len(h), U64)
    power[1:] = U64(base)
    back = np.ones(m, U64)
    back[1:] = U64(pow(base, -1, 1 << 64))
    total = np.zeros(len(h) + 1, U64)
    total[1:] = np.cumsum(h * np.cumprod(power), dtype=U64)
    return (total[n:] - total[:m]) * np.cumprod(back)


def chosen(h: np.ndarray, n_words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all ``gram``-word runs, for every ``n_words``-word window the last of its
    runs with the least hash): equal windows choose equal runs, wherever they stand."""
    g = mix(rolling(h, gram, BASES[0]), 41)
    span = n_words - gram + 1
    m, at = len(h) - n_words + 1, []
    for lo in range(0, m, 20_000):
        view = np.lib.stride_tricks.sliding_window_view(g[lo:min(lo + 20_000, m) + span - 1], span)
        at.append(np.arange(lo, lo + len(view)) + span - 1 - view[:, ::-1].argmin(axis=1))
    return g, np.concatenate(at)


def fingerprints(docs: DataFrame, n_words: int, gram: int) -> DataFrame:
    """(doc_id, th, prints): the hashes of the runs that the document's windows choose."""
    def run(batches):
        import xxhash

        known: dict = {}
        for b in batches:
            ids, ths, prints = [], [], []
            for i, th, text in zip(*(c.to_pylist() for c in b.columns)):
                words = (text or "").encode().lower().split()
                if len(words) >= n_words:
                    g, at = chosen(_hashes(words, known, xxhash.xxh3_64_intdigest), n_words, gram)
                    ids.append(i)
                    ths.append(th)
                    prints.append(g[np.unique(at)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(prints, pa.list_(pa.int64()))],
                names=["doc_id", "th", "prints"])

    return docs.mapInArrow(run, "doc_id long, th long, prints array<long>")


def shared_windows(texts: DataFrame, n_words: int, gram: int) -> DataFrame:
    """(doc_id, th, text, prints) -> the windows whose chosen run is one of ``prints``."""
    def run(batches):
        import xxhash

        known: dict = {}
        for b in batches:
            for i, th, text, prints in zip(*(c.to_pylist() for c in b.columns)):
                h = _hashes(text.encode().lower().split(), known, xxhash.xxh3_64_intdigest)
                g, at = chosen(h, n_words, gram)
                pos = np.flatnonzero(np.isin(g[at].view(np.int64), np.array(prints, np.int64)))
                one, two = (rolling(h, n_words, base)[pos].view(np.int64) for base in BASES)
                place = np.array([m.span() for m in WORDS.finditer(text)], np.int64)
                start, end = place[pos, 0], place[pos + n_words - 1, 1]
                for lo in range(0, len(pos), 10_000):
                    s = slice(lo, lo + 10_000)
                    n = len(pos[s])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * n, pa.int64()), pa.array([th] * n, pa.int64()),
                         *(pa.array(c[s], pa.int64()) for c in (pos, start, end, one, two))],
                        names=["doc_id", "th", "word", "start", "end", "d1", "d2"])

    return texts.mapInArrow(run, "doc_id long, th long, word long, start long, end long, d1 long, d2 long")


def repeated_passages(docs: DataFrame, n_words: int = PASSAGE_WORDS, gram: int = GRAM_WORDS,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, word, start, end, n_words, first_doc_id, first_word, first_start): the
    longest runs of words whose windows of ``n_words`` all stand earlier, at one place."""
    if not 0 < gram <= n_words:
        raise ValueError("gram must lie between 1 and n_words")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"),
                    F.col(text_col).alias("text"))
    prints = written(fingerprints(d, n_words, gram), "passage-prints")
    each = prints.select("doc_id", "th", F.explode("prints").alias("print"))
    shared = written(each.groupBy("print").count().filter("count > 1").select("print"), "passage-shared")
    hits = join_small(each, shared, "print", "left_semi", shared.count(), BROADCAST_PRINTS)
    hits = hits.groupBy("doc_id", "th").agg(F.collect_set("print").alias("prints"))
    hits = written(hits.withColumnsRenamed({"doc_id": "h_id", "th": "h_th"}), "passage-hits")
    n_prints = hits.agg(F.coalesce(F.sum(F.size("prints")), F.lit(0))).first()[0]
    texts = join_small(d, hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")), "inner",
                       n_prints, BROADCAST_PRINTS).select("doc_id", "th", "text", "prints")
    w = written(shared_windows(texts, n_words, gram), "passage-windows")
    place = F.struct("doc_id", "th", "word", "start")
    firsts = w.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = written(firsts.filter(~F.col("first").eqNullSafe(F.col("last"))).select("d1", "d2", "first"), "passage-firsts")
    later = w.join(firsts, ["d1", "d2"]).filter(~place.eqNullSafe(F.col("first"))) \
        .select("doc_id", "th", "word", "start", "end", "first", F.col("first.doc_id").alias("f_id"),
                F.col("first.th").alias("f_th"), (F.col("first.word") - F.col("word")).alias("shift"))
    run = ["doc_id", "th", "f_id", "f_th", "shift"]
    number = F.dense_rank().over(Window.partitionBy(*run).orderBy("word"))      # repeated rows have one number
    runs = later.withColumn("run", F.col("word") - number).groupBy(*run, "run").agg(
        F.min("word").alias("word"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max("word") - F.min("word") + n_words).alias("n_words"), F.min("first").alias("first"))
    return runs.select("doc_id", "th", "word", "start", "end", "n_words", F.col("f_id").alias("first_doc_id"),
                       F.col("first.word").alias("first_word"), F.col("first.start").alias("first_start"))


def op5_shared_passages(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more over all ``documents``, wherever lines are cut."""
    return repeated_passages(read_table(spark, sf_dir, "documents")).drop("th")
