"""Substring dedup by hashing units whose borders follow from the words.

A text is cut into units that do not depend on its lines: a unit ends at a word when a hash
of the word and the one before says so (one word in ``every`` on average). Equal passages are
therefore cut alike, but for the words before their first border and after their last, however
their lines are laid out. Units are normalised (A-Z lower-cased, white space left out) and
digested (128 bits), digests are grouped globally, the earliest occurrence by (doc_id, text,
unit) stays, and every other one is a repeat. Consecutive repeats of a document are joined into
passages, with the offsets of the original text; passages of fewer than ``min_words`` words are
left alone. A passage of 50 words keeps ``min_words`` = 20 of them in whole units but for some
three times in a hundred; a longer one nearly always (README: measured recall).

A unit crosses the shuffle once, packed with the others of its task and hash bucket. Tasks join
a chunk's equal units first, so a unit that a third of all documents hold is one unit a chunk
there; the chunk's other occurrences are repeats already and need only the earliest place, by
a join that AQE can split. Buckets grow in number with the rows; a task holds one at a time.

Offsets count code points of the original text: ``text[start:end]`` is the passage.

Defined results: null and empty texts and texts of white space have no units; a null id ranks
first; documents are told apart by id and text, so rows that repeat both have one place and
keep and lose the same passages; a long stretch without a border is one unit, however long;
an empty table gives no rows; extra columns are left out, and pass through ``cut_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirador.llm.bpe import pack, unpack
from mirador.llm.common import lean, read_table, temporary_name, written
from mirador.llm.ngram_join import KNOWN_WORDS, U64, mix

EVERY = 6                      # words a unit, on average
MIN_WORDS = 20                 # words of a passage, at least
CHUNK_UNITS = 400_000          # units a task joins before the shuffle
ROWS_PER_BUCKET = 4_000        # documents per hash bucket of digests
MIN_BUCKETS = 16
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
PLAIN = ("d1", "d2", "doc_id", "th", "unit", "word", "n_words", "start", "end")
UNITS_DDL = "bucket long, payload binary, " + ", ".join(f"{c} long" for c in PLAIN)
PLACED_DDL = "first boolean, " + ", ".join(f"{c} long" for c in PLAIN)
PACKED = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8,
          np.int64, np.uint8, np.int64)


def cut(text: str, known: dict, every: int) -> tuple[np.ndarray, ...] | None:
    """(d1, d2, unit, word, n_words, start, end) of the text's units, or None without words."""
    raw = text.encode()
    words = raw.lower().split()                                # A-Z only; ASCII white space
    if not words:
        return None
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.md5(w).digest()[:8], "big")
    h = np.array(list(map(known.__getitem__, words)), U64)
    top = (h >> U64(56)).astype(np.int64)
    stop = (3 * np.append(0, top[:-1]) + top) % every == 0
    stop[-1] = True
    last = np.flatnonzero(stop)
    first = np.append(0, last[:-1] + 1)
    a = np.frombuffer(raw, np.uint8)
    space = np.ones(len(a) + 2, np.int8)
    space[1:-1] = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(space))
    chars = np.cumsum((a & 0xC0) != 0x80)
    digests = []
    for base in BASES:
        power, back = np.full(len(h), base, U64), np.full(len(h), pow(base, -1, 1 << 64), U64)
        power[0] = back[0] = 1
        total = np.append(U64(0), np.cumsum(h * np.cumprod(power), dtype=U64))
        digests.append(mix((total[last + 1] - total[first]) * np.cumprod(back)[first] ^ (last - first).astype(U64), 51))
    return (*digests, np.arange(len(last)), first, last - first + 1, chars[edge[0::2][first]] - 1, chars[edge[1::2][last] - 1])


def first_of_each(d1, d2, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by digest and place without rows that repeat both, whether a row is its digest's
    first, number of different places of the row's digest)."""
    order = np.lexsort((place, d2, d1))
    a, b, p = d1[order], d2[order], place[order]
    same = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
    new = ~(same & np.append(False, p[1:] == p[:-1]))
    order, first = order[new], ~same[new]
    starts = np.flatnonzero(first)
    return order, first, np.repeat(np.diff(np.append(starts, len(order))), np.diff(np.append(starts, len(order))))


def plain_rows(columns: dict, ddl: str) -> pa.RecordBatch:
    """A batch with ``columns``; the others are null."""
    n = len(next(iter(columns.values())))
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(n, kinds[k])
                                       for c, k in names], names=[c for c, _ in names])


class Chunk:
    """The units of a task's next documents."""

    def __init__(self) -> None:
        self.docs, self.parts, self.held = {}, [], 0

    def add(self, doc_id, th, units) -> None:
        doc = self.docs.setdefault((doc_id is not None, doc_id or 0, th), len(self.docs))
        self.parts.append((np.full(len(units[0]), doc), *units))
        self.held += len(units[0])

    def batches(self, buckets: int, row: int):
        doc, d1, d2, unit, *rest = (np.concatenate(c) for c in zip(*self.parts))
        table = sorted(self.docs, key=lambda d: d)             # by (has an id, id, text)
        number = np.empty(len(table), np.int64)
        number[[self.docs[d] for d in table]] = np.arange(len(table))
        doc = number[doc]
        has, ids, ths = (np.array([d[k] for d in table], np.int64) for k in range(3))
        order, first, times = first_of_each(d1, d2, doc << 32 | unit)
        later = order[~first]
        for lo in range(0, len(later), 50_000):
            at = later[lo:lo + 50_000]
            cols = dict(zip(PLAIN, (d1[at].view(np.int64), d2[at].view(np.int64), None, ths[doc[at]], unit[at], *(c[at] for c in rest))))
            cols["doc_id"] = pa.array(ids[doc[at]], mask=has[doc[at]] == 0)
            cols["bucket"] = (np.arange(row + lo, row + lo + len(at)) * 7919) % buckets
            yield plain_rows(cols, UNITS_DDL)
        own, more = order[first], times[first] > 1
        bucket = (mix(d1[own], 52) % U64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")                 # by digest within a bucket
        own, more, bucket = own[by], more[by], bucket[by]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        packed = []
        for lo, hi in zip(start, np.append(start[1:], len(own))):
            at = own[lo:hi]
            used, which = np.unique(doc[at], return_inverse=True)
            packed.append(pack(np.diff(d1[at], prepend=U64(0)), d2[at], *(c.astype(np.uint32) for c in (which, unit[at], *(r[at] for r in rest))),
                               more[lo:hi].astype(np.uint8), ids[used], has[used].astype(np.uint8), ths[used]))
        yield plain_rows({"bucket": bucket[start], "payload": packed}, UNITS_DDL)


def units(docs: DataFrame, every: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Packed units by bucket of their digest, and those that stand earlier in their chunk as rows."""
    def run(batches):
        known, chunk, row = {}, Chunk(), TaskContext.get().partitionId()
        for b in batches:
            for i, th, text in zip(*(c.to_pylist() for c in b.columns)):
                got = cut(text or "", known, every)
                if got:
                    chunk.add(i, th, got)
                if chunk.held >= CHUNK_UNITS:
                    yield from chunk.batches(buckets, row)
                    row, chunk = row + chunk.held, Chunk()
        if chunk.held:
            yield from chunk.batches(buckets, row)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"),
                       F.col(text_col).alias("text")).mapInArrow(lean(run), UNITS_DDL)


def placed(docs: DataFrame, every: int, id_col: str, text_col: str) -> DataFrame:
    """Every unit that stands twice or more: the digest's earliest place (``first``) and the others."""
    buckets = max(MIN_BUCKETS, docs.count() // ROWS_PER_BUCKET)

    def run(batches):
        bucket, held = None, []

        def repeats():
            parts, tables, base = [], [], 0
            for p in held:
                d1, d2, which, unit, word, n, start, end, more, ids, has, ths = unpack(p, *PACKED)
                parts.append((np.cumsum(d1, dtype=U64), d2, which + base, unit, word, n, start, end, more))
                tables.append((has.astype(np.int64), ids, ths))
                base += len(ids)
            d1, d2, which, *rest, more = (np.concatenate(c) for c in zip(*parts))
            has, ids, ths = (np.concatenate(c) for c in zip(*tables))
            by = np.lexsort((ths, ids, has))
            change = np.append(False, (has[by][1:] != has[by][:-1]) | (ids[by][1:] != ids[by][:-1]) | (ths[by][1:] != ths[by][:-1]))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(change)                       # rows of one id and text have one rank
            unit = rest[0].astype(np.int64)
            order, first, times = first_of_each(d1, d2, rank[which] << 32 | unit)
            starts = np.cumsum(first) - 1
            digest_more = np.zeros(int(first.sum()), bool)     # also if a chunk saw more of the digest
            keys = np.lexsort((d2, d1))
            new = np.append(True, (d1[keys][1:] != d1[keys][:-1]) | (d2[keys][1:] != d2[keys][:-1]))
            np.logical_or.at(digest_more, np.cumsum(new) - 1, more[keys] > 0)
            use = (times > 1) | digest_more[starts]
            at, first = order[use], first[use]
            doc = which[at]
            cols = dict(zip(PLAIN, (d1[at].view(np.int64), d2[at].view(np.int64), None, ths[doc], *(c[at].astype(np.int64) for c in rest))))
            cols["doc_id"] = pa.array(ids[doc], mask=has[doc] == 0)
            return plain_rows({**cols, "first": first}, PLACED_DDL)

        for b in batches:
            payload = b.column(1)
            plain = b.filter(payload.is_null())
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(plain.num_rows, bool)), *plain.columns[2:]],
                                                 names=["first", *PLAIN])
            for k in np.flatnonzero(payload.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if b.column(0)[k].as_py() != bucket:
                    if held:
                        yield repeats()
                    bucket, held = b.column(0)[k].as_py(), []
                held.append(payload[k].as_py())
        if held:
            yield repeats()

    # as many partitions as buckets: left to Spark, small ones are joined, and an Arrow batch of packed units
    # is as large as all of a task's buckets
    return units(docs, every, buckets, id_col, text_col).repartition(buckets, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(lean(run), PLACED_DDL)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, every: int = EVERY, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, th, start, end, word, n_words, n_units, first_doc_id, first_start): the passages to
    remove, with the earliest place of their first unit."""
    both = written(placed(docs, every, id_col, text_col), "passage-units")
    firsts = both.filter("first").select("d1", "d2", F.struct("doc_id", "th", "unit", "start").alias("f"))
    own = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th")) & (F.col("unit") == F.col("f.unit"))
    later = both.filter("not first").join(firsts, ["d1", "d2"]).filter(~own)
    number = F.dense_rank().over(Window.partitionBy("doc_id", "th").orderBy("unit"))      # repeated rows have one number
    runs = later.withColumn("run", F.col("unit") - number).groupBy("doc_id", "th", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("word").alias("word"),
        (F.max(F.col("word") + F.col("n_words")) - F.min("word")).alias("n_words"),
        (F.max("unit") - F.min("unit") + 1).alias("n_units"), F.min_by("f", "unit").alias("f"))
    return runs.filter(F.col("n_words") >= min_words).select(
        "doc_id", "th", "start", "end", "word", "n_words", "n_units", F.col("f.doc_id").alias("first_doc_id"),
        F.col("f.start").alias("first_start"))


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, every: int = EVERY, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages taken out of the texts, columns unchanged (a document's
    passages are one row, bounded by its own units)."""
    key, of, gone = (temporary_name(x, docs.columns) for x in ("repeat_id", "repeat_text", "repeat_spans"))
    spans = repeated_passages(docs, min_words, every, id_col, text_col) \
        .groupBy(F.col("doc_id").alias(key), F.col("th").alias(of)) \
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(gone))
    s = F.col(gone)
    text = F.col(text_col)
    # what lies before each passage (from the end of the one before), then the rest
    kept = F.transform(s, lambda x, i: F.substring(text, F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"]).cast("int") + 1,
                                                   (x["start"] - F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"])).cast("int")))
    rest = F.substring(text, F.element_at(s, -1)["end"].cast("int") + 1, F.length(text))
    out = docs.join(spans, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(of)), "left")
    return out.withColumn(text_col, F.when(s.isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest))) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_unit_hashing(spark, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more over all ``documents`` that stand earlier, wherever lines are cut."""
    return repeated_passages(read_table(spark, sf_dir, "documents")).drop("th")


OP5_UNITS_SQL = r"""
WITH pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS p FROM documents WHERE text IS NOT NULL)),
ends AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM pieces),
words AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, e - length(piece) AS start, e,
  translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
 FROM ends WHERE regexp_full_match(piece, '[^\x20\x09-\x0D]+')),
tops AS (SELECT *, CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) AS top FROM words),
stops AS (SELECT *, CAST((3 * coalesce(lag(top) OVER o, 0) + top) % 6 = 0 AS INTEGER) AS stop FROM tops
 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
cut AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit
 FROM stops),
units AS (SELECT doc_id, unit, min(i) AS word, count(*) AS n, min(start) AS start, max(e) AS e, string_agg(w, ' ' ORDER BY i) AS norm
 FROM cut GROUP BY doc_id, unit),
ranked AS (SELECT *, first_value(doc_id) OVER o AS f_id, first_value(unit) OVER o AS f_unit, first_value(start) OVER o AS f_start
 FROM units WINDOW o AS (PARTITION BY norm ORDER BY doc_id, unit)),
later AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM ranked
 WHERE doc_id <> f_id OR unit <> f_unit)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", CAST(min(word) AS BIGINT) AS word,
 CAST(sum(n) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n_units, arg_min(f_id, unit) AS first_doc_id,
 CAST(arg_min(f_start, unit) AS BIGINT) AS first_start
FROM later GROUP BY doc_id, run HAVING sum(n) >= 20
"""
