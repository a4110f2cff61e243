"""N-gram Jaccard join: parity sketches, pigeonhole by size band, verification.

A document is its set of distinct word n-grams (64-bit hashes); documents with equal sets
are one class. Two sets with Jaccard >= t, the smaller of size a, differ in at most
d = a (1 - t) / t elements. A band's sketch deals the elements by hash into parts; each part
is the XOR of its elements, so an element changes one part only, and of K parts at least
K - d are equal. Bands grow by 1 / t, so similar sets lie in the same or in adjacent bands: a
set is sketched for its own band and for the one below, and equal (band, parts, XOR) keys meet.

Keys are pairs of parts that both hold elements, within G groups of parts; an empty part is
never a key, since it says nothing. K = d + G + 1 + slack. Of two similar sets, let c be the
parts that are empty in both. If c <= slack, at least K - d - c > G equal parts hold elements,
so a group has two of them and the sets share that pair. If c > slack, both sets have more than
``slack`` empty parts; such sets are dealt anew with another hash, and the same holds there.
Sets with too many empty parts in all dealings (slack is the mean number and one deviation, so
one set in some thousands) emit their d + 1 elements of least hash instead: at most d of those
of either set are not in the other, so the least common element is among both sets' d + 1. No
pair is lost. Groups are as many as leave a part ``MIN_LOAD`` elements or more, since two
parts of few elements are one common phrase that unrelated documents share. Below a threshold
of some 0.65, d is too near to a for any such plan, and all sets go by their least elements.

All pairs of a key are never built. Sets that share a key are joined to the key's first
set (star), which gives clusters: unions of everything that could be similar. Inside a
cluster, similarity is verified exactly, in blocks of bounded size: a task gets one or two
blocks, counts intersections through its own inverted index, and returns only a spanning
forest of the verified links. Components of these forests, with the members of every
class, are the result; it equals the closure of all links.

Class ids are 64-bit set hashes; a clash of two different sets is as likely as for any
64-bit id.

Defined results: null texts and texts without words have no shingles, belong to no
class and are their own component; texts with fewer words than n have one shingle, the
whole sequence; a null id stays null; repeated rows are members of the same class; an empty
table gives no rows; extra columns are ignored, and pass through ``one_per_group``. Documents
are told apart by id and text: a class is verified with the text of its first document by
(doc_id, text hash), null ids last, whatever other rows hold that id.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.bpe import pack, ragged_take, unpack
from mirador.llm.common import join_small, lean, read_table, temporary_name, written
from mirador.llm.components import components

MIN_LOAD = 1.8                 # mean elements of a part, at least, where a plan allows
DEALINGS = 3                   # hashes by which a set with many empty parts is dealt
BLOCK_SETS = 4_096             # sets per verification block
BLOCK_SHINGLES = 1_000_000     # shingles per verification block
BROADCAST_ROWS = 300_000       # rows of (ids, cluster), some 40 bytes each
SEEN_SETS = 100_000            # set hashes a task remembers to skip repeated keys
CHUNK_KEYS = 500_000           # keys a task joins before the shuffle
ROWS_PER_BUCKET = 1_000        # documents per hash bucket of keys
MIN_BUCKETS = 16
KNOWN_WORDS = 100_000          # word hashes a task remembers
U64 = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """text -> sorted distinct 64-bit hashes of its word n-grams."""

    def __init__(self, n: int) -> None:
        import xxhash

        self.n, self.hash, self.words = n, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()       # A-Z only; ASCII white space
        if not words:
            return np.zeros(0, U64)
        if len(words) < self.n:
            whole = b"".join(len(w).to_bytes(8, "big") + w for w in words)
            return np.array([self.hash(whole, seed=1)], U64)
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        known, h = self.words, np.empty(len(words), U64)
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h[:] = list(map(known.__getitem__, words))
        m = len(words) - self.n + 1
        grams = np.zeros(m, U64)
        for j in range(self.n):
            grams = mix(grams ^ h[j:j + m], j)
        return np.unique(grams)


@lru_cache(maxsize=None)
def edges_of(percent: int, size: int) -> tuple[int, ...]:
    """Band borders 1, .., each at least 1 / t times the one before, beyond ``size``."""
    out = [1]
    while out[-1] <= size:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return tuple(out)


def slack_for(low: int, parts_without: int) -> int:
    """Empty parts to allow for: the mean and one deviation for a set of ``low`` elements; -1 if no
    number of parts has so few."""
    slack = 0
    while slack < low:
        parts = parts_without + slack
        load = low / parts
        empty = parts * (1 - 1 / parts) ** low
        spread = parts * exp(-load) * (1 - (1 + load) * exp(-load))
        need = ceil(empty + sqrt(max(0.0, spread)))
        if need <= slack:
            return slack
        slack = need
    return -1


@lru_cache(maxsize=None)
def band_plan(percent: int, low: int, high: int) -> tuple[int, int, int, int]:
    """(differences, parts, groups, slack) for a band of smaller sets of size low .. high - 1:
    the most groups (hence the fewest keys) that leave ``MIN_LOAD``, or else one group; no
    parts if there is no plan."""
    d = (high - 1) * (100 - percent) // percent

    def plan(groups: int) -> tuple[int, int, int, int] | None:
        slack = slack_for(low, d + groups + 1)
        return None if slack < 0 else (d, d + groups + 1 + slack, groups, slack)

    good, bad = 1, d + 1                                   # more groups than d hardly save keys
    while bad - good > 1:
        mid = (good + bad) // 2
        p = plan(mid)
        good, bad = (mid, bad) if p and low >= MIN_LOAD * p[1] else (good, mid)
    return (plan(good) if d else None) or (d, 0, 0, 0)


@lru_cache(maxsize=256)
def pairs_in_groups(parts: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of parts with the same number modulo ``groups``."""
    steps = range(groups, parts, groups)
    i = [np.arange(parts - step) for step in steps] or [np.zeros(0, np.int64)]
    j = [np.arange(step, parts) for step in steps] or [np.zeros(0, np.int64)]
    return np.concatenate(i), np.concatenate(j)


def band_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The pigeonhole keys of a set, for its own band and the one below."""
    borders = edges_of(percent, 1 << max(4, len(s).bit_length()))
    own, out = int(np.searchsorted(borders, len(s), side="right")) - 1, []
    for band in (own, own - 1):
        if band < 0:
            continue
        d, parts, groups, slack = band_plan(percent, borders[band], borders[band + 1])
        if not d:
            continue                                       # only equal sets are similar
        for deal in range(DEALINGS if parts else 0):
            spot, value = mix(s, 100 * deal + 11) >> U64(32), mix(s, 100 * deal + 12)
            part = ((spot * U64(parts)) >> U64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            n = np.bincount(part, minlength=parts)
            xor = np.zeros(parts, U64)
            full = np.flatnonzero(n)
            xor[full] = np.bitwise_xor.reduceat(value[order], (np.cumsum(n) - n)[full])
            one = mix(xor ^ np.arange(parts, dtype=U64), 100 * deal + 13)
            i, j = pairs_in_groups(parts, groups)
            use = (n[i] > 0) & (n[j] > 0)
            out.append(mix(mix(one[i[use]], 15) ^ one[j[use]] ^ U64(band), 100 * deal + 14))
            if parts - len(full) <= slack:
                break
        else:
            out.append(mix(np.sort(mix(s, 17))[:d + 1] ^ U64(band), 18))
    return np.concatenate(out) if out else np.zeros(0, U64)


def stars_of(key: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(key, sid, n) of a chunk: the first n rows are the keys, each with its least set. Then
    the chunk's other sets, each as two rows with the least set of a key they hold, under a
    key of the two sets' own."""
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    first = np.repeat(sid[start], np.diff(np.append(start, len(key))))
    other = first != sid
    a, b = first[other], sid[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[new], b[new]
    spread = mix(a.view(U64) ^ mix(b.view(U64), 31), 32).view(np.int64)
    return np.concatenate([key[start], spread, spread]), np.concatenate([sid[start], a, b]), len(start)


SKETCH_DDL = "bucket long, doc_id long, th long, n_shingles long, sid long, payload binary"
SKETCHED = pa.schema([(c, pa.int64()) for c in ("bucket", "doc_id", "th", "n_shingles", "sid")] + [("payload", pa.binary())])


def packed_keys(key: np.ndarray, sid: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(key, sid) rows by bucket of the key: sorted keys as differences, sets as places in a list."""
    bucket = (mix(key.view(U64), 33) % U64(buckets)).astype(np.int64)
    order = np.lexsort((key.view(U64), bucket))
    key, sid, bucket = key[order], sid[order], bucket[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rows = []
    for lo, hi in zip(start, np.append(start[1:], len(key))):
        own, at = np.unique(sid[lo:hi], return_inverse=True)
        rows.append(pack(np.diff(key[lo:hi].view(U64), prepend=U64(0)), at.astype(np.uint32), own))
    none = pa.nulls(len(rows), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(bucket[start]), none, none, none, none, pa.array(rows, pa.binary())],
                                      schema=SKETCHED)


def sketches(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """A row per document (payload null), and the keys of new sets by bucket.

    Tasks join the sets of a chunk of keys first, and send each key once a chunk. A key that a
    third of all sets share is thus as many keys as there are chunks; links found in a chunk go
    under keys of their own. A set that the task has seen sends no keys again."""
    def run(batches):
        shingle, seen, row = Shingler(n), set(), 0
        keys, owners, held = [], [], 0

        def joined():
            key, sid, _ = stars_of(np.concatenate(keys).view(np.int64), np.concatenate(owners))
            return packed_keys(key, sid, buckets)

        for b in batches:
            sizes, sids = [], []
            for text in b.column(2).to_pylist():
                s = shingle(text)
                sizes.append(len(s))
                if not len(s):
                    sids.append(None)
                    continue
                one = mix(np.array([np.bitwise_xor.reduce(mix(s, 21)) ^ mix(s, 22).sum(dtype=U64), len(s)], U64), 23)
                sid = int(mix(one[:1] ^ one[1:], 24).view(np.int64)[0])
                sids.append(sid)
                if sid not in seen:
                    keys.append(band_keys(s, percent))
                    owners.append(np.full(len(keys[-1]), sid, np.int64))
                    held += len(keys[-1])
                if len(seen) < SEEN_SETS:
                    seen.add(sid)
                if held >= CHUNK_KEYS:
                    yield joined()
                    keys, owners, held = [], [], 0
            spread = (np.arange(row, row + b.num_rows) * 7919 + TaskContext.get().partitionId()) % buckets
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread, pa.int64()), b.column(0), b.column(1), pa.array(sizes, pa.int64()),
                 pa.array(sids, pa.int64()), pa.nulls(b.num_rows, pa.binary())], schema=SKETCHED)
        if held:
            yield joined()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"),
                       F.col(text_col).alias("text")).mapInArrow(lean(run), SKETCH_DDL)


def signatures(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, n_shingles, sid, other): a row per document (``other`` null), and the links
    (sid, other) of every key's sets to its least.

    Keys cross the shuffle packed, in buckets whose number grows with the rows; a task holds
    one bucket at a time."""
    buckets = max(MIN_BUCKETS, docs.count() // ROWS_PER_BUCKET)
    names = ["doc_id", "th", "n_shingles", "sid", "other"]

    def run(batches):
        bucket, held = None, []

        def links():
            parts = [unpack(p, np.uint64, np.uint32, np.int64) for p in held]
            key = np.concatenate([np.cumsum(k, dtype=U64) for k, _, _ in parts])
            sid = np.concatenate([own[at] for _, at, own in parts])
            order = np.lexsort((sid, key))
            key, sid = key[order], sid[order]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            first = np.repeat(sid[start], np.diff(np.append(start, len(key))))
            a, b = first[first != sid], sid[first != sid]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
            none = pa.nulls(int(new.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(a[new]), pa.array(b[new])], names=names)

        for b in batches:
            payload = b.column(5)
            plain = b.filter(payload.is_null())
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([*plain.columns[1:5], pa.nulls(plain.num_rows, pa.int64())], names=names)
            for k in np.flatnonzero(payload.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if b.column(0)[k].as_py() != bucket:
                    if held:
                        yield links()
                    bucket, held = b.column(0)[k].as_py(), []
                held.append(payload[k].as_py())
        if held:
            yield links()

    rows = sketches(docs, n, percent, id_col, text_col, buckets)
    return rows.repartition("bucket").sortWithinPartitions("bucket") \
        .mapInArrow(lean(run), "doc_id long, th long, n_shingles long, sid long, other long")


def linked(sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; across sides only, if there are two."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    posting, lens = owner[order], np.bincount(code, minlength=len(n))
    starts = np.cumsum(lens) - lens
    mine = np.searchsorted(owner, np.arange(len(sets) + 1))
    side, root, out = np.array(sides), np.arange(len(sets)), []
    two = len(set(sides)) > 1
    for a in range(len(sets)):
        if two and side[a] != side[0]:
            continue
        others, _ = ragged_take(posting, starts, lens, code[mine[a]:mine[a + 1]])
        common = np.bincount(others, minlength=len(sets))
        hit = 100 * common >= percent * (size[a] + size - common)
        hit &= (side != side[a]) if two else (np.arange(len(sets)) > a)
        for b in np.flatnonzero(hit & (root != root[a])):
            if root[b] != root[a]:
                root[root == root[b]] = root[a]
                out.append((a, int(b)))
    return out


def verified_links(docs: DataFrame, firsts: DataFrame, clusters: DataFrame, n: int, percent: int,
                   id_col: str, text_col: str) -> DataFrame:
    """(a, b): verified links between set ids that span every group."""
    own = clusters.select(F.col("id").alias("sid"), F.col("root").alias("cluster")).join(firsts, "sid")
    sizes = own.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS),
                                                  F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    own = written(own.join(sizes, "cluster").select(
        "sid", "cluster", "blocks", "first.doc_id", "first.th", F.pmod(F.xxhash64("sid"), F.col("blocks")).alias("i")), "clusters")
    d = docs.select(F.col(id_col).cast("long").alias("d_id"), F.xxhash64(text_col).alias("d_th"),
                    F.col(text_col).alias("text")).filter("text is not null")
    texts = join_small(d, own, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_th") == F.col("th")), "inner",
                       own.count(), BROADCAST_ROWS)
    # a set goes to every pair of blocks that holds its own
    texts = texts.select("cluster", "sid", "i", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    texts = texts.select("cluster", "sid", "i", "text", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"))

    def run(table: pa.Table) -> pa.Table:
        shingle, sets = Shingler(n), {}
        for sid, i, text in zip(*(table.column(c).to_pylist() for c in ("sid", "i", "text"))):
            if sid not in sets:                            # rows that repeat id and text
                sets[sid] = shingle(text), i
        ids = sorted(sets)
        got = linked([sets[x][0] for x in ids], [sets[x][1] for x in ids], percent) if len(ids) > 1 else []
        return pa.table({"a": pa.array([ids[a] for a, _ in got], pa.int64()),
                         "b": pa.array([ids[b] for _, b in got], pa.int64())})

    return texts.groupBy("cluster", "p", "q").applyInArrow(run, "a long, b long")


def grouped(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, n_shingles, sid, first) per row; ``first`` is the (no_id, doc_id, th) of the
    group's first document, null for texts without words."""
    both = written(signatures(docs, n, percent, id_col, text_col), "signatures")
    sig, met = both.filter("other is null").drop("other"), both.filter("other is not null")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    firsts = sig.filter("sid is not null").groupBy("sid") \
        .agg(F.min(place).alias("first"), F.first("n_shingles").alias("n_shingles"))
    clusters = components(met.select(F.col("sid").alias("a"), F.col("other").alias("b")))
    links = verified_links(docs, firsts, clusters, n, percent, id_col, text_col)
    roots = components(links)
    least = roots.join(firsts.select(F.col("sid").alias("id"), "first"), "id")
    least = least.groupBy("root").agg(F.min("first").alias("least")).join(roots, "root")
    named = firsts.join(least.select(F.col("id").alias("sid"), "least"), "sid", "left") \
        .select("sid", F.coalesce("least", "first").alias("first"))
    named = written(named, "named")
    return sig.select("doc_id", "th", "n_shingles", "sid").join(named, "sid", "left")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row; links at Jaccard >= percent / 100."""
    return grouped(docs, n, percent, id_col, text_col) \
        .select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id"))
                .otherwise(F.col("first.doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` without those that are not the first of their group by (doc_id, text hash), null
    ids last, columns unchanged. Texts without words are kept; rows that repeat both id and
    text stay or go together."""
    key, of = (temporary_name(x, docs.columns) for x in ("group_member", "group_text"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    gone = grouped(docs, n, percent, id_col, text_col).filter(F.col("sid").isNotNull() & other) \
        .select(F.col("doc_id").alias(key), F.col("th").alias(of)).distinct()
    gone = written(gone, "near-duplicates")
    on = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(of))
    return join_small(docs, gone, on, "left_anti", gone.count(), BROADCAST_ROWS)


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``: four words, Jaccard 0.85."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+3], ' ') AS g
 FROM (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 3, 1) AS BIGINT) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
 SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
 JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
 GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
 CAST(least(w.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.doc_id = w.doc_id), w.doc_id)) AS BIGINT) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
