"""Steps of the text index on whole Arrow batches: terms counted per record, postings dealt to
folders in packed rows, and cut to blocks there.

A packed row holds many strings or numbers as bytes (``words.sizes_of``), so what Spark writes and
shuffles is a row per record, or per folder slice and batch, not a row per posting."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions.words import bytes_of_each, cut, pieces, sizes_of, string_parts, strings_of

COUNTED_DDL = "catalog_id string, id string, len int, terms binary, sizes binary, tf binary"
TERMS_DDL = "catalog_id string, id string, len int, term string, tf array<int>"
DEALT_DDL = ("part long, catalogs binary, catalog_sizes binary, terms binary, term_sizes binary, n_docs binary, "
             "counts binary, ids binary, id_sizes binary, weights binary, records binary")
BLOCKS_DDL = ("bucket int, catalog_id string, term string, block long, bound double, low double, n long, "
              "ids binary, id_sizes binary, impacts binary")
DEAL_POSTINGS = 250_000        # postings dealt at once, about
COUNT_POSTINGS = 1_000_000     # postings counted at once, about
BLOCK_ROWS = 20_000            # blocks of an Arrow batch
CATALOG_FACTOR = 1_000_003


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value per row: the bytes of its values, which end before ``ends``."""
    at = np.concatenate(([0], ends)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def packed_strings(texts: pa.Array, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    sizes, data = sizes_of(texts)
    upto = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    return packed(data, upto[ends]), packed(sizes, ends)


def numbers(column: pa.Array, kind: str) -> np.ndarray:
    return string_parts(column)[1].view(kind)


def counts_in(column: pa.Array, width: int) -> np.ndarray:
    """How many values of ``width`` bytes each row holds."""
    return np.diff(string_parts(column)[0]) // width


def codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(a code per string, the strings by code); null has a code too."""
    coded = texts.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def starts_of(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


# ------------------------------------------------------------------ counting
def counted(batch: pa.RecordBatch, n_fields: int, stem: Callable[[str], str] | None) -> pa.RecordBatch:
    """A row per record (catalog, id, then its lowered fields): its length and distinct terms, each
    with an int per field."""
    n = batch.num_rows
    found, at = cut(pa.concat_arrays([batch.column(2 + f) for f in range(n_fields)]))
    field, row = np.divmod(at, n)
    code, terms = codes(found)
    if stem is not None:
        known, terms = codes(pa.array([stem(w) for w in terms.to_pylist()], pa.string()))
        code = known[code]
    n_terms = max(1, len(terms))
    each = np.sort((row * n_terms + code) * n_fields + field)
    first = starts_of(each)
    pair, field = np.divmod(each[first], n_fields)
    new = starts_of(pair)
    tf = np.zeros((len(new), n_fields), np.int32)
    tf[np.repeat(np.arange(len(new)), np.diff(new, append=len(pair))), field] = np.diff(first, append=len(each))
    row_of, term_of = np.divmod(pair[new], n_terms)
    ends = np.cumsum(np.bincount(row_of, minlength=n))
    data, sizes = packed_strings(terms.take(pa.array(term_of)), ends)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(np.bincount(row, minlength=n).astype(np.int32)), data, sizes,
         packed(tf.reshape(-1), ends * n_fields)], names=["catalog_id", "id", "len", "terms", "sizes", "tf"])


def count_records(fields: DataFrame, names: tuple[str, ...], stem=None) -> DataFrame:
    """``COUNTED_DDL`` of records with text fields."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi in pieces([batch.column(2 + f) for f in range(len(names))]):
                yield counted(batch.slice(lo, hi - lo), len(names), stem)
    return fields.select(F.col("catalog_id").cast("string"), F.col("id").cast("string"), *[F.lower(f).alias(f) for f in names]) \
        .mapInArrow(run, COUNTED_DDL)


def record_pieces(batch: pa.RecordBatch, sizes: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch of counted records in slices of about ``most`` terms, a record at least."""
    upto = np.concatenate(([0], np.cumsum(counts_in(batch.column(sizes), 4))))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def term_rows(counted_records: DataFrame, n_fields: int) -> DataFrame:
    """(catalog_id, id, len, term, tf: an int per field) of every record."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in record_pieces(batch, 4, DEAL_POSTINGS):
                terms = strings_of(numbers(b.column(4), "<i4"), string_parts(b.column(3))[1])
                row = pa.array(np.repeat(np.arange(b.num_rows), counts_in(b.column(4), 4)))
                at = np.arange(len(terms) + 1, dtype=np.int32) * n_fields
                tf = pa.ListArray.from_arrays(pa.array(at), pa.array(numbers(b.column(5), "<i4")))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(3)), terms, tf],
                                                 names=["catalog_id", "id", "len", "term", "tf"])
    return counted_records.select("catalog_id", "id", "len", "terms", "sizes", "tf").mapInArrow(run, TERMS_DDL)


def term_counts(counted_records: DataFrame) -> DataFrame:
    """(catalog_id, term, n): how many records of a slice of an Arrow batch hold the term."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in record_pieces(batch, 2, COUNT_POSTINGS):
                code, terms = codes(strings_of(numbers(b.column(2), "<i4"), string_parts(b.column(1))[1]))
                catalog, names = codes(b.column(0))
                each = np.sort(np.repeat(catalog, counts_in(b.column(2), 4)) * max(1, len(terms)) + code)
                first = starts_of(each)
                of, term = np.divmod(each[first], max(1, len(terms)))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(of)), terms.take(pa.array(term)), pa.array(np.diff(first, append=len(each)).astype(np.int64))],
                    names=["catalog_id", "term", "n"])
    return counted_records.select("catalog_id", "terms", "sizes").mapInArrow(run, "catalog_id string, term string, n long")


# ------------------------------------------------------------------ dealing
def place_of(catalog: Column, term: Column) -> Column:
    """A number below 2^53 of (catalog, term), which ``places`` gives as well."""
    return F.crc32(term.cast("binary")) + F.crc32(catalog.cast("binary")) * CATALOG_FACTOR


def places(strings: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, bytes_of_each(strings)), np.int64, len(strings))


def weight_of(tf: np.ndarray, length: np.ndarray, avgdl: np.ndarray, weights: list[float]) -> np.ndarray:
    """What a term adds to a document's BM25 over its fields, but for the idf."""
    norm = L.BM25_K * (1 - L.BM25_B + L.BM25_B * (length / avgdl))
    out = np.zeros(len(tf))
    for k, w in enumerate(weights):
        held = tf[:, k] > 0
        t = tf[held, k]
        out[held] += t * (L.BM25_K + 1) / (t + norm[held]) * w
    return out


class Dealer:
    """Deals postings to ``buckets`` x ``slices`` parts by (catalog, term); a very common term
    (``common``: {term: {catalog: parts}}) by document as well."""

    def __init__(self, buckets: int, slices: int, common: dict, weights: list[float]):
        self.buckets, self.slices, self.common, self.weights = buckets, slices, common, weights
        self.common_terms = pa.array(sorted(common), pa.string())

    def rows(self, catalog: pa.Array, ids: pa.Array, length, id_hash, n_docs, avgdl, terms: pa.Array, row: np.ndarray,
             tf: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The first six are per record, ``row`` tells the record of a posting."""
        if not len(row):
            return
        cat, cat_names = codes(catalog)
        code, names = codes(terms)
        of = cat[row]
        entry = of * len(names) + code
        place = places(names)[code] + (places(cat_names) * CATALOG_FACTOR)[of]
        turn = place // self.buckets
        if len(self.common_terms):
            which = pc.index_in(names, self.common_terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            held = np.array([[self.common[t].get(c, 1) for c in cat_names.to_pylist()] for t in self.common_terms.to_pylist()])
            often = np.flatnonzero(which[code] >= 0)
            turn[often] += id_hash[row[often]] % held[which[code[often]], of[often]]
        part = place % self.buckets * self.slices + turn % self.slices
        order = np.argsort(part * (len(names) * len(cat_names)) + entry, kind="stable")
        part, entry, row = part[order], entry[order], row[order]
        weights = weight_of(tf[order], length[row], avgdl[row], self.weights)
        run = starts_of(part * (len(names) * len(cat_names)) + entry)          # a run is a part's postings of an entry
        first = starts_of(part)
        ends = np.append(first[1:], len(part))                                 # of the parts, in postings and in runs
        run_ends = np.searchsorted(run, ends)
        cat_of, term_of = np.divmod(entry[run], len(names))
        cats, cat_sizes = packed_strings(cat_names.take(pa.array(cat_of)), run_ends)
        words, word_sizes = packed_strings(names.take(pa.array(term_of)), run_ends)
        id_data, id_sizes = packed_strings(ids.take(pa.array(row)), ends)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[first]), cats, cat_sizes, words, word_sizes, packed(n_docs[row[run]], run_ends),
             packed(np.diff(run, append=len(part)).astype(np.int32), run_ends), id_data, id_sizes,
             packed(weights, ends), packed(records[order].astype(np.int32), ends)],
            names=[f.split()[0] for f in DEALT_DDL.split(", ")])

    def records(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of counted records."""
        for batch in it:
            for b in record_pieces(batch, 7, DEAL_POSTINGS):
                terms = strings_of(numbers(b.column(7), "<i4"), string_parts(b.column(6))[1])
                row = np.repeat(np.arange(b.num_rows), counts_in(b.column(7), 4))
                tf = numbers(b.column(8), "<i4").reshape(len(row), len(self.weights))
                per_record = [b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
                yield from self.rows(b.column(0), b.column(1), *per_record, terms, row, tf, np.ones(len(row), np.int32))

    def term_rows(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows per record and term, which stand for ``records`` records."""
        for b in it:
            tf = b.column(7).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(self.weights))
            per_record = [b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            yield from self.rows(b.column(0), b.column(1), *per_record, b.column(6), np.arange(b.num_rows), tf,
                                 b.column(8).to_numpy(zero_copy_only=False))


# ------------------------------------------------------------------ blocks
def blocks(slices: int, block_postings: int, common: dict, shared: bool) -> Callable:
    """A part's postings by (catalog, term), greatest impacts first, in blocks of ``block_postings``.

    A term's df is the number of records of its postings here; that of a very common term, whose
    postings lie in several parts, is in ``common`` ({term: {catalog: df}}). With ``shared``
    an id may have several postings of a term, whose impacts are summed."""
    common_terms = pa.array(sorted(common), pa.string())

    def of_part(part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def strings(data: int, sizes: int) -> pa.Array:
            return pa.concat_arrays([strings_of(numbers(b.column(sizes), "<i4"), string_parts(b.column(data))[1]) for b in held])

        def values(column: int, kind: str) -> np.ndarray:
            return np.concatenate([numbers(b.column(column), kind) for b in held])

        cat, cat_names = codes(strings(1, 2))
        term, names = codes(strings(3, 4))
        # codes in the order of the strings, so that a folder's row groups have narrow ranges
        by_name = [pc.sort_indices(x).to_numpy() for x in (cat_names, names)]
        rank = [np.argsort(o) for o in by_name]
        entry, head, group = np.unique(rank[0][cat] * len(names) + rank[1][term], return_index=True, return_inverse=True)
        n_docs = values(5, "<i8")[head]
        of = np.repeat(group, values(6, "<i4"))
        ids, weights, records = strings(7, 8), values(9, "<f8"), values(10, "<i4")
        df = np.bincount(of, records, len(entry))
        entry_cat, entry_term = by_name[0][entry // len(names)], by_name[1][entry % len(names)]
        if len(common_terms):
            for g in np.flatnonzero(pc.is_in(names, common_terms).to_numpy(zero_copy_only=False)[entry_term]):
                df[g] = common[names[int(entry_term[g])].as_py()].get(cat_names[int(entry_cat[g])].as_py(), df[g])
        if shared:
            id_code, id_names = codes(ids)
            pair, once = np.unique(of * len(id_names) + id_code, return_inverse=True)
            weights = np.bincount(once, weights, len(pair))
            of, ids = pair // len(id_names), id_names.take(pa.array(pair % len(id_names)))
        idf = np.log10((n_docs - df + 0.5) / (df + 0.5) + 1)
        impact = idf[of] * weights
        order = np.lexsort((-impact, of))
        order = order[impact[order] > 0]
        of, impact = of[order], impact[order]
        new = starts_of(of)
        within = np.arange(len(of)) - np.repeat(new, np.diff(new, append=len(of)))
        start = np.flatnonzero(within % block_postings == 0)
        end = np.append(start[1:], len(of)).astype(np.int64) if len(start) else start
        for lo in range(0, len(start), BLOCK_ROWS):
            s, e = start[lo:lo + BLOCK_ROWS], end[lo:lo + BLOCK_ROWS]
            id_data, id_sizes = packed_strings(ids.take(pa.array(order[s[0]:e[-1]])), e - s[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(s), part // slices, np.int32)), cat_names.take(pa.array(entry_cat[of[s]])),
                 names.take(pa.array(entry_term[of[s]])), pa.array((part << 32) + lo + np.arange(len(s))),
                 pa.array(impact[s]), pa.array(impact[e - 1]), pa.array(e - s),
                 id_data, id_sizes, packed(impact[s[0]:e[-1]], e - s[0])], names=[f.split()[0] for f in BLOCKS_DDL.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}                             # a task has one part
        for b in it:
            number = b.column(0).to_numpy()
            for part in np.unique(number):
                held.setdefault(int(part), []).append(b.filter(pa.array(number == part)) if (number != part).any() else b)
        for part in list(held):
            yield from of_part(part, held.pop(part))
    return run


def unpacked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, impact) of blocks' postings."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            k = len(keys)
            ids = strings_of(numbers(b.column(k + 1), "<i4"), string_parts(b.column(k))[1])
            row = pa.array(np.repeat(np.arange(b.num_rows), counts_in(b.column(k + 1), 4)))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(k)), ids, pa.array(numbers(b.column(k + 2), "<f8"))],
                                             names=[*keys, "id", "impact"])
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys) + ", id string, impact double"
    return rows.select(*keys, "ids", "id_sizes", "impacts").mapInArrow(run, schema)
