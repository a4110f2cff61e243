"""Line dedup by a segment-partition edit join (DataFrame functions only).

A line goes if an earlier line, by (document id, line number), is equal or lies within
``TAU`` edits (insert, delete, replace one code point). Lines of fewer than ``MIN_CHARS``
code points after trimming are left alone.

1. Equal lines: 128-bit hashes are grouped (partial aggregation); all but the first go, and
   only first lines take part in the edit join.
2. A line of length l is split into TAU + 1 segments whose lengths differ by one at most.
   If a line s of length l .. l + TAU is within TAU edits of it, one segment occurs in s
   unchanged, near its own place. So every line emits its segments as index keys (length,
   segment number, hash of the text), and for every partner length l the substrings of s
   that may equal segment i: those shifted by max(-i, D - (TAU - i)) ..
   min(i, D + (TAU - i)), D = |s| - l (12 keys a line in all for TAU = 2).
3. Keys are grouped with partial aggregation (least and greatest line hash), so a key that a
   third of all lines share is never gathered; only lines under a key that another line's
   index key shares live on, found by a join whose hot keys can be split. Their texts are fetched, and two left semi joins on the key
   (index lines before probes, probes before index lines) verify with the banded
   ``levenshtein`` of Spark. A semi join stops at the first earlier line and returns each
   line once, so a group of near copies is never expanded into its pairs.

``line_classes`` joins the same keys in full: all links between different lines, whose
components with the copies of every line are the classes. ``remove_lines`` keeps the first
line of each class, so in a chain of links a line may go whose kept line is more than ``TAU``
edits away. Links grow with the square of a group of near copies; none is left out.

Defined results: null texts have no lines; null ids rank first; documents are told apart by
id and text, so rows that repeat both lose the same lines and keep the same lines; empty
lines stay; an empty table loses nothing; extra columns pass through ``remove_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.common import discard, join_small, read_table, temporary_name, written
from mirador.llm.components import components

TAU = 2
MIN_CHARS = 20
BROADCAST_ROWS = 300_000       # rows of ids and hashes, some 50 bytes each


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, th, line_no, line, a, b): lines long enough, with two 64-bit hashes."""
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"),
                        F.posexplode(F.split(text, "\n", -1)).alias("line_no", "raw"))
    lines = lines.select("doc_id", "th", "line_no", F.trim("raw").alias("line")) \
        .filter(F.length("line") >= min_chars)
    return lines.select("*", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def keyed(lines: DataFrame, tau: int) -> DataFrame:
    """(a, key, index) of every line: its index keys, and probes for partners of its length or
    up to tau shorter. Lines have at least (tau + 1) ** 2 code points, so a shifted segment
    never leaves the line. The (shorter, segment, shift) to emit are constants, exploded
    first, so that the generated code cuts and hashes in one place."""
    wanted = [(shorter, i, shift) for shorter in range(tau + 1) for i in range(tau + 1)
              for shift in range(max(-i, shorter - (tau - i)), min(i, shorter + (tau - i)) + 1)]
    wanted = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(w, ("shorter", "i", "shift"))]) for w in wanted])
    rows = lines.select("a", "line", F.length("line").alias("n"), F.explode(wanted).alias("w"))
    rows = rows.select("a", "line", (F.col("n") - F.col("w.shorter")).alias("length"), "w.*")
    rows = rows.select("*", F.pmod("length", F.lit(tau + 1)).alias("r"))
    rows = rows.select("*", ((F.col("length") - F.col("r")) / (tau + 1)).cast("int").alias("q"),
                       (F.col("r") + F.col("i") - (tau + 1)).alias("longer"))   # longer segments before this one
    start = F.col("q") * F.col("i") + F.greatest("longer", F.lit(0)) + F.col("shift") + 1
    part = F.col("line").substr(start, F.col("q") + F.when(F.col("longer") >= 0, 1).otherwise(0))
    own = (F.col("shorter") == 0) & (F.col("shift") == 0)                       # also this line's index key
    return rows.select("a", F.xxhash64("length", "i", part).alias("key"), own.alias("index"))


def candidates(docs: DataFrame, tau: int, min_chars: int, id_col: str, text_col: str) -> tuple:
    """All lines, with the first place of those that are seen twice; the first places' texts
    under a shared key; and their keys."""
    if min_chars < (tau + 1) ** 2:
        raise ValueError("min_chars must be at least (tau + 1) ** 2")
    lines = lines_of(docs, id_col, text_col, min_chars)
    place = F.struct("doc_id", "th", "line_no")
    seen = lines.select("a", "b", place.alias("place")).groupBy("a", "b") \
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
    copies = written(seen.filter(F.col("first") != F.col("last"))
                     .select(F.col("a").alias("ca"), F.col("b").alias("cb"), "first"), "line-copies")
    n_copies = copies.count()
    marked = join_small(lines, copies, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")), "left",
                        n_copies, BROADCAST_ROWS)
    later = F.col("first").isNotNull() & (place != F.col("first"))
    once = marked.filter(~later)

    emitted = written(keyed(once.select("a", "line"), tau), "line-all-keys")      # cut and hashed once
    shared = emitted.groupBy("key").agg(F.max("index").alias("indexed"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    shared = written(shared.filter("indexed and lo <> hi").select(F.col("key").alias("k")), "shared-keys")
    live = join_small(emitted, shared, F.col("key") == F.col("k"), "left_semi", shared.count(), BROADCAST_ROWS)
    live = written(live, "line-keys")
    discard(emitted)
    named = written(live.select(F.col("a").alias("la")).distinct(), "live-lines")
    texts = written(join_small(once, named, F.col("a") == F.col("la"), "left_semi", named.count(), BROADCAST_ROWS)
                    .select("a", place.alias("place"), "line"), "live-texts")
    return marked, texts, live.join(texts, "a").select("key", "index", "a", "place", "line")


def line_matches(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, th, line_no, kind): the lines that an earlier line equals or nearly equals;
    kind is ``equal`` or ``near``."""
    marked, texts, rows = candidates(docs, tau, min_chars, id_col, text_col)
    place = F.struct("doc_id", "th", "line_no")
    later = F.col("first").isNotNull() & (place != F.col("first"))

    def earlier(left: DataFrame, right: DataFrame) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        close = F.levenshtein(F.col("x.line"), F.col("y.line"), tau) >= 0
        on = (F.col("x.key") == F.col("y.key")) & (F.col("y.place") < F.col("x.place")) & close
        return x.join(y, on, "left_semi").select("a")

    index = rows.filter("index")
    near = written(earlier(rows, index).unionByName(earlier(index, rows)).distinct(), "near-lines")
    equal_lines = marked.filter(later).select(place.alias("place"), F.lit("equal").alias("kind"))
    near_lines = texts.join(near, "a").select("place", F.lit("near").alias("kind"))
    # a removed text's copies are removed as later lines already
    return equal_lines.unionByName(near_lines).select("place.*", "kind").distinct()


def line_classes(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, th, line_no, class_doc_id, class_line_no, n_links, kind) of every line with an equal
    or a near one. The class is named by its first line; ``n_links`` counts the different lines
    within ``tau`` edits. kind is ``first``, ``equal`` (a copy of an earlier line) or ``near``
    (first of its copies, not of its class)."""
    marked, _, rows = candidates(docs, tau, min_chars, id_col, text_col)
    x, y = rows.filter("index").alias("x"), rows.alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.a") != F.col("y.a")) \
        & (F.levenshtein(F.col("x.line"), F.col("y.line"), tau) >= 0)
    links = x.join(y, on).select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b")).distinct()
    links = written(links, "line-links")
    counts = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n"))
    linked = components(links).join(counts, F.col("id") == F.col("a")).select("id", "root", "n")
    place = F.struct("doc_id", "th", "line_no")
    own = written(marked.join(linked, F.col("a") == F.col("id"), "left").filter("first is not null or id is not null")
                  .select(place.alias("place"), F.coalesce("first", place).alias("first"),
                          F.coalesce("root", "a").alias("root"), F.coalesce("n", F.lit(0)).alias("n_links")), "line-members")
    heads = written(own.groupBy("root").agg(F.min("first").alias("head")), "line-heads")
    kind = F.when(F.col("place") != F.col("first"), "equal").when(F.col("place") != F.col("head"), "near").otherwise("first")
    return own.join(heads, "root").select(
        "place.*", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"),
        "n_links", kind.alias("kind")).distinct()


def remove_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` with the first line of every class only, columns unchanged. Documents left without a
    word by it are dropped: all they held stands elsewhere in the corpus."""
    names = [temporary_name(x, docs.columns) for x in ("line_id", "line_th", "line_gone", "line_parts")]
    key, th, gone, parts = names
    removed = line_classes(docs, tau, min_chars, id_col, text_col).filter("kind <> 'first'") \
        .groupBy(F.col("doc_id").alias(key), F.col("th").alias(th)).agg(F.collect_set("line_no").alias(gone))
    removed = written(removed, "removed-lines")
    text = F.col(text_col)
    on = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(th))
    out = join_small(docs, removed, on, "left", removed.count(), BROADCAST_ROWS)
    # a column of its own, used twice: split once a text, not once a line. Documents without a
    # word are left out by an empty array, not a filter, which Spark would push down and so
    # put the text together twice
    out = out.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split(text, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n")
    left = F.filter(F.array(left), lambda t: F.rlike(t, F.lit(r"[^\x20\x09-\x0D]")))
    out = out.withColumn(parts, F.explode(F.when(F.col(gone).isNull(), F.array(text)).otherwise(left)))
    return out.select(*[(F.col(parts) if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of equal and nearly equal lines over all ``documents``, with their links counted."""
    return line_classes(read_table(spark, sf_dir, "documents")).drop("th")
