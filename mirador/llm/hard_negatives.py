"""Hard-negative mining by a secondary-sort shuffle.

An anchor's positives are its best rows of the same label; a positive of score p opens the
window of negatives (rows of other labels) with scores from low to high percent of p, of which
the best few are wanted.

1. Vectors become integers. Anchors and rows are cut into blocks by a hash of the row, so no
   label, id or vector makes a block large; a cell compares a block of anchors with a block of
   rows and keeps each anchor's best few of its label. The best of all cells are the positives.
2. The cells are compared once more. With the windows known, a cell keeps for each the first
   few scores inside (a combiner: no score beyond them can be among the first few of all).
3. Pair scores are shuffled under the key (anchor, descending score, kind, id): rows are
   repartitioned by anchor and sorted within partitions by the rest, as
   ``repartitionAndSortWithinPartitions`` does, in Spark's own rows. A task streams over them: a
   positive opens its window, a negative goes to every open window that holds its score, a
   window is closed when it is full or the scores have passed it. At most ``positives`` windows
   are held, never an anchor's rows.

Scores are exact integers: products below 2^53 are summed in doubles, others in 64-bit
integers. A row whose integers' squares sum to 4e18 or more takes no part, so that every score
fits a long (Cauchy-Schwarz).

Defined results: rows with a null id, label or vector, or any null or non-finite component,
take no part; only vectors of one dimension meet; rows that repeat id, label and vector count
once; rows that share an id but differ are different rows, each an anchor of its own; ties go
to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirador.llm.common import positive_hash, read_table, written

ANCHOR_BLOCK = 16_384
ROW_BLOCK = 16_384
SQUARES = 4e18                 # a row's limit; two such rows' score stays below 2^62
STEP = 256                     # anchors whose scores are held at a time
PAIR_DDL = "anchor_id long, anchor long, score long, kind int, id long, row long"
MINED_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integer_rows(vectors: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, dim, v, row): floor(scale * x) as little-endian 64-bit integers, and a hash
    that tells rows of one id apart."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & sound
    rows = vectors.filter(F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))

    def run(batches):
        for b in batches:
            with np.errstate(over="ignore"):
                flat = np.floor(b.column(2).flatten().to_numpy(zero_copy_only=False) * scale)
            n = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(n))
            with np.errstate(over="ignore"):
                keep = np.array([np.square(flat[a:z]).sum() < SQUARES for a, z in zip(ends[:-1], ends[1:])], bool)
            raw = [flat[a:z].astype("<i8").tobytes() if k else b"" for a, z, k in zip(ends[:-1], ends[1:], keep)]
            batch = pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n.astype(np.int32)), pa.array(raw, pa.binary())],
                names=["vec_id", "label", "dim", "v"])
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, "vec_id long, label long, dim int, v binary").distinct() \
        .withColumn("row", F.xxhash64("label", "v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows whose products fit 64 bits."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2 ** 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def matrix(table: pa.Table) -> np.ndarray:
    raw = b"".join(table.column("v").to_pylist())
    return np.frombuffer(raw, "<i8").reshape(table.num_rows, -1 if raw else 0)


def first_few(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties by place."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:k]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score in the window of a positive's score."""
    return -(-low * positive // 100), high * positive // 100


def in_cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, choose) -> DataFrame:
    """(anchor_id, anchor, score, kind, id, row): what ``choose(scores, same_label, anchor's
    table, k)`` takes of each anchor's rows in every cell; rows come by (id, row)."""
    na, nr = max(1, ceil(n_anchors / ANCHOR_BLOCK)), max(1, ceil(n_rows / ROW_BLOCK))
    h = positive_hash(F.col("vec_id"), F.col("row"), seed=12)
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])        # columns of its own for the cogroup
    left = own.withColumn("ab", F.pmod(h, F.lit(na))).withColumn("rb", F.explode(F.expr(f"sequence(0L, {nr - 1}L)")))
    right = rows.withColumn("rb", F.pmod(h, F.lit(nr))).withColumn("ab", F.explode(F.expr(f"sequence(0L, {na - 1}L)")))

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and r.num_rows:
            r = r.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            x, y = matrix(a), matrix(r)
            ids, hashes, labels = (r.column(c).to_numpy() for c in ("vec_id", "row", "label"))
            for lo in range(0, a.num_rows, STEP):
                part = a.slice(lo, STEP)
                s = products(x[lo:lo + STEP], y)
                for k, one in enumerate(part.drop_columns(["v"]).to_pylist()):
                    other = (ids != one["vec_id"]) | (hashes != one["row"])
                    kind, at = choose(s[k], labels == one["label"], other, one)
                    n = len(at)
                    out.append((np.full(n, one["vec_id"]), np.full(n, one["row"]), s[k][at], np.full(n, kind), ids[at], hashes[at]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
        kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2
        return pa.table({n: pa.array(c, t) for n, c, t in
                         zip(("anchor_id", "anchor", "score", "kind", "id", "row"), cols, kinds)})

    keys = ["ab", "rb", "dim"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, PAIR_DDL)


def mined(pairs: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """Pairs (kind 0: positives, 1: negatives) -> each positive's first negatives in its window."""
    ordered = pairs.repartition("anchor_id", "anchor") \
        .sortWithinPartitions("anchor_id", "anchor", F.desc("score"), "kind", "id", "row")

    def run(batches):
        anchor, open_windows = None, []
        for b in batches:
            out = []
            for anchor_id, a, score, kind, i in zip(*(b.column(c).to_pylist() for c in range(5))):
                if (anchor_id, a) != anchor:
                    anchor, open_windows = (anchor_id, a), []
                if kind == 0:
                    open_windows.append([i, score, *window(score, low, high), 0])
                    continue
                for w in open_windows:
                    if w[2] <= score <= w[3]:
                        w[4] += 1
                        out.append((anchor_id, w[0], w[4], i, w[1], score))
                open_windows = [w for w in open_windows if w[4] < negatives and w[2] <= score]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 names=[c.split()[0] for c in MINED_DDL.split(", ")])

    return ordered.mapInArrow(run, MINED_DDL)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, is_anchor: str = "vec_id % 100 = 0", id_col: str = "vec_id",
                   label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    if not 0 <= low <= high <= 100:
        raise ValueError("a window lies between 0 and 100 percent of its positive")
    rows = written(integer_rows(vectors, scale, id_col, label_col, vector_col), "integer-rows")
    anchors = rows.filter(is_anchor)
    n, n_anchors = rows.count(), anchors.count()

    def best_of_label(scores, same, other, one):
        at = np.flatnonzero(same & other)
        return 0, at[first_few(scores[at], positives)]

    rank = F.row_number().over(Window.partitionBy("anchor_id", "anchor").orderBy(F.desc("score"), "id", "row"))
    best = in_cells(anchors, rows, n_anchors, n, best_of_label).withColumn("nth", rank)
    best = written(best.filter(F.col("nth") <= positives).drop("nth"), "positives")

    opened = best.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor").alias("row")) \
        .agg(F.collect_set("score").alias("opened"))            # at most ``positives`` scores an anchor

    def in_windows(scores, same, other, one):
        taken = []
        for p in one["opened"]:
            lo, hi = window(p, low, high)
            at = np.flatnonzero((scores >= lo) & (scores <= hi) & ~same)
            taken.append(at[first_few(scores[at], negatives)])
        return 1, np.unique(np.concatenate(taken))

    found = in_cells(anchors.join(opened, ["vec_id", "row"]), rows, n_anchors, n, in_windows)
    return mined(best.unionByName(found), negatives, low, high)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors: ids of ``embeddings`` divisible by 100; one label in seven is moved on first."""
    e = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", label.alias("label"), "embedding"))


OP12_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
 FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id
   ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
