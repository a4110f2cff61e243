"""Exact top-k by inner product with pivot-table elimination.

A bounded sample gives the pivots (farthest-first). Every vector's distances to all
pivots are precomputed once and written beside it. For a query q and a candidate x the
triangle inequality gives  d(q, x) >= max over pivots |d(q, p) - d(x, p)| = low,  hence
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 <= (|q|^2 + |x|^2 - low^2) / 2.  Candidates are
evaluated in the order of that bound until the k-th best score so far lies above the
next bound: everything behind it is ruled out exactly.

Queries and candidates are cut into blocks by a hash of the id; one group joins a query
block with a candidate block and returns at most k rows per query; the best k of those
are ranked in Spark. No block depends on how common a vector is, so copies spread evenly.

Vectors are integers after quantising, and scores are exact: products below 2^53 are summed in
doubles, others in 64-bit integers. A vector whose scaled components' squares sum to 4e18 or
more takes no part, so that every score fits a long (Cauchy-Schwarz).

Defined results: vectors that are null, empty, too large (above), or hold null or non-finite
components take no part, nor do rows with a null id; only vectors of one dimension meet; rows that repeat
exactly count once; ties go to the smaller id; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirador.llm.common import positive_hash, read_table, written
from mirador.llm.hard_negatives import SQUARES, products

PIVOTS = 32
PIVOT_SAMPLE = 2_000       # vectors the pivots are chosen from (bounded, by hash)
CANDIDATE_ROWS = 8_192     # per block
QUERY_ROWS = 1_024         # per block


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x), only whole finite vectors."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) \
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    small = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale)) < SQUARES
    whole = F.when(small, F.transform(v, lambda x: F.floor(x * scale).cast("double")))
    return vectors.filter(F.coalesce(ok & small, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")).distinct()


def choose_pivots(q: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Farthest-first pivots per dimension from a bounded sample; {dimension: matrix}."""
    rows = q.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    out = {}
    for dim in {len(r["v"]) for r in rows}:
        x = np.array([r["v"] for r in rows if len(r["v"]) == dim])
        at, far = [0], np.linalg.norm(x - x[0], axis=1)
        while len(at) < min(n, len(x)):
            at.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(x - x[at[-1]], axis=1))
        out[dim] = x[at]
    return out


def pivot_table(q: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, v, distances to the pivots of its dimension)."""
    def run(batches):
        for pdf in batches:
            d = [np.linalg.norm(pivots.get(len(v), np.zeros((0, len(v)))) - v, axis=1) for v in pdf["v"]]
            yield pdf.assign(d=d)

    return q.mapInPandas(run, "vec_id long, v array<double>, d array<double>")


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[tuple[int, int, int]]:
    """Exact (query, candidate, score) top k of one block by bound order."""
    ids = rows["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")          # ties in score then fall to the smaller id
    ids = ids[order]
    x, dx = np.stack(rows["v"].to_numpy())[order], np.stack(rows["d"].to_numpy())[order]
    whole, most = x.astype(np.int64), x.shape[1] * float(np.abs(x).max(initial=0.0))
    norm, out = (x * x).sum(axis=1), []
    for qid, q, dq in zip(queries["vec_id"], queries["v"], queries["d"]):
        low = np.abs(dx - dq).max(axis=1) if dx.shape[1] else np.zeros(len(ids))
        bound = (norm + (q * q).sum() - low * low) / 2
        bound += 1e-9 * (np.abs(bound) + norm) + 0.25   # scores are integers; covers rounding
        bound[ids == qid] = -np.inf                     # the query's own row
        top_i, top_s, done, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 256
        own = q.astype(np.int64)[None] if most * float(np.abs(q).max(initial=0.0)) >= 2 ** 53 else None
        by = np.argsort(-bound, kind="stable")
        while done < len(by) and not (len(top_s) == k and top_s[-1] > bound[by[done]]):
            part = by[done:done + step]
            part = part[bound[part] > -np.inf]
            got = (x[part] @ q).astype(np.int64) if own is None else products(whole[part], own)[:, 0]
            s, i = np.concatenate([top_s, got]), np.concatenate([top_i, part])
            best = np.lexsort((ids[i], -s))[:k]
            top_s, top_i = s[best], i[best]
            done, step = done + step, step * 2
        out += [(int(qid), int(ids[i]), int(s)) for i, s in zip(top_i, top_s)]
    return out


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, pivots: int = PIVOTS, is_query="vec_id % 50 = 0",
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows."""
    q = written(quantised(vectors, scale, id_col, vector_col), "vectors")
    table = written(pivot_table(q, choose_pivots(q, pivots)), "pivot-table")
    n, queries = table.count(), table.filter(is_query)
    blocks = max(1, ceil(n / CANDIDATE_ROWS))
    query_blocks = max(1, ceil(queries.count() / QUERY_ROWS))
    h = positive_hash(F.col("vec_id"), seed=8)
    dim = F.size("v").alias("dim")
    left = queries.select("*", dim, F.pmod(h, F.lit(query_blocks)).alias("qb"),
                          F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("cb"))
    right = table.select("*", dim, F.pmod(h, F.lit(blocks)).alias("cb"),
                         F.explode(F.expr(f"sequence(0L, {query_blocks - 1}L)")).alias("qb"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = search_block(a, b, k) if len(a) and len(b) else []
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["qb", "cb", "dim"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)) \
        .applyInPandas(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def op6_pivot_search(spark, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 50; candidates: every other row of ``embeddings``."""
    return top_k(read_table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH q AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
 FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
 vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
