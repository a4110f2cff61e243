"""Vectors: text embedding, upsert by id, and top-k cosine search.

* ``embed_text`` runs a pluggable encoder over Arrow batches (``mapInPandas``);
  the default encoder (``mapInArrow``) hashes the index's tokens (MD5) into a fixed number of
  dimensions, mean pools and L2-normalises (no model is needed offline, and SQL can compute the same). Any
  callable ``list[str] -> ndarray[n, dim]`` can replace it, e.g. an ONNX model.
* ``vector_topk`` is brute force over blocks: a block of queries meets a block of
  vectors in one group, which returns at most k rows per query (and catalog); the
  global top-k is then a row_number filter over those candidates.
* ``vector_upsert`` replaces by id with an anti join + union (the update batch
  is the small side), so the stored vectors are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions.words import bytes_of_each, cut, pieces

KNOWN_TOKENS = 200_000         # token positions an encoder remembers


def token_place(token: str, dim: int) -> tuple[int, int]:
    """(position, sign) of a token, from its MD5 (which SQL engines have as well)."""
    h = hashlib.md5(token.encode()).digest()
    return int.from_bytes(h[:4]) % dim, 1 - 2 * (h[4] >> 4 & 1)


def hashed_encoder(dim: int = L.EMBEDDING_DIM) -> Callable[[pa.Array], np.ndarray]:
    """Token hashing encoder of lowered texts: each token adds its sign at its position; mean, L2
    norm. A token is hashed once; the sums are one ``bincount`` over all tokens of the array."""
    known: dict[bytes, int] = {}

    def encode(texts: pa.Array) -> np.ndarray:
        words, row = cut(texts)
        coded = words.dictionary_encode()
        if len(known) > KNOWN_TOKENS:
            known.clear()
        each = bytes_of_each(coded.dictionary)
        for w in each:
            if w not in known:
                place, plus = token_place(w.decode(), dim)
                known[w] = place * 2 + (plus < 0)
        code = np.fromiter(map(known.__getitem__, each), np.int64, len(each))
        at, sign, which = code // 2, 1.0 - 2.0 * (code % 2), coded.indices.to_numpy(zero_copy_only=False)
        out = np.bincount(row * dim + at[which], sign[which], len(texts) * dim).astype(float).reshape(len(texts), dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0)
    return encode


def embed_text(df: DataFrame, id_col: str, text_col: str, encoder=None,
               batch: int = L.EMBED_BATCH, extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """(id, *extra, vector array<float>) for each row. The default encoder cuts the index's tokens from
    the bytes of whole Arrow batches; another one takes ``batch`` texts at a time."""
    keep = [id_col, *extra_cols]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep) + ", vector array<float>"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = list(pdf["encoded_text"])
            vecs = [encoder(texts[i:i + batch]) for i in range(0, len(texts), batch)]
            mat = np.vstack(vecs) if vecs else np.zeros((0, L.EMBEDDING_DIM))
            out = pdf[keep].copy()
            out["vector"] = list(mat.astype(np.float32))
            yield out

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = hashed_encoder()
        for whole in it:
            for lo, hi in pieces([whole.column(len(keep))]):
                b = whole.slice(lo, hi - lo)
                mat = encode(b.column(len(keep)))
                at = np.arange(len(mat) + 1, dtype=np.int32) * mat.shape[1]
                vecs = pa.ListArray.from_arrays(pa.array(at), pa.array(mat.astype(np.float32).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], vecs], names=[*keep, "vector"])
    if encoder:
        return df.select(*keep, F.col(text_col).alias("encoded_text")).mapInPandas(run, schema)
    return df.select(*keep, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("encoded_text")).mapInArrow(hashed, schema)


QUERY_BLOCK = 512           # queries and vectors that one task compares
VECTOR_BLOCK = 16_384


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores (9 decimals), ties to the smaller id."""
    r = np.round(scores, 9)
    near = np.flatnonzero(r >= np.partition(r, -k)[-k]) if len(r) > k else np.arange(len(r))
    return near[np.lexsort((ids[near], -r[near]))[:k]]


def unit_rows(vectors) -> np.ndarray:
    m = np.array([np.asarray(x, dtype=np.float64) for x in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id",
                vec_col: str = "vector", catalog_col: str | None = None,
                per_catalog: bool = False) -> DataFrame:
    """Top-k cosine similarity per query (per query and catalog if ``per_catalog``).

    Query batches of any size: a batch of one block goes to the tasks that hold the vectors, of
    which nothing is shuffled but at most k candidates per query (and catalog) and Arrow batch.
    Larger ones and the vectors are cut into blocks by hash, one group compares a block of each
    and returns at most k rows per query (and catalog)."""
    cat = catalog_col or "_cat"
    src = vectors if catalog_col else vectors.withColumn("_cat", F.lit(""))
    id_type = src.schema[id_col].dataType.simpleString()
    cat_type = src.schema[cat].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, {cat} {cat_type}, {id_col} {id_type}, score double"
    nq = max(1, -(-queries.count() // QUERY_BLOCK))
    keys = ["query_id", cat] if per_catalog else ["query_id"]
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), F.asc(id_col))

    def best(ids, cats, mat, q_ids, q_mat) -> pd.DataFrame:
        frames, sims = [], mat @ q_mat.T
        groups = pd.Series(cats).groupby(cats).indices.values() if per_catalog else [np.arange(len(ids))]
        for rows in groups:
            for j, qid in enumerate(q_ids):
                top = rows[best_rows(sims[rows, j], ids[rows], k)]
                frames.append(pd.DataFrame({"query_id": qid, cat: cats[top], id_col: ids[top], "score": sims[top, j]}))
        return pd.concat(frames) if frames else pd.DataFrame(columns=["query_id", cat, id_col, "score"])

    if nq == 1:
        # one block of queries (QUERY_BLOCK rows at most) goes to the tasks; the vectors stay where they are
        asked = queries.select("query_id", "vector").collect()
        q_ids, q_mat = [r[0] for r in asked], unit_rows([r[1] for r in asked])

        def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in it:
                if len(b) and len(q_ids):
                    yield best(b[id_col].to_numpy(), b[cat].to_numpy(), unit_rows(b["_v"]), q_ids, q_mat)
        cand = src.select(id_col, cat, F.col(vec_col).alias("_v")).mapInPandas(scan, schema)
        out = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return out if catalog_col else out.drop("_cat")

    nv = max(1, -(-src.count() // VECTOR_BLOCK))
    left = queries.select("query_id", F.col("vector").alias("_q"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("_qb"),
                          F.explode(F.expr(f"sequence(0L, {nv - 1}L)")).alias("_vb"))
    right = src.select(id_col, cat, F.col(vec_col).alias("_v"), F.pmod(F.xxhash64(id_col), F.lit(nv)).alias("_vb"),
                       F.explode(F.expr(f"sequence(0L, {nq - 1}L)")).alias("_qb"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["query_id", cat, id_col, "score"])
        return best(b[id_col].to_numpy(), b[cat].to_numpy(), unit_rows(b["_v"]), a["query_id"], unit_rows(a["_q"]))

    cand = left.groupBy("_qb", "_vb").cogroup(right.groupBy("_qb", "_vb")).applyInPandas(run, schema)
    out = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out if catalog_col else out.drop("_cat")


def vector_upsert(base: DataFrame, batch: DataFrame, id_col: str, vec_col: str,
                  dim: int | None = None, version_col: str = "version") -> DataFrame:
    """Insert or replace rows of ``batch`` by id; all or nothing.

    If any batch vector has the wrong dimension the whole batch is rejected and
    the base is returned unchanged. Within the batch the highest version wins; a null
    version is the lowest.
    """
    if dim is not None:
        bad = batch.where(F.size(vec_col) != dim).limit(1).count()
        if bad:
            return base
    # the highest version per id, as a partial aggregate (an id repeated many
    # times in a batch is merged from per-partition buffers, not sorted in one task)
    others = [c for c in batch.columns if c != id_col]
    latest = (batch.groupBy(id_col)
              .agg(F.max_by(F.struct(*others), F.struct(F.col(version_col).isNotNull(), F.col(version_col))).alias("_v"))
              .select(id_col, *[F.col("_v." + c).alias(c) for c in others]))
    kept = base.join(latest.select(id_col), id_col, "left_anti")
    return kept.unionByName(latest.select(*base.columns))


def rrf_fuse(semantic: DataFrame, lexical: DataFrame, keys: list[str],
             semantic_weight: float = L.RRF_SEMANTIC_WEIGHT, lexical_weight: float = L.RRF_LEXICAL_WEIGHT,
             k: int = L.RRF_K, id_col: str = "id") -> DataFrame:
    """score = sum of w / (k + rank) over the lists (rank from 1 within each key)."""
    s = semantic.select(*keys, id_col, (F.lit(semantic_weight) / (k + F.col("rank"))).alias("c"))
    x = lexical.select(*keys, id_col, (F.lit(lexical_weight) / (k + F.col("rank"))).alias("c"))
    return s.unionByName(x).groupBy(*keys, id_col).agg(F.sum("c").alias("score"))
