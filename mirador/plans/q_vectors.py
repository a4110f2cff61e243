"""Vector operators: embedding, top-k, upsert, rank fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mirador.fixtures import load_tables
from mirador.functions import lookups as L
from mirador.operators import search, vectors
from mirador.operators.documents import build_documents
from mirador.plans.oracles import oracle
from mirador.plans.q_search import (BM25_SQL, DOC_SQL, HYBRID_FILTERS, HYBRID_LIMIT, LIKE_SQL, SEARCH_QUERIES,
                                    qterms_for, search_index)
from mirador.plans.registry import query
from mirador.plans.sqlparts import tokens, values_table
from mirador.sources import records
from mirador.session import written_table

TOPK = 10


def dataset_vectors(spark, sf):
    """Embeddings of the dataset documents, computed once per input folder."""
    def build():
        docs = build_documents(records.datasets(spark, sf), records.resources(spark, sf))
        # the join shuffles, so the encoder input is already spread over the cluster
        docs = docs.join(records.datasets(spark, sf).select("id", "catalog_id"), "id")
        return vectors.embed_text(docs, "id", "document", extra_cols=("catalog_id",))
    return written_table(spark, ("vectors", sf.rstrip("/")), build)


@query("embed_text")
def q_embed_text(spark, sf):
    """The vectors' components that are not zero, as (id, position, weight)."""
    v = dataset_vectors(spark, sf)
    return v.select("id", F.posexplode("vector").alias("position", "w")).where("w <> 0") \
        .select("id", F.col("position").cast("bigint").alias("position"), F.round(F.col("w").cast("double"), 6).alias("weight"))


def vectors_sql(name: str, source: str, key: str, expr: str) -> str:
    """CTEs: ``name`` (key, position, w as stored in 32 bits) and ``name_n`` (key, norm of it)."""
    h = "md5(term)"
    return f"""{name}_t AS (SELECT {key}, unnest({tokens(expr)}) AS term FROM {source}),
{name}_s AS (SELECT {key}, CAST('0x' || substr({h}, 1, 8) AS BIGINT) % {L.EMBEDDING_DIM} AS position,
  sum(1 - 2 * (CAST('0x' || substr({h}, 9, 1) AS INTEGER) % 2)) AS s FROM {name}_t GROUP BY {key}, position HAVING s <> 0),
{name}_l AS (SELECT {key}, sqrt(CAST(sum(s * s) AS DOUBLE)) AS l FROM {name}_s GROUP BY {key}),
{name} AS (SELECT {key}, position, CAST(CAST(s AS DOUBLE) / l AS FLOAT) AS w FROM {name}_s JOIN {name}_l USING ({key})),
{name}_n AS (SELECT {key}, sqrt(sum(CAST(w AS DOUBLE) * w)) AS n FROM {name} GROUP BY {key})"""


DOCS_SQL = f"{DOC_SQL}, {vectors_sql('dv', 'dtext', 'id', 'document')}"

oracle("embed_text", f"WITH {DOCS_SQL}\nSELECT id, position, round(CAST(w AS DOUBLE), 6) AS weight FROM dv", "v_resources")

# Each query's ``fetch`` nearest documents per catalog, by the cosine of their vectors.
SEMANTIC_SQL = f"""{DOCS_SQL}, qx AS {values_table(SEARCH_QUERIES)}, {vectors_sql('qv', 'qx', 'query_id', 'query')},
dots AS (SELECT query_id, id, sum((CAST(q.w AS DOUBLE) / qn.n) * (CAST(d.w AS DOUBLE) / dn.n)) AS dot
  FROM qv q JOIN dv d USING (position) JOIN qv_n qn USING (query_id) JOIN dv_n dn USING (id) GROUP BY query_id, id),
sem AS (SELECT qx.query_id, d.catalog_id, d.id, row_number() OVER (PARTITION BY qx.query_id, d.catalog_id
   ORDER BY round(coalesce(dot, 0.0::DOUBLE), 9) DESC, d.id) AS rank
  FROM qx CROSS JOIN v_datasets d LEFT JOIN dots ON dots.query_id = qx.query_id AND dots.id = d.id)"""


def query_vectors(spark):
    return vectors.embed_text(spark.createDataFrame(SEARCH_QUERIES, "query_id int, query string"), "query_id", "query")


def semantic_lists(spark, sf, fetch, catalog=None):
    return vectors.vector_topk(search.in_catalog(dataset_vectors(spark, sf), catalog), query_vectors(spark), fetch,
                               catalog_col="catalog_id", per_catalog=True)


def label_centroids(emb):
    """One query per label: the mean vector of the label (a 64 x labels aggregate)."""
    parts = emb.select("label", F.posexplode("embedding").alias("pos", "x")) \
               .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (parts.groupBy("label")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("pm"))
            .select(F.col("label").alias("query_id"), F.transform("pm", lambda s: s["m"]).alias("vector")))


@query("vector_topk")
def q_vector_topk(spark, sf):
    load_tables(spark, sf, ("embeddings",))
    emb = spark.table("embeddings")
    r = vectors.vector_topk(emb.select(F.col("vec_id").alias("id"), F.col("label").alias("catalog_id"),
                                       F.col("embedding").alias("vector")),
                            label_centroids(emb), TOPK, catalog_col="catalog_id")
    return r.select("query_id", "id", "catalog_id", F.round("score", 6).alias("score"),
                    F.col("rank").cast("bigint").alias("rank"))


oracle("vector_topk", f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM u GROUP BY label, pos) GROUP BY label),
s AS (SELECT c.label AS query_id, e.vec_id AS id, e.label AS catalog_id, list_cosine_similarity(e.v, c.centroid) AS score FROM c, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, catalog_id, round(score, 6) AS score, rank FROM r WHERE rank <= {TOPK}""")


@query("vector_upsert")
def q_vector_upsert(spark, sf):
    load_tables(spark, sf, ("embeddings",))
    emb = spark.table("embeddings")
    base = emb.select("vec_id", "label", "embedding", F.lit(0).alias("version"))
    replace = emb.where(F.col("label") == 3).select(
        "vec_id", "label", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(1).alias("version"))
    insert = emb.where(F.col("label") == 7).select(
        (F.col("vec_id") + 1_000_000).alias("vec_id"), "label", "embedding", F.lit(1).alias("version"))
    out = vectors.vector_upsert(base, replace.unionByName(insert), "vec_id", "embedding", dim=64)
    return out.select("vec_id", "label", "version",
                      F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_v"))


oracle("vector_upsert", """WITH base AS (SELECT vec_id, label, embedding, 0 AS version FROM embeddings),
batch AS (SELECT vec_id, label, list_transform(embedding, lambda x: -x) AS embedding, 1 AS version FROM embeddings WHERE label = 3
  UNION ALL SELECT vec_id + 1000000, label, embedding, 1 FROM embeddings WHERE label = 7),
u AS (SELECT * FROM base WHERE vec_id NOT IN (SELECT vec_id FROM batch) UNION ALL SELECT * FROM batch)
SELECT vec_id, label, version, round(CAST(embedding[1] AS DOUBLE), 6) AS first_v FROM u""")


@query("rrf_fuse")
def q_rrf_fuse(spark, sf):
    """Vector and BM25 lists per (query, catalog), fused."""
    keys = ["query_id", "catalog_id"]
    lex = search.bm25_topk(search_index(spark, sf), qterms_for(spark, sf))
    fused = vectors.rrf_fuse(semantic_lists(spark, sf, L.DEFAULT_FTS_LIMIT), lex, keys)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "id")
    return fused.select(*keys, "id", F.round("score", 9).alias("score"),
                        F.row_number().over(w).cast("bigint").alias("rank"))


def fused_sql(lexical: str, fetch: int) -> str:
    """``f`` (query_id, catalog_id, id, score) from the lexical list's CTE and the vectors' ``sem``."""
    return f"""c AS (SELECT query_id, catalog_id, id, {L.RRF_SEMANTIC_WEIGHT} / ({L.RRF_K} + rank) AS c FROM sem WHERE rank <= {fetch}
  UNION ALL SELECT query_id, catalog_id, id, {L.RRF_LEXICAL_WEIGHT} / ({L.RRF_K} + rank) FROM {lexical} WHERE rank <= {fetch}),
f AS (SELECT query_id, catalog_id, id, CAST(sum(c) AS DOUBLE) AS score FROM c GROUP BY query_id, catalog_id, id)"""


oracle("rrf_fuse", f"""WITH {BM25_SQL}, {SEMANTIC_SQL}, {fused_sql('bm', L.DEFAULT_FTS_LIMIT)},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, catalog_id ORDER BY round(score, 9) DESC, id) AS rank FROM f)
SELECT query_id, catalog_id, id, round(score, 9) AS score, rank FROM r""", "v_datasets", "v_catalogs", "v_resources")


def hybrid_in(spark, sf, catalog=None):
    """Hybrid mode: per catalog, lexical and vector lists of 3 x limit fused, merged by max."""
    fetch = HYBRID_LIMIT * L.OVERFETCH_FACTOR
    ds = search.in_catalog(records.datasets(spark, sf), catalog)
    catalogs = None if catalog is None else spark.createDataFrame([(catalog,)], "catalog_id string")
    lex = search.fts_search(ds, search_index(spark, sf), search.in_catalog(qterms_for(spark, sf), catalog), SEARCH_QUERIES,
                            fetch, catalogs)
    fused = vectors.rrf_fuse(semantic_lists(spark, sf, fetch, catalog), lex, ["query_id", "catalog_id"])
    filters = HYBRID_FILTERS if catalog is None else {}
    r = search.hybrid_search(fused, ds, records.resources(spark, sf), HYBRID_LIMIT, **filters)
    return r.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"),
                    F.lit("hybrid").alias("mode"))


@query("hybrid_search_vector")
def q_hybrid_search_vector(spark, sf):
    return hybrid_in(spark, sf)


_FETCH = HYBRID_LIMIT * L.OVERFETCH_FACTOR
LISTS_SQL = f"""{BM25_SQL}, {LIKE_SQL}, {SEMANTIC_SQL},
lx AS (SELECT query_id, catalog_id, id, rank FROM bm WHERE rank <= {_FETCH}
  UNION ALL SELECT query_id, catalog_id, id, rank FROM lk WHERE rank <= {_FETCH}
   AND (query_id, catalog_id) NOT IN (SELECT query_id, catalog_id FROM bm)), {fused_sql('lx', _FETCH)}"""
_VIEWS = ("v_datasets", "v_catalogs", "v_resources")

oracle("hybrid_search_vector", f"""WITH {LISTS_SQL},
mg AS (SELECT query_id, id, max(score) AS score FROM f GROUP BY query_id, id),
rs AS (SELECT mg.* FROM mg JOIN v_datasets d ON mg.id = d.id
  WHERE d.organization IS NOT NULL AND contains(lower(d.organization), 'org 1')
    AND EXISTS (SELECT 1 FROM v_resources r WHERE r.dataset_id = d.id AND lower(r.format) = 'csv')
    AND list_contains(coalesce(list_transform(string_split(d.tags_text, ' '), lambda t: lower(t)), []), 'en')),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM rs)
SELECT query_id, id, round(score, 9) AS score, rank, 'hybrid' AS mode FROM rk WHERE rank <= {HYBRID_LIMIT}""", *_VIEWS)

SEARCH_CATALOG = "src4"


@query("hybrid_search_catalog")
def q_hybrid_search_catalog(spark, sf):
    """The hybrid search in one catalog."""
    return hybrid_in(spark, sf, SEARCH_CATALOG)


oracle("hybrid_search_catalog", f"""WITH {LISTS_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f WHERE catalog_id = '{SEARCH_CATALOG}')
SELECT query_id, id, round(score, 9) AS score, rank, 'hybrid' AS mode FROM rk WHERE rank <= {HYBRID_LIMIT}""", *_VIEWS)
