"""Driver tables and the stand-in views built from them.

Every view is one SQL text that Spark SQL and DuckDB both accept, so the same
text feeds the Spark job (as a temp view) and the SQL oracle (inside WITH).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mirador.session import apply_runtime_conf, session_key

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed parameters: the "now" of every stand-in run (UTC), and the "now" of the
# event-log stand-ins (health checks, outcomes), which lie in January 2024.
AS_OF = "2026-01-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

VIEW_SQL: dict[str, str] = {
    "v_catalogs": """
SELECT 'src' || CAST(n_nationkey AS STRING) AS id, n_name AS name, r_name AS country,
 CASE WHEN n_nationkey % 3 = 0 THEN 'socrata' ELSE 'ckan' END AS protocol, n_nationkey AS pos
 FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_datasets": """
SELECT source || ':' || CAST(doc_id AS STRING) AS id, source AS catalog_id, CAST(doc_id AS STRING) AS external_id, doc_id,
 lang AS language, split_part(text, chr(10), 1) AS title,
 CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN lang || ' ' || source ELSE text END AS description,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'Org ' || CAST(doc_id % 11 AS STRING) END AS organization,
 CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang || ' topic' || CAST(doc_id % 9 AS STRING) END AS tags_text,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'CC-BY-4.0' END AS license,
 CASE WHEN doc_id % 13 = 0 THEN NULL ELSE DATE '2022-01-01' + CAST(doc_id % 900 AS INT) END AS created_on,
 CASE WHEN doc_id % 17 = 0 THEN NULL ELSE DATE '2023-01-01' + CAST(doc_id % 1300 AS INT) END AS modified_on
 FROM documents""",
    "v_resources": """
SELECT d.id AS dataset_id, d.catalog_id, d.doc_id, d.i,
 'https://' || d.catalog_id || '.example.org/' || d.external_id || '/' || CAST(d.i AS STRING) AS url,
 CASE (d.doc_id + d.i) % 8 WHEN 0 THEN 'CSV' WHEN 1 THEN 'json' WHEN 2 THEN 'PDF' WHEN 3 THEN 'XLSX' WHEN 4 THEN 'geojson' WHEN 5 THEN 'ZIP' WHEN 6 THEN '' ELSE 'xyz' END AS format,
 CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.doc_id * 1000 END AS size_bytes
 FROM (SELECT id, catalog_id, doc_id, external_id, 0 AS i FROM v_datasets WHERE doc_id % 4 > 0
  UNION ALL SELECT id, catalog_id, doc_id, external_id, 1 FROM v_datasets WHERE doc_id % 4 > 1
  UNION ALL SELECT id, catalog_id, doc_id, external_id, 2 FROM v_datasets WHERE doc_id % 4 > 2) d""",
    # Events fall on the resources of all documents; a tenth of the documents is never checked.
    "v_checks": """
SELECT r.catalog_id, r.url, e.ts AS checked_at, e.event_id, CAST(floor(e.value * 10) AS BIGINT) AS latency_ms,
 CASE e.event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'purchase' THEN 403 WHEN 'error' THEN 500 ELSE 404 END AS status
 FROM (SELECT *, (event_id * 13) % (SELECT count(*) FROM documents) AS doc FROM events) e
 JOIN v_resources r ON r.doc_id = e.doc AND r.i = e.event_id % 3 WHERE r.doc_id % 10 <> 9""",
    "v_series": """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
 CASE WHEN day(o_orderdate) = 29 THEN NULL ELSE CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) END AS value
 FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE), day(o_orderdate)""",
    "v_prev": """
SELECT catalog_id, external_id, CASE WHEN doc_id % 3 = 0 THEN modified_on - 30 ELSE modified_on END AS modified_on,
 DATE '2026-01-01' - CAST(doc_id % 14 AS INT) AS last_scored_on, CAST(doc_id % 101 AS DOUBLE) / 100 AS overall FROM v_datasets WHERE doc_id % 10 <> 3
 UNION ALL SELECT 'src' || CAST(n_nationkey AS STRING), 'gone' || CAST(n_nationkey AS STRING), DATE '2024-01-01', DATE '2025-12-30', CAST(1 AS DOUBLE) / 2 FROM nation""",
    # Preset directory: one preset per region, plus "all"; one member is unknown.
    "v_presets": """
SELECT lower(r_name) AS preset, 'src' || CAST(n_nationkey AS STRING) AS catalog_id, n_nationkey AS member_pos
 FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'all', 'src' || CAST(n_nationkey AS STRING), n_nationkey FROM nation
 UNION ALL SELECT 'america', 'src99', 99 FROM region WHERE r_regionkey = 1""",
    # Sweep state of the previous run: complete (young or old), incomplete, or none.
    "v_sweep_state": """
SELECT id AS catalog_id, pos % 3 = 0 AS complete,
 CASE WHEN pos % 3 = 0 THEN CASE WHEN pos % 2 = 0 THEN TIMESTAMP '2025-12-29 00:00:00' ELSE TIMESTAMP '2025-06-01 00:00:00' END END AS last_complete_sweep,
 CASE WHEN pos % 3 = 1 THEN TIMESTAMP '2024-06-01 00:00:00' WHEN pos % 3 = 0 THEN TIMESTAMP '2025-06-01 00:00:00' END AS cursor,
 CAST(CASE WHEN pos % 3 = 1 THEN 40 ELSE 50 END AS BIGINT) AS processed_count,
 CAST(CASE WHEN pos % 3 = 1 THEN 0 ELSE 50 END AS BIGINT) AS total_known
 FROM v_catalogs WHERE pos % 3 <> 2""",
    "v_sweep_aggs": """
SELECT catalog_id, 'completeness' AS dimension, CAST(processed_count * 500 AS BIGINT) AS sum_milli, processed_count AS count FROM v_sweep_state
 UNION ALL SELECT catalog_id, 'freshness', CAST(processed_count * 250 AS BIGINT), processed_count FROM v_sweep_state
 UNION ALL SELECT catalog_id, 'structure', CAST(processed_count * 700 AS BIGINT), processed_count FROM v_sweep_state
 UNION ALL SELECT catalog_id, 'accessibility', CAST(1100 AS BIGINT), CAST(2 AS BIGINT) FROM v_sweep_state""",
    # Series metadata (one row per series of v_series).
    "v_series_meta": """
SELECT series_id AS id, 'Serie ' || series_id AS title, 'Total de pedidos ' || lower(series_id) AS description,
 CASE WHEN series_id < '3' THEN 'prioridad alta' ELSE 'prioridad baja' END AS category,
 CASE substring(series_id, 1, 1) WHEN '1' THEN 'R/P1D' WHEN '2' THEN 'R/P1M' WHEN '3' THEN 'R/P3M' WHEN '4' THEN 'month' ELSE 'weekly' END AS frequency_raw,
 'USD' AS units, 'orders' AS source, min(date) AS start_date, max(date) AS end_date
 FROM v_series GROUP BY series_id""",
}

VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "v_series_meta": ("v_series",),
    "v_presets": (),
    "v_sweep_state": ("v_catalogs",),
    "v_sweep_aggs": ("v_sweep_state",),
    "v_catalogs": (),
    "v_datasets": (),
    "v_resources": ("v_datasets",),
    "v_checks": ("v_resources",),
    "v_series": (),
    "v_prev": ("v_datasets",),
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in VIEW_DEPS[n]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


# (session, view name) -> the sf_dir it was registered from; lets repeated calls
# skip re-reading parquet footers and re-analysing view SQL.
_REGISTERED: dict[tuple[str, str], str] = {}


def _fresh(spark: SparkSession, name: str, sf_dir: str) -> bool:
    return _REGISTERED.get((session_key(spark), name)) == sf_dir


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the driver's parquet tables as temp views (lazy scans), once per session."""
    apply_runtime_conf(spark)
    sf_dir = sf_dir.rstrip("/")
    for t in names:
        if _fresh(spark, t, sf_dir):
            continue
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        _REGISTERED[(session_key(spark), t)] = sf_dir
        for v in VIEW_SQL:  # views built on older tables are stale now
            _REGISTERED.pop((session_key(spark), v), None)


def register_views(spark: SparkSession, sf_dir: str, views=tuple(VIEW_SQL)) -> None:
    """Register driver tables and the stand-in views (in dependency order)."""
    load_tables(spark, sf_dir)
    sf_dir = sf_dir.rstrip("/")
    for v in _closure(views):
        if _fresh(spark, v, sf_dir):
            continue
        spark.sql(VIEW_SQL[v]).createOrReplaceTempView(v)
        _REGISTERED[(session_key(spark), v)] = sf_dir


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_views(spark, sf_dir, (name,))
    return spark.table(name)


def with_views(sql: str, *views: str) -> str:
    """Prefix an oracle SQL text with the stand-in views it reads, as CTEs."""
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in _closure(views))
    body = sql.strip()
    if not ctes:
        return body
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
