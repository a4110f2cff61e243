"""Source/sink round trips through the shared folder, load plans, charset scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirador.fixtures import AS_OF, register_views
from mirador.plans import pipeline
from mirador.plans.oracles import oracle
from mirador.plans.registry import query
from mirador.plans.sqlparts import SUMMARY_CTES
from mirador.session import materialize, scratch_path
from mirador.sources import records, stores

# ------------------------------------------------------------------ load plan
MANIFEST_SQL = f"""
SELECT page_id, url,
 CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR
  WHEN 2 THEN TIMESTAMP '{AS_OF}' - INTERVAL 30 HOUR ELSE TIMESTAMP '{AS_OF}' - INTERVAL 100 HOUR END AS cached_at,
 page_id % 3 <> 0 AS has_validators,
 CASE WHEN page_id % 5 = 0 THEN NULL ELSE CAST(length(html) AS BIGINT) * CASE WHEN page_id % 7 = 0 THEN 200000 ELSE 10 END END AS content_length
FROM pages"""


@query("resource_load_plan")
def q_resource_load_plan(spark, sf):
    register_views(spark, sf, ())
    return stores.load_plan(spark.sql(MANIFEST_SQL), AS_OF).select("page_id", "url", "cache_key", "action")


oracle("resource_load_plan", f"""WITH m AS ({MANIFEST_SQL.strip()})
SELECT page_id, url, sha256(url) AS cache_key,
 CASE WHEN cached_at IS NOT NULL AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(cached_at) < 24 * 3600000000 THEN 'cached'
  WHEN content_length IS NOT NULL AND content_length > 209715200 THEN 'direct_scan'
  WHEN cached_at IS NOT NULL AND has_validators THEN 'revalidate' ELSE 'download' END AS action FROM m""")

# ------------------------------------------------------------------ charset scan


@query("charset_scan")
def q_charset_scan(spark, sf):
    register_views(spark, sf, ())
    docs = spark.table("documents")
    enc = (F.when(F.col("doc_id") % 3 == 0, F.lit("utf-8"))
           .when(F.col("doc_id") % 3 == 1,
                 F.when(F.col("text").rlike("[^\\x00-\\xFF]"), F.lit("utf-8")).otherwise(F.lit("latin-1")))
           .otherwise(F.lit("utf-16")))
    path = scratch_path(spark, "raw-docs")
    # the write job lands the files in the shared folder; their names and sizes are a table
    files = materialize(stores.write_text_files(docs.withColumn("enc", enc), path, "doc_id", "text", "enc"))
    files = files.groupBy("path").agg(F.max("n_bytes").alias("n_bytes"))        # rows that repeat an id share a file
    scan = stores.charset_scan(spark, files)
    number = lambda: F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("bigint").alias("doc_id")
    found = materialize(stores.file_encodings(spark, files))
    lines = stores.decoded_lines(spark, files, found).groupBy(number()).agg(F.sum(F.length("line")).cast("bigint").alias("line_chars"))
    texts = scan.select(number(), F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("md5"))
    return texts.join(found.select(number(), "encoding"), "doc_id").join(lines, "doc_id", "left") \
        .select("doc_id", "encoding", "line_chars", "n_chars", "md5")


oracle("charset_scan", """SELECT doc_id,
 CASE doc_id % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN
   CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') AND NOT regexp_matches(text, '[^\\x00-\\xFF]') THEN 'ISO-8859-1' ELSE 'UTF-8' END
  ELSE 'UTF-16' END AS encoding,
 CASE WHEN doc_id % 3 <> 2 THEN CAST(length(replace(text, chr(10), '')) AS BIGINT) END AS line_chars, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS md5 FROM documents""")

# ------------------------------------------------------------------ metadata store
META_TTL_HOURS = 24
METADATA_SCHEMA = "id string, title string, cached_at timestamp, catalog_id string"


@query("metadata_store")
def q_metadata_store(spark, sf):
    register_views(spark, sf, ("v_datasets", "v_catalogs"))
    d = records.datasets(spark, sf)
    cats = spark.table("v_catalogs").select(F.col("id").alias("catalog_id"), "pos")
    d = d.join(cats, "catalog_id")
    store = stores.CatalogStore(spark, scratch_path(spark, "metadata"), METADATA_SCHEMA)
    cached_at = F.lit(AS_OF).cast("timestamp") - F.make_interval(hours=(F.col("pos") % 4) * 10)
    cached = d.select("id", "catalog_id", "title", cached_at.alias("cached_at"), "pos")
    store.save(cached.withColumn("title", F.lit("an old title")).drop("pos"))
    store.save(cached.where("pos % 4 <> 1").drop("pos"))             # replaces these catalogs only
    return stores.fresh_records(store.load(), AS_OF, META_TTL_HOURS).select("id", "catalog_id", "title")


oracle("metadata_store", """SELECT d.id, d.catalog_id, CASE WHEN c.pos % 4 = 1 THEN 'an old title' ELSE d.title END AS title FROM v_datasets d JOIN v_catalogs c ON d.catalog_id = c.id
WHERE c.pos % 4 <> 3""", "v_datasets", "v_catalogs")

# ------------------------------------------------------------------ score export
DIMS = ["overall", "accessibility", "structure", "freshness", "completeness"]


@query("score_export")
def q_score_export(spark, sf):
    full = pipeline.dataset_scores(spark, sf)
    scores = full.select("id", "catalog_id", *DIMS)
    entries = full.select("catalog_id", "external_id", "modified_at",
                          F.lit(AS_OF).cast("timestamp").alias("last_scored_at"), "overall")
    index = pipeline.catalog_index(spark, sf)
    meta = index.agg(F.count(F.lit(1)).alias("catalogs"), F.sum("dataset_count").alias("datasets"))
    out = stores.export_scores(index, scores, meta, scratch_path(spark, "export"), entries)
    back = spark.read.schema("id string, overall double, accessibility double, structure double, "
                             "freshness double, completeness double, catalog_id string").json(out["scores"])
    idx = spark.read.schema("id string, status string").json(out["catalogs"])
    ent = (spark.read.schema("external_id string, overall double, catalog_id string").json(out["entries"])
           .groupBy("catalog_id").agg(F.count(F.lit(1)).alias("catalog_entries")))
    return (back.join(idx.select(F.col("id").alias("catalog_id"), F.col("status").alias("catalog_status")),
                      "catalog_id", "left")
            .join(ent, "catalog_id", "left"))


oracle("score_export", f"""WITH {SUMMARY_CTES}
SELECT sc.catalog_id, sc.id, sc.overall, sc.accessibility, sc.structure, sc.freshness, sc.completeness,
 idx.status AS catalog_status, count(*) OVER (PARTITION BY sc.catalog_id) AS catalog_entries
FROM sc LEFT JOIN idx ON sc.catalog_id = idx.id""",
       "v_datasets", "v_resources", "v_checks", "v_catalogs")

# ------------------------------------------------------------------ state store
CORRUPT_POS = 5


@query("state_store")
def q_state_store(spark, sf):
    register_views(spark, sf, ("v_catalogs",))
    cats = spark.table("v_catalogs")
    pos = F.col("pos")
    state = F.to_json(F.struct(
        F.col("id").alias("catalog_id"), (pos * 3).cast("bigint").alias("processed_count"),
        F.when(pos % 3 == 0, F.lit("2025-12-30T00:00:00.000Z")).alias("last_complete_sweep"),
        F.when(pos % 2 == 0, F.lit("detail")).otherwise(F.lit("aggregate")).alias("tier"),
        F.when(pos % 5 == 2, F.lit("unreachable")).otherwise(F.lit("ok")).alias("status"),
        F.when(pos % 5 == 2, F.lit(3)).otherwise(F.lit(0)).cast("bigint").alias("consecutive_failures"),
        F.lit("2025-12-31T00:00:00Z").alias("last_run_at")))
    line = F.when(pos == CORRUPT_POS, F.concat(F.lit('{"catalog_id": "'), F.col("id"), F.lit('", "tier": ')))\
        .otherwise(state)
    path = scratch_path(spark, "state")
    stores.state_write_lines(cats.where(pos % 4 != 3).select(line.alias("value")), path)
    st = stores.state_read(spark, path)
    none = stores.state_read(spark, scratch_path(spark, "no-state")).select(F.col("catalog_id").alias("nothing"))
    return cats.join(st, cats["id"] == st["catalog_id"], "left").join(none, cats["id"] == none["nothing"], "left").select(
        "id", F.col("catalog_id").isNotNull().alias("has_state"), "tier", "status", "consecutive_failures",
        "processed_count", "last_complete_sweep", F.col("nothing").isNotNull().alias("in_missing_folder"))


oracle("state_store", f"""WITH s AS (SELECT id, pos % 4 <> 3 AND pos <> {CORRUPT_POS} AS has_state, pos FROM v_catalogs)
SELECT id, has_state, CASE WHEN has_state THEN CASE WHEN pos % 2 = 0 THEN 'detail' ELSE 'aggregate' END END AS tier,
 CASE WHEN has_state THEN CASE WHEN pos % 5 = 2 THEN 'unreachable' ELSE 'ok' END END AS status,
 CAST(CASE WHEN has_state THEN CASE WHEN pos % 5 = 2 THEN 3 ELSE 0 END END AS BIGINT) AS consecutive_failures,
 CAST(CASE WHEN has_state THEN pos * 3 END AS BIGINT) AS processed_count,
 CASE WHEN has_state AND pos % 3 = 0 THEN TIMESTAMP '2025-12-30 00:00:00' END AS last_complete_sweep, false AS in_missing_folder FROM s""",
       "v_catalogs")
