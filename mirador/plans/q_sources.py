"""Source operators: payload mapping, protocol detection, cursor listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirador.fixtures import register_views
from mirador.plans.oracles import oracle
from mirador.plans.registry import query
from mirador.plans.sqlparts import trim_ws
from mirador.sources import payloads

# ------------------------------------------------------------------ CKAN


def ckan_pages(spark, sf):
    """Landed CKAN package_search pages built from the stand-in records (50 per page)."""
    register_views(spark, sf, ("v_datasets", "v_resources"))
    d, r = spark.table("v_datasets"), spark.table("v_resources")
    res = r.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct(
        "i", F.concat(F.lit("res-"), F.col("i").cast("string")).alias("id"), "url", "format",
        F.when(F.col("i") == 0, F.lit("")).otherwise(F.concat(F.lit("file "), F.col("i").cast("string"))).alias("name"),
        F.when(F.col("doc_id") % 5 == 2, F.lit(0).cast("bigint")).otherwise(F.col("size_bytes")).alias("size")))).alias("rs"))
    j = d.join(res, d["id"] == res["dataset_id"], "left")
    tags = F.transform(F.coalesce(F.split("tags_text", " "), F.array().cast("array<string>")), lambda t: F.struct(
        t.alias("name"), F.when(F.col("doc_id") % 4 == 1, F.lit("")).otherwise(F.upper(t)).alias("display_name")))
    org = (F.when(F.col("doc_id") % 5 == 0, F.lit(None))
           .otherwise(F.struct(F.concat(F.lit("org-"), (F.col("doc_id") % 11).cast("string")).alias("name"),
                               F.when(F.col("doc_id") % 10 == 1, F.lit("")).otherwise(F.col("organization")).alias("title"))))
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00"))
    pkg = F.struct(
        F.concat(F.lit("pkg-"), F.col("external_id")).alias("id"),
        F.concat(F.lit("ds-"), F.col("external_id")).alias("name"),
        F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("title")).alias("title"),
        F.coalesce(F.col("description"), F.lit("")).alias("notes"), org.alias("organization"), tags.alias("tags"),
        F.transform(F.coalesce("rs", F.array()), lambda x: F.struct(x["id"].alias("id"), x["url"].alias("url"),
                                                                   x["format"].alias("format"), x["name"].alias("name"),
                                                                   x["size"].alias("size"))).alias("resources"),
        F.col("license").alias("license_title"),
        F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("lic-"), (F.col("doc_id") % 3).cast("string"))).alias("license_id"),
        F.when(F.col("created_on").isNotNull(), iso(F.col("created_on"))).alias("metadata_created"),
        F.when(F.col("modified_on").isNotNull(), iso(F.col("modified_on"))).alias("metadata_modified"),
        F.when(F.col("doc_id") % 23 == 0, F.lit("deleted")).when(F.col("doc_id") % 2 == 0, F.lit(None))
         .otherwise(F.lit("active")).alias("state"))
    pages = (j.groupBy("catalog_id", (F.col("doc_id") / 50).cast("bigint").alias("page"))
             .agg(F.array_sort(F.collect_list(F.struct("doc_id", pkg.alias("pkg")))).alias("ps")))
    body = F.struct(F.lit(True).alias("success"),
                    F.struct(F.size("ps").cast("bigint").alias("count"),
                             F.transform("ps", lambda x: x["pkg"]).alias("results")).alias("result"))
    return pages.select("catalog_id", "page", F.to_json(body).alias("payload"))


def record_columns(df):
    return df.select("id", "catalog_id", "external_id", "title", "description", "organization",
                     F.array_join("tags", "|").alias("tags"), "license",
                     F.size("resources").cast("bigint").alias("n_resources"),
                     F.array_join(F.transform("resources", lambda r: r["format"]), "|").alias("formats"),
                     F.size(F.filter("resources", lambda r: r["size_bytes"].isNotNull())).cast("bigint").alias("n_sized"),
                     "created_at", "modified_at")


@query("ckan_map")
def q_ckan_map(spark, sf):
    return record_columns(payloads.ckan_map(ckan_pages(spark, sf)))


oracle("ckan_map", """WITH rs AS (SELECT dataset_id, count(*) AS n,
   string_agg(upper(coalesce(nullif(format, ''), 'unknown')), '|' ORDER BY i) AS formats,
   sum(CASE WHEN (CASE WHEN doc_id % 5 = 2 THEN 0 ELSE size_bytes END) > 0 THEN 1 ELSE 0 END) AS n_sized
   FROM v_resources GROUP BY dataset_id)
SELECT d.catalog_id || ':ds-' || d.external_id AS id, d.catalog_id, 'ds-' || d.external_id AS external_id,
 CASE WHEN d.doc_id % 9 = 0 OR d.title = '' THEN 'ds-' || d.external_id ELSE d.title END AS title,
 nullif(coalesce(d.description, ''), '') AS description,
 CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 10 = 1 OR coalesce(d.organization, '') = '' THEN 'org-' || CAST(d.doc_id % 11 AS VARCHAR) ELSE d.organization END AS organization,
 coalesce(array_to_string(list_transform(string_split(d.tags_text, ' '), lambda t: CASE WHEN d.doc_id % 4 = 1 THEN t ELSE upper(t) END), '|'), '') AS tags,
 coalesce(nullif(d.license, ''), CASE WHEN d.doc_id % 8 = 0 THEN 'lic-' || CAST(d.doc_id % 3 AS VARCHAR) END) AS license,
 CAST(coalesce(rs.n, 0) AS BIGINT) AS n_resources, coalesce(rs.formats, '') AS formats, CAST(coalesce(rs.n_sized, 0) AS BIGINT) AS n_sized,
 CASE WHEN d.created_on IS NOT NULL THEN strftime(d.created_on, '%Y-%m-%d') || 'T00:00:00' END AS created_at,
 CASE WHEN d.modified_on IS NOT NULL THEN strftime(d.modified_on, '%Y-%m-%d') || 'T00:00:00' END AS modified_at
FROM v_datasets d LEFT JOIN rs ON rs.dataset_id = d.id WHERE NOT (d.doc_id % 23 = 0)""", "v_resources")

# ------------------------------------------------------------------ Socrata


def socrata_pages(spark, sf):
    """Landed Socrata catalog pages built from the pages table (25 per page)."""
    register_views(spark, sf, ())
    p = spark.table("pages")
    pid = F.col("page_id")
    md = (F.when(pid % 3 == 0, F.array(F.struct(F.lit("Dataset-Information_Agency").alias("key"),
                                                F.concat(F.lit("DIA "), (pid % 5).cast("string")).alias("value"))))
          .when(pid % 3 == 1, F.array(F.struct(F.lit("Other").alias("key"), F.lit("x").alias("value")),
                                      F.struct(F.lit("Entidad Responsable").alias("key"),
                                               F.concat(F.lit("Entidad "), (pid % 6).cast("string")).alias("value"))))
          .otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    domain_tags = (F.when(pid % 2 == 0, F.array(F.lit("a"), F.concat(F.lit("b"), (pid % 3).cast("string"))))
                   .when(pid % 6 == 3, F.array().cast("array<string>")))
    res = F.struct(
        F.struct(F.concat(F.lit("abcd-"), pid.cast("string")).alias("id"),
                 F.concat(F.lit("Page "), pid.cast("string")).alias("name"), F.col("html").alias("description"),
                 F.when(pid % 4 == 0, F.lit(None)).when(pid % 4 == 1, F.lit(""))
                  .otherwise(F.concat(F.lit("Agency "), (pid % 7).cast("string"))).alias("attribution"),
                 F.when(pid % 10 == 0, F.lit("map")).when(pid % 10 == 1, F.lit(None)).otherwise(F.lit("dataset")).alias("type"),
                 F.lit("2024-02-01T00:00:00.000Z").alias("updatedAt"), F.lit("2023-05-01T00:00:00.000Z").alias("createdAt"),
                 F.when(pid % 4 != 0, F.concat(F.lit("2024-03-"), F.lpad((pid % 28 + 1).cast("string"), 2, "0"),
                                               F.lit("T00:00:00.000Z"))).alias("data_updated_at")).alias("resource"),
        F.struct(md.alias("domain_metadata"), domain_tags.alias("domain_tags"),
                 F.when(pid % 5 != 0, F.array(F.lit("t1"))).alias("tags")).alias("classification"),
        F.struct(F.regexp_extract("url", r"://([^/:?#]+)", 1).alias("domain"),
                 F.when(pid % 5 == 0, F.lit("")).otherwise(F.lit("ODbL")).alias("license")).alias("metadata"))
    pages = p.groupBy((pid / 25).cast("bigint").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(pid.alias("k"), res.alias("r")))).alias("rs"))
    body = F.struct(F.size("rs").cast("bigint").alias("resultSetSize"), F.transform("rs", lambda x: x["r"]).alias("results"))
    return pages.select(F.lit("portal").alias("catalog_id"), "page", F.to_json(body).alias("payload"))


@query("socrata_map")
def q_socrata_map(spark, sf):
    return record_columns(payloads.socrata_map(socrata_pages(spark, sf))).drop("n_sized")


oracle("socrata_map", f"""SELECT 'portal:abcd-' || CAST(page_id AS VARCHAR) AS id, 'portal' AS catalog_id, 'abcd-' || CAST(page_id AS VARCHAR) AS external_id,
 'Page ' || CAST(page_id AS VARCHAR) AS title,
 CASE WHEN coalesce(html, '') <> '' THEN {trim_ws("regexp_replace(html, '<[^>]*>', '', 'g')")} END AS description,
 CASE WHEN page_id % 4 >= 2 THEN 'Agency ' || CAST(page_id % 7 AS VARCHAR)
      WHEN page_id % 3 = 0 THEN 'DIA ' || CAST(page_id % 5 AS VARCHAR)
      WHEN page_id % 3 = 1 THEN 'Entidad ' || CAST(page_id % 6 AS VARCHAR) END AS organization,
 CASE WHEN page_id % 2 = 0 THEN 'a|b' || CAST(page_id % 3 AS VARCHAR) WHEN page_id % 6 = 3 THEN '' WHEN page_id % 5 <> 0 THEN 't1' ELSE '' END AS tags,
 CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'ODbL' END AS license, CAST(1 AS BIGINT) AS n_resources, 'CSV' AS formats,
 '2023-05-01T00:00:00.000Z' AS created_at,
 CASE WHEN page_id % 4 <> 0 THEN '2024-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00.000Z' ELSE '2024-02-01T00:00:00.000Z' END AS modified_at
FROM pages WHERE page_id % 10 <> 0""")

# ------------------------------------------------------------------ protocol detection


SOCRATA_LANGUAGES = {"Español": "es", "english": "en", "Português": "pt", "Français": "fr", "Deutsch": None,
                     "Idioma español": "es", "PT-br": "pt"}


def probe_payloads(spark, sf):
    """Landed probe responses of four kinds, built from the pages table."""
    register_views(spark, sf, ())
    pid = F.col("page_id")
    lang_ckan = F.when(pid % 3 == 0, F.lit("es-AR")).when(pid % 3 == 1, F.lit("EN")).otherwise(F.lit("x"))
    no = F.pmod(F.floor(pid / 5), F.lit(7))                     # independent of the payload's kind
    lang_val = F.element_at(F.array(*[F.lit(x) for x in SOCRATA_LANGUAGES]), (no + 1).cast("int"))
    ckan = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.array(F.struct(
        lang_ckan.alias("metadata_language"))).alias("results")).alias("result")))
    soc = F.to_json(F.struct(pid.alias("resultSetSize"), F.array(F.struct(F.struct(F.array(
        F.struct(F.lit("Category").alias("key"), F.lit("x").alias("value")),
        F.struct(F.lit("Idioma del dataset").alias("key"), lang_val.alias("value"))).alias("domain_metadata"))
        .alias("classification"))).alias("results")))
    payload = (F.when(pid % 5 == 0, ckan).when(pid % 5 == 1, soc)
               .when(pid % 5 == 2, F.lit('{"success": "true", "resultSetSize": "12"}'))
               .when(pid % 5 == 3, F.lit('{"success": false, "resultSetSize": 3.5, "results": []}'))
               .otherwise(F.lit("not json")))
    return spark.table("pages").select("page_id", payload.alias("payload"))


@query("payload_protocol")
def q_payload_protocol(spark, sf):
    return payloads.payload_protocol(probe_payloads(spark, sf)).select("page_id", "protocol", "language")


_LANG_SQL = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(SOCRATA_LANGUAGES.values()) if v)
oracle("payload_protocol", f"""SELECT page_id,
 CASE page_id % 5 WHEN 0 THEN 'ckan' WHEN 1 THEN 'socrata' WHEN 3 THEN 'socrata' END AS protocol,
 CASE WHEN page_id % 5 = 0 THEN (CASE page_id % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'en' END)
      WHEN page_id % 5 = 1 THEN (CASE (page_id // 5) % 7 {_LANG_SQL} END) END AS language
FROM pages""")

# ------------------------------------------------------------------ cursor listing
CURSOR = "2025-06-01 00:00:00"


@query("list_since")
def q_list_since(spark, sf):
    register_views(spark, sf, ("v_datasets", "v_catalogs"))
    d = spark.table("v_datasets").select("id", "catalog_id", F.col("modified_on").cast("timestamp").alias("modified_at"))
    cats = spark.table("v_catalogs").select(F.col("id").alias("catalog_id"), "protocol")
    d = d.join(cats, "catalog_id", "left")
    out = payloads.list_since(d, CURSOR, keep_undated=F.col("protocol") == "socrata")
    return out.select("id", "catalog_id", "modified_at")


oracle("list_since", f"""SELECT d.id, d.catalog_id, CAST(d.modified_on AS TIMESTAMP) AS modified_at
FROM v_datasets d LEFT JOIN v_catalogs c ON d.catalog_id = c.id
WHERE CAST(d.modified_on AS TIMESTAMP) >= TIMESTAMP '{CURSOR}' OR (d.modified_on IS NULL AND c.protocol = 'socrata')""",
       "v_datasets", "v_catalogs")
