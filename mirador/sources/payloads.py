"""Landed portal payloads (CKAN and Socrata JSON) -> DatasetRecord rows, and
protocol / language detection over landed probe responses.

Payloads are parsed with explicit schemas (``from_json``) or as VARIANT when the
JSON type of a field matters; pages are exploded to one row per record, so the
work is spread over all pages, never one document per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.functions.columns import js_trim

CKAN_SCHEMA = (
    "success boolean, result struct<count:bigint, results:array<struct<"
    "id:string, name:string, title:string, notes:string, "
    "organization:struct<id:string,name:string,title:string>, "
    "tags:array<struct<id:string,name:string,display_name:string>>, "
    "resources:array<struct<id:string,url:string,format:string,name:string,size:bigint>>, "
    "license_title:string, license_id:string, metadata_created:string, metadata_modified:string, "
    "state:string>>>")

SOCRATA_SCHEMA = (
    "resultSetSize bigint, results array<struct<"
    "resource:struct<id:string,name:string,description:string,attribution:string,type:string,"
    "updatedAt:string,createdAt:string,data_updated_at:string>, "
    "classification:struct<categories:array<string>,tags:array<string>,domain_category:string,"
    "domain_tags:array<string>,domain_metadata:array<struct<key:string,value:string>>>, "
    "metadata:struct<domain:string,license:string>, permalink:string, link:string>>")


def _or(*cols: Column) -> Column:
    """JavaScript ``a || b``: the first value that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def ckan_map(pages: DataFrame, catalog_col: str = "catalog_id", json_col: str = "payload") -> DataFrame:
    """CKAN package_search pages -> DatasetRecord (non-active packages dropped)."""
    parsed = pages.select(catalog_col, F.from_json(F.col(json_col), CKAN_SCHEMA).alias("p"))
    pk = parsed.select(catalog_col, F.explode("p.result.results").alias("k"))
    pk = pk.where(F.col("k.state").isNull() | (F.col("k.state") == "") | (F.col("k.state") == "active"))
    rid = F.concat(F.col(catalog_col), F.lit(":"), F.col("k.name"))
    res = F.transform(F.coalesce(F.col("k.resources"), F.array()), lambda r: F.struct(
        r["id"].alias("id"), r["url"].alias("url"),
        F.upper(_or(r["format"], F.lit("unknown"))).alias("format"),
        _or(r["name"]).alias("name"),
        F.when(r["size"] > 0, r["size"]).alias("size_bytes")))
    return pk.select(
        rid.alias("id"), F.col(catalog_col).alias("catalog_id"), F.col("k.name").alias("external_id"),
        _or(F.col("k.title"), F.col("k.name")).alias("title"),
        _or(F.col("k.notes")).alias("description"),
        _or(F.col("k.organization.title"), F.col("k.organization.name")).alias("organization"),
        F.transform(F.coalesce(F.col("k.tags"), F.array()),
                    lambda t: _or(t["display_name"], t["name"])).alias("tags"),
        _or(F.col("k.license_title"), F.col("k.license_id")).alias("license"),
        res.alias("resources"),
        _or(F.col("k.metadata_created")).alias("created_at"),
        _or(F.col("k.metadata_modified")).alias("modified_at"))


def strip_html(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, r"<[^>]*>", ""))


def socrata_map(pages: DataFrame, catalog_col: str = "catalog_id", json_col: str = "payload") -> DataFrame:
    """Socrata catalog pages -> DatasetRecord (only type null or 'dataset')."""
    parsed = pages.select(catalog_col, F.from_json(F.col(json_col), SOCRATA_SCHEMA).alias("p"))
    r = parsed.select(catalog_col, F.explode("p.results").alias("r"))
    r = r.where(F.col("r.resource.type").isNull() | (F.col("r.resource.type") == "")
                | (F.col("r.resource.type") == "dataset"))
    rid = F.concat(F.col(catalog_col), F.lit(":"), F.col("r.resource.id"))
    agency = F.filter(F.coalesce(F.col("r.classification.domain_metadata"), F.array()),
                      lambda m: (m["key"] == "Dataset-Information_Agency") | m["key"].contains("Entidad")
                      | m["key"].contains("Agency"))
    org = F.coalesce(_or(F.col("r.resource.attribution")), F.try_element_at(agency, F.lit(1))["value"])
    tags = F.coalesce(F.col("r.classification.domain_tags"), F.col("r.classification.tags"),
                      F.array().cast("array<string>"))
    url = F.concat(F.lit("https://"), F.col("r.metadata.domain"), F.lit("/api/views/"),
                   F.col("r.resource.id"), F.lit("/rows.csv?accessType=DOWNLOAD"))
    resource = F.array(F.struct(F.col("r.resource.id").alias("id"), url.alias("url"),
                                F.lit("CSV").alias("format"), _or(F.col("r.resource.name")).alias("name"),
                                F.lit(None).cast("bigint").alias("size_bytes")))
    return r.select(
        rid.alias("id"), F.col(catalog_col).alias("catalog_id"), F.col("r.resource.id").alias("external_id"),
        F.col("r.resource.name").alias("title"),
        F.when(_or(F.col("r.resource.description")).isNotNull(),
               strip_html(F.col("r.resource.description"))).alias("description"),
        org.alias("organization"), tags.alias("tags"),
        _or(F.col("r.metadata.license")).alias("license"), resource.alias("resources"),
        _or(F.col("r.resource.createdAt")).alias("created_at"),
        F.coalesce(F.col("r.resource.data_updated_at"), F.col("r.resource.updatedAt")).alias("modified_at"))


def _json_type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def payload_protocol(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Classify landed probe responses: ckan when ``success`` is boolean true,
    socrata when ``resultSetSize`` is a JSON number (ckan checked first); the
    language from the first record (CKAN metadata_language, or the Socrata
    Idioma/Language metadata entry)."""
    v = F.try_parse_json(F.col(json_col))
    success_true = (_json_type(v, "$.success") == "BOOLEAN") & \
        F.coalesce(F.try_variant_get(v, "$.success", "boolean"), F.lit(False))
    rss_type = _json_type(v, "$.resultSetSize")
    rss_number = rss_type.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | \
        rss_type.startswith("DECIMAL")
    protocol = (F.when(success_true, F.lit("ckan")).when(F.coalesce(rss_number, F.lit(False)), F.lit("socrata")))
    ckan_lang = F.try_variant_get(v, "$.result.results[0].metadata_language", "string")
    ckan_lang = F.when(F.length(ckan_lang) >= 2, F.lower(F.substring(ckan_lang, 1, 2)))
    md = F.try_variant_get(v, "$.results[0].classification.domain_metadata",
                           "array<struct<key:string,value:string>>")
    entry = F.try_element_at(F.filter(F.coalesce(md, F.array().cast("array<struct<key:string,value:string>>")),
                                      lambda m: m["key"].contains("Idioma") | m["key"].contains("Language")),
                             F.lit(1))
    val = F.lower(entry["value"])
    soc_lang = (F.when(val.startswith("es") | val.contains("español"), F.lit("es"))
                .when(val.startswith("en") | val.contains("english"), F.lit("en"))
                .when(val.startswith("pt") | val.contains("portugu"), F.lit("pt"))
                .when(val.startswith("fr") | val.contains("fran"), F.lit("fr")))
    language = F.when(protocol == "ckan", ckan_lang).when(protocol == "socrata", soc_lang)
    return payloads.select("*", protocol.alias("protocol"), language.alias("language"))


def list_since(records: DataFrame, cursor: str, keep_undated: Column | bool = False) -> DataFrame:
    """Records modified at or after the cursor (inclusive), ascending by modified
    time per catalog; where ``keep_undated`` holds (the Socrata path) records
    without a date are kept too (they sort last)."""
    keep = keep_undated if isinstance(keep_undated, Column) else F.lit(bool(keep_undated))
    since = (F.col("modified_at") >= F.lit(cursor).cast("timestamp")) | \
        (F.col("modified_at").isNull() & keep)
    # a global sort is range-partitioned, so one large catalog spreads over many tasks
    return records.where(since).orderBy("catalog_id", F.col("modified_at").asc_nulls_last(), "id")
