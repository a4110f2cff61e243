"""Rankings over the catalog index (one row per catalog) and dataset listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.operators.numbering import numbered


def weighted(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.col("overall") * F.log10(1 + F.col("dataset_count")))


def weighted_rank(index: DataFrame, n: int = 5) -> DataFrame:
    """Top catalogs by overall * log10(1 + datasets), pending ones excluded."""
    w = weighted(index.where(F.col("status") != "pending"))
    return (w.orderBy(F.desc("weight"), F.asc("pos"))
            .limit(n)
            .select("id", "country", "dataset_count", "overall",
                    F.round("weight", 6).alias("weight")))


def country_ranking(index: DataFrame) -> DataFrame:
    """Countries ordered by scored catalogs then total datasets; inside a country
    pending catalogs last, then by weight; a running rank that skips pending.

    The input is already reduced to one row per catalog, so the single global
    ordering window sees only catalog rows.
    """
    pending = (F.col("status") == "pending")
    by_country = Window.partitionBy("country")
    g = (weighted(index)
         .withColumn("is_pending", pending.cast("int"))
         .withColumn("scored_count", F.sum(1 - F.col("is_pending")).over(by_country))
         .withColumn("total_datasets", F.sum("dataset_count").over(by_country))
         .withColumn("first_pos", F.min("pos").over(by_country)))
    order = [F.desc("scored_count"), F.desc("total_datasets"), F.asc("first_pos"),
             F.asc("is_pending"), F.desc("weight"), F.asc("pos")]
    glob = Window.orderBy(*order)
    g = g.withColumn("row_no", F.row_number().over(glob)) \
         .withColumn("running", F.sum(1 - F.col("is_pending")).over(glob.rowsBetween(Window.unboundedPreceding, 0)))
    return g.select("country", "id", "status", "scored_count", "total_datasets", "row_no",
                    F.when(F.col("is_pending") == 0, F.col("running")).alias("rank"),
                    F.round("weight", 6).alias("weight"))


def tier_classify(catalogs: DataFrame, membership: DataFrame, detail_presets: list[str],
                  priority_presets: list[str]) -> DataFrame:
    """Detail tier if in a detail preset; order detail first, then the first
    position in the priority presets (unlisted last), then input order.

    ``membership`` holds (preset, catalog_id, member_pos) rows.
    """
    detail = (membership.where(F.col("preset").isin(*detail_presets))
              .select("catalog_id").distinct().withColumn("in_detail", F.lit(True)))
    prio_idx = F.array_position(F.array(*[F.lit(p) for p in priority_presets]), F.col("preset"))
    prio = (membership.where(F.col("preset").isin(*priority_presets))
            .groupBy("catalog_id")
            .agg(F.min(F.struct(prio_idx.alias("p"), F.col("member_pos").alias("m"))).alias("k")))
    c = (catalogs.join(detail, catalogs["id"] == detail["catalog_id"], "left").drop("catalog_id")
         .join(prio, catalogs["id"] == prio["catalog_id"], "left").drop("catalog_id"))
    c = c.withColumn("tier", F.when(F.col("in_detail"), F.lit("detail")).otherwise(F.lit("aggregate")))
    w = Window.orderBy(F.when(F.col("tier") == "detail", 0).otherwise(1),
                       F.col("k.p").asc_nulls_last(), F.col("k.m").asc_nulls_last(), F.col("pos"))
    return c.select("id", "tier", F.row_number().over(w).alias("run_order"))


DEEP_ROWS = 100_000            # rows before a page from which it is found by numbers


def dataset_list_page(scores: DataFrame, search: str | None, sort: str = "overall",
                      page: int = 0, page_size: int = L.DATASET_PAGE_SIZE,
                      descending: bool | None = None) -> DataFrame:
    """Case-insensitive substring over title, organization and id (search text
    trimmed), sorted by overall (default descending), title (empty title: the id)
    or organization (missing: empty), then paged. Ties keep id order.

    A first page is a limit per partition and a merge of those; far pages would put all rows
    before them into one task, so they are found by row numbers from range partitions."""
    df = scores
    q = (search or "").strip().lower()
    if q:
        df = df.where(F.lower(F.coalesce("title", F.lit(""))).contains(q)
                      | F.lower(F.coalesce("organization", F.lit(""))).contains(q)
                      | F.lower(F.col("id")).contains(q))
    key = {"overall": F.col("overall"),
           "title": F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("id")),
           "organization": F.coalesce(F.col("organization"), F.lit(""))}[sort]
    desc = (sort == "overall") if descending is None else descending
    start = page * page_size
    if start < DEEP_ROWS:
        return df.orderBy(key.desc() if desc else key.asc(), F.asc("id")).offset(start).limit(page_size)
    keyed = df.withColumn("_key", key)
    order = [F.col("_key").desc() if desc else F.col("_key").asc(), F.col("id").asc()]
    here = F.col("_rn").between(start + 1, start + page_size)
    return numbered(keyed, [], order, "_rn").where(here).orderBy("_rn").drop("_rn", "_key")
