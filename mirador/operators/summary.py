"""Catalog-level aggregates over the per-dataset score table.

All are keyed by ``catalog_id`` and use partial (map-side) aggregation, so a
catalog holding a third of all datasets costs one merge of small buffers, not
one task holding its rows. The exact median works on a histogram of rounded
days (bounded by the number of distinct day values), never on the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirador.functions.columns import avg3, mean_exact, round3

DIMS = ("accessibility", "structure", "freshness", "completeness")


def catalog_summary(scores: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per catalog: means of overall and dimensions, accessible share, coverage.

    ``known`` (catalog_id, known_count) gives the number of datasets the catalog
    holds; when absent, scored = known. ``resource_count`` counts distinct
    formats per dataset, summed.
    """
    agg = scores.groupBy("catalog_id").agg(
        F.count(F.lit(1)).alias("datasets_scored"),
        avg3(F.col("overall")).alias("overall"),
        *[avg3(F.col(d)).alias(d) for d in DIMS],
        F.sum("accessible").alias("_accessible"),
        F.sum("checked").alias("_checked"),
        F.sum(F.size("formats")).cast("bigint").alias("resource_count"),
    )
    if known is None:
        agg = agg.withColumn("dataset_count", F.col("datasets_scored"))
    else:
        agg = agg.join(known, "catalog_id", "left") \
                 .withColumn("dataset_count", F.coalesce(F.col("known_count"), F.lit(0)).cast("bigint"))
    coverage = F.when(F.col("dataset_count") > 0,
                      round3(F.col("datasets_scored") / F.col("dataset_count"))).otherwise(F.lit(1.0))
    return agg.select(
        "catalog_id", "dataset_count", "datasets_scored", "resource_count",
        "overall", *DIMS,
        F.when(F.col("_checked") > 0, round3(F.col("_accessible") / F.col("_checked")))
         .otherwise(F.lit(0.0)).alias("accessible_pct"),
        coverage.alias("coverage"),
    )


def median_freshness(scores: DataFrame) -> DataFrame:
    """Exact median of rounded days since modification per catalog (null if none).

    Built from a (catalog, days) histogram: the middle one or two values are
    found from cumulative counts, which keeps the work proportional to the
    number of distinct day values per catalog.
    """
    hist = (scores.where(F.col("days_since_modified").isNotNull())
            .groupBy("catalog_id", "days_since_modified").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("catalog_id").orderBy("days_since_modified")
    cum = hist.withColumn("hi", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
              .withColumn("lo", F.col("hi") - F.col("n") + 1) \
              .withColumn("total", F.sum("n").over(Window.partitionBy("catalog_id")))
    # 1-based positions of the middle values
    k1 = F.floor((F.col("total") + 1) / 2)
    k2 = F.floor(F.col("total") / 2) + 1
    picked = cum.select(
        "catalog_id",
        F.when((F.col("lo") <= k1) & (k1 <= F.col("hi")), F.col("days_since_modified")).alias("m1"),
        F.when((F.col("lo") <= k2) & (k2 <= F.col("hi")), F.col("days_since_modified")).alias("m2"))
    med = picked.groupBy("catalog_id").agg(
        ((F.max("m1") + F.max("m2")) / 2.0).alias("median_freshness_days"))
    cats = scores.select("catalog_id").distinct()
    return cats.join(med, "catalog_id", "left")


def top_formats(scores: DataFrame, n: int = 5) -> DataFrame:
    """Top formats per catalog by the number of datasets having them (tie: format)."""
    counts = (scores.select("catalog_id", F.explode("formats").alias("format"))
              .groupBy("catalog_id", "format").agg(F.count(F.lit(1)).alias("datasets")))
    w = Window.partitionBy("catalog_id").orderBy(F.desc("datasets"), F.asc("format"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def global_stats(index: DataFrame) -> DataFrame:
    """Catalog count, distinct countries, totals and means over non-pending catalogs."""
    scored = F.col("status") != "pending"
    n_scored = F.sum(F.when(scored, 1).otherwise(0))
    return index.agg(
        F.count(F.lit(1)).alias("catalog_count"),
        F.countDistinct("country").alias("country_count"),
        F.coalesce(F.sum(F.when(scored, F.col("dataset_count"))), F.lit(0)).cast("bigint").alias("total_datasets"),
        F.coalesce(F.sum(F.when(scored, F.col("resource_count"))), F.lit(0)).cast("bigint").alias("total_resources"),
        F.coalesce(F.round(mean_exact(F.when(scored, F.col("overall"))), 6), F.lit(0.0)).alias("avg_overall"),
        F.coalesce(F.round(mean_exact(F.when(scored, F.col("accessibility"))), 6), F.lit(0.0))
         .alias("avg_accessibility"),
    )
