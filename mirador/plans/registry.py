"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (or views Spark derives from them) in
full; no id subsets or row caps except where a limit is the feature itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.plans import pipeline
from mirador.operators import ranking, scoring, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _joined(c):
    return F.array_join(c, ",")


# ------------------------------------------------------------------ scoring
@query("score_completeness")
def q_score_completeness(spark, sf):
    s = pipeline.dataset_scores(spark, sf)
    return s.select("id", "catalog_id", "completeness", _joined("fields_present").alias("fields_present"),
                    _joined("fields_missing").alias("fields_missing"), "description_length",
                    "tag_count", "resource_count")


@query("score_freshness")
def q_score_freshness(spark, sf):
    return pipeline.dataset_scores(spark, sf).select("id", "freshness", "days_since_modified")


@query("score_structure")
def q_score_structure(spark, sf):
    return pipeline.dataset_scores(spark, sf).select(
        "id", "structure", "best_format", _joined("formats").alias("formats"), "resource_count")


@query("score_accessibility")
def q_score_accessibility(spark, sf):
    return pipeline.dataset_scores(spark, sf).select("id", "accessibility", "checked", "accessible")


@query("score_overall")
def q_score_overall(spark, sf):
    return pipeline.dataset_scores(spark, sf).select(
        "id", "catalog_id", "accessibility", "structure", "freshness", "completeness", "overall")


@query("score_level")
def q_score_level(spark, sf):
    s = scoring.with_level(pipeline.dataset_scores(spark, sf))
    return s.select("id", "overall", "level", "percent")


# ------------------------------------------------------------------ summaries
@query("catalog_summary")
def q_catalog_summary(spark, sf):
    return pipeline.summaries(spark, sf)


@query("median_freshness")
def q_median_freshness(spark, sf):
    return summary.median_freshness(pipeline.dataset_scores(spark, sf))


@query("top_formats")
def q_top_formats(spark, sf):
    return summary.top_formats(pipeline.dataset_scores(spark, sf)) \
        .select("catalog_id", "format", F.col("datasets").cast("bigint").alias("datasets"),
                F.col("rank").cast("bigint").alias("rank"))


@query("global_stats")
def q_global_stats(spark, sf):
    return summary.global_stats(pipeline.catalog_index(spark, sf))


@query("weighted_rank")
def q_weighted_rank(spark, sf):
    return ranking.weighted_rank(pipeline.catalog_index(spark, sf))


@query("country_ranking")
def q_country_ranking(spark, sf):
    return ranking.country_ranking(pipeline.catalog_index(spark, sf)) \
        .select("country", "id", "status", F.col("scored_count").cast("bigint").alias("scored_count"),
                F.col("total_datasets").cast("bigint").alias("total_datasets"),
                F.col("row_no").cast("bigint").alias("row_no"),
                F.col("rank").cast("bigint").alias("rank"), "weight")
