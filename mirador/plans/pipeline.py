"""The scoring run expressed as DataFrame plans over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.fixtures import AS_OF
from mirador.operators import scoring, summary
from mirador.sources import records
from mirador.session import written_table


def dataset_scores(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """The per-dataset score table of a run, written once to the shared folder."""
    def build():
        return scoring.score_datasets(records.datasets(spark, sf_dir), records.resources(spark, sf_dir),
                                      records.checks(spark, sf_dir), as_of)
    return written_table(spark, ("scores", sf_dir.rstrip("/"), as_of), build)


def known_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (records.datasets(spark, sf_dir).groupBy("catalog_id")
            .agg(F.count(F.lit(1)).alias("known_count")))


def summaries(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    return summary.catalog_summary(dataset_scores(spark, sf_dir, as_of), known_counts(spark, sf_dir))


def catalog_index(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """Every catalog of the directory: its summary, or a zero 'pending' placeholder."""
    cats = records.catalogs(spark, sf_dir)
    s = summaries(spark, sf_dir, as_of)
    j = cats.join(s, cats["id"] == s["catalog_id"], "left")
    zero = F.lit(0.0)
    return j.select(
        "id", "name", "country", "protocol", "pos",
        F.when(F.col("catalog_id").isNull(), F.lit("pending")).otherwise(F.lit("ok")).alias("status"),
        F.coalesce("dataset_count", F.lit(0)).cast("bigint").alias("dataset_count"),
        F.coalesce("resource_count", F.lit(0)).cast("bigint").alias("resource_count"),
        F.coalesce("datasets_scored", F.lit(0)).cast("bigint").alias("datasets_scored"),
        *[F.coalesce(c, zero).alias(c) for c in
          ("overall", "accessibility", "structure", "freshness", "completeness", "accessible_pct")],
        F.coalesce("coverage", zero).alias("coverage"),
    )
