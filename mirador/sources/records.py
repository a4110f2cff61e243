"""Dataset records, resources and checks in the library's typed shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.fixtures import register_views

DATASET_COLUMNS = ["id", "catalog_id", "external_id", "title", "description",
                   "organization", "tags", "license", "created_at", "modified_at", "language"]


def datasets(spark: SparkSession, sf_dir: str, keep_doc_id: bool = False) -> DataFrame:
    """DatasetRecord rows: tags as an array (empty when absent), dates as UTC timestamps."""
    register_views(spark, sf_dir, ("v_datasets",))
    d = spark.table("v_datasets")
    cols = [
        "id", "catalog_id", "external_id", "title", "description", "organization",
        F.when(F.col("tags_text").isNull(), F.array().cast("array<string>"))
         .otherwise(F.split("tags_text", " ")).alias("tags"),
        "license",
        F.col("created_on").cast("timestamp").alias("created_at"),
        F.col("modified_on").cast("timestamp").alias("modified_at"),
        "language",
    ]
    if keep_doc_id:
        cols.append("doc_id")
    return d.select(*cols)


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("v_resources",))
    return spark.table("v_resources").select("dataset_id", "catalog_id", "i", "url", "format",
                                             "size_bytes")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("v_checks",))
    return spark.table("v_checks")


def catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("v_catalogs",))
    return spark.table("v_catalogs")
