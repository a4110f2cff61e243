"""Per-record text for embedding and record lookup by composite id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_formats(resources: DataFrame) -> DataFrame:
    """Distinct upper-cased formats per dataset in first-seen order.

    Formats are made distinct before they are collected, so a record's list is
    bounded by the format vocabulary, not by its number of resources.
    """
    first = (resources.groupBy("dataset_id", F.upper("format").alias("f"))
             .agg(F.min("i").alias("first_i")))
    return (first.groupBy("dataset_id")
            .agg(F.array_sort(F.collect_list(F.struct("first_i", "f"))).alias("fs"))
            .select(F.col("dataset_id").alias("id"), F.transform("fs", lambda x: x["f"]).alias("formats")))


def build_documents(datasets: DataFrame, resources: DataFrame) -> DataFrame:
    """``Fuente: org. Título: t. Tema: tags. Formatos: F1, F2. Descripción: d.``"""
    d = datasets.join(distinct_formats(resources), "id", "left")
    nonempty = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    parts = F.concat_ws(
        ". ",
        F.when(nonempty("organization"), F.concat(F.lit("Fuente: "), F.col("organization"))),
        F.concat(F.lit("Título: "), F.coalesce(F.col("title"), F.lit("undefined"))),
        F.when(F.size("tags") > 0, F.concat(F.lit("Tema: "), F.array_join("tags", ", "))),
        F.when(F.size("formats") > 0, F.concat(F.lit("Formatos: "), F.array_join("formats", ", "))),
        F.when(nonempty("description"), F.concat(F.lit("Descripción: "), F.col("description"))),
    )
    text = F.when(parts.endswith("."), parts).otherwise(F.concat(parts, F.lit(".")))
    return d.select("id", text.alias("document"))


def lookup(datasets: DataFrame, ids: list[str], catalog_id: str | None = None) -> DataFrame:
    """Records by composite id ``catalog:external`` (no colon: no match), plus all
    records of one catalog. The catalog part is an equality on the partition
    column, so a catalog-partitioned table is pruned to one folder."""
    valid = [rid for rid in ids if ":" in rid]
    cats = sorted({rid.split(":", 1)[0] for rid in valid})
    out = (datasets.where(F.col("catalog_id").isin(*cats) & F.col("id").isin(*valid))
           .withColumn("requested", F.col("id")))
    if catalog_id is not None:
        part = datasets.where(F.col("catalog_id") == catalog_id) \
                       .withColumn("requested", F.lit(f"catalog:{catalog_id}"))
        out = out.unionByName(part)
    return out
