"""Gapless row numbers without one task for all rows, or for all rows of a key.

Rows are range-partitioned by (key, order), sorted within partitions and written; each
partition numbers its own rows of a key, the partitions' counts are summed up per key (one row
per key and partition), and every row adds its partition's offset. A key that holds a third of
all rows is spread over the partitions of its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.session import scratch_path


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... per key in the given order (which should be total)."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "numbered")
    by = [F.col(k) for k in keys] + list(order)
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    own = [*keys, "_part"]
    firsts = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if keys else \
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # one row a partition
    firsts = firsts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(own)], "_from",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(own)]
    joined = rows.join(firsts, on)
    # a key's rows lie together in a partition, in order, so places in the partition tell their numbers
    return joined.withColumn(name, (F.col("_at") - F.col("_from") + F.col("_before") + 1).cast("bigint")) \
        .drop("_part", "_at", "_from", "_before", *[f"_k{i}" for i in range(len(own))])
