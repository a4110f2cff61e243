"""Range join of two large tables: values against half-open intervals.

A theta join compares every value with every interval. Here an interval is put on the level of
its length (bins of the next power of two), where it covers two bins at most, and a value looks
into one bin of every level in use; an equi-join on (level, bin) with the interval's borders as
residual condition gives exactly the pairs of the theta join. Both sides shuffle on the key, so
neither has to fit in memory, and AQE splits a bin that many values share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirador.session import scratch_path

MIN_LEVEL, MAX_LEVEL = -40, 62     # bins of 2^-40 .. 2^62


def range_join(values: DataFrame, intervals: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Rows of both sides with low <= value < high. Nulls and empty intervals match nothing."""
    span = F.col(high) - F.col(low)
    level = F.least(F.greatest(F.ceil(F.log2(span.cast("double"))).cast("int"), F.lit(MIN_LEVEL)), F.lit(MAX_LEVEL))
    own = intervals.where(F.col(low) < F.col(high)).withColumn("_level", level)
    bin_of = lambda c, lv: F.floor(c.cast("double") / F.pow(F.lit(2.0), lv)).cast("bigint")
    keyed = own.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(low), F.col("_level")), bin_of(F.col(high), F.col("_level")))))
    levels = [r[0] for r in own.select("_level").distinct().collect()]       # at most 103 numbers
    if not levels:
        return values.join(intervals, F.lit(False))
    points = values.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]))) \
        .withColumn("_bin", bin_of(F.col(value), F.col("_level")))
    return points.join(keyed, ["_level", "_bin"]) \
        .where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_level", "_bin")


def range_totals(values: DataFrame, intervals: DataFrame, value: str, low: str, high: str, sums: dict) -> DataFrame:
    """``intervals`` that hold a value (low <= value < high), with ``n_values`` and the sums of the
    values' columns in ``sums`` (name -> exact number column; null if none is known).

    The pairs grow with both sides, totals need none: the values and the intervals' borders are
    sorted in one range partitioning, running totals make every border's total of the values
    below it, and an interval's totals are the difference of its borders'."""
    spark, path = values.sparkSession, scratch_path(values.sparkSession, "range-totals")
    points = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_x")).agg(
        F.count(F.lit(1)).alias("_n"), *[a for k, c in sums.items() for a in (F.sum(c).alias(k), F.count(c).alias(f"_n_{k}"))])
    cols = points.columns[1:]
    own = intervals.where(F.col(low) < F.col(high))
    borders = own.select(F.explode(F.array(low, high)).alias("_x")).distinct()
    rows = points.withColumn("_kind", F.lit(1)).unionByName(borders.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    rows.repartitionByRange("_x", "_kind").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    within = Window.partitionBy("_part").orderBy("_x", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)          # one row a partition
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(c) for c in cols]) \
        .select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in cols])
    total = {c: F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in cols}
    below = rows.select("_part", "_x", "_kind", *total.values()).where("_kind = 0").join(parts, "_part") \
        .select("_x", *[(F.col(c) + F.col(f"_before_{c}")).alias(c) for c in cols])
    at = lambda border, name: below.select(F.col("_x").alias(f"_{name}"), F.struct(*cols).alias(name))
    j = own.join(at(low, "_lo"), F.col(low) == F.col("__lo")).join(at(high, "_hi"), F.col(high) == F.col("__hi"))
    part = lambda c: F.col(f"_hi.{c}") - F.col(f"_lo.{c}")
    kind = {k: points.schema[k].dataType for k in sums}
    return j.where(part("_n") > 0).select(*intervals.columns, part("_n").alias("n_values"),
                                          *[F.when(part(f"_n_{k}") > 0, part(k).cast(kind[k])).alias(k) for k in sums])
