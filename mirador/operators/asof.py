"""As-of join: for each left row, the latest right row with the same key at or
before its time.

Spark has no ASOF syntax. A plain window over the key would put a hot key (one
user with a third of all events) into one task, so the work is split by time
bucket: matches inside a (key, bucket) come from a window over that bucket;
rows with no earlier match in their bucket take the last right row of earlier
buckets, found from a per-(key, bucket) summary that is tiny (one row per key
per bucket), then joined back on (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str,
              right_cols: list[str], bucket: str = "hour") -> DataFrame:
    """Left rows with the right columns of the last right row with right.ts <= left.ts.

    Ties on ts: a right row at the same instant counts as "before". Among right
    rows with equal ts the one with the larger struct of ``right_cols`` wins.
    Output right columns are prefixed ``r_``.
    """
    rcols = ["_rts"] + right_cols
    l = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast("timestamp").alias("_rts"),
                    *[F.lit(None).cast(right.schema[c].dataType).alias("_r_" + c) for c in right_cols])
    r = right.select(F.col(key), F.col(ts), F.lit(0).alias("_side"), F.col(ts).alias("_rts"),
                     *[F.col(c).alias("_r_" + c) for c in right_cols])
    # align columns: right rows carry nulls for the left-only columns
    left_only = [c for c in left.columns if c not in (key, ts)]
    for c in left_only:
        r = r.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    cols = [key, ts] + left_only + ["_side", "_rts"] + ["_r_" + c for c in right_cols]
    u = l.select(*cols).unionByName(r.select(*cols))
    u = u.withColumn("_bucket", F.date_trunc(bucket, F.col(ts)))
    payload = F.struct(*[F.col(c if c == "_rts" else "_r_" + c).alias(c) for c in rcols])
    u = u.withColumn("_payload", F.when(F.col("_side") == 0, payload))

    # 1) in-bucket: last right payload at or before each row (right sorts first on ties)
    w = (Window.partitionBy(key, "_bucket")
         .orderBy(F.col(ts), F.col("_side"), F.col("_payload"))
         .rowsBetween(Window.unboundedPreceding, 0))
    u = u.withColumn("_in", F.last("_payload", ignorenulls=True).over(w))

    # 2) carry from earlier buckets: one summary row per (key, bucket) holding the
    #    bucket's last right row (null if none), then the latest non-null summary
    #    strictly before each bucket. A hot key has one summary row per bucket.
    summary = (u.groupBy(key, "_bucket")
               .agg(F.max(F.when(F.col("_side") == 0,
                                 F.struct(F.col(ts).alias("t"), F.col("_payload").alias("p")))).alias("_m")))
    wb = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cand = summary.withColumn("_c", F.last("_m", ignorenulls=True).over(wb)) \
                  .select(key, "_bucket", F.col("_c.p").alias("_carry"))
    out = (u.where(F.col("_side") == 1)
           .join(cand, [key, "_bucket"], "left")
           .withColumn("_match", F.coalesce(F.col("_in"), F.col("_carry"))))
    return out.select(*left.columns, *[F.col("_match." + c).alias("r_" + c.lstrip("_")) for c in rcols])
