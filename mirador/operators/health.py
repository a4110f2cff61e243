"""Resource health: latest fresh observation per URL, what to check next, and
per-dataset annotations and reports. All keyed joins on (catalog, url) or url;
latest-per-key uses ``max_by`` (a partial aggregate), not a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions.columns import epoch_micros


def latest_health(checks: DataFrame) -> DataFrame:
    """One observation per (catalog, url): the last written (latest check, then event id)."""
    order = F.struct("checked_at", "event_id")
    return (checks.groupBy("catalog_id", "url")
            .agg(F.max_by(F.struct("status", "latency_ms", "checked_at", "event_id"), order).alias("h"))
            .select("catalog_id", "url", "h.status", "h.latency_ms", "h.checked_at", "h.event_id"))


def is_fresh(checked_at, as_of: str, ttl_hours: float = L.HEALTH_TTL_HOURS):
    age_us = epoch_micros(F.lit(as_of).cast("timestamp")) - epoch_micros(checked_at)
    return age_us <= int(ttl_hours * 3600 * 1_000_000)


def health_latest_fresh(checks: DataFrame, as_of: str, ttl_hours: float = L.HEALTH_TTL_HOURS) -> DataFrame:
    """Latest result per (catalog, url) that is not older than the TTL (stale ones purged)."""
    latest = latest_health(checks)
    return latest.where(is_fresh(F.col("checked_at"), as_of, ttl_hours))


def health_to_check(resources: DataFrame, fresh: DataFrame) -> DataFrame:
    """Resources whose URL has no fresh result (an anti join)."""
    return resources.join(fresh.select("catalog_id", "url"), ["catalog_id", "url"], "left_anti")


def status_ok(status):
    return (status >= L.HEALTH_OK_MIN) & (status <= L.HEALTH_OK_MAX)


def health_annotate(resources: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per dataset: resources with a fresh result (merged by URL over catalogs),
    how many are OK, and the tag: all OK, none OK, or k/n."""
    by_url = fresh.groupBy("url").agg(F.max_by("status", F.struct("checked_at", "event_id")).alias("status"))
    j = resources.join(by_url, "url", "left")
    agg = j.groupBy("dataset_id").agg(
        F.count("status").alias("checked"),
        F.sum(F.when(status_ok(F.col("status")), 1).otherwise(0)).alias("ok"))
    tag = (F.when(F.col("checked") == 0, F.lit(None))
           .when(F.col("ok") == F.col("checked"), F.lit("Accesible"))
           .when(F.col("ok") == 0, F.lit("Inaccesible"))
           .otherwise(F.concat(F.col("ok").cast("string"), F.lit("/"), F.col("checked").cast("string"),
                               F.lit(" accesibles"))))
    return agg.select(F.col("dataset_id").alias("id"), F.col("checked").cast("bigint").alias("checked"),
                      F.col("ok").cast("bigint").alias("ok"), tag.alias("tag"))


def health_report(resources: DataFrame, fresh: DataFrame) -> DataFrame:
    """Each resource with a fresh result: OK/FALLA, size, latency; per-dataset totals."""
    j = resources.join(fresh.select("catalog_id", "url", "status", "latency_ms"), ["catalog_id", "url"])
    rows = j.select("dataset_id", "url", F.coalesce(F.when(F.col("format") != "", F.col("format")), F.lit("?"))
                    .alias("format"), "size_bytes", "status", "latency_ms",
                    F.when(status_ok(F.col("status")), F.lit("OK")).otherwise(F.lit("FALLA")).alias("verdict"))
    totals = rows.groupBy("dataset_id").agg(
        F.sum(F.when(F.col("verdict") == "OK", 1).otherwise(0)).cast("bigint").alias("accessible"),
        F.sum(F.when(F.col("verdict") == "FALLA", 1).otherwise(0)).cast("bigint").alias("failed"))
    return rows.join(totals, "dataset_id")
