"""Quality scoring: four dimension scores and a weighted overall per dataset.

Scoring is one plan over three keyed tables (datasets, resources, checks): the
resource side is reduced to one row per dataset with partial (map-side)
aggregation before it meets the dataset side, so no dataset ever collects its
resources into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions.columns import (blank_to_null, epoch_micros, format_key, format_score,
                                       freshness_lambda, js_trim, round3,
                                       score_level, status_score, weighted_sum)

DAY_SECONDS = 86400.0


def latest_status(checks: DataFrame) -> DataFrame:
    """Latest observed check per (catalog_id, url); later event wins a tie."""
    order = F.struct("checked_at", "event_id")
    return (checks.groupBy("catalog_id", "url")
            .agg(F.max_by(F.struct("status", "latency_ms", "checked_at"), order).alias("c"))
            .select("catalog_id", "url", "c.status", "c.latency_ms", "c.checked_at"))


def resource_facts(resources: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per resource with its format score and latest status score."""
    latest = latest_status(checks)
    return (resources.join(latest, ["catalog_id", "url"], "left")
            .select("dataset_id", "catalog_id", "i", "url", "format", "size_bytes",
                    "status", "latency_ms",
                    format_score(F.coalesce(F.when(F.col("format") != "", F.col("format")),
                                            F.lit("unknown"))).alias("format_score"),
                    format_key(F.col("format")).alias("format_key"),
                    status_score(F.col("status")).alias("access_score")))


def resource_rollup(facts: DataFrame) -> DataFrame:
    """Per dataset: resource count, accessibility parts, best format, distinct formats."""
    return (facts.groupBy("dataset_id")
            .agg(F.count(F.lit(1)).alias("resource_count"),
                 F.sum("access_score").alias("access_sum"),
                 F.sum(F.when(F.col("access_score") >= L.ACCESSIBLE_MIN_SCORE, 1).otherwise(0))
                  .alias("accessible"),
                 F.max("format_score").alias("best_format_score"),
                 # first resource (lowest position) with the best score wins a tie
                 F.max_by("format_key", F.struct(F.col("format_score"), -F.col("i")))
                  .alias("best_format"),
                 F.array_sort(F.collect_set("format_key")).alias("formats")))


def completeness_score(d: DataFrame, resource_count: Column) -> Column:
    desc_len = F.length(js_trim(F.col("description")))
    present = {
        "title": blank_to_null(F.col("title")).isNotNull(),
        "description": blank_to_null(F.col("description")).isNotNull(),
        "organization": blank_to_null(F.col("organization")).isNotNull(),
        "tags": F.coalesce(F.size("tags"), F.lit(0)) > 0,
        "license": blank_to_null(F.col("license")).isNotNull(),
        "resources": resource_count > 0,
        "modifiedAt": F.col("modified_at").isNotNull(),
        "createdAt": F.col("created_at").isNotNull(),
    }
    parts = []
    for name, w in L.COMPLETENESS_WEIGHTS:
        if name == "description":
            part = F.when(~present[name], F.lit(0.0)).when(desc_len >= L.MIN_DESCRIPTION_LENGTH, F.lit(w)) \
                .otherwise(F.lit(w / 2))
        else:
            part = F.when(present[name], F.lit(w)).otherwise(F.lit(0.0))
        parts.append(part)
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return round3(total), present


def fields_lists(present: dict) -> tuple[Column, Column]:
    names = [n for n, _ in L.COMPLETENESS_WEIGHTS]
    have = F.array_compact(F.array(*[F.when(present[n], F.lit(n)) for n in names]))
    miss = F.array_compact(F.array(*[F.when(~present[n], F.lit(n)) for n in names]))
    return have, miss


def days_since(as_of: str, ts: Column) -> Column:
    raw = (epoch_micros(F.lit(as_of).cast("timestamp")) - epoch_micros(ts)) / (DAY_SECONDS * 1e6)
    return F.greatest(F.lit(0.0), raw)


def freshness_score(as_of: str, modified_at: Column,
                    half_life_days: float = L.FRESHNESS_HALF_LIFE_DAYS) -> Column:
    days = days_since(as_of, modified_at)
    raw = F.exp(F.lit(-freshness_lambda(half_life_days)) * days)
    return F.when(modified_at.isNull(), F.lit(0.0)).otherwise(round3(F.least(F.lit(1.0), raw)))


def overall_score(cols: dict) -> Column:
    """Weighted sum in the fixed dimension order; a missing dimension adds 0."""
    pairs = [(F.coalesce(cols[d], F.lit(0.0)), L.QUALITY_WEIGHTS[d]) for d in L.OVERALL_ORDER]
    return round3(weighted_sum(pairs))


def score_datasets(datasets: DataFrame, resources: DataFrame, checks: DataFrame,
                   as_of: str, half_life_days: float = L.FRESHNESS_HALF_LIFE_DAYS) -> DataFrame:
    """Wide score table: one row per dataset with the four dimensions and overall."""
    rollup = resource_rollup(resource_facts(resources, checks))
    d = datasets.join(rollup, datasets["id"] == rollup["dataset_id"], "left")
    n_res = F.coalesce(F.col("resource_count"), F.lit(0))
    comp, present = completeness_score(d, n_res)
    have, miss = fields_lists(present)
    acc = F.when(n_res > 0, round3(F.col("access_sum") / n_res)).otherwise(F.lit(0.0))
    struct_ = F.coalesce(F.col("best_format_score"), F.lit(0.0))
    fresh = freshness_score(as_of, F.col("modified_at"), half_life_days)
    days = F.when(F.col("modified_at").isNotNull(),
                  F.floor(days_since(as_of, F.col("modified_at")) + 0.5).cast("bigint"))
    scored = d.select(
        "id", "catalog_id", "external_id", "title", "organization", "modified_at",
        acc.alias("accessibility"), struct_.alias("structure"), fresh.alias("freshness"),
        comp.alias("completeness"),
        n_res.cast("bigint").alias("resource_count"),
        n_res.cast("bigint").alias("checked"),
        F.coalesce(F.col("accessible"), F.lit(0)).cast("bigint").alias("accessible"),
        F.col("best_format"),
        F.coalesce(F.col("formats"), F.array().cast("array<string>")).alias("formats"),
        days.alias("days_since_modified"),
        F.length(js_trim(F.col("description"))).cast("bigint").alias("description_length"),
        F.coalesce(F.size("tags"), F.lit(0)).cast("bigint").alias("tag_count"),
        have.alias("fields_present"), miss.alias("fields_missing"),
    )
    dims = {c: F.col(c) for c in ("accessibility", "structure", "freshness", "completeness")}
    return scored.withColumn("overall", overall_score(dims))


def with_level(df: DataFrame, score_col: str = "overall") -> DataFrame:
    return df.withColumn("level", score_level(F.col(score_col))) \
             .withColumn("percent", F.floor(F.col(score_col) * 100 + 0.5).cast("bigint"))


def bounds_check(df: DataFrame) -> DataFrame:
    """Validate score rows: dimension in the enum and score a number in 0..1."""
    ok_dim = F.col("dimension").isin(*L.DIMENSIONS)
    ok_score = F.col("score").isNotNull() & (F.col("score") >= 0) & (F.col("score") <= 1) \
        & ~F.isnan(F.col("score"))
    reason = (F.when(~ok_dim | F.col("dimension").isNull(), F.lit("unknown_dimension"))
              .when(F.col("score").isNull() | F.isnan(F.col("score")), F.lit("bad_type"))
              .when(~ok_score, F.lit("out_of_range")))
    return df.withColumn("reject_reason", reason) \
             .withColumn("valid", F.col("reject_reason").isNull())
