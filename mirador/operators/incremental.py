"""Incremental scoring runs: diff against the previous run, merge, fallbacks,
failure streaks, cursor sweeps and run totals.

Everything is keyed by catalog (and dataset) so all catalogs are processed by
one plan; the sequential per-catalog loop of a single-process runner becomes
grouping by ``catalog_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions.columns import avg3, epoch_micros, int_div, round3, thousandths, weighted_sum
from mirador.operators.numbering import numbered

DAY_US = 86_400 * 1_000_000


def _age_us(as_of: str, ts):
    return epoch_micros(F.lit(as_of).cast("timestamp")) - epoch_micros(ts)


# ------------------------------------------------------------------ diff / merge
def diff_runs(current: DataFrame, previous: DataFrame, as_of: str,
              rescore_days: int = L.RESCORE_DAYS) -> DataFrame:
    """Classify by (catalog_id, external_id): new / modified / expired / kept / deleted.

    ``current``: catalog_id, external_id, modified_at; ``previous``: catalog_id,
    external_id, prev_modified_at, last_scored_at and, if kept scores are carried
    on, prev_overall. Precedence in that order.
    """
    keys = ["catalog_id", "external_id"]
    prev_overall = (F.col("prev_overall") if "prev_overall" in previous.columns
                    else F.lit(None).cast("double").alias("prev_overall"))
    j = current.select(*keys, "modified_at", F.lit(True).alias("_cur")).join(
        previous.select(*keys, "prev_modified_at", "last_scored_at", prev_overall, F.lit(True).alias("_prev")), keys, "full")
    modified = (F.col("modified_at").isNotNull() & F.col("prev_modified_at").isNotNull()
                & (F.col("modified_at") > F.col("prev_modified_at")))
    expired = _age_us(as_of, F.col("last_scored_at")) > rescore_days * DAY_US
    status = (F.when(F.col("_prev").isNull(), F.lit("new"))
              .when(F.col("_cur").isNull(), F.lit("deleted"))
              .when(modified, F.lit("modified"))
              .when(expired, F.lit("expired"))
              .otherwise(F.lit("kept")))
    return j.select(*keys, "modified_at", "prev_modified_at", "last_scored_at", "prev_overall", status.alias("status"))


def merge_scores(diff: DataFrame, scored: DataFrame, as_of: str) -> DataFrame:
    """Kept entries stay as they were, score included; new, modified and expired get this run's
    scores and as_of as their scoring time; deleted ones drop out."""
    keep = diff.where(F.col("status") == "kept").select(
        "catalog_id", "external_id", F.col("prev_modified_at").alias("modified_at"), "last_scored_at",
        F.lit("kept").alias("origin"), F.col("prev_overall").alias("overall"))
    redo = diff.where(F.col("status").isin("new", "modified", "expired")).join(
        scored.select("catalog_id", "external_id", "overall"), ["catalog_id", "external_id"], "left")
    redo = redo.select("catalog_id", "external_id", "modified_at",
                       F.lit(as_of).cast("timestamp").alias("last_scored_at"),
                       F.lit("scored").alias("origin"), "overall")
    return keep.unionByName(redo)


def orphan_cleanup(stored: DataFrame, active: DataFrame) -> DataFrame:
    """Stored catalogs that are not in the active set (to be removed)."""
    return stored.select("catalog_id").distinct().join(
        active.select(F.col("id").alias("catalog_id")), "catalog_id", "left_anti")


# A summary row's fields and what a catalog without any summary holds in them.
SUMMARY_ZERO = {"status": "pending", "dataset_count": 0, "resource_count": 0, "datasets_scored": 0, "overall": 0.0,
                "accessibility": 0.0, "structure": 0.0, "freshness": 0.0, "completeness": 0.0, "usability": 0.0,
                "accessible_pct": 0.0, "median_freshness_days": None, "top_formats": [], "coverage": 0.0, "tier": "detail",
                "scored_at": None}


def summary_fallback(catalogs: DataFrame, current: DataFrame, previous: DataFrame, as_of: str) -> DataFrame:
    """Every catalog with its own columns (name, country, protocol, language): this run's summary,
    else the last known one unchanged (its stored status and time included), else a zero
    'pending' row of now. Both summaries hold catalog_id and the fields of ``SUMMARY_ZERO``; the
    tier of a pending catalog is the directory's, if it has one."""
    fields = list(SUMMARY_ZERO)
    one = lambda df, name, key: df.select(F.col("catalog_id").alias(key), F.struct(*fields).alias(name))
    own = [c for c in catalogs.columns if c not in fields]
    j = catalogs.alias("c").join(one(current, "cur", "_c"), F.col("c.id") == F.col("_c"), "left") \
        .join(one(previous, "prev", "_p"), F.col("c.id") == F.col("_p"), "left")
    types = dict(current.dtypes)
    zeros = {f: F.array() if z == [] else F.lit(z) for f, z in SUMMARY_ZERO.items()}
    zeros["scored_at"] = F.lit(as_of).cast("timestamp")
    if "tier" in catalogs.columns:
        zeros["tier"] = F.col("c.tier")
    chosen = [F.when(F.col("_c").isNotNull(), F.col(f"cur.{f}")).when(F.col("_p").isNotNull(), F.col(f"prev.{f}"))
              .otherwise(zeros[f].cast(types[f])).cast(types[f]).alias(f) for f in fields]
    return j.select(*[F.col(f"c.{c}") for c in own], *chosen)


# ------------------------------------------------------------------ failures
def failure_streak(outcomes: DataFrame, key: str, as_of: str) -> DataFrame:
    """Final failure state per key from an outcome log (ts, event_id, failed).

    Consecutive failures = failures after the key's last success; the state is
    unreachable from 3 on, and an unreachable key is skipped while its last
    failure is less than 7 days old. A success also clears the last failure. Computed with two partial aggregates (the
    last success per key, then the failures after it), so a hot key is merged
    from per-partition buffers instead of being sorted in one task.
    """
    order = F.struct("ts", "event_id")
    last_ok = (outcomes.where(~F.col("failed")).groupBy(key)
               .agg(F.max(order).alias("last_ok")))
    j = outcomes.join(last_ok, key, "left")
    after = F.col("last_ok").isNull() | (order > F.col("last_ok"))
    agg = j.groupBy(key).agg(
        F.sum(F.when(F.col("failed") & after, 1).otherwise(0)).cast("bigint").alias("consecutive_failures"),
        F.max(F.when(F.col("failed") & after, F.col("ts"))).alias("last_failure"),
        F.count(F.lit(1)).alias("events"))
    status = F.when(F.col("consecutive_failures") >= L.UNREACHABLE_AFTER_FAILURES, F.lit("unreachable")) \
        .otherwise(F.lit("ok"))
    days = _age_us(as_of, F.col("last_failure")) / DAY_US
    skip = (status == "unreachable") & (days < L.RETRY_AFTER_DAYS)
    return agg.select(key, "consecutive_failures", status.alias("status"), "last_failure",
                      skip.alias("skip"), F.col("events").cast("bigint").alias("events"))


# ------------------------------------------------------------------ cursor sweeps
def sweep_plan(catalogs: DataFrame, state: DataFrame, as_of: str,
               rescore_days: int = L.RESCORE_DAYS, known: DataFrame | None = None) -> DataFrame:
    """Per catalog: skip (fresh complete sweep), restart (old complete sweep),
    resume (incomplete) or fresh (no state); start cursor and carried counts.

    ``known`` (catalog_id, known_count) is what the source reports as its number
    of records; it is used only while the stored total is unknown (0)."""
    j = catalogs.select(F.col("id").alias("catalog_id")).join(state, "catalog_id", "left")
    if known is not None:
        j = j.join(known, "catalog_id", "left")
    else:
        j = j.withColumn("known_count", F.lit(None).cast("bigint"))
    has = F.col("complete").isNotNull()
    young = _age_us(as_of, F.col("last_complete_sweep")) < rescore_days * DAY_US
    action = (F.when(~has, F.lit("fresh"))
              .when(F.col("complete") & F.col("last_complete_sweep").isNotNull() & young, F.lit("skip"))
              .when(F.col("complete") & F.col("last_complete_sweep").isNotNull(), F.lit("restart"))
              .when(~F.col("complete"), F.lit("resume"))
              .otherwise(F.lit("fresh")))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    cursor = (F.when(action == "resume", F.coalesce(F.col("cursor"), epoch))
              .when(action == "restart", F.col("last_complete_sweep"))
              .when(action == "skip", F.col("cursor"))
              .otherwise(epoch))
    carried = F.when(action.isin("resume", "skip"), F.col("processed_count")).otherwise(F.lit(0))
    return j.select("catalog_id", action.alias("action"), cursor.alias("start_cursor"),
                    carried.cast("bigint").alias("carried_processed"),
                    F.when(F.coalesce(F.col("total_known"), F.lit(0)) == 0,
                           F.coalesce(F.col("known_count"), F.lit(0)))
                     .otherwise(F.col("total_known")).cast("bigint").alias("total_known"),
                    F.col("complete").alias("was_complete"), "last_complete_sweep", "cursor")


def sweep_chunk(scores: DataFrame, plan: DataFrame, chunk_size: int = L.SWEEP_CHUNK_SIZE,
                every: int = L.SWEEP_ACCESS_EVERY, keep_undated: Column | bool = False) -> DataFrame:
    """Records of one sweep run per catalog: modified >= cursor (inclusive), and where
    ``keep_undated`` holds (the Socrata path) those without a date, which sort last; the
    first ``chunk_size`` in (modified, id) order; accessibility only for every
    ``every``-th record. The row_number filter is planned with a per-partition
    limit before the shuffle, so a hot catalog contributes at most
    ``chunk_size`` rows per partition. Without a chunk size (0) all records are numbered, by
    range partitions with counted offsets, so a hot catalog is no single task's."""
    keep = keep_undated if isinstance(keep_undated, Column) else F.lit(bool(keep_undated))
    p = plan.where(F.col("action") != "skip").select("catalog_id", "start_cursor")
    cand = scores.join(p, "catalog_id") \
                 .where((F.col("modified_at") >= F.col("start_cursor")) | (F.col("modified_at").isNull() & keep))
    order = [F.col("modified_at").asc_nulls_last(), F.col("id")]
    if chunk_size > 0:
        # a filter on the rank column itself lets Spark limit each partition first
        ranked = cand.withColumn("rn", F.row_number().over(Window.partitionBy("catalog_id").orderBy(*order))) \
            .where(F.col("rn") <= chunk_size)
    else:
        ranked = numbered(cand, ["catalog_id"], order)
    return ranked.withColumn("idx", F.col("rn") - 1).drop("rn") \
                 .withColumn("with_access", (F.col("idx") % every) == 0)


def sweep_partials(chunk: DataFrame) -> DataFrame:
    """Per (catalog, dimension): sum (exact, in thousandths) and count of this chunk."""
    dims = F.array(
        F.struct(F.lit("completeness").alias("dimension"), F.col("completeness").alias("score")),
        F.struct(F.lit("freshness").alias("dimension"), F.col("freshness").alias("score")),
        F.struct(F.lit("structure").alias("dimension"), F.col("structure").alias("score")),
        F.when(F.col("with_access"),
               F.struct(F.lit("accessibility").alias("dimension"), F.col("accessibility").alias("score"))))
    long = chunk.select("catalog_id", F.explode(F.array_compact(dims)).alias("d"))
    return long.groupBy("catalog_id", F.col("d.dimension").alias("dimension")).agg(
        F.sum(thousandths(F.col("d.score"))).alias("sum_milli"), F.count(F.lit(1)).alias("count"))


def sweep_state(plan: DataFrame, chunk: DataFrame, chunk_size: int, as_of: str | None = None) -> DataFrame:
    """New state per catalog after this run (skipped catalogs keep theirs), as the next run's
    ``sweep_plan`` reads it; a sweep that ends now (``as_of``) is the last complete one."""
    run = chunk.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("chunk_count"),
                                          F.max("modified_at").alias("max_modified"))
    j = plan.join(run, "catalog_id", "left")
    cc = F.coalesce(F.col("chunk_count"), F.lit(0))
    processed = F.col("carried_processed") + cc
    complete = F.lit(chunk_size == 0) | (cc < chunk_size)
    skip = F.col("action") == "skip"
    total = F.when(~skip & complete & (processed > F.col("total_known")), processed) \
        .otherwise(F.col("total_known"))
    cov = F.when(total > 0, F.least(F.lit(1.0), processed / total)).otherwise(F.lit(0.0))
    new_cursor = F.greatest(F.col("start_cursor"), F.coalesce(F.col("max_modified"), F.col("start_cursor")))
    return j.select(
        "catalog_id", "action",
        F.when(skip, F.col("carried_processed")).otherwise(processed).cast("bigint").alias("processed_count"),
        total.cast("bigint").alias("total_known"),
        F.when(skip, F.col("was_complete")).otherwise(complete).alias("complete"),
        F.when(skip, F.col("cursor")).otherwise(new_cursor).alias("cursor"),
        F.when(~skip & complete, F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp())
         .otherwise(F.col("last_complete_sweep")).alias("last_complete_sweep"),
        round3(cov).alias("coverage"), cc.cast("bigint").alias("chunk_count"))


def sweep_aggregates(plan: DataFrame, partials: DataFrame, old_aggs: DataFrame) -> DataFrame:
    """Running {sum, count} per (catalog, dimension): resumed and skipped catalogs
    add to their stored sums; restarted and fresh ones start from zero."""
    carry = old_aggs.join(plan.where(F.col("action").isin("resume", "skip")).select("catalog_id"),
                          "catalog_id", "left_semi")
    both = carry.select("catalog_id", "dimension", "sum_milli", "count") \
        .unionByName(partials.select("catalog_id", "dimension", "sum_milli", "count"))
    return both.groupBy("catalog_id", "dimension").agg(
        F.sum("sum_milli").cast("bigint").alias("sum_milli"), F.sum("count").cast("bigint").alias("count"))


def sweep_summary(state: DataFrame, aggs: DataFrame) -> DataFrame:
    """Means from running sums (3 decimals, half up, exact), overall from the means,
    dataset count = max(total known, processed)."""
    means = aggs.select("catalog_id", "dimension",
                        F.when(F.col("count") > 0,
                               int_div(F.col("sum_milli") * 2 + F.col("count"), F.col("count") * 2) / 1000.0)
                        .otherwise(F.lit(0.0)).alias("mean"))
    wide = means.groupBy("catalog_id").pivot("dimension", ["accessibility", "structure", "freshness",
                                                           "completeness"]).agg(F.first("mean"))
    s = state.join(wide, "catalog_id", "left")
    dims = {d: F.coalesce(F.col(d), F.lit(0.0)) for d in ("accessibility", "structure", "freshness", "completeness")}
    overall = round3(weighted_sum([(dims[d], L.QUALITY_WEIGHTS[d]) for d in L.OVERALL_ORDER]))
    return s.select("catalog_id",
                    F.greatest("total_known", "processed_count").cast("bigint").alias("dataset_count"),
                    *[dims[d].alias(d) for d in ("accessibility", "structure", "freshness", "completeness")],
                    overall.alias("overall"), "coverage", F.col("processed_count").alias("datasets_scored"))


# ------------------------------------------------------------------ run totals
def run_summary(index: DataFrame) -> DataFrame:
    """Totals of a run: datasets, resources, processed, skipped, failed, and the
    mean coverage of the aggregate tier (3 decimals)."""
    agg_tier = F.col("tier") == "aggregate"
    return index.agg(
        F.sum("dataset_count").cast("bigint").alias("total_datasets"),
        F.sum("resource_count").cast("bigint").alias("total_resources"),
        F.sum(F.when(F.col("run_status") == "processed", 1).otherwise(0)).cast("bigint").alias("processed"),
        F.sum(F.when(F.col("run_status") == "skipped", 1).otherwise(0)).cast("bigint").alias("skipped"),
        F.sum(F.when(F.col("run_status") == "failed", 1).otherwise(0)).cast("bigint").alias("failed"),
        F.coalesce(avg3(F.when(agg_tier, F.col("coverage"))), F.lit(0.0)).alias("aggregate_coverage"))


# ------------------------------------------------------------------ directory
def preset_resolve(presets: DataFrame, catalogs: DataFrame, preset_names: list[str],
                   catalog_ids: list[str], default_id: str) -> tuple[DataFrame, DataFrame]:
    """Preset names, then explicit ids -> distinct catalogs in first-seen order.

    Returns (resolved, unknown). ``presets`` holds (preset, catalog_id, member_pos).
    The request is a parameter list, exploded with its positions; members come
    from a broadcast join on the (small) preset table.
    """
    spark = presets.sparkSession
    req = [(i, "preset", n) for i, n in enumerate(preset_names)] + \
          [(len(preset_names) + i, "catalog", c) for i, c in enumerate(catalog_ids)]
    r = spark.createDataFrame(req or [(0, "none", "")], "req_pos int, kind string, name string")
    known_p = presets.select("preset").distinct().withColumn("_ok", F.lit(True))
    known_c = catalogs.select(F.col("id").alias("name")).withColumn("_ok", F.lit(True))
    unknown = (r.where(F.col("kind") == "preset").join(known_p, r["name"] == known_p["preset"], "left_anti")
               .unionByName(r.where(F.col("kind") == "catalog").join(known_c, "name", "left_anti")))
    from_p = r.where(F.col("kind") == "preset").join(presets, r["name"] == presets["preset"]) \
        .join(catalogs.select(F.col("id").alias("catalog_id")), "catalog_id", "left_semi") \
        .select("catalog_id", "req_pos", "member_pos")
    from_c = r.where(F.col("kind") == "catalog").select(F.col("name").alias("catalog_id"), "req_pos",
                                                        F.lit(0).alias("member_pos"))
    allc = from_p.unionByName(from_c)
    w = Window.partitionBy("catalog_id").orderBy("req_pos", "member_pos")
    first = allc.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    order = Window.orderBy("req_pos", "member_pos")
    resolved = first.select("catalog_id", F.row_number().over(order).alias("position"))
    if not req:
        resolved = spark.createDataFrame([(default_id, 1)], "catalog_id string, position int")
    return resolved, unknown


def catalog_counts(catalogs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Catalog list with its number of records, zero included."""
    n = datasets.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n"))
    return catalogs.join(n, catalogs["id"] == n["catalog_id"], "left") \
        .select("id", "name", "country", F.coalesce("n", F.lit(0)).cast("bigint").alias("dataset_count"))
