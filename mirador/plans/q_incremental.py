"""Health joins, directory operators and the incremental pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirador.fixtures import AS_OF, EVENTS_AS_OF, register_views
from mirador.functions import columns
from mirador.functions import lookups as L
from mirador.operators import health, incremental, ranking, search, summary
from mirador.plans import pipeline
from mirador.plans.oracles import oracle
from mirador.plans.registry import query
from mirador.plans.sqlparts import SCORES_CTES, SUMMARY_CTES, avg3, dbl, r3
from mirador.session import scratch_path
from mirador.sources import records, stores

NEXT_AS_OF = "2026-01-05 00:00:00"       # the run after AS_OF's
HEALTH_TS = f"TIMESTAMP '{EVENTS_AS_OF}'"
TTL_US = L.HEALTH_TTL_HOURS * 3600 * 1_000_000

FRESH_SQL = f"""lh AS (SELECT catalog_id, url, status, latency_ms, checked_at, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY catalog_id, url ORDER BY checked_at DESC, event_id DESC) AS rn FROM v_checks) WHERE rn = 1),
fresh AS (SELECT * FROM lh WHERE epoch_us({HEALTH_TS}) - epoch_us(checked_at) <= {TTL_US})"""


def fresh_health(spark, sf):
    return health.health_latest_fresh(records.checks(spark, sf), EVENTS_AS_OF)


@query("health_latest_fresh")
def q_health_latest_fresh(spark, sf):
    return fresh_health(spark, sf).select("catalog_id", "url", "status", "latency_ms", "checked_at")


oracle("health_latest_fresh", f"WITH {FRESH_SQL}\nSELECT catalog_id, url, status, latency_ms, checked_at FROM fresh",
       "v_checks")


@query("health_to_check")
def q_health_to_check(spark, sf):
    return health.health_to_check(records.resources(spark, sf), fresh_health(spark, sf)) \
        .select("dataset_id", "catalog_id", "url")


oracle("health_to_check", f"""WITH {FRESH_SQL}
SELECT r.dataset_id, r.catalog_id, r.url FROM v_resources r
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.catalog_id = r.catalog_id AND f.url = r.url)""", "v_checks")


@query("health_annotate")
def q_health_annotate(spark, sf):
    return health.health_annotate(records.resources(spark, sf), fresh_health(spark, sf))


oracle("health_annotate", f"""WITH {FRESH_SQL},
bu AS (SELECT url, status FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY checked_at DESC, event_id DESC) AS rn FROM fresh) WHERE rn = 1),
a AS (SELECT r.dataset_id AS id, CAST(count(bu.status) AS BIGINT) AS checked,
  CAST(sum(CASE WHEN bu.status >= 200 AND bu.status <= 399 THEN 1 ELSE 0 END) AS BIGINT) AS ok
  FROM v_resources r LEFT JOIN bu ON r.url = bu.url GROUP BY r.dataset_id)
SELECT id, checked, ok, CASE WHEN checked = 0 THEN NULL WHEN ok = checked THEN 'Accesible' WHEN ok = 0 THEN 'Inaccesible'
  ELSE CAST(ok AS VARCHAR) || '/' || CAST(checked AS VARCHAR) || ' accesibles' END AS tag FROM a""", "v_checks")


@query("health_report")
def q_health_report(spark, sf):
    return health.health_report(records.resources(spark, sf), fresh_health(spark, sf))


oracle("health_report", f"""WITH {FRESH_SQL},
rows AS (SELECT r.dataset_id, r.url, coalesce(nullif(r.format, ''), '?') AS format, r.size_bytes, f.status, f.latency_ms,
  CASE WHEN f.status >= 200 AND f.status <= 399 THEN 'OK' ELSE 'FALLA' END AS verdict
  FROM v_resources r JOIN fresh f ON r.catalog_id = f.catalog_id AND r.url = f.url),
t AS (SELECT dataset_id, CAST(sum(CASE WHEN verdict = 'OK' THEN 1 ELSE 0 END) AS BIGINT) AS accessible,
  CAST(sum(CASE WHEN verdict = 'FALLA' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM rows GROUP BY dataset_id)
SELECT rows.*, t.accessible, t.failed FROM rows JOIN t ON rows.dataset_id = t.dataset_id""", "v_checks")


@query("catalog_counts")
def q_catalog_counts(spark, sf):
    return incremental.catalog_counts(records.catalogs(spark, sf), records.datasets(spark, sf))


oracle("catalog_counts", """SELECT c.id, c.name, c.country, CAST(count(d.id) AS BIGINT) AS dataset_count
FROM v_catalogs c LEFT JOIN v_datasets d ON d.catalog_id = c.id GROUP BY c.id, c.name, c.country""",
       "v_catalogs", "v_datasets")

# ------------------------------------------------------------------ directory
PRESET_REQ = (["europe", "america"], ["src3", "src0", "src24"])


@query("preset_resolve")
def q_preset_resolve(spark, sf):
    register_views(spark, sf, ("v_presets", "v_catalogs"))
    resolved, unknown = incremental.preset_resolve(spark.table("v_presets"), spark.table("v_catalogs"),
                                                   *PRESET_REQ, default_id="src0")
    if unknown.limit(1).count():
        raise ValueError("unknown preset or catalog in request")
    return resolved.select("catalog_id", F.col("position").cast("bigint").alias("position"))


_req_rows = [(i, "preset", n) for i, n in enumerate(PRESET_REQ[0])] + \
            [(len(PRESET_REQ[0]) + i, "catalog", c) for i, c in enumerate(PRESET_REQ[1])]
_req_sql = ", ".join(f"({i}, '{k}', '{n}')" for i, k, n in _req_rows)
oracle("preset_resolve", f"""WITH req AS (SELECT * FROM (VALUES {_req_sql}) t(req_pos, kind, name)),
m AS (SELECT p.catalog_id, req.req_pos, p.member_pos FROM req JOIN v_presets p ON req.kind = 'preset' AND req.name = p.preset
      WHERE p.catalog_id IN (SELECT id FROM v_catalogs)
      UNION ALL SELECT name, req_pos, 0 FROM req WHERE kind = 'catalog'),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY req_pos, member_pos) AS rn FROM m) WHERE rn = 1)
SELECT catalog_id, row_number() OVER (ORDER BY req_pos, member_pos) AS position FROM f""", "v_presets", "v_catalogs")

TIER_ARGS = (["america"], ["europe", "america", "all"])


@query("tier_classify")
def q_tier_classify(spark, sf):
    register_views(spark, sf, ("v_presets", "v_catalogs"))
    membership = spark.table("v_presets").join(
        spark.table("v_catalogs").select(F.col("id").alias("catalog_id")), "catalog_id", "left_semi")
    r = ranking.tier_classify(spark.table("v_catalogs"), membership, *TIER_ARGS)
    return r.select("id", "tier", F.col("run_order").cast("bigint").alias("run_order"))


_prio = " ".join(f"WHEN '{p}' THEN {i + 1}" for i, p in enumerate(TIER_ARGS[1]))
oracle("tier_classify", f"""WITH mem AS (SELECT * FROM v_presets WHERE catalog_id IN (SELECT id FROM v_catalogs)),
det AS (SELECT DISTINCT catalog_id FROM mem WHERE preset IN ({", ".join(repr(p) for p in TIER_ARGS[0])})),
pr AS (SELECT catalog_id, p, m FROM (SELECT catalog_id, CASE preset {_prio} END AS p, member_pos AS m,
   row_number() OVER (PARTITION BY catalog_id ORDER BY CASE preset {_prio} END, member_pos) AS rn
   FROM mem WHERE preset IN ({", ".join(repr(p) for p in TIER_ARGS[1])})) WHERE rn = 1),
c AS (SELECT v.id, v.pos, CASE WHEN det.catalog_id IS NOT NULL THEN 'detail' ELSE 'aggregate' END AS tier, pr.p, pr.m
  FROM v_catalogs v LEFT JOIN det ON v.id = det.catalog_id LEFT JOIN pr ON v.id = pr.catalog_id)
SELECT id, tier, row_number() OVER (ORDER BY CASE WHEN tier = 'detail' THEN 0 ELSE 1 END, p NULLS LAST, m NULLS LAST, pos) AS run_order FROM c""",
       "v_presets", "v_catalogs")

# ------------------------------------------------------------------ diff / merge / cleanup / fallback


def diff_inputs(spark, sf):
    register_views(spark, sf, ("v_datasets", "v_prev"))
    cur = spark.table("v_datasets").select("catalog_id", "external_id",
                                           F.col("modified_on").cast("timestamp").alias("modified_at"))
    prev = spark.table("v_prev").select("catalog_id", "external_id",
                                        F.col("modified_on").cast("timestamp").alias("prev_modified_at"),
                                        F.col("last_scored_on").cast("timestamp").alias("last_scored_at"),
                                        F.col("overall").alias("prev_overall"))
    return cur, prev


@query("diff_runs")
def q_diff_runs(spark, sf):
    cur, prev = diff_inputs(spark, sf)
    return incremental.diff_runs(cur, prev, AS_OF).select("catalog_id", "external_id", "status")


DIFF_SQL = f"""cur AS (SELECT catalog_id, external_id, CAST(modified_on AS TIMESTAMP) AS modified_at FROM v_datasets),
prev AS (SELECT catalog_id, external_id, CAST(modified_on AS TIMESTAMP) AS prev_modified_at,
  CAST(last_scored_on AS TIMESTAMP) AS last_scored_at, overall AS prev_overall FROM v_prev),
j AS (SELECT coalesce(c.catalog_id, p.catalog_id) AS catalog_id, coalesce(c.external_id, p.external_id) AS external_id,
  c.modified_at, p.prev_modified_at, p.last_scored_at, p.prev_overall, c.external_id IS NOT NULL AS in_cur, p.external_id IS NOT NULL AS in_prev
  FROM cur c FULL OUTER JOIN prev p ON c.catalog_id = p.catalog_id AND c.external_id = p.external_id),
diff AS (SELECT *, CASE WHEN NOT in_prev THEN 'new' WHEN NOT in_cur THEN 'deleted'
  WHEN modified_at IS NOT NULL AND prev_modified_at IS NOT NULL AND modified_at > prev_modified_at THEN 'modified'
  WHEN epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_scored_at) > {L.RESCORE_DAYS} * 86400000000 THEN 'expired'
  ELSE 'kept' END AS status FROM j)"""

oracle("diff_runs", f"WITH {DIFF_SQL}\nSELECT catalog_id, external_id, status FROM diff", "v_datasets", "v_prev")


@query("merge_scores")
def q_merge_scores(spark, sf):
    cur, prev = diff_inputs(spark, sf)
    diff = incremental.diff_runs(cur, prev, AS_OF)
    scored = pipeline.dataset_scores(spark, sf)
    return incremental.merge_scores(diff, scored, AS_OF)


oracle("merge_scores", f"""WITH {SCORES_CTES}, {DIFF_SQL}
SELECT catalog_id, external_id, prev_modified_at AS modified_at, last_scored_at, 'kept' AS origin, prev_overall AS overall
FROM diff WHERE status = 'kept'
UNION ALL SELECT d.catalog_id, d.external_id, d.modified_at, TIMESTAMP '{AS_OF}', 'scored', sc.overall
FROM diff d LEFT JOIN sc ON d.catalog_id = sc.catalog_id AND d.external_id = sc.external_id
WHERE d.status IN ('new', 'modified', 'expired')""", "v_datasets", "v_prev", "v_resources", "v_checks")


@query("orphan_cleanup")
def q_orphan_cleanup(spark, sf):
    """The previous run's entries in a store, before and after its orphans are removed."""
    register_views(spark, sf, ("v_prev", "v_catalogs"))
    active = spark.table("v_catalogs").where(F.col("pos") % 4 != 3)
    store = stores.CatalogStore(spark, scratch_path(spark, "entries"), "external_id string, overall double, catalog_id string", "external_id")
    store.save(spark.table("v_prev").select("external_id", "overall", "catalog_id"))
    stored = spark.createDataFrame([(c,) for c in store.catalogs()], "catalog_id string")
    listed = incremental.orphan_cleanup(stored, active).withColumn("orphan", F.lit(True))
    store.remove_orphans(active)
    left = store.load().groupBy("catalog_id").agg(F.count(F.lit(1)).alias("entries_left"))
    return stored.join(listed, "catalog_id", "left").join(left, "catalog_id", "left").select(
        "catalog_id", F.coalesce("orphan", F.lit(False)).alias("removed"), F.coalesce("entries_left", F.lit(0)).alias("entries_left"))


oracle("orphan_cleanup", """SELECT p.catalog_id, c.id IS NULL AS removed,
 CAST(sum(CASE WHEN c.id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS entries_left
FROM v_prev p LEFT JOIN (SELECT id FROM v_catalogs WHERE pos % 4 <> 3) c ON p.catalog_id = c.id
GROUP BY p.catalog_id, c.id""", "v_prev", "v_catalogs")


@query("summary_fallback")
def q_summary_fallback(spark, sf):
    register_views(spark, sf, ("v_prev", "v_catalogs"))
    tier = F.when(F.col("pos") % 2 == 0, F.lit("detail")).otherwise(F.lit("aggregate"))
    langs = spark.sql(search.CATALOG_LANG_SQL).select(F.col("catalog_id").alias("id"), "language")
    cats = spark.table("v_catalogs").join(langs, "id").select("id", "name", "country", "protocol", "language", "pos", tier.alias("tier"))
    known = cats.select(F.col("id").alias("catalog_id"), "tier", "pos")
    scores = pipeline.dataset_scores(spark, sf)
    formats = summary.top_formats(scores).groupBy("catalog_id") \
        .agg(F.array_sort(F.collect_list(F.struct("rank", "format"))).getField("format").alias("top_formats"))
    current = pipeline.summaries(spark, sf).join(known.where(F.col("pos") % 5 != 2), "catalog_id") \
        .join(summary.median_freshness(scores), "catalog_id", "left").join(formats, "catalog_id", "left") \
        .select("catalog_id", F.lit("ok").alias("status"), "dataset_count", "resource_count", "datasets_scored", "overall",
                "accessibility", "structure", "freshness", "completeness", F.lit(0.0).alias("usability"), "accessible_pct",
                "median_freshness_days", F.coalesce("top_formats", F.array().cast("array<string>")).alias("top_formats"),
                "coverage", "tier", F.lit(AS_OF).cast("timestamp").alias("scored_at"))
    n, mean = F.count(F.lit(1)), columns.avg3(F.col("overall"))
    previous = spark.table("v_prev").groupBy("catalog_id").agg(n.alias("dataset_count"), mean.alias("overall"),
                                                               F.max("last_scored_on").cast("timestamp").alias("scored_at")) \
        .join(known, "catalog_id").select(
            "catalog_id", F.when(F.col("pos") % 3 == 0, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
            "dataset_count", (F.col("dataset_count") * 2).alias("resource_count"), F.col("dataset_count").alias("datasets_scored"),
            "overall", *[F.col("overall").alias(c) for c in ("accessibility", "structure", "freshness", "completeness")],
            F.lit(0.0).alias("usability"), F.lit(0.5).alias("accessible_pct"),
            F.col("pos").cast("double").alias("median_freshness_days"), F.array(F.lit("csv"), F.lit("json")).alias("top_formats"),
            F.lit(1.0).alias("coverage"), "tier", "scored_at")
    out = incremental.summary_fallback(cats, current, previous, NEXT_AS_OF).drop("pos")
    return out.withColumn("top_formats", F.array_join("top_formats", ","))


_SUMMARY_FIELDS = ("accessibility", "structure", "freshness", "completeness")


def _pick(cur: str, prev: str, zero: str, name: str) -> str:
    return f"CASE WHEN cur.catalog_id IS NOT NULL THEN {cur} WHEN prev.catalog_id IS NOT NULL THEN {prev} ELSE {zero} END AS {name}"


oracle("summary_fallback", f"""WITH {SUMMARY_CTES}, lang AS ({search.CATALOG_LANG_SQL.strip()}),
med AS (SELECT catalog_id, CAST(median(days_since_modified) AS DOUBLE) AS m FROM sc GROUP BY catalog_id),
fc AS (SELECT catalog_id, f, count(*) AS n FROM (SELECT catalog_id, unnest(formats) AS f FROM sc) GROUP BY catalog_id, f),
fr AS (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY n DESC, f) AS rank FROM fc),
tf AS (SELECT catalog_id, string_agg(f, ',' ORDER BY rank) AS formats FROM fr WHERE rank <= 5 GROUP BY catalog_id),
cur AS (SELECT summ.*, m, formats FROM summ LEFT JOIN med USING (catalog_id) LEFT JOIN tf USING (catalog_id)
  WHERE catalog_id IN (SELECT id FROM v_catalogs WHERE pos % 5 <> 2)),
prev AS (SELECT catalog_id, count(*) AS n, {avg3('overall')} AS o, max(last_scored_on) AS at FROM v_prev GROUP BY catalog_id)
SELECT c.id, c.name, c.country, c.protocol, lang.language,
 {_pick("'ok'", "CASE WHEN c.pos % 3 = 0 THEN 'failed' ELSE 'ok' END", "'pending'", 'status')},
 CAST(coalesce(cur.dataset_count, prev.n, 0) AS BIGINT) AS dataset_count,
 CAST({_pick('cur.resource_count', 'prev.n * 2', '0', 'x')[:-5]} AS BIGINT) AS resource_count,
 CAST(coalesce(cur.datasets_scored, prev.n, 0) AS BIGINT) AS datasets_scored,
 coalesce(cur.overall, prev.o, {dbl(0.0)}) AS overall,
 {", ".join(f"coalesce(cur.{f}, prev.o, {dbl(0.0)}) AS {f}" for f in _SUMMARY_FIELDS)}, {dbl(0.0)} AS usability,
 {_pick('cur.accessible_pct', dbl(0.5), dbl(0.0), 'accessible_pct')},
 {_pick('cur.m', 'CAST(c.pos AS DOUBLE)', 'NULL', 'median_freshness_days')},
 {_pick("coalesce(cur.formats, '')", "'csv,json'", "''", 'top_formats')},
 {_pick('cur.coverage', dbl(1.0), dbl(0.0), 'coverage')},
 CASE WHEN c.pos % 2 = 0 THEN 'detail' ELSE 'aggregate' END AS tier,
 {_pick(f"TIMESTAMP '{AS_OF}'", 'CAST(prev.at AS TIMESTAMP)', f"TIMESTAMP '{NEXT_AS_OF}'", 'scored_at')}
FROM v_catalogs c JOIN lang ON lang.catalog_id = c.id LEFT JOIN cur ON c.id = cur.catalog_id LEFT JOIN prev ON c.id = prev.catalog_id""",
       "v_datasets", "v_resources", "v_checks", "v_prev", "v_catalogs")

# ------------------------------------------------------------------ failures


def outcomes(spark, sf):
    register_views(spark, sf, ())
    return spark.table("events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))


@query("failure_streak")
def q_failure_streak(spark, sf):
    return incremental.failure_streak(outcomes(spark, sf), "user_id", EVENTS_AS_OF)


oracle("failure_streak", f"""WITH o AS (SELECT user_id, ts, event_id, event_type = 'error' AS failed FROM events),
lo AS (SELECT user_id, ts AS lts, event_id AS leid FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
       FROM o WHERE NOT failed) WHERE rn = 1),
a AS (SELECT o.user_id, CAST(sum(CASE WHEN failed AND (lo.lts IS NULL OR o.ts > lo.lts OR (o.ts = lo.lts AND o.event_id > lo.leid)) THEN 1 ELSE 0 END) AS BIGINT) AS consecutive_failures,
  max(CASE WHEN failed AND (lo.lts IS NULL OR o.ts > lo.lts OR (o.ts = lo.lts AND o.event_id > lo.leid)) THEN o.ts END) AS last_failure, CAST(count(*) AS BIGINT) AS events
  FROM o LEFT JOIN lo ON o.user_id = lo.user_id GROUP BY o.user_id)
SELECT user_id, consecutive_failures, CASE WHEN consecutive_failures >= {L.UNREACHABLE_AFTER_FAILURES} THEN 'unreachable' ELSE 'ok' END AS status,
 last_failure, consecutive_failures >= {L.UNREACHABLE_AFTER_FAILURES} AND (epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(last_failure)) / 86400000000.0 < {L.RETRY_AFTER_DAYS} AS skip,
 events FROM a""")

# ------------------------------------------------------------------ sweeps
SWEEP_CHUNK = 20


def sweep_run(spark, sf):
    register_views(spark, sf, ("v_sweep_state", "v_sweep_aggs", "v_catalogs"))
    plan = incremental.sweep_plan(spark.table("v_catalogs"), spark.table("v_sweep_state"), AS_OF,
                                  known=pipeline.known_counts(spark, sf))
    protocols = spark.table("v_catalogs").select(F.col("id").alias("catalog_id"), "protocol")
    scores = pipeline.dataset_scores(spark, sf).join(protocols, "catalog_id")
    chunk = incremental.sweep_chunk(scores, plan, SWEEP_CHUNK, keep_undated=F.col("protocol") == "socrata")
    state = incremental.sweep_state(plan, chunk, SWEEP_CHUNK, AS_OF)
    aggs = incremental.sweep_aggregates(plan, incremental.sweep_partials(chunk), spark.table("v_sweep_aggs"))
    return plan, chunk, state, aggs


@query("sweep_skip_or_restart")
def q_sweep_skip_or_restart(spark, sf):
    plan = sweep_run(spark, sf)[0]
    return plan.select("catalog_id", "action", "start_cursor", "carried_processed", "total_known")


PLAN_SQL = f"""plan AS (SELECT c.id AS catalog_id,
  CASE WHEN s.complete IS NULL THEN 'fresh'
   WHEN s.complete AND s.last_complete_sweep IS NOT NULL AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(s.last_complete_sweep) < {L.RESCORE_DAYS} * 86400000000 THEN 'skip'
   WHEN s.complete AND s.last_complete_sweep IS NOT NULL THEN 'restart'
   WHEN NOT s.complete THEN 'resume' ELSE 'fresh' END AS action,
  s.complete AS was_complete, s.last_complete_sweep, s.cursor, s.processed_count,
  CASE WHEN coalesce(s.total_known, 0) = 0 THEN coalesce(k.n, 0) ELSE s.total_known END AS total_known
  FROM v_catalogs c LEFT JOIN v_sweep_state s ON c.id = s.catalog_id
  LEFT JOIN (SELECT catalog_id, count(*) AS n FROM v_datasets GROUP BY catalog_id) k ON c.id = k.catalog_id),
plan2 AS (SELECT *, CASE WHEN action = 'resume' THEN coalesce(cursor, TIMESTAMP '1970-01-01 00:00:00')
   WHEN action = 'restart' THEN last_complete_sweep WHEN action = 'skip' THEN cursor ELSE TIMESTAMP '1970-01-01 00:00:00' END AS start_cursor,
  CAST(CASE WHEN action IN ('resume', 'skip') THEN processed_count ELSE 0 END AS BIGINT) AS carried_processed FROM plan)"""

oracle("sweep_skip_or_restart", f"""WITH {PLAN_SQL}
SELECT catalog_id, action, start_cursor, carried_processed, CAST(total_known AS BIGINT) AS total_known FROM plan2""",
       "v_catalogs", "v_sweep_state", "v_datasets")

CHUNK_SQL = f"""{SCORES_CTES}, {PLAN_SQL},
cand AS (SELECT sc.*, p.start_cursor FROM sc JOIN plan2 p ON sc.catalog_id = p.catalog_id
  JOIN v_catalogs vc ON vc.id = sc.catalog_id
  WHERE p.action <> 'skip' AND (sc.modified_at >= p.start_cursor OR (sc.modified_at IS NULL AND vc.protocol = 'socrata'))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY modified_at NULLS LAST, id) - 1 AS idx FROM cand),
chunk AS (SELECT *, idx % {L.SWEEP_ACCESS_EVERY} = 0 AS with_access FROM ranked WHERE idx < {SWEEP_CHUNK}),
run AS (SELECT catalog_id, count(*) AS chunk_count, max(modified_at) AS max_modified FROM chunk GROUP BY catalog_id),
st AS (SELECT p.catalog_id, p.action, p.carried_processed + coalesce(r.chunk_count, 0) AS processed,
  coalesce(r.chunk_count, 0) AS cc, p.total_known, p.was_complete, p.cursor, p.start_cursor, r.max_modified, p.carried_processed,
  p.last_complete_sweep
  FROM plan2 p LEFT JOIN run r ON p.catalog_id = r.catalog_id),
st2 AS (SELECT *, cc < {SWEEP_CHUNK} AS complete_now,
  CASE WHEN action <> 'skip' AND cc < {SWEEP_CHUNK} AND processed > total_known THEN processed ELSE total_known END AS total_new FROM st),
state AS (SELECT catalog_id, action, CAST(CASE WHEN action = 'skip' THEN carried_processed ELSE processed END AS BIGINT) AS processed_count,
  CAST(total_new AS BIGINT) AS total_known, CASE WHEN action = 'skip' THEN was_complete ELSE complete_now END AS complete,
  CASE WHEN action = 'skip' THEN cursor ELSE greatest(start_cursor, coalesce(max_modified, start_cursor)) END AS cursor,
  CASE WHEN action <> 'skip' AND complete_now THEN TIMESTAMP '{AS_OF}' ELSE last_complete_sweep END AS last_complete_sweep,
  {r3("CASE WHEN total_new > 0 THEN least(" + dbl(1.0) + ", processed / total_new) ELSE " + dbl(0.0) + " END")} AS coverage,
  CAST(cc AS BIGINT) AS chunk_count FROM st2)"""


@query("sweep_chunk")
def q_sweep_chunk(spark, sf):
    return sweep_run(spark, sf)[2]


oracle("sweep_chunk", f"WITH {CHUNK_SQL}\nSELECT * FROM state", "v_datasets", "v_resources", "v_checks", "v_catalogs",
       "v_sweep_state")

@query("sweep_next_run")
def q_sweep_next_run(spark, sf):
    """A run's state goes through the state store into the plan of the next, which takes all that is left."""
    _, _, state, _ = sweep_run(spark, sf)
    path = scratch_path(spark, "sweep-state")
    stores.state_save(state.drop("action", "chunk_count"), path)
    cats = spark.table("v_catalogs")
    plan = incremental.sweep_plan(cats, stores.state_read(spark, path), NEXT_AS_OF)
    protocols = cats.select(F.col("id").alias("catalog_id"), "protocol")
    scores = pipeline.dataset_scores(spark, sf).join(protocols, "catalog_id")
    chunk = incremental.sweep_chunk(scores, plan, 0, keep_undated=F.col("protocol") == "socrata")
    new = incremental.sweep_state(plan, chunk, 0, NEXT_AS_OF)
    access = chunk.groupBy("catalog_id").agg(F.sum(F.col("with_access").cast("bigint")).alias("with_access"),
                                             F.max("idx").cast("bigint").alias("last_idx"))
    return new.join(access, "catalog_id", "left")


NEXT_SQL = f"""{CHUNK_SQL},
nplan AS (SELECT c.id AS catalog_id, CASE WHEN s.complete AND epoch_us(TIMESTAMP '{NEXT_AS_OF}') - epoch_us(s.last_complete_sweep) < {L.RESCORE_DAYS} * 86400000000 THEN 'skip'
   WHEN s.complete THEN 'restart' WHEN NOT s.complete THEN 'resume' ELSE 'fresh' END AS action, s.complete AS was_complete,
   s.last_complete_sweep, s.cursor, s.processed_count, coalesce(s.total_known, 0) AS total_known
  FROM v_catalogs c LEFT JOIN state s ON c.id = s.catalog_id),
nplan2 AS (SELECT *, CASE action WHEN 'resume' THEN coalesce(cursor, TIMESTAMP '1970-01-01 00:00:00') WHEN 'restart' THEN last_complete_sweep
   WHEN 'skip' THEN cursor ELSE TIMESTAMP '1970-01-01 00:00:00' END AS start_cursor,
   CASE WHEN action IN ('resume', 'skip') THEN processed_count ELSE 0 END AS carried FROM nplan),
nranked AS (SELECT sc.catalog_id, sc.modified_at, row_number() OVER (PARTITION BY sc.catalog_id ORDER BY sc.modified_at NULLS LAST, sc.id) - 1 AS idx
  FROM sc JOIN nplan2 p ON sc.catalog_id = p.catalog_id JOIN v_catalogs vc ON vc.id = sc.catalog_id
  WHERE p.action <> 'skip' AND (sc.modified_at >= p.start_cursor OR (sc.modified_at IS NULL AND vc.protocol = 'socrata'))),
nrun AS (SELECT catalog_id, count(*) AS cc, max(modified_at) AS max_modified, max(idx) AS last_idx,
   sum(CASE WHEN idx % {L.SWEEP_ACCESS_EVERY} = 0 THEN 1 ELSE 0 END) AS with_access FROM nranked GROUP BY catalog_id),
nst AS (SELECT p.*, coalesce(r.cc, 0) AS cc, r.max_modified, r.last_idx, r.with_access, p.carried + coalesce(r.cc, 0) AS processed,
   CASE WHEN p.action <> 'skip' THEN greatest(p.total_known, p.carried + coalesce(r.cc, 0)) ELSE p.total_known END AS total_new
  FROM nplan2 p LEFT JOIN nrun r ON p.catalog_id = r.catalog_id)"""

oracle("sweep_next_run", f"""WITH {NEXT_SQL}
SELECT catalog_id, action, CAST(CASE WHEN action = 'skip' THEN carried ELSE processed END AS BIGINT) AS processed_count,
 CAST(total_new AS BIGINT) AS total_known, CASE WHEN action = 'skip' THEN was_complete ELSE true END AS complete,
 CASE WHEN action = 'skip' THEN cursor ELSE greatest(start_cursor, coalesce(max_modified, start_cursor)) END AS cursor,
 CASE WHEN action = 'skip' THEN last_complete_sweep ELSE TIMESTAMP '{NEXT_AS_OF}' END AS last_complete_sweep,
 {r3("CASE WHEN total_new > 0 THEN least(" + dbl(1.0) + ", processed / total_new) ELSE " + dbl(0.0) + " END")} AS coverage,
 CAST(cc AS BIGINT) AS chunk_count, CAST(with_access AS BIGINT) AS with_access, CAST(last_idx AS BIGINT) AS last_idx FROM nst""",
       "v_datasets", "v_resources", "v_checks", "v_catalogs", "v_sweep_state")

AGGS_SQL = f"""{CHUNK_SQL},
long AS (SELECT catalog_id, 'completeness' AS dimension, completeness AS score FROM chunk
  UNION ALL SELECT catalog_id, 'freshness', freshness FROM chunk UNION ALL SELECT catalog_id, 'structure', structure FROM chunk
  UNION ALL SELECT catalog_id, 'accessibility', accessibility FROM chunk WHERE with_access),
part AS (SELECT catalog_id, dimension, sum(CAST(round(score * 1000) AS BIGINT)) AS sum_milli, count(*) AS count FROM long GROUP BY catalog_id, dimension),
carry AS (SELECT a.* FROM v_sweep_aggs a WHERE a.catalog_id IN (SELECT catalog_id FROM plan2 WHERE action IN ('resume', 'skip'))),
aggs AS (SELECT catalog_id, dimension, CAST(sum(sum_milli) AS BIGINT) AS sum_milli, CAST(sum(count) AS BIGINT) AS count FROM
  (SELECT catalog_id, dimension, sum_milli, count FROM carry UNION ALL SELECT * FROM part) GROUP BY catalog_id, dimension),
means AS (SELECT catalog_id, dimension, CASE WHEN count > 0 THEN CAST((2 * sum_milli + count) // (2 * count) AS BIGINT) / {dbl(1000.0)} ELSE {dbl(0.0)} END AS mean FROM aggs)"""


@query("sweep_summary")
def q_sweep_summary(spark, sf):
    _, _, state, aggs = sweep_run(spark, sf)
    return incremental.sweep_summary(state, aggs)


_W = L.QUALITY_WEIGHTS
oracle("sweep_summary", f"""WITH {AGGS_SQL},
w AS (SELECT s.catalog_id, s.total_known, s.processed_count, s.coverage,
  coalesce(max(CASE WHEN m.dimension = 'accessibility' THEN m.mean END), {dbl(0.0)}) AS accessibility,
  coalesce(max(CASE WHEN m.dimension = 'structure' THEN m.mean END), {dbl(0.0)}) AS structure,
  coalesce(max(CASE WHEN m.dimension = 'freshness' THEN m.mean END), {dbl(0.0)}) AS freshness,
  coalesce(max(CASE WHEN m.dimension = 'completeness' THEN m.mean END), {dbl(0.0)}) AS completeness
  FROM state s LEFT JOIN means m ON s.catalog_id = m.catalog_id GROUP BY s.catalog_id, s.total_known, s.processed_count, s.coverage)
SELECT catalog_id, CAST(greatest(total_known, processed_count) AS BIGINT) AS dataset_count, accessibility, structure, freshness, completeness,
 {r3(f"(((({dbl(0.0)} + completeness * {dbl(_W['completeness'])}) + freshness * {dbl(_W['freshness'])}) + structure * {dbl(_W['structure'])}) + accessibility * {dbl(_W['accessibility'])})")} AS overall,
 coverage, processed_count AS datasets_scored FROM w""",
       "v_datasets", "v_resources", "v_checks", "v_catalogs", "v_sweep_state", "v_sweep_aggs")


@query("run_summary")
def q_run_summary(spark, sf):
    idx = pipeline.catalog_index(spark, sf)
    run = idx.withColumn("tier", F.when(F.col("pos") % 2 == 0, F.lit("detail")).otherwise(F.lit("aggregate"))) \
             .withColumn("run_status", F.when(F.col("status") == "pending", F.lit("skipped"))
                         .when(F.col("pos") % 5 == 2, F.lit("failed")).otherwise(F.lit("processed")))
    return incremental.run_summary(run)


oracle("run_summary", f"""WITH {SUMMARY_CTES},
r AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 'detail' ELSE 'aggregate' END AS tier,
  CASE WHEN status = 'pending' THEN 'skipped' WHEN pos % 5 = 2 THEN 'failed' ELSE 'processed' END AS run_status FROM idx)
SELECT CAST(sum(dataset_count) AS BIGINT) AS total_datasets, CAST(sum(resource_count) AS BIGINT) AS total_resources,
 CAST(sum(CASE WHEN run_status = 'processed' THEN 1 ELSE 0 END) AS BIGINT) AS processed,
 CAST(sum(CASE WHEN run_status = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
 CAST(sum(CASE WHEN run_status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
 coalesce({avg3("CASE WHEN tier = 'aggregate' THEN coverage END")}, {dbl(0.0)}) AS aggregate_coverage FROM r""",
       "v_datasets", "v_resources", "v_checks", "v_catalogs")
