"""Streaming operators, each run as an availableNow stream over landed files and
checked against its batch twin's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirador.fixtures import EVENTS_AS_OF, register_views
from mirador.functions import lookups as L
from mirador.plans import pipeline
from mirador.plans.oracles import ORACLES, oracle
from mirador.plans.q_events import usage_json
from mirador.plans.registry import query
from mirador.plans.sqlparts import SCORES_CTES
from mirador.sources import records
from mirador.streaming import jobs

CHUNKS = 4


@query("stream_event_ingest")
def q_stream_event_ingest(spark, sf):
    src, out = jobs.scratch(spark, "events-landed"), jobs.scratch(spark, "events-ingest")
    landed = usage_json(spark, sf)
    files = jobs.land_in_chunks(landed, src, "event_id", CHUNKS)
    paths = jobs.event_ingest(spark, src, out, landed.schema, files)
    routed = spark.read.parquet(paths["routed"])
    return routed.select("event_id", "type", (F.col("valid") == "true").alias("valid"), "reason")


ORACLES["stream_event_ingest"] = ORACLES["usage_event_validate"]


@query("stream_sweep_totals")
def q_stream_sweep_totals(spark, sf):
    src, out = jobs.scratch(spark, "scores-landed"), jobs.scratch(spark, "sweep-totals")
    s = pipeline.dataset_scores(spark, sf).select(
        "catalog_id", F.col("external_id").cast("bigint").alias("doc_id"),
        "accessibility", "structure", "freshness", "completeness")
    files = jobs.land_in_chunks(s, src, "doc_id", CHUNKS)
    log = jobs.sweep_totals(spark, src, out, "catalog_id string, doc_id bigint, accessibility double, "
                                             "structure double, freshness double, completeness double", files)
    return log.read().select("catalog_id", "dimension", F.col("sum_milli").cast("bigint"),
                                             F.col("count").cast("bigint"))


oracle("stream_sweep_totals", f"""WITH {SCORES_CTES},
long AS (SELECT catalog_id, 'accessibility' AS dimension, accessibility AS score FROM sc
  UNION ALL SELECT catalog_id, 'structure', structure FROM sc UNION ALL SELECT catalog_id, 'freshness', freshness FROM sc
  UNION ALL SELECT catalog_id, 'completeness', completeness FROM sc)
SELECT catalog_id, dimension, CAST(sum(CAST(round(score * 1000) AS BIGINT)) AS BIGINT) AS sum_milli,
 CAST(count(*) AS BIGINT) AS count FROM long GROUP BY catalog_id, dimension""", "v_datasets", "v_resources", "v_checks")


@query("stream_latest_health")
def q_stream_latest_health(spark, sf):
    src, out = jobs.scratch(spark, "checks-landed"), jobs.scratch(spark, "latest-health")
    c = records.checks(spark, sf)
    files = jobs.land_in_chunks(c, src, "event_id", CHUNKS)
    read = jobs.latest_health(spark, src, out, "catalog_id string, url string, checked_at timestamp_ntz, "
                                               "event_id bigint, latency_ms bigint, status int", EVENTS_AS_OF,
                              files=files)
    return read().select("catalog_id", "url", "status", "latency_ms", "checked_at")


ORACLES["stream_latest_health"] = ORACLES["health_latest_fresh"]


@query("stream_failure_state")
def q_stream_failure_state(spark, sf):
    src, out = jobs.scratch(spark, "outcomes-landed"), jobs.scratch(spark, "failure-state")
    register_views(spark, sf, ())
    o = spark.table("events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    files = jobs.land_in_chunks(o, src, "event_id", CHUNKS)
    log = jobs.failure_state(spark, src, out, "user_id bigint, ts timestamp_ntz, event_id bigint, failed boolean",
                             files=files)
    return jobs.final_failure_state(log, "user_id", EVENTS_AS_OF)


ORACLES["stream_failure_state"] = ORACLES["failure_streak"]


@query("endpoint_outage_state")
def q_endpoint_outage_state(spark, sf):
    """Batch twin of the outage state machine (no SQL form: a fold per key)."""
    register_views(spark, sf, ())
    o = spark.table("events").select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return jobs.outage_batch(o, "user_id")


@query("stream_outage_state")
def q_stream_outage_state(spark, sf):
    """The outage state as a stream whose outcomes land up to twelve hours out of order."""
    src, out = jobs.scratch(spark, "outage-landed"), jobs.scratch(spark, "outage-state")
    register_views(spark, sf, ())
    late = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.col("event_id") * 7919, F.lit(43_200))
    o = spark.table("events").select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"),
                                     late.alias("arrival"))
    files = jobs.land_in_chunks(o, src, "arrival", CHUNKS)
    done = jobs.outage_stream(spark, src, out, "user_id bigint, event_id bigint, ts timestamp_ntz, ok boolean", "user_id",
                              files=files)
    return spark.read.parquet(done).select(F.col("key").alias("user_id"), "event_id", "ts", "decision", "state")


_RESET_US = L.OUTAGE_RESET_SECONDS * 1_000_000
# The circuit rules as a recursive walk over each key's outcomes in time order
# (an independent sequential formulation of the same fold).
oracle("endpoint_outage_state", f"""WITH RECURSIVE ev AS (
  SELECT user_id, event_id, ts, event_type <> 'error' AS ok, epoch_us(ts) AS tu,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
fsm(user_id, rn, event_id, ts, decision, state, failures, successes, last_failure) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR),
    'closed', 0, 0, CAST(0 AS BIGINT) FROM ev
  UNION ALL
  SELECT user_id, rn, event_id, ts,
    CASE WHEN st1 = 'open' THEN 'rejected' ELSE 'allowed' END,
    CASE WHEN st1 = 'open' THEN 'open'
         WHEN ok AND st1 = 'half_open' THEN CASE WHEN s1 + 1 >= {L.OUTAGE_HALF_OPEN_SUCCESSES} THEN 'closed' ELSE 'half_open' END
         WHEN ok THEN 'closed'
         WHEN st1 = 'half_open' THEN 'open'
         WHEN failures + 1 >= {L.OUTAGE_FAILURE_THRESHOLD} THEN 'open' ELSE 'closed' END,
    CASE WHEN st1 = 'open' THEN failures
         WHEN ok AND st1 = 'half_open' THEN CASE WHEN s1 + 1 >= {L.OUTAGE_HALF_OPEN_SUCCESSES} THEN 0 ELSE failures END
         WHEN ok THEN 0 ELSE failures + 1 END,
    CASE WHEN st1 = 'open' THEN s1
         WHEN ok AND st1 = 'half_open' THEN CASE WHEN s1 + 1 >= {L.OUTAGE_HALF_OPEN_SUCCESSES} THEN 0 ELSE s1 + 1 END
         WHEN ok THEN s1
         WHEN st1 = 'half_open' THEN 0 ELSE s1 END,
    CASE WHEN st1 <> 'open' AND NOT ok THEN tu ELSE last_failure END
  FROM (SELECT e.user_id, e.rn, e.event_id, e.ts, e.ok, e.tu, f.failures, f.last_failure,
          CASE WHEN f.state = 'open' AND e.tu - f.last_failure >= {_RESET_US} THEN 'half_open' ELSE f.state END AS st1,
          CASE WHEN f.state = 'open' AND e.tu - f.last_failure >= {_RESET_US} THEN 0 ELSE f.successes END AS s1
        FROM fsm f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1) step)
SELECT user_id, event_id, ts, decision, state FROM fsm WHERE rn > 0""")


ORACLES["stream_outage_state"] = ORACLES["endpoint_outage_state"]
