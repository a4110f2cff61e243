"""Query-log audit, usage events and score-row validation over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirador.fixtures import register_views
from mirador.functions import lookups as L
from mirador.operators import audit, scoring
from mirador.plans.oracles import oracle
from mirador.plans.registry import query
from mirador.plans.sqlparts import trim_ws

# Fixed parameter: SQL texts of the query log (one per event_id % 16; {n} is a number of the event's own).
LOG_SQL = [
    "SELECT * FROM datos LIMIT {n}",
    "SELECT * FROM datos; DROP TABLE datos",
    "SELECT * FROM datos WHERE name = 'a;b{n}'",
    "  drop table t{n}",
    "SELECT * FROM read_csv('/etc/passwd{n}')",
    "SELECT {n}",
    "   ",
    "CREATE TEMP TABLE t{n} AS SELECT * FROM datos",
    "with x as (select * from datos) select * from x",
    "EXPLAIN SELECT * FROM datos",
    "SELECT 'it''s;' AS s{n} FROM datos",
    "select * from datos where x = 'unterminated;",
    "select count(*) from T{n}",
    "create temporary table if not exists \"T{n}\" as select * from ventas",
    "CREATE TEMP TABLE datos AS SELECT {n}",
    "SELECT a.x FROM t{n} a JOIN t1 b ON a.k = b.k",
]
LOG_NO = "(event_id * 31 + user_id) % 23"
SESSION_TABLES = ["datos", "ventas"]
SESSIONS = 40                  # sessions a day


def _case_sql(col: str) -> str:
    whens = " ".join("WHEN {} THEN '{}'".format(i, s.replace("'", "''")) for i, s in enumerate(LOG_SQL))
    return f"CASE {col} % {len(LOG_SQL)} {whens} END"


def query_log(spark, sf):
    register_views(spark, sf, ())
    sql = F.element_at(F.array(*[F.lit(s) for s in LOG_SQL]), (F.col("event_id") % len(LOG_SQL) + 1).cast("int"))
    session = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), (F.col("user_id") % SESSIONS).cast("string"))
    return spark.table("events").select("event_id", "ts", session.alias("session"),
                                        F.replace(sql, F.lit("{n}"), F.expr(LOG_NO).cast("string")).alias("sql"))


@query("sql_policy_audit")
def q_sql_policy_audit(spark, sf):
    log = audit.audit_log(query_log(spark, sf), SESSION_TABLES, "session", ["ts", "event_id"])
    return log.select("event_id", "session", audit.audit_simple(F.col("sql")).alias("verdict_simple"),
                      F.col("verdict").alias("verdict_session"))


def _duck_audit(simple: bool) -> str:
    t = trim_ws("q.sql")
    outside = f"regexp_replace({t}, '{audit.STRING_LITERAL.replace(chr(39), chr(39) * 2)}', '', 'g')"
    def rx(p):
        return p.replace("'", "''")
    stmt = audit.STMT_RE if simple else audit.STMT_SESSION_RE
    tables = [L.SIMPLE_MODE_TABLE] if simple else SESSION_TABLES
    table_re = rx(audit._table_re(tables))
    created = f"lower(replace(regexp_extract({t}, '{rx(audit.CREATE_TEMP_RE)}', 1), '\"', ''))"
    fn = (f"WHEN regexp_matches({t}, '{rx(audit.FN_RE)}') THEN 'blocked_function:' || "
          f"regexp_extract({t}, '{rx(audit.FN_RE)}', 1)")
    st = (f"WHEN regexp_matches({t}, '{rx(stmt)}') THEN 'blocked_statement:' || "
          f"upper(regexp_extract({t}, '{rx(stmt)}', 1))")
    create = ("" if simple else
              f"WHEN regexp_matches({t}, '{rx(audit.CREATE_TEMP_RE)}') AND {created} IN "
              f"({', '.join(repr(x.lower()) for x in tables)}) THEN 'reserved_table_name' "
              f"WHEN regexp_matches({t}, '{rx(audit.CREATE_TEMP_RE)}') THEN 'create_temp:' || {created}")
    middle = f"{st} {fn}" if simple else f"{fn} {create} {st}"
    return (f"CASE WHEN {t} = '' THEN 'empty' WHEN contains({outside}, ';') THEN 'multi_statement' {middle} "
            f"WHEN NOT regexp_matches({t}, '{rx(audit.SELECT_RE)}') THEN 'not_select' "
            f"WHEN NOT regexp_matches({t}, '{table_re}') THEN 'missing_table' ELSE 'ok' END")


oracle("sql_policy_audit", f"""WITH q AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') || '/' || CAST(user_id % {SESSIONS} AS VARCHAR) AS session,
  replace({_case_sql('event_id')}, '{{n}}', CAST({LOG_NO} AS VARCHAR)) AS sql FROM events),
v AS (SELECT *, {_duck_audit(True)} AS verdict_simple, {_duck_audit(False)} AS verdict FROM q),
made AS (SELECT session, substr(verdict, 13) AS name, min((ts, event_id)) AS first FROM v WHERE starts_with(verdict, 'create_temp:') GROUP BY 1, 2),
held AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first) AS nth FROM made)
SELECT event_id, session, verdict_simple, CASE
 WHEN (starts_with(verdict, 'create_temp:') OR verdict = 'reserved_table_name') AND EXISTS (SELECT 1 FROM held h
   WHERE h.session = v.session AND h.nth = {L.MAX_TEMP_TABLES} AND (v.ts, v.event_id) > h.first) THEN 'temp_limit'
 WHEN verdict = 'missing_table' AND EXISTS (SELECT 1 FROM held h WHERE h.session = v.session AND h.nth <= {L.MAX_TEMP_TABLES}
   AND h.first < (v.ts, v.event_id) AND list_contains(regexp_extract_all(lower(v.sql), '\\w+'), h.name)) THEN 'ok'
 ELSE verdict END AS verdict_session FROM v""")

# ------------------------------------------------------------------ usage events
TYPE_MAP = {"view": "search", "click": "query", "signup": "inspect", "error": "error", "purchase": "purchase"}


NUMBER_FIELDS = ("catalogId", "datasetId", "resourceUrl", "format")


def usage_json(spark, sf):
    """Usage events as landed JSON, built from the events table (some deliberately invalid)."""
    register_views(spark, sf, ())
    e = spark.table("events")
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    typ = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in TYPE_MAP.items()])
    ts = F.when(eid % 19 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")) \
          .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
    fields = [
        F.concat(F.lit("e"), eid.cast("string")).alias("id"), ts.alias("timestamp"),
        F.when(eid % 29 != 0, F.col("user_id").cast("string")).alias("clientId"),
        (F.col("event_type") != "error").alias("success"),
        F.when(eid % 17 == 0, F.col("value") - 100).otherwise(F.col("value")).alias("durationMs"),
        typ.alias("type"),
        F.when(typ == "search", F.concat(F.lit("q"), k.cast("string"))).alias("query"),
        F.when((typ == "search") & (eid % 13 != 0), F.when(eid % 7 == 0, k + 0.5).otherwise(k.cast("double")))
         .alias("resultCount"),
        F.when(typ == "query", F.lit("SELECT * FROM datos")).alias("sql"),
        F.when(typ == "query", (k - 50).cast("double")).alias("rowsReturned"),
        F.when(typ == "inspect", k.cast("double")).alias("rowCount"),
        F.when(typ == "error", F.concat(F.lit("E"), k.cast("string"))).alias("errorCode"),
        F.when((typ == "error") & (eid % 11 != 0), F.lit("boom")).alias("errorMessage")]
    # each of the text fields holds a number in some events
    body = F.to_json(F.struct(*fields, F.lit("src1").alias("catalogId"), F.lit("CSV").alias("format")))
    for i, name in enumerate(NUMBER_FIELDS):
        body = F.when(eid % 31 == i, F.to_json(F.struct(*fields, k.alias(name)))).otherwise(body)
    return e.select("event_id", "user_id", "ts", body.alias("json"))


@query("usage_event_validate")
def q_usage_event_validate(spark, sf):
    v = audit.validate_events(usage_json(spark, sf))
    return v.select("event_id", "type", "valid", "reason")


oracle("usage_event_validate", f"""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_MAP.items())} END AS type, value, event_type FROM events),
r AS (SELECT event_id, type, CASE
  WHEN type NOT IN ({", ".join(repr(t) for t in L.EVENT_TYPES)}) THEN 'bad_type'
  WHEN event_id % 29 = 0 THEN 'missing_base'
  WHEN event_id % 31 < {len(NUMBER_FIELDS)} THEN 'bad_field_type'
  WHEN event_id % 19 = 0 THEN 'bad_timestamp'
  WHEN event_id % 17 = 0 AND value - 100 < 0 THEN 'negative_duration'
  WHEN (type = 'search' AND event_id % 13 = 0) OR (type = 'error' AND event_id % 11 = 0) THEN 'missing_field'
  WHEN (type = 'search' AND (k < 0 OR event_id % 7 = 0)) OR (type = 'query' AND k - 50 < 0) OR (type = 'inspect' AND k < 0) THEN 'bad_count'
  END AS reason FROM e)
SELECT event_id, type, reason IS NULL AS valid, reason FROM r""")


@query("usage_batch_bounds")
def q_usage_batch_bounds(spark, sf):
    register_views(spark, sf, ())
    e = spark.table("events").select((F.col("user_id") % 3).alias("client_id"),
                                     F.date_trunc("week", "ts").alias("batch_id"))
    return audit.batch_bounds(e, "client_id", "batch_id")


oracle("usage_batch_bounds", f"""WITH b AS (SELECT user_id % 3 AS client_id, date_trunc('week', ts) AS batch_id, CAST(count(*) AS BIGINT) AS n
  FROM events GROUP BY user_id % 3, date_trunc('week', ts))
SELECT client_id, batch_id, n, CAST(CASE WHEN n BETWEEN 1 AND {L.MAX_EVENT_BATCH} THEN n ELSE 0 END AS BIGINT) AS accepted,
 CASE WHEN n BETWEEN 1 AND {L.MAX_EVENT_BATCH} THEN 'accepted' ELSE 'rejected' END AS status FROM b""")

# ------------------------------------------------------------------ score rows
DIM_MAP = {"view": "accessibility", "click": "structure", "purchase": "freshness", "signup": "completeness",
           "error": "speed"}


@query("score_bounds_check")
def q_score_bounds_check(spark, sf):
    register_views(spark, sf, ())
    dim = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in DIM_MAP.items()])
    rows = spark.table("events").select("event_id", dim.alias("dimension"), (F.col("value") / 40.0).alias("score"))
    return scoring.bounds_check(rows).select("event_id", "dimension", "score", "valid", "reject_reason")


oracle("score_bounds_check", f"""WITH r AS (SELECT event_id, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in DIM_MAP.items())} END AS dimension,
  value / CAST(40.0 AS DOUBLE) AS score FROM events),
v AS (SELECT *, CASE WHEN dimension IS NULL OR dimension NOT IN ({", ".join(repr(d) for d in L.DIMENSIONS)}) THEN 'unknown_dimension'
  WHEN score IS NULL OR isnan(score) THEN 'bad_type' WHEN score < 0 OR score > 1 THEN 'out_of_range' END AS reject_reason FROM r)
SELECT event_id, dimension, score, reject_reason IS NULL AS valid, reject_reason FROM v""")
