"""Policy audit of SQL texts in a query log, usage-event validation and batch
bounds. Every rule is a column expression (regex, JSON field tests), so an
audit is one projection over the log, at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions.columns import js_trim

# A single-quoted SQL literal ('' escapes a quote); an unterminated one runs to the end.
STRING_LITERAL = r"'(?:[^']|'')*(?:'|$)"


def _alt(words) -> str:
    return "|".join(words)


STMT_RE = rf"(?i)^\s*({_alt(L.BLOCKED_STATEMENTS)})\b"
STMT_SESSION_RE = rf"(?i)^\s*({_alt(w for w in L.BLOCKED_STATEMENTS if w != 'CREATE')})\b"
FN_RE = rf"(?i)\b({_alt(L.BLOCKED_FUNCTIONS)})\s*\("
SELECT_RE = r"(?i)^\s*(SELECT|WITH)\b"
IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_]*"


def _words(*words: str) -> str:
    return r"\s+".join(words)


# CREATE TEMP TABLE [IF NOT EXISTS] name AS, the name plain or in double quotes
CREATE_TEMP_RE = (rf"(?i)^\s*{_words('CREATE', '(?:TEMPORARY|TEMP)', 'TABLE')}\s+(?:{_words('IF', 'NOT', 'EXISTS')}\s+)?"
                  rf'("?{IDENTIFIER}"?)\s+AS\s+')


def _table_re(tables) -> str:
    return rf"(?i)\b({_alt(tables)})\b"


def audit_simple(sql: Column, table: str = L.SIMPLE_MODE_TABLE) -> Column:
    """Verdict of the simple-mode rules, first failing rule wins."""
    t = js_trim(sql)
    outside = F.regexp_replace(t, STRING_LITERAL, "")
    return (F.when(t == "", F.lit("empty"))
            .when(outside.contains(";"), F.lit("multi_statement"))
            .when(t.rlike(STMT_RE), F.concat(F.lit("blocked_statement:"), F.upper(F.regexp_extract(t, STMT_RE, 1))))
            .when(t.rlike(FN_RE), F.concat(F.lit("blocked_function:"), F.regexp_extract(t, FN_RE, 1)))
            .when(~t.rlike(SELECT_RE), F.lit("not_select"))
            .when(~t.rlike(_table_re([table])), F.lit("missing_table"))
            .otherwise(F.lit("ok")))


def audit_session(sql: Column, tables: list[str]) -> Column:
    """Verdict of the session-mode rules (the function rule comes before the
    statement rule, and only CREATE TEMP TABLE ... AS passes as a CREATE)."""
    t = js_trim(sql)
    outside = F.regexp_replace(t, STRING_LITERAL, "")
    created = F.lower(F.regexp_replace(F.regexp_extract(t, CREATE_TEMP_RE, 1), '"', ""))
    return (F.when(t == "", F.lit("empty"))
            .when(outside.contains(";"), F.lit("multi_statement"))
            .when(t.rlike(FN_RE), F.concat(F.lit("blocked_function:"), F.regexp_extract(t, FN_RE, 1)))
            .when(t.rlike(CREATE_TEMP_RE) & created.isin(*[x.lower() for x in tables]),
                  F.lit("reserved_table_name"))
            .when(t.rlike(CREATE_TEMP_RE), F.concat(F.lit("create_temp:"), created))
            .when(t.rlike(STMT_SESSION_RE),
                  F.concat(F.lit("blocked_statement:"), F.upper(F.regexp_extract(t, STMT_SESSION_RE, 1))))
            .when(~t.rlike(SELECT_RE), F.lit("not_select"))
            .when(~t.rlike(_table_re(tables)), F.lit("missing_table"))
            .otherwise(F.lit("ok")))


def audit_log(log: DataFrame, tables: list[str], key: str, order: list[str],
              max_temp_tables: int = L.MAX_TEMP_TABLES) -> DataFrame:
    """``log`` (with ``sql``) and its session-mode verdict, the sessions' temp tables included.

    A session (``key``) may hold ``max_temp_tables``: with the last of them created, every later
    CREATE TEMP is ``temp_limit``, whatever its name. A later query may read what the session
    created before. Both follow from each name's first creation, a partial aggregate: the
    first ``max_temp_tables`` names by it exist, and the last one's place is the limit's."""
    place = F.struct(*order)
    v = log.withColumn("_place", place).withColumn("verdict", audit_session(F.col("sql"), tables))
    created = v.where(F.col("verdict").startswith("create_temp:")) \
        .groupBy(F.col(key).alias("_owner"), F.substring("verdict", len("create_temp:") + 1, 10_000).alias("name")) \
        .agg(F.min("_place").alias("first"))
    nth = F.row_number().over(Window.partitionBy("_owner").orderBy("first"))
    held = created.withColumn("nth", nth).where(F.col("nth") <= max_temp_tables)
    full = held.where(F.col("nth") == max_temp_tables).select("_owner", F.col("first").alias("_full_at"))
    v = v.join(full, F.col(key) == F.col("_owner"), "left").drop("_owner")
    is_create = F.col("verdict").startswith("create_temp:") | (F.col("verdict") == "reserved_table_name")
    v = v.withColumn("verdict", F.when(is_create & (F.col("_place") > F.col("_full_at")), F.lit("temp_limit"))
                     .otherwise(F.col("verdict"))).drop("_full_at")
    # texts without a base table: do their words name a temp table of the session?
    asked = v.where(F.col("verdict") == "missing_table") \
        .select(F.col(key).alias("_k"), F.col("_place").alias("_at"), F.explode(F.array_distinct(
            F.regexp_extract_all(F.lower("sql"), F.lit(r"\w+"), F.lit(0)))).alias("word"))
    named = asked.join(held, (F.col("_k") == F.col("_owner")) & (F.col("word") == F.col("name")) & (F.col("first") < F.col("_at"))) \
        .select("_k", "_at").distinct()
    v = v.join(named, (F.col(key) == F.col("_k")) & (F.col("_place") == F.col("_at")), "left")
    return v.withColumn("verdict", F.when(F.col("_k").isNotNull(), F.lit("ok")).otherwise(F.col("verdict"))) \
        .drop("_k", "_at", "_place")


# ------------------------------------------------------------------ usage events
EVENT_SCHEMA = ("id string, timestamp string, clientId string, datasetId string, resourceUrl string, "
                "success boolean, durationMs double, type string, query string, catalogId string, "
                "resultCount double, sql string, rowsReturned double, errorMessage string, format string, "
                "columnCount double, rowCount double, errorCode string")
STRING_FIELDS = tuple(f.split()[0] for f in EVENT_SCHEMA.split(", ") if f.endswith(" string") and not f.startswith("type "))
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def _nonneg_int(c: Column) -> Column:
    return (c >= 0) & (F.floor(c) == c)


def validate_events(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Parse usage events and give each a verdict: ok, or the first failing rule."""
    e = F.from_json(F.col(json_col), EVENT_SCHEMA)
    df = raw.withColumn("e", e).withColumn("_v", F.try_parse_json(F.col(json_col)))       # parsed once for all fields
    c = lambda n: F.col("e." + n)
    typ = c("type")
    required = {
        "search": [("query", None), ("resultCount", "int")],
        "query": [("sql", None)],
        "inspect": [],
        "error": [("errorCode", None), ("errorMessage", None)],
    }
    optional_counts = {"search": [], "query": ["rowsReturned"], "inspect": ["columnCount", "rowCount"],
                       "error": []}
    # from_json coerces numbers to strings; the parsed value still knows its JSON type
    v = F.col("_v")
    wrong_type = F.lit(False)
    for f in STRING_FIELDS:
        found = F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
        wrong_type = wrong_type | F.coalesce(~found.isin("STRING", "VOID"), F.lit(False))
    missing = F.lit(False)
    bad_count = F.lit(False)
    for t, fields in required.items():
        for f, kind in fields:
            missing = missing | ((typ == t) & c(f).isNull())
            if kind == "int":
                bad_count = bad_count | ((typ == t) & c(f).isNotNull() & ~_nonneg_int(c(f)))
        for f in optional_counts[t]:
            bad_count = bad_count | ((typ == t) & c(f).isNotNull() & ~_nonneg_int(c(f)))
    reason = (F.when(F.col("e").isNull(), F.lit("unparsable"))
              .when(typ.isNull() | ~typ.isin(*L.EVENT_TYPES), F.lit("bad_type"))
              .when(c("timestamp").isNull() | c("clientId").isNull() | c("success").isNull(), F.lit("missing_base"))
              .when(wrong_type, F.lit("bad_field_type"))
              .when(~c("timestamp").rlike(ISO_DATETIME) | F.try_to_timestamp(c("timestamp")).isNull(),
                    F.lit("bad_timestamp"))
              .when(c("durationMs").isNotNull() & (c("durationMs") < 0), F.lit("negative_duration"))
              .when(missing, F.lit("missing_field"))
              .when(bad_count, F.lit("bad_count")))
    return df.select("*", typ.alias("type"), reason.alias("reason"), reason.isNull().alias("valid")).drop("e", "_v")


def batch_bounds(events: DataFrame, client_col: str, batch_col: str) -> DataFrame:
    """A batch is accepted only with 1..1000 events; the response is the accepted count."""
    n = events.groupBy(client_col, batch_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    ok = F.col("n").between(1, L.MAX_EVENT_BATCH)
    return n.select(client_col, batch_col, "n", F.when(ok, F.col("n")).otherwise(F.lit(0)).cast("bigint")
                    .alias("accepted"), F.when(ok, F.lit("accepted")).otherwise(F.lit("rejected")).alias("status"))
