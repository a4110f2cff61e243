"""Ad-hoc SQL operators: one query per relational operator family, plus paging,
sessions, temp tables, CSV scan, inspect and column profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirador.fixtures import load_tables
from mirador.operators import asof, rangejoin, sqlapi
from mirador.plans.oracles import oracle
from mirador.plans.registry import query
from mirador.session import scratch_path


def spark_sql(name: str, spark_text: str, duck_text: str | None = None):
    """Register a pass-through SQL query (same text in both engines unless given)."""
    def run(spark, sf):
        load_tables(spark, sf)
        return spark.sql(spark_text)
    run.__name__ = f"q_{name}"
    query(name)(run)
    oracle(name, duck_text or spark_text)


spark_sql("sql_filter_project", """
SELECT c_custkey, c_name, c_acctbal FROM customer
WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey""")

spark_sql("sql_aggregate", """
SELECT count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty,
 CAST(avg(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS avg_price FROM lineitem""")

spark_sql("sql_group_by", """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty
FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY n DESC""")

spark_sql("sql_inner_join", """
SELECT c_mktsegment, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")

spark_sql("sql_cte", """
WITH per_order AS (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, count(*) AS lines
                   FROM lineitem GROUP BY l_orderkey)
SELECT lines, count(*) AS n_orders, max(q) AS max_q FROM per_order WHERE q > 50 GROUP BY lines""")

spark_sql("sql_cast", """
SELECT o_orderstatus, count(*)::INTEGER AS n, sum(o_totalprice::DECIMAL(18,2)) AS total,
 min(o_orderdate::DATE) AS first_day, max(o_orderkey)::STRING AS last_key FROM orders GROUP BY o_orderstatus""")

spark_sql("sql_outer_semi_anti", """
SELECT 'left' AS kind, count(*) AS n, count(o.o_orderkey) AS matched FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'right', count(*), count(c.c_custkey) FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'full', count(*), count(c.c_custkey) FROM customer c FULL OUTER JOIN orders o ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'semi', count(*), count(*) FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'anti', count(*), 0 FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey""", """
SELECT 'left' AS kind, count(*) AS n, count(o.o_orderkey) AS matched FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'right', count(*), count(c.c_custkey) FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'full', count(*), count(c.c_custkey) FROM customer c FULL OUTER JOIN orders o ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'semi', count(*), count(*) FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'anti', count(*), 0 FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey""")

# Range (band) join: 20 equal-width price bands built from the data (20 rows by
# construction, so the broadcast side has a proven size), parts matched by range.
@query("sql_theta_range_join")
def q_sql_theta_range_join(spark, sf):
    """Parts with the line items whose price lies in a band above the part's, as wide as its size says."""
    load_tables(spark, sf)
    bands = spark.table("part").select("p_partkey", F.col("p_retailprice").alias("lo"),
                                       (F.col("p_retailprice") + F.col("p_size") / F.lit(8.0)).alias("hi"))
    lines = spark.table("lineitem").select("l_extendedprice", F.col("l_quantity").cast("decimal(18,2)").alias("qty"))
    # totals per part: the pairs would grow with the product of both tables
    t = rangejoin.range_totals(lines, bands, "l_extendedprice", "lo", "hi", {"sum_qty": F.col("qty")})
    return t.groupBy("p_partkey").agg(F.sum("n_values").alias("n_lines"), F.sum("sum_qty").cast("decimal(28,2)").alias("sum_qty"))


oracle("sql_theta_range_join", """
SELECT p_partkey, count(*) AS n_lines, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty
FROM part JOIN lineitem ON l_extendedprice >= p_retailprice AND l_extendedprice < p_retailprice + p_size / 8.0::DOUBLE
GROUP BY p_partkey""")

spark_sql("sql_grouping_sets", """
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g_flag,
 CAST(grouping(l_linestatus) AS BIGINT) AS g_status, count(*) AS n, count(DISTINCT l_suppkey) AS n_supp,
 sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 10""")

spark_sql("sql_window", """
SELECT o_orderkey, o_custkey,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
 rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS price_rank,
 sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_sum,
 lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_order,
 count(*) OVER (PARTITION BY o_custkey) AS cust_orders
FROM orders""")

spark_sql("sql_set_ops", """
SELECT 'union' AS op, count(*) AS n FROM (SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier) t
UNION ALL SELECT 'union_all', count(*) FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier) t
UNION ALL SELECT 'intersect', count(*) FROM (SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier) t
UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier) t""")

spark_sql("sql_subquery", """
SELECT o_orderpriority, count(*) AS n FROM orders o
WHERE o_totalprice > (SELECT avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'AUTOMOBILE')
  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 30)
  AND o_totalprice > (SELECT min(o_totalprice) FROM orders)
GROUP BY o_orderpriority""")

spark_sql("sql_fn_string", """
SELECT p_partkey, upper(p_brand) AS brand_u, lower(p_type) AS type_l, substring(p_name, 1, 5) AS name5,
 split_part(p_type, ' ', 2) AS type2, regexp_replace(p_name, '[aeiou]', '') AS no_vowels,
 concat_ws('|', p_brand, p_type) AS joined, length(p_name) AS name_len,
 lpad(CAST(p_size AS STRING), 3, '0') AS size3, replace(p_brand, '#', '-') AS brand_dash,
 position('a' IN p_name) AS first_a, trim(concat('  ', p_brand, '  ')) AS trimmed,
 startswith(p_type, 'STANDARD') AS is_standard
FROM part""", """
SELECT p_partkey, upper(p_brand) AS brand_u, lower(p_type) AS type_l, substring(p_name, 1, 5) AS name5,
 split_part(p_type, ' ', 2) AS type2, regexp_replace(p_name, '[aeiou]', '', 'g') AS no_vowels,
 concat_ws('|', p_brand, p_type) AS joined, length(p_name) AS name_len,
 lpad(CAST(p_size AS VARCHAR), 3, '0') AS size3, replace(p_brand, '#', '-') AS brand_dash,
 position('a' IN p_name) AS first_a, trim(concat('  ', p_brand, '  ')) AS trimmed,
 starts_with(p_type, 'STANDARD') AS is_standard
FROM part""")

spark_sql("sql_fn_date", """
SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start, CAST(o_orderdate AS DATE) AS day,
 datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS days_to_2002,
 add_months(CAST(o_orderdate AS DATE), 3) AS plus_3m, year(o_orderdate) AS y, month(o_orderdate) AS m,
 quarter(o_orderdate) AS q, date_format(o_orderdate, 'yyyy-MM') AS ym,
 last_day(CAST(o_orderdate AS DATE)) AS month_end, date_add(CAST(o_orderdate AS DATE), 10) AS plus_10d
FROM orders""", """
SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start, CAST(o_orderdate AS DATE) AS day,
 CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS days_to_2002,
 CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS plus_3m, CAST(year(o_orderdate) AS INTEGER) AS y,
 CAST(month(o_orderdate) AS INTEGER) AS m, CAST(quarter(o_orderdate) AS INTEGER) AS q, strftime(o_orderdate, '%Y-%m') AS ym,
 last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS plus_10d
FROM orders""")

spark_sql("sql_fn_math", """
SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS fl, ceil(l_extendedprice) AS ce,
 round(abs(l_discount - 0.05), 6) AS dist, round(ln(l_extendedprice), 6) AS ln_price,
 round(log10(l_extendedprice), 6) AS log_price, round(power(l_quantity, 2), 6) AS qty_sq,
 round(sqrt(l_quantity), 6) AS qty_sqrt, sign(l_discount - 0.05) AS sgn,
 CAST(l_quantity AS BIGINT) % 7 AS qty_mod7, greatest(l_tax, l_discount) AS top_rate
FROM lineitem""", """
SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(ceil(l_extendedprice) AS BIGINT) AS ce,
 round(abs(l_discount - 0.05), 6) AS dist, round(ln(l_extendedprice), 6) AS ln_price,
 round(log10(l_extendedprice), 6) AS log_price, round(power(l_quantity, 2), 6) AS qty_sq,
 round(sqrt(l_quantity), 6) AS qty_sqrt, CAST(sign(l_discount - 0.05) AS DOUBLE) AS sgn,
 CAST(l_quantity AS BIGINT) % 7 AS qty_mod7, greatest(l_tax, l_discount) AS top_rate
FROM lineitem""")

spark_sql("sql_fn_array", """
SELECT vec_id, label, size(embedding) AS dim, size(filter(embedding, x -> x > 0)) AS n_pos,
 round(CAST(element_at(embedding, 1) AS DOUBLE), 6) AS first_v,
 round(CAST(array_max(embedding) AS DOUBLE), 6) AS max_v,
 round(CAST(element_at(array_sort(embedding), 1) AS DOUBLE), 6) AS min_v,
 round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), CAST(0 AS DOUBLE), (a, b) -> a + b), 4) AS sq_norm,
 size(array_distinct(transform(embedding, x -> x > 0))) AS n_signs,
 array_contains(transform(embedding, x -> x > 0), true) AS any_pos
FROM embeddings""", """
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_pos,
 round(CAST(embedding[1] AS DOUBLE), 6) AS first_v,
 round(CAST(list_max(embedding) AS DOUBLE), 6) AS max_v,
 round(CAST(list_sort(embedding)[1] AS DOUBLE), 6) AS min_v,
 round(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b), 4) AS sq_norm,
 CAST(len(list_distinct(list_transform(embedding, lambda x: x > 0))) AS INTEGER) AS n_signs,
 list_contains(list_transform(embedding, lambda x: x > 0), true) AS any_pos
FROM embeddings""")

spark_sql("sql_fn_map", """
WITH m AS (SELECT event_id, map_from_entries(array(named_struct('k', 'type', 'v', event_type), named_struct('k', 'user', 'v', CAST(user_id AS STRING)))) AS props_map
           FROM events)
SELECT event_id, size(props_map) AS n_keys, element_at(props_map, 'type') AS type_v,
 array_join(map_keys(props_map), ',') AS keys, element_at(props_map, 'user') AS user_v FROM m""", """
WITH m AS (SELECT event_id, map_from_entries([struct_pack(k := 'type', v := event_type), struct_pack(k := 'user', v := CAST(user_id AS VARCHAR))]) AS props_map
           FROM events)
SELECT event_id, CAST(cardinality(props_map) AS INTEGER) AS n_keys, props_map['type'] AS type_v,
 array_to_string(map_keys(props_map), ',') AS keys, props_map['user'] AS user_v FROM m""")

spark_sql("sql_fn_json", """
SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
 from_json(props, 'k BIGINT').k + 1 AS k_next, json_object_keys(props)[0] AS first_key,
 CAST(get_json_object(props, '$.k') AS BIGINT) > 50 AS is_big
FROM events""", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k_next, json_keys(props)[1] AS first_key,
 CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS is_big
FROM events""")

spark_sql("sql_topk", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5""")

# ------------------------------------------------------------------ paging
PAGED_SQL = ("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders "
             "WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey")


@query("sql_paged")
def q_sql_paged(spark, sf):
    load_tables(spark, sf)
    return sqlapi.paged(spark.sql(PAGED_SQL), limit=100, offset=50)


oracle("sql_paged", f"""
WITH q AS ({PAGED_SQL}), t AS (SELECT count(*) AS total_rows FROM q)
SELECT q.*, CAST(t.total_rows AS BIGINT) AS total_rows, (50 + least(100, greatest(0, t.total_rows - 50))) < t.total_rows AS has_more
FROM q, t ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50""")

# ------------------------------------------------------------------ sessions
SESSION_SQL = """
SELECT c.c_mktsegment, p.o_orderstatus, count(*) AS n, sum(CAST(p.o_totalprice AS DECIMAL(18,2))) AS total
FROM pedidos p JOIN clientes c ON p.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, p.o_orderstatus"""


@query("sql_session")
def q_sql_session(spark, sf):
    s = sqlapi.SqlSession.open(spark)
    s.add_table("pedidos", f"{sf}/orders.parquet", fmt="parquet")
    s.add_table("clientes", f"{sf}/customer.parquet", fmt="parquet")
    return s.sql(SESSION_SQL)


oracle("sql_session", SESSION_SQL.replace("pedidos", "orders").replace("clientes", "customer"))


@query("sql_temp_table")
def q_sql_temp_table(spark, sf):
    s = sqlapi.SqlSession.open(spark)
    s.add_table("pedidos", f"{sf}/orders.parquet", fmt="parquet")
    s.create_temp_table("grandes", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM pedidos "
                                   "WHERE o_totalprice > 150000")
    return s.sql("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM grandes "
                 "GROUP BY o_orderpriority")


oracle("sql_temp_table", """
WITH grandes AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 150000)
SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM grandes GROUP BY o_orderpriority""")

# ------------------------------------------------------------------ CSV, inspect, profile


CSV_DIALECTS = {"semicolon": {"sep": ";"}, "quoted_lines": {"quoteAll": True},
                "latin_1": {"sep": "|", "encoding": "ISO-8859-1"}, "utf_16": {"sep": "\t", "encoding": "UTF-16"}}


def customer_files(spark, sf):
    """The customers as CSV folders of four dialects, with names that need each of them."""
    root = scratch_path(spark, "customer-csv")
    c = spark.read.parquet(f"{sf}/customer.parquet")
    line = F.concat("c_name", F.lit('\nsecond "line", '), "c_mktsegment")
    for name, options in CSV_DIALECTS.items():
        text = line if name == "quoted_lines" else F.concat("c_name", F.lit(" é, ñ; o"))
        c.withColumn("c_name", text).write.option("header", True).option("escape", '"').options(**options).csv(f"{root}/{name}")
    return root


@query("csv_scan_infer")
def q_csv_scan_infer(spark, sf):
    root, out = customer_files(spark, sf), None
    for name in CSV_DIALECTS:
        df = sqlapi.read_csv_infer(spark, f"{root}/{name}").withColumn("dialect", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


oracle("csv_scan_infer", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, CASE WHEN dialect = 'quoted_lines'
  THEN c_name || chr(10) || 'second "line", ' || c_mktsegment ELSE c_name || ' é, ñ; o' END AS c_name,
 CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment, dialect
FROM customer, (VALUES ('semicolon'), ('quoted_lines'), ('latin_1'), ('utf_16')) d(dialect)""")


@query("inspect_table")
def q_inspect_table(spark, sf):
    """A Latin-1 file with ``;`` and a Parquet table, inspected."""
    path = scratch_path(spark, "orders-csv")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    o.orderBy("o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", F.concat("o_orderpriority", F.lit(" é")).alias("o_orderpriority")) \
        .write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    both = sqlapi.inspect_csv(spark, path).withColumn("source", F.lit("csv")) \
        .unionByName(sqlapi.inspect(o.orderBy("o_orderkey").drop("o_totalprice")).withColumn("source", F.lit("parquet")))
    return both.withColumn("preview", F.array_join("preview", "|", "NULL"))


oracle("inspect_table", """
WITH o AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5),
p AS (SELECT string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS o_orderkey,
  string_agg(CAST(o_custkey AS VARCHAR), '|' ORDER BY o_orderkey) AS o_custkey,
  string_agg(o_orderstatus, '|' ORDER BY o_orderkey) AS o_orderstatus,
  string_agg(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY o_orderkey) AS o_orderdate,
  string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS o_orderpriority,
  string_agg(o_orderpriority || ' é', '|' ORDER BY o_orderkey) AS accented FROM o),
n AS (SELECT count(*) AS row_count FROM orders)
SELECT c.column_name, c.column_type, CAST(c.position AS BIGINT) AS position, row_count, c.encoding, c.preview, c.source FROM n, (
 SELECT 'o_orderkey' AS column_name, 'int' AS column_type, 1 AS position, o_orderkey AS preview, 'ISO-8859-1' AS encoding, 'csv' AS source FROM p
 UNION ALL SELECT 'o_custkey', 'int', 2, o_custkey, 'ISO-8859-1', 'csv' FROM p
 UNION ALL SELECT 'o_orderstatus', 'string', 3, o_orderstatus, 'ISO-8859-1', 'csv' FROM p
 UNION ALL SELECT 'o_orderpriority', 'string', 4, accented, 'ISO-8859-1', 'csv' FROM p
 UNION ALL SELECT 'o_orderkey', 'bigint', 1, o_orderkey, 'auto', 'parquet' FROM p
 UNION ALL SELECT 'o_custkey', 'bigint', 2, o_custkey, 'auto', 'parquet' FROM p
 UNION ALL SELECT 'o_orderstatus', 'string', 3, o_orderstatus, 'auto', 'parquet' FROM p
 UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', 4, o_orderdate, 'auto', 'parquet' FROM p
 UNION ALL SELECT 'o_orderpriority', 'string', 5, o_orderpriority, 'auto', 'parquet' FROM p) c""")


@query("column_profile")
def q_column_profile(spark, sf):
    return sqlapi.column_profile(spark.read.parquet(f"{sf}/customer.parquet"))


oracle("column_profile", """
WITH s AS (SELECT count(*) AS total, avg(c_custkey) AS promedio, min(c_custkey) AS min_v, max(c_custkey) AS max_v FROM customer),
t AS (SELECT c_name AS value, count(*) AS cantidad FROM customer GROUP BY c_name ORDER BY cantidad DESC, value LIMIT 10)
SELECT 'c_custkey' AS numeric_column, 'c_name' AS text_column, t.value, t.cantidad, s.total,
 s.promedio, CAST(s.min_v AS DOUBLE) AS min_v, CAST(s.max_v AS DOUBLE) AS max_v FROM t, s""")


@query("sql_asof_join")
def q_sql_asof_join(spark, sf):
    load_tables(spark, sf, ("events",))
    ev = spark.table("events")
    left = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = ev.where(F.col("event_type") == "view").select("user_id", "ts",
                                                          F.col("event_id").alias("view_id"))
    j = asof.asof_join(left, right, "user_id", "ts", ["view_id"])
    return j.select("event_id", "user_id", "ts", F.col("r_view_id").alias("view_id"),
                    F.col("r_rts").alias("view_ts"))


oracle("sql_asof_join", """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, event_id AS view_id FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, p.ts, v.view_id, v.ts AS view_ts
FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
