"""Time series queries over the v_series stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirador.fixtures import register_views
from mirador.functions import lookups as L
from mirador.operators import series
from mirador.plans.oracles import oracle
from mirador.plans.registry import query


def meta_and_points(spark, sf):
    register_views(spark, sf, ("v_series", "v_series_meta"))
    return spark.table("v_series_meta"), spark.table("v_series")


def freq_sql(expr: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.FREQUENCY_MAP.items())
    return f"(CASE {expr} {whens} ELSE {expr} END)"


@query("series_catalog")
def q_series_catalog(spark, sf):
    return series.series_catalog(meta_and_points(spark, sf)[0])


oracle("series_catalog", """WITH m AS (SELECT *, row_number() OVER (ORDER BY id) AS position FROM v_series_meta)
SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(min(position) AS BIGINT) AS first_position,
 string_agg(id, ',' ORDER BY position) AS ids FROM m GROUP BY category""", "v_series_meta")

SEARCH_Q = "pedidos URGENT"


@query("series_search")
def q_series_search(spark, sf):
    return series.series_search(meta_and_points(spark, sf)[0], SEARCH_Q)


oracle("series_search", f"""WITH h AS (SELECT id, title FROM v_series_meta
  WHERE {" AND ".join(f"contains(lower(concat_ws(' ', title, description)), '{w.lower()}')" for w in SEARCH_Q.split())})
SELECT id, title, (SELECT CAST(count(*) AS BIGINT) FROM h) AS total FROM h ORDER BY id LIMIT {L.SERIES_SEARCH_DEFAULT}""",
       "v_series_meta")


@query("series_frequency")
def q_series_frequency(spark, sf):
    m = meta_and_points(spark, sf)[0]
    return m.select("id", "frequency_raw", series.normalize_frequency(F.col("frequency_raw")).alias("frequency"))


oracle("series_frequency", f"SELECT id, frequency_raw, {freq_sql('frequency_raw')} AS frequency FROM v_series_meta",
       "v_series_meta")

RANGE = ("1996-01-01", "1997-06-30", 100)


@query("series_range")
def q_series_range(spark, sf):
    return series.series_range(meta_and_points(spark, sf)[1], *RANGE)


oracle("series_range", f"""WITH p AS (SELECT * FROM v_series WHERE date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY series_id) AS total FROM p)
SELECT series_id, date, value, CAST(rn AS BIGINT) AS rn, CAST(total AS BIGINT) AS total FROM r WHERE rn <= {RANGE[2]}""",
       "v_series")


@query("series_collapse")
def q_series_collapse(spark, sf):
    return series.series_collapse(meta_and_points(spark, sf)[1], "month", decimals=2)


oracle("series_collapse", """SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS period,
 CAST((sum(CAST(round(value * 100) AS BIGINT)) * 200 + count(value)) // (2 * count(value)) AS BIGINT) / CAST(10000.0 AS DOUBLE) AS avg,
 sum(CAST(round(value * 100) AS BIGINT)) / CAST(100.0 AS DOUBLE) AS sum, min(value) AS min, max(value) AS max,
 arg_max(value, date) FILTER (WHERE value IS NOT NULL) AS end_of_period, CAST(count(value) AS BIGINT) AS n_values
FROM v_series GROUP BY series_id, date_trunc('month', date)""", "v_series")


@query("series_info")
def q_series_info(spark, sf):
    m, p = meta_and_points(spark, sf)
    return series.series_info(m, p)


oracle("series_info", f"""SELECT m.id, m.title, {freq_sql('m.frequency_raw')} AS frequency, m.units, m.start_date, m.end_date,
 o.first_date, o.last_date, o.n_points, o.n_values FROM v_series_meta m LEFT JOIN
 (SELECT series_id, min(date) AS first_date, max(date) AS last_date, CAST(count(*) AS BIGINT) AS n_points,
   CAST(count(value) AS BIGINT) AS n_values FROM v_series GROUP BY series_id) o ON m.id = o.series_id""",
       "v_series", "v_series_meta")


def build_payloads(points):
    """Series API responses, one per (series, year), as JSON text (the landed form)."""
    pt = F.concat(F.lit('["'), F.date_format("date", "yyyy-MM-dd"), F.lit('",'),
                  F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit("]"))
    g = (points.withColumn("yr", F.year("date"))
         .groupBy("series_id", "yr")
         .agg(F.array_sort(F.collect_list(F.struct("date", pt.alias("p")))).alias("pts"),
              F.min("date").alias("sd"), F.max("date").alias("ed"), F.count(F.lit(1)).alias("n")))
    meta0 = F.struct(F.lit("R/P1D").alias("frequency"), F.date_format("sd", "yyyy-MM-dd").alias("start_date"),
                     F.date_format("ed", "yyyy-MM-dd").alias("end_date"),
                     F.lit(None).cast("struct<id:string,description:string,units:string>").alias("field"),
                     F.lit(None).cast("struct<title:string>").alias("distribution"),
                     F.lit(None).cast("struct<source:string,description:string,theme:array<string>>").alias("dataset"))
    meta1 = F.struct(F.lit(None).cast("string").alias("frequency"), F.lit(None).cast("string").alias("start_date"),
                     F.lit(None).cast("string").alias("end_date"),
                     F.struct(F.col("series_id").alias("id"),
                              F.when(F.col("series_id") < "3", F.concat(F.lit("Pedidos "), F.col("series_id")))
                              .alias("description"), F.lit("USD").alias("units")).alias("field"),
                     F.struct(F.concat(F.lit("Distribucion "), F.col("series_id")).alias("title")).alias("distribution"),
                     F.struct(F.lit("orders").alias("source"),
                              F.when(F.col("series_id") > "2", F.concat(F.lit("Pedidos por prioridad "), F.col("series_id")))
                              .alias("description"),
                              F.array(F.lit("comercio"), F.lit("ventas")).alias("theme")).alias("dataset"))
    meta = F.when(F.col("yr") % 3 == 0, F.array(meta0)).otherwise(F.array(meta0, meta1))
    payload = F.concat(F.lit('{"data":['), F.array_join(F.transform("pts", lambda s: s["p"]), ","),
                       F.lit('],"count":'), F.col("n").cast("string"), F.lit(',"meta":'), F.to_json(meta),
                       F.lit("}"))
    return g.select(F.concat(F.col("series_id"), F.lit(":"), F.col("yr").cast("string")).alias("payload_id"),
                    payload.alias("payload"))


@query("series_points_parse")
def q_series_points_parse(spark, sf):
    return series.parse_series_payloads(build_payloads(meta_and_points(spark, sf)[1]))


oracle("series_points_parse", """WITH y AS (SELECT series_id, year(date) AS yr, date, value FROM v_series),
g AS (SELECT series_id, yr, min(date) AS sd, max(date) AS ed FROM y GROUP BY series_id, yr)
SELECT y.series_id || ':' || CAST(y.yr AS VARCHAR) AS payload_id, y.date, y.value,
 CASE WHEN y.yr % 3 <> 0 THEN y.series_id END AS field_id,
 CASE WHEN y.yr % 3 <> 0 THEN coalesce(CASE WHEN y.series_id < '3' THEN 'Pedidos ' || y.series_id END, 'Distribucion ' || y.series_id) END AS title,
 CASE WHEN y.yr % 3 <> 0 AND y.series_id > '2' THEN 'Pedidos por prioridad ' || y.series_id END AS description,
 CASE WHEN y.yr % 3 <> 0 THEN 'daily' END AS frequency, CASE WHEN y.yr % 3 <> 0 THEN 'USD' END AS units,
 CASE WHEN y.yr % 3 <> 0 THEN 'orders' END AS source, CASE WHEN y.yr % 3 <> 0 THEN 'comercio' END AS theme,
 CASE WHEN y.yr % 3 <> 0 THEN CAST(g.sd AS VARCHAR) END AS start_date, CASE WHEN y.yr % 3 <> 0 THEN CAST(g.ed AS VARCHAR) END AS end_date
FROM y JOIN g ON y.series_id = g.series_id AND y.yr = g.yr""", "v_series")
