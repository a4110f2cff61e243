"""Time series: catalog, search, frequency names, ranges, collapse, info and
the parser of series API payloads. Points are (series_id, date, value) rows;
every operator groups by series (and period), never by the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions.columns import int_div
from mirador.operators.numbering import numbered


def normalize_frequency(raw: Column) -> Column:
    m = F.create_map(*[x for k, v in L.FREQUENCY_MAP.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, raw), raw)


def clamp(n: int | None, default: int, hi: int) -> int:
    return default if n is None else max(1, min(int(n), hi))


def series_catalog(meta: DataFrame) -> DataFrame:
    """Series grouped by category in first-seen order (position), with counts."""
    m = numbered(meta.select("id", "category"), [], [F.col("id")], "position")
    return (m.groupBy("category")
            .agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"),
                 F.array_sort(F.collect_list(F.struct("position", "id"))).alias("members"))
            .select("category", F.col("n").cast("bigint").alias("n"),
                    F.col("first_position").cast("bigint").alias("first_position"),
                    F.array_join(F.transform("members", lambda s: s["id"]), ",").alias("ids")))


def series_search(meta: DataFrame, q: str, limit: int | None = None) -> DataFrame:
    """All words of ``q`` in title or description (case-insensitive), by id, with the total."""
    n = clamp(limit, L.SERIES_SEARCH_DEFAULT, L.SERIES_SEARCH_MAX)
    words = [w.lower() for w in q.split() if w]
    text = F.lower(F.concat_ws(" ", F.col("title"), F.col("description")))
    hit = meta
    for w in words:
        hit = hit.where(text.contains(w))
    # the first rows and the count in one lazy plan: both sides are one row
    first = hit.orderBy("id").limit(n).agg(F.collect_list(F.struct("id", "title")).alias("rows"), F.lit(None).cast("bigint").alias("total"))
    total = hit.agg(F.lit(None).cast(first.schema["rows"].dataType).alias("rows"), F.count(F.lit(1)).alias("total"))
    both = first.unionByName(total).agg(F.first("rows", ignorenulls=True).alias("rows"), F.max("total").alias("total"))
    return both.select(F.explode(F.array_sort("rows")).alias("r"), "total").select("r.id", "r.title", "total")


def series_range(points: DataFrame, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Points of each series between start and end (inclusive), first ``limit`` by date,
    with the number available in the range."""
    n = clamp(limit, L.SERIES_DEFAULT_LIMIT, L.SERIES_MAX_LIMIT)
    p = points.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    w = Window.partitionBy("series_id").orderBy("date")
    ranked = p.withColumn("rn", F.row_number().over(w))
    total = p.groupBy("series_id").agg(F.count(F.lit(1)).alias("total"))
    return ranked.where(F.col("rn") <= n).join(total, "series_id") \
        .select("series_id", "date", "value", F.col("rn").cast("bigint").alias("rn"),
                F.col("total").cast("bigint").alias("total"))


def series_collapse(points: DataFrame, period: str, decimals: int | None = None) -> DataFrame:
    """Collapse to day/month/quarter/year: avg, sum, min, max, and end of period (the
    value at the latest date with a value). Nulls are ignored; all partial aggregates.

    With ``decimals`` (values known to have that many decimals, e.g. money), sum
    and mean are exact: integer units are summed and the mean is rounded half up
    to ``decimals + 2`` places by integer division, independent of merge order.
    """
    p = points.withColumn("period", F.date_trunc(period, F.col("date")).cast("date"))
    v = F.col("value")
    if decimals is None:
        avg, total = F.round(F.avg(v), 4), F.round(F.sum(v), 4)
    else:
        scale = 10 ** decimals
        units = F.sum(F.round(v * scale).cast("bigint"))
        n = F.count(v)
        avg = int_div(units * 200 + n, n * 2) / float(scale * 100)
        total = units / float(scale)
    return p.groupBy("series_id", "period").agg(
        avg.alias("avg"), total.alias("sum"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.max_by(v, F.when(v.isNotNull(), F.col("date"))).alias("end_of_period"),
        F.count(v).cast("bigint").alias("n_values"))


def series_info(meta: DataFrame, points: DataFrame) -> DataFrame:
    """Metadata with the stated and the observed period of each series."""
    obs = points.groupBy("series_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count(F.lit(1)).cast("bigint").alias("n_points"), F.count("value").cast("bigint").alias("n_values"))
    return meta.join(obs, meta["id"] == obs["series_id"], "left").select(
        "id", "title", normalize_frequency(F.col("frequency_raw")).alias("frequency"), "units",
        "start_date", "end_date", "first_date", "last_date", "n_points", "n_values")


# ------------------------------------------------------------------ payloads
PAYLOAD_SCHEMA = (
    "data array<array<string>>, count bigint, "
    "meta array<struct<frequency:string,start_date:string,end_date:string,"
    "field:struct<id:string,description:string,units:string>,"
    "distribution:struct<title:string>,"
    "dataset:struct<source:string,description:string,theme:array<string>>>>")


def parse_series_payloads(payloads: DataFrame, id_col: str = "payload_id",
                          json_col: str = "payload") -> DataFrame:
    """Series API responses -> one row per point with the response's metadata.

    Metadata is taken only when ``meta`` has at least two entries (temporal
    first, field second); the title is the field description, else the
    distribution title. Values that are not numbers and dates that are none become null.
    """
    j = payloads.select(id_col, F.from_json(F.col(json_col), PAYLOAD_SCHEMA).alias("r"))
    has_meta = F.size("r.meta") >= 2
    t = F.col("r.meta")[0]
    f = F.col("r.meta")[1]
    meta_cols = [
        F.when(has_meta, f["field"]["id"]).alias("field_id"),
        F.when(has_meta, F.coalesce(F.when(f["field"]["description"] != "", f["field"]["description"]),
                                    f["distribution"]["title"])).alias("title"),
        F.when(has_meta, f["dataset"]["description"]).alias("description"),
        F.when(has_meta, normalize_frequency(F.coalesce(t["frequency"], F.lit("")))).alias("frequency"),
        F.when(has_meta, f["field"]["units"]).alias("units"),
        F.when(has_meta, f["dataset"]["source"]).alias("source"),
        F.when(has_meta, F.try_element_at(f["dataset"]["theme"], F.lit(1))).alias("theme"),
        F.when(has_meta, t["start_date"]).alias("start_date"),
        F.when(has_meta, t["end_date"]).alias("end_date"),
    ]
    pts = j.select(id_col, *meta_cols, F.explode("r.data").alias("pt"))
    return pts.select(id_col, F.col("pt")[0].try_cast("date").alias("date"),
                      F.col("pt")[1].try_cast("double").alias("value"),
                      *[c for c in pts.columns if c not in (id_col, "pt")])
