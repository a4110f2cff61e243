"""Edge cases of single operators on hand-made inputs."""

import datetime as dt

from pyspark.sql import functions as F

from mirador.operators import series, sqlapi, summary, vectors
from mirador.session import scratch_path
from mirador.sources import payloads, stores


def test_vector_upsert_all_or_nothing(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], "id long, v array<double>, version int")
    bad = spark.createDataFrame([(1, [5.0, 5.0], 1), (3, [1.0], 1)], "id long, v array<double>, version int")
    out = vectors.vector_upsert(base, bad, "id", "v", dim=2)
    assert sorted((r["id"], r["version"]) for r in out.collect()) == [(1, 0), (2, 0)]
    good = spark.createDataFrame([(1, [5.0, 5.0], 1), (1, [6.0, 6.0], 2), (3, [1.0, 1.0], 1)],
                                 "id long, v array<double>, version int")
    out = {r["id"]: (r["version"], list(r["v"])) for r in vectors.vector_upsert(base, good, "id", "v", dim=2).collect()}
    assert out == {1: (2, [6.0, 6.0]), 2: (0, [0.0, 1.0]), 3: (1, [1.0, 1.0])}


def test_charset_detection(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    text = "Año de publicación: 2024"
    (folder / "1.txt").write_bytes(text.encode("utf-8"))
    (folder / "2.txt").write_bytes(text.encode("latin-1"))
    (folder / "3.txt").write_bytes(text.encode("utf-16"))
    (folder / "4.txt").write_bytes(b"\xef\xbb\xbf" + text.encode("utf-8"))
    (folder / "5.txt").write_bytes(b"plain ascii")
    got = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["text"]) for r in stores.charset_scan(spark, str(folder)).collect()}
    assert got["1.txt"] == ("UTF-8", text)
    assert got["2.txt"] == ("ISO-8859-1", text)
    assert got["3.txt"] == ("UTF-16", text)
    assert got["4.txt"] == ("UTF-8", text)
    assert got["5.txt"] == ("UTF-8", "plain ascii")


def test_median_even_and_odd(spark):
    rows = [("a", 1), ("a", 3), ("a", 10), ("a", 20), ("b", 5), ("b", 7), ("b", 100), ("c", None)]
    df = spark.createDataFrame(rows, "catalog_id string, days_since_modified bigint")
    got = {r["catalog_id"]: r["median_freshness_days"] for r in summary.median_freshness(df).collect()}
    assert got == {"a": 6.5, "b": 7.0, "c": None}


def test_paging_end_and_bounds(spark):
    q = spark.range(25).withColumnRenamed("id", "x").orderBy("x")
    last = sqlapi.paged(q, limit=10, offset=20).collect()
    assert [r["x"] for r in last] == list(range(20, 25)) and not last[0]["has_more"]
    assert sqlapi.paged(q, limit=10, offset=30).count() == 0
    assert sqlapi.clamp_limit(None) == 1000


def test_list_since_inclusive_and_undated(spark):
    ts = dt.datetime
    recs = spark.createDataFrame(
        [("a:1", "a", ts(2025, 6, 1)), ("a:2", "a", ts(2025, 5, 31)), ("a:3", "a", None),
         ("s:1", "s", None), ("s:2", "s", ts(2025, 7, 1))],
        "id string, catalog_id string, modified_at timestamp")
    out = payloads.list_since(recs, "2025-06-01 00:00:00", keep_undated=F.col("catalog_id") == "s")
    assert [r["id"] for r in out.collect()] == ["a:1", "s:2", "s:1"]


def test_protocol_detection_malformed(spark):
    df = spark.createDataFrame([(1, '{"success": true, "result": {"results": [{"metadata_language": "pt-BR"}]}}'),
                                (2, '{"success": "true"}'), (3, "{broken"),
                                (4, '{"resultSetSize": 0, "results": []}'),
                                (5, '{"success": true, "resultSetSize": 3}')], "k int, payload string")
    got = {r["k"]: (r["protocol"], r["language"]) for r in payloads.payload_protocol(df).collect()}
    assert got == {1: ("ckan", "pt"), 2: (None, None), 3: (None, None), 4: ("socrata", None), 5: ("ckan", None)}


def test_series_collapse_end_of_period_skips_nulls(spark):
    d = dt.date
    pts = spark.createDataFrame([("s", d(2024, 1, 1), 1.0), ("s", d(2024, 1, 15), 3.0), ("s", d(2024, 1, 31), None),
                                 ("s", d(2024, 2, 1), None)], "series_id string, date date, value double")
    got = {r["period"]: r for r in series.series_collapse(pts, "month").collect()}
    jan = got[d(2024, 1, 1)]
    assert jan["avg"] == 2.0 and jan["sum"] == 4.0 and jan["end_of_period"] == 3.0 and jan["n_values"] == 2
    assert got[d(2024, 2, 1)]["end_of_period"] is None


def test_scratch_paths_are_fresh(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and spark.sparkContext.getCheckpointDir() in a


def test_outage_stream_equals_batch_twin(spark):
    from mirador.streaming import jobs
    base = dt.datetime(2024, 1, 1)
    rows = [(k, i, base + dt.timedelta(seconds=13 * i), (i * 7 + k) % 5 != 0 and (i // 9) % 3 != 1)
            for i in range(240) for k in (1, 2)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, ok boolean")
    src, out = scratch_path(spark, "outage-src"), scratch_path(spark, "outage-out")
    jobs.land_in_chunks(df, src, "event_id", 3)
    target = jobs.outage_stream(spark, src, out, "user_id long, event_id long, ts timestamp_ntz, ok boolean", "user_id")
    streamed = {(r["key"], r["event_id"]): (r["decision"], r["state"]) for r in spark.read.parquet(target).collect()}
    batch = {(r["user_id"], r["event_id"]): (r["decision"], r["state"])
             for r in jobs.outage_batch(df, "user_id", 2).collect()}
    assert streamed == batch and len(batch) == len(rows)


def test_entries_missing_or_corrupt(spark):
    path = scratch_path(spark, "entries")
    assert stores.entries_read(spark, path).count() == 0
    lines = spark.createDataFrame(
        [('{"catalog_id": "a", "external_id": "1", "overall": 0.5}',), ('{"catalog_id": "a", "external_',)], "value string")
    stores.state_write_lines(lines, path)
    got = stores.entries_read(spark, path).collect()
    assert [(r["external_id"], r["overall"]) for r in got] == [("1", 0.5)]


def test_session_sql_accepts_double_quoted_identifiers(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("nombre,edad\nAna,30\n")
    s = sqlapi.SqlSession.open(spark)
    s.add_table("gente", str(p))
    assert s.sql('SELECT AVG("edad") AS promedio FROM gente').first()["promedio"] == 30.0


def test_hybrid_vector_query_invariants(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    from mirador.sources import records
    rows = E.queries()["hybrid_search_vector"](spark, SF_SMALL).collect()
    assert rows and all(r["mode"] == "hybrid" for r in rows)
    ds = {r["id"]: r for r in records.datasets(spark, SF_SMALL).collect()}
    fmts = {}
    for r in records.resources(spark, SF_SMALL).collect():
        fmts.setdefault(r["dataset_id"], set()).add((r["format"] or "").lower())
    by_q = {}
    for r in rows:
        d = ds[r["id"]]
        assert d["organization"] and "org 1" in d["organization"].lower()
        assert "csv" in fmts.get(r["id"], set()) and "en" in [t.lower() for t in d["tags"]]
        by_q.setdefault(r["query_id"], []).append(r)
    for q, rs in by_q.items():
        ranked = sorted(rs, key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(rs) + 1)) and len(rs) <= 10
        assert all(a["score"] >= b["score"] for a, b in zip(ranked, ranked[1:]))
