"""Fallback rows, sessions in the query log, sweep state between runs."""

import datetime as dt

from pyspark.sql import functions as F

from mirador.operators import audit, incremental

FIELDS = ("catalog_id string, status string, dataset_count bigint, resource_count bigint, datasets_scored bigint, overall double, "
          "accessibility double, structure double, freshness double, completeness double, usability double, accessible_pct double, "
          "median_freshness_days double, top_formats array<string>, coverage double, tier string, scored_at timestamp")


def summary(catalog, n, at, status="ok"):
    return (catalog, status, n, n, n, 0.5, 0.5, 0.5, 0.5, 0.5, 0.0, 1.0, 3.0, ["csv"], 1.0, "detail", at)


def test_every_catalog_has_a_summary(spark):
    now, then = dt.datetime(2026, 1, 1), dt.datetime(2025, 6, 1)
    cats = spark.createDataFrame([(c, c.upper(), "es", "aggregate") for c in "abc"], "id string, name string, language string, tier string")
    cur = spark.createDataFrame([summary("a", 1, now)], FIELDS)
    prev = spark.createDataFrame([summary("a", 9, then), summary("b", 2, then, "failed")], FIELDS)
    got = {r.id: r for r in incremental.summary_fallback(cats, cur, prev, "2026-01-02 00:00:00").collect()}
    assert (got["a"].dataset_count, got["a"].scored_at, got["a"].language) == (1, now, "es")
    assert (got["b"].dataset_count, got["b"].scored_at, got["b"].status) == (2, then, "failed")
    c = got["c"]
    assert (c.status, c.dataset_count, c.usability, c.median_freshness_days, c.top_formats, c.tier, c.scored_at) == \
        ("pending", 0, 0.0, None, [], "aggregate", dt.datetime(2026, 1, 2))


def test_temp_tables_of_a_session(spark):
    texts = [(1, "a", "CREATE TEMP TABLE t1 AS SELECT * FROM datos"), (2, "a", 'create temporary table if not exists "T2" as select 1'),
             (3, "a", "SELECT * FROM t2"), (4, "b", "SELECT * FROM t2"), (5, "a", "CREATE TEMP TABLE datos AS SELECT 1"),
             (6, "a", "CREATE TEMP TABLE t1 AS SELECT 2"), (7, "a", "CREATE TEMP TABLE t3 AS SELECT 2"), (0, "a", "SELECT * FROM t1"),
             (8, "a", "SELECT * FROM t3"), (9, "b", "CREATE TEMP TABLE datos AS SELECT 1"), (10, "a", "SELECT 't1' FROM nothing")]
    log = spark.createDataFrame([(i, s, q) for i, s, q in texts], "at int, session string, sql string")
    got = {r["at"]: r.verdict for r in audit.audit_log(log, ["datos"], "session", ["at"], 2).collect()}
    assert got == {0: "missing_table", 1: "create_temp:t1", 2: "create_temp:t2", 3: "ok", 4: "missing_table", 5: "temp_limit",
                   6: "temp_limit", 7: "temp_limit", 8: "missing_table", 9: "reserved_table_name", 10: "ok"}


def test_a_text_field_with_a_number(spark):
    rows = [(f, f'{{"timestamp": "2024-01-01T00:00:00Z", "clientId": "c", "success": true, "type": "inspect", "{f}": 5}}')
            for f in audit.STRING_FIELDS if f not in ("timestamp", "clientId")]
    got = {r.f: r.reason for r in audit.validate_events(spark.createDataFrame(rows, "f string, json string")).collect()}
    assert set(got.values()) == {"bad_field_type"} and {"id", "catalogId", "datasetId", "resourceUrl", "format"} <= set(got)


def test_a_sweep_s_state_feeds_the_next(spark):
    day = dt.datetime(2025, 1, 1)
    cats = spark.createDataFrame([("a",)], "id string")
    recs = spark.createDataFrame([("a", f"r{i}", day + dt.timedelta(days=i), 0.5, 0.5, 0.5, 0.5) for i in range(7)],
                                 "catalog_id string, id string, modified_at timestamp, accessibility double, structure double, "
                                 "freshness double, completeness double")
    state = spark.createDataFrame([], "catalog_id string, complete boolean, last_complete_sweep timestamp, cursor timestamp, "
                                      "processed_count bigint, total_known bigint")
    seen = []
    for run in range(4):
        as_of = f"2026-01-0{run + 1} 00:00:00"
        plan = incremental.sweep_plan(cats, state, as_of)
        chunk = incremental.sweep_chunk(recs, plan, 4)
        new = incremental.sweep_state(plan, chunk, 4, as_of)
        state = spark.createDataFrame(new.collect(), new.schema)
        r = state.first()
        seen.append((r.action, r.chunk_count, r.complete, r.last_complete_sweep))
    assert seen == [("fresh", 4, False, None), ("resume", 4, False, None), ("resume", 1, True, dt.datetime(2026, 1, 3)),
                    ("skip", 0, True, dt.datetime(2026, 1, 3))]
    everything = incremental.sweep_chunk(recs, incremental.sweep_plan(cats, state.limit(0), "2026-01-01 00:00:00"), 0)
    assert [r.idx for r in everything.orderBy("modified_at").collect()] == list(range(7))
    assert everything.where(F.col("with_access")).count() == 1


def test_far_pages_equal_near_ones(spark, monkeypatch):
    from mirador.operators import ranking
    rows = [(f"c:{i}", f"title {i % 7}" if i % 5 else "", None if i % 4 == 0 else f"org {i % 3}", (i * 37 % 11) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, title string, organization string, overall double").repartition(5)
    for sort in ("overall", "title", "organization"):
        for page in (0, 3, 14, 40):
            near = ranking.dataset_list_page(df, "c:", sort, page).collect()
            with monkeypatch.context() as m:
                m.setattr(ranking, "DEEP_ROWS", 0)
                assert ranking.dataset_list_page(df, "c:", sort, page).collect() == near
