"""Rules that a query's oracle cannot show: odd inputs, large batches, carried state."""

import datetime as dt

import pytest

import __spark_entry__ as E
from mirador.fixtures import view
from mirador.operators import audit, incremental, search, series, sqlapi, vectors
from mirador.streaming import jobs
from tests.conftest import SF_SMALL
from tests.test_plans import plan_of

DAY = dt.datetime(2026, 1, 1)


def test_descriptions_are_whole_texts(spark):
    d = view(spark, SF_SMALL, "v_datasets").where("doc_id % 7 > 1")
    t = spark.table("documents").withColumnRenamed("doc_id", "i")
    assert d.join(t, d.doc_id == t.i).where("description <> text").count() == 0


def test_checks_cover_the_same_share_of_documents_at_every_size(spark):
    for sf in (SF_SMALL, SF_SMALL.replace("0.001", "0.01")):
        r = view(spark, sf, "v_resources").select("doc_id").distinct().count()
        c = view(spark, sf, "v_checks").select("url").distinct().join(
            view(spark, sf, "v_resources"), "url").select("doc_id").distinct().count()
        assert 0.8 <= c / r < 0.95


def test_resources_are_made_without_a_nested_loop(spark):
    assert "NestedLoop" not in plan_of(view(spark, SF_SMALL, "v_resources"))


def test_kept_scores_are_carried_through_two_runs(spark):
    cur = spark.createDataFrame([("c", "a", DAY), ("c", "b", DAY)], "catalog_id string, external_id string, modified_at timestamp")
    prev = spark.createDataFrame([("c", "a", DAY, DAY, 0.7)], "catalog_id string, external_id string, "
                                 "prev_modified_at timestamp, last_scored_at timestamp, prev_overall double")
    scored = spark.createDataFrame([("c", "b", 0.4)], "catalog_id string, external_id string, overall double")
    one = incremental.merge_scores(incremental.diff_runs(cur, prev, str(DAY)), scored, str(DAY))
    assert {r.external_id: r.overall for r in one.collect()} == {"a": 0.7, "b": 0.4}
    again = one.selectExpr("catalog_id", "external_id", "modified_at prev_modified_at", "last_scored_at", "overall prev_overall")
    two = incremental.merge_scores(incremental.diff_runs(cur, again, str(DAY)), scored.limit(0), str(DAY))
    assert {(r.external_id, r.overall, r.origin) for r in two.collect()} == {("a", 0.7, "kept"), ("b", 0.4, "kept")}


def test_a_success_clears_the_last_failure(spark):
    o = spark.createDataFrame([(1, DAY, 1, True), (1, DAY, 2, False), (2, DAY, 3, False), (2, DAY, 4, True)],
                              "k long, ts timestamp, event_id long, failed boolean")
    got = {r.k: (r.consecutive_failures, r.last_failure) for r in incremental.failure_streak(o, "k", str(DAY)).collect()}
    assert got == {1: (0, None), 2: (1, DAY)}


def test_sweep_keeps_undated_records_where_asked(spark):
    s = spark.createDataFrame([("c", "x", None), ("c", "y", DAY)], "catalog_id string, id string, modified_at timestamp")
    p = spark.createDataFrame([("c", "fresh", dt.datetime(1970, 1, 1))], "catalog_id string, action string, start_cursor timestamp")
    assert [r.id for r in incremental.sweep_chunk(s, p, 5).collect()] == ["y"]
    assert [r.id for r in incremental.sweep_chunk(s, p, 5, keep_undated=True).orderBy("idx").collect()] == ["y", "x"]


def test_landing_keeps_rows_without_a_key(spark, tmp_path):
    df = spark.createDataFrame([(1,), (None,), (9,)], "k long")
    jobs.land_in_chunks(df, str(tmp_path / "a"), "k", 2)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3


def test_backslash_in_a_query(spark):
    d = spark.createDataFrame([("1", "c", r"a\b title", None, None, None)],
                              "id string, catalog_id string, title string, description string, organization string, tags array<string>")
    got = search.like_fallback(d, [(1, r"a\b"), (2, "zz\\")]).collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "1")]


def test_malformed_date_is_null(spark):
    p = spark.createDataFrame([("p", '{"data": [["2024-13-99", 1], ["2024-01-02", 2]], "meta": []}')], "payload_id string, payload string")
    assert [r.date for r in series.parse_series_payloads(p).orderBy("value").collect()] == [None, dt.date(2024, 1, 2)]


def test_null_versions_keep_the_row(spark):
    base = spark.createDataFrame([(1, 0, [1.0])], "id long, version int, v array<double>")
    batch = spark.createDataFrame([(1, None, [2.0])], "id long, version int, v array<double>")
    assert vectors.vector_upsert(base, batch, "id", "v").first().v == [2.0]


def test_vector_batches_over_many_blocks_with_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 50)
    v = spark.range(300).selectExpr("id", "array(1.0D, 0.0D) AS vector")
    q = spark.range(40).selectExpr("id AS query_id", "array(0.0D, 1.0D) AS vector")
    got = vectors.vector_topk(v, q, 3).collect()
    assert len(got) == 120 and {r.id for r in got} == {0, 1, 2}


@pytest.mark.parametrize("json,reason", [
    ('{"timestamp": "2024-01-01T00:00:00Z", "clientId": 5, "success": true, "type": "inspect"}', "bad_field_type"),
    ('{"timestamp": "2024-13-01T00:00:00Z", "clientId": "c", "success": true, "type": "inspect"}', "bad_timestamp"),
    ('{"timestamp": "2024-01-01T00:00:00Z", "clientId": "c", "success": true, "type": "inspect"}', None)])
def test_event_types_and_dates(spark, json, reason):
    assert audit.validate_events(spark.createDataFrame([(json,)], "json string")).first().reason == reason


def test_array_columns_are_not_numeric(spark):
    df = spark.createDataFrame([([1, 2], "x", 3.0)], "a array<int>, t string, n double")
    assert sqlapi.column_profile(df).first().numeric_column == "n"


def test_entry_without_the_training_data_folders(monkeypatch):
    import builtins
    real = builtins.__import__

    def no_llm(name, *args, **kw):
        if name in ("corpus_pipeline",) or name.startswith("mirador.llm"):
            raise ModuleNotFoundError(name=name.split(".queries")[0])
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", no_llm)
    assert E.training_data() == ({}, {}) and "score_overall" in E.queries()
