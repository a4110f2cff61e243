import datetime as dt
import random

import numpy as np
import pytest

from mirador.operators import incremental
from mirador.session import scratch_path
from mirador.sources import versions
from mirador.streaming import jobs, landing, outage
from mirador.streaming.updates import UpdateLog

BASE = dt.datetime(2024, 1, 1)
OUTCOME = "user_id long, event_id long, ts timestamp_ntz, ok boolean"


def one_by_one(outcomes):
    """The circuit rules outcome by outcome: [(ts_us, ok)] -> [(allowed, state)]."""
    opened, failures, successes, out = None, 0, 0, []
    for ts, ok in outcomes:
        half = opened is not None and ts - opened >= 60_000_000
        if opened is not None and not half:
            out.append((False, "open"))
            continue
        if half and ok:
            successes += 1
            if successes == 2:
                opened, failures, successes = None, 0, 0
            out.append((True, "closed" if opened is None else "half_open"))
        elif half:
            opened, successes = ts, 0
            out.append((True, "open"))
        elif ok:
            failures = 0
            out.append((True, "closed"))
        else:
            failures += 1
            opened = ts if failures == 5 else None
            out.append((True, "open" if opened is not None else "closed"))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_give_what_single_outcomes_give(seed):
    rng = random.Random(seed)
    for _ in range(60):
        t, rows, ok = 0, [], True
        for _ in range(rng.randrange(0, 120)):
            ok = ok if rng.random() < 0.8 else not ok
            t += rng.choice([0, 1, 9, 20, 59, 60, 61, 200]) * 1_000_000
            rows.append((t, ok))
        ts, oks = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], bool)
        cut = rng.randrange(0, len(rows) + 1)                   # state carried over a cut
        a1, s1, state = outage.fold(outage.START, ts[:cut], oks[:cut])
        a2, s2, _ = outage.fold(state, ts[cut:], oks[cut:])
        got = list(zip(np.append(a1, a2).astype(bool).tolist(), outage.NAMES[np.append(s1, s2).astype(int)].tolist()))
        assert got == one_by_one(rows)


def late_rows(rng, n, hours):
    rows = [(rng.randrange(3), i, BASE + dt.timedelta(seconds=90 * i + rng.randrange(60)), rng.random() < 0.6) for i in range(n)]
    return [(*r, int((r[2] - BASE).total_seconds()) + rng.randrange(hours * 3600)) for r in rows]


def test_late_outcomes_give_the_batch_decisions(spark):
    rows = late_rows(random.Random(1), 900, 10)
    df = spark.createDataFrame(rows, OUTCOME + ", arrival long")
    src, out = scratch_path(spark, "outage-src"), scratch_path(spark, "outage-out")
    jobs.land_in_chunks(df, src, "arrival", 5)
    done = jobs.outage_stream(spark, src, out, OUTCOME, "user_id", "12 hours")
    streamed = spark.read.parquet(done).collect()
    batch = {(r.user_id, r.event_id): (r.decision, r.state) for r in jobs.outage_batch(df, "user_id").collect()}
    assert len(streamed) == len(rows)
    assert {(r["key"], r.event_id): (r.decision, r.state) for r in streamed} == batch
    # settled outcomes leave the state store: none older than the last watermark is pending
    held = spark.read.format("statestore").option("stateVarName", "pending").load(f"{out}/_checkpoint")
    ts = [r["list_element"]["ts"] for r in held.collect()]
    newest = max(int((r[2] - dt.datetime(1970, 1, 1)).total_seconds()) for r in rows) * 1_000_000
    assert ts and min(ts) >= newest - 13 * 3_600_000_000


def test_late_rows_give_the_batch_streaks(spark):
    rows = [(k, i, t, not ok, a) for k, i, t, ok, a in late_rows(random.Random(2), 600, 10)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, failed boolean, arrival long")
    src, out = scratch_path(spark, "fail-src"), scratch_path(spark, "fail-out")
    jobs.land_in_chunks(df, src, "arrival", 6)
    log = jobs.failure_state(spark, src, out, "user_id long, event_id long, ts timestamp_ntz, failed boolean", "user_id", "12 hours")
    got = {tuple(r) for r in jobs.final_failure_state(log, "user_id", "2024-02-01 00:00:00").collect()}
    want = incremental.failure_streak(df.drop("arrival"), "user_id", "2024-02-01 00:00:00")
    assert got == {tuple(r) for r in want.select(*jobs.final_failure_state(log, "user_id", "2024-02-01 00:00:00").columns).collect()}


def test_expired_urls_leave_the_state_and_the_log(spark):
    rows = [("c", "gone", BASE, 0, 1, 200)] + [("c", f"u{i % 5}", BASE + dt.timedelta(hours=i), i + 1, 1, 200) for i in range(120)]
    schema = "catalog_id string, url string, checked_at timestamp_ntz, event_id bigint, latency_ms bigint, status int"
    src, out = scratch_path(spark, "health-src"), scratch_path(spark, "health-out")
    jobs.land_in_chunks(spark.createDataFrame(rows, schema), src, "event_id", 10)
    read = jobs.latest_health(spark, src, out, schema, "2024-01-05 23:30:00", 24)
    assert sorted(r.url for r in read().collect()) == [f"u{i}" for i in range(5)]
    held = spark.read.format("statestore").load(f"{out}/_checkpoint").select("key.url", "key.window").distinct().collect()
    assert "gone" not in {r.url for r in held} and len(held) <= 5 * (24 // 6 + 3)
    base = spark.read.parquet(versions.current(spark, f"{out}/updates/base"))
    assert base.where("url = 'gone'").count() == 0
    assert len(versions.listed(spark, f"{out}/updates/delta")) < 8


def test_update_log_keeps_the_last_row(spark):
    log = UpdateLog(spark, scratch_path(spark, "log"), "k long, v string", ["k"], every=3)
    for batch in range(7):
        rows = [(k, f"{batch}") for k in range(batch, batch + 3)]
        log.add(spark.createDataFrame(rows, "k long, v string"), batch)
        log.add(spark.createDataFrame(rows, "k long, v string"), batch)           # replayed
    assert {(r.k, r.v) for r in log.read().collect()} == {(k, str(min(k, 6))) for k in range(9)}
    assert len(log.deltas()) < 3


def test_landing_is_whole_chunks_in_order(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    path = scratch_path(spark, "landed")
    landing.land_in_chunks(df, path, "k", 4, files=3)
    fs, p = versions.path_of(spark, path)
    found = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p))
    assert len(found) == 12 and [n[:5] for _, n in found] == [f"{i:05d}" for i in range(4) for _ in range(3)]
    assert spark.read.parquet(path).count() == 1000
    few = scratch_path(spark, "few")
    landing.land_in_chunks(spark.createDataFrame([(1,), (5,)], "k long"), few, "k", 2, files=4)
    assert len(versions.listed(spark, few)) == 8 and spark.read.parquet(few).count() == 2


def test_versions_switch_last(spark):
    path = scratch_path(spark, "versions")
    schema = "k long"
    assert versions.load(spark, path, schema).count() == 0
    versions.save(spark.range(3).withColumnRenamed("id", "k"), path)

    def broken(folder):
        spark.range(9).write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        versions.publish(spark, path, broken)
    assert versions.load(spark, path, schema).count() == 3
    for n in (4, 5, 6):
        versions.save(spark.range(n).withColumnRenamed("id", "k"), path)
    assert versions.load(spark, path, schema).count() == 6 and len(versions.entries(spark, path)) == 2


def test_files_of_a_chunk_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(landing, "ROWS_A_FILE", 100)
    path = scratch_path(spark, "landed-many")
    files = landing.land_in_chunks(spark.range(4_000).withColumnRenamed("id", "k"), path, "k", 4)
    names = sorted(n for n in versions.listed(spark, path) if n.endswith(".parquet"))
    assert files == 10 and [sum(n.startswith(f"{c:05d}-") for n in names) for c in range(4)] == [10] * 4
    assert spark.read.parquet(path).count() == 4_000
