"""Structured Streaming jobs with batch twins.

Each job reads a file stream (``availableNow`` trigger, so it drains what has
landed and stops), keeps its state in the streaming state store, writes each
micro-batch idempotently to its own folder, and has a checkpoint in the shared
folder, so a lost executor or a restarted driver resumes where the checkpoint
says.

* ``event_ingest``: usage events validated and routed to good / rejected.
* ``sweep_totals``: running {sum, count} per (catalog, dimension).
* ``latest_health``: latest observation per (catalog, url) as a streaming
  ``max_by`` aggregation whose state and update log expire with the TTL.
* ``failure_state`` / ``outage_stream``: keyed state (``transformWithState``) with the
  outcomes that a late one may still change, settled behind the watermark.
* ``outage_batch``: the batch twin, folded in independent segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.operators import audit, health, incremental
from mirador.session import scratch_path
from mirador.sources import versions
from mirador.streaming import failures, landing, outage
from mirador.streaming.landing import land_in_chunks  # noqa: F401 - part of this module's interface
from mirador.streaming.updates import UpdateLog


def write_batch(df: DataFrame, target: str, batch_id: int, partition_by: str | None = None) -> None:
    """Idempotent micro-batch sink: each batch owns ``target/batch=<id>`` and is
    written in overwrite mode, so a batch replayed after a failure (foreachBatch
    is at-least-once) replaces its own output instead of duplicating it."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(f"{target}/batch={batch_id}")


def run_available_now(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                      mode: str = "append") -> None:
    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------------------ event ingest
def event_ingest(spark: SparkSession, source: str, out: str, schema, files: int = landing.FILES) -> dict[str, str]:
    """Validate landed usage events (JSON text in column ``json``) and route them."""
    paths = {"routed": f"{out}/routed"}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one idempotent write routes both outputs (valid=true / valid=false folders)
        write_batch(audit.validate_events(batch), out + "/routed", batch_id, partition_by="valid")

    run_available_now(stream, sink, f"{out}/_checkpoint")
    return paths


# ------------------------------------------------------------------ running totals
def sweep_totals(spark: SparkSession, source: str, out: str, schema: str, files: int = landing.FILES) -> UpdateLog:
    """Running per (catalog, dimension) exact sums (thousandths) and counts: update mode, so a
    micro-batch emits only the totals that it changed."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score"))
                     for d in ("accessibility", "structure", "freshness", "completeness")])
    long = stream.select("catalog_id", F.explode(dims).alias("d"))
    agg = long.groupBy("catalog_id", F.col("d.dimension").alias("dimension")).agg(
        F.sum(F.round(F.col("d.score") * 1000).cast("bigint")).alias("sum_milli"),
        F.count(F.lit(1)).alias("count"))
    log = UpdateLog(spark, f"{out}/totals", "catalog_id string, dimension string, sum_milli bigint, count bigint",
                    ["catalog_id", "dimension"])
    run_available_now(agg, log.add, f"{out}/_checkpoint", mode="update")
    return log


# ------------------------------------------------------------------ latest health
HEALTH_OUT = "catalog_id string, url string, status int, latency_ms bigint, checked_at timestamp_ntz, event_id bigint"
HEALTH_WINDOW_HOURS = 6        # a URL has one state row for each window within the TTL


def latest_health(spark: SparkSession, source: str, out: str, schema: str, as_of: str,
                  ttl_hours: float = L.HEALTH_TTL_HOURS, files: int = landing.FILES) -> Callable[[], DataFrame]:
    """Latest observation per (catalog, url), with state and log bounded by the live URLs.

    A streaming ``max_by`` per (catalog, url, time window) in update mode, under a watermark of
    the TTL: the state of a window goes when all of it is older than the TTL, and so does a URL
    that is no longer checked. Observations that come later than that are stale anyway. The
    update log keeps the last row per key and drops expired ones when it is compacted."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source) \
        .withColumn("at", F.col("checked_at").cast("timestamp")).withWatermark("at", f"{int(ttl_hours * 3600)} seconds")
    latest = (stream.groupBy(F.window("at", f"{HEALTH_WINDOW_HOURS} hours"), "catalog_id", "url")
              .agg(F.max_by(F.struct("status", "latency_ms", "checked_at", "event_id"),
                            F.struct("checked_at", "event_id")).alias("h"))
              .select("catalog_id", "url", "h.status", "h.latency_ms", "h.checked_at", "h.event_id",
                      F.date_trunc("hour", F.col("window.start")).cast("timestamp_ntz").alias("since")))
    log = UpdateLog(spark, f"{out}/updates", HEALTH_OUT + ", since timestamp_ntz", ["catalog_id", "url", "since"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("checked_at")).first()[0]       # expiry by event time, one value
        alive = None if newest is None else F.col("checked_at") >= F.lit(newest) - F.make_interval(hours=F.lit(int(ttl_hours)))
        log.add(batch, batch_id, alive)

    run_available_now(latest, sink, f"{out}/_checkpoint", mode="update")

    def read() -> DataFrame:
        # the latest of a key's windows, then the TTL filter
        return health.health_latest_fresh(log.read(), as_of, ttl_hours)
    return read


# ------------------------------------------------------------------ keyed state machines
def failure_fold(rows: pd.DataFrame, st: tuple | None) -> tuple:
    """Fold outcomes (sorted by ts, event_id) into (consecutive, last_failure, events)."""
    consecutive, last_failure, events = st if st else (0, None, 0)
    for failed, ts in zip(rows["failed"], rows["ts"]):
        events += 1
        if failed:
            consecutive += 1
            last_failure = ts if last_failure is None or ts > last_failure else last_failure
        else:
            consecutive, last_failure = 0, None
    return consecutive, last_failure, events


FAILURE_OUT = "user_id long, consecutive_failures long, last_failure timestamp, events long"


def failure_state(spark: SparkSession, source: str, out: str, schema: str, key: str = "user_id",
                  lateness: str = "1 day", files: int = landing.FILES) -> UpdateLog:
    """Per key: consecutive failures (a success resets), last failure, events seen. Outcomes up to
    ``lateness`` behind the latest count in their place."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source) \
        .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    schema_out = FAILURE_OUT.replace("user_id", key)
    states = stream.groupBy(key).transformWithStateInPandas(failures.Failures(key), schema_out, "Update", "EventTime")
    log = UpdateLog(spark, f"{out}/updates", schema_out, [key])
    with rocksdb(spark):
        run_available_now(states, log.add, f"{out}/_checkpoint", mode="update")
    return log


def final_failure_state(log: UpdateLog, key: str, as_of: str) -> DataFrame:
    """The last update per key, with status and retry decision."""
    last = log.read()
    status = F.when(F.col("consecutive_failures") >= L.UNREACHABLE_AFTER_FAILURES, F.lit("unreachable")) \
        .otherwise(F.lit("ok"))
    days = incremental._age_us(as_of, F.col("last_failure")) / incremental.DAY_US
    return last.select(key, F.col("consecutive_failures").cast("bigint").alias("consecutive_failures"),
                       status.alias("status"), F.col("last_failure").cast("timestamp_ntz").alias("last_failure"),
                       ((status == "unreachable") & (days < L.RETRY_AFTER_DAYS)).alias("skip"),
                       F.col("events").cast("bigint").alias("events"))


# ------------------------------------------------------------------ outage (circuit) state
def new_outage_state() -> dict:
    return {"state": outage.START}


def outage_step(held: dict, ts_us: int, ok: bool) -> tuple[str, str]:
    """One outcome; returns (decision, state after)."""
    allowed, after, held["state"] = outage.fold(held["state"], np.array([ts_us]), np.array([ok]))
    return "allowed" if allowed[0] else "rejected", str(outage.NAMES[after[0]])


OUTAGE_OUT = "key long, event_id long, ts timestamp_ntz, decision string, state string"


def outage_segments(outcomes: DataFrame, key: str, bucket: str = "day") -> DataFrame:
    """Cut each key's outcome history into independent segments.

    An outcome is a sync point when it and the outcome before it are successes
    and that earlier success is at least the reset time after the key's last
    failure: whatever the state was, the first success is admitted (half-open or
    closed) and the second leaves the circuit closed with zero counts. So after a
    sync point the fold restarts from the initial state, and the segments between
    sync points can be folded in parallel.

    "Previous outcome" and "last failure before" come from windows over (key,
    time bucket), with the value carried in from earlier buckets through a window
    over one summary row per (key, bucket); segment numbers are a running count
    of sync points built the same way. A hot key is thus spread over its buckets.
    """
    reset_us = L.OUTAGE_RESET_SECONDS * 1_000_000
    o = outcomes.withColumn("_b", F.date_trunc(bucket, F.col("ts")))
    o = o.withColumn("_tu", F.unix_micros(F.col("ts").cast("timestamp")))
    order = [F.col("_tu"), F.col("event_id")]
    wb = Window.partitionBy(key, "_b").orderBy(*order)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    o = (o.withColumn("_prev_ok", F.lag("ok").over(wb))
          .withColumn("_prev_tu", F.lag("_tu").over(wb))
          .withColumn("_last_fail", F.last(F.when(~F.col("ok"), F.col("_tu")), ignorenulls=True).over(before)))
    # per (key, bucket): last outcome and last failure; carried into later buckets
    summ = o.groupBy(key, "_b").agg(
        F.max_by(F.struct(F.col("ok").alias("ok"), F.col("_tu").alias("tu")), F.struct(*order)).alias("_last"),
        F.max(F.when(~F.col("ok"), F.col("_tu"))).alias("_bfail"))
    wk = Window.partitionBy(key).orderBy("_b")
    carry = (summ.withColumn("_c_last", F.lag("_last").over(wk))
                 .withColumn("_c_fail", F.last("_bfail", ignorenulls=True)
                             .over(wk.rowsBetween(Window.unboundedPreceding, -1)))
                 .select(key, "_b", "_c_last", "_c_fail"))
    o = o.join(carry, [key, "_b"], "left")
    prev_ok = F.coalesce(F.col("_prev_ok"), F.col("_c_last.ok"))
    prev_tu = F.coalesce(F.col("_prev_tu"), F.col("_c_last.tu"))
    last_fail = F.coalesce(F.col("_last_fail"), F.col("_c_fail"))
    sync = (F.col("ok") & F.coalesce(prev_ok, F.lit(False))
            & (last_fail.isNull() | (prev_tu - last_fail >= reset_us)))
    o = o.withColumn("_sync", sync.cast("int"))
    # segment = number of sync points strictly before the outcome (two-level running count)
    o = o.withColumn("_local", F.coalesce(F.sum("_sync").over(before), F.lit(0)))
    counts = o.groupBy(key, "_b").agg(F.sum("_sync").alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wk.rowsBetween(Window.unboundedPreceding, -1)),
                                                   F.lit(0))).select(key, "_b", "_off")
    o = o.join(offsets, [key, "_b"], "left")
    return o.select(key, "event_id", "ts", "ok", (F.col("_off") + F.col("_local")).cast("bigint").alias("segment"))


def outage_batch(outcomes: DataFrame, key: str, n_partitions: int | None = None) -> DataFrame:
    """Batch twin: the outcomes are cut into independent segments
    (``outage_segments``), segments are hash-partitioned and time-sorted, and each
    is folded from the initial state by streaming through Arrow batches (state
    carried across batches, so memory stays bounded). A key with many segments is
    spread over many tasks; one segment is inherently sequential."""
    seg = outage_segments(outcomes.select(key, "event_id", "ts", "ok"), key)
    by = ["key", "segment"] if n_partitions is None else [n_partitions, "key", "segment"]
    src = (seg.select(F.col(key).alias("key"), "segment", "event_id", "ts", "ok")
           .repartition(*by).sortWithinPartitions("key", "segment", "ts", "event_id"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, outage.START
        for pdf in it:
            if pdf.empty:
                continue
            ts, ok = outage.micros(pdf["ts"]), pdf["ok"].to_numpy().astype(bool)
            names = list(zip(pdf["key"], pdf["segment"]))
            new = (pdf[["key", "segment"]] != pdf[["key", "segment"]].shift()).any(axis=1).to_numpy()
            new[0] = names[0] != last
            cuts = np.unique(np.append(0, np.flatnonzero(new)))
            allowed, after = [], []
            for a, b in zip(cuts, np.append(cuts[1:], len(pdf))):
                got, then, state = outage.fold(outage.START if new[a] else state, ts[a:b], ok[a:b])
                allowed.append(got)
                after.append(then)
            last = names[-1]
            yield outage.decided(pdf["key"], ts, pdf["event_id"].to_numpy(), np.concatenate(allowed), np.concatenate(after))
    return src.mapInPandas(run, OUTAGE_OUT).withColumnRenamed("key", key)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Start streams with the RocksDB state store (``transformWithState`` needs it), for this start only."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def outage_stream(spark: SparkSession, source: str, out: str, schema: str, key: str,
                  lateness: str = "1 day", files: int = landing.FILES) -> str:
    """Streaming form: outcomes up to ``lateness`` behind the latest are folded in their place;
    the update log's last decision of every outcome is the batch twin's."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source) \
        .select(F.col(key).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "ok") \
        .withWatermark("ts", lateness)
    states = stream.groupBy("key").transformWithStateInPandas(outage.Outages(), OUTAGE_OUT, "Update", "EventTime")
    log = UpdateLog(spark, f"{out}/decisions", OUTAGE_OUT, ["key", "event_id"])
    with rocksdb(spark):
        run_available_now(states, log.add, f"{out}/_checkpoint", mode="update")
    log.compact()
    return versions.current(spark, f"{out}/decisions/base")


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
