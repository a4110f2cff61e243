"""SparkSession helpers: one place for dialect, time zone and shuffle settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Timestamps are read and printed in UTC so that
# results repeat on any machine; ANSI mode and double-quoted identifiers give the
# SQL dialect the ad-hoc queries expect.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "mirador",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.driver.memory", os.environ.get("MIRADOR_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Apply the settings results depend on (UTC, ANSI) to a session we did not
    build, and make sure the executors can import this package. Double-quoted
    identifiers are switched on only in the SQL sessions the tool opens."""
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(k, SESSION_CONF[k])
    ship_package(spark)


def session_key(spark: SparkSession) -> str:
    """A key unique to one session (stable while it lives, never reused)."""
    try:
        return str(spark._jsparkSession.sessionUUID())
    except Exception:  # noqa: BLE001 - older JVM side
        return f"{spark.sparkContext.applicationId}:{id(spark)}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per SparkContext (``addPyFile`` of a
    zip), so Python steps (mapInPandas, applyInPandasWithState) import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import mirador
    pkg = os.path.dirname(os.path.abspath(mirador.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="mirador-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    The folder comes from ``spark.checkpoint.dir`` (or one already set on the
    context). Only a local-mode session without one gets a private temp folder,
    which is the test case; a cluster without a shared folder is an error,
    because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mirador-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


_TABLES: dict[tuple, str] = {}


def written_folder(spark: SparkSession, key: tuple, write) -> str:
    """A folder that ``write(path)`` fills once (per session and key)."""
    k = (session_key(spark), "folder") + tuple(key)
    if k not in _TABLES:
        path = scratch_path(spark, "derived-" + "-".join(str(x) for x in key)[:60].replace("/", "_"))
        write(path)
        _TABLES[k] = path
    return _TABLES[k]


def written_table(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A derived table written once (per session and key) to the shared folder and
    read back: later plans start from the file instead of recomputing the lineage,
    and a lost executor re-reads files instead of replaying the whole plan."""
    k = (session_key(spark),) + tuple(key)
    path = _TABLES.get(k)
    if path is None:
        path = scratch_path(spark, "derived-" + "-".join(str(x) for x in key)[:60].replace("/", "_"))
        build().write.mode("overwrite").parquet(path)
        _TABLES[k] = path
    return spark.read.parquet(path)


def forget_tables() -> None:
    """Drop the memory of written tables, so the next query builds its own."""
    _TABLES.clear()


def materialize(df: DataFrame) -> DataFrame:
    """Evaluate once and cut the lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
