"""Versioned tables: a staged write, and a manifest that is switched last.

A table is a folder of version folders (``v-<uuid>``) and numbered manifest entries
(``_manifest/<n>``, a line with the folder's name). A write fills a new folder and only then
renames its entry into place; readers take the highest entry. A write that fails leaves the
old version as it was; two writers that publish the same number cannot both succeed. The
entries and folders are few (``keep`` versions), so listing them on the driver is bounded.

All through Hadoop's file system API, so local, HDFS and object-store folders work alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def path_of(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    fs, p = path_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return bool(fs.delete(p, True))


def entries(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in listed(spark, f"{path}/_manifest") if n.isdigit())


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = path_of(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def head(spark: SparkSession, path: str) -> str | None:
    """The text of the current manifest entry, if there is one."""
    numbers = entries(spark, path)
    return read_text(spark, f"{path}/_manifest/{numbers[-1]}") if numbers else None


def switch(spark: SparkSession, path: str, text: str, seen: int) -> int:
    """Make ``text`` the entry after number ``seen``; fails if another writer was first."""
    number = seen + 1
    fs, staged = path_of(spark, f"{path}/_manifest/.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(staged, path_of(spark, f"{path}/_manifest/{number}")[1]):
        fs.delete(staged, False)
        raise RuntimeError(f"version {number} of {path} was published by another writer")
    return number


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version, if there is one."""
    name = head(spark, path)
    return None if name is None else f"{path}/{name.strip()}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Let ``write`` fill a new folder, then make it the current version; versions older than the
    last ``keep`` are deleted."""
    name, before = f"v-{uuid.uuid4().hex[:12]}", entries(spark, path)
    write(f"{path}/{name}")
    switch(spark, path, name, before[-1] if before else 0)
    vacuum(spark, path, keep)
    return f"{path}/{name}"


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete versions older than the last ``keep``; returns the folders' names."""
    gone = []
    for number in entries(spark, path)[:-keep]:
        name = read_text(spark, f"{path}/_manifest/{number}").strip()
        delete(spark, f"{path}/_manifest/{number}")
        delete(spark, f"{path}/{name}")
        gone.append(name)
    return gone


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None, keep: int = 2) -> str:
    """Publish ``df`` as the table's next version."""
    def write(folder: str) -> None:
        w = df.write.format(fmt)
        (w.partitionBy(partition_by) if partition_by else w).save(folder)

    return publish(df.sparkSession, path, write, keep)


def load(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """The current version, or an empty table of the schema."""
    folder = current(spark, path)
    if folder is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).format(fmt).load(folder)
