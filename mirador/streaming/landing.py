"""Landing a table as files that a stream sees arrive in order."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.sources import versions

FILES = 4                      # files a chunk, at least
ROWS_A_FILE = 100_000          # about


def land_in_chunks(df: DataFrame, path: str, order_col: str, n_chunks: int, files: int | None = None) -> int:
    """Land ``df`` in ``n_chunks`` chunks by ``order_col``, several files each, in one job: the
    chunk is a column, rows are dealt by (chunk, salt), and the files are then moved into the
    landing folder with modification times in the chunks' order, which file streams follow.
    Each chunk is ``files`` files (empty ones, if it has few rows), so a stream that takes that
    many at a trigger gets it whole. Unless ``files`` is given, it follows from the number of rows, so
    that tasks stay small; it is returned. Rows without a key come first; a table without any
    key is one chunk."""
    spark = df.sparkSession
    lo, hi, n = df.agg(F.min(order_col), F.max(order_col), F.count(F.lit(1))).first()
    files = files or max(FILES, -(-n // (n_chunks * ROWS_A_FILE)))
    chunk = F.lit(0)
    if lo is not None:
        step = (hi - lo) // n_chunks + 1
        chunk = F.coalesce(F.floor((F.col(order_col) - F.lit(lo)) / F.lit(step)).cast("int"), F.lit(0))
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex[:8]}"
    salted = df.withColumn("landing_chunk", chunk) \
        .withColumn("landing_salt", F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    salted.repartition(n_chunks * files, "landing_chunk", "landing_salt").drop("landing_salt") \
        .write.partitionBy("landing_chunk").parquet(staged)
    fs, target = versions.path_of(spark, path)
    fs.mkdirs(target)
    now = int(time.time() * 1000) - 1000 * (n_chunks + 1)
    empty = None
    for folder in sorted((n for n in versions.listed(spark, staged) if n.startswith("landing_chunk=")),
                         key=lambda n: int(n.split("=")[1])):
        at = int(folder.split("=")[1])
        names = [n for n in versions.listed(spark, f"{staged}/{folder}") if n.startswith("part-")]
        for k in range(max(files, len(names))):
            _, to = versions.path_of(spark, f"{path}/{at:05d}-{k:03d}-{uuid.uuid4().hex[:8]}.parquet")
            if k < len(names):
                fs.rename(versions.path_of(spark, f"{staged}/{folder}/{names[k]}")[1], to)
            else:
                empty = empty or empty_file(df, f"{staged}/none")
                spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, empty, fs, to, False, fs.getConf())
            fs.setTimes(to, now + 1000 * at, -1)
    versions.delete(spark, staged)
    return files


def empty_file(df: DataFrame, folder: str):
    """A Parquet file of the table's columns without rows."""
    df.limit(0).coalesce(1).write.parquet(folder)
    name = next(n for n in versions.listed(df.sparkSession, folder) if n.startswith("part-"))
    return versions.path_of(df.sparkSession, f"{folder}/{name}")[1]
