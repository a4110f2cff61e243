"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.session import apply_runtime_conf, scratch_path

# A word: a run of anything but ASCII white space (fixed by the query contracts).
WORD = r"[^\x20\x09-\x0D]+"

# Rows per Arrow batch; texts may be long, so batches stay small.
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """UTC/ANSI settings, package on the executors, small Arrow batches."""
    apply_runtime_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: the lineage
    is cut, a lost executor re-reads files, and later plans see real sizes."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the scratch tables that ``df`` reads, when nothing reads them any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_memory() -> None:
    """Give a task's freed memory back to the system: Python workers are kept between tasks, and
    what they hold on to counts against the executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def lean(run):
    """A task function over batches that releases its memory at the end."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()
    return wrapped


def join_small(big: DataFrame, small: DataFrame, on, how: str, rows: int, most_rows: int) -> DataFrame:
    """Join with a written table of ``rows`` counted rows: it is broadcast up to
    ``most_rows``; beyond that the join shuffles (AQE splits skewed keys)."""
    return big.join(F.broadcast(small) if rows <= most_rows else small, on, how)


def positive_hash(*cols: Column, seed: int = 0) -> Column:
    """63-bit non-negative hash of the columns."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def temporary_name(name: str, taken) -> str:
    """A column name based on ``name`` that ``taken`` does not hold (any case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name
