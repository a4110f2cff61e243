"""The update log of a stream's keyed results, compacted to one row a key.

A micro-batch writes its own ``delta/batch=<id>`` folder (overwritten if the batch is replayed).
Every few batches the log is compacted: the last row of each key, without expired ones, is
published as the next version of the base table and the deltas it holds are deleted. A log is
therefore at most the live keys and a few micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.sources import versions

COMPACT_EVERY = 8


class UpdateLog:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], every: int = COMPACT_EVERY) -> None:
        self.spark, self.path, self.schema, self.keys, self.every = spark, path, schema, keys, every

    def add(self, batch: DataFrame, batch_id: int, alive: Column | None = None) -> None:
        """Write a micro-batch's updates; ``alive`` tells rows to keep when compacting."""
        batch.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch_id}")
        if len(self.deltas()) >= self.every:
            self.compact(alive)

    def deltas(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in versions.listed(self.spark, f"{self.path}/delta") if "=" in n)

    def read(self) -> DataFrame:
        """The last row of every key."""
        cols = [c.strip().split()[0] for c in self.schema.split(",")]
        rows = versions.load(self.spark, f"{self.path}/base", f"{self.schema}, batch bigint")
        if self.deltas():
            delta = self.spark.read.schema(f"{self.schema}, batch bigint").option("basePath", f"{self.path}/delta") \
                .parquet(f"{self.path}/delta")
            rows = rows.unionByName(delta)
        rest = [c for c in cols if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct("batch", *rest), "batch").alias("last"))
        return last.select(*self.keys, "last.batch", *[f"last.{c}" for c in rest])

    def compact(self, alive: Column | None = None) -> None:
        """Publish the last rows as the base, then delete the deltas in it."""
        done, rows = self.deltas(), self.read()
        versions.save(rows if alive is None else rows.where(alive), f"{self.path}/base", keep=1)
        for batch in done:
            versions.delete(self.spark, f"{self.path}/delta/batch={batch}")
