"""Connected components over an edge table (large-star / small-star).

Every round rewires each node's larger neighbours to its smallest one, so paths shorten
by half; rounds end when the edges no longer change. Each step is a partial aggregate and
a join on node ids, written to the shared folder; edges never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """edges (a, b), a > b. Large: neighbours above a node; small: those below it. Returns the
    new edges and the written table that they read."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter(F.col("b") < F.col("a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = written(least, "least")                        # a table, so that a hub's rows can be split
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, root) for every node with an edge; root is the smallest id."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = written(e, "edges")
    state = None
    while True:
        wide, least = _star(e, True)
        wide = written(wide, "edges")
        narrow, least2 = _star(wide, False)
        old, e = e, written(narrow, "edges")
        for done in (old, least, wide, least2):            # a finished round's tables
            discard(done)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")) \
        .unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
