"""Mixing sources to target weights (capped water-filling, seeded repetitions).

Each source wants ``weight / sum(weights)`` of the budget but can give at most
``max_epochs`` times its size. The water level is found exactly: sources sorted by
cap / weight are clamped from the left while the level of the rest lies above their
cap; the excess is thereby shared again by weight until no target is above its cap.

A source's target becomes whole repetitions of all its documents plus a seeded
fraction: documents are ordered by a seeded hash, and those below a threshold are
taken once more. The threshold comes from sums per hash range (4096 per source,
partially aggregated), then from the documents of the one range that holds the cut,
so a source with a third of all rows is never sorted or gathered as a whole.

Defined results: a null text or one without words has size 0 and takes no words; a
null source is a source of its own; rows that repeat exactly (same id and text) share
one hash and are taken together; an empty table gives an empty mix. Extra columns
pass through, also under names used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.llm.common import WORD, join_small, positive_hash, read_table, written

RANGES_BITS = 12                       # hash ranges per source: 2 ** 12
# One row per source; up to this many (about 10 MB) the plan is broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float, budget: float | None = None) -> DataFrame:
    """(source, source_size, weight) -> the same plus ``target``.

    One row per source, so the two sorted windows see a table as long as the list of
    sources, not the corpus."""
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))) \
        .withColumn("ratio", F.try_divide(F.col("cap"), F.col("weight")))
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(every).cast("double")
    rest = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", F.try_divide(rest, weight))
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap")))
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def cycling_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .., cycle, repeating, over sources by code point, null last."""
    n = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    return sizes.withColumn("weight", F.pmod(n - 1, F.lit(cycle)) + 1)


def mix_plan(base: DataFrame, max_epochs: float = 3.0, weigh=cycling_weights,
             budget: float | None = None) -> DataFrame:
    """(source, size, h) per document -> (source, source_size, weight, target, whole, below).

    ``whole`` repetitions of every document, one more where ``h <= below``."""
    in_range = F.shiftright("h", 63 - RANGES_BITS).alias("r")
    ranges = base.groupBy("source", in_range).agg(F.sum("size").alias("range_size"))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = water_fill(weigh(sizes), max_epochs, budget)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    targets = written(targets.withColumn("whole", whole)
                      .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    n = targets.count()

    upto = Window.partitionBy("source").orderBy("r")
    t = targets.select(F.col("source").alias("t_source"), "rest")
    cuts = ranges.withColumn("upto", F.sum("range_size").over(upto)) \
        .withColumn("before", F.col("upto") - F.col("range_size"))
    cuts = join_small(cuts, t, F.col("source").eqNullSafe(F.col("t_source")), "inner", n, BROADCAST_SOURCES)
    cuts = written(cuts.filter((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
                   .select(F.col("source").alias("c_source"), F.col("r").alias("c_r"), "rest", "before"), "mix-cuts")

    # documents of the range that holds the cut: one 4096th of each source
    near = join_small(base.withColumn("r", F.shiftright("h", 63 - RANGES_BITS)), cuts,
                      F.col("source").eqNullSafe(F.col("c_source")) & (F.col("r") == F.col("c_r")),
                      "inner", n, BROADCAST_SOURCES)
    near = near.groupBy("source", "rest", "before", "h").agg(F.sum("size").alias("size"))
    w = Window.partitionBy("source").orderBy("h")
    middle = F.col("before") + F.sum("size").over(w) - F.col("size") / 2
    fits = near.withColumn("middle", middle).filter(F.col("middle") <= F.col("rest")) \
        .groupBy("source").agg(F.max("h").alias("h"))
    fits = fits.select(F.col("source").alias("f_source"), "h")
    out = targets.join(cuts.select("c_source", "c_r"), F.col("source").eqNullSafe(F.col("c_source")), "left") \
        .join(fits, F.col("source").eqNullSafe(F.col("f_source")), "left")
    range_start = F.shiftleft(F.col("c_r").cast("long"), 63 - RANGES_BITS) - 1
    return written(out.select("source", "source_size", "weight", "target", "whole",
                              F.when(F.col("rest") > 0, F.coalesce("h", range_start, F.lit(-1)))
                              .otherwise(-1).alias("below")), "mix-plan")


def base_of(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"),
                       positive_hash(F.col(id_col), F.col(text_col), seed=seed).alias("h"))


def repetitions(plan_alias: str = "p") -> Column:
    """How often the mix takes a document with hash ``h`` under the joined plan."""
    extra = F.when(F.col("h") <= F.col(f"{plan_alias}.below"), 1).otherwise(0)
    return (F.col(f"{plan_alias}.whole") + extra).cast("long")


def mix_sizes(docs: DataFrame, max_epochs: float = 3.0, seed: int = 17, weigh=cycling_weights,
              budget: float | None = None, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the plan's columns."""
    base = written(base_of(docs, seed, id_col, text_col, source_col), "mix-base")
    plan = mix_plan(base, max_epochs, weigh, budget)
    got = join_small(base.alias("b"), plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")),
                     "inner", plan.count(), BROADCAST_SOURCES)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * repetitions()).alias("taken"),
                      repetitions().alias("repetitions"), F.col("b.source").alias("source"))


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: int = 17, weigh=cycling_weights,
        budget: float | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, columns unchanged."""
    base = written(base_of(docs, seed, id_col, text_col, source_col), "mix-base")
    plan = mix_plan(base, max_epochs, weigh, budget)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                    F.col(source_col).alias("d_source"),
                    positive_hash(F.col(id_col), F.col(text_col), seed=seed).alias("h"))
    got = join_small(d, plan.alias("p"), F.col("d_source").eqNullSafe(F.col("p.source")),
                     "inner", plan.count(), BROADCAST_SOURCES)
    taken = got.select("doc", F.explode(F.array_repeat(F.lit(0), repetitions().cast("int"))).alias("copy"))
    return taken.select("doc.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, weights 1, 2, 3 repeating, at most three epochs."""
    return mix_sizes(read_table(spark, sf_dir, "documents"))
