"""Sharding by a k-d tree over document metadata.

The tree starts with one node that holds all rows and as many leaves as shards are
wanted (or as the target bytes ask for). A node with k leaves is split along its widest
dimension (extent relative to the whole table's) at the weighted median that gives
k // 2 of k shares of its bytes to the left, until every node is one leaf, i.e. until it
has reached the target bytes. All nodes of a level are worked on together; a row's node is a
column, written once a level.

Medians are distributed: per step, rows are counted into 4096 bins per node (partial
aggregation; the driver gets one row per node) and the bin with the cut is divided
further. Within one value, rows are ordered by a text hash, so equal texts lie
together: they stay in one shard unless they weigh more than an eighth of a shard, in
which case a hash of the document id cuts through them.

Shards are numbered by leaf; slots run through (shard, hash part) with offsets from
counted parts, so no shard is numbered by one task.

Defined results: a null text has no bytes (size 8) and the CRC of nothing, 0; dimensions
of null texts are 0; rows that repeat exactly stay separate rows with slots of their
own; an empty table gives no rows; extra columns are ignored. A row heavier than a shard
makes its shard as large.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.llm.common import discard, join_small, positive_hash, read_table, written

BINS = 4096
SLOT_PARTS = 1024
TOLERANCE = 0.002          # of a shard's bytes: how near a cut comes to its goal
WHOLE_GROUP = 0.125        # of a shard's bytes: heavier groups of equal texts are cut
BROADCAST_NODES = 100_000  # rows of (node, cut), some 40 bytes each
LAST = (1 << 63) - 1


@dataclass
class Node:
    """An open node: its leaves, the number of its first leaf, and its cut when it is found."""
    leaves: int
    first: int
    dim: int = 0
    cut: tuple[int, int] = (LAST, LAST)     # (key, h): rows up to it go left


def small_table(spark, rows: list[tuple], ddl: str) -> DataFrame:
    """A row per node, as a written table (a level may have as many nodes as there are shards)."""
    return written(spark.createDataFrame(rows, ddl), "shard-nodes")


def _refine(rows: DataFrame, search: dict[int, dict], tolerance: float) -> None:
    """Narrow each node's [lo, hi] until the bin with its goal is light or one key.

    ``rows``: node, key, size. ``search[node]``: lo, hi, below (bytes under lo), goal."""
    going = {n for n, s in search.items() if s["lo"] < s["hi"]}
    while going:
        table = small_table(rows.sparkSession, [
            (n, search[n]["lo"], search[n]["hi"], (search[n]["hi"] - search[n]["lo"]) // BINS + 1,
             float(search[n]["goal"] - search[n]["below"])) for n in sorted(going)],
            "node long, lo long, hi long, width long, goal double")
        # one row per node of the level: at most as many as there are shards
        got = join_small(rows, table, "node", "inner", len(going), BROADCAST_NODES).filter("key between lo and hi") \
            .groupBy("node", "lo", "width", "goal", F.expr("(key - lo) div width").alias("bin")) \
            .agg(F.sum("size").alias("bytes"))
        w = Window.partitionBy("node").orderBy("bin")
        got = got.withColumn("upto", F.sum("bytes").over(w)).filter(F.col("upto") >= F.col("goal"))
        got = got.groupBy("node").agg(F.min(F.struct("bin", "lo", "width", "upto", "bytes")).alias("b"))
        for r in got.collect():
            s, b = search[r["node"]], r["b"]
            start = b["lo"] + b["bin"] * b["width"]
            s["below"] += b["upto"] - b["bytes"]
            s["lo"], s["hi"], s["bytes"] = start, min(s["hi"], start + b["width"] - 1), b["bytes"]
            if s["lo"] >= s["hi"] or s["bytes"] <= tolerance:
                going.discard(r["node"])
        discard(table)


def kd_leaves(meta: DataFrame, dims: list[str], leaves: int, total: float) -> DataFrame:
    """``meta`` (size, h, one sortable long key per dimension) with ``leaf``, its leaf's number.

    A row's node is a column of a table that is written once a level; nodes, keys and cuts
    meet it by joins on the node, so the work of a level does not grow with the tree."""
    spark, target = meta.sparkSession, total / max(1, leaves)
    bounds = [F.min(d).alias(f"lo_{d}") for d in dims] + [F.max(d).alias(f"hi_{d}") for d in dims]
    whole = meta.agg(*bounds).first()
    width = {d: max(1, (whole[f"hi_{d}"] or 0) - (whole[f"lo_{d}"] or 0)) for d in dims}
    nodes = {1: Node(max(1, leaves), 0)}
    number = {} if leaves > 1 else {1: 0}
    at, last = meta.withColumn("node", F.lit(1).cast("long")), None
    while open_nodes := {i: n for i, n in nodes.items() if n.leaves > 1}:
        stats = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("bytes"), *bounds).collect()}
        search = {}
        for i, n in open_nodes.items():
            if i not in stats:             # no rows here: its leaves stay empty
                continue
            r = stats[i]
            n.dim = max(range(len(dims)), key=lambda d: (r[f"hi_{dims[d]}"] - r[f"lo_{dims[d]}"]) / width[dims[d]])
            search[i] = {"lo": r[f"lo_{dims[n.dim]}"], "hi": r[f"hi_{dims[n.dim]}"], "below": 0, "bytes": r["bytes"],
                         "goal": r["bytes"] * (n.leaves // 2) / n.leaves}
        chosen = small_table(spark, [(i, n.dim) for i, n in open_nodes.items()], "node long, dim int")
        key = F.element_at(F.array(*dims), F.col("dim") + 1)
        keyed = join_small(at, chosen, "node", "inner", len(open_nodes), BROADCAST_NODES).withColumn("key", key)
        _refine(keyed.select("node", "key", "size"), search, TOLERANCE * target)
        split = {}
        for i, s in search.items():
            before, after = s["goal"] - s["below"], s["below"] + s["bytes"] - s["goal"]
            if s["lo"] < s["hi"] or s["bytes"] <= WHOLE_GROUP * target:
                nodes[i].cut = (s["hi"], LAST) if after <= before else (s["lo"], -1)
            else:                          # one heavy key: cut it by document hash
                split[i] = {"lo": 0, "hi": LAST, "below": s["below"], "goal": s["goal"], "heavy": s["lo"],
                            "bytes": s["bytes"]}
        if split:
            heavy = small_table(spark, [(i, s["heavy"]) for i, s in split.items()], "node long, heavy long")
            rows = join_small(keyed, heavy, "node", "inner", len(split), BROADCAST_NODES).filter("key = heavy")
            _refine(rows.select("node", F.col("h").alias("key"), "size"), split, TOLERANCE * target)
            discard(heavy)
            for i, s in split.items():
                before, after = s["goal"] - s["below"], s["below"] + s["bytes"] - s["goal"]
                nodes[i].cut = (s["heavy"], s["hi"] if after <= before else s["lo"] - 1)
        cuts = small_table(spark, [(i, n.dim, *n.cut) for i, n in open_nodes.items()],
                           "node long, dim int, cut_key long, cut_h long")
        moved = join_small(at, cuts, "node", "left", len(open_nodes), BROADCAST_NODES)
        left = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (F.col("h") <= F.col("cut_h")))
        node = F.when(F.col("dim").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1))
        at = written(moved.withColumn("node", node).select(*meta.columns, "node"), "shard-level")
        for done in (chosen, cuts, last):
            if done is not None:
                discard(done)
        last = at
        for i, n in open_nodes.items():
            half = n.leaves // 2
            nodes |= {2 * i: Node(half, n.first), 2 * i + 1: Node(n.leaves - half, n.first + half)}
            del nodes[i]
        number |= {i: n.first for i, n in nodes.items() if n.leaves == 1}
    table = small_table(spark, list(number.items()), "node long, leaf int")
    return join_small(at, table, "node", "inner", len(number), BROADCAST_NODES).drop("node")


def text_dimensions(text: Column) -> dict[str, Column]:
    """Metadata that equal texts share: length, lines, share of bytes beyond ASCII."""
    n, chars = F.octet_length(text), F.length(text)
    lines = chars - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    foreign = F.try_divide((n - chars) * 1000, n)
    return {"k_chars": chars, "k_lines": lines, "k_foreign": foreign}


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
              dimensions=text_dimensions, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot."""
    text = F.col(text_col)
    th = positive_hash(text, seed=5).bitwiseAND(F.lit(0x7FFFFFFF))
    dims = dimensions(text)
    keyed = [(F.shiftleft(F.coalesce(c, F.lit(0)).cast("long"), 31) + th).alias(k) for k, c in dims.items()]
    meta = written(docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        positive_hash(F.col(id_col), text, seed=6).alias("h"), *keyed), "shard-meta")
    total = meta.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, ceil(total / target_bytes))
    put = kd_leaves(meta, list(dims), shards, total) if total else meta.withColumn("leaf", F.lit(0))
    put = put.withColumn("shard", F.col("leaf").cast("int")).withColumn("part", F.pmod("h", F.lit(SLOT_PARTS)).cast("int"))
    parts = put.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    parts = parts.select("shard", "part", offset.alias("offset"))
    in_part = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "doc_id"))
    put = put.withColumn("in_part", in_part).join(parts, ["shard", "part"])
    return put.select("doc_id", "size", "text_crc32", "shard",
                      (F.col("offset") + F.col("in_part") - 1).cast("long").alias("slot"))


def op2_kd_shards(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards of near equal bytes."""
    out = kd_shards(read_table(spark, sf_dir, "documents"), shards=24)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
