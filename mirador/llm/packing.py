"""Packing documents into sequences of bounded length: best-two-fit over a histogram.

1. Tasks tokenise whole texts, append the end id, cut longer ones into pieces of ``capacity``
   tokens (the remainder comes first) and number the pieces of a length within the task.
2. The pieces are counted by length. Best-two-fit needs nothing else, since pieces of one
   length are alike: fill a sequence with the longest piece that fits, again and again; then, if
   it has more than one piece and a gap, replace the smallest piece by the two unpacked ones
   that fill the gap with its room best, if they fill more. A sequence made so is repeated as
   long as the counts of its lengths allow: each decision depends only on which lengths are
   left, and none of them runs out meanwhile. Afterwards one length cannot be used as often as
   before, so there are at most the sum of ``capacity / length`` over all lengths different
   sequences (some 17,000 for 2048), however many documents there are. The histogram (at
   most ``capacity`` numbers) and this plan are all the driver holds.
3. Pieces get their number among all pieces of their length, by prefix sums over the tasks'
   counts, and look their place up in the plan. No length needs a task of its own: a third
   of all pieces may have one length.

Defined results: a null text counts as empty, which is one piece with the end id alone;
repeated rows and repeated or null ids are documents of their own; an empty table gives no
rows; extra columns are left out. Texts that hold the string of a special token get that
token, as the tokenizer's own call does (``add_special_tokens`` concerns others).
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirador.llm.bpe import read_ranks
from mirador.llm.common import lean, read_table, written

CAPACITY = 2_048
BATCH_TOKENS = 4_000_000       # tokens whose pieces are sent on together
PIECES_DDL = "block int, doc_id long, piece int, start long, length int, ids_crc32 long, nth int, ids array<int>"
PLACED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def encoder(tokenizer: str, ranks: dict[bytes, int] | None, pattern: str | None):
    """text -> uint32 ids of the tokenizer (its JSON). With the same vocabulary as ranks, texts
    without special tokens take the tiktoken library, which gives the same ids sooner."""
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(tokenizer)
    special = re.compile("|".join(re.escape(t["content"]) for t in json.loads(tokenizer).get("added_tokens", [])) or r"(?!)")
    quick = None
    if ranks:
        quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> np.ndarray:
        if quick and not special.search(text):
            return np.array(quick(text), np.uint32)
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False,
           ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Pieces of every text: ``nth`` counts a task's (``block``'s) pieces of one length."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), read_ranks(ranks_path) if ranks_path else None))

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"          # one thread a task
        encode, block, seen = encoder(*shared.value, pattern), TaskContext.get().partitionId(), {}

        def packed():
            cols = list(zip(*rows))
            lists = pa.array([None] * len(rows), pa.list_(pa.int32()))
            if keep_ids:
                ends = np.append(0, np.cumsum(cols[4]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                 pa.array(np.concatenate(held).view(np.int32)))
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), lists],
                                              names=["block", "doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids"])

        rows, held, tokens = [], [], 0
        for b in batches:
            for i, text in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                start, stop = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    part = ids[start:stop]
                    nth = seen.get(len(part), 0)
                    seen[len(part)] = nth + 1
                    rows.append((block, i, piece, start, len(part), zlib.crc32(part.tobytes()), nth))
                    if keep_ids:
                        held.append(part)
                    start, stop = stop, stop + capacity
                tokens += len(ids)
                if tokens >= BATCH_TOKENS:
                    yield packed()
                    rows, held, tokens = [], [], 0
        if rows:
            yield packed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), PIECES_DDL)


def best_pair(rest: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """Lengths x >= y with ``rest`` pieces left, more_than < x + y <= room, as full as possible."""
    a = np.flatnonzero(rest[:room])
    if not len(a):
        return None
    at = np.searchsorted(a, np.minimum(room - a, a), side="right") - 1
    at -= (at >= 0) & (a[at] == a) & (rest[a] < 2)              # not one piece twice
    total = np.where(at >= 0, a + a[at], 0)
    k = len(a) - 1 - int(total[::-1].argmax())
    return (int(a[k]), int(a[at[k]])) if total[k] > more_than else None


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """{length: pieces} -> [(sequences, [(length, pieces in each), ...]), ...]."""
    n = np.zeros(capacity + 1, np.int64)
    for length, c in counts.items():
        n[length] = c
    out = []
    while (left := np.flatnonzero(n)).size:
        use, gap, below = {}, capacity, capacity
        while (k := int(np.searchsorted(left, min(gap, below), side="right")) - 1) >= 0:
            length = int(left[k])
            use[length] = min(int(n[length]), gap // length)
            gap, below = gap - length * use[length], length - 1
        most = dict(use)
        if gap and sum(use.values()) > 1:
            small, rest = min(use), n.copy()
            for length, c in use.items():
                rest[length] -= c
            if pair := best_pair(rest, gap + small, small):
                use[small] -= 1
                for x in pair:
                    use[x] = use.get(x, 0) + 1
        times = min(int(n[x]) // max(use.get(x, 0), most.get(x, 0)) for x in {*use, *most})
        use = {x: c for x, c in use.items() if c}
        for x, c in use.items():
            n[x] -= times * c
        out.append((times, sorted(use.items(), reverse=True)))
    return out


def plan_table(plan) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by ranges of their numbers, in order of (length, number)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, use in plan:
        offset = 0
        for length, c in use:
            first = taken.get(length, 0)
            rows.append((length, first, c, sequence, offset))
            taken[length] = first + times * c
            offset += length * c
        sequence += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), cols))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The written pieces with their ``sequence_id`` and ``offset``."""
    counts = written(parts.groupBy("length", "block").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = parts.sparkSession.sparkContext.broadcast(plan_table(best_two_fit(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")),
                     "piece-firsts")
    keep = [c for c in parts.columns if c not in ("block", "nth")]
    ddl = PLACED_DDL + (", ids array<int>" if "ids" in keep else "")

    def run(batches):
        p = plan.value
        shift = 1 + int(max(p["first"], default=0)).bit_length() + 20
        key = (p["length"] << shift) | p["first"]               # lengths take the high bits
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            k = np.searchsorted(key, (length << shift) | number, side="right") - 1
            nth = number - p["first"][k]
            place = {"sequence_id": p["sequence"][k] + nth // p["each"][k],
                     "offset": p["offset"][k] + nth % p["each"][k] * length, "length": length}
            cols = {c: pa.array(place[c], pa.int64()) if c in place else b.column(c) for c in (*keep, "sequence_id", "offset")}
            yield pa.RecordBatch.from_arrays([cols[c.split()[0]] for c in ddl.split(", ")], names=[c.split()[0] for c in ddl.split(", ")])

    numbered = parts.join(firsts, ["length", "block"]).withColumn("number", F.col("first") + F.col("nth"))
    return numbered.select(*keep, "number").mapInArrow(lean(run), ddl)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
                   keep_ids: bool = True, **how) -> DataFrame:
    """Each piece with its sequence and place; with its ids, if they are kept."""
    parts = written(pieces(docs, tokenizer_path, end_id, capacity, keep_ids, **how), "pieces")
    return pack(parts if keep_ids else parts.drop("ids"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the sequences themselves (at most ``capacity`` ids each)."""
    row = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(row.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))


def op13_best_two_fit(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          keep_ids=False, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          pattern=public_tokenizers.PATTERN)
