"""Periodic runs of words: descending-LCP Kruskal over each text's suffixes.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at
least ``shortest`` words and ``exponent`` periods. Its start s and s + q begin suffixes whose
longest common prefix (LCP) is exactly length - q. The suffixes are ranked by prefix doubling;
neighbours in that order are edges weighted by their LCP. Edges are taken in descending order
and unite classes (union-find); each class keeps its positions in order, and the smaller class
is put into the larger. Positions i < j that thereby become neighbours have an LCP of exactly
the edge's weight l, so with distance d = j - i <= l the words i .. i + l + d have period d: a
seed, and a run if the word before does not fit. Were a position of the class between s and
s + q, the q words at s would stand inside their own square and q would not be smallest; so
every run is seeded, once, with its smallest period.

Only LCPs that a run needs are followed (5 words for six words and four periods). Texts none
of whose word n-grams of that size repeats, as most, end after one sort of n-gram hashes; a
clash of hashes costs time, not correctness.

One text is one task's work, whole: a run may span all of it. A text of n words takes some
4 log2(n) bytes a word for the ranks of the doubling, held only while it is worked on.

Defined results: null and empty texts have no words and no runs, and an empty collapsed text;
repeated rows and repeated or null ids stay rows of their own; an empty table gives no rows;
extra columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.llm.common import WORD, lean, read_table
from mirador.llm.ngram_join import mix

SHORTEST = 6
EXPONENT = 4
BATCH_WORDS = 500_000          # words whose results are sent on together
RUNS_DDL = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string, "
            "collapsed_sha256 string")


def least_lcp(shortest: int, exponent: int) -> int:
    """The least length - period of a run: no shorter common prefix seeds one."""
    return min(max(shortest, exponent * q) - q for q in range(1, -(-shortest // exponent) + 1))


def repeats(codes: np.ndarray, n: int) -> bool:
    """Whether some ``n`` consecutive codes may stand twice (hashes: never a wrong no)."""
    if len(codes) <= n:
        return False
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        h = mix(h ^ codes[j:j + len(h)].astype(np.uint64), j)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, LCP of each with the next) by prefix doubling."""
    n, levels, width = len(codes), [], 1
    rank = np.append(np.unique(codes, return_inverse=True)[1], -1).astype(np.int64)
    while True:
        levels.append(rank.astype(np.int32))                    # equal ranks: ``width`` equal words
        if rank.max() == n - 1 or width >= n:
            break
        after = np.full(n + 1, -1, np.int64)
        after[:max(n - width, 0)] = rank[width:n]
        rank = np.append(np.unique(rank[:n] * (n + 1) + after[:n] + 1, return_inverse=True)[1], -1)
        width *= 2
    order = np.argsort(rank[:n], kind="stable")
    i, j = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][i] == levels[k][j]) * (1 << k)
        i, j, lcp = i + step, j + step, lcp + step
    return order, lcp


def runs_of(codes: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the codes, by start, then period."""
    least = least_lcp(shortest, exponent)
    if not repeats(codes, least):
        return []
    order, lcp = suffix_order(codes)
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    x, place, out = codes.tolist(), order.tolist(), []
    parent = {int(r): int(r) for r in np.union1d(edges, edges + 1)}
    sets = {r: [place[r]] for r in parent}                      # class -> its positions in order

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    for e, l in zip(edges.tolist(), lcp[edges].tolist()):
        a, b = find(e), find(e + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets.pop(b)
        parent[b] = a
        if 16 * len(small) < len(large):
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()
        own = set(small)
        for p in small:
            k = bisect_left(large, p)
            for q in (large[k - 1] if k else None, large[k + 1] if k + 1 < len(large) else None):
                if q is None or q in own:
                    continue
                i, d = min(p, q), abs(p - q)
                if d <= l and l + d >= max(shortest, exponent * d) and (i == 0 or x[i - 1] != x[i + d - 1]):
                    out.append((i, l + d, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: a run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT, id_col: str = "doc_id",
                  text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, runs, collapsed, collapsed_sha256) per row: the runs of the text's words
    by start, then period, and the words that no run drops, joined by one space, with their
    digest; only the digest without ``keep_text``."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def run(batches):
        def packed():
            ids, sizes, found, texts, digests = zip(*rows)
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], kind),
                 pa.array(texts, pa.string()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"])

        for b in batches:
            rows, held = [], 0
            for i, text in zip(*(c.to_pylist() for c in b.columns)):
                words = (text or "").encode().split()           # ASCII white space
                number: dict[bytes, int] = {}
                codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                found = runs_of(codes, shortest, exponent)
                if found:
                    words = [words[k] for k in np.flatnonzero(kept_words(len(words), found)).tolist()]
                left = b" ".join(words)
                rows.append((i, len(codes), found, left.decode() if keep_text else None, hashlib.sha256(left).hexdigest()))
                held += len(codes)
                if held >= BATCH_WORDS:
                    yield packed()
                    rows, held = [], 0
            if rows:
                yield packed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), RUNS_DDL)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the query's periodic tails: one id in ten repeats its words from word a on
    with period p. A null id or text stays as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def tail(s: Column) -> Column:
        a = F.pmod(s["g"], s["n"])
        p = F.floor((s["n"] - a) / (3 + F.pmod(s["g"], F.lit(8)))) + 1
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1),
                                        lambda i: F.get(s["w"], at(i).cast("int"))), " ")

    # the struct is made once per text: a lambda's variable, not a repeated expression
    s = F.array(F.struct(words.alias("w"), F.size(words).cast("long").alias("n"), F.floor(h / 10).alias("g")))
    changed = F.get(F.transform(s, lambda s: F.when(s["n"] > 0, tail(s)).otherwise(text)), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of six words and four periods in every text of ``documents``, one id in ten with a
    periodic tail planted by the query."""
    docs = read_table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), keep_text=False)
    longest = F.get(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"])
                                 .when(a["start"] != b["start"], a["start"] - b["start"])
                                 .otherwise(a["period"] - b["period"]).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"),
        F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")
