"""CSV files of unknown dialect: encoding, separator, quote and line form per file.

A task opens the head of each file and scores every (separator, quote) on it: the share of
records with the most frequent number of fields, then that number. The encoding is told by a
byte order mark, by valid UTF-8, or is Latin-1. Whether a quoted field runs over lines can show
anywhere in a file, so lines with an odd number of quotes are looked for in all of it, by a
split-wise text scan; only then are files read whole (a multi-line file cannot be split).
Spark's own reader does the rest with those options, one read per dialect.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirador.sources.stores import MARKS, filesystem

HEAD_BYTES = 65_536
SEPARATORS = (",", ";", "\t", "|")
QUOTES = ('"', "'")
DIALECT_DDL = "path string, encoding string, sep string, quote string, multi_line boolean"
WIDER = [T.IntegerType(), T.LongType(), T.DoubleType()]


def encoding_of(head: bytes) -> str:
    """By byte order mark, by valid UTF-8 (a head may end inside a character), else Latin-1."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    for cut in range(min(4, len(head) + 1)):
        try:
            head[:len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError as e:
            if e.start < len(head) - 4:
                break
    return "ISO-8859-1"


def score(text: str, sep: str, quote: str) -> tuple[float, int]:
    """(share of records of the most frequent width, that width); a width of one scores nothing."""
    try:
        widths = Counter(len(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, quotechar=quote) if r)
    except csv.Error:
        return 0.0, 0
    if not widths:
        return 0.0, 0
    width, n = max(widths.items(), key=lambda x: (x[1], x[0]))
    return (n / sum(widths.values()) if width > 1 else 0.0), width


def wraps(text: str, sep: str, quote: str) -> int:
    """Fields that seem to open with the quote."""
    return sum(text.count(before + quote) for before in (sep, "\n")) + text.startswith(quote)


def sniff(head: bytes, whole: bool) -> tuple[str, str, str]:
    """(encoding, separator, quote) of a file's head."""
    encoding = encoding_of(head)
    text = head.decode({"UTF-8": "utf-8-sig", "UTF-16": "utf-16"}.get(encoding, "latin-1"), errors="ignore")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not whole and "\n" in text:
        text = text[:text.rindex("\n") + 1]                     # whole lines only
    best = max(((*score(text, s, q), wraps(text, s, q) if q == '"' else wraps(text, s, q) - 1, -i, -j)
                for i, s in enumerate(SEPARATORS) for j, q in enumerate(QUOTES)))
    return encoding, SEPARATORS[-best[3]], QUOTES[-best[4]]


def dialects(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, encoding, sep, quote, multi_line."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for name, length in zip(pdf["path"], pdf["length"]):
                fs, inside = filesystem(name)
                with fs.open_input_stream(inside) as f:
                    rows.append((name, *sniff(f.read(HEAD_BYTES), length <= HEAD_BYTES)))
            yield pd.DataFrame(rows, columns=["path", "encoding", "sep", "quote"])

    heads = files.mapInPandas(run, "path string, encoding string, sep string, quote string")
    # a line with an odd number of quotes lies inside a quoted field, or opens or closes one
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    n = lambda q: F.length(F.regexp_replace("value", f"[^{q}]", ""))
    odd = lines.groupBy("path").agg(*[F.max(n(q) % 2).alias(f"odd{i}") for i, q in enumerate(QUOTES)])
    same = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    j = heads.withColumn("key", same).join(odd.select(same.alias("key"), "odd0", "odd1"), "key", "left")
    multi = (F.col("encoding") == "UTF-16") | (F.when(F.col("quote") == QUOTES[0], F.col("odd0")).otherwise(F.col("odd1")) == 1)
    return j.select("path", "encoding", "sep", "quote", F.coalesce(multi, F.lit(False)).alias("multi_line"))


def widest(kinds: list) -> T.DataType:
    """The type that holds all: equal types, the wider number, else text."""
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(k in WIDER for k in kinds):
        return max(kinds, key=WIDER.index)
    return T.StringType()


def read(spark: SparkSession, path: str, sampling_ratio: float = 1.0, dialect: dict | None = None) -> DataFrame:
    """CSV with a header row and inferred types. ``dialect`` (sep, quote, encoding, multiLine, as the
    reader's options) is detected per file unless given; files of several dialects are united by
    column name."""
    def one(where, options: dict) -> DataFrame:
        return (spark.read.option("header", True).option("inferSchema", True).option("samplingRatio", sampling_ratio)
                .option("escape", options["quote"]).options(**options).csv(where))

    if dialect is not None:
        return one(path, {"sep": ",", "quote": '"', "encoding": "UTF-8", "multiLine": False, **dialect})
    found = dialects(spark, path)
    groups = found.groupBy("encoding", "sep", "quote", "multi_line").agg(F.collect_list("path").alias("paths")).collect()
    frames = [one(path if len(groups) == 1 else g["paths"],
                  {"sep": g["sep"], "quote": g["quote"], "encoding": g["encoding"], "multiLine": g["multi_line"]})
              for g in sorted(groups, key=lambda g: (g["encoding"], g["sep"], g["quote"], g["multi_line"]))]
    if not frames:
        return one(path, {"sep": ",", "quote": '"', "encoding": "UTF-8", "multiLine": False})
    kinds: dict[str, list] = {}
    for f in frames:
        for c in f.schema.fields:
            kinds.setdefault(c.name, []).append(c.dataType)
    out = None
    for f in frames:
        f = f.select(*[F.col(f"`{c}`").cast(widest(kinds[c])).alias(c) for c in f.columns])
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def encodings(spark: SparkSession, path: str) -> str:
    """The files' encoding, or all of them joined by a comma."""
    rows = dialects(spark, path).select("encoding").distinct().collect()
    return ",".join(sorted(r["encoding"] for r in rows))
