"""Stores in the shared folder: cached catalog records, score exports and run
state; plus the per-URL load plan and a charset scan over raw files.

Everything is written by executors with the DataFrame writers into new folders, and a manifest
is switched last (``versions``), so readers see the old version or the new one; nothing is
assembled on the driver. Per-catalog files hold one JSON line per record instead of one
nested document per catalog, so no catalog is ever collected into a single row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions.columns import epoch_micros
from mirador.sources import versions

HOUR_US = 3600 * 1_000_000
MARKS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16"))     # byte order marks


# ------------------------------------------------------------------ metadata store
class CatalogStore:
    """Records by catalog, of which a write replaces whole catalogs.

    A write fills ``version=<uuid>/catalog_id=<c>`` folders, clustered by (catalog, id): rows are
    range-partitioned by both, so a task holds few catalogs and a large catalog spreads over
    many tasks. Then the manifest, a line (catalog, version) per catalog, is switched; a failed
    write leaves every catalog as it was. Reads name the catalogs' folders, so a point lookup
    opens one, where Parquet's statistics and a bloom filter on the id skip row groups. The
    driver holds the list of catalogs, as a metastore holds partitions.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, id_col: str = "id") -> None:
        self.spark, self.path, self.schema, self.id_col = spark, path.rstrip("/"), schema, id_col

    def catalogs(self) -> dict[str, str]:
        """Catalog -> version, as the manifest says."""
        lines = (versions.head(self.spark, self.path) or "").splitlines()
        return dict(line.split("\t") for line in lines)

    def publish(self, mapping: dict[str, str], before: dict[str, str], seen: int) -> None:
        versions.switch(self.spark, self.path, "\n".join(f"{c}\t{v}" for c, v in sorted(mapping.items())), seen)
        for c, v in before.items():
            if mapping.get(c) != v:
                versions.delete(self.spark, self.folder(c, v))

    def folder(self, catalog: str, version: str) -> str:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{self.path}/version={version}/catalog_id={escape(catalog)}"

    def save(self, records: DataFrame, **options) -> None:
        """Replace the catalogs that ``records`` holds (rows without a catalog are left out)."""
        seen, before, version = versions.entries(self.spark, self.path), self.catalogs(), uuid.uuid4().hex[:12]
        bloom = {f"parquet.bloom.filter.enabled#{self.id_col}": "true"}
        (records.where(F.col("catalog_id").isNotNull()).repartitionByRange("catalog_id", self.id_col)
         .sortWithinPartitions("catalog_id", self.id_col).write.options(**{**bloom, **options})
         .partitionBy("catalog_id").parquet(f"{self.path}/version={version}"))
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        new = [unescape(n.split("=", 1)[1]) for n in versions.listed(self.spark, f"{self.path}/version={version}") if "=" in n]
        self.publish({**before, **dict.fromkeys(new, version)}, before, seen[-1] if seen else 0)

    def load(self, catalogs: list[str] | None = None) -> DataFrame:
        """Records of the catalogs (all, if none are named); none if nothing is stored."""
        held = self.catalogs()
        names = sorted(held) if catalogs is None else sorted(set(catalogs) & set(held))
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path) \
            .parquet(*[self.folder(c, held[c]) for c in names])

    def lookup(self, ids: list[str], catalogs: dict[str, str]) -> DataFrame:
        """Records by id; ``catalogs`` names each id's catalog, and only those folders are read."""
        return self.load(sorted(set(catalogs.values()))).where(F.col(self.id_col).isin(*ids))

    def remove_orphans(self, active: DataFrame, column: str = "id") -> list[str]:
        """Remove the catalogs that are not active; returns them."""
        seen, before = versions.entries(self.spark, self.path), self.catalogs()
        stored = self.spark.createDataFrame([(c,) for c in sorted(before)], "catalog_id string")
        gone = [r[0] for r in stored.join(active.select(F.col(column).alias("catalog_id")), "catalog_id", "left_anti").collect()]
        if gone:
            self.publish({c: v for c, v in before.items() if c not in set(gone)}, before, seen[-1])
        return sorted(gone)


def fresh_records(df: DataFrame, as_of: str, ttl_hours: float) -> DataFrame:
    """Records of the catalogs whose cache is younger than the TTL."""
    age = epoch_micros(F.lit(as_of).cast("timestamp")) - epoch_micros(F.col("cached_at"))
    return df.where(age < int(ttl_hours * HOUR_US))


# ------------------------------------------------------------------ score export
def export_scores(index: DataFrame, scores: DataFrame, meta: DataFrame, path: str,
                  entries: DataFrame | None = None) -> dict[str, str]:
    """Write the catalog index, the per-catalog dataset scores, the per-catalog
    dataset entries (what the next run diffs against) and the run metadata as JSON: a new
    version of the export, which is switched when all of it is written. Per-catalog rows are
    range-partitioned by (catalog, id), so a task writes few files."""
    def write(folder: str) -> None:
        index.write.json(f"{folder}/catalogs.json")
        scores.repartitionByRange("catalog_id", "id").write.partitionBy("catalog_id").json(f"{folder}/catalogs")
        if entries is not None:
            entries.repartitionByRange("catalog_id", "external_id").write.partitionBy("catalog_id").json(f"{folder}/entries")
        meta.coalesce(1).write.json(f"{folder}/meta.json")

    folder = versions.publish(index.sparkSession, path, write)
    return {"catalogs": f"{folder}/catalogs.json", "scores": f"{folder}/catalogs", "meta": f"{folder}/meta.json",
            "entries": f"{folder}/entries"}


# ------------------------------------------------------------------ state store
SWEEP_SCHEMA = ("processed_count bigint, total_known bigint, complete boolean, cursor timestamp, "
                "last_complete_sweep timestamp, coverage double")
STATE_SCHEMA = ("catalog_id string, tier string, status string, consecutive_failures bigint, "
                f"last_run_at string, {SWEEP_SCHEMA}, _corrupt_record string")


def state_write_lines(lines: DataFrame, path: str) -> None:
    """Write state as JSON lines (one line per catalog) from a ``value`` column."""
    lines.select("value").write.mode("overwrite").text(path)


def state_save(state: DataFrame, path: str) -> None:
    """Publish a run's state (any of the schema's columns) as the next version."""
    versions.save(state.select(F.to_json(F.struct(*state.columns)).alias("value")), path, "text")


def state_read(spark: SparkSession, path: str) -> DataFrame:
    """Read state, of the current version if there are versions; a missing folder is no state, a
    corrupt line yields no state for its catalog (PERMISSIVE mode)."""
    if not versions.listed(spark, path):
        return spark.createDataFrame([], STATE_SCHEMA).drop("_corrupt_record")
    df = (spark.read.schema(STATE_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(versions.current(spark, path) or path))
    return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


ENTRY_SCHEMA = ("catalog_id string, external_id string, modified_at timestamp, last_scored_at timestamp, "
                "overall double, _corrupt_record string")


def entries_read(spark: SparkSession, path: str) -> DataFrame:
    """Previous dataset entries (JSON lines, e.g. written by ``export_scores``).
    A missing folder reads as no entries; corrupt lines are dropped."""
    try:
        df = (spark.read.schema(ENTRY_SCHEMA).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
        df.schema  # resolves the path
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return spark.createDataFrame([], ENTRY_SCHEMA).drop("_corrupt_record")
    return df.where(F.col("_corrupt_record").isNull() & F.col("external_id").isNotNull()).drop("_corrupt_record")


# ------------------------------------------------------------------ load plan
def load_plan(manifest: DataFrame, as_of: str, ttl_hours: float = L.FILE_CACHE_TTL_HOURS,
              max_bytes: int = L.DIRECT_SCAN_THRESHOLD_BYTES) -> DataFrame:
    """Per URL: cache key (SHA-256 of the URL) and the way to load it.

    cached: cached and younger than the TTL; direct_scan: a probed size above
    the limit (an unknown size counts as within it); revalidate: stale cache
    with validators, conditional request; download: otherwise.
    """
    age = epoch_micros(F.lit(as_of).cast("timestamp")) - epoch_micros(F.col("cached_at"))
    fresh = F.col("cached_at").isNotNull() & (age < int(ttl_hours * HOUR_US))
    too_big = F.col("content_length").isNotNull() & (F.col("content_length") > max_bytes)
    action = (F.when(fresh, F.lit("cached")).when(too_big, F.lit("direct_scan"))
              .when(F.col("cached_at").isNotNull() & F.col("has_validators"), F.lit("revalidate"))
              .otherwise(F.lit("download")))
    return manifest.select("*", F.sha2(F.col("url"), 256).alias("cache_key"), action.alias("action"))


# ------------------------------------------------------------------ charset scan
def filesystem(uri: str):
    """(filesystem, path) for a folder URI: local, HDFS or object store."""
    from pyarrow import fs as pafs
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def named(path: str) -> str:
    """The path as Spark names it: with a scheme."""
    return ("" if ":/" in path else "file:") + path.rstrip("/")


def write_text_files(df: DataFrame, path: str, id_col: str, text_col: str, enc_col: str) -> DataFrame:
    """Each task writes its rows as raw files ``<id>.txt`` in the given encoding
    (into a shared folder); returns (id, path, bytes written)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        for pdf in it:
            sizes = []
            for rid, text, enc in zip(pdf[id_col], pdf[text_col], pdf[enc_col]):
                data = text.encode(enc)
                with fs.open_output_stream(f"{root}/{rid}.txt") as fh:
                    fh.write(data)
                sizes.append(len(data))
            names = [f"{named(path)}/{rid}.txt" for rid in pdf[id_col]]
            yield pd.DataFrame({id_col: pdf[id_col], "path": names, "n_bytes": sizes})
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, path string, n_bytes bigint"
    return df.select(id_col, text_col, enc_col).mapInPandas(run, schema)


FILES_A_TASK, BYTES_A_TASK = 2_000, 32 << 20
PIECE = 8 << 20                # bytes of a file that one row of work names
READ = 1 << 20


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes) of a folder's files, or of one file, listed in a task: the driver holds no
    names. Names that begin with ``_`` or ``.`` are left out, as Spark does."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs
        for _ in it:
            fs, root = filesystem(path)
            one = fs.get_file_info(root)
            if one.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            here = [one] if one.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
            files = [f for f in here if f.type == pafs.FileType.File and f.base_name[:1] not in "_."]
            head = named(path)
            for k in range(0, len(files), 10_000):
                some = files[k:k + 10_000]
                yield pd.DataFrame({"path": [head if f is one else f"{head}/{f.base_name}" for f in some],
                                    "n_bytes": [f.size for f in some]})
    return spark.range(0, 1, 1, 1).mapInPandas(run, "path string, n_bytes bigint")


def file_table(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(path, n_bytes) of ``source``: a folder, or such a table."""
    return (listed_files(spark, source) if isinstance(source, str) else source).select("path", "n_bytes")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with ``n_bytes``, dealt to tasks by number and bytes."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    return rows.repartition(max(1, -(-n // FILES_A_TASK), -(-size // BYTES_A_TASK)))


def file_contents(files: DataFrame) -> DataFrame:
    """(path, content) per file; a file is one row."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names, data, held = [], [], 0
            for name in b.column(0).to_pylist():
                fs, inside = filesystem(name)
                with fs.open_input_stream(inside) as f:
                    names.append(name)
                    data.append(f.read())
                held += len(data[-1])
                if held >= PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], names=["path", "content"])
                    names, data, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], names=["path", "content"])
    return files.select("path").mapInArrow(run, "path string, content binary")


def lines_from(f, start: int, stop: int) -> Iterator[bytes]:
    """The lines of an open file in the stretches behind line feeds that begin in [start, stop): read
    to their end, which may lie beyond; a file's pieces give each line once."""
    at, rest = start, b""
    if start:                                                  # from behind the first line feed
        f.seek(start - 1)
        at = start - 1
        while at < stop - 1:
            chunk = f.read(min(READ, stop - 1 - at))
            if not chunk:
                return
            k = chunk.find(b"\n")
            if k >= 0:
                at, rest = at + len(chunk), chunk[k + 1:]
                break
            at += len(chunk)
        else:
            return
    else:
        f.seek(0)
        rest = f.read(3)
        at = len(rest)
        rest = rest.removeprefix(MARKS[0][0])
    while True:
        # behind ``stop - 1`` the first line feed ends the last stretch
        inside = stop - 1 - at
        chunk = f.read(min(READ, inside)) if inside > 0 else f.read(READ)
        if inside <= 0:
            k = chunk.find(b"\n")
            if k >= 0 or not chunk:
                yield from (rest + chunk[:k + 1]).splitlines()
                return
        elif not chunk:
            yield from rest.splitlines()
            return
        at, rest = at + len(chunk), rest + chunk
        k = rest.rfind(b"\n") + 1
        if k:
            yield from rest[:k].splitlines()
            rest = rest[k:]


def raw_lines(files: DataFrame) -> DataFrame:
    """(path, value) per line of files of any size, as bytes: large files are many pieces."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(PIECE).cast("bigint"))
    pieces = files.select("path", "n_bytes", F.explode(starts).alias("start")) \
        .withColumn("stop", F.least(F.col("start") + PIECE, "n_bytes"))
    pieces = dealt(pieces.select("path", "start", "stop", (F.col("stop") - F.col("start")).alias("n_bytes")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, data, held = [], [], 0
        for b in it:
            for name, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                fs, inside = filesystem(name)
                with fs.open_input_file(inside) as f:
                    for line in lines_from(f, start, stop):
                        names.append(name)
                        data.append(line)
                        held += len(line) + 1
                        if held >= PIECE or len(data) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], names=["path", "value"])
                            names, data, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], names=["path", "value"])

    return pieces.select("path", "start", "stop").mapInArrow(run, "path string, value binary")


def file_encodings(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, encoding) per file, whatever its size: the byte order mark is read from the head, and
    lines are tested for valid UTF-8 piece by piece (a line feed never lies inside a UTF-8
    character), so no file has to be one row. ``path``: a folder, or a table (path, n_bytes)."""
    files = file_table(spark, path)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            marks = []
            for name in pdf["path"]:
                fs, inside = filesystem(name)
                with fs.open_input_stream(inside) as f:
                    head = f.read(3)
                marks.append(next((e for mark, e in MARKS if head.startswith(mark)), None))
            yield pd.DataFrame({"path": pdf["path"], "mark": marks})

    lines = raw_lines(files).groupBy("path").agg(F.min(F.is_valid_utf8(F.col("value").cast("string"))).alias("valid"))
    heads = dealt(files).select("path").mapInPandas(run, "path string, mark string")
    return heads.join(lines, "path", "left").select("path", F.coalesce(
        "mark", F.when(F.coalesce("valid", F.lit(True)), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1"))).alias("encoding"))


def decoded_lines(spark: SparkSession, path: str | DataFrame, encodings: DataFrame | None = None) -> DataFrame:
    """(path, line) of UTF-8 and Latin-1 files of any size, decoded as detected (``encodings``, if
    they are known); a large file is many rows in many tasks. (UTF-16 files have no lines of bytes;
    ``charset_scan`` reads them.)"""
    files = file_table(spark, path)
    found = (file_encodings(spark, files) if encodings is None else encodings).where(F.col("encoding") != "UTF-16")
    raw = raw_lines(files.join(found.select("path"), "path", "left_semi")).withColumn("value", F.col("value").cast("string"))
    line = F.when(F.col("encoding") == "UTF-8", F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return raw.join(found, "path").select("path", line.alias("line"))


def charset_scan(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Detect and decode raw text files: BOM first, then valid UTF-8, else Latin-1. ``path``: a
    folder, or a table (path, n_bytes). Files are read by the tasks that they are dealt to, so
    the driver holds neither names nor contents."""
    raw = file_contents(dealt(file_table(spark, path).where(F.col("path").endswith(".txt"))))
    c = F.col("content")
    head3 = F.hex(F.substring(c, 1, 3))
    head2 = F.substring(head3, 1, 4)
    as_str = c.cast("string")
    enc = (F.when(head3 == "EFBBBF", F.lit("UTF-8"))
           .when(head2.isin("FFFE", "FEFF"), F.lit("UTF-16"))
           .when(F.is_valid_utf8(as_str), F.lit("UTF-8"))
           .otherwise(F.lit("ISO-8859-1")))
    body = F.when(head3 == "EFBBBF", F.expr("substring(content, 4)")).otherwise(c)
    text = (F.when(enc == "UTF-16", F.decode(c, "UTF-16"))
            .when(enc == "UTF-8", F.decode(body, "UTF-8"))
            .otherwise(F.decode(c, "ISO-8859-1")))
    return raw.select("path", enc.alias("encoding"), text.alias("text"))
