import random

import pytest
from pyspark.sql import functions as F

from mirador.operators import numbering, rangejoin, sqlapi
from mirador.session import scratch_path
from mirador.sources import csvfiles, stores, versions

SCHEMA = "id string, title string, catalog_id string"


def rows(spark, catalogs, n=40, title="t"):
    return spark.createDataFrame([(f"{c}:{i}", f"{title}{i}", c) for c in catalogs for i in range(n)], SCHEMA)


def test_a_write_replaces_its_catalogs_only(spark):
    store = stores.CatalogStore(spark, scratch_path(spark, "store"), SCHEMA)
    assert store.load().count() == 0 and store.catalogs() == {}
    store.save(rows(spark, ["a", "b", "odd=name/x"]))
    store.save(rows(spark, ["b"], 3, "new"))
    got = {r[0]: r[1] for r in store.load().groupBy("catalog_id").count().collect()}
    assert got == {"a": 40, "b": 3, "odd=name/x": 40}
    assert {r.title[:3] for r in store.load(["b"]).collect()} == {"new"}
    assert store.load(["nothing"]).count() == 0


def test_a_failed_write_leaves_the_old_version(spark):
    store = stores.CatalogStore(spark, scratch_path(spark, "store"), SCHEMA)
    store.save(rows(spark, ["a"]))
    broken = rows(spark, ["a"], 9).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.save(broken)
    assert store.load().count() == 40


def test_orphans_are_removed(spark):
    store = stores.CatalogStore(spark, scratch_path(spark, "store"), SCHEMA)
    store.save(rows(spark, ["a", "b", "c"]))
    before = store.catalogs()
    assert store.remove_orphans(spark.createDataFrame([("b",), ("z",)], "id string")) == ["a", "c"]
    assert list(store.catalogs()) == ["b"] and store.load().count() == 40
    assert not versions.listed(spark, store.folder("a", before["a"]))
    assert store.remove_orphans(spark.createDataFrame([("b",)], "id string")) == []


def scanned_rows(df):
    """(files opened, rows out of the scan) of the executed plan."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if "AdaptiveSparkPlan" in p.getClass().getSimpleName():
            return walk(p.executedPlan())
        if "FileSourceScan" in p.getClass().getSimpleName():
            m = p.metrics()
            out.append((m.apply("numFiles").value(), m.apply("numOutputRows").value()))
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
    walk(plan)
    return out


def test_a_point_lookup_reads_one_folder_and_skips_row_groups(spark):
    store = stores.CatalogStore(spark, scratch_path(spark, "store"), SCHEMA)
    many = spark.range(60_000).select(F.concat(F.lit("a:"), F.md5(F.col("id").cast("string"))).alias("id"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit("a").alias("catalog_id"))
    store.save(many.unionByName(rows(spark, ["b", "c"])).repartition(1),
               **{"parquet.block.size": "200000", "parquet.bloom.filter.expected.ndv#id": "20000"})
    wanted = many.orderBy("id").offset(31_000).first()["id"]
    found = store.lookup([wanted], {wanted: "a"})
    assert [r.id for r in found.collect()] == [wanted]
    files = len([n for n in versions.listed(spark, store.folder("a", store.catalogs()["a"])) if n.startswith("part-")])
    (opened, out), = scanned_rows(found)
    assert opened <= files and 0 < out < 15_000                 # of 60,080 rows
    absent = "a:" + "7" * 20                                    # inside the ids' range; the filter says no
    assert scanned_rows(store.lookup([absent], {absent: "a"}))[0][1] < 15_000


def test_state_of_a_missing_folder_and_of_versions(spark):
    path = scratch_path(spark, "state")
    assert stores.state_read(spark, path).count() == 0
    for n in (1, 2):
        stores.state_save(spark.createDataFrame([("a", n)], "catalog_id string, processed_count bigint"), path)
    assert [(r.catalog_id, r.processed_count) for r in stores.state_read(spark, path).collect()] == [("a", 2)]


def test_numbers_have_no_gaps(spark):
    rng = random.Random(4)
    data = [("hot" if i % 3 else f"k{rng.randrange(5)}", rng.randrange(200), i) for i in range(3000)] + [(None, 1, 5000), (None, 0, 5001)]
    df = spark.createDataFrame(data, "k string, v int, id int").repartition(7)
    got = {(r.k, r.id): r.rn for r in numbering.numbered(df, ["k"], [F.col("v"), F.col("id")]).collect()}
    want = {}
    for k in {d[0] for d in data}:
        for n, (_, _, i) in enumerate(sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]))):
            want[k, i] = n + 1
    assert got == want
    alone = numbering.numbered(df, [], [F.col("id").desc()], "n").collect()
    assert [r.id for r in sorted(alone, key=lambda r: r.n)] == sorted((d[2] for d in data), reverse=True)
    assert numbering.numbered(df.limit(0), ["k"], [F.col("id")]).count() == 0


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(6)
    values = [(i, rng.choice([rng.uniform(-50, 50), float(rng.randrange(-9, 9)), None])) for i in range(400)]
    spans = [(i, lo, lo + rng.choice([0, 1e-9, 0.5, 1, 3, 40, 500])) for i, lo in
             enumerate(float(rng.randrange(-60, 60)) / rng.choice([1, 3]) for _ in range(150))] + [(900, None, 1.0), (901, 3.0, 1.0)]
    v = spark.createDataFrame(values, "vid int, x double")
    s = spark.createDataFrame(spans, "sid int, lo double, hi double")
    j = rangejoin.range_join(v, s, "x", "lo", "hi")
    assert "NestedLoop" not in j._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in j._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, k) for i, x in values for k, lo, hi in spans if None not in (x, lo) and lo <= x < hi)
    assert sorted((r.vid, r.sid) for r in j.collect()) == want
    assert rangejoin.range_join(v, s.limit(0), "x", "lo", "hi").count() == 0


@pytest.mark.parametrize("head, want", [
    (b"a,b\n1,2\n", ("UTF-8", ",", '"')), (b"a;b;c\n1,5;2;3\n2,5;x;y\n", ("UTF-8", ";", '"')),
    ("a\tb\né\tñ\n".encode("latin-1"), ("ISO-8859-1", "\t", '"')), (b"\xef\xbb\xbfa|b\n1|2\n", ("UTF-8", "|", '"')),
    ("a;b\n1;é\n".encode("utf-16"), ("UTF-16", ";", '"')), (b"'a','b'\n'x, y','2'\n'z','3'\n", ("UTF-8", ",", "'")),
    (b'a,b\n"x;y;z",2\n"p\nq;",3\n', ("UTF-8", ",", '"')), (b"", ("UTF-8", ",", '"')), (b"one\ntwo\n", ("UTF-8", ",", '"')),
    ("a,b\n1,é".encode()[:-1], ("UTF-8", ",", '"'))])
def test_dialect_of_a_head(head, want):
    assert csvfiles.sniff(head, True) == want


def test_files_of_several_dialects_are_united(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("nombre;edad\nAña;30\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text('nombre,edad,nota\n"Be\nto",4.5,"dice ""sí"""\n')
    df = sqlapi.read_csv_infer(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("Añan"[:3], 30.0, None), ("Be\nto", 4.5, 'dice "sí"')]
    assert csvfiles.encodings(spark, str(tmp_path)) == "ISO-8859-1,UTF-8"
    fixed = sqlapi.read_csv_infer(spark, str(tmp_path / "a.csv"), dialect={"sep": ";", "encoding": "ISO-8859-1"})
    assert fixed.columns == ["nombre", "edad"]


def test_quoted_line_break_behind_the_head(spark, tmp_path):
    body = "".join(f"{i},{'x' * 40}\n" for i in range(3000))
    (tmp_path / "c.csv").write_text("k,v\n" + body + '9999,"two\nlines"\n')
    df = sqlapi.read_csv_infer(spark, str(tmp_path / "c.csv"))
    assert df.count() == 3001 and df.where("k = 9999").first()["v"] == "two\nlines"
    found = {r.column_name: r for r in sqlapi.inspect_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert (found["k"].column_type, found["k"].row_count, found["k"].encoding) == ("int", 3001, "UTF-8")
    assert found["k"].preview == ["0", "1", "2", "3", "4"]


def test_encodings_without_reading_files_as_rows(spark, tmp_path):
    files = {"a.txt": "añb\nline é".encode(), "b.txt": "añb\nlíne".encode("latin-1"), "c.txt": "x\ny".encode("utf-16"),
             "d.txt": b"\xef\xbb\xbfz", "e.txt": b"plain\nascii\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.encoding for r in stores.file_encodings(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "UTF-8", "b.txt": "ISO-8859-1", "c.txt": "UTF-16", "d.txt": "UTF-8", "e.txt": "UTF-8"}
    lines = {}
    for r in stores.decoded_lines(spark, str(tmp_path)).collect():
        lines.setdefault(r.path.rsplit("/", 1)[1], set()).add(r.line)
    assert lines["b.txt"] == {"añb", "líne"} and lines["a.txt"] == {"añb", "line é"} and "c.txt" not in lines


def test_files_are_scanned_without_a_listing_on_the_driver(spark, tmp_path, monkeypatch):
    lines = ["", "uno", "dos  tres", "", "x" * 40, "año", "y\rz", "fin"]
    for k, end in enumerate(["\n", "\r\n", ""]):
        (tmp_path / f"{k}.txt").write_bytes((end or "\n").join(lines).encode() + end.encode())
    (tmp_path / "9.txt").write_bytes(b"")
    files = stores.listed_files(spark, str(tmp_path))
    assert stores.charset_scan(spark, files).inputFiles() == []          # no file index that names every file
    assert stores.decoded_lines(spark, files).inputFiles() == []
    want = sorted((k, x) for k in range(3) for line in lines for x in line.split("\r"))
    for piece in (4, 5, 7, 16, 8 << 20):                                 # pieces give every line once
        monkeypatch.setattr(stores, "PIECE", piece)
        got = [(int(r.path[-5]), r.line) for r in stores.decoded_lines(spark, files).collect()]
        assert sorted(got) == want, piece
    assert {r.path[-5]: r.text for r in stores.charset_scan(spark, files).collect()}["9"] == ""
