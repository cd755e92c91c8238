import gzip
import json
import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollcall.operators.rows import in_input_order
from rollcall.plans.collate import collate
from rollcall.sources import csv as c
from rollcall.sources.files import HIDDEN, NOTHING, OTHER_SUFFIX, discover, find_files, unique_paths
from rollcall.sources.typed_json import first_tag_value, flatten_typed_json


@pytest.fixture
def put(tmp_path):
    def write(name, data):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(path)

    return write


def values(spark, path, **kw):
    return [tuple(r) for r in c.read_csv(spark, path, **kw).collect()]


@pytest.mark.parametrize("multiline", [True, False])
def test_edge_bytes(spark, put, multiline):
    text = 'a,b,c\n1,2\n\n1,2,3,4\n" x ",NA,null\n'
    got = values(spark, put("e.csv", text), multiline=multiline)
    assert got == [("1", "2", ""), ("1", "2", "3"), ("x", "NA", "null")]


@pytest.mark.parametrize("multiline", [True, False])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends_and_mark(spark, put, end, multiline):
    text = "﻿" + end.join(["a,b", "1,2", "3,4"]) + end
    path = put("l.csv", text)
    assert c.read_csv(spark, path, multiline=multiline).columns == ["a", "b"]
    assert values(spark, path, multiline=multiline) == [("1", "2"), ("3", "4")]


def test_untrimmed(spark, put):
    assert values(spark, put("u.csv", 'a,b\n x ," y "\n'), trim=False) == [(" x ", " y ")]
    assert values(spark, put("u.csv", 'a,b\n x ," y "\n')) == [("x", "y")]


def test_separator_and_encoding(spark, put):
    path = put("s.csv", "näme;b\nü;2\n".encode("latin-1"))
    df = c.read_csv(spark, path, sep=";", encoding="ISO-8859-1")
    assert df.columns == ["näme", "b"] and rows(df) == [("ü", "2")]
    bom = put("bom.csv", "﻿a,b\n1,2\n")
    assert c.read_csv(spark, bom, encoding="utf-8-sig").columns == ["a", "b"]


def test_header_over_two_lines(spark, put):
    df = c.read_csv(spark, put("h.csv", 'a,"b\nb"\n1,2\n'))
    assert df.columns == ["a", "b\nb"] and rows(df) == [("1", "2")]


def test_header_only_and_empty_files(spark, put):
    paths = [put("0.csv", ""), put("1.csv", "a,b\n"), put("2.csv", "b,c\n1,2\n"), put("3.csv", " \n")]
    loaded = c.read_many(spark, paths)
    assert loaded.df.columns == ["a", "b", "c", "_file_ord", "_row_ord"]
    assert rows(loaded.df, "a", "b", "c", "_file_ord") == [("", "1", "2", 2)]
    assert rows(c.file_inventory(loaded), "_file_ord", "rows", "columns") == [
        (0, 0, 0), (1, 0, 2), (2, 1, 2), (3, 0, 0),
    ]
    assert c.read_many(spark, paths[:1]).df.count() == 0
    assert c.read_csv(spark, paths[0]).columns == []


def test_columns_are_bound_by_each_header(spark, put):
    paths = [put("1.csv", "a,b\n1,2\n"), put("2.csv", "b,a\n2,1\n"), put("3 x.csv", "a,b\n1,2\n")]
    loaded = c.read_many(spark, paths)
    assert set(rows(loaded.df, "a", "b")) == {("1", "2")}
    assert rows(loaded.df, "_file_ord") == [(0,), (1,), (2,)]
    assert c.headers(spark, paths)[paths[1]] == ["b", "a"]
    with pytest.raises(Exception):
        c.read_csv(spark, paths[:2]).collect()


def test_odd_file_names(spark, put, tmp_path):
    names = ["a b.csv", "p%20q.csv", "x[1].csv", "é.csv"]
    paths = [put(n, f"a\n{n}\n") for n in names]
    assert discover(spark, str(tmp_path)) == sorted(paths)
    loaded = c.read_many(spark, paths)
    assert rows(loaded.df, "_file_ord", "a") == list(enumerate(names))
    assert not loaded.skipped


def test_repeated_header(spark, put):
    path = put("r.csv", "a,b,a\n1,2,3\n")
    with pytest.raises(ValueError, match="repeated header names: a"):
        c.read_many(spark, [path])
    loaded = c.read_many(spark, [path], c.CsvFormat(duplicate_headers="last"))
    assert rows(loaded.df, "a", "b") == [("3", "2")]


def test_names_by_case_only(spark, put):
    path = put("c.csv", "Date,date\n1,2\n")
    with pytest.raises(ValueError, match="caseSensitive"):
        c.read_many(spark, [path])
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert rows(c.read_many(spark, [path]).df, "Date", "date") == [("1", "2")]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_unreadable_files(spark, put, tmp_path):
    good, gone = put("g.csv", "a\n1\n"), str(tmp_path / "gone.csv")
    loaded = c.read_many(spark, [gone, good])
    assert list(loaded.skipped) == [gone] and rows(loaded.df, "a", "_file_ord") == [("1", 1)]
    with pytest.raises(Exception):
        c.read_many(spark, [gone, good], on_error="raise")
    with pytest.raises(ValueError, match="none of the 1"):
        c.read_many(spark, [gone])
    with pytest.raises(ValueError, match="no input"):
        c.read_many(spark, [])


def test_bad_gzip_is_skipped(spark, put):
    good = put("g.csv.gz", gzip.compress(b"a\n1\n"))
    loaded = c.read_many(spark, [put("bad.csv.gz", b"not gzip at all"), good])
    assert len(loaded.skipped) == 1 and rows(loaded.df, "a") == [("1",)]


def test_row_order_over_splits(spark, put):
    """Ordinals follow the lines of a file that is cut into many partitions."""
    lines = [f"{i},{'x' * (i % 50)}" for i in range(20_000)]
    paths = [put(f"{n}.csv", "i,pad\n" + "\n".join(lines) + "\n") for n in "abc"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        loaded = c.read_many(spark, paths, c.CsvFormat(multiline=False))
        assert loaded.df.rdd.getNumPartitions() > 15
        got = [(r._file_ord, int(r.i)) for r in in_input_order(loaded.df).collect()]
        assert got == [(f, i) for f in range(3) for i in range(20_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_discover(spark, put, tmp_path):
    for name in ("b.csv", "a.csv", "c.CSV", "d.txt", "sub/e.csv"):
        put(name, "" if name == "b.csv" else "a\n1\n")
    base = str(tmp_path)

    def short(paths):
        return [p.removeprefix(base + "/") for p in paths]

    assert short(discover(spark, base)) == ["a.csv", "b.csv"]
    assert short(discover(spark, base, recursive=True)) == ["a.csv", "b.csv", "sub/e.csv"]
    assert short(discover(spark, base, pattern="*.txt")) == ["d.txt"]
    assert short(discover(spark, [f"{base}/b.csv", base])) == ["b.csv", "a.csv"]
    assert short(discover(spark, f"{base}/*")) == ["a.csv", "b.csv", "c.CSV"]
    assert discover(spark, [f"{base}/d.txt", f"{base}/none*"]) == []
    assert short(discover(spark, [f"file://{base}/b.csv", f"file:{base}"])) == ["b.csv", "a.csv"]
    assert unique_paths(["x", "y", "x"]) == ["x", "y"]


def test_discover_relative(spark, put, tmp_path):
    put("d/a.csv", "a\n1\n")
    below = os.path.relpath(tmp_path)
    for given in (f"{below}/d", f"{below}/d/a.csv", f"{below}/*/a.csv"):
        assert discover(spark, given) == [f"{tmp_path}/d/a.csv"]


def test_no_input_is_dropped_unreported(spark, put, tmp_path):
    for name in ("a.csv", "_x.csv", ".x.csv", "n.txt", "_t/b.csv", "x[1].csv"):
        put(name, "a\n1\n")
    base = str(tmp_path)
    found = find_files(spark, [base, f"{base}/x[1].csv", f"{base}/gone.csv", f"{base}/n.txt", f"{base}/q*.csv", f"{base}/_x.csv"], recursive=True)
    assert found.paths == [f"{base}/a.csv", f"{base}/x[1].csv"]
    assert found.skipped == {
        f"{base}/_x.csv": HIDDEN,
        f"{base}/.x.csv": HIDDEN,
        f"{base}/_t/b.csv": HIDDEN,
        f"{base}/gone.csv": NOTHING,
        f"{base}/n.txt": OTHER_SUFFIX,
        f"{base}/q*.csv": NOTHING,
    }
    fates = found.frame(spark)
    assert fates.columns == ["input", "path", "fate"] and fates.where("fate = 'given before'").count() == 1
    with pytest.raises(FileNotFoundError, match="gone.csv"):
        find_files(spark, [f"{base}/a.csv", f"{base}/gone.csv"], on_error="raise")
    merged = collate(spark, [base, f"{base}/gone.csv"], keys=None)
    assert set(merged.loaded.skipped) == {f"{base}/_x.csv", f"{base}/.x.csv", f"{base}/gone.csv"}
    with pytest.raises(FileNotFoundError):
        collate(spark, [base, f"{base}/gone.csv"], keys=None, on_error="raise")


def _jobs(spark, work):
    """Jobs that ``work`` runs."""
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_headers_of_many_files_take_no_job(spark, put):
    paths = [put(f"{i:02}.csv", f"a,b{i % 3}\n1,2\n") for i in range(40)]
    assert _jobs(spark, lambda: c.probe_files(spark, paths)) == 0
    assert _jobs(spark, lambda: spark.range(3).count()) > 0
    found = c.headers(spark, paths)
    assert [found[p] for p in paths] == [["a", f"b{i % 3}"] for i in range(40)]


def test_header_scan_stops_after_the_header(spark, put):
    """The tail of this file cannot be read, so a scan that went on would fail."""
    digits = random.Random(1).randbytes(25_000_000).hex(",", 20).replace(",", "\n")
    whole = gzip.compress(b"a,b\n" + digits.encode(), 1)
    path = put("cut.csv.gz", whole[: len(whole) // 2])
    assert c.headers(spark, [path]) == {path: ["a", "b"]}
    with pytest.raises(Exception):
        c.read_csv(spark, path).count()


def test_headers_with_blank_and_padded_names(spark, put):
    assert c.read_csv(spark, put("b.csv", "a,,b\n1,2,3\n")).columns == ["a", "_c1", "b"]
    df = c.read_csv(spark, put("p.csv", '" a ",b\n1, 2 \n'))
    assert df.columns == ["a", "b"] and rows(df) == [("1", "2")]
    other = put("q.csv", "a,c\n1,2\n")
    with pytest.raises(ValueError, match="another header"):
        c.read_csv(spark, [put("p.csv", "a,b\n1,2\n"), other])


def test_headers_in_another_encoding(spark, put):
    paths = [put("u.csv", "é;b\n1;2\n".encode("utf-16-le")), put("v.csv", '"x\ny";é\n3;4\n'.encode("utf-16-le")), put("w.csv", b"")]
    loaded = c.read_many(spark, paths, c.CsvFormat(sep=";", encoding="UTF-16LE"))
    assert [f.header for f in loaded.files] == [("é", "b"), ("x\ny", "é"), ()]
    assert rows(loaded.df, "é", "b", "x\ny") == [("1", "2", ""), ("4", "", "3")]


LINE = '{"ParticipantID":{"S":"p1"},"n":{"N":"5"},"flag":true,"z":null,"l":{"L":[{"S":"a"}]},"e":{}}'


def test_typed_json(spark):
    df = spark.createDataFrame([(LINE,)], "line string")
    flat = flatten_typed_json(df, "line")
    assert flat.first().asDict() == {
        "ParticipantID": "p1", "n": "5", "flag": "true", "z": None, "l": '[{"S":"a"}]', "e": None,
    }


def test_typed_json_edges(spark):
    lines = ['{"q":"{\\"S\\":\\"x\\"}","b":[1,2]}', '{"q":{"S":"{x"}}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    flat = flatten_typed_json(df, "line", ["q", "b"])
    assert rows(flat) == [(0, '{"S":"x"}', "[1,2]"), (1, "{x", None)]
    tags = spark.createDataFrame([('{"A":"1","B":"2"}',), ("{}",), (None,)], "v string")
    assert rows(tags.select(first_tag_value(F.col("v")))) == sorted([("1",), (None,), (None,)], key=repr)


def test_row_numbers_do_not_depend_on_the_splits(spark, put):
    """One file cut into many splits, small files packed together, and lines of several rows."""
    paths = [put("big.csv", "k,v\n" + "".join(f"{i},{'x' * (i % 40)}\n" for i in range(5000)))]
    paths += [put(f"s{i}.csv", f"k\n{i}\n{i}b\n") for i in range(5)]
    seen = []
    for bytes_, multiline in (("4096", False), ("1000000", False), ("4096", True)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        try:
            df = c.read_many(spark, paths, c.CsvFormat(multiline=multiline)).df
            seen.append(rows(df, "_file_ord", "_row_ord", "k"))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == seen[2]
    assert [r for r in seen[0] if r[0] == 0] == sorted(((0, i, str(i)) for i in range(5000)), key=repr)
    assert [r for r in seen[0] if r[0] == 3] == [(3, 0, "2"), (3, 1, "2b")]


@pytest.mark.parametrize("n", ["1", "7"])
def test_row_numbers_at_two_partition_counts(spark, put, n):
    path = put("p.csv", "k\n" + "".join(f"{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.minPartitionNum", n)
    try:
        df = c.read_many(spark, [path], c.CsvFormat(multiline=False)).df
        assert all(int(r.k) == r._row_ord for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_typed_json_of_many_fields(spark):
    fields = {f"f{i:05}": {"S": str(i)} for i in range(1200)}
    df = spark.createDataFrame([(json.dumps(fields),), ('{"f00001":{"S":"x"},"f00001":{"S":"y"}}',)], "line string")
    flat = flatten_typed_json(df, "line")
    assert len(flat.columns) == 1200 and flat.columns == sorted(fields)
    assert rows(flat, "f00000", "f00001", "f01199") == sorted([("0", "1", "1199"), (None, "x", None)], key=repr)
