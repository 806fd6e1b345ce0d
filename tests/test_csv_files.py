"""CSV folders: a dialect per file, records across splits, against Python's own reader."""

import csv
import io
import os
import random

import pytest

from riskframe.session import scratch_path
from riskframe.sources import csv_files as CSV
from riskframe.sources import readers as RD


def folder(spark, files):
    path = scratch_path(spark, "csv")
    os.makedirs(path)
    for name, data in files.items():
        with open(os.path.join(path, name), "wb") as fh:
            fh.write(data)
    return path


def test_each_file_keeps_its_own_dialect(spark):
    rows = "id{0}Género{0}nota\n{1}{0}Sí{0}\"a{0}b\"\n"
    path = folder(spark, {"a.csv": rows.format(",", 1).encode(), "b.csv": rows.format(",", 2).encode("latin-1"), "c.csv": rows.format(";", 3).encode(),
                          "d d%20.csv": "\ufeffid\tGénero\tnota\n4\tSí\t\"a\nb\"\n".encode(), "e.csv": b"id|otra\n5|x\n", "f.csv": b""})
    df = RD.read_csv(spark, path)
    assert df.columns == ["id", "Género", "nota", "otra"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == [("1", "Sí", "a,b", None), ("2", "Sí", "a,b", None), ("3", "Sí", "a;b", None), ("4", "Sí", "a\nb", None), ("5", None, None, "x")]
    found = {os.path.basename(d.file): (d.sep, d.encoding, d.broken) for d in CSV.dialects(spark, path)}
    assert found == {"a.csv": (",", "UTF-8", False), "b.csv": (",", "ISO-8859-1", False), "c.csv": (";", "UTF-8", False),
                     "d d%20.csv": ("\t", "UTF-8", True), "e.csv": ("|", "UTF-8", False)}


@pytest.mark.parametrize("split", [200, 1000, 1 << 20])
@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_quoted_line_breaks_across_splits(spark, split, encoding):
    rng = random.Random(split)
    rows = []
    for i in range(400):
        cell = "".join(rng.choice(["a", "é", "\n", '"', ",", " ", "\n\n", "line\n"]) for _ in range(rng.choice([0, 1, 5, 30]))).strip()
        rows.append([str(i), cell, rng.choice(["x", "", "y\nz"])])
    rows.append(["400", "long\n" * 300 + "end", "spans many splits"])
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([["id", "a\nb", "c"], *rows])
    path = folder(spark, {"one.csv": text.getvalue().encode(encoding), "two.csv": text.getvalue().encode(encoding)})
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = RD.read_csv(spark, path)
        got = sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))
        splits = CSV.lines_of(spark, path).select("f", "b").distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert splits > 20 if split == 200 else splits >= 2
    want = [tuple(v or None for v in r) for r in csv.reader(io.StringIO(text.getvalue()))][1:]
    assert got == sorted(want + want, key=lambda r: int(r[0]))


def test_given_dialect_empty_folder_and_repeated_headers(spark):
    path = folder(spark, {"a.csv": b"a;b,c\n1;2,3\n"})
    assert RD.read_csv(spark, path, sep=";").columns == ["a", "b,c"]
    assert RD.sniff_csv(spark, path) == (",", "UTF-8")
    assert RD.read_csv(spark, folder(spark, {"x.csv": b""})).count() == 0
    plain = RD.read_csv(spark, folder(spark, {"a.csv": b"a,A,,b\n1,2,3,4\n"}))
    broken = RD.read_csv(spark, folder(spark, {"a.csv": b'a,A,,b\n1,2,3,"4\n4"\n'}))
    assert plain.columns == broken.columns
