"""Workbooks are read row by row: bounded memory, string tables on disk, the same rows."""

import io
import tracemalloc
import zipfile

import pandas as pd

from riskframe.sources import readers as RD


def book(rows, shared):
    """A workbook whose cells are numbers of its string table."""
    ns = RD._NS["m"]
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{c}{i}" t="s"><v>{k}</v></c>' if k is not None else "" for c, k in zip("ABC", r)) + "</row>"
                   for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><r><t>{x[:2]}</t></r><r><t>{x[2:]}</t></r></si>" for x in shared) + "</sst>")
    return out.getvalue()


def test_string_table_and_columns_beyond_the_header(monkeypatch):
    monkeypatch.setattr(RD, "SHARED_IN_MEMORY", 10)  # the table goes to disk
    shared = ["id", "name", "é1", "x" * 50, "ñandú"]
    data = book([(0, 1, None), (2, None, 3), (4, 3, None)], shared)
    assert RD.workbook_columns(data) == ["id", "name", "col2"]
    got = RD.parse_xlsx(data)
    assert got.astype(object).where(got.notna(), None).values.tolist() == [["é1", None, "x" * 50], ["ñandú", "x" * 50, None]]
    assert RD.parse_xlsx(book([], [])).empty


def test_a_long_sheet_needs_little_memory():
    n = 60_000
    data = RD.write_xlsx(pd.DataFrame({"id": range(n), "text": ["some words that repeat " * 4] * n}))
    tracemalloc.start()
    rows = sum(1 for _ in RD.workbook_rows(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n + 1 and peak < 8 << 20  # the sheet's XML alone has over 8 MB
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.getinfo("xl/worksheets/sheet1.xml").file_size > 8 << 20


def test_partitions_are_written_as_several_workbooks(spark, tmp_path):
    df = spark.range(0, 2500, 1, 2).selectExpr("id", "concat('v', id) AS v")
    RD.write_workbooks(df, str(tmp_path / "books"), 400)
    assert len(list((tmp_path / "books").glob("*.xlsx"))) == 8  # 1,250 rows a partition
    got = RD.read_workbooks(spark, str(tmp_path / "books"), ["id", "v"])
    assert sorted((int(r["id"]), r["v"]) for r in got.collect()) == [(k, f"v{k}") for k in range(2500)]
