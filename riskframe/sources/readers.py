"""Readers: CSV dialect sniffing, workbook ingest, JSON lists, extension dispatch.

Separator, encoding and quoted line breaks are decided for every CSV file by itself
(:mod:`riskframe.sources.csv_files`).  Every column is read as STRING and typed explicitly
downstream (no ``inferSchema`` pass over the data).
"""

from __future__ import annotations

import array
import functools
import io
import itertools
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources import csv_files as CSV

def sniff_csv(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, encoding) of the first file; the byte-order mark is dropped by the reader."""
    first = next(iter(CSV.dialects(spark, path)), None)
    return (first.sep, first.encoding) if first else (CSV.SEPARATORS[0], CSV.UTF8)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
             keep_blanks: bool = False) -> DataFrame:
    """Sniff each file's dialect where not given, read all columns as STRING, strip header names.

    Files of a folder may differ in separator, encoding and columns; a column that a file lacks is missing there.
    An empty field is missing (NULL), whether it was quoted or not.
    ``keep_blanks`` keeps leading/trailing blanks of values as they are."""
    found = CSV.dialects(spark, path)
    if not found:  # not a single line: there is no header, either
        return spark.createDataFrame([], "value string").drop("value")
    if sep or encoding:
        found = [CSV.with_given(d, sep, encoding) for d in found]
    return CSV.read_files(spark, found, keep_blanks)


# ---- S3: workbook ingest -----------------------------------------------------
#: Bytes of a string table held in memory, strings of it kept ready, and rows of a batch.
SHARED_IN_MEMORY, SHARED_CACHED, WORKBOOK_BATCH = 1 << 25, 100_000, 10_000
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The file of the workbook's first sheet: by the workbook's own order, not by file names."""
    book, names = "xl/workbook.xml", z.namelist()
    rels = "xl/_rels/workbook.xml.rels"
    if book in names and rels in names:
        sheet = ET.fromstring(z.read(book)).find("m:sheets/m:sheet", _NS)
        if sheet is not None:
            rid = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
            for rel in ET.fromstring(z.read(rels)):
                if rel.get("Id") == rid:
                    target = rel.get("Target").lstrip("/")
                    return target if target.startswith("xl/") else "xl/" + target
    return sorted(n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n))[0]


class SharedStrings:
    """A workbook's string table: a little of it in memory, a long one in a file of the task."""

    def __init__(self):
        self.data, self.ends = tempfile.SpooledTemporaryFile(SHARED_IN_MEMORY), array.array("q", [0])
        self.get = functools.lru_cache(SHARED_CACHED)(self._read)

    def add(self, text: str) -> None:
        self.ends.append(self.ends[-1] + self.data.write(text.encode()))

    def _read(self, i: int) -> str:
        self.data.seek(self.ends[i])
        return self.data.read(self.ends[i + 1] - self.ends[i]).decode()


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ET.Element]:
    """The elements ``tag`` of an XML part, one at a time; what was read is forgotten."""
    tag, above = f"{{{_NS['m']}}}{tag}", []
    with z.open(name) as part:
        for event, el in ET.iterparse(part, ("start", "end")):
            if event == "start":
                above.append(el)
                continue
            above.pop()
            if el.tag == tag:
                yield el
                if above:
                    above[-1].clear()


def workbook_rows(content: bytes) -> Iterator[dict[int, str | None]]:
    """Rows of the first worksheet as {column number: text}; only one row is held at a time."""
    z = zipfile.ZipFile(io.BytesIO(content))
    text, shared = f"{{{_NS['m']}}}t", SharedStrings()
    if "xl/sharedStrings.xml" in z.namelist():
        for si in _elements(z, "xl/sharedStrings.xml", "si"):
            shared.add("".join(t.text or "" for t in si.iter(text)))
    for r in _elements(z, _first_sheet(z), "row"):
        cells: dict[int, str | None] = {}
        for c in r.findall("m:c", _NS):
            if c.get("t") == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(text))
            else:
                v = c.find("m:v", _NS)
                val = None if v is None else v.text
                if c.get("t") == "s" and val is not None:
                    val = shared.get(int(val))
            cells[_col_index(c.get("r"))] = val
        yield cells


def _column_name(header: dict[int, str | None], i: int) -> str:
    return str(header.get(i) or f"col{i}").strip()


def workbook_columns(content: bytes) -> list[str]:
    """Names of all columns that any row has: the first row's texts, ``col<number>`` where it has none."""
    rows = workbook_rows(content)
    header = next(rows, None)
    if header is None:
        return []
    width = max((max(r) + 1 for r in itertools.chain([header], rows) if r), default=0)
    return [_column_name(header, i) for i in range(width)]


def parse_xlsx(content: bytes) -> pd.DataFrame:
    """First worksheet of an .xlsx file as a string DataFrame (stdlib zip + XML)."""
    names = workbook_columns(content)
    body = [[r.get(i) for i in range(len(names))] for r in itertools.islice(workbook_rows(content), 1, None)]
    return pd.DataFrame(body, columns=names, dtype=object) if names else pd.DataFrame()


def write_xlsx(pdf: pd.DataFrame) -> bytes:
    """Minimal .xlsx writer (inline strings), used to derive workbook inputs from tables."""
    def cell(ref, v):
        if v is None or (isinstance(v, float) and pd.isna(v)):
            return ""
        s = str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{s}</t></is></c>'

    def ref(ci, ri):
        name, n = "", ci + 1
        while n:
            n, rem = divmod(n - 1, 26)
            name = chr(65 + rem) + name
        return f"{name}{ri}"

    lines = ['<row r="1">' + "".join(cell(ref(i, 1), c) for i, c in enumerate(pdf.columns)) + "</row>"]
    for ri, row in enumerate(pdf.itertuples(index=False), start=2):
        lines.append(f'<row r="{ri}">' + "".join(cell(ref(i, ri), v) for i, v in enumerate(row)) + "</row>")
    sheet = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="%s"><sheetData>%s</sheetData></worksheet>'
             % (_NS["m"], "".join(lines)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="%s" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>' % _NS["m"])
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return buf.getvalue()


def read_workbooks(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """S3: every ``.xlsx`` under ``path`` -> rows (first sheet), one task per workbook file.

    A task holds the compressed file, a batch of rows and some of the string table, whatever the size of the sheet.

    ``columns`` is the expected header (all STRING); missing ones come back NULL.  Without it
    the header is the union of the files' headers, which are read first.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    if not columns:
        def headers(it):
            for pdf in it:
                for content in pdf["content"]:
                    yield pd.DataFrame({"c": workbook_columns(bytes(content))}, dtype=object)
        columns = [r["c"] for r in files.mapInPandas(headers, "c string").distinct().orderBy("c").collect()]
    schema = ", ".join(f"`{c}` string" for c in columns)

    def parse(it):
        for pdf in it:
            for content in pdf["content"]:
                rows = workbook_rows(bytes(content))
                header = next(rows, {})
                place = {}
                while batch := list(itertools.islice(rows, WORKBOOK_BATCH)):
                    for i in {i for r in batch for i in r} | set(header):
                        place.setdefault(_column_name(header, i), i)
                    yield pd.DataFrame({c: pd.Series([r.get(place.get(c)) for r in batch], dtype=object) for c in columns})

    return files.mapInPandas(parse, schema)


#: Rows of a written workbook, which a task holds whole (a sheet cannot hold more than 1,048,576).
WORKBOOK_ROWS = 20_000


def write_workbooks(df: DataFrame, path: str, rows: int = WORKBOOK_ROWS) -> None:
    """Write each partition of ``df`` as ``.xlsx`` files of at most ``rows`` rows under ``path`` (inputs for S3).

    Files go through Arrow's file systems to the shared store, named by partition, place and attempt;
    each is written under a hidden name and moved when whole.  A task holds the rows of one file."""
    cols = df.columns

    def write(it):
        from pyarrow import fs
        from pyspark import TaskContext
        store, base = fs.FileSystem.from_uri(path)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()

        def save(k, pdf):
            store.create_dir(base, recursive=True)
            name = f"part-{part:05d}-{k:05d}"
            hidden = f"{base}/_{name}-{attempt}"
            with store.open_output_stream(hidden, compression=None) as out:
                out.write(write_xlsx(pdf[cols]))
            store.move(hidden, f"{base}/{name}.xlsx")  # a repeated attempt replaces the file
            return pd.DataFrame({"n": [len(pdf)]})

        k, held = 0, None
        for pdf in it:
            held = pdf if held is None else pd.concat([held, pdf])
            while len(held) >= rows:
                yield save(k, held[:rows])
                k, held = k + 1, held[rows:]
        if held is not None and len(held):
            yield save(k, held)

    df.select(*[F.col(c).cast("string") for c in cols]).mapInPandas(write, "n long").agg(F.sum("n")).first()


# ---- S13 / S16 / S5 / S14 ------------------------------------------------------
def read_json_records(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """JSON records, one per line or one array per file (decided by the first character)."""
    if multi_line is None:
        head = spark.read.text(path).filter(F.trim("value") != "").first()
        multi_line = head is not None and head["value"].lstrip("\ufeff ").startswith("[")
    return spark.read.option("multiLine", multi_line).json(path)


READERS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".xlsx": "xlsx"}


def read_any(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Choose the reader from the file extension; unsupported -> ValueError."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    kind = READERS.get(ext)
    if kind is None:
        raise ValueError(f"unsupported format: {ext or path} (use .csv, .parquet, .json or .xlsx)")
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return read_json_records(spark, path)
    return read_workbooks(spark, path, columns)


def input_guard(df: DataFrame) -> DataFrame:
    """One-row report (n_rows, n_columns, empty)."""
    n_cols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(n_cols).alias("n_columns"), ((F.col("n_rows") == 0) | F.lit(n_cols == 0)).alias("empty"))


def preview(df: DataFrame, order_by: str, n: int = 8) -> DataFrame:
    """First ``n`` rows in a stable order (missing stays NULL)."""
    return df.orderBy(order_by).limit(n)


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each column (name -> type) only when it is absent."""
    out = df
    for c, t in columns.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out
