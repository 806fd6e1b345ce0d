"""CSV folders of mixed files (S1, S2): a dialect per file, and quoted line breaks in splittable files.

One pass over all lines decides for every file: its header, whether all its bytes are UTF-8, and whether any
line has an odd number of quotes (then quoted values hold line breaks).  Files of one dialect and header are read
together by ``spark.read.csv``.  Files with quoted line breaks are read by their splits, too: a line
break ends a record if the number of quotes before it is even, so each split needs only the parity of the
quotes in the splits before it, a running sum over one small row per split.  Records that cross a
split are put together from their ends.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.session import cut_lineage, ship_package

SEPARATORS = [",", ";", "\t", "|"]
UTF8, LATIN1 = "UTF-8", "ISO-8859-1"
PIECES = "f string, b long, kind int, first boolean, text string"
RECORD, TAIL, MIDDLE, HEAD = range(4)


class Dialect(NamedTuple):
    file: str
    sep: str
    encoding: str
    broken: bool  # quoted values hold line breaks
    columns: tuple[str, ...]
    head: bytes


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(f, b, v): the lines of all files as bytes, with their file and the first byte of their split."""
    ship_package(spark)
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                                         F.col("value").cast("binary").alias("v"))


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Consecutive lines of one split of one file."""
    f, b = batch.column("f").to_pylist(), batch.column("b").to_pylist()
    v = batch.column("v").to_pylist()
    for key, some in groupby(range(len(f)), lambda i: (f[i], b[i])):
        at = list(some)
        yield key, v[at[0]:at[-1] + 1]


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def _first_record(lines: list[bytes]) -> bytes:
    quotes = 0
    for k, line in enumerate(lines):
        quotes += line.count(b'"')
        if quotes % 2 == 0:
            return b"\n".join(lines[:k + 1])
    return lines[0]


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split and batch: its first line if the file begins there, bytes that are no UTF-8, lines with an odd number of quotes."""
    last = None
    for batch in batches:
        rows = []
        for key, lines in _segments(batch):
            joined = b"\n".join(lines)
            odd = b'"' in joined and any(x.count(b'"') % 2 for x in lines)
            rows.append((key[0], _first_record(lines) if key[1] == 0 and key != last else None, not _is_utf8(joined), odd))
            last = key
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.bool_(), pa.bool_()))]
                              if rows else [pa.array([], t) for t in (pa.string(), pa.binary(), pa.bool_(), pa.bool_())],
                              names=["f", "head", "bad", "odd"])


def dialects(spark: SparkSession, path: str | list[str]) -> list[Dialect]:
    """One dialect per file that has a line, by file name: the separator is the first that splits the header."""
    seen = lines_of(spark, path).mapInArrow(_look, "f string, head binary, bad boolean, odd boolean").groupBy("f").agg(
        F.max("head").alias("head"), F.bool_or("bad").alias("bad"), F.bool_or("odd").alias("odd")).collect()  # a row per file
    out = []
    for r in sorted(seen, key=lambda r: r["f"]):
        encoding, head = LATIN1 if r["bad"] else UTF8, bytes(r["head"])
        sep = next((x for x in SEPARATORS if x.encode() in head), SEPARATORS[0])
        out.append(Dialect(unquote(r["f"]), sep, encoding, r["odd"], columns_of(head, sep, encoding), head))
    return out


def columns_of(head: bytes, sep: str, encoding: str) -> tuple[str, ...]:
    header = head.decode(encoding, "replace").lstrip("\ufeff")
    return tuple(c.strip() for c in next(csv.reader(io.StringIO(header), delimiter=sep), []))


def with_given(found: Dialect, sep: str | None, encoding: str | None) -> Dialect:
    """A dialect with the separator or encoding that the caller knows."""
    sep, encoding = sep or found.sep, encoding or found.encoding
    return found._replace(sep=sep, encoding=encoding, columns=columns_of(found.head, sep, encoding))


def _glue(encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records of a split, and the ends of those that cross its borders."""
        key, inside, held, began, first = None, False, [], False, False
        out: list[tuple] = []

        def close(kind: int) -> None:
            out.append((*key, kind, first, b"\n".join(held).decode(encoding)))

        def end_of_split() -> None:
            if held:
                close(TAIL if began else MIDDLE)

        for batch in batches:
            start = iter(batch.column("inside").to_pylist())
            for now, lines in _segments(batch):
                starts = [next(start) for _ in lines]
                if now != key:
                    end_of_split()
                    key, inside, held, began = now, bool(starts[0]), [], False
                    fresh = now[1] == 0
                for line in lines:
                    if not held:
                        began, first = not inside, fresh and not inside
                        fresh = False
                    held.append(line)
                    inside ^= line.count(b'"') % 2 == 1
                    if not inside:
                        close(RECORD if began else HEAD)
                        held = []
            if len(out) >= 1000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
                out = []
        end_of_split()
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
    return run


_NAMES = ["f", "b", "kind", "first", "text"]
_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())


def records(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """(first, text): the records of files with quoted line breaks; ``first`` marks a file's header."""
    lines = lines_of(spark, files)
    quotes = F.octet_length("v") - F.octet_length(F.replace(F.col("v").cast("string"), F.lit('"'), F.lit("")).cast("binary"))
    per_split = lines.groupBy("f", "b").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut_lineage(per_split.select("f", "b", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")), "csv-splits")
    # one narrow row per split of the files; a broadcast join leaves the lines in their order
    glued = cut_lineage(lines.join(F.broadcast(splits), ["f", "b"]).select("f", "b", "v", "inside").mapInArrow(_glue(encoding), PIECES), "csv-records")
    pieces = glued.filter(F.col("kind") != RECORD).withColumn("seq", F.when(F.col("kind") == TAIL, 1).otherwise(0))
    ordered = Window.partitionBy("f").orderBy("b", "seq")
    crossing = pieces.withColumn("k", F.count_if(F.col("kind") == TAIL).over(ordered)).groupBy("f", "k").agg(
        F.bool_or("first").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "seq", "text"))), lambda x: x["text"]), "\n")
        .alias("text"))
    return glued.filter(F.col("kind") == RECORD).select("first", "text").unionByName(crossing.select("first", "text"))


def read_group(spark: SparkSession, files: list[str], like: Dialect, keep_blanks: bool) -> DataFrame:
    """Files of one dialect and header, all columns as strings."""
    options = {"sep": like.sep, "escape": '"', "quote": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": not keep_blanks,
               "ignoreTrailingWhiteSpace": not keep_blanks}
    if not like.broken:
        return spark.read.options(header=True, inferSchema=False, encoding=like.encoding, **options).csv(files)
    names = [f"c{i}" for i in range(len(like.columns))]
    text = F.when(F.col("first"), None).otherwise(F.nullif(F.col("text"), F.lit("")))  # headers and empty lines are no rows
    schema = ", ".join(f"{n} string" for n in names)
    rows = records(spark, files, like.encoding).select(text.alias("text")).filter("text is not null")
    parsed = rows.select(F.from_csv("text", schema, {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).alias("r"))
    return parsed.select(*[F.col(f"r.{n}") for n in names]).toDF(*numbered(like.columns))


def numbered(names: tuple[str, ...]) -> list[str]:
    """Header names as the CSV reader gives them: a name on several columns gets their numbers, an empty one is ``_c<number>``."""
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_files(spark: SparkSession, found: list[Dialect], keep_blanks: bool = False) -> DataFrame:
    """All files: those of one dialect and header at once, the rest united by column names."""
    def clean(df: DataFrame) -> DataFrame:
        df = df.toDF(*[c.replace("\ufeff", "").strip() for c in df.columns])
        return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])

    def group(d: Dialect) -> tuple:
        return d[1:5]

    order = sorted(found, key=lambda d: (group(d), d.file))
    parts = sorted(([d for d in some] for _, some in groupby(order, group)), key=lambda some: some[0].file)
    frames = [clean(read_group(spark, [d.file for d in some], some[0], keep_blanks)) for some in parts]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
