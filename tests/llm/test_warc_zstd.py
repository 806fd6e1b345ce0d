import base64
import hashlib
import struct

import duckdb

from riskframe.llm.queries import WARC_SQL
from riskframe.llm.warc_zstd import DICT_FRAME, archive_and_read, read_archives, record_bytes, records_of, target_uri, write_archives

SCHEMA = "page_id long, url string, html string, first string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, least=0):
    data = [(p, u, (h or "").encode()) for p, u, h in rows]
    out = []
    for p, u, b in data:
        same = [q for q, _, c in data if c == b and q is not None]
        first = max(same) if same and len(b) >= least and sum(c == b for _, _, c in data) > 1 else None
        revisit = first is not None and p != first
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response",
                    first if revisit else None, u if u is None else u.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")))
    return sorted(out, key=str)


ROWS = [(1, "http://a/x y%41/a%20b", "<p>hello</p>"), (2, None, "<p>hello</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "h\r\nX: y", "é\r\n\r\nWARC/1.1\r\n"),
        (None, "http://d", "<p>hello</p>"), (None, "http://e", "only null"), (7, "u", "rep"), (7, "u", "rep"), (8, "http://é", "z" * 3_000_000)]


def test_round_trip_against_brute_force(spark):
    got = archive_and_read(spark, pages(spark, ROWS).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_least_payload_hot_copies_and_empty(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "same page " * 50 if i % 3 == 0 else f"<html>{i} {'word ' * (i % 40)}</html>") for i in range(400)] + [(1000, "u", ""), (1001, "u", "")]
    manifest = write_archives(pages(spark, rows), str(tmp_path / "w"), min_payload=1)
    assert sorted(map(tuple, read_archives(manifest, str(tmp_path / "w")).collect()), key=str) == brute(rows, 1)
    empty = archive_and_read(spark, pages(spark, []))
    assert empty.count() == 0


def test_file_is_a_dictionary_frame_and_one_frame_per_record(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><body><p>page {i} about common things</p></body></html>" * 20) for i in range(300)]
    manifest = write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w")).collect()
    assert sum(m["records"] for m in manifest) == 300
    path = tmp_path / "w" / "archives" / manifest[0]["archive"]
    data = path.read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == DICT_FRAME and size > 0 and data.count(b"\x28\xb5\x2f\xfd", 8 + size) >= 300
    plain = sum(len(record_bytes(p, u, h.encode(), None, False)) for p, u, h in rows)
    assert len(data) - 8 - size < plain / 6
    with path.open("rb") as f:
        heads = [h for h, _ in records_of(f)]
    assert len(heads) == 300 and all(h["WARC-Type"] == "response" and h["WARC-Record-ID"].startswith("<urn:page:") for h in heads)


def test_addresses_keep_their_escapes_and_records_have_names_of_their_own():
    assert target_uri("http://h/a%20b") == "http://h/a%20b"
    assert target_uri("http://h/100% x\t%zz%4") == "http://h/100%25%20x%09%25zz%254"
    names = [record_bytes(p, "u", b, f, f is not None).split(b"\r\n")[2] for p, b, f in [
        (1, b"a", None), (1, b"b", None), (1, b"a", 2), (None, b"a", None), (None, b"b", None)]]
    assert len(set(names)) == 5
    named = record_bytes(3, "u", b"a", 1, True)
    assert b"WARC-Refers-To: " + names[0].split(b": ", 1)[1] in named


def test_sql_twin_on_null_ids(spark):
    con = duckdb.connect()
    rows = [(1, "u", "x"), (None, "u", "x"), (2, "u", "x"), (None, "u", "only null"), (None, "u", "only null"), (None, "u", None), (5, "u", "")]
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    got = archive_and_read(spark, pages(spark, rows)).drop("url")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(WARC_SQL).fetchall(), key=str)
