"""Secret scan with corpus-wide ownership frequency.

One pass over the whole texts finds, per row, the base spans (assignments, access
keys, long hex runs) and further candidate strings: long runs of credential
characters that mix letters and digits.  Candidate values are hashed; the corpus
then counts for each hash the distinct repositories and owners that hold it:

* a hash held by several owners is a widely copied example,
* a hash held by one owner, with enough entropy and no placeholder word, is an
  owner-specific live-looking credential.

Candidates of the second class become additional spans (kind ``owned``); base
spans always stay, with their class counted beside them.

Spans are (start, end) in code points, end exclusive.  Defined results: a null
text is empty and has no spans; an empty table gives no rows; null owners or
repositories count as one unnamed owner or repository; repeated rows are reported
each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import written

KINDS = ["assign", "access", "hex", "owned"]
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same spans as [0-9a-f]+ of 24 or more
#: Further candidates: runs of credential characters of 20 or more.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|xxxx|your|0123456789|123456789", re.I | re.A)
#: A live-looking value has at least this much Shannon entropy per character ...
MIN_ENTROPY = 3.0
#: ... and a value that this many distinct owners hold in so many distinct repositories is a widely copied example,
COPIED_OWNERS, COPIED_REPOS = 3, 2
#: as is one with this many of either.
COPIED_MANY = 5
#: Repositories of a single owner: fewer may be their own key in many places.
COPIED_ALONE = 25

_SPAN = "struct<kind:int,start:int,end:int,hash:binary,live:boolean>"
SCAN_SCHEMA = f"doc_id long, repo string, owner string, base_sha256 string, same binary, found array<{_SPAN}>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base patterns, leftmost non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def live_looking(value: str) -> bool:
    """Letters and digits mixed, no placeholder word, enough entropy."""
    if not (re.search("[A-Za-z]", value) and re.search("[0-9]", value)) or PLACEHOLDER.search(value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= MIN_ENTROPY


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Live-looking runs that overlap no base span."""
    out, i = [], 0
    spans = sorted((s, e) for _, s, e, _ in base)
    for m in CANDIDATE.finditer(text):
        while i < len(spans) and spans[i][1] <= m.start():
            i += 1
        if any(s < m.end() and e > m.start() for s, e in spans[i:i + 4]) or not live_looking(m[0]):
            continue
        out.append((3, m.start(), m.end(), m[0]))
    return out


def span_text(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)


def _hash(value: str) -> bytes:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas, same, found = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            shas.append(hashlib.sha256(span_text(base).encode()).hexdigest())
            every = base + candidates(text, base)
            same.append(_hash(text) if every else None)  # names the text, so that equal ones count once
            found.append([{"kind": k, "start": s, "end": e, "live": live_looking(v),
                           "hash": _hash(v)} for k, s, e, v in every])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("hash", pa.binary()), ("live", pa.bool_())]))
        yield pa.record_batch([batch.column("doc_id"), batch.column("repo"), batch.column("owner"),
                               pa.array(shas, pa.string()), pa.array(same, pa.binary()), pa.array(found, kind)],
                              names=["doc_id", "repo", "owner", "base_sha256", "same", "found"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
                 owner_col: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per document with its counts, span strings and the ownership class of its values.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned (live-looking
    values that are not widely copied), n_copied (widely copied values), n_repos and n_owners
    (the most repositories, and owners, that hold one of its values; 0 without values)."""
    scanned = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                          F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner")) \
        .mapInArrow(_scan, SCAN_SCHEMA)
    rows = written(scanned.withColumn("row", F.monotonically_increasing_id()), "secret-rows")
    one = rows.select("row", "repo", "owner", "same", F.explode("found").alias("f")).select("row", "repo", "owner", "same", "f.*")
    frequency = written(ownership(one, copied_owners), "secret-owners")
    judged = one.join(frequency, "hash").select(
        "row", "kind", "start", "end", "n_repos", "n_owners", "copied", (F.col("live") & ~F.col("copied")).alias("owned"))
    # each row's own spans only: bounded by its text, however often a value is copied elsewhere
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | F.col("owned"), F.struct("start", "kind", "end")))).alias("s"),
        F.count_if("owned").alias("n_owned"), F.count_if("copied").alias("n_copied"),
        F.max("n_repos").alias("n_repos"), F.max("n_owners").alias("n_owners"))
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def count(kind: int):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")

    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")
    return rows.join(per_row, "row", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256",
        F.coalesce(text, F.lit("")).alias("spans"),
        F.coalesce("n_owned", F.lit(0)).cast("bigint").alias("n_owned"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_copied", "n_repos", "n_owners")])


def ownership(values: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """hash, n_repos, n_owners, copied: distinct pairs first, so a value that a third of the rows
    hold is combined on the map side before each exchange.  A text stands for the smallest
    repository that has it, so equal texts are one repository."""
    owners = values.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    repos = (values.groupBy("hash", "same").agg(F.min("repo").alias("repo")).groupBy("hash", "repo").agg(F.count("*").alias("n"))
             .groupBy("hash").agg(F.count("*").alias("n_repos")))
    many = (F.col("n_owners") >= COPIED_MANY) | ((F.col("n_repos") >= COPIED_MANY) & (F.col("n_owners") >= 2)) | \
        (F.col("n_repos") >= COPIED_ALONE)
    return owners.join(repos, "hash").withColumn(
        "copied", ((F.col("n_owners") >= copied_owners) & (F.col("n_repos") >= COPIED_REPOS)) | many)
