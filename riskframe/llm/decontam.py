"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

Words are runs of characters outside ASCII punctuation, blanks and controls, with A-Z
lower-cased.  Each item gives windows of ``WINDOW`` consecutive words (a shorter item is one
window).  A window is a set of positioned shingles of ``SHINGLE`` words (or of all its words,
if it has fewer).

1. One scan of the documents keeps, per row, the positions whose shingle may belong to a
   window.  The test is a byte table (16 slots per shingle, of bounded size) probed four times by the shingle's hash,
   built by an aggregate.  It passes every true shingle, and each kept position carries the few words around it.
   Texts are never shuffled or joined.
2. The kept positions, joined to the windows' shingles, give the exact frequency of each
   shingle over all documents.  A window's shingles are ordered by rarity.  As a contained
   window has all its shingles in the document, the rarest one is a sufficient prefix, and a
   window with a shingle of frequency 0 occurs nowhere.
3. Positions join windows on the prefix shingle alone.  The prefix's offset gives the start;
   starts before the text or ends behind it are discarded (positional and length bounds).
4. The words around the position are compared with the window's words: exact containment.

Covered words are counted by one ordered pass per document over the occurrences.

Defined results: a null or wordless text has no words and is clean; a null or wordless item
has no window; rows with equal or null ids are separate rows; an item id on several rows is
one item; a null item id is named by the empty string; empty tables give no rows or clean
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.tables import fingerprint, sized, without, written

WINDOW = 10
SHINGLE = 5
#: Least and most bytes of the position filter.  A fuller table lets more positions through to
#: the exact join; it never loses one.
LEAST_SLOTS, MOST_SLOTS, PROBES = 1 << 16, 1 << 23, 4
#: Fixed pattern of the characters between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Array of words, A-Z lower-cased and other letters as they are."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)) \
        .otherwise(F.lower(text))
    return F.filter(F.split(low, GAP), lambda w: w != "")


def _shingle_hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _slots(h: Column, size: int) -> list[Column]:
    return [F.pmod(F.shiftrightunsigned(h, 13 * p), F.lit(size)).cast("int") for p in range(PROBES)]


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words, len) and which items have them (wid, item)."""
    each = (items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                         words_of(F.col(text_col)).alias("w"))
            .filter(F.size("w") > 0)
            .select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))).alias("s"))
            .select("item", F.slice("w", F.col("s"), F.lit(window)).alias("words")).distinct())
    each = written(each, "windows-of-items")
    windows = written(each.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words",
                                                             F.size("words").alias("len")), "windows")
    return windows, written(each.join(windows, "words").select("wid", "item"), "window-items")


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(wid, len, k, off, h): every positioned shingle of each window."""
    by_size = [windows.filter(F.col("len") == k if k < shingle else F.col("len") >= shingle)
               .select("wid", "len", "words", F.lit(k).alias("k"),
                       F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
               .select("wid", "len", "k", "off", _shingle_hash(F.col("words"), F.col("off"), k).alias("h"))
               for k in range(1, shingle + 1)]
    out = by_size[0]
    for df in by_size[1:]:
        out = out.unionAll(df)
    return out


def position_filter(shingles: DataFrame) -> bytes:
    """One byte per slot, '1' where a window's shingle falls; put together by Spark, the driver gets one row."""
    hashes = shingles.select("h").distinct()
    size = min(max(LEAST_SLOTS, 1 << (16 * hashes.count()).bit_length()), MOST_SLOTS)
    slots = hashes.select(F.explode(F.array(*_slots(F.col("h"), size))).alias("s"))
    # 32 slots at a time, as the digits of a number, the first slot last
    part = slots.groupBy(F.shiftright("s", 5).cast("bigint").alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("s").bitwiseAND(31))).alias("bits"))
    digits = F.reverse(F.lpad(F.bin(F.coalesce("bits", F.lit(0).cast("bigint"))), 32, "0"))
    every = shingles.sparkSession.range(size // 32).join(part, "id", "left").select(F.struct("id", digits.alias("d")).alias("x"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["d"]), "")  # MOST_SLOTS / 32 rows at most
    return bytes(every.agg(text.cast("binary").alias("t")).first()["t"])


def kept_positions(docs: DataFrame, table: bytes, sizes: list[int], id_col: str, text_col: str,
                   window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, fp, n_words, hits): the positions that pass the filter, with their surroundings."""
    base = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"),
                       words_of(F.col(text_col)).alias("w"))
    n, bits, one = F.size("w"), F.lit(table), F.lit(b"1")

    def found(k: int) -> Column:
        def passes(i: Column) -> Column:
            # the first slot fails for nearly all positions, so the others are seldom looked up
            first, *more = [F.substring(bits, s + 1, F.lit(1)) == one for s in _slots(_shingle_hash(F.col("w"), i, k), len(table))]
            for test in more:
                first = first & test
            return first

        reach = window - shingle if k == shingle else 0  # an occurrence starts at most so far before its prefix

        def hit(i: Column) -> Column:
            first = F.greatest(i - reach, F.lit(0))
            return F.struct(F.lit(k).alias("k"), i.alias("at"), first.alias("first"),
                            _shingle_hash(F.col("w"), i, k).alias("h"),
                            F.slice(F.col("w"), first + 1, i - first + k + reach).alias("around"))

        starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, passes), hit)

    hits = F.concat(*[found(k) for k in sizes]) if sizes else \
        F.array().cast("array<struct<k:int,at:int,first:int,h:bigint,around:array<string>>>")
    return written(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "fp", n.alias("n_words"),
                               hits.alias("hits")), "decontam-positions")


def occurrences(rows: DataFrame, windows: DataFrame, shingles: DataFrame) -> DataFrame:
    """(row, start, len, wid): exact occurrences of windows in rows."""
    at = rows.select("row", "n_words", F.explode("hits").alias("x")).select("row", "n_words", "x.*")
    known = sized(shingles.select("k", "h").distinct(), "decontam-shingles")
    frequency = at.join(known, ["k", "h"]).groupBy("k", "h").agg(F.count("*").alias("freq"))
    ranked = shingles.join(frequency, ["k", "h"], "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "h", "off", "k")).alias("p"))
    prefix = sized(ranked.filter("p.freq > 0").join(windows, "wid")
                   .select("wid", "len", "words", "p.h", "p.off", "p.k"), "decontam-prefixes", 200_000)
    start = F.col("at") - F.col("off")
    return (at.join(prefix, ["k", "h"])
            .filter((start >= 0) & (start + F.col("len") <= F.col("n_words")))
            .filter(F.slice("around", start - F.col("first") + 1, F.col("len")) == F.col("words"))
            .select("row", start.alias("start"), "len", "wid"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_fp."""
    windows, of_items = item_windows(items)
    shingles = written(window_shingles(windows), "window-shingles")
    sizes = sorted(r["k"] for r in shingles.select("k").distinct().collect())  # at most SHINGLE numbers
    rows = kept_positions(docs, position_filter(shingles), sizes, id_col, text_col)
    found = written(occurrences(rows, windows, shingles), "decontam-occurrences")
    ordered = Window.partitionBy("row").orderBy("start", F.desc("len"))
    end = F.col("start") + F.col("len")
    covered = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    hit = (found.select("row", F.greatest(end - F.greatest("start", F.coalesce(covered, F.lit(0))), F.lit(0)).alias("new"))
           .groupBy("row").agg(F.sum("new").alias("n_hit")))
    named = (found.select("row", "wid").distinct().join(of_items, "wid").select("row", "item").distinct()
             .groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("names")))
    return (rows.select("row", "doc_id", "fp", "n_words").join(hit.join(named, "row"), "row", "left")
            .select("doc_id", F.col("n_words").cast("bigint").alias("n_words"),
                    F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                    F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated"), F.col("fp").alias("text_fp")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a window of an item, all columns kept."""
    bad = contamination(docs, items).filter("contaminated")
    return without(docs, bad.select(F.col("doc_id").alias("_id"), F.col("text_fp").alias("_fp")), "decontam-dropped")
