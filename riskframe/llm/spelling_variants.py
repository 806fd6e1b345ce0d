"""Grouping of spelling variants: words one edit apart, each pointing to its most frequent near word.

1. Counts: runs of letters of whole texts, counted with map-side aggregation, so a word that is a third of all
   text is one row per task.  The vocabulary is written in order of frequency (ties: code points), and a
   word's number follows that order: the best of some words is the least of their numbers.
2. Reduced alphabet: letters are hashed to ``symbols`` symbols.  If two words are one edit apart, their
   reduced words are equal or one edit apart, so the full one-edit neighbourhood of a reduced word
   (deletions, replacements, insertions and itself) meets the reduced word of every near word.
   It is made as 64-bit hashes, from prefix sums of a polynomial, so a word of length n costs n * symbols numbers,
   never n strings of length n.
3. The neighbourhoods are joined to the reduced vocabulary by hash, and the original words of
   every meeting pair are compared exactly (Levenshtein distance 1 over code points).  Collisions of
   letters or hashes cost a comparison and never make a result; no pair is left out.
   More symbols mean larger neighbourhoods and fewer such comparisons; ``symbols_for`` chooses by the counted
   vocabulary, and the result is the same with any number of them.
4. A word's form is the near word of least number if it is frequent enough; roots follow by pointer doubling, as
   each step at least multiplies the count.

Defined results: null and empty texts have no words; rows with equal or null ids count as separate rows;
empty tables give no rows; other columns are ignored, whatever their names.  Texts and words of any length
are handled whole.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import BROADCAST_ROWS, written
from riskframe.llm.textnp import give_back, mix

SHORTEST, RAREST, RATIO = 5, 3, 2
#: Letters of a word; only A-Z are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
#: The reduced vocabulary is broadcast only below so many rows (``BROADCAST_ROWS``) and bytes of words.
BROADCAST_BYTES = 1 << 25
#: Hashes made at a time in a task, and words whose neighbourhoods a task makes.
MADE, WORDS_OF_TASK = 1 << 19, 20_000

_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


def runs_of_letters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of letters, A-Z lower-cased."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))
    return (docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(low, f"[^{LETTERS}]+")).alias("run")).filter("run <> ''"))


def misspelt(doc_id: Column, run: Column) -> Column:
    """The word that op13 reads: where 97 divides a hash of id and run, one letter is missing.  A null id changes nothing."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(r, word, n): the words of ``word`` that are long and frequent enough, numbered from the most frequent on."""
    counted = words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= rarest)
    counted = written(counted, "spelling-counts")
    return written(counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("r"), "word", "n"), "spelling-words")


def symbols_for(words: int) -> int:
    """The least number of symbols, from 4, at which reduced words of 7 letters are eight times as many as ``words``."""
    return next(k for k in range(4, 64) if k ** 7 >= 8 * words)


def _reduced(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all letters, from 1; ends of words)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return mix(points * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(symbols) + np.uint64(1), np.cumsum([len(w) for w in words])


def whole_words(letters: np.ndarray) -> np.ndarray:
    """Hashes of reduced words of one length (rows of ``letters``)."""
    power = np.cumprod(np.r_[np.uint64(1), np.full(letters.shape[1] - 1, _BASE, np.uint64)], dtype=np.uint64)
    return mix((letters * power).sum(axis=1, dtype=np.uint64))


def neighbourhoods(letters: np.ndarray, symbols: int) -> np.ndarray:
    """Hashes of the one-edit neighbourhoods of reduced words of one length, the words themselves included."""
    k, n = letters.shape
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)], dtype=np.uint64)
    head = np.zeros((k, n + 1), np.uint64)
    np.cumsum(letters * power[:n], axis=1, dtype=np.uint64, out=head[:, 1:])
    whole = head[:, -1:]
    any_symbol = np.arange(1, symbols + 1, dtype=np.uint64)
    without = head[:, :-1] + (whole - head[:, 1:]) * np.uint64(_BACK)
    changed = whole[:, :, None] + (any_symbol - letters[:, :, None]) * power[:n, None]
    longer = (head + (whole - head) * np.uint64(_BASE))[:, :, None] + any_symbol * power[:, None]
    return mix(np.concatenate([without, changed.reshape(k, -1), longer.reshape(k, -1)], axis=1))


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, their letters as rows) of equal lengths, so many at a time that about MADE hashes result."""
    flat, ends = _reduced(words, symbols)
    lengths = np.diff(np.r_[0, ends])
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        step = max(1, MADE // int((2 * n + 1) * symbols + n))
        for a in range(0, len(which), step):
            some = which[a:a + step]
            yield some, flat[(ends[some] - n)[:, None] + np.arange(n)]


def _hash(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            out = np.zeros(len(words), np.uint64)
            for some, letters in _by_length(words, symbols):
                out[some] = whole_words(letters)
            yield pa.record_batch([pa.array(out.view(np.int64)), batch.column("r"), batch.column("word")], names=["h", "near", "near_word"])
    return run


def _spread(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for some, letters in _by_length(words, symbols):
                made = np.sort(neighbourhoods(letters, symbols), axis=1)
                new = np.c_[np.ones(len(some), bool), made[:, 1:] != made[:, :-1]]
                ends = np.r_[0, np.cumsum(new.sum(axis=1))].astype(np.int32)
                rows = batch.take(pa.array(some))
                yield pa.record_batch([rows.column("r"), rows.column("word"), pa.ListArray.from_arrays(pa.array(ends), pa.array(made[new].view(np.int64)))],
                                      names=["r", "word", "hashes"])
        give_back()
    return run


def near_pairs(words: DataFrame, symbols: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(r, near): all pairs of numbers of words exactly one edit apart, in both directions, each once."""
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("b")).first()
    symbols = symbols or symbols_for(size["n"])
    table = words.select("r", "word")
    reduced = written(table.mapInArrow(_hash(symbols), "h long, near long, near_word string"), "spelling-reduced")
    if size["n"] <= broadcast_rows and size["b"] <= BROADCAST_BYTES:
        reduced = F.broadcast(reduced)
    # the vocabulary is small and its neighbourhoods are not, so the words are dealt to tasks by their number
    spread = table.repartition(max(words.sparkSession.sparkContext.defaultParallelism, size["n"] // WORDS_OF_TASK), "r")
    around = spread.mapInArrow(_spread(symbols), "r long, word string, hashes array<long>").select("r", "word", F.explode("hashes").alias("h"))
    return around.join(reduced, "h").filter(F.levenshtein("word", "near_word", 1) == 1).select("r", "near")


def roots(forms: DataFrame) -> DataFrame:
    """(r, root) from (r, form): each form's form and so on, to the last; all steps go to smaller numbers."""
    up = written(forms.select("r", F.coalesce("form", "r").alias("root")), "spelling-up")
    while True:
        above = up.select(F.col("r").alias("root"), F.col("root").alias("next"))
        new = written(up.join(above, "root").select("r", F.col("root").alias("old"), F.col("next").alias("root")), "spelling-up")
        up = new.select("r", "root")
        if new.filter("root < old").isEmpty():
            return up


def spelling_variants(words: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, ratio: int = RATIO,
                      symbols: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per word of the vocabulary of ``words`` (a row per occurrence): word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest count (ties: first in code points) if that is ``ratio`` times the
    word's own or more; ``root`` is where forms lead."""
    known = vocabulary(words, shortest, rarest)
    best = near_pairs(known, symbols, broadcast_rows).groupBy("r").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    best = written(best, "spelling-near")
    target = known.select(F.col("r").alias("near"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = written(known.join(best, "r", "left").join(target, "near", "left").select(
        "r", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        *[F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("near", "form", "form_n")]), "spelling-linked")
    root = roots(linked.select("r", F.col("near").alias("form")))
    last = known.select(F.col("r").alias("root"), F.col("word").alias("last"))
    return linked.join(root.join(last, "root").select("r", "last"), "r").select(
        "word", "form", F.col("last").alias("root"), "n", "n_near", "form_n")


def spelling_variants_of_documents(docs: DataFrame) -> DataFrame:
    return spelling_variants(runs_of_letters(docs).select(misspelt(F.col("doc_id"), F.col("run")).alias("word")))


#: The same result in DuckDB SQL: near words by equal strings after deletions, roots by recursion.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, run, count(*) AS k, CAST(doc_id AS VARCHAR) || ':' || run AS said
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(octet_length(encode(said))),
           lambda i: CAST('0x' || substr(hex(encode(said)), 2 * i + 1, 2) AS BIGINT)),
           lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS h FROM runs, bits),
v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
shorter AS (SELECT DISTINCT d.word AS a, v.word AS b FROM d JOIN v ON d.less = v.word),
near AS (
  SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
  UNION ALL SELECT DISTINCT x.word, y.word FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.word <> y.word),
best AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM near JOIN v ON v.word = near.b GROUP BY a),
f AS (
  SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form,
    CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN up ON up.word = f.word JOIN f AS g ON g.word = up.at WHERE g.form IS NULL
"""
