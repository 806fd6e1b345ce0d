"""License scan by ordered signature rules (DataFrame operations only).

Words are runs of characters outside ASCII punctuation, blanks and controls, with A-Z lower-cased.

1. Keyword prefilter: one scan keeps, per row, the places whose word is the keyword of some rule,
   with the ``REACH`` words on either side.  Texts are never shuffled, and a text without a keyword
   meets no expression at all.
2. The places are joined to the rules by keyword.  The rules are a fixed list (``license_rules``),
   broadcast as such.  A rule's expressions must match right before and right behind its keyword,
   so the length of a match follows from them and no text is searched.
3. Priority and containment: a detection lying within one of an earlier rule is suppressed.  A match
   has at most 2 * REACH + 1 words, so only detections that start so many words earlier can hold it:
   a window of bounded range, not a join of a row with itself.
   Base phrases are neither suppressed nor do they suppress.

Defined results: a null, empty or wordless text has no words, no detection, empty labels and score 0;
rows with equal or null ids are separate rows; equal detections (one place, one rule) are one; of rules
matching the same words, the first one stays; empty tables give no rows; other columns are
ignored, whatever their names.  A long text is scanned whole; its detections are spread by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.decontam import words_of
from riskframe.llm.license_rules import REACH, Rule, rules
from riskframe.llm.tables import fingerprint, written

#: Words of the longest possible match, less one: how much earlier a containing detection can start.
SPAN = 2 * REACH


FIELDS = "priority, label, keyword, before, after, weight, base"


def _values(signature_rules: list[Rule]) -> str:
    """The rules as rows of an SQL ``VALUES`` list (a placeholder of priority -1 where there is none)."""
    return ",\n  ".join(f"({r.priority}, '{r.label}', '{r.keyword}', '{r.before}', '{r.after}', CAST({r.weight!r} AS DOUBLE), {str(r.base).lower()})"
                        for r in signature_rules or [Rule(-1, "", "", "", "", 0.0, False)])


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def keyword_places(docs: DataFrame, keywords: list[str], id_col: str, text_col: str, reach: int = REACH) -> DataFrame:
    """(row, doc_id, fp, n_words, places): every place of a keyword with the words around it."""
    base = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"), words_of(F.col(text_col)).alias("w"))
    n = F.size("w")

    def joined(start: Column, length: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(F.slice("w", start, length), " "), F.lit(" "))

    def place(i: Column) -> Column:
        had = F.least(i, F.lit(reach))
        return F.struct(i.alias("at"), F.get("w", i).alias("keyword"), joined(i - had + 1, had).alias("pre"),
                        joined(i + 2, F.lit(reach)).alias("post"))

    indices = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # most texts have no keyword: their places are not looked for
    some = F.arrays_overlap("w", F.array(*[F.lit(k) for k in keywords]))
    places = F.transform(F.filter(indices, lambda i: F.get("w", i).isin(keywords)), place)
    none = F.array().cast("array<struct<at:int,keyword:string,pre:string,post:string>>")
    return written(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "fp", n.cast("bigint").alias("n_words"),
                               F.when(some, places).otherwise(none).alias("places")), "license-places")


def detections(places: DataFrame, signature_rules: list[Rule]) -> DataFrame:
    """(row, start, end, priority, label, weight, base, kept): every match of a rule, words ``start`` to ``end`` exclusive."""
    listed = F.broadcast(places.sparkSession.sql(f"SELECT * FROM (VALUES {_values(signature_rules)}) AS rules({FIELDS}) WHERE priority >= 0"))
    tried = (places.select("row", F.explode("places").alias("p")).select("row", "p.*").join(listed, "keyword")
             .withColumn("behind", F.expr("regexp_extract(post, after, 0)")).filter("behind <> ''")
             .withColumn("ahead", F.expr("regexp_extract(pre, before, 0)")).filter("ahead <> ''"))
    start, end = F.col("at") - _spaces(F.col("ahead")) + 1, F.col("at") + _spaces(F.col("behind"))
    found = written(tried.select("row", start.alias("start"), end.alias("end"), "priority", "label", "weight", "base")
                    .distinct(), "license-matches")
    earlier = Window.partitionBy("row").orderBy("start").rangeBetween(-SPAN, 0)
    # base phrases hold nothing back, so they enter the window as empty matches
    held = F.collect_list(F.struct(F.when(F.col("base"), F.lit(-1)).otherwise(F.col("end")).alias("e"), F.col("priority").alias("p"))).over(earlier)
    inside = F.exists("held", lambda x: (x["e"] >= F.col("end")) & (x["p"] < F.col("priority")))
    return found.withColumn("held", held).withColumn("kept", F.col("base") | ~inside).drop("held")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  signature_rules: list[Rule] | None = None) -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    n_detections, n_suppressed, spans, text_fp.

    ``spans`` are the detections that stay (start, end, label, weight) by start; ``score`` is the largest weight among them."""
    listed = rules() if signature_rules is None else signature_rules
    rows = keyword_places(docs, sorted({r.keyword for r in listed}), id_col, text_col)
    found = detections(rows, listed)
    base, kept = F.col("base"), F.col("kept")
    per_row = found.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(kept, F.col("label")))), ",").alias("labels"),
        F.max(F.when(kept, F.col("weight"))).alias("score"), F.count("*").alias("n_detections"),
        F.count_if(~kept).alias("n_suppressed"),
        F.sort_array(F.collect_list(F.when(kept, F.struct("start", "end", "label", "weight")))).alias("spans"))
    zero = F.lit(0).cast("bigint")
    return rows.select("row", "doc_id", "fp", "n_words").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_detections", zero).alias("n_detections"),
        F.coalesce("n_suppressed", zero).alias("n_suppressed"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,weight:double>>")).alias("spans"),
        F.col("fp").alias("text_fp"))


def scan_sql(table: str = "documents", signature_rules: list[Rule] | None = None) -> str:
    """The same scan in DuckDB SQL, from the same rules, without the prefilter's arrays and windows."""
    return rf"""
WITH rules({FIELDS}) AS (VALUES
  {_values(rules() if signature_rules is None else signature_rules)}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}),
p AS (
  SELECT r, i, keyword, ' ' || array_to_string(list_slice(w, greatest(1, i + 1 - {REACH}), i), ' ') || ' ' AS pre,
    ' ' || array_to_string(list_slice(w, i + 2, i + 1 + {REACH}), ' ') || ' ' AS post
  FROM (SELECT r, w, unnest(w) AS keyword, unnest(range(len(w))) AS i FROM d) WHERE keyword IN (SELECT keyword FROM rules)),
t AS (
  SELECT r, i, priority, label, weight, base, regexp_extract(pre, before) AS ahead, regexp_extract(post, after) AS behind
  FROM p JOIN rules USING (keyword)),
f AS (
  SELECT DISTINCT r, i + 1 - (length(ahead) - length(replace(ahead, ' ', ''))) AS s,
    i + length(behind) - length(replace(behind, ' ', '')) AS e, priority, label, weight, base
  FROM t WHERE ahead <> '' AND behind <> ''),
k AS (
  SELECT *, base OR NOT EXISTS (SELECT 1 FROM f AS o WHERE o.r = f.r AND NOT o.base AND o.priority < f.priority
                                AND o.s <= f.s AND o.e >= f.e) AS kept FROM f),
a AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kept) AS labels, max(weight) FILTER (WHERE kept) AS score,
    count(*) AS n_detections, count(*) FILTER (WHERE NOT kept) AS n_suppressed FROM k GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(n_detections, 0) AS n_detections, coalesce(n_suppressed, 0) AS n_suppressed
FROM d LEFT JOIN a USING (r)
"""
