"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.license_scan import scan_sql
from riskframe.llm.spelling_variants import SQL as SPELLING_SQL
from riskframe.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_secret_scan")
def op1(spark, sf):
    from riskframe.llm.secret_scan import scan_secrets
    return scan_secrets(read(spark, sf, "documents"))


@query("op2_hyper_shuffle")
def op2(spark, sf):
    from riskframe.llm.hyper_shuffle import shard_table
    return shard_table(read(spark, sf, "documents"), shards=8)


@query("op5_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op5(spark, sf):
    from riskframe.llm.exact_dedup import exact_groups
    return exact_groups(read(spark, sf, "documents"), keep="largest", each_row=True).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '([\\<#:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\<#])', '\\\1', 'g'))) AS BIGINT)
    AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query("op3_chat_trie", CHAT_SQL)
def op3(spark, sf):
    from riskframe.llm.chat_trie import format_conversations
    table = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], table.schema)
    return format_conversations(table.unionByName(more))


DECONTAM_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item, list_slice(w, s, s + 9) AS win FROM (
    SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
p AS (
  SELECT r, s, l, list_slice(w, s, s + l - 1) AS win FROM (
    SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT len(win) AS l FROM v) WHERE len(w) >= l)),
o AS (SELECT p.r, p.s, p.l, v.item FROM p JOIN v ON p.win = v.win),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS q FROM o) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""


@query("op6_decontamination", DECONTAM_SQL)
def op6(spark, sf):
    from riskframe.llm.decontam import contamination
    return contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark")).drop("text_fp")


@query("op7_language_id")
def op7(spark, sf):
    from riskframe.llm.langid import language_id
    return language_id(read(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score")


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS x FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, octet_length(b) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(x, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31), 1)), 'string_agg', '')
    AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""


@query("op10_warc_zstd", WARC_SQL)
def op10(spark, sf):
    from riskframe.llm.warc_zstd import archive_and_read
    return archive_and_read(spark, read(spark, sf, "pages")).drop("url")


@query("op4_toxicity")
def op4(spark, sf):
    from riskframe.llm.toxicity import toxicity
    return toxicity(read(spark, sf, "documents"), read(spark, sf, "labels")).drop("text_fp")


@query("op9_piece_lattice")
def op9(spark, sf):
    from riskframe.llm.piece_lattice import encode_and_decode
    return encode_and_decode(read(spark, sf, "documents"))


@query("op8_minhash_forest")
def op8(spark, sf):
    from riskframe.llm.minhash_forest import near_duplicates
    return near_duplicates(read(spark, sf, "documents")).select("doc_id", "class_id", "n_links", "rep_id")


@query("op11_license_scan", scan_sql())
def op11(spark, sf):
    from riskframe.llm.license_scan import scan_licenses
    return scan_licenses(read(spark, sf, "documents")).drop("spans", "text_fp")


@query("op12_periodic_runs")
def op12(spark, sf):
    from riskframe.llm.periodic_runs import digest, periodic_runs, with_repeats
    return digest(periodic_runs(with_repeats(read(spark, sf, "documents"))))


@query("op13_spelling_variants", SPELLING_SQL)
def op13(spark, sf):
    from riskframe.llm.spelling_variants import spelling_variants_of_documents
    return spelling_variants_of_documents(read(spark, sf, "documents"))
