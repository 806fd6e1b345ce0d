"""Chat formatting over a prefix tree of conversations.

Conversations that share initial turns share the nodes of a tree (a node is a turn after a
given history).  The output emits each node once, in depth-first order, with

* ``token_start``: where its tokens lie in its tree's sequence (a token is a code point of
  the formatted turn),
* ``position_start``: the position id of its first token, i.e. the tokens of its history,
* ``attends``: the intervals of the sequence that hold its history (with the node's own
  earlier tokens, what it may attend to).

How the tree is built without a recursive walk or a group in memory:

1. Turns stream through tasks in (conversation, turn) order; a running 128-bit digest over
   the formatted turns names the node of each prefix.
2. A node's *owner* is the smallest conversation that contains it.  Along a conversation
   the owners never decrease, and what one owner owns is a contiguous run, so a path is a
   short list of runs however many turns it has (one more per branch point).
3. Conversations sorted by their lists of owners are in depth-first order; a node lies
   behind its owner's offset.  Offsets are running sums over range partitions.

``members`` says which runs make up a conversation, so every conversation can be read back
from the emitted nodes.

The template is ``### role: text</turn>`` and a newline.  Backslash, ``<`` and ``#`` in a text
(and ``:`` in a role) are escaped by a backslash, so no text can end or start a turn.

Defined results: a null text or role is empty; a null turn sorts first; turns with equal
numbers sort by role and text, repeated rows are turns of their own; the rows with a null
conversation id are one conversation with a null id (the smallest 64-bit number stands for
it); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.tables import written

NULL_ID = -(1 << 63)
LOSS_ROLE = "assistant"
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)

TURNS = ("ck long, idx int, node binary, parent binary, role string, segment string, n_tokens int, "
         "position_start long, loss_start int, loss_end int")
READ = "ck long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str, more: str = "") -> str:
    return re.sub(rf"[\\<#{more}]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its escaped text lies in it."""
    head = HEAD + escape(role, ":") + MIDDLE
    body = escape(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def parse_turn(segment: str) -> tuple[str, str]:
    m = _TURN.fullmatch(segment)
    if m is None:
        raise ValueError(f"not a formatted turn: {segment[:80]!r}")
    return unescape(m[1]), unescape(m[2])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests along each conversation; the state is one conversation's last digest."""
    now, idx, at, parent = None, 0, 0, b""
    for batch in batches:
        out = []
        for ck, role, text in zip(*(batch.column(c).to_pylist() for c in ("ck", "role", "text"))):
            if ck != now:
                now, idx, at, parent = ck, 0, 0, b""
            segment, s, e = format_turn(role, text)
            node = hashlib.blake2b(parent + segment.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            mask = (s, e) if role == LOSS_ROLE else (0, 0)
            out.append((ck, idx, node, parent, role, segment, len(segment), at, *mask))
            idx, at, parent = idx + 1, at + len(segment), node
        if out:
            yield _batch(out, [("ck", pa.int64()), ("idx", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()),
                               ("role", pa.string()), ("segment", pa.string()), ("n_tokens", pa.int32()),
                               ("position_start", pa.int64()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from its formatted turns in order."""
    fields = [("ck", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
              ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    now, n, turns, loss_chars, loss, chars, begun = None, 0, None, 0, None, 0, False
    out: list[tuple] = []
    for batch in batches:
        for ck, segment, s, e in zip(*(batch.column(c).to_pylist() for c in ("ck", "segment", "loss_start", "loss_end"))):
            if not begun or ck != now:
                if begun:
                    out.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                now, n, loss_chars, chars, begun = ck, 0, 0, 0, True
                turns, loss = hashlib.sha256(), hashlib.sha256()
            role, text = parse_turn(segment)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            learned = unescape(segment[s:e])
            loss.update(learned.encode("utf-8", "surrogatepass"))
            n, loss_chars, chars = n + 1, loss_chars + len(learned), chars + len(segment)
        if out:
            yield _batch(out, fields)
            out = []
    if begun:
        yield _batch([(now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)], fields)


def running_offsets(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``offset``: the sum of ``value`` over all rows before it in ``order`` (unique).

    Rows are range-partitioned and written; partition totals (one row each) give the
    partitions' offsets, and each partition sums its own rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), name)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = (ranged.groupBy("_part").agg(F.sum(value).alias("_t"))
            .select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(base), "_part")
            .withColumn("offset", F.col("_base") + F.col("_run")).drop("_part", "_run", "_base"))


def build_forest(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): the emitted turns, each once, and the runs that make up each conversation."""
    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("ck"),
                                F.col("turn"), text("role"), text("text"))
    turns = written(rows.repartition("ck").sortWithinPartitions("ck", "turn", "role", "text")
                    .select("ck", "role", "text").mapInArrow(_chain, TURNS), "chat-turns")
    owners = written(turns.groupBy("node").agg(F.min("ck").alias("owner"), F.count("*").alias("n_conversations")), "chat-owners")
    path = turns.select("ck", "idx", "node", "position_start", "n_tokens").join(owners.select("node", "owner"), "node")
    runs = written(path.groupBy("ck", "owner").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("position_start").alias("from_token"),
        F.max(F.col("position_start") + F.col("n_tokens")).alias("to_token")), "chat-runs")
    keys = runs.groupBy("ck").agg(F.sort_array(F.collect_list("owner")).alias("key"))
    emitted = runs.filter(F.col("owner") == F.col("ck")).select(
        "ck", "from_token", (F.col("to_token") - F.col("from_token")).alias("own")).join(keys, "ck") \
        .withColumn("tree", F.get("key", F.lit(0)))
    placed = written(running_offsets(emitted, "key", "own", "chat-order"), "chat-placed")
    roots = placed.groupBy("tree").agg(F.min("offset").alias("root"))
    placed = written(placed.join(roots, "tree").select("ck", "tree", "from_token", "own",
                                                       (F.col("offset") - F.col("root")).alias("at")), "chat-offsets")
    # history runs of each owner: where the earlier owners' runs lie in the sequence
    history = (runs.filter(F.col("owner") != F.col("ck")).join(placed.select(F.col("ck").alias("owner"), "at"), "owner")
               .groupBy("ck").agg(F.sort_array(F.collect_list(F.struct(
                   F.col("from_token").alias("p"), F.col("at").alias("start"),
                   (F.col("at") + F.col("to_token") - F.col("from_token")).alias("end")))).alias("history")))
    places = placed.join(history, "ck", "left")
    own_at = F.col("at") + F.col("position_start") - F.col("from_token")
    earlier = F.transform(F.coalesce("history", F.array().cast("array<struct<p:bigint,start:bigint,end:bigint>>")),
                          lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    own_run = F.when(own_at > F.col("at"), F.array(F.struct(F.col("at").alias("start"), own_at.alias("end")))) \
        .otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    nodes = (turns.join(owners, "node").filter(F.col("ck") == F.col("owner")).join(places, "ck")
             .select("tree", "owner", "idx", "node", "parent", "role", "segment", "n_tokens", "n_conversations",
                     own_at.alias("token_start"), "position_start", "loss_start", "loss_end",
                     F.concat(earlier, own_run).alias("attends")))
    return written(nodes, "chat-nodes"), runs.select("ck", "owner", "first_idx", "last_idx")


def read_conversations(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Read each conversation back from the emitted nodes: digests of its turns and of its loss mask."""
    steps = members.select("ck", "owner", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    return (steps.join(nodes.select("owner", "idx", "segment", "loss_start", "loss_end"), ["owner", "idx"])
            .repartition("ck").sortWithinPartitions("ck", "idx").select("ck", "segment", "loss_start", "loss_end")
            .mapInArrow(_read_back, READ)
            .select(F.when(F.col("ck") != NULL_ID, F.col("ck")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars",
                    "loss_sha256", "formatted_chars"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    return read_conversations(*build_forest(conversations))
