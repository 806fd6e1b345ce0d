import hashlib

import pytest

from riskframe.llm.chat_trie import build_forest, escape, format_conversations, format_turn, parse_turn, read_conversations, unescape

SCHEMA = "conv_id long, turn long, role string, text string, ck long, node string, segment string"


def conv(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest(), sum(len(format_turn(r, x)[0]) for _, r, x in turns))
    return out


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "a"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"),
        (2, 2, "user", "b"), (2, 3, "assistant", "\\### Assistant: </turn> ok"), (3, 0, "user", "hi"), (4, 0, "system", "s"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, "user", "hi"), (6, 1, "assistant", "hello"), (6, 2, "user", "a"),
        (7, None, None, None), (7, 1, "ro:le<#", "x"), (7, 1, "assistant", ""), (7, 1, "assistant", ""), (None, 0, "user", "q"),
        (8, 0, "user", "é" * 50_000), (8, 1, "assistant", "</turn>\n### user: no")]


def test_read_back_matches_brute_force(spark):
    got = {r["conv_id"]: tuple(r)[1:] for r in format_conversations(conv(spark, ROWS)).collect()}
    assert got == brute(ROWS)


def test_shared_turns_once_depth_first_with_positions_and_attention(spark):
    nodes, members = build_forest(conv(spark, ROWS))
    rows = nodes.collect()
    distinct = set()
    for c in {r[0] for r in ROWS}:
        path = ()
        for t in sorted(((t, r or "", x or "") for i, t, r, x in ROWS if i == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            path = (*path, t[1:])
            distinct.add(path)
    assert len(rows) == len(distinct)
    by_node = {bytes(r["node"]): r for r in rows}
    for tree in {r["tree"] for r in rows}:
        own = sorted((r for r in rows if r["tree"] == tree), key=lambda r: r["token_start"])
        at = 0
        open_path = []
        for r in own:
            assert r["token_start"] == at == r["token_start"]  # gapless: each token once
            at += r["n_tokens"]
            parent = bytes(r["parent"])
            while open_path and open_path[-1] != parent:  # depth first: the parent is still on the open path
                open_path.pop()
            assert (not parent) or open_path
            open_path.append(bytes(r["node"]))
            history, p = [], parent
            while p:
                history.append(by_node[p])
                p = bytes(by_node[p]["parent"])
            assert r["position_start"] == sum(h["n_tokens"] for h in history)
            seen = {i for a in r["attends"] for i in range(a["start"], a["end"])}
            assert seen == {i for h in history for i in range(h["token_start"], h["token_start"] + h["n_tokens"])}
    assert read_conversations(nodes, members).count() == len({r[0] for r in ROWS})


def test_hot_first_turn_long_conversation_and_empty(spark):
    rows = [(i, 0, "system", "same") for i in range(200)] + [(i, 1, "user", f"q{i % 5}") for i in range(200)]
    rows += [(500, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(600)]
    got = {r["conv_id"]: tuple(r)[1:] for r in format_conversations(conv(spark, rows)).collect()}
    assert got == brute(rows)
    assert build_forest(conv(spark, rows))[0].count() == 1 + 5 + 600
    assert format_conversations(conv(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "###", "<", "a\\<b", "</turn>\n", "\\### Assistant: </turn> ok", "\n\n"])
def test_escape_round_trip(text):
    assert unescape(escape(text)) == text
    assert parse_turn(format_turn("r:o", text)[0]) == ("r:o", text)
