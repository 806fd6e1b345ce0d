import re

import duckdb
import pytest

from riskframe.llm.license_rules import REACH, Rule, rules
from riskframe.llm.license_scan import scan_licenses, scan_sql
from tests.llm.test_decontam import LOW, W

COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections", "n_suppressed")


def brute(docs, listed):
    """Every rule at every word of every text, then every pair of detections."""
    out = []
    for d, t in docs:
        w, found = W.findall((t or "").translate(LOW)), set()
        for i, word in enumerate(w):
            pre, post = " " + " ".join(w[max(0, i - REACH):i]) + " ", " " + " ".join(w[i + 1:i + 1 + REACH]) + " "
            for r in listed:
                if r.keyword == word:
                    a, b = re.search(r.before, pre), re.search(r.after, post)
                    if a and b:
                        found.add((i + 1 - a[0].count(" "), i + b[0].count(" "), r))
        kept = [(s, e, r) for s, e, r in found if r.base or not any(
            not o.base and o.priority < r.priority and x <= s and y >= e for x, y, o in found)]
        base = [(s, r.label) for s, _, r in found if r.base]
        out.append((d, len(w), len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None),
                    ",".join(sorted({lab for _, lab in base})), ",".join(sorted({r.label for _, _, r in kept})),
                    max((r.weight for _, _, r in kept), default=0.0), len(found), len(found) - len(kept)))
    return sorted(out, key=str)


GRANT = "Licensed under the Apache License, Version 2.0 (the License)"
DOCS = [(1, GRANT), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0. All rights reserved."),
        (4, "Released under the MIT License.\n" * 40), (5, None), (6, ""), (7, "?! ..."), (8, "gnu lesser general public license"),
        (9, "general public license"), (10, "cc by cc by cc by"), (11, "all rights  reserved, ALL-RIGHTS-RESERVED!"), (12, "all rights"),
        (13, "the apache tribe of mit in public; a gpled thing, copyrighted"), (14, "é" * 50 + " gpl " + "ß " * 30 + "gplv3"),
        (15, "SPDX-License-Identifier: Apache-2.0"), (16, "spdx license identifier cc by nc sa 4 0"), (17, "lead " * 20000 + "cc-by"),
        (18, "Dual licensed under the MIT license and the BSD 3-Clause License"), (19, "KK cc İ by"), (1, GRANT), (None, GRANT),
        (20, "provided as is, without warranty of any kind, express or implied"), (21, "x" * 100000 + " mit license " + "y" * 100000),
        (22, "licence gnu affero general public licence version 3 or at your option any later version of it")]


def as_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_rules_are_many_valid_and_within_reach():
    listed = rules()
    assert len(listed) > 200 and len({(r.keyword, r.before, r.after) for r in listed}) == len(listed)
    for r in listed:
        re.compile(r.before), re.compile(r.after)
        assert r.before.count(" ") <= REACH + 8 and 0 < r.weight <= 1
    assert [r.label for r in listed if r.base] == ["cc-by", "gpl", "reserved"]


def test_against_brute_force(spark, docs_of):
    assert as_rows(scan_licenses(docs_of(DOCS))) == brute(DOCS, rules())


def test_other_rules_ties_and_containment(spark, docs_of):
    mine = [Rule(0, "long", "b", " (?:a )$", "^(?: c) ", 0.5, False), Rule(1, "tie", "b", " (?:a )$", "^(?: c) ", 0.9, False),
            Rule(2, "short", "b", " (?:)$", "^(?:) ", 1.0, False), Rule(3, "wide", "b", " (?:z a )$", "^(?: c) ", 0.4, False),
            Rule(4, "base", "c", " (?:b )$", "^(?:) ", 0.2, True)]
    docs = [(1, "a b c"), (2, "b"), (3, "z a b c b"), (4, "a b c " * 500)]
    got = as_rows(scan_licenses(docs_of(docs), signature_rules=mine))
    assert got == brute(docs, mine)
    assert [r[6] for r in got] == ["base,long", "short", "base,long,short,wide", "base,long"]


def test_hot_line_and_empty_tables(spark, docs_of):
    docs = [(i, "a b " * (i % 7) + (DOCS[i % 4][1] if i % 3 else GRANT)) for i in range(300)]
    assert as_rows(scan_licenses(docs_of(docs))) == brute(docs, rules())
    assert scan_licenses(docs_of([])).count() == 0
    assert scan_licenses(docs_of([(1, "cc by")]), signature_rules=[]).collect()[0]["n_detections"] == 0


def test_sql_twin(docs_of):
    con = duckdb.connect()
    frame = docs_of(DOCS, extra=False).select("doc_id", "text").toPandas()
    con.register("frame", frame)
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM frame")
    rows = con.sql(scan_sql()).fetchall()
    assert sorted(rows, key=str) == brute(DOCS, rules())


def test_no_python_in_the_plan(spark, docs_of):
    plan = scan_licenses(docs_of(DOCS))._jdf.queryExecution().toString()
    assert not re.search(r"MapInArrow|MapInPandas|PythonUDF|ArrowEval|BatchEval|CartesianProduct", plan)


@pytest.mark.parametrize("text,label", [("released under MIT", "mit"), ("GNU LGPL v2.1", "lgpl"), ("CC0 1.0", "cc0"),
                                         ("for internal use only", "proprietary"), ("Eclipse Public License - v 2.0", "epl-2.0")])
def test_single_labels(docs_of, text, label):
    assert label in scan_licenses(docs_of([(1, text)])).collect()[0]["labels"].split(",")
