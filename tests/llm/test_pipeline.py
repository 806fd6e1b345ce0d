"""The pipeline's stages on their own inputs, the registered queries against their SQL, and the guard of the entry."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from riskframe.llm import queries
from tests.conftest import ROOT, SMALL
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_minhash_forest import brute as near
from tests.oracle_harness import compare, duck


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        before = docs
        f(spark, docs, SMALL).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        out.append((name, before, docs))
    return out


def test_stages_keep_columns_and_decide_as_brute_force(spark, stages):
    assert [n for n, *_ in stages] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "encoding"]
    for name, before, after in stages[:-1]:
        assert before.columns == after.columns
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        left = sorted(r["doc_id"] for r in after.collect())
        if name == "toxicity":
            assert 0.8 * len(rows) < len(left) <= len(rows)
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(rows):
                first.setdefault(t, i)
            assert left == sorted(first.values())
        elif name == "near_dedup":
            assert left == sorted({c for c, *_ in near(rows).values()})
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert left == sorted(r[0] for r in contaminated(rows, items) if not r[-1])
    _, before, after = stages[-1]
    assert after.count() == before.count() and after.filter("not round_trip").count() == 0


def test_run_gives_the_rows_of_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    want = stages[-1][2]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    r = compare(spark, duck(SMALL), name, queries.QUERIES[name], queries.ORACLES[name], SMALL)
    assert r["status"] in ("exact", "tolerant"), r


def test_every_operator_is_registered():
    names = [k for k in entry.queries() if k.startswith("op") or k == "pipeline"]
    assert sorted({k.split("_")[0] for k in names}) == sorted(["pipeline", *(f"op{n}" for n in range(1, 14))])


def test_entry_works_without_the_folders():
    code = ("import sys, importlib.util as u; real = u.find_spec\n"
            "u.find_spec = lambda n, *a: None if n in ('riskframe.llm', 'corpus_pipeline') else real(n, *a)\n"
            f"sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e\n"
            "assert 'A2' in e.queries() and not any(k.startswith('op') for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
