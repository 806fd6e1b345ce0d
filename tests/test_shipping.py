"""The package reaches Python workers that cannot see the repository."""

import os
import subprocess
import sys

from tests.conftest import ROOT, SMALL

CODE = f"""
import os, sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,1,1500]").config("spark.executor.memory", "900m")
         .config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
         .config("spark.checkpoint.dir", os.environ["SHARED"]).config("spark.sql.shuffle.partitions", "2").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as e
print("ROWS", e.queries()["S3"](spark, {SMALL!r}).count())
spark.stop()
"""


def test_worker_side_code_runs_outside_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    # executors of a local cluster write their logs to a folder "work" in Spark's home: a home of links keeps it here
    import pyspark
    home = tmp_path / "home"
    home.mkdir()
    for name in os.listdir(os.path.dirname(pyspark.__file__)):
        if name != "work":
            (home / name).symlink_to(os.path.join(os.path.dirname(pyspark.__file__), name))
    (home / "work").mkdir()
    (tmp_path / "shared").mkdir()
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=240, env=env | {
        "SHARED": f"file://{tmp_path}/shared", "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13",
        "PYSPARK_PYTHON": sys.executable, "TMPDIR": str(tmp_path)})
    assert "ROWS 1531" in out.stdout, (out.stdout[-500:], out.stderr[-1500:])


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest
    from riskframe.session import checkpoint_root

    class Conf:
        def get(self, *_):
            return None

    class None_:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: None_()})()})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(type("Session", (), {"sparkContext": Context(), "conf": Conf()})())
