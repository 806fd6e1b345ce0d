"""Session helpers.

Library code never changes session settings it does not own.  The only
setting filled in here is the checkpoint folder, and only when the cluster
has not named one (local tests).
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "riskframe") -> SparkSession:
    """Session for tests and the local bench (``local[cores]``, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


_SCRATCH: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written intermediate tables.

    Uses ``spark.checkpoint.dir`` (or the context's checkpoint dir) as named
    by the cluster.  Only when neither is set and the master is local (a test
    session) a fresh folder is created, registered, and removed at exit; on a
    cluster a machine-local folder would not be seen by other executors, so
    the missing setting is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = sc._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="riskframe-ckpt-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique table path below the shared checkpoint folder.

    Whoever writes intermediate tables also runs Python tasks, so the package is shipped here."""
    ship_package(spark)
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def scratch_tables() -> list[str]:
    """The scratch paths handed out in this process and not dropped since."""
    return list(_SCRATCH)


def drop_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete scratch tables (all of this process by default) once no result reads them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in list(_SCRATCH) if paths is None else paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _SCRATCH:
            _SCRATCH.remove(p)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Workers find the package neither on a cluster where it is not installed nor in a local
    session that was started outside the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="riskframe-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "riskframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("riskframe", os.path.relpath(full, top)))
    sc.addPyFile(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def cut_lineage(df, name: str = "stage"):
    """Cut the lineage by writing a Parquet table into the shared checkpoint folder.

    Used between the passes of multi-pass operators: later passes read the
    written columnar files instead of recomputing the whole plan, and a lost
    executor does not force a recomputation from the sources.  (A reliable
    RDD checkpoint would re-run the plan row-wise through the RDD path; a
    table write is one ordinary, codegen'd job.)
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
