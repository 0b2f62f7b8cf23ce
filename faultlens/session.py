"""Session construction and the shared folder for materialised tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


# Scratch tables made in the current scope; two jobs of one session in different threads have their own.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("faultlens_scratch", default=None)


def make_session(master: str | None = None, app: str = "faultlens",
                 shuffle_partitions: int | None = None,
                 extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the jobs assume.

    On a cluster, pass ``master=None`` and let the launcher decide; the
    shuffle partition count should then be sized to the data
    (roughly input bytes / 128 MB), AQE coalesces the small ones.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder every executor can reach, below ``spark.checkpoint.dir``.

    The cluster names the shared location; we only choose our own when the
    setting is absent and the master is local (tests).  On a cluster a folder
    of our own would be on one machine only, so that is an error.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="faultlens-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    path = base.rstrip("/") + "/faultlens"
    for p in parts:
        path += "/" + p
    return path


def unique_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh sub-folder of :func:`shared_dir` (one per write)."""
    path = shared_dir(spark, *parts, uuid.uuid4().hex[:12])
    made = _SCRATCH.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables that the block made when it ends, also after an error.

    For jobs that write their results elsewhere: a lazy result of the block
    must not be read after it.
    """
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


# Whether Spark deletes a query's shuffle files when the query ends, not when the driver next collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that the block runs go as that query ends."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        hp = spark._jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)


def ship_package(spark: SparkSession) -> None:
    """Make ``faultlens`` importable in executor Python workers (once per
    session), as ``--py-files`` would; needed by the ``mapInPandas`` stages.
    Set ``faultlens.shipPackage=false`` when the cluster already has it."""
    sc = spark.sparkContext
    if getattr(sc, "_faultlens_shipped", False):
        return
    if spark.conf.get("faultlens.shipPackage", "true").lower() == "false":
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="faultlens-pkg-")
    archive = shutil.make_archive(os.path.join(out, "faultlens"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="faultlens")
    sc.addPyFile(archive)
    sc._faultlens_shipped = True
