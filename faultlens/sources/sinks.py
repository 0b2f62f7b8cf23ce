"""Writers for the cohort, the feature table and the report tables.

Targets live below the shared folder (``spark.checkpoint.dir``) unless the
caller names one.  A whole table is written beside its place and moved there when it is
complete: a write that fails half-way leaves the old table as it was.  Between the two moves of a switch a
crash leaves the old table under its spare name, where :func:`recover` (called by every write and by
:func:`read_table`) finds it.  The moves are renames of folders; on a store without these use
``fmt="delta"``, whose log does the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NEW, _OLD = "__new-", "__old-"


def _files(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _moved(spark: SparkSession, a: str, b: str) -> None:
    fs, src = _files(spark, a)
    if not fs.rename(src, _files(spark, b)[1]):
        raise OSError(f"cannot move {a} to {b}")


def recover(spark: SparkSession, path: str) -> None:
    """Put back the table that an interrupted switch of ``path`` moved away, and drop what it left."""
    path = path.rstrip("/")
    fs, p = _files(spark, path)
    parent = p.getParent()
    if not fs.exists(parent):
        return
    left = [f.getPath() for f in fs.listStatus(parent) if f.getPath().getName().startswith(p.getName() + _OLD)]
    for old in left:
        if not fs.exists(p):
            fs.rename(old, p)
        else:
            fs.delete(old, True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by=None) -> str:
    """Put ``df`` at ``path`` in place of what is there; the schema may change between runs."""
    spark = df.sparkSession
    if fmt == "delta":
        w = df.write.mode("overwrite").format(fmt).option("overwriteSchema", "true")
        (w.partitionBy(*partition_by) if partition_by else w).save(path)
        return path
    path = path.rstrip("/")
    recover(spark, path)
    run = uuid.uuid4().hex[:12]
    new, old = f"{path}{_NEW}{run}", f"{path}{_OLD}{run}"
    w = df.write.format(fmt)
    try:
        (w.partitionBy(*partition_by) if partition_by else w).save(new)
    except Exception:
        fs, p = _files(spark, new)
        fs.delete(p, True)
        raise
    fs, p = _files(spark, path)
    there = fs.exists(p)
    if there:
        _moved(spark, path, old)
    _moved(spark, new, path)
    if there:
        fs.delete(_files(spark, old)[1], True)
    return path


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table that :func:`write_table` wrote, also after a switch that was interrupted."""
    if fmt != "delta":
        recover(spark, path)
    return spark.read.format(fmt).load(path)


def write_report_tables(tables: dict[str, DataFrame], path: str, scenario_id: str,
                        model: str) -> dict[str, str]:
    """Store each report table (thresholds, attribution summary, ...) under
    ``path/<name>`` partitioned by scenario and model.

    Only the (scenario, model) partition is replaced (dynamic partition overwrite: files are staged
    and moved when the job commits), so reports of other models and scenarios stay, and a failed
    write leaves the old report.
    """
    out = {}
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        (df.withColumn("scenario_id", F.lit(scenario_id))
           .withColumn("model", F.lit(model))
           .write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic")
           .partitionBy("scenario_id", "model")
           .parquet(target))
        out[name] = target
    return out


def read_report(spark: SparkSession, path: str, name: str, scenario_id: str,
                model: str) -> DataFrame:
    """Read one report table of one model; the filter prunes partitions."""
    return (spark.read.parquet(f"{path.rstrip('/')}/{name}")
            .filter((F.col("scenario_id") == scenario_id) & (F.col("model") == model)))


def materialize(df: DataFrame, name: str, partition_by=None) -> DataFrame:
    """Write ``df`` once below the shared folder and continue from the files.

    Cuts the lineage (a lost executor re-reads files instead of re-running
    the upstream scans and joins), lets later reads prune columns and push
    filters, and replaces repeated evaluation of the same subplan.  With
    ``partition_by``, later filters on those columns read only their folders.
    """
    from faultlens.session import unique_dir
    spark = df.sparkSession
    path = unique_dir(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)
