"""Writes that fail, or are tried again, leave whole tables."""

import threading

import pytest
from pyspark.sql import functions as F

from faultlens.plans import scenarios as SC
from faultlens.session import scratch_scope, unique_dir
from faultlens.sources import sinks


def failing(spark, n=100):
    """Rows of which one raises an error while they are written."""
    return spark.range(n).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))


def folders(path):
    return sorted(p.name for p in path.iterdir())


def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(5), path)
    with pytest.raises(Exception, match="lost"):
        sinks.write_table(failing(spark), path)
    assert sinks.read_table(spark, path).count() == 5 and folders(tmp_path) == ["t"]
    sinks.write_table(spark.range(3).withColumn("more", F.lit(1)), path, partition_by=["more"])
    assert sinks.read_table(spark, path).columns == ["id", "more"] and folders(tmp_path) == ["t"]


def test_a_table_is_overwritten_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(5), path)
    sinks.write_table(sinks.read_table(spark, path).filter("id > 1"), path)
    assert sinks.read_table(spark, path).count() == 3


@pytest.mark.parametrize("stop_at", [1, 2])
def test_an_interrupted_switch_is_mended(spark, tmp_path, monkeypatch, stop_at):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(5), path)
    moves, real = [], sinks._moved

    def crash(spark, a, b):
        moves.append(a)
        if len(moves) == stop_at:
            raise OSError("gone")
        real(spark, a, b)

    monkeypatch.setattr(sinks, "_moved", crash)
    with pytest.raises(OSError):
        sinks.write_table(spark.range(9), path)
    monkeypatch.undo()
    assert sinks.read_table(spark, path).count() == 5
    sinks.write_table(spark.range(2), path)
    assert sinks.read_table(spark, path).count() == 2


def test_reports_that_fail_leave_the_old_ones(spark, tmp_path):
    path = str(tmp_path / "reports")
    for model in ("a", "b"):
        sinks.write_report_tables({"metrics": spark.range(4)}, path, "s", model)
    with pytest.raises(Exception, match="lost"):
        sinks.write_report_tables({"metrics": failing(spark)}, path, "s", "a")
    assert [sinks.read_report(spark, path, "metrics", "s", m).count() for m in ("a", "b")] == [4, 4]
    sinks.write_report_tables({"metrics": spark.range(2)}, path, "s", "a")
    assert [sinks.read_report(spark, path, "metrics", "s", m).count() for m in ("a", "b")] == [2, 4]


def test_a_run_replaces_itself_in_the_history(spark, tmp_path):
    path = str(tmp_path / "history")
    m = spark.createDataFrame([("XGBoost", 0.9)], "model string, auc double")
    SC.append_metrics(spark, m, path, "s1", "007")
    SC.append_metrics(spark, m.withColumn("auc", F.lit(0.8)), path, "s1", "007")
    SC.append_metrics(spark, m, path, "s2", "007")
    hist = SC.append_metrics(spark, m, path, "s1", "008")
    assert sorted((r["run"], r["auc"]) for r in hist.collect()) == [("007", 0.8), ("008", 0.9)]
    with pytest.raises(Exception, match="lost"):
        SC.append_metrics(spark, failing(spark).select(F.lit("x").alias("model"), F.col("id").cast("double").alias("auc")), path, "s1", "009")
    assert SC.append_metrics(spark, m, path, "s1", "010").count() == 3


def test_scopes_of_two_threads_keep_their_tables_apart(spark):
    from faultlens.sources.sinks import materialize
    barrier, left = threading.Barrier(2), {}

    def job(name, first):
        with scratch_scope(spark):
            df = materialize(spark.range(3), f"scope/{name}")
            barrier.wait(60)
            if not first:
                barrier.wait(60)        # the other scope has ended by now
            left[name] = df.count()
        if first:
            barrier.wait(60)

    threads = [threading.Thread(target=job, args=a) for a in (("a", True), ("b", False))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert left == {"a": 3, "b": 3}
    assert unique_dir(spark, "x") != unique_dir(spark, "x")
