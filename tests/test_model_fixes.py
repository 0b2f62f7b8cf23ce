"""Period AUC, score ranges, telemetry layout, shared folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.operators import growth as G
from faultlens.operators import roc as R
from faultlens.plans import scenarios as SC
from faultlens.session import shared_dir
from faultlens.sources import testmap as T
from fixture_paths import SF0001


def test_period_auc_without_both_classes(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("a", 0, 0.9), ("b", 1, 0.3), (None, 1, 0.3), (None, 0, 0.2)]
    got = {r["period"]: r for r in SC.period_auc(spark.createDataFrame(rows, f"period string, {S.LABEL} int, score double")).collect()}
    assert got["a"]["auc"] == pytest.approx(0.75) and got["b"]["auc"] is None and got["b"]["assets"] == 1
    assert got[None]["auc"] == 1.0


def test_grouped_auc_of_crowded_scores(spark):
    """Scores within a hair of zero spread over ranges drawn from the data; each group's AUC is exact."""
    rng = np.random.default_rng(2)
    rows = [(g, int(y), float(x) * 1e-12) for g in range(3) for y, x in zip(rng.integers(0, 2, 4000), rng.random(4000).round(3))]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    got = {r["g"]: r["auc"] for r in R.grouped_auc(df, "g").collect()}
    for g in range(3):
        y, x = (np.array([r[i] for r in rows if r[0] == g], float) for i in (1, 2))
        assert got[g] == pytest.approx(G.exact_auc(x, y), abs=1e-12)
    ranges = R.with_ranges(df.groupBy("g", "score").agg(F.count("*").alias("n")), 8).groupBy("_b").count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 3 * min(r["count"] for r in ranges)


def test_layout_writes_few_files(spark, tmp_path):
    from faultlens.sources.layout import write_telemetry_layout
    tel = T.telemetry(spark, SF0001).repartition(16)
    path = write_telemetry_layout(tel, str(tmp_path / "layout"))
    folders = spark.read.parquet(path).select("platform", "emission", "occurrence_day").distinct().count()
    files = spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    assert files <= 2 * folders


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(), "x")
