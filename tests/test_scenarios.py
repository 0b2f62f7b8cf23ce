"""Many scenarios in one pass equal one run per scenario; cause ranking;
backward validation; metrics history."""

import datetime as dt

from pyspark.sql import functions as F

from faultlens.operators import models as M
from faultlens.plans import jobs as J
from faultlens.plans import scenarios as SC
from faultlens.session import unique_dir
from faultlens.sources import testmap as T

from fixture_paths import SF001


def test_multi_scenario_equals_single_runs(spark):
    cl, dp, tel = T.claims(spark, SF001), T.dispositions(spark, SF001), T.telemetry(spark, SF001)
    multi = SC.multi_scenario_feature_table(cl, dp, tel, T.scenarios(spark), T.FEATURES)
    multi = multi.cache()
    singles = [T.scenario(targets=(t,), scenario_id=f"target={t}") for t in T.CANDIDATES]
    singles.append(T.scenario(with_groups=True, scenario_id="grouped"))
    for sc in singles:
        one = J.feature_table_from_sources(cl, dp, tel, sc)
        got = multi.filter(F.col("scenario_id") == sc.scenario_id).drop("scenario_id")
        assert got.count() == one.count()
        assert got.exceptAll(one).isEmpty() and one.exceptAll(got).isEmpty(), sc.scenario_id
    multi.unpersist()


def test_rank_root_causes(spark):
    scores = spark.createDataFrame(
        [("e1", "A", 0.2), ("e1", "B", 0.7), ("e1", "C", 0.7), ("e2", "A", 0.1)],
        "ESN string, component string, score double")
    got = [(r.ESN, r.component, r["rank"]) for r in
           SC.rank_root_causes(scores).orderBy("ESN", "rank").collect()]
    assert got == [("e1", "B", 1), ("e1", "C", 2), ("e1", "A", 3), ("e2", "A", 1)]
    hist = SC.claim_history_scores(T.claims(spark, SF001))
    sums = hist.groupBy("ESN").agg(F.sum("score").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).isEmpty()


def test_backward_validation_and_history(spark):
    table = T.model_matrix_source(spark, SF001, with_date=True)
    cols = ["l_discount_max", "l_discount_min", "l_discount_std", "l_tax_avg"]
    out = SC.backward_validation(spark, table, cols, "Failure_date", "2001-01-01",
                                 M.ModelSpec(M.FOREST, 4, 5)).collect()
    assert out and all(r.period >= dt.date(2001, 1, 1) for r in out)
    assert sum(r.assets for r in out) == table.filter("Failure_date >= DATE'2001-01-01'").count()
    assert 0.8 < out[0].overall_auc <= 1.0
    path = unique_dir(spark, "history-test")
    m = spark.createDataFrame([("XGBoost", 10, 0.9)], "model string, trees int, auc double")
    SC.append_metrics(spark, m, path, "s1")
    hist = SC.append_metrics(spark, m, path, "s1")
    assert hist.count() == 2


def test_component_scores_rank_every_asset(spark):
    import __spark_entry__ as E
    ranked = E._rank_by_models(spark, SF001)
    per = ranked.groupBy("ESN").agg(F.count("*").alias("n"), F.max("rank").alias("m"),
                                    F.countDistinct("component").alias("c")).collect()
    assert per and all(r.n == r.m == r.c == len(T.CANDIDATES) for r in per)
    assert ranked.filter((F.col("score") < 0) | (F.col("score") > 1)).isEmpty()


def test_models_of_all_scenarios_take_the_jobs_of_one(spark):
    """Joint growth: no more Spark jobs for eight scenarios than for two, and each model is its own scenario's."""
    from test_models import jobs_of
    base = T.model_matrix_source(spark, SF001)
    cols = ["l_discount_max", "l_tax_max"]
    rows = base.filter("ESN % 8 = 0").select("ESN", "label", *cols)

    def scores(n):
        multi = None
        for i in range(n):
            one = rows.withColumn("scenario_id", F.lit(f"s{i}")).withColumn("label", (F.col("label") + i) % 2)
            multi = one if multi is None else multi.unionByName(one)
        comps = {f"s{i}": f"c{i}" for i in range(n)} | {"none": "never"}
        got, unknown = SC.component_scores(spark, multi, cols, comps, M.ModelSpec(M.FOREST, 3, 4))
        return {(r["ESN"], r["component"]): r["score"] for r in got.collect()}, unknown

    (few, jobs_few), (many, jobs_many) = jobs_of(spark, lambda: scores(2)), jobs_of(spark, lambda: scores(8))
    assert jobs_many <= jobs_few + 3
    assert len(few[0]) == 2 * rows.count() and len(many[0]) == 8 * rows.count() and many[1] == ["none"]
    for (asset, comp), s in many[0].items():      # labels are turned in every second scenario
        assert abs(s - (many[0][asset, "c0"] if int(comp[1:]) % 2 == 0 else 1 - many[0][asset, "c0"])) < 1e-9


def test_multi_scenario_all_grouped_uses_union_prefilter(spark):
    cl, dp, tel = T.claims(spark, SF001), T.dispositions(spark, SF001), T.telemetry(spark, SF001)
    scs = [T.scenario(platforms=("P0",), emissions=("E0",), scenario_id="a"),
           T.scenario(platforms=("P2", "P1"), emissions=("E1",), scenario_id="b")]
    multi = SC.multi_scenario_feature_table(cl, dp, tel, SC.scenario_table(spark, scs), T.FEATURES)
    plan = multi._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" in plan                   # union of groups pre-filters the scan
    for sc in scs:
        one = J.feature_table_from_sources(cl, dp, tel, sc)
        got = multi.filter(F.col("scenario_id") == sc.scenario_id).drop("scenario_id")
        assert got.exceptAll(one).isEmpty() and one.exceptAll(got).isEmpty(), sc.scenario_id


def test_telemetry_is_aggregated_before_scenarios_join(spark):
    """Many scenarios on the same claims leave the scan and the window aggregate as they are."""
    cl, dp, tel = T.claims(spark, SF001), T.dispositions(spark, SF001), T.telemetry(spark, SF001)
    scs = [T.scenario(targets=(T.CANDIDATES[i % 5],), scenario_id=f"s{i}") for i in range(200)]
    table = SC.scenario_table(spark, scs)
    claims = SC.multi_scenario_claims(cl, dp, table)
    one = SC.multi_scenario_claims(cl, dp, SC.scenario_table(spark, scs[:1]))
    keys = SC.window_parts(claims, tel, table, T.FEATURES).drop("_codes")
    assert keys.count() == SC.window_parts(one, tel, table, T.FEATURES).count()
    got = SC.multi_scenario_feature_table(cl, dp, tel, table, T.FEATURES)
    per = got.groupBy("scenario_id").count().select("count").distinct().collect()
    assert len(per) == 1 and got.count() == 200 * per[0]["count"]


def test_parts_of_several_groups_merge_and_codes_with_brackets(spark):
    """An asset with two groups in its window: the merged deviation is that of all its rows."""
    tel = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 2), "P0_E0_M", "[a]", None, 1.0), (1, dt.datetime(2024, 1, 3), "P1_E1_M", "[b]", "", 5.0),
         (1, dt.datetime(2024, 1, 4), "P1_E1_M", "x[c]]", "[a", 9.5), (1, dt.datetime(2024, 1, 5), None, None, "b]", 2.0)],
        "ESN long, Occurrence_time timestamp, engine_model_group string, Faultlist string, Faultlist2 string, v double")
    cl = spark.createDataFrame([(7, 1, "A", dt.date(2024, 1, 6))],
                               "Claim_number long, ESN long, ABO_FAILURE_PART string, Failure_date date")
    dp = spark.createDataFrame([(7, "N")], "Claim_number long, TNF_Flag string")
    mk = lambda i, codes, p=(), e=(): T.scenario(candidates=("A", "B"), targets=("A",), fault_codes=codes,
                                                 features=("v",), platforms=p, emissions=e, scenario_id=i)
    scs = [mk("all", ("a",)), mk("odd", ("c]",)), mk("none", ("a]",)), mk("one", ("b",), ("P1",), ("E1",))]
    got = {r["scenario_id"]: r for r in SC.multi_scenario_feature_table(
        cl, dp, tel, SC.scenario_table(spark, scs), ["v"]).collect()}
    import statistics as st
    assert set(got) == {"all", "odd", "one"}
    assert abs(got["all"]["v_std"] - st.stdev([1.0, 5.0, 9.5, 2.0])) < 1e-12 and got["all"]["v_avg"] == 17.5 / 4
    assert abs(got["one"]["v_std"] - st.stdev([5.0, 9.5])) < 1e-12 and got["one"]["v_max"] == 9.5
    for sc in scs:
        single = J.feature_table_from_sources(cl, dp, tel, sc).collect()
        assert len(single) == (sc.scenario_id in got)
