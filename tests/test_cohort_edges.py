"""Hand-made edge rows (FIXTURES.md, "Hand-made edge rows")."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultlens import Scenario
from faultlens.operators import cohort as C
from faultlens.operators import features as FT
from faultlens.plans import jobs as J

D = dt.date
TS = dt.datetime
CLAIM_SCHEMA = "Claim_number string, ESN string, ABO_FAILURE_PART string, Failure_date date"
DISP_SCHEMA = "Claim_number string, TNF_Flag string"
TEL_SCHEMA = ("ESN string, Occurrence_time timestamp, engine_model_group string, "
              "Faultlist string, Faultlist2 string, v string")


def sc(**kw):
    args = dict(candidates=("A", "B"), targets=("A",), fault_codes=("1682",), features=("v",))
    args.update(kw)
    return Scenario(**args)


def claim_assets(spark, claims, disps, s=None):
    s = s or sc()
    c = spark.createDataFrame(claims, CLAIM_SCHEMA)
    d = spark.createDataFrame(disps, DISP_SCHEMA).dropna()
    return C.claim_cohort(c, d, s.candidates, s.targets)


def test_disposition_rules(spark):
    f = D(2024, 1, 10)
    claims = [("c1", "e1", "A", f),            # no disposition -> gone
              ("c2", "e2", "A", f),            # null flag -> gone
              ("c3", "e3", "B", f),            # two non-Y -> two rows -> gone
              ("c4", "e4", "A", f),            # one Y + one N -> one row, kept
              ("c5", "e5", "A", f)]            # plain N -> kept
    disps = [("c2", None), ("c3", "N"), ("c3", "N"), ("c4", "Y"), ("c4", "N"), ("c5", "N")]
    got = {r.ESN for r in claim_assets(spark, claims, disps).collect()}
    assert got == {"e4", "e5"}


def test_second_claim_on_other_part_does_not_count(spark):
    f = D(2024, 1, 10)
    claims = [("c1", "e1", "A", f), ("c2", "e1", "Z", f)]
    got = claim_assets(spark, claims, [("c1", "N"), ("c2", "N")]).collect()
    assert [(r.ESN, r.label) for r in got] == [("e1", 1)]


def test_null_asset_is_gone(spark):
    f = D(2024, 1, 10)
    got = claim_assets(spark, [("c1", None, "A", f)], [("c1", "N")]).collect()
    assert got == []


def _cohort_rows(spark, tel, fail=D(2024, 1, 10), s=None):
    s = s or sc()
    c = spark.createDataFrame([("c1", "e1", "A", fail), ("c2", "e2", "B", fail)], CLAIM_SCHEMA)
    d = spark.createDataFrame([("c1", "N"), ("c2", "N")], DISP_SCHEMA)
    t = spark.createDataFrame(tel, TEL_SCHEMA)
    return J.plan_cohort(c, d, t, s)


def test_window_edges(spark):
    tel = [("e1", TS(2024, 1, 10, 8, 0), "X_Y_Z", "[1682]", None, "1"),    # same day 08:00 -> out
           ("e1", TS(2024, 1, 10, 0, 0), "X_Y_Z", "[1682]", None, "2"),    # midnight -> in
           ("e1", TS(2024, 1, 3, 23, 59), "X_Y_Z", "[1682]", None, "3"),   # 7 days at 23:59 -> in
           ("e1", TS(2024, 1, 2, 23, 59), "X_Y_Z", "[1682]", None, "4")]   # 8 calendar days -> out
    got = sorted(r.v for r in _cohort_rows(spark, tel).window_rows.collect())
    assert got == ["2", "3"]


def test_fault_code_brackets_and_nulls(spark):
    t0 = TS(2024, 1, 9)
    tel = [("e1", t0, "X_Y_Z", "[168]", None, "1"),          # 168 is not 1682 -> no hit (alone)
           ("e2", t0, "X_Y_Z", None, "[3574][1682]", "1"),   # null list + hit in the other
           ("e2", t0, "X_Y_Z", "[9]", "[9]", "2")]           # same asset, no hit -> kept too
    s = sc(fault_codes=("1682",))
    p = _cohort_rows(spark, [r for r in tel], s=s)
    rows = p.rows.collect()
    assert {r.ESN for r in rows} == {"e2"}
    assert sorted(r.v for r in rows) == ["1", "2"]
    s2 = sc(fault_codes=("168",))
    rows2 = _cohort_rows(spark, tel, s=s2).rows.collect()
    assert {r.ESN for r in rows2} == {"e1"}


def test_matching_row_with_null_feature_keeps_asset(spark):
    t0 = TS(2024, 1, 9)
    tel = [("e1", t0, "X_Y_Z", "[1682]", None, "abc"),   # the only hit, feature bad -> dropped later
           ("e1", t0, "X_Y_Z", "[1]", None, "2.5")]
    p = _cohort_rows(spark, tel)
    ft = J.build_feature_table(p.rows, sc()).collect()
    assert [(r.ESN, r.v_max, r.v_std) for r in ft] == [("e1", 2.5, None)]   # one row: std null
    fused = J.feature_table_from_sources(
        spark.createDataFrame([("c1", "e1", "A", D(2024, 1, 10))], CLAIM_SCHEMA),
        spark.createDataFrame([("c1", "N")], DISP_SCHEMA),
        spark.createDataFrame(tel, TEL_SCHEMA), sc()).collect()
    assert [(r.ESN, r.v_max, r.v_std, r.label) for r in fused] == [("e1", 2.5, None, 1)]


def test_lenient_numeric(spark):
    vals = ["abc", "", "NaN", " 1.5 ", "1d", "1_000", "1f", "inf", "-2e3", ".5", "1__0", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.v for r in FT.cast_features(df, ["v"]).collect()]
    import math
    assert got[0] is None and got[1] is None and math.isnan(got[2])
    assert got[3:] == [1.5, None, 1000.0, None, float("inf"), -2000.0, 0.5, None, None]
    clean = FT.drop_incomplete(FT.cast_features(df, ["v"]), ["v"]).collect()
    assert len(clean) == 5      # NaN dropped like null


def test_group_without_underscore_is_filtered(spark):
    t = spark.createDataFrame(
        [("e1", TS(2024, 1, 9), "X15", None, None, "1"),
         ("e1", TS(2024, 1, 9), "X15_NSVI_A", None, None, "1"),
         ("e1", TS(2024, 1, 9), "X15_NSVI", None, None, "1"),
         ("e1", TS(2024, 1, 9), "X15N_NSVI_A", None, None, "1")], TEL_SCHEMA)
    got = C.group_filter(t, ["X15"], ["NSVI"]).collect()
    assert sorted(r.engine_model_group for r in got) == ["X15_NSVI", "X15_NSVI_A"]
    # the prefix form equals the token form
    tok = t.filter(F.get(F.split("engine_model_group", "_"), 0).isin("X15") &
                   F.get(F.split("engine_model_group", "_"), 1).isin("NSVI"))
    assert sorted(tok.collect()) == sorted(got)


def test_argument_errors(spark):
    with pytest.raises(ValueError):
        sc(candidates=())
    with pytest.raises(ValueError):
        sc(fault_codes=())
    with pytest.raises(ValueError):
        C.candidate_filter(spark.createDataFrame([], CLAIM_SCHEMA), [])
    with pytest.raises(ValueError):
        C.fault_code_match([], ["Faultlist"])
    single = spark.createDataFrame([("e1", 1.0, 1), ("e2", 2.0, 1)], "ESN string, x double, label int")
    with pytest.raises(ValueError):
        FT.require_two_classes(single)
    with pytest.raises(FT.EmptyCohortError):
        FT.check_not_empty(single.filter("false"))


def test_timestamp_failure_date(spark):
    """A timestamp failure compares by time for '>=' and by calendar day for the
    7-day bound (the reading at 16:00 on the failure day is after 15:00 -> out)."""
    c = spark.createDataFrame([("c1", "e1", "A", TS(2024, 1, 10, 15, 0))],
                              "Claim_number string, ESN string, ABO_FAILURE_PART string, "
                              "Failure_date timestamp")
    d = spark.createDataFrame([("c1", "N")], DISP_SCHEMA)
    t = spark.createDataFrame(
        [("e1", TS(2024, 1, 10, 14, 0), "X_Y_Z", "[1682]", None, "in: same day, earlier"),
         ("e1", TS(2024, 1, 10, 16, 0), "X_Y_Z", "[1682]", None, "out: after failure"),
         ("e1", TS(2024, 1, 3, 0, 1), "X_Y_Z", "[1682]", None, "in: 7 calendar days"),
         ("e1", TS(2024, 1, 2, 23, 59), "X_Y_Z", "[1682]", None, "out: 8 calendar days")],
        TEL_SCHEMA)
    got = sorted(r.v for r in J.plan_cohort(c, d, t, sc()).window_rows.collect())
    assert got == ["in: 7 calendar days", "in: same day, earlier"]


def test_read_checks_types(spark, tmp_path):
    from faultlens.sources import read_claims, read_telemetry
    good = spark.createDataFrame([("c1", 7, "A", D(2024, 1, 1))],
                                 "Claim_number string, ESN bigint, ABO_FAILURE_PART string, "
                                 "Failure_date date")
    assert read_claims(spark, good).count() == 1
    bad = spark.createDataFrame([("c1", "e1", "A", "2024-01-01")], CLAIM_SCHEMA.replace(
        "Failure_date date", "Failure_date string"))
    with pytest.raises(TypeError, match="Failure_date"):
        read_claims(spark, bad)
    tel = spark.createDataFrame([("e1", TS(2024, 1, 1), "X_Y_Z", "[1]", None, "1.5")], TEL_SCHEMA)
    assert read_telemetry(spark, tel, ["v"]).count() == 1
    with pytest.raises(TypeError, match="v"):
        read_telemetry(spark, tel.withColumn("v", F.array(F.lit(1.0))), ["v"])
