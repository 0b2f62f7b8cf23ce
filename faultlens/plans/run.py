"""Run one scenario end to end from a JSON argument file.

    spark-submit --py-files faultlens.zip faultlens/plans/run.py args.json

``args.json`` keys: claims, dispositions, telemetry (table names or paths),
output (folder), candidates, targets, fault_codes, features, platforms,
emissions, and optionally window_days, split_ratio, validation_ratio, seed,
max_depth, max_iterations, early_stopping, training_partitions, mode ("auto" | "custom"),
n_trials, scenario_id, top_k (features kept after screening), selected_features
(these are used as they are and nothing is screened), feature_table (a stored
table to train on; the cohort is then not built) and format (of path inputs).
Writes cohort, feature table, ranking and the report tables under ``output``; an
empty feature table stops the job. Scratch tables go when the job ends.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import functions as F

from faultlens import Scenario, make_session
from faultlens.operators import features as FT
from faultlens.plans import jobs
from faultlens.plans.training import screen_features, train_and_report
from faultlens.session import scratch_scope
from faultlens.sources import read_claims, read_dispositions, read_telemetry, scan_feature_table
from faultlens.sources.sinks import read_table, write_report_tables, write_table

SCENARIO_KEYS = ("candidates", "targets", "fault_codes", "features", "platforms", "emissions",
                 "window_days", "split_ratio", "validation_ratio", "seed", "early_stopping",
                 "max_depth", "max_iterations", "training_partitions", "scenario_id")


def run(args: dict, spark=None) -> dict:
    spark = spark or make_session()
    with scratch_scope(spark):      # everything to keep is written under the output folder
        return _run(args, spark)


def _run(args: dict, spark) -> dict:
    sc = Scenario(**{k: args[k] for k in SCENARIO_KEYS if k in args})
    out = args["output"].rstrip("/")
    fmt = args.get("format", "parquet")
    if args.get("feature_table"):
        table = scan_feature_table(spark, args["feature_table"], fmt)
    else:
        claims = read_claims(spark, args["claims"], fmt)
        disp = read_dispositions(spark, args["dispositions"], fmt)
        tel = read_telemetry(spark, args["telemetry"], sc.features, fmt)
        plan = jobs.plan_cohort(claims, disp, tel, sc)
        write_table(plan.rows, f"{out}/cohort")
        write_table(jobs.build_feature_table(read_table(spark, f"{out}/cohort"), sc), f"{out}/features")
        table = read_table(spark, f"{out}/features")
    table = FT.check_not_empty(table, "feature table")
    chosen = list(args.get("selected_features") or [])
    if not chosen:
        _, ranking, _ = screen_features(spark, table, jobs.feature_names(sc), sc)
        write_table(ranking, f"{out}/ranking")
        ranking = read_table(spark, f"{out}/ranking")
        chosen = [r.feature for r in ranking.filter(F.col("rank") <= int(args.get("top_k", 10)))
                  .orderBy("rank").collect()]
    reports = train_and_report(spark, table, chosen, sc, mode=args.get("mode", "auto"),
                               n_trials=int(args.get("n_trials", 10)))
    for name, rep in reports.items():
        write_report_tables(rep.tables, f"{out}/reports", sc.scenario_id, name)
    return {"output": out, "features": chosen,
            "auc": {name: rep.evaluation.auc for name, rep in reports.items()}}


if __name__ == "__main__":
    with open(sys.argv[1]) as f:
        print(json.dumps(run(json.load(f))))
