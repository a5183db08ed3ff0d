import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.functions.boosting import Settings, boosted, cuts_of
from millrace.operators import stages, validation
from millrace.plans import workflow
from millrace.plans.screening import Config
from millrace.plans.validation import fold_features, validate
from millrace.sources import outputs


def plant(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x, load = rng.normal(size=n), rng.normal(size=n)
    y = np.zeros(n)
    for i in range(3, n):
        y[i] = 0.3 * y[i - 1] + 0.9 * x[i - 3] + 0.2 * load[i - 1] + 0.2 * rng.normal()
    return pd.DataFrame({"t": np.arange(n) * 60, "y": y, "x": x, "load": load, "noise": rng.normal(size=n)})


QUICK = Settings(rounds=60, rate=0.15, depth=3, patience=10)


def test_boosting_learns_and_stops_early():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 4))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + x[:, 1] * (x[:, 2] > 0) + 0.1 * rng.normal(size=900)
    part = slice(0, 600), slice(600, 750), slice(750, 900)
    guess, last = boosted(*(v[part[0]] for v in (x, y)), *(v[part[1]] for v in (x, y)), x[part[2]], Settings(rounds=400, rate=0.1))
    assert np.mean((guess - y[part[2]]) ** 2) < 0.25 * y.var() and 10 < last < 400
    again, _ = boosted(*(v[part[0]] for v in (x, y)), *(v[part[1]] for v in (x, y)), x[part[2]], Settings(rounds=400, rate=0.1))
    assert (guess == again).all()
    flat, stopped = boosted(np.ones((50, 1)), y[:50], np.ones((20, 1)), y[:20], np.ones((5, 1)), QUICK)
    assert np.allclose(flat, y[:50].mean(), atol=0.5) and stopped < 60 and all(len(c) < 64 for c in cuts_of(x))


def test_validation_finds_what_adds_to_the_baseline(spark):
    pool = spark.createDataFrame([(1, "noise", 2), (2, "x", 3), (3, "y", 1), (4, "gone", 2), (5, "load", -1)], "candidate_order int, variable string, screening_lag int")
    v = validate(spark.createDataFrame(plant()), "y", pool, ["load"], 5, settings=QUICK)
    uplift = {r["variable"]: r for r in v.uplift.collect()}
    assert v.status == "success" and uplift["x"]["uplift_rank"] == 1 and uplift["x"]["validation_status"] == "validated_incremental_signal"
    assert uplift["noise"]["median_rmse_improvement_pct"] < 10 and uplift["gone"]["validation_status"] == "insufficient_features" and uplift["gone"]["fold_count"] == 0
    means = {r["model"]: r for r in v.model_summary.collect()}
    assert means["M2"]["mean_rmse"] < means["M1"]["mean_rmse"] < 1.1 * means["M0"]["mean_rmse"] and means["M2"]["m2_vs_m1_rmse_improvement_pct"] > 20
    context = validation.fold_context(v.rows.withColumnRenamed("part", "partition"))
    assert outputs.bundle_errors(v.fold_metrics, context, v.candidate_metrics, v.uplift).count() == 0
    torn = outputs.bundle_errors(v.fold_metrics.where("not (fold = 1 and model = 'M0')").unionByName(v.fold_metrics.where("fold = 0 and model = 'M1'")), context, v.candidate_metrics.withColumn("rmse", F.col("rmse") * 2), v.uplift)
    assert {r["rule"] for r in torn.collect()} == {"doubled metrics", "models missing in a fold", "improvements"}
    print_one = stages.fingerprint(v.rows, ["x__lag_3"]).first()
    assert print_one == stages.fingerprint(v.rows.orderBy(F.desc("t")), ["x__lag_3"]).first() != stages.fingerprint(v.rows.withColumn("y", F.col("y") + 1), ["x__lag_3"]).first()
    v.release()


def test_folds_do_not_see_beyond_their_parts(spark):
    data = plant(600)
    splits = validation.expanding_splits(600, gap=3)
    features = [("y", 1), ("x", 3)]
    run = lambda d: fold_features(spark.createDataFrame(d), "y", ["y", "x"], features, splits, 60, mode="lowpass_diff").toPandas().set_index(["fold", "part", "t"]).sort_index()
    one = run(data)
    later = data.copy()
    cut = splits[0].validation[1]
    later.loc[cut:, ["x", "y"]] += 100
    two = run(later)
    for part in ("train", "validation"):
        pd.testing.assert_frame_equal(one.loc[0].loc[part], two.loc[0].loc[part])
    # The first row of a part has no difference, so the first, second and fourth row of a validation block lack something;
    # the third reads the gap before the block. Training rows read nothing before them.
    a, b = splits[0].validation
    assert len(one.loc[0].loc["train"]) == splits[0].train[1] - 4 and len(one.loc[0].loc["validation"]) == b - a - 3
    assert one.loc[0].loc["validation"].index.min() == (a + 2) * 60


def test_too_few_rows_in_a_fold(spark):
    data = plant(200)
    data.loc[data.index % 2 == 0, "x"] = np.nan
    pool = spark.createDataFrame([(1, "x", 3)], "candidate_order int, variable string, screening_lag int")
    with pytest.raises(ValueError, match="training rows"):
        validate(spark.createDataFrame(data).replace(float("nan"), None), "y", pool, [], 5, settings=QUICK)


def test_candidate_pool_bounds(spark):
    rows = spark.createDataFrame([(f"v{i}", "priority_review", 2, "use", None, "", i, None, None) for i in range(20)], "variable string, final_recommendation string, screening_lag int, recommended_use string, candidate_class string, risk_flags string, final_rank int, candidate_priority_rank int, candidate_pool_rank int")
    assert [r["variable"] for r in stages.candidate_pool(rows, "v0", top_n=3, forced=["v0", "v9"]).orderBy("candidate_order").collect()] == ["v1", "v2", "v3", "v9"]
    with pytest.raises(ValueError):
        stages.candidate_pool(rows, "v0", top_n=11)
    with pytest.raises(ValueError, match="more than 12"):
        stages.candidate_pool(rows, "v0", top_n=10, forced=["v11", "v12", "v13"])


def test_command_line_from_screening_to_validation(spark, tmp_path, capsys):
    data = plant()
    data.insert(0, "time", pd.Timestamp("2025-01-01") + pd.to_timedelta(data.pop("t"), "s"))
    data.to_csv(tmp_path / "in.csv", index=False)
    out = str(tmp_path / "run")
    run = lambda *a: cli.main([*a, "--output", out])
    run("analyze", "--input", str(tmp_path / "in.csv"), "--target", "y", "--max-lag", "4", "--preprocess-mode", "lowpass", "--lowpass-tau-minutes", "0.5", "--residual-control-columns", "load", "--exclude-windows", json.dumps([{"start": 1735689600 + 6000, "end": 1735689600 + 6060}]))
    assert "# Screening of y" in capsys.readouterr().out
    ranked = outputs.read_optional(spark, f"{out}/raw", "ranked_features").orderBy("driver_rank").collect()
    assert ranked[0]["variable"] == "x" and ranked[0]["lag"] == 3 and outputs.read_optional(spark, f"{out}/comparison", "preprocessing_comparison").count() == 3
    assert outputs.current(f"{out}/raw", spark)["about"]["gap_starts"] == [1735689600 + 6120]
    run("confirm-branch", "--branch", "processed")
    config, branch = workflow.formal(spark, out)
    assert config.mode == "lowpass" and branch.endswith("processed") and Config.from_json(outputs.load_config(spark, out)).controls == ("load",)
    run("confirm-branch", "--branch", "raw")
    for command in ("run-enhanced", "run-granger", "run-model", "run-causal-review", "run-validation"):
        run(command, *(["--control-columns", "load"] if command in ("run-causal-review", "run-validation") else []), *(["--whitelist", "x"] if command == "run-validation" else []))
    assert outputs.read_optional(spark, f"{out}/granger", "granger_tests").orderBy("q_order").first()["variable"] == "x"
    assert outputs.read_optional(spark, f"{out}/model", "model_variable_importance").orderBy("importance_rank").first()["variable"] == "x"
    assert outputs.read_optional(spark, f"{out}/enhanced", "enhanced_validation_summary").count() == 3
    assert outputs.current(f"{out}/validation", spark)["about"]["status"] == "success"
    uplift = {r["variable"]: r for r in outputs.read_optional(spark, f"{out}/validation", "candidate_uplift").collect()}
    assert uplift["x"]["validation_status"] == "validated_incremental_signal"
    with pytest.raises(ValueError):
        workflow.confirm_branch(spark, out, "other")
