import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.distributions import betainc, corr_p, f_tail, t_two_sided
from millrace.operators import association, axis, causality, filters, preprocess, residual, stability, validation
from millrace.plans.screening import Config, screen
from millrace.sources import outputs, tables


def long_of(spark, columns, step=60):
    rows = [(i * step, name, None if v is None or math.isnan(v) else float(v)) for name, values in columns.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "t long, variable string, value double")


def values(df, name):
    return [r["value"] for r in df.where(F.col("variable") == name).orderBy("t").collect()]


def test_tails_against_known_values():
    assert betainc(2, 3, 0.5) == pytest.approx(0.6875)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert f_tail(3, 2, 10) == pytest.approx(1 - 0.904632568, abs=1e-8)
    assert corr_p(1.0, 10) == 0.0 and math.isnan(corr_p(0.5, 2))


def test_benjamini_hochberg_ignores_nulls(spark):
    p = [0.01, 0.04, 0.03, None, 0.2]
    out = association.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", "q")
    got = {r["i"]: r["q"] for r in out.collect()}
    assert got[3] is None
    assert [got[i] for i in (0, 2, 1, 4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])


def test_leading_variable_is_found(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=360)
    y = np.roll(x, 4) + 0.1 * rng.normal(size=360)
    best = association.best_lags(association.lag_scores(long_of(spark, {"x": x, "y": y, "noise": rng.normal(size=360)}), "y", 6, 60)).collect()
    top = {r["variable"]: r for r in best}
    assert top["x"]["lag"] == 4 and top["x"]["score"] > 0.9 and top["x"]["direction"] == "variable_leads"


def test_constant_series_has_no_correlation(spark):
    out = association.lag_scores(long_of(spark, {"x": [1.0] * 40, "y": list(range(40))}), "y", 2, 60).collect()
    assert all(r["pearson"] is None for r in out)


def test_physical_lags_do_not_cross_gaps_or_forced_starts(spark):
    rows = [(t, v, float(t)) for v in ("x", "y") for t in (0, 60, 120, 300, 360)]
    long = spark.createDataFrame(rows, "t long, variable string, value double")
    assert {r["t"] for r in axis.lagged_pairs(long, "y", [1], 60).collect()} == {60, 120, 360}
    assert {r["t"] for r in axis.lagged_pairs(long, "y", [1], 60, [120]).collect()} == {60, 360}


def test_segments(spark):
    t = spark.createDataFrame([(x,) for x in (0, 60, 120, 210, 400)], "t long")
    ids = lambda **k: [r["segment"] for r in axis.segment_ids(t, 60, **k).orderBy("t").collect()]
    assert ids() == [0, 0, 0, 1, 2] and ids(tolerance=1.5) == [0, 0, 0, 0, 1] and ids(tolerance=1.5, starts=[60]) == [0, 1, 1, 1, 2]


def test_interpolation_fills_the_first_of_a_gap_only(spark):
    out = preprocess.interpolate(long_of(spark, {"x": [None, 1, None, None, None, 5, None]}), 2)
    assert values(out, "x") == [None, 1.0, 2.0, 3.0, None, 5.0, None]


def test_lowpass_matches_a_loop(spark):
    x = [1.0, None, 3.0, 2.0]
    a, b = 1 - math.exp(-2 / 5), 1 - math.exp(-1 / 5)
    second = 1 + a * 2
    assert values(preprocess.lowpass(long_of(spark, {"x": x}), 5.0), "x") == [1.0, None, pytest.approx(second), pytest.approx(second + b * (2 - second))]


@pytest.mark.parametrize("tau", [0.01, 1.0, 30.0, 1e6])
def test_lowpass_in_blocks_matches_a_loop(tau):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.choice([1, 1, 1, 5, 900], 3000)).astype(float)
    x = rng.normal(size=3000)
    want = [x[0]]
    for i in range(1, 3000):
        want.append(want[-1] + (1 - math.exp(-(t[i] - t[i - 1]) / tau)) * (x[i] - want[-1]))
    assert np.allclose(preprocess.low_passed(t, x, tau), want, rtol=1e-9, atol=1e-10)


def test_causal_steps_do_not_see_the_future(spark):
    x = [float(i * i % 17) for i in range(40)]
    short, full = (preprocess.transform(long_of(spark, {"x": v}), "detrend_diff", causal=True) for v in (x[:30], x))
    assert values(short, "x") == values(full, "x")[:30]


def test_diff_interval_rounds_half_to_even():
    assert [preprocess.diff_interval(m, 60) for m in (0.5, 1.5, 2.5)] == [1, 2, 2]
    with pytest.raises(ValueError):
        preprocess.diff_interval(0, 60)


def test_conditions_never_match_missing_values(spark):
    df = spark.createDataFrame([(0, -1.5), (1, 0.0), (2, None), (3, float("nan")), (4, float("inf"))], "t long, x double")
    kept = filters.exclude(df, rules=[{"column": "x", "operator": "!=", "value": 0}])
    assert {r["t"] for r in kept.collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        filters.condition_mask([{"column": "x", "operator": "~", "value": 0}])


def test_exclusion_stats_of_an_empty_table(spark):
    r = filters.exclusion_stats(spark.createDataFrame([], "t long"), [{"start": 0, "end": 1}]).first()
    assert (r["original"], r["ratio"]) == (0, 0.0)


def test_residual_corr_removes_a_common_driver(spark):
    rng = np.random.default_rng(3)
    load = rng.normal(size=300)
    columns = {"load": load, "y": 1.8 * load + 0.3 * rng.normal(size=300), "x": 1.6 * load + 0.3 * rng.normal(size=300), "other": rng.normal(size=300), "twice": 2 * load, "flat": np.ones(300)}
    long = long_of(spark, columns)
    for controls in (["load"], ["load", "other"]):
        out = {r["variable"]: r for r in residual.residual_corr(residual.residual_scores(long, "y", controls, 3, 60), 3).collect()}
        assert out["x"]["residual_corr"] < 0.3 and out["x"]["residual_status"] == "ok" and out["load"]["residual_status"] == "control_reference_not_residualized"
    both = {r["variable"]: r for r in residual.residual_corr(residual.residual_scores(long, "y", ["load", "twice"], 3, 60), 3).collect()}
    assert both["x"]["residual_status"] == "rank_deficient" and both["x"]["control_matrix_rank"] == 2
    none = {r["variable"]: r["residual_status"] for r in residual.residual_corr(residual.residual_scores(long, "y", ["flat"], 3, 60), 3).collect()}
    assert none["x"] == "no_valid_controls"
    few = residual.residual_corr(residual.residual_scores(long.where("t < 600 and variable in ('x', 'y', 'load')"), "y", ["load"], 8, 60), 8).where("variable = 'x'").first()
    assert few["residual_status"] == "insufficient_joint_samples" and few["residual_n"] == 10


def test_residuals_match_a_loop_over_joint_rows(spark):
    rng = np.random.default_rng(8)
    n = 120
    z, x, y = (rng.normal(size=n).tolist() for _ in range(3))
    y = [0.5 * a + b for a, b in zip(z, y, strict=True)]
    x[7], y[30], z[55] = None, None, None
    joint = [i for i in range(n) if None not in (x[i], y[i], z[i])]
    zs = np.array([z[i] for i in joint])
    left = lambda v: v - np.polyval(np.polyfit(zs, v, 1), zs)
    rx, ry = (dict(zip(joint, left(np.array([v[i] for i in joint])), strict=True)) for v in (x, y))
    got = {r["lag"]: r for r in residual.residual_scores(long_of(spark, {"x": x, "y": y, "z": z}), "y", ["z"], 2, 60).where("variable = 'x' and lag is not null").collect()}
    for k in range(-2, 3):
        pairs = np.array([(rx[i - k], ry[i]) for i in joint if i - k in rx])
        assert got[k]["n"] == len(pairs) and got[k]["pearson"] == pytest.approx(np.corrcoef(pairs.T)[0, 1])


def test_series_in_memory_and_by_windows_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    columns = {v: [None if rng.random() < 0.1 else float(x) for x in rng.integers(0, 9, 200)] for v in ("y", "a", "b")} | {"flat": [1.0] * 200, "none": [None] * 200}
    long = long_of(spark, columns)
    keep = spark.createDataFrame([(t * 60,) for t in range(40, 170)], "t long")
    table = lambda: sorted((r["variable"], r["lag"], r["n"], *(None if r[c] is None else round(r[c], 9) for c in ("pearson", "spearman"))) for r in association.lag_scores(long, "y", 60, 60, starts=[1800, 7200], targets=keep).collect())
    parts = keep.withColumn("half", F.when(F.col("t") < 6000, "a").otherwise("b"))
    halves = lambda: sorted((r["half"], r["variable"], r["lag"], r["n"], None if r["spearman"] is None else round(r["spearman"], 9)) for r in association.lag_scores(long, "y", 9, 60, targets=parts, group="half").collect())
    one, two = table(), halves()
    monkeypatch.setattr(association.series, "SERIES_ROWS", 10)
    assert one == table() and len(one) == 3 * 121 and two == halves() and {x[0] for x in two} == {"a", "b"}


def test_excluded_windows_block_lags_in_a_screen(spark):
    rng = np.random.default_rng(4)
    n = 400
    x = rng.normal(size=n)
    y = np.roll(x, 5) + 0.1 * rng.normal(size=n)
    wide = spark.createDataFrame(pd.DataFrame({"t": np.arange(n) * 60, "y": y, "x": x, "w": rng.normal(size=n)}))
    s = screen(wide, Config("y", 6, exclude_windows=({"start": 100 * 60, "end": 102 * 60},)))
    assert s.frame.starts == (103 * 60,)
    got = s.lag_scores.where("variable = 'x' and lag = 5").first()
    kept = [i for i in range(n) if not 100 <= i <= 102]
    pairs = [i for i in kept if i - 5 in kept and (i < 103) == (i - 5 < 103)]
    assert got["n"] == len(pairs) and s.ranked.orderBy("driver_rank").first()["variable"] == "x"
    # First differences do not bridge the window either.
    assert s.long.where("variable = 'x'").groupBy("exact").count().count() == 2
    s.release()


def test_admission_interpolation_and_resampling(spark):
    n = 120
    base = np.arange(n, dtype=float)
    wide = pd.DataFrame({"t": np.arange(n) * 60, "y": base % 7, "half": np.where(np.arange(n) % 2, base, np.nan), "flat": 1.0, "kept": 2.0, "gap": np.where((np.arange(n) >= 50) & (np.arange(n) < 58), np.nan, base)})
    df = spark.createDataFrame(wide).replace(float("nan"), None)
    f = preprocess.prepare(df, "y", protected=["kept"])
    assert f.variables == ("y", "kept", "gap") and f.protected_constant == ("kept",) and f.period == 60 and f.rows == n
    gap = values(f.long, "gap")
    assert gap[50:55] == [50.0, 51.0, 52.0, 53.0, 54.0] and gap[55:58] == [None] * 3
    two = preprocess.prepare(df, "y", resample_seconds=120, protected=["kept"])
    assert two.period == 120 and two.rows == 60 and "half" in two.variables
    low = preprocess.prepare(df, "y", segment=("gap", "low", None, None), max_lag=2)
    assert {r["t"] for r in low.targets.collect()} <= {int(t) for t in range(0, 45 * 60, 60)}
    for frame in (f, two, low):
        frame.release()
    with pytest.raises(ValueError, match="fewer than 10"):
        preprocess.prepare(df.limit(5), "y")


def test_redundancy_keeps_a_clear_representative(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 200))
    long = long_of(spark, {"y": rng.normal(size=200), "a1": a, "a2": np.roll(a, -1), "b1": b, "b2": 3 * b, "c": rng.normal(size=200)})
    best = spark.createDataFrame([("a1", 2), ("a2", 3), ("b1", 1), ("b2", 1), ("c", 1), ("d", -1)], "variable string, lag int")
    pairs = association.redundant_pairs(long, "y", best, 60)
    groups = {r["variable"]: r["group"] for r in association.redundancy_groups(pairs, best.where("lag > 0")).collect()}
    assert groups == {"a1": "a1", "a2": "a1", "b1": "b1", "b2": "b1", "c": "c"}
    profile = spark.createDataFrame([("a1", 0.9, None), ("a2", 0.7, None), ("b1", 0.8, 0.1), ("b2", 0.1, 0.8), ("c", 0.5, 0.5)], "variable string, u double, v double")
    table = spark.createDataFrame(list(groups.items()), "variable string, group string")
    assert {r["variable"] for r in association.redundant_variables(table, profile, ["u", "v"]).where("redundant").collect()} == {"a2", "b1", "b2"}


def test_benjamini_hochberg_over_many_buckets(spark):
    rng = np.random.default_rng(9)
    p = [None if rng.random() < 0.05 else float(rng.choice([0.0, 0.01, 0.5, rng.random() ** 3])) for _ in range(700)]
    known = sorted(x for x in p if x is not None)
    want = {}
    for i, x in reversed(list(enumerate(known))):
        want[x] = min(1.0, x * len(known) / (i + 1), want.get(x, 1.0), want.get(known[i + 1], 1.0) if i + 1 < len(known) else 1.0)
    out = association.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", "q", buckets=16).collect()
    assert all((r["q"] is None) == (p[r["i"]] is None) and (r["q"] is None or r["q"] == pytest.approx(want[p[r["i"]]])) for r in out)


def test_more_tails_against_tables():
    assert [t_two_sided(t, df) for t, df in ((12.706, 1), (2.776, 4), (2.042, 30), (1.96, 10**6))] == pytest.approx([0.05] * 4, abs=2e-4)
    assert [f_tail(f, a, b) for f, a, b in ((161.45, 1, 1), (4.10, 2, 10), (2.38, 12, 17), (3.94, 1, 100))] == pytest.approx([0.05] * 4, abs=6e-4)


@pytest.mark.parametrize("kind", ["whole", "gaps", "off the grid", "collinear"])
def test_lag_scan_matches_direct_solutions(kind):
    rng = np.random.default_rng(20)
    n = 220
    t = np.arange(n) * 60
    x, y = rng.normal(size=n), rng.normal(size=n)
    y[2:] += 0.5 * x[:-2]
    if kind in ("gaps", "off the grid"):
        x[rng.random(n) < 0.05], y[rng.random(n) < 0.05] = np.nan, np.nan
        keep = (t < 3000) | (t > 4200)
        t, x, y = t[keep], x[keep], y[keep]
    if kind == "off the grid":
        t = np.where(np.arange(len(t)) == 5, t + 1, t)
    if kind == "collinear":
        x = np.roll(y, 1)
    scan = causality.LagScan(t, x, y, 60, 6)
    z = lambda v: (v - np.nanmean(v)) / np.nanstd(v)
    for p in range(1, 7):
        scan.advance()
        rows = np.column_stack([z(y), *[causality.shifted(t, z(v), k, 60) for v in (y, x) for k in range(1, p + 1)]])
        rows = rows[np.isfinite(rows).all(axis=1)]
        ones = np.ones((len(rows), 1))
        want = [causality.ssr(np.hstack([ones, rows[:, c]]), rows[:, 0]) for c in (list(range(1, p + 1)), list(range(1, 2 * p + 1)), [1], [1, 2 * p])]
        n_rows, s0, r0, s1, r1, a, b = scan.solve()
        assert n_rows == len(rows) and (r0, r1) == (want[0][1], want[1][1])
        assert [s0, s1, a, b] == pytest.approx([w[0] for w in want], rel=1e-8, abs=1e-8)


def test_granger_matches_normal_equations(spark):
    rng = np.random.default_rng(12)
    n = 150
    x, y = rng.normal(size=n), rng.normal(size=n)
    y[2:] += 0.6 * x[:-2]
    got = {r["lag"]: r for r in causality.granger(long_of(spark, {"x": x, "y": y}), "y", 3, 60).collect()}

    def squares(columns, t):
        m = np.column_stack([np.ones(len(t)), *columns])
        return float(((t - m @ np.linalg.solve(m.T @ m, m.T @ t)) ** 2).sum())

    for p in (1, 2, 3):
        t = y[p:]
        own, other = ([v[p - k : n - k] for k in range(1, p + 1)] for v in (y, x))
        s0, s1 = squares(own, t), squares(own + other, t)
        f = (s0 - s1) / p / (s1 / (len(t) - 2 * p - 1))
        assert got[p]["n"] == len(t) and got[p]["f"] == pytest.approx(f) and got[p]["p"] == pytest.approx(f_tail(f, p, len(t) - 2 * p - 1))


def test_regime_reversal(spark):
    rows = [("x", "low", 0.9, 0.9, 2), ("x", "mid", 0.8, -0.8, 2), ("y", "low", 0.5, 0.5, 1)]
    out = {r["variable"]: r for r in stability.regime_robustness(spark.createDataFrame(rows, "variable string, regime string, score double, signed_corr double, lag int"), 6).collect()}
    assert out["x"]["regime_sign_reversal_flag"] and out["x"]["regime_evidence_status"] == "partial_coverage"
    assert out["y"]["regime_evidence_status"] == "insufficient_regimes" and out["y"]["regime_stability_final"] is None


def test_granger_finds_the_driver(spark):
    rng = np.random.default_rng(5)
    x, e = rng.normal(size=400), 0.3 * rng.normal(size=400)
    y = np.zeros(400)
    for i in range(2, 400):
        y[i] = 0.4 * y[i - 1] + 0.8 * x[i - 2] + e[i]
    long = long_of(spark, {"x": x, "y": y, "noise": rng.normal(size=400)})
    out = {(r["variable"], r["lag"]): r for r in causality.granger(long, "y", 3, 60).collect()}
    assert out["x", 2]["q"] < 1e-6 and out["noise", 2]["q"] > 0.01
    cond = {(r["variable"], r["lag"]): r for r in causality.conditional_granger(long, "y", ["noise"], 3, 60).collect()}
    assert cond["x", 2]["q"] < 1e-6
    lift = {r["variable"]: r for r in causality.model_lift(long, "y", association.best_lags(association.lag_scores(long, "y", 3, 60)), 3, 60).collect()}
    assert lift["x"]["model_lift"] > 0.3


def test_split_errors_and_gaps():
    s = validation.expanding_splits(700, gap=5)
    assert all(a.train[1] + 5 == a.validation[0] and a.validation[1] + 5 == a.test[0] for a in s) and s[-1].test[1] == 700
    with pytest.raises(ValueError):
        validation.expanding_splits(100)


def test_screen_ranks_the_driver_first(spark):
    rng = np.random.default_rng(7)
    n = 360
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = np.roll(x, 3) + 0.15 * rng.normal(size=n)
    wide = spark.createDataFrame(pd.DataFrame({"t": np.arange(n) * 60, "y": y, "x": x, "noise": rng.normal(size=n), "load": z}))
    s = screen(wide, Config("y", 6, capacity="load", controls=("load",)))
    rows = s.ranked.orderBy("driver_rank").collect()
    assert rows[0]["variable"] == "x" and rows[0]["lag"] == 3 and rows[0]["candidate_grade"] in "AB"
    assert s.pool.first()["variable"] == "x"
    s.release()


def test_readers_and_publishing(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿time,y,x\n2025-01-01 00:00,1,2\n2025-01-01 00:01,3,\nbad,4,5\n2025-01-01 00:01,7,8\n".encode())
    (tmp_path / "b.txt").write_text("time;y\n2025-01-01;1\n2025-01-02;2\n")
    (tmp_path / "c.csv").write_bytes("时间,值\n2025-01-01,1\n".encode("gb18030"))
    a = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert tables.time_column(a) == "time" and a.columns == ["time", "y", "x"]
    assert [(r["y"], r["x"]) for r in tables.load_series(a, "time").orderBy("t").collect()] == [("1", "2"), ("7", "8")]
    assert tables.duplicate_times(a, "time").first()[0] == 1
    assert tables.read_table(spark, str(tmp_path / "b.txt")).columns == ["time", "y"]
    assert tables.read_table(spark, str(tmp_path / "c.csv")).columns == ["时间", "值"]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.doc")
    folder = str(tmp_path / "out")
    assert outputs.read_optional(spark, folder, "t") is None
    first = outputs.publish({"t": spark.range(1)}, folder, {"note": "é"})
    assert outputs.current(folder)["about"] == {"note": "é"}
    outputs.publish({"t": spark.range(2)}, folder)
    assert outputs.read_optional(spark, folder, "t").count() == 2
    outputs.rollback(folder, first)
    assert outputs.read_optional(spark, folder, "t").count() == 1
    with pytest.raises(ValueError):
        outputs.rollback(folder, "v-none")
    outputs.export_csv(spark.createDataFrame([("ä", 1)], "a string, b int"), f"{folder}/x.csv")
    assert (tmp_path / "out/x.csv").read_text("utf-8-sig") == "a,b\nä,1\n"
    with pytest.raises(ValueError):
        outputs.export_csv(spark.range(3), f"{folder}/y.csv", 2)
    (tmp_path / "big.csv").write_bytes(b"time,y\n" + b"2025-01-01,1\n" * 100_000)
    assert len(tables.first_bytes(spark, str(tmp_path / "big.csv"))) == 64 * 1024


def test_streaming_lowpass(spark, tmp_path):
    from millrace.streaming.resampling import lowpass_stream

    src = str(tmp_path / "in")
    long_of(spark, {"x": [1.0, 3.0, 2.0]}).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("t long, variable string, value double").parquet(src)
    q = lowpass_stream(stream, 5.0).writeStream.format("memory").queryName("lp").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["value"] for r in spark.sql("select value from lp order by t").collect()] == [pytest.approx(v) for v in values(preprocess.lowpass(long_of(spark, {"x": [1.0, 3.0, 2.0]}), 5.0), "x")]
