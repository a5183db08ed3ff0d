"""Command line: screen a table, confirm a branch and run the later stages; results go into versioned folders."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .plans import workflow
from .plans.screening import Config
from .session import session
from .sources import outputs, tables

MODES = ["raw", "detrend", "diff", "detrend_diff", "lowpass", "lowpass_detrend", "lowpass_diff"]


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("--output", required=True, help="result folder")
        return c

    a = command("analyze", "screen a table, raw and processed")
    a.add_argument("--input", required=True)
    a.add_argument("--target", required=True)
    a.add_argument("--time-column")
    a.add_argument("--encoding", default="auto")
    a.add_argument("--max-lag", type=int, default=12)
    a.add_argument("--top-k", type=int, default=20)
    a.add_argument("--resample-seconds", type=int)
    a.add_argument("--min-valid-ratio", type=float, default=0.7)
    a.add_argument("--preprocess-mode", choices=MODES, default="raw")
    a.add_argument("--lowpass-tau-minutes", type=float, default=5.0)
    a.add_argument("--diff-interval-minutes", type=float)
    a.add_argument("--detrend-window", type=int, default=24)
    a.add_argument("--max-interpolate-gap-points", type=int, default=5)
    a.add_argument("--segment-column")
    a.add_argument("--segment-mode", choices=["all", "low", "mid", "high", "custom"], default="all")
    a.add_argument("--segment-min", type=float)
    a.add_argument("--segment-max", type=float)
    a.add_argument("--capacity-column")
    a.add_argument("--residual-control-columns", default="")
    a.add_argument("--force-include-variables", default="")
    a.add_argument("--excluded-columns", default="")
    a.add_argument("--exclude-windows", default="[]", help="JSON list of {start, end} in seconds")
    a.add_argument("--exclude-conditions", default="[]", help="JSON list of {column, operator, value}")
    command("confirm-branch", "make a branch the formal result").add_argument("--branch", required=True, choices=workflow.BRANCHES)
    command("run-enhanced", "model lift and rolling correlation")
    command("run-granger", "Granger tests").add_argument("--max-lag", type=int)
    command("run-model", "a forest and what it finds").add_argument("--max-model-features", type=int, default=300)
    r = command("run-causal-review", "conditional tests and decisions")
    r.add_argument("--control-columns", default="")
    r.add_argument("--max-lag", type=int)
    r.add_argument("--min-rows", type=int, default=60)
    r.add_argument("--top-n", type=int)
    v = command("run-validation", "out-of-time validation of the reviewed candidates")
    v.add_argument("--control-columns", default="")
    v.add_argument("--whitelist", default="")
    v.add_argument("--top-n", type=int, default=8)
    v.add_argument("--max-lag", type=int)
    return p


def load(spark: SparkSession, source: dict, target: str) -> DataFrame:
    """The wide frame of a run's input."""
    raw = tables.read_table(spark, source["input"], source["encoding"])
    time = source["time_column"] or tables.time_column(raw)
    if not time:
        raise SystemExit("no time column found; name it with --time-column")
    wide = tables.numeric_frame(tables.load_series(raw, time), target)
    return wide.drop(*source["excluded"])


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session(a.master)
    folder = a.output
    if a.command == "analyze":
        config = Config(
            a.target, a.max_lag, a.top_k, a.preprocess_mode, tuple(names(a.residual_control_columns)), a.capacity_column, tuple(names(a.force_include_variables)), a.min_valid_ratio,
            tuple(json.loads(a.exclude_windows)), tuple(json.loads(a.exclude_conditions)), a.resample_seconds, a.max_interpolate_gap_points, a.detrend_window,
            a.lowpass_tau_minutes, a.diff_interval_minutes, a.segment_column, a.segment_mode, a.segment_min, a.segment_max,
        )
        source = {"input": a.input, "encoding": a.encoding, "time_column": a.time_column, "excluded": names(a.excluded_columns)}
        if lost := [c for c in source["excluded"] if c in [config.target, *config.protected]]:
            raise SystemExit(f"columns in use: {lost}")
        found = workflow.analyze(spark, load(spark, source, config.target), config, folder)
        outputs.write_text(spark, f"{folder}/source.json", json.dumps(source))
        print(json.dumps(found))
        print(outputs.summary(outputs.read_optional(spark, f"{folder}/raw", "ranked_features"), config.target))
        return
    if a.command == "confirm-branch":
        workflow.confirm_branch(spark, folder, a.branch)
        return
    config, _ = workflow.formal(spark, folder)
    wide = load(spark, json.loads(outputs.read_text(spark, f"{folder}/source.json")), config.target)
    run = {
        "run-enhanced": lambda: workflow.enhanced(spark, wide, folder),
        "run-granger": lambda: workflow.granger(spark, wide, folder, a.max_lag),
        "run-model": lambda: workflow.model(spark, wide, folder, a.max_model_features),
        "run-causal-review": lambda: workflow.causal_review(spark, wide, folder, names(a.control_columns), a.max_lag, a.min_rows, a.top_n),
        "run-validation": lambda: workflow.validate(spark, wide, folder, names(a.control_columns), names(a.whitelist), a.top_n, a.max_lag),
    }[a.command]
    print(json.dumps({"version": run()}))


if __name__ == "__main__":
    main()
