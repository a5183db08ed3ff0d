"""Streaming forms of the causal steps (an extension: batch tables are the reference form)."""

from __future__ import annotations

from collections.abc import Iterator

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resample_stream(events: DataFrame, width: str, lateness: str) -> DataFrame:
    """Mean and count per variable and window of (ts, variable, value); later rows than the watermark are dropped."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "variable")
        .agg(F.avg("value").alias("value"), F.count("value").alias("n")).select(F.col("window.start").alias("ts"), "variable", "value", "n")
    )


def lowpass_stream(events: DataFrame, tau_minutes: float) -> DataFrame:
    """First-order low-pass per variable; the state is the last time and output."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, y = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, x in zip(rows["t"], rows["value"], strict=True):
            if x is None or pd.isna(x) or (last is not None and t <= last):
                continue
            y = float(x) if y is None else y + (1 - math.exp(-((t - last) / 60) / tau_minutes)) * (float(x) - y)
            last = int(t)
            out.append((key[0], last, y))
        if last is not None:
            state.update((last, y))
        yield pd.DataFrame(out, columns=["variable", "t", "value"])

    return events.groupBy("variable").applyInPandasWithState(step, "variable string, t long, value double", "last long, y double", "append", GroupStateTimeout.NoTimeout)
