"""The same semantics on streams: sliding windows with late data, and smoothing as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, by: list[str], value: str, size: str = "30 seconds", step: str = "25 seconds", late: str = "1 minute") -> DataFrame:
    """Counts and means over sliding windows; rows later than ``late`` are dropped, windows end once the watermark passes them."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, size, step), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def smoothed(events: DataFrame, key: str, order: str, value: str, gap: int, alpha: float = 0.5) -> DataFrame:
    """Exponential smoothing per key with a new start after a gap; the state is the last order and value of the key.

    Rows of a micro-batch are taken in order; a row not after the state's is dropped.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, level = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, v in zip(rows[order].tolist(), rows[value].tolist(), strict=True):
            if last is not None and o <= last:
                continue
            fresh = last is None or o - last > gap
            level = float(v) if fresh else level + alpha * (float(v) - level)
            last = int(o)
            out.append((keys[0], last, level, fresh))
        if last is not None:
            state.update((last, level))
        yield pd.DataFrame(out, columns=[key, order, "smoothed", "fresh"])

    kind = dict(events.dtypes)[key]
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} bigint, smoothed double, fresh boolean", "last bigint, level double", "append", "NoTimeout")
