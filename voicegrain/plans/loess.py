"""Seasonal-trend decomposition by loess: a series as trend, season and remainder, with weights that make outliers count less.

Inner rounds take turns: the season is each weekday's own series smoothed by loess, less what a low-pass filter keeps of it; the trend is the loess of what
the season leaves. Outer rounds weigh days by the size of their remainders (bisquare at six medians). A series is a group of one row a day, so
that its length is bounded by the calendar, and groups are independent tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def odd(x: float) -> int:
    """The least odd whole number that is not below x."""
    n = math.ceil(x)
    return n if n % 2 else n + 1


def loess(y: np.ndarray, weights: np.ndarray, q: int, at: np.ndarray) -> np.ndarray:
    """Local lines through (0, y[0]), (1, y[1]), ... at the places `at`: tricube weights over the q nearest points, times the given weights."""
    n = len(y)
    x = np.arange(n, dtype=float)
    gap = np.abs(at[:, None] - x[None, :])
    reach = np.partition(gap, min(q, n) - 1, axis=1)[:, min(q, n) - 1] * max(1.0, q / n)
    reach = np.maximum(reach, 1e-12)[:, None]
    near = np.where(gap < reach, (1 - (gap / reach) ** 3) ** 3, 0.0)
    w = near * weights[None, :]
    total = w.sum(axis=1)
    w = np.where(total[:, None] > 0, w, near)  # no weight left: as if all days counted
    total = w.sum(axis=1)
    w = w / np.where(total > 0, total, 1)[:, None]
    middle = w @ x
    spread = (w * (x[None, :] - middle[:, None]) ** 2).sum(axis=1)
    mean = w @ y
    slope = (w * (x[None, :] - middle[:, None])) @ y
    bent = spread > 1e-9 * max(n - 1, 1) ** 2
    line = mean + np.where(bent, (at - middle) * slope / np.where(bent, spread, 1), 0.0)
    return np.where(total > 0, line, np.interp(at, x, y))


def _means(y: np.ndarray, k: int) -> np.ndarray:
    """Moving means of k values, k - 1 fewer than there are."""
    sums = np.concatenate(([0.0], np.cumsum(y)))
    return (sums[k:] - sums[:-k]) / k


def stl(y: np.ndarray, period: int = 7, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """trend, season, remainder and weights of a series of two periods at least; of a shorter one, its mean is the trend."""
    n = len(y)
    if n < 2 * period:
        trend = np.full(n, y.mean() if n else 0.0)
        return trend, np.zeros(n), y - trend, np.ones(n)
    low, slow = odd(period), odd(1.5 * period / (1 - 1.5 / seasonal))
    days = np.arange(n, dtype=float)
    trend, season, weights = np.zeros(n), np.zeros(n), np.ones(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            left = y - trend
            cycle = np.zeros(n + 2 * period)
            for day in range(period):
                own = left[day::period]
                cycle[day::period] = loess(own, weights[day::period], seasonal, np.arange(-1, len(own) + 1, dtype=float))
            passed = _means(_means(_means(cycle, period), period), 3)
            season = cycle[period : period + n] - loess(passed, np.ones(n), low, days)
            trend = loess(y - season, weights, slow, days)
        rest = y - trend - season
        if turn < outer:
            size = 6 * np.median(np.abs(rest))
            weights = np.ones(n) if size <= 1e-12 else np.where(np.abs(rest) < size, (1 - (np.abs(rest) / size) ** 2) ** 2, 0.0)
    return trend, season, rest, weights


def decompose(series: DataFrame, by: str = "topic_id", period: int = 7, seasonal: int = 7, robust: bool = True) -> DataFrame:
    """by, day, n, trend, season, remainder, weight. series: by, day, n with a row for every day."""
    key = series.schema[by].dataType.simpleString()
    inner, outer = (2, 15) if robust else (5, 0)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("day")
        found = stl(table["n"].to_numpy().astype(float), period, seasonal, inner, outer)
        for name, values in zip(("trend", "season", "remainder", "weight"), found, strict=True):
            table = table.append_column(name, pa.array(values))
        return table

    return series.select(by, "day", F.col("n").cast("long").alias("n")).groupBy(by).applyInArrow(run, f"{by} {key}, day date, n long, trend double, season double, remainder double, weight double")


def outliers(parts: DataFrame, by: str = "topic_id", sigma: float = 2.5) -> DataFrame:
    """Days of decompose() whose remainder is further from its mean than sigma deviations of the remainders before them (two at least): is_anomaly, expected, z."""
    before = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    z = F.try_divide(F.col("remainder") - F.avg("remainder").over(before), F.stddev_samp("remainder").over(before))
    told = parts.withColumn("expected", F.col("trend") + F.col("season")).withColumn("z", z)
    return told.withColumn("is_anomaly", F.coalesce(F.abs("z") > sigma, F.lit(False)))
