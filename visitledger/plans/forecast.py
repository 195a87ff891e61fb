"""Weekly charge forecast: additive level, damped trend and a 4-week season, fitted by grid search.

Every series is one row with its weekly values as an array (as long as the calendar, not as the data).
Spark builds the series and spreads them over the tasks; inside a task a series is folded once with all
grid points side by side as numpy vectors, and the point with the smallest squared error wins.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitledger.config import PracticeConfig
from visitledger.functions import dates
from visitledger.operators.topk import largest

# Smoothing grid for level, trend, season and damping.
ALPHAS = (0.05, 0.1, 0.2, 0.4, 0.6, 0.8)
BETAS = (0.0, 0.05, 0.1, 0.3)
GAMMAS = (0.0, 0.1, 0.3, 0.6)
PHIS = (0.8, 0.9, 0.98)

MIN_WEEKS = 8


def charge_weeks(charges: DataFrame, cfg: PracticeConfig, by: tuple[str, ...] = (), ends_on: str = "MON") -> DataFrame:
    """Charges per series and week since the forecast start, calendar gaps as 0: one row per series with
    `first_week`, `last_week` and the array `values`."""
    recent = charges.filter(F.col("service_date") >= F.lit(cfg.forecast_start))
    week = dates.week_end(F.col("service_date"), ends_on).alias("week")
    weekly = recent.groupBy(*by, week).agg(F.sum("charge_amount").cast("double").alias("v"))
    keyed = weekly.groupBy(*by).agg(
        F.min("week").alias("first_week"), F.max("week").alias("last_week"),
        F.sort_array(F.collect_list(F.struct("week", "v"))).alias("_weeks"))

    def with_gap(entry: Column, i: Column) -> Column:
        before = F.get(F.col("_weeks"), i - 1)["week"]
        missing = F.when(i == 0, F.lit(0)).otherwise((F.date_diff(entry["week"], before) / 7 - 1).cast("int"))
        return F.concat(F.array_repeat(F.lit(0.0), missing), F.array(entry["v"]))

    values = F.flatten(F.transform("_weeks", with_gap))
    return keyed.filter("first_week is not null").withColumn("values", values).drop("_weeks")


FIT = "alpha double, beta double, gamma double, phi double, level double, trend double, season array<double>, sse double"


BLOCK = 64


def fit_block(series: list[np.ndarray], period: int = 4) -> list[tuple]:
    """Best grid point of each series with its final level, trend and season (oldest season value first).

    State arrays are (series, grid point). Longer series come first, so the ones that still have values at a
    step are a leading slice.
    """
    order = sorted(range(len(series)), key=lambda i: -len(series[i]))
    lengths = np.array([len(series[i]) for i in order])
    values = np.zeros((len(series), lengths[0]))
    for row, i in enumerate(order):
        values[row, :lengths[row]] = series[i]
    alpha, beta, gamma, phi = np.array(list(product(ALPHAS, BETAS, GAMMAS, PHIS))).T
    shape = (len(series), alpha.size)

    def mean(start):
        total = values[:, start]
        for k in range(start + 1, start + period):
            total = total + values[:, k]
        return total / period

    first = mean(0)
    level = np.repeat(first[:, None], shape[1], axis=1)
    trend = np.repeat(((mean(period) - first) / period)[:, None], shape[1], axis=1)
    season = np.repeat((values[:, :period] - first[:, None])[:, :, None], shape[1], axis=2)
    sse = np.zeros(shape)
    for t in range(lengths[0]):
        n = int(np.count_nonzero(lengths > t))
        v, old, slot = values[:n, t, None], level[:n], t % period
        seasonal, damped = season[:n, slot].copy(), phi * trend[:n]
        base = old + damped
        error = v - (base + seasonal)
        season[:n, slot] = gamma * (v - old - damped) + (1.0 - gamma) * seasonal
        renewed = alpha * (v - seasonal) + (1.0 - alpha) * base
        trend[:n] = beta * (renewed - old) + (1.0 - beta) * damped
        level[:n] = renewed
        sse[:n] += error * error
    fits: list[tuple] = [()] * len(series)
    for row, i in enumerate(order):
        best = int(np.argmin(sse[row]))
        state = (alpha[best], beta[best], gamma[best], phi[best], level[row, best], trend[row, best])
        seasons = [float(season[row, (lengths[row] + k) % period, best]) for k in range(period)]
        fits[i] = (*(float(x) for x in state), seasons, float(sse[row, best]))
    return fits


def fit(series: DataFrame, by: tuple[str, ...] = (), period: int = 4) -> DataFrame:
    """The best parameters and final state per series; series shorter than 8 weeks have no row."""
    names = [part.split(" ")[0] for part in FIT.split(", ")]

    @F.pandas_udf(FIT)
    def best(values: pd.Series) -> pd.DataFrame:
        arrays = [np.asarray(v, dtype=float) for v in values]
        fits = [fit for i in range(0, len(arrays), BLOCK) for fit in fit_block(arrays[i:i + BLOCK], period)]
        return pd.DataFrame(fits, columns=names)

    span = F.date_diff("last_week", "first_week")
    long_enough = series.filter(span >= 7 * (MIN_WEEKS - 1))
    if by:
        # The rows are few and small but each costs CPU, so they are spread over all cores.
        long_enough = long_enough.repartition(series.sparkSession.sparkContext.defaultParallelism)
    fitted = long_enough.withColumn("state", best("values"))
    return fitted.select(*by, "last_week", _mean_all(F.col("values")).alias("avg_hist"), "state")


def _mean_all(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), F.size(values))


def forecast(fitted: DataFrame, by: tuple[str, ...] = (), steps: int = 26, period: int = 4) -> DataFrame:
    """`steps` weekly forecasts per series."""
    ahead = fitted.select(*by, "state", "last_week", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    phi = F.col("state.phi")
    damping = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0.0), lambda acc, k: acc + F.pow(phi, k))
    seasonal = F.element_at("state.season", (F.col("step") - 1) % period + 1)
    value = F.col("state.level") + damping * F.col("state.trend") + seasonal
    return ahead.select(*by, "step", F.date_add("last_week", F.col("step") * 7).alias("week"), value.alias("forecast"))


def forecast_stats(fitted: DataFrame, predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean history, mean forecast and growth in percent per series."""
    means = predictions.groupBy(*by).agg(F.avg("forecast").alias("avg_forecast"))
    history = fitted.select(*by, "avg_hist")
    joined = history.join(means, list(by)) if by else history.withColumn(
        "avg_forecast", means.select("avg_forecast").scalar())
    growth = F.when(F.col("avg_hist") > 0, (F.col("avg_forecast") - F.col("avg_hist")) / F.col("avg_hist") * 100.0)
    return joined.withColumn("growth_pct", F.coalesce(growth, F.lit(0.0)))


def top_weeks(predictions: DataFrame, k: int = 3) -> DataFrame:
    """The k weeks with the largest forecast."""
    return largest(predictions.select("week", "forecast"), "forecast", k, "week")
