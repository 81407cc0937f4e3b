"""Backtested forecasts for one or many series, keyed by any columns.

Rows are aggregated to calendar buckets first, so a series is at most one value per
bucket however skewed its key is. The seasonal-naive model, the backtest, the choice of
model and the bands are joins and aggregations; only the Holt-Winters fit runs in
Python, one short series per call.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.errors import ForecastError
from quillgrid.functions.parsing import label_of, moment_of, number_of
from quillgrid.operators.profile import TableProfile
from quillgrid.operators.roles import pick_date_column, rank_metrics
from quillgrid.operators.smoothing import holt_winters
from quillgrid.operators.timeseries import (
    bucket_end,
    choose_frequency,
    fill_gaps,
    shift_bucket,
    trim_edges,
)
from quillgrid.sources.scratch import written

# --- Fixed values ------------------------------------------------------------
MIN_PERIODS = 12
SEASONS = {"D": 7, "W": 52, "ME": 12}
HOLDOUT_MIN, HOLDOUT_PART = 4, 5
Z80, Z95 = 1.2816, 1.96
NEAR_ZERO = 1e-9
HORIZON_MIN, HORIZON_MAX, HORIZON_DEFAULT = 2, 365, 30
MODELS = ("seasonal_naive", "holt_winters")  # earlier wins a tie
ONE_SERIES = "_series"
SERIES_PER_TASK, MAX_TASKS = 32, 20_000
# -----------------------------------------------------------------------------


@dataclass
class Series:
    """Regular series, one row per key and bucket: keys, period, value.

    A table without series keys gets one constant key, so that every join is on a key;
    results leave it out again.
    """

    frame: DataFrame
    frequency: str
    keys: list[str] = field(default_factory=list)

    @property
    def season(self) -> int:
        return SEASONS[self.frequency]

    def public(self, frame: DataFrame) -> DataFrame:
        return frame.drop(ONE_SERIES)

    def stored(self) -> "Series":
        """The same series read back from a written table, for use by several jobs."""
        return Series(written(self.frame, "series"), self.frequency, self.keys)


def prepare_series(frame: DataFrame, date_column: str, metric: str, keys: Sequence[str] = ()) -> Series:
    """Bucket totals, gaps as 0, unfinished edge weeks or months dropped."""
    names = list(keys) or [ONE_SERIES]
    labels = [label_of(frame, k).alias(k) for k in keys] or [F.lit("all").alias(ONE_SERIES)]
    rows = frame.select(
        *labels,
        moment_of(frame, date_column).alias("_d"),
        number_of(frame, metric).alias("_v"),
    )
    frequency = choose_frequency(rows, "_d")
    if frequency is None:
        raise ForecastError(f"{date_column} holds no usable date")
    totals = (
        rows.where("_d is not null and _v is not null")
        .groupBy(*names, bucket_end(F.col("_d"), frequency).alias("period"))
        .agg(
            F.sum("_v").alias("value"),
            F.min("_d").cast("date").alias("_first"),
            F.max("_d").cast("date").alias("_last"),
        )
    )
    filled = fill_gaps(totals, frequency, names, ["value"])
    w = Window.partitionBy(*names)
    filled = filled.withColumns({"_first": F.min("_first").over(w), "_last": F.max("_last").over(w)})
    trimmed = trim_edges(filled, frequency, "_first", "_last", names)
    return Series(trimmed.select(*names, "period", F.col("value").cast("double").alias("value")), frequency, names)


def series_eligibility(series: Series) -> DataFrame:
    """Per series: its length, and why it cannot be forecast if so."""
    n = F.col("observations")
    short = F.concat(F.lit("only "), n, F.lit(f" usable periods, at least {MIN_PERIODS} are needed"))
    return series.public(
        series.frame.groupBy(*series.keys)
        .agg(F.count("*").alias("observations"))
        .withColumns({"eligible": n >= MIN_PERIODS, "reason": F.when(n < MIN_PERIODS, short)})
    )


@dataclass
class Eligibility:
    eligible: bool
    reason: str | None = None
    date_column: str | None = None
    metric_options: list[str] = field(default_factory=list)
    frequency: str | None = None
    observations: int = 0


def check_eligibility(frame: DataFrame, profile: TableProfile) -> Eligibility:
    """Whether the table as a whole can be forecast, judged on its first metric."""
    date = pick_date_column(profile)
    if date is None:
        return Eligibility(False, "no date column; if dates are stored as text, clean the table first")
    metrics = [m for m in rank_metrics(profile) if m in frame.columns]
    if not metrics:
        return Eligibility(False, "no numeric metric column", date)
    series = prepare_series(frame, date, metrics[0])
    found = series_eligibility(series).first()
    n = found["observations"] if found else 0
    if n < MIN_PERIODS:
        return Eligibility(False, f"only {n} usable periods, at least {MIN_PERIODS} are needed", date, observations=n)
    return Eligibility(True, None, date, metrics, series.frequency, n)


# --- Models ------------------------------------------------------------------


def numbered(series: Series) -> DataFrame:
    """Position `i` of n in its series, and the holdout length; short series left out."""
    w = Window.partitionBy(*series.keys)
    n = F.col("n")
    holdout = F.greatest(F.lit(HOLDOUT_MIN), F.least(F.floor(n / HOLDOUT_PART), F.lit(series.season)))
    return (
        series.frame.withColumns({"i": F.row_number().over(w.orderBy("period")), "n": F.count("*").over(w)})
        .where(n >= MIN_PERIODS)
        .withColumn("holdout", holdout.cast("int"))
    )


def naive_predictions(points: DataFrame, series: Series, horizon: int) -> DataFrame:
    """The last full cycle repeated, or the last value when there is no full cycle.

    Predicts the holdout from the part before it, and the future from everything.
    """
    keys, season = series.keys, F.lit(series.season)
    lengths = points.groupBy(*keys).agg(F.max("n").alias("n"), F.max("holdout").alias("holdout"))
    phases = F.array(
        *[
            F.struct(F.lit(phase).alias("phase"), m.alias("m"), steps.alias("steps"))
            for phase, m, steps in (
                ("holdout", F.col("n") - F.col("holdout"), F.col("holdout")),
                ("future", F.col("n"), F.lit(horizon)),
            )
        ]
    )
    m = F.col("m")
    cyclic = (m >= season) & (season > 1)
    steps = (
        lengths.select(*keys, F.inline(phases))
        .select(*keys, "phase", "m", F.explode(F.sequence(F.lit(1), F.col("steps").cast("int"))).alias("h"))
        .withColumn("i", F.when(cyclic, m - season + 1 + (F.col("h") - 1) % season).otherwise(m))
    )
    return steps.join(points.select(*keys, "i", "value"), [*keys, "i"]).select(
        *keys, F.lit(MODELS[0]).alias("model"), "phase", "h", F.col("value").alias("predicted")
    )


def smoothed_predictions(points: DataFrame, series: Series, horizon: int) -> DataFrame:
    """Holt-Winters for every series; a fit that does not stay finite yields no rows.

    Series are small but fits are not: the number of tasks follows the number of series,
    where adaptive execution would merge them by their few bytes.
    """
    keys, season = series.keys, series.season
    count = series.frame.select(*keys).distinct().count()
    tasks = min(MAX_TASKS, math.ceil(count / SERIES_PER_TASK))
    rows = points.select(*keys, "i", "value", "holdout").repartition(tasks, *keys)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        values = group.sort_values("i")["value"].to_numpy()
        holdout = int(group["holdout"].iloc[0])
        parts = []
        for phase, known, steps in (("holdout", values[:-holdout], holdout), ("future", values, horizon)):
            predicted = holt_winters(known, steps, season)
            if np.isfinite(predicted).all():
                h = np.arange(1, steps + 1, dtype="int32")
                parts.append(pd.DataFrame({"phase": phase, "h": h, "predicted": predicted}))
        found = pd.concat(parts) if parts else pd.DataFrame({"phase": [], "h": [], "predicted": []})
        for k in keys:
            found[k] = group[k].iloc[0]
        return found[[*keys, "phase", "h", "predicted"]]

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "phase string", "h int", "predicted double"])
    fitted = rows.groupBy(*keys).applyInPandas(fit, schema)
    return fitted.select(*keys, F.lit(MODELS[1]).alias("model"), "phase", "h", "predicted")


def backtest(points: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series and model: percentage error (near-zero actuals ignored) and residual spread."""
    keys = list(keys)
    held = predictions.where("phase = 'holdout'")
    actual = points.where("i > n - holdout").select(
        *keys, (F.col("i") - (F.col("n") - F.col("holdout"))).cast("int").alias("h"), "value"
    )
    spread = points.where("i <= n - holdout").groupBy(*keys).agg(F.stddev_pop("value").alias("_train"))
    miss = F.col("value") - F.col("predicted")
    size = F.when(F.abs("value") >= NEAR_ZERO, F.abs("value"))
    scored = held.join(actual, [*keys, "h"]).groupBy(*keys, "model").agg(
        (F.avg(F.abs(miss) / size) * 100).alias("mape"), F.stddev_pop(miss).alias("_residual")
    )
    zero = F.lit(0.0)
    std = F.coalesce(F.nullif("_residual", zero), F.nullif("_train", zero), F.lit(1.0))
    return scored.join(spread, keys).select(*keys, "model", "mape", std.alias("std"))


def select_model(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest error per series; no error counts as worst, and ties keep the simpler model."""
    keys = list(keys)
    order = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    worst_last = F.struct(F.coalesce("mape", F.lit(float("inf"))), order)
    picked = F.min_by(F.struct("model", "mape", "std"), worst_last)
    return scores.groupBy(*keys).agg(picked.alias("b")).select(*keys, "b.*")


def with_bands(points: DataFrame, chosen: DataFrame, series: Series) -> DataFrame:
    """Calendar, non-negativity and 80/95% bands for chosen future predictions."""
    keys = series.keys
    ends = points.groupBy(*keys).agg(F.max("period").alias("_end"), F.min("value").alias("_least"))
    mean = F.when(F.col("_least") >= 0, F.greatest(F.col("predicted"), F.lit(0.0))).otherwise(F.col("predicted"))
    width = F.col("std") * F.sqrt("h")

    def band(z: float) -> Column:
        return F.round(mean + z * width, 2)

    return chosen.join(ends, keys).select(
        *keys, "h", shift_bucket(F.col("_end"), F.col("h"), series.frequency).alias("period"), "model",
        F.round("mape", 1).alias("backtest_mape"), F.round(mean, 2).alias("mean"),
        band(-Z80).alias("lo80"), band(Z80).alias("hi80"), band(-Z95).alias("lo95"), band(Z95).alias("hi95"),
    )


@dataclass
class Forecast:
    forecast: DataFrame
    history: DataFrame
    scores: DataFrame
    summary: DataFrame
    frequency: str
    horizon: int
    keys: list[str]


def run_forecast(series: Series, horizon: int = HORIZON_DEFAULT, models: Sequence[str] = MODELS) -> Forecast:
    """Backtest the models, keep the better one per series, and project it."""
    if not HORIZON_MIN <= horizon <= HORIZON_MAX:
        raise ForecastError(f"horizon must be {HORIZON_MIN}..{HORIZON_MAX}")
    unknown = set(models) - set(MODELS)
    if unknown or not models:
        raise ForecastError(f"unknown models: {sorted(unknown)}")
    series = series.stored()
    keys = series.keys
    points = numbered(series)
    if points.isEmpty():
        raise ForecastError(f"no series has {MIN_PERIODS} periods")
    makers = {MODELS[0]: naive_predictions, MODELS[1]: smoothed_predictions}
    predictions = None
    for m in MODELS:
        if m in models:
            part = makers[m](points, series, horizon)
            predictions = part if predictions is None else predictions.unionByName(part)
    predictions = written(predictions, "predictions")  # fits run once
    scores = backtest(points, predictions, keys)
    best = select_model(scores, keys)
    chosen = predictions.where("phase = 'future'").join(best, [*keys, "model"])
    forecast = with_bands(points, chosen, series)
    history = points.select(*keys, "period", F.round("value", 2).alias("value"))
    summary = forecast_summary(forecast, history, keys, horizon)
    named = [k for k in keys if k != ONE_SERIES]
    return Forecast(*[series.public(f) for f in (forecast, history, scores, summary)], series.frequency, horizon, named)


def forecast_summary(forecast: DataFrame, history: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Forecast total against the equally long recent window, and the change in percent."""
    keys = list(keys)
    ahead = forecast.groupBy(*keys).agg(F.sum("mean").alias("_f"), F.first("model").alias("model"))
    latest = Window.partitionBy(*keys).orderBy(F.desc("period"))
    recent = (
        history.withColumn("_k", F.row_number().over(latest))
        .where(F.col("_k") <= horizon)
        .groupBy(*keys)
        .agg(F.sum("value").alias("_r"))
    )
    f, r = F.col("_f"), F.col("_r")
    return ahead.join(recent, keys).select(
        *keys, "model", F.round(f, 2).alias("forecast_total"), F.round(r, 2).alias("recent_total"),
        F.round((f - r) / F.nullif(F.abs(r), F.lit(0.0)) * 100, 1).alias("change_pct"),
    )
