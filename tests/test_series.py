import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrid.errors import ForecastError
from quillgrid.operators.forecast import (
    check_eligibility,
    prepare_series,
    run_forecast,
    series_eligibility,
)
from quillgrid.operators.profile import profile_table
from quillgrid.operators.smoothing import holt_winters
from quillgrid.operators.timeseries import fill_gaps, frequency_for, half_growth, recent_deltas, resample


def daily(spark, days=700, trend=0.5, amp=20.0, start="2024-01-01"):
    rng = np.random.default_rng(7)
    t = np.arange(days)
    value = 100 + trend * t + amp * np.sin(2 * np.pi * t / 7) + rng.normal(0, 5, days)
    pdf = pd.DataFrame({"order_date": pd.date_range(start, periods=days), "revenue": value})
    return spark.createDataFrame(pdf).withColumn("order_date", F.col("order_date").cast("timestamp_ntz")), pdf


@pytest.mark.parametrize(("days", "expected"), [(0, "D"), (62, "D"), (63, "W"), (370, "W"), (371, "ME")])
def test_frequency(days, expected):
    assert frequency_for(days) == expected


@pytest.mark.parametrize("freq", ["D", "W", "ME"])
def test_resample_matches_pandas(spark, freq):
    frame, pdf = daily(spark, 200)
    keep = pdf.index % 40 < 20  # leaves gaps of weeks
    expected = pdf[keep].set_index("order_date").resample(freq)["revenue"].sum()
    sparse = frame.join(spark.createDataFrame(pdf[keep][["order_date"]]).withColumn("order_date", F.col("order_date").cast("timestamp_ntz")), "order_date")
    found = resample(sparse, "order_date", freq, {"v": F.sum("revenue")}).orderBy("period").toPandas()
    assert [str(p) for p in found["period"]] == [str(i.date()) for i in expected.index]
    assert list(found["v"]) == pytest.approx(list(expected))


def test_edges_are_trimmed(spark):
    frame, pdf = daily(spark, 700, start="2024-01-10")
    series = prepare_series(frame, "order_date", "revenue")
    assert series.frequency == "ME"
    found = series.frame.orderBy("period").toPandas()
    monthly = pdf.set_index("order_date").resample("ME")["revenue"].sum()
    assert str(found["period"].iloc[0]) == "2024-02-29"
    assert str(found["period"].iloc[-1]) == "2025-11-30"
    assert list(found["value"]) == pytest.approx(list(monthly.iloc[1:-1]))


def test_half_growth_middle_goes_second(spark):
    rows = [("a", f"2026-01-0{i}", float(v)) for i, v in enumerate([1, 1, 1, 3, 3], 1)] + [("b", "2026-01-01", 1.0)]
    series = spark.createDataFrame(rows, "k string, p string, v double").withColumn("period", F.to_date("p"))
    found = half_growth(series, "v", ["k"]).collect()
    assert len(found) == 1  # series of fewer than four buckets tell nothing
    assert found[0]["growth_pct"] == 250.0
    assert (str(found[0]["best_period"]), str(found[0]["worst_period"])) == ("2026-01-04", "2026-01-01")


def test_recent_delta_needs_ten_rows(spark):
    frame, pdf = daily(spark, 60)
    found = recent_deltas(frame, "order_date", {"revenue": F.col("revenue")})["revenue"]
    end, s = pdf["order_date"].max(), pdf.set_index("order_date")["revenue"]
    w = pd.Timedelta(days=29)
    now, before = s[s.index > end - w].sum(), s[(s.index <= end - w) & (s.index > end - 2 * w)].sum()
    assert found == pytest.approx((now - before) / before * 100)
    assert recent_deltas(frame.limit(9), "order_date", {"revenue": F.col("revenue")}) == {"revenue": None}


def test_smoothing_follows_trend_and_season():
    line = holt_winters(100 + 2.0 * np.arange(60), 10, 7)
    assert line[-1] > 218
    t = np.arange(180)
    wave = 100 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 7)
    ahead = np.arange(180, 194)
    assert holt_winters(wave, 14, 7) == pytest.approx(100 + 0.5 * ahead + 20 * np.sin(2 * np.pi * ahead / 7), rel=0.1)


def test_forecast_bands_and_calendar(spark):
    frame, _ = daily(spark, 365)
    series = prepare_series(frame, "order_date", "revenue")
    result = run_forecast(series, 14)
    rows = result.forecast.orderBy("h").collect()
    assert len(rows) == 14 and "_series" not in result.forecast.columns
    assert {r["period"].isoweekday() for r in rows} == {7}
    widths = [r["hi95"] - r["lo95"] for r in rows]
    assert widths == sorted(widths)
    assert all(r["lo95"] <= r["lo80"] <= r["mean"] <= r["hi80"] <= r["hi95"] for r in rows)
    assert all(r["mean"] >= 0 for r in rows)
    scores = {r["model"]: r["mape"] for r in result.scores.collect()}
    assert rows[0]["model"] == min(scores, key=scores.get)


def test_many_series_with_a_hot_key(spark):
    frame, _ = daily(spark, 700)
    hot = frame.withColumn("k", F.lit("hot"))
    others = frame.where(F.dayofmonth("order_date") % 2 == 0).withColumn("k", F.concat(F.lit("s"), F.dayofweek("order_date")))
    short = frame.orderBy("order_date").limit(40).withColumn("k", F.lit("short"))
    missing = frame.withColumn("k", F.lit(None).cast("string"))
    rows = hot.unionByName(hot).unionByName(others).unionByName(short).unionByName(missing)
    series = prepare_series(rows, "order_date", "revenue", ["k"])
    usable = {r["k"]: r["eligible"] for r in series_eligibility(series).collect()}
    assert usable.pop("short") is False and all(usable.values())
    made = {r["k"]: r["count"] for r in run_forecast(series, 5).forecast.groupBy("k").count().collect()}
    assert made == dict.fromkeys(usable, 5) and "(missing)" in made


def test_eligibility_reasons(spark):
    frame, _ = daily(spark, 365)
    info = check_eligibility(frame, profile_table(frame))
    assert info.eligible and info.frequency == "W" and info.metric_options == ["revenue"]
    few = frame.orderBy("order_date").limit(8)
    assert "periods" in check_eligibility(few, profile_table(few)).reason
    undated = frame.select("revenue")
    assert "date" in check_eligibility(undated, profile_table(undated)).reason
    unmeasured = frame.select("order_date", F.lit("x").alias("note"))
    assert "metric" in check_eligibility(unmeasured, profile_table(unmeasured)).reason


def test_refusals(spark):
    frame, _ = daily(spark, 40)
    series = prepare_series(frame, "order_date", "revenue")
    with pytest.raises(ForecastError):
        run_forecast(series, 1)
    with pytest.raises(ForecastError):
        run_forecast(series, 5, ["arima"])
    with pytest.raises(ForecastError):
        run_forecast(prepare_series(frame.limit(5), "order_date", "revenue"), 5)


def test_zero_actuals_and_flat_series(spark):
    rows = pd.DataFrame({"order_date": pd.date_range("2026-01-01", periods=30), "revenue": 0.0})
    frame = spark.createDataFrame(rows).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))
    result = run_forecast(prepare_series(frame, "order_date", "revenue"), 4)
    first = result.forecast.orderBy("h").first()
    assert first["model"] == "seasonal_naive" and first["backtest_mape"] is None and first["mean"] == 0.0
    assert result.summary.first()["change_pct"] is None


@pytest.mark.parametrize(("frequency", "last"), [("D", dt.date(9999, 12, 31)), ("W", dt.date(9999, 12, 26)), ("ME", dt.date(9999, 12, 31))])
def test_a_far_date_is_spelt_out_in_many_tasks(spark, frequency, last):
    first = {"D": dt.date(2023, 11, 13), "W": dt.date(2023, 11, 12), "ME": dt.date(2023, 12, 31)}[frequency]
    series = spark.createDataFrame([(first, 1.0), (last, 2.0)], "period date, v double")
    filled = fill_gaps(series, frequency, zero=["v"])
    found = filled.agg(F.count("*"), F.min("period"), F.max("period"), F.count_distinct("period"), F.sum("v")).first()
    steps = {"D": (last - first).days, "W": (last - first).days // 7, "ME": (last.year - first.year) * 12 + last.month - first.month}[frequency]
    assert tuple(found) == (steps + 1, first, last, steps + 1, 3.0)
    sizes = filled.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) > 1 and sizes.max() < 0.6 * sizes.sum()
