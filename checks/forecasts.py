"""Forecast steps with SQL forms, and the fitted model without one."""

from pyspark.sql import functions as F

from checks.registry import query, table
from quillgrid.operators.forecast import (
    check_eligibility,
    prepare_series,
    run_forecast,
    series_eligibility,
)
from quillgrid.operators.profile import profile_table
from quillgrid.operators.small import small_frame

KEY = "o_orderpriority"
HORIZON = 18

SERIES_SQL = f"""
WITH s AS (SELECT {KEY}, last_day(cast(o_orderdate AS date)) AS period, sum(cast(o_totalprice AS decimal(18,2))) AS total,
    cast(min(o_orderdate) AS date) AS a, cast(max(o_orderdate) AS date) AS z FROM orders GROUP BY 1, 2),
b AS (SELECT {KEY}, min(period) AS p0, max(period) AS p1, min(a) AS a, max(z) AS z, date_diff('month', min(period), max(period)) + 1 AS n FROM s GROUP BY 1),
c AS (SELECT {KEY}, last_day(cast(unnest(generate_series(date_trunc('month', p0), date_trunc('month', p1), interval 1 month)) AS date)) AS period FROM b),
series AS (SELECT c.{KEY}, c.period, cast(coalesce(total, 0) AS double) AS value FROM c LEFT JOIN s USING ({KEY}, period) JOIN b USING ({KEY})
  WHERE n < 3 OR NOT ((c.period = p1 AND b.z < p1) OR (c.period = p0 AND b.a > date_trunc('month', p0)))),
points AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY {KEY}) AS n,
    greatest(4, least(count(*) OVER (PARTITION BY {KEY}) // 5, 12)) AS holdout FROM series WINDOW w AS (PARTITION BY {KEY} ORDER BY period) QUALIFY n >= 12),
lengths AS (SELECT {KEY}, max(n) AS n, max(holdout) AS holdout, max(period) AS last_period, min(value) AS least FROM points GROUP BY 1),
back AS (SELECT {KEY}, n - holdout AS m, unnest(generate_series(1, holdout)) AS h FROM lengths),
held AS (SELECT back.{KEY}, h, known.value AS predicted, actual.value AS value FROM back
  JOIN points known ON known.{KEY} = back.{KEY} AND known.i = CASE WHEN m >= 12 THEN m - 12 + 1 + (h - 1) % 12 ELSE m END
  JOIN points actual ON actual.{KEY} = back.{KEY} AND actual.i = m + h),
train AS (SELECT {KEY}, stddev_pop(value) AS train_std FROM points WHERE i <= n - holdout GROUP BY 1),
scores AS (SELECT {KEY}, avg(abs(value - predicted) / CASE WHEN abs(value) >= 1e-9 THEN abs(value) END) * 100 AS mape,
    coalesce(nullif(stddev_pop(value - predicted), 0), nullif(max(train_std), 0), 1.0) AS std FROM held JOIN train USING ({KEY}) GROUP BY 1),
future AS (SELECT {KEY}, n, last_period, least, unnest(generate_series(1, {HORIZON})) AS h FROM lengths),
projected AS (SELECT future.{KEY}, cast(h AS int) AS h, last_day(cast(date_trunc('month', last_period) + to_months(cast(h AS int)) AS date)) AS period, mape, std,
    CASE WHEN least >= 0 THEN greatest(points.value, 0) ELSE points.value END AS mean
  FROM future JOIN points ON points.{KEY} = future.{KEY} AND points.i = future.n - 12 + 1 + (h - 1) % 12 JOIN scores ON scores.{KEY} = future.{KEY}),
bands AS (SELECT {KEY}, h, period, 'seasonal_naive' AS model, round(mape, 1) AS backtest_mape, round(mean, 2) AS mean, round(mean - 1.2816 * std * sqrt(h), 2) AS lo80, round(mean + 1.2816 * std * sqrt(h), 2) AS hi80,
    round(mean - 1.96 * std * sqrt(h), 2) AS lo95, round(mean + 1.96 * std * sqrt(h), 2) AS hi95 FROM projected)
"""


def _series(spark, sf, keys=(KEY,)):
    return prepare_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", keys)


def _naive(spark, sf):
    return run_forecast(_series(spark, sf), HORIZON, ["seasonal_naive"])


@query("prepare_series", SERIES_SQL + f"SELECT {KEY}, period, round(value, 2) AS value FROM series")
def prepared(spark, sf):
    return _series(spark, sf).frame.select(KEY, "period", F.round("value", 2).alias("value"))


@query("series_eligibility", SERIES_SQL + f"SELECT {KEY}, count(*) AS observations, count(*) >= 12 AS eligible, cast(NULL AS varchar) AS reason FROM series GROUP BY 1")
def eligibility(spark, sf):
    return series_eligibility(_series(spark, sf))


@query(
    "forecast_eligibility",
    "WITH s AS (SELECT last_day(cast(o_orderdate AS date)) AS period, cast(min(o_orderdate) AS date) AS a, cast(max(o_orderdate) AS date) AS z FROM orders GROUP BY 1), "
    "b AS (SELECT min(period) AS p0, max(period) AS p1, min(a) AS a, max(z) AS z, date_diff('month', min(period), max(period)) + 1 AS n FROM s), "
    "o AS (SELECT n - CASE WHEN z < p1 THEN 1 ELSE 0 END - CASE WHEN a > date_trunc('month', p0) THEN 1 ELSE 0 END AS observations FROM b) "
    "SELECT observations >= 12 AS eligible, 'o_orderdate' AS date_column, 'o_totalprice' AS metric, 'ME' AS frequency, observations FROM o",
)
def table_eligibility(spark, sf):
    """The whole table judged from its own profile: date, first metric, enough periods."""
    orders = table(spark, sf, "orders")
    found = check_eligibility(orders, profile_table(orders))
    row = (found.eligible, found.date_column, found.metric_options[0], found.frequency, found.observations)
    return small_frame(spark, [row], "eligible boolean, date_column string, metric string, frequency string, observations bigint")


@query("seasonal_naive_backtest", SERIES_SQL + f"SELECT {KEY}, 'seasonal_naive' AS model, round(mape, 4) AS mape, round(std, 2) AS std FROM scores")
def naive_backtest(spark, sf):
    return _naive(spark, sf).scores.select(KEY, "model", F.round("mape", 4).alias("mape"), F.round("std", 2).alias("std"))


@query("seasonal_naive_bands", SERIES_SQL + "SELECT * FROM bands")
def naive_bands(spark, sf):
    return _naive(spark, sf).forecast


@query(
    "forecast_summary",
    SERIES_SQL + f", r AS (SELECT {KEY}, sum(cast(value AS decimal(18,2))) AS r FROM points WHERE n - i < {HORIZON} GROUP BY 1), f AS (SELECT {KEY}, sum(cast(mean AS decimal(18,2))) AS f FROM bands GROUP BY 1) "
    f"SELECT {KEY}, 'seasonal_naive' AS model, cast(f AS double) AS forecast_total, cast(r AS double) AS recent_total, round((cast(f AS double) - r) / abs(r) * 100, 1) AS change_pct FROM f JOIN r USING ({KEY})",
)
def summary(spark, sf):
    return _naive(spark, sf).summary


@query("forecast_history", SERIES_SQL + f"SELECT {KEY}, period, round(value, 2) AS value FROM points WHERE n - i < 400")
def history(spark, sf):
    return _naive(spark, sf).history


@query("holt_winters_forecast")
def holt_winters_forecast(spark, sf):
    """Fitted by search: no SQL form."""
    return run_forecast(_series(spark, sf), HORIZON, ["holt_winters"]).forecast


@query("select_model_forecast")
def select_model_forecast(spark, sf):
    """Both models backtested; the better one per series is projected."""
    return run_forecast(_series(spark, sf), HORIZON).forecast


@query("forecast_many_series")
def forecast_many_series(spark, sf):
    """One monthly series per customer nation and order priority."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    series = prepare_series(rows, "o_orderdate", "o_totalprice", ["c_nationkey", KEY])
    return run_forecast(series, 6).forecast


@query("forecast_one_series")
def forecast_one_series(spark, sf):
    return run_forecast(_series(spark, sf, ()), HORIZON).forecast
