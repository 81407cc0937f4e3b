"""Dashboard tables, facts, ledger rollups and calendar helpers."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.plans import ENDS, SPINES
from checks.profiles import PROFILE_SQL, TYPES_SQL
from checks.registry import PARSED_SQL, dirty, query, table
from quillgrid.functions.render import compact_number
from quillgrid.operators import dashboard, facts, ledger
from quillgrid.operators.profile import profile_table
from quillgrid.operators.small import small_frame
from quillgrid.operators.timeseries import choose_frequency, date_range, half_growth, recent_deltas, resample, trim_edges
from quillgrid.plans.run import run_plan
from quillgrid.plans.starter import starter_plans

# --- Dashboard -------------------------------------------------------------------

_AMOUNT = {"revenue": "cast(amount AS decimal(18,2))", "quantity": "cast(quantity AS decimal(18,2))"}


def _delta_sql(source: str, moment: str, value: str) -> str:
    """Change of a total, latest window against the one before it."""
    v = f"cast({value} AS decimal(18,2))"
    return (
        f"SELECT (cast(now AS double) - before) / abs(before) * 100 FROM (SELECT sum({v}) FILTER ({moment} > e - w * interval 1 day) AS now, "
        f"cast(sum({v}) FILTER ({moment} <= e - w * interval 1 day AND {moment} > e - 2 * w * interval 1 day) AS double) AS before FROM {source}, "
        f"(SELECT max({moment}) AS e, greatest(7, least(datediff('second', min({moment}), max({moment})) // 86400 // 2, 90)) AS w FROM {source} WHERE {value} IS NOT NULL))"
    )


@query(
    "kpi_tiles",
    f"WITH {PARSED_SQL}, t AS (SELECT 0 AS place, 'Records' AS label, cast(count(*) AS double) AS value, cast(NULL AS double) AS delta FROM parsed "
    f"UNION ALL SELECT 1, 'Total revenue', cast(sum(exact_amount) AS double), ({_delta_sql('parsed', 'moment', 'amount')}) FROM parsed "
    f"UNION ALL SELECT 2, 'Total quantity', sum(quantity), ({_delta_sql('parsed', 'moment', 'quantity')}) FROM parsed) "
    "SELECT place, label, value, round(delta, 1) AS delta_pct, round(delta, 1) >= 0 AS delta_positive FROM t",
)
def kpi_tiles(spark, sf):
    return dashboard.kpi_table(dirty(spark, sf), ["revenue", "quantity"], "order_date").drop("shown")


@query(
    "recent_delta",
    f"SELECT round(({_delta_sql('events', 'ts', 'value')}), 2) AS delta_pct",
)
def recent_delta(spark, sf):
    found = recent_deltas(table(spark, sf, "events"), "ts", {"value": F.col("value")})
    return small_frame(spark, [(found["value"],)], "d double").select(F.round("d", 2).alias("delta_pct"))


def _shown(v: str, thousands: float, whole: bool) -> str:
    plain = f"WHEN abs({v}) >= 100 THEN format('{{:,.0f}}', {v})" if whole else ""
    return (
        f"CASE WHEN abs({v}) >= 1000000 THEN format('{{:,.2f}}', {v} / 1000000) || 'M' WHEN abs({v}) >= {thousands} "
        f"THEN format('{{:,.1f}}', {v} / 1000) || 'K' {plain} ELSE format('{{:,.2f}}', {v}) END"
    )


@query(
    "compact_numbers",
    f"SELECT l_orderkey, l_linenumber, {_shown('q', 10000, True)} AS tile, {_shown('q', 1000, False)} AS fact "
    "FROM (SELECT l_orderkey, l_linenumber, l_quantity * l_linenumber * 1024 * (l_orderkey % 7) + 0.25 AS q FROM lineitem)",
)
def compact_numbers(spark, sf):
    v = F.col("l_quantity") * F.col("l_linenumber") * 1024 * (F.col("l_orderkey") % 7) + 0.25
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", compact_number(v).alias("tile"), compact_number(v, 1_000, None).alias("fact")
    )


def _series_sql(source: str, moment: str, metrics: dict[str, str], frequency: str) -> str:
    parts = []
    for m, c in metrics.items():
        parts.append(
            f"(WITH s AS (SELECT {ENDS[frequency].format(moment)} AS period, sum({c}) AS total FROM {source} WHERE {moment} IS NOT NULL AND {c} IS NOT NULL GROUP BY 1), "
            f"spine AS ({SPINES[frequency]}) SELECT '{m}' AS metric, spine.period, round(cast(coalesce(total, 0) AS double), 2) AS total FROM spine LEFT JOIN s USING (period))"
        )
    return " UNION ALL ".join(parts)


@query("metric_series", f"WITH {PARSED_SQL} " + _series_sql("parsed", "moment", _AMOUNT, "ME"))
def metric_series(spark, sf):
    return dashboard.metric_series(dirty(spark, sf), ["revenue", "quantity"], "order_date").drop("bucket")


_GROUPED = (
    f"WITH {PARSED_SQL}, g AS (SELECT 'fulfilled' AS dimension, coalesce(fulfilled, '(missing)') AS category, sum(exact_amount) AS total FROM parsed GROUP BY 2 "
    "UNION ALL SELECT 'priority', coalesce(priority, '(missing)'), sum(exact_amount) FROM parsed GROUP BY 2) "
)


@query(
    "category_bars",
    _GROUPED + "SELECT * FROM (SELECT dimension, category, 'revenue' AS metric, round(cast(total AS double), 2) AS total, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, category) AS place FROM g) WHERE place <= 10",
)
def category_bars(spark, sf):
    return dashboard.bar_table(dirty(spark, sf), "revenue", ["fulfilled", "priority"])


@query(
    "category_shares",
    _GROUPED + "SELECT dimension, category, 'revenue' AS metric, round(cast(total AS double), 2) AS total, round(cast(total AS double) / cast(sum(total) OVER (PARTITION BY dimension) AS double) * 100, 2) AS share_pct FROM g",
)
def category_shares(spark, sf):
    return dashboard.share_table(dirty(spark, sf), "revenue", ["fulfilled", "priority"])


def _histogram_sql(source: str, c: str) -> str:
    return (
        f"WITH e AS (SELECT min({c}) AS lo, max({c}) AS hi, cast(least(30, greatest(8, floor(sqrt(count(*))))) AS int) AS n FROM {source}), "
        f"g AS (SELECT {c} AS v, lo, (hi - lo) / n AS w, n, cast(least(floor(({c} - lo) * (n / (hi - lo))), n - 1) AS int) AS k FROM {source}, e), "
        "b AS (SELECT CASE WHEN v < lo + k * w THEN k - 1 WHEN v >= lo + (k + 1) * w AND k < n - 1 THEN k + 1 ELSE k END AS bin, count(*) AS hits FROM g GROUP BY 1), "
        "spine AS (SELECT cast(unnest(generate_series(0, n - 1)) AS int) AS bin, lo, hi, n, (hi - lo) / n AS w FROM e) "
        f"SELECT '{c}' AS metric, bin, round(lo + bin * w, 2) AS low_edge, round(CASE WHEN bin = n - 1 THEN hi ELSE lo + (bin + 1) * w END, 2) AS high_edge, coalesce(hits, 0) AS count "
        "FROM spine LEFT JOIN b USING (bin)"
    )


@query("histogram", _histogram_sql("events", "value"))
def histogram(spark, sf):
    return dashboard.histogram_table(table(spark, sf, "events"), ["value"])


@query("histogram_two_metrics", f"SELECT * FROM ({_histogram_sql('lineitem', 'l_extendedprice')}) UNION ALL SELECT * FROM ({_histogram_sql('lineitem', 'l_quantity')})")
def histogram_two_metrics(spark, sf):
    return dashboard.histogram_table(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])


@query(
    "box_summary",
    "SELECT o_orderpriority AS category, round(min(o_totalprice), 2) AS min, round(quantile_cont(o_totalprice, 0.25), 2) AS q1, round(quantile_cont(o_totalprice, 0.5), 2) AS median, "
    "round(quantile_cont(o_totalprice, 0.75), 2) AS q3, round(max(o_totalprice), 2) AS max FROM orders GROUP BY 1 HAVING count(*) >= 5",
)
def box_summary(spark, sf):
    return dashboard.box_table(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


@query("option_dates", f"WITH {PARSED_SQL} SELECT cast(min(moment) AS date) AS date_from, cast(max(moment) AS date) AS date_to FROM parsed")
def option_dates(spark, sf):
    return dashboard.filter_options(dirty(spark, sf), "order_date", None)[0]


@query("option_values", "SELECT cast(user_id AS varchar) AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def option_values(spark, sf):
    return dashboard.filter_options(table(spark, sf, "events"), None, "user_id")[1]


@query(
    "dashboard_filters",
    f"WITH {PARSED_SQL} SELECT priority, count(*) AS rows FROM parsed WHERE moment >= timestamp '1996-03-01' AND moment < timestamp '1998-10-01' AND priority IN ('1-URGENT', '5-LOW') GROUP BY 1",
)
def dashboard_filters(spark, sf):
    chosen = dashboard.DashboardFilters("1996-03-01", "1998-09-30", ["1-URGENT", "5-LOW"])
    rows = dashboard.dashboard_rows(dirty(spark, sf), "order_date", "priority", chosen)
    return rows.groupBy("priority").agg(F.count("*").alias("rows"))


_SHOWN = {
    "kpis": "SELECT 'Records' AS label, count(*) AS value FROM parsed UNION ALL SELECT 'Total revenue', cast(sum(exact_amount) AS double) FROM parsed "
    "UNION ALL SELECT 'Total quantity', sum(quantity) FROM parsed",
    "dates": "SELECT edge, datediff('day', DATE '1970-01-01', cast(day AS date)) FROM (SELECT unnest(['date_from', 'date_to']) AS edge, unnest([min(moment), max(moment)]) AS day FROM parsed)",
    "options": "SELECT fulfilled, count(*) FROM parsed GROUP BY 1",
    "lines": f"SELECT metric || ' ' || period, total FROM ({_series_sql('parsed', 'moment', _AMOUNT, 'ME')})",
    "bars": "SELECT dimension || ' ' || category, round(cast(total AS double), 2) FROM g",
    "shares": "SELECT dimension || ' ' || category, round(cast(total AS double) / cast(sum(total) OVER (PARTITION BY dimension) AS double) * 100, 2) FROM g",
    "histograms": f"SELECT 'revenue ' || bin, count FROM ({_histogram_sql('(SELECT * FROM parsed WHERE amount IS NOT NULL)', 'amount')}) "
    f"UNION ALL SELECT 'quantity ' || bin, count FROM ({_histogram_sql('(SELECT * FROM parsed WHERE quantity IS NOT NULL)', 'quantity')})",
    "boxes": "SELECT fulfilled || ' ' || unnest(['min', 'q1', 'median', 'q3', 'max']), unnest(list_transform(quantile_cont(amount, [0, 0.25, 0.5, 0.75, 1]), lambda q: round(q, 2))) FROM parsed GROUP BY fulfilled",
    "correlations": "SELECT a || '~' || b, r FROM (SELECT unnest(['revenue', 'quantity', 'revenue', 'quantity']) AS a, unnest(['revenue', 'quantity', 'quantity', 'revenue']) AS b, "
    "unnest([1.0, 1.0, corr, corr]) AS r FROM (SELECT round(corr(amount, quantity), 3) AS corr FROM parsed))",
}


@query(
    "dashboard_build",
    _GROUPED + " UNION ALL ".join(f"SELECT '{part}' AS part, label, cast(value AS double) AS value FROM ({sql}) t(label, value)" for part, sql in _SHOWN.items()),
)
def dashboard_build(spark, sf):
    """All nine tables of the dashboard over all rows, as one."""
    frame = dirty(spark, sf)
    built = dashboard.build_dashboard(frame, profile_table(frame))
    days = built.date_options.select(F.inline(F.array(*[F.struct(F.lit(c).alias("edge"), F.datediff(c, F.lit("1970-01-01")).alias("day")) for c in ("date_from", "date_to")])))
    stats = ["min", "q1", "median", "q3", "max"]
    boxes = built.boxes.select("category", F.inline(F.array(*[F.struct(F.lit(m).alias("stat"), F.col(m).alias("value")) for m in stats])))
    shown = {
        "kpis": (built.kpis, ["label"], " ", "value"), "dates": (days, ["edge"], " ", "day"), "options": (built.category_options, ["value"], " ", "count"),
        "lines": (built.lines, ["metric", "period"], " ", "total"), "bars": (built.bars, ["dimension", "category"], " ", "total"),
        "shares": (built.shares, ["dimension", "category"], " ", "share_pct"), "histograms": (built.histograms, ["metric", "bin"], " ", "count"),
        "boxes": (boxes, ["category", "stat"], " ", "value"), "correlations": (built.correlations, ["column_a", "column_b"], "~", "r"),
    }
    parts = [
        rows.select(F.lit(part).alias("part"), F.concat_ws(mark, *[F.col(c).cast("string") for c in label]).alias("label"), F.col(value).cast("double").alias("value"))
        for part, (rows, label, mark, value) in shown.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "starter_plan_answers",
    f"WITH {PARSED_SQL} SELECT 'top_n' AS operation, fulfilled AS label, round(cast(sum(exact_amount) AS double), 2) AS value FROM parsed GROUP BY 2 "
    "UNION ALL SELECT 'aggregate', 'mean_revenue', round(cast(sum(exact_amount) AS double) / count(exact_amount), 2) FROM parsed "
    "UNION ALL SELECT 'correlate', 'revenue~quantity', round(corr(amount, quantity), 4) FROM parsed "
    f"UNION ALL SELECT 'trend', cast(period AS varchar), total FROM ({_series_sql('parsed', 'moment', {'revenue': _AMOUNT['revenue']}, 'ME')})",
)
def starter_plan_answers(spark, sf):
    frame = dirty(spark, sf)
    top, trend, correlate, average = starter_plans(profile_table(frame))
    answers = [
        run_plan(frame, top).rows.select(F.lit("top_n").alias("operation"), F.col("fulfilled").alias("label"), F.round("sum_revenue", 2).alias("value")),
        run_plan(frame, average).rows.select(F.lit("aggregate"), F.lit("mean_revenue"), F.round("mean_revenue", 2)),
        run_plan(frame, correlate).rows.select(F.lit("correlate"), F.concat_ws("~", "column_a", "column_b"), "pearson_r"),
    ]
    series = run_plan(frame, trend).rows
    answers.append(series.select(F.lit("trend"), F.col("period").cast("string"), F.round(trend.metrics[0].name, 2)))
    return reduce(DataFrame.union, answers)


# --- Calendar series ---------------------------------------------------------------


@query(
    "date_ranges",
    "SELECT cast(min(o_orderdate) AS date) AS date_from, cast(max(o_orderdate) AS date) AS date_to FROM orders",
)
def date_ranges(spark, sf):
    return date_range(table(spark, sf, "orders"), "o_orderdate")


_SPANS = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


@query(
    "frequency_choice",
    " UNION ALL ".join(
        f"SELECT '{t}' AS source, CASE WHEN d <= 62 THEN 'D' WHEN d <= 370 THEN 'W' ELSE 'ME' END AS frequency FROM (SELECT datediff('second', min({c}), max({c})) // 86400 AS d FROM {t})"
        for t, c in _SPANS.items()
    )
    + " UNION ALL SELECT 'one year', CASE WHEN d <= 62 THEN 'D' WHEN d <= 370 THEN 'W' ELSE 'ME' END FROM (SELECT datediff('day', min(o_orderdate), max(o_orderdate)) AS d FROM orders WHERE year(o_orderdate) = 1997)",
)
def frequency_choice(spark, sf):
    frames = {t: table(spark, sf, t).withColumnRenamed(c, "d") for t, c in _SPANS.items()}
    frames["one year"] = frames["orders"].where(F.year("d") == 1997)
    return small_frame(spark, [(n, choose_frequency(f, "d")) for n, f in frames.items()], "source string, frequency string")


@query("resample_week", _series_sql("orders", "o_orderdate", {"orders": "cast(o_totalprice AS decimal(18,2))"}, "W"))
def resample_week(spark, sf):
    series = resample(table(spark, sf, "orders"), "o_orderdate", "W", {"total": F.sum("o_totalprice")})
    return series.select(F.lit("orders").alias("metric"), "period", F.round("total", 2).alias("total"))


@query(
    "edge_trim",
    "WITH s AS (SELECT last_day(cast(o_orderdate AS date)) AS period, sum(cast(o_totalprice AS decimal(18,2))) AS total FROM orders GROUP BY 1), "
    "b AS (SELECT cast(min(o_orderdate) AS date) AS a, cast(max(o_orderdate) AS date) AS z FROM orders) "
    "SELECT period, round(cast(total AS double), 2) AS total FROM s, b WHERE NOT (period = (SELECT max(period) FROM s) AND z < period) "
    "AND NOT (period = (SELECT min(period) FROM s) AND a > date_trunc('month', period))",
)
def edge_trim(spark, sf):
    orders = table(spark, sf, "orders")
    series = resample(
        orders, "o_orderdate", "ME",
        {"total": F.sum("o_totalprice"), "_a": F.min("o_orderdate").cast("date"), "_z": F.max("o_orderdate").cast("date")},
        zero=["total"],
    )
    bounds = series.agg(F.min("_a").alias("first"), F.max("_z").alias("last")).first()
    placed = series.drop("_a", "_z").withColumns({"one": F.lit(1), "first": F.lit(bounds[0]), "last": F.lit(bounds[1])})
    return trim_edges(placed, "ME", "first", "last", ["one"]).select("period", F.round("total", 2).alias("total"))


def _growth_sql(source: str, key: str, total: str = "total") -> str:
    return (
        f"p AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY period) AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source}), "
        f"h AS (SELECT {key}, max(n) AS buckets, cast(sum({total}) FILTER (i <= n // 2) AS double) AS a, cast(sum({total}) FILTER (i > n // 2) AS double) AS b, "
        f"arg_max(period, ({total}, -i)) AS best_period, round(cast(max({total}) AS double), 2) AS best_value, arg_min(period, ({total}, i)) AS worst_period, round(cast(min({total}) AS double), 2) AS worst_value FROM p GROUP BY 1) "
    )


@query(
    "half_growth",
    "WITH s AS (SELECT event_type, cast(ts AS date) AS period, sum(cast(value AS decimal(18,2))) AS total FROM events GROUP BY 1, 2), "
    "c AS (SELECT event_type, cast(unnest(generate_series(min(period)::timestamp, max(period)::timestamp, interval 1 day)) AS date) AS period FROM s GROUP BY 1), "
    "f AS (SELECT c.event_type, c.period, coalesce(total, 0) AS total FROM c LEFT JOIN s USING (event_type, period)), "
    + _growth_sql("f", "event_type")
    + "SELECT event_type, buckets, round((b - a) / abs(a) * 100, 1) AS growth_pct, best_period, best_value, worst_period, worst_value FROM h WHERE buckets >= 4",
)
def growth(spark, sf):
    events = table(spark, sf, "events")
    series = resample(events, "ts", "D", {"total": F.sum(F.col("value").cast("decimal(18,2)"))}, ["event_type"])
    return half_growth(series, "total", ["event_type"])


# --- Facts ---------------------------------------------------------------------------


@query(
    "metric_facts",
    f"WITH {PARSED_SQL}, s AS ({_series_sql('parsed', 'moment', _AMOUNT, 'ME')}), " + _growth_sql("s", "metric")
    + ", t AS (SELECT 'revenue' AS metric, round(cast(sum(exact_amount) AS double), 2) AS total, round(cast(sum(exact_amount) AS double) / count(amount), 2) AS mean FROM parsed "
    "UNION ALL SELECT 'quantity', round(sum(quantity), 2), round(sum(quantity) / count(quantity), 2) FROM parsed) "
    "SELECT t.metric, t.total, t.mean, round((b - a) / abs(a) * 100, 1) AS growth_pct, best_period, best_value, worst_period, worst_value FROM t JOIN h USING (metric)",
)
def metric_facts(spark, sf):
    return facts.metric_facts(dirty(spark, sf), ["revenue", "quantity"], "order_date")


@query(
    "segment_facts",
    _GROUPED.rstrip() + ", r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, category) AS k, count(*) OVER (PARTITION BY dimension) AS n, "
    "cast(sum(total) OVER (PARTITION BY dimension) AS double) AS whole FROM g) "
    "SELECT dimension, 'revenue' AS metric, max(category) FILTER (k = 1) AS top_name, round(cast(max(total) FILTER (k = 1) AS double), 2) AS top_value, "
    "round(cast(max(total) FILTER (k = 1) AS double) / max(whole) * 100, 1) AS top_share_pct, max(category) FILTER (k = n) AS bottom_name, "
    "round(cast(max(total) FILTER (k = n) AS double), 2) AS bottom_value, max(n) AS segments_count FROM r GROUP BY 1 HAVING max(n) >= 2",
)
def segment_facts(spark, sf):
    return facts.segment_facts(dirty(spark, sf), "revenue", ["fulfilled", "priority", "currency"])


@query(
    "anomaly_facts",
    PROFILE_SQL + "SELECT name AS \"column\", hits AS outlier_count, round(hits / total * 100, 2) AS outlier_pct, "
    "(SELECT max(quantity) FROM dirty) AS example_high, (SELECT min(quantity) FROM dirty) AS example_low FROM outliers JOIN typed USING (name) WHERE hits > 0 AND semantic_type = 'numeric'",
)
def anomaly_facts(spark, sf):
    frame = dirty(spark, sf)
    return facts.anomaly_facts(frame, profile_table(frame))


@query(
    "data_notes",
    TYPES_SQL + "SELECT 'missing' AS note, name AS \"column\", total - present AS rows, round(round((total - present) / total * 100, 2), 1) AS pct FROM typed WHERE round((total - present) / total * 100, 2) > 5 "
    "UNION ALL SELECT 'duplicates', NULL, n, NULL FROM (SELECT (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS n) WHERE n > 0",
)
def data_notes(spark, sf):
    frame = dirty(spark, sf)
    return facts.data_notes(frame, profile_table(frame))


@query(
    "fact_overview",
    f"WITH {PARSED_SQL} SELECT count(*) AS row_count, 'order_date' AS date_column, cast(min(moment) AS date) AS date_from, cast(max(moment) AS date) AS date_to FROM parsed",
)
def fact_overview(spark, sf):
    frame = dirty(spark, sf)
    found = facts.extract_facts(frame, profile_table(frame))
    return found.dates.select(
        F.lit(found.overview["row_count"]).cast("bigint").alias("row_count"), F.lit(found.overview["date_column"]).alias("date_column"), "date_from", "date_to"
    )


# --- Ledger ----------------------------------------------------------------------------

# Words stand in for tokens; models and projects are spread over the conversations.
USAGE_SQL = """
WITH usage AS (
  SELECT conv_id, turn, concat('p', cast(conv_id % 10 AS varchar)) AS project_id,
    CASE conv_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'gpt-4.1' WHEN 3 THEN 'llama-3.1-8b-instant' ELSE 'unlisted' END AS model,
    CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS prompt_tokens, CASE WHEN role = 'user' THEN 0 ELSE length(text) END AS completion_tokens
  FROM {conversations})
"""
_PRICED = (
    USAGE_SQL.format(conversations="conversations")
    + ", prices(model, i, o) AS (VALUES ('gpt-4o-mini', 0.15, 0.60), ('gpt-4o', 2.50, 10.00), ('gpt-4.1-mini', 0.40, 1.60), ('gpt-4.1', 2.00, 8.00), ('llama-3.3-70b-versatile', 0.59, 0.79), ('llama-3.1-8b-instant', 0.05, 0.08)), "
    "costs AS (SELECT usage.*, cast(round((prompt_tokens * coalesce(i, 2.5)::decimal(10,4) + completion_tokens * coalesce(o, 10)::decimal(10,4)) * 0.000001::decimal(6,6), 6) AS double) AS cost_usd FROM usage LEFT JOIN prices USING (model)) "
)


def _costs(spark, sf):
    sql = USAGE_SQL.replace("{conversations}", "{source}") + " SELECT * FROM usage"
    return ledger.with_cost(spark.sql(sql.replace("varchar", "string"), source=table(spark, sf, "conversations")))


@query("usage_costs", _PRICED + "SELECT conv_id, turn, model, cost_usd FROM costs")
def usage_costs(spark, sf):
    return _costs(spark, sf).select("conv_id", "turn", "model", "cost_usd")


@query(
    "budget_rollup",
    _PRICED + "SELECT project_id, count(*) AS calls, cast(sum(cast(cost_usd AS decimal(18,6))) AS double) AS spent_usd, sum(cast(cost_usd AS decimal(18,6))) >= 0.05 AS budget_exhausted FROM costs GROUP BY 1",
)
def budget_rollup(spark, sf):
    return ledger.budget_rollup(_costs(spark, sf), 0.05)


@query(
    "storage_rollup",
    "SELECT c_nationkey AS owner_id, cast(sum(cast(floor(o_totalprice) AS bigint)) AS bigint) AS total_bytes FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY 1",
)
def storage_rollup(spark, sf):
    versions = table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.floor("o_totalprice").alias("size_bytes"))
    projects = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("owner_id"),
        F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01")).alias("deleted_at"),
    )
    return ledger.storage_rollup(versions, projects)


@query(
    "newest_first",
    "SELECT o_orderkey AS project_id, cast(o_orderdate AS date) AS created_on FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey",
)
def newest_first(spark, sf):
    """All live projects of one owner, latest first."""
    projects = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.col("o_orderpriority").alias("owner_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"),
    )
    return ledger.newest_first(projects, "1-URGENT").select("project_id", F.col("created_at").cast("date").alias("created_on"))
