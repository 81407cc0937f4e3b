"""Query-plan language: aggregates, filters, trends, comparisons, descriptions."""

from checks.registry import PARSED_SQL, dirty, query, table
from quillgrid.plans.model import Filter, Metric, QueryPlan
from quillgrid.plans.run import run_plan

MONEY = "cast({} AS decimal(18,2))"


def _sum(c: str) -> str:
    return f"round(cast(coalesce(sum({MONEY.format(c)}), 0) AS double), 4)"


def _mean(c: str) -> str:
    return f"round(cast(sum({MONEY.format(c)}) AS double) / count({c}), 4)"


AGGREGATES = {
    "sum": _sum,
    "mean": _mean,
    "median": lambda c: f"round(quantile_cont({c}, 0.5), 4)",
    "min": lambda c: f"round(min({c}), 4)",
    "max": lambda c: f"round(max({c}), 4)",
    "count": lambda c: f"count({c})",
    "nunique": lambda c: f"count(DISTINCT {c})",
}
ALL_METRICS = [Metric("o_totalprice", a) for a in AGGREGATES]
ALL_SQL = ", ".join(f"{f('o_totalprice')} AS {a}_o_totalprice" for a, f in AGGREGATES.items())


def _run(spark, sf, source, plan, part="rows"):
    frame = dirty(spark, sf) if source == "dirty" else table(spark, sf, source)
    return getattr(run_plan(frame, plan), part)


def _plan(name, sql, source, plan, part="rows"):
    query(name, sql)(lambda spark, sf: _run(spark, sf, source, plan, part))


_plan("aggregate_global", f"SELECT {ALL_SQL} FROM orders", "orders", QueryPlan("aggregate", ALL_METRICS))
_plan(
    "aggregate_by_key",
    f"SELECT o_orderpriority, {ALL_SQL} FROM orders GROUP BY 1",
    "orders",
    QueryPlan("aggregate", ALL_METRICS, group_by=["o_orderpriority"]),
)
_plan(
    "aggregate_two_keys",
    f"SELECT o_orderpriority, o_orderstatus, {ALL_SQL} FROM orders GROUP BY 1, 2",
    "orders",
    QueryPlan("aggregate", ALL_METRICS, group_by=["o_orderpriority", "o_orderstatus"]),
)
_plan(
    "aggregate_by_date",
    f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, {_sum('o_totalprice')} AS sum_o_totalprice, "
    "count(o_orderkey) AS count_o_orderkey FROM orders GROUP BY 1",
    "orders",
    QueryPlan("aggregate", [Metric("o_totalprice"), Metric("o_orderkey", "count")], group_by=["o_orderdate"]),
)
_plan(
    "aggregate_missing_group",
    f"WITH {PARSED_SQL} SELECT coalesce(priority, '(missing)') AS priority, count(order_id) AS count_order_id, "
    "round(cast(sum(exact_amount) AS double), 4) AS sum_revenue, coalesce(sum(quantity), 0) AS sum_quantity, "
    "count(DISTINCT currency) AS nunique_currency FROM parsed GROUP BY 1",
    "dirty",
    QueryPlan(
        "aggregate",
        [Metric("order_id", "count"), Metric("revenue"), Metric("quantity"), Metric("currency", "nunique")],
        group_by=["priority"],
    ),
)
_plan(
    "top_customers",
    f"SELECT cast(o_custkey AS varchar) AS o_custkey, {_sum('o_totalprice')} AS sum_o_totalprice, "
    "count(o_orderkey) AS count_o_orderkey FROM orders GROUP BY 1 "
    "ORDER BY sum_o_totalprice DESC, o_custkey LIMIT 10",
    "orders",
    QueryPlan("top_n", [Metric("o_totalprice"), Metric("o_orderkey", "count")], group_by=["o_custkey"]),
)
_plan(
    "bottom_customers",
    f"SELECT cast(o_custkey AS varchar) AS o_custkey, {_mean('o_totalprice')} AS mean_o_totalprice "
    "FROM orders GROUP BY 1 ORDER BY mean_o_totalprice, o_custkey LIMIT 25",
    "orders",
    QueryPlan("top_n", [Metric("o_totalprice", "mean")], group_by=["o_custkey"], sort_desc=False, limit=25),
)
_plan(
    "top_groups_summary",
    "SELECT count(*) AS groups, least(count(*), 10) AS rows_returned FROM (SELECT DISTINCT o_custkey FROM orders)",
    "orders",
    QueryPlan("top_n", [Metric("o_totalprice")], group_by=["o_custkey"]),
    "summary",
)
for _agg, _sql in AGGREGATES.items():
    _c = "l_partkey" if _agg == "nunique" else "l_extendedprice"
    _plan(
        f"aggregate_{_agg}",
        f"SELECT l_returnflag, l_linestatus, {_sql(_c)} AS {_agg}_{_c} FROM lineitem GROUP BY 1, 2",
        "lineitem",
        QueryPlan("aggregate", [Metric(_c, _agg)], group_by=["l_returnflag", "l_linestatus"]),
    )

# --- Filters -----------------------------------------------------------------

_FILTERS = {
    "eq_number": ("orders", [Filter("o_custkey", "eq", 7)], "o_custkey = 7"),
    "eq_text": ("orders", [Filter("o_orderstatus", "eq", "F")], "o_orderstatus = 'F'"),
    "eq_number_as_text": ("orders", [Filter("o_custkey", "eq", "7")], "o_custkey = 7"),
    "ne_number": ("orders", [Filter("o_custkey", "ne", 7)], "o_custkey <> 7"),
    "ne_text": ("orders", [Filter("o_orderpriority", "ne", "5-LOW")], "o_orderpriority <> '5-LOW'"),
    "gt": ("orders", [Filter("o_totalprice", "gt", 250000)], "o_totalprice > 250000"),
    "gte": ("orders", [Filter("o_totalprice", "gte", "250000.5")], "o_totalprice >= 250000.5"),
    "lt": ("orders", [Filter("o_totalprice", "lt", 99999.99)], "o_totalprice < 99999.99"),
    "lte": ("orders", [Filter("o_custkey", "lte", 100)], "o_custkey <= 100"),
    "date_gte": ("orders", [Filter("o_orderdate", "gte", "1998-01-01")], "o_orderdate >= timestamp '1998-01-01'"),
    "eq_date": ("orders", [Filter("o_orderdate", "eq", "1997-01-15")], "cast(o_orderdate AS date) = date '1997-01-15'"),
    "ne_date": ("orders", [Filter("o_orderdate", "ne", "1997-01-15")], "cast(o_orderdate AS date) <> date '1997-01-15'"),
    "in_date": ("orders", [Filter("o_orderdate", "in", ["1997-01-15", "1998-02-03", "no date"])], "cast(o_orderdate AS date) IN (date '1997-01-15', date '1998-02-03')"),
    "in_text": ("orders", [Filter("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])], "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "in_numbers_as_text": ("orders", [Filter("o_custkey", "in", ["1", 2, "3.0"])], "cast(o_custkey AS varchar) IN ('1', '2', '3.0')"),
    "between": ("orders", [Filter("o_totalprice", "between", [100000, 200000])], "o_totalprice BETWEEN 100000 AND 200000"),
    "between_dates": ("orders", [Filter("o_orderdate", "between", ["1996-01-01", "1996-12-31"])], "o_orderdate BETWEEN timestamp '1996-01-01' AND timestamp '1996-12-31'"),
    "contains": ("orders", [Filter("o_orderpriority", "contains", "ur.ent|low")], "regexp_matches(o_orderpriority, '(?i)ur.ent|low')"),
    "chain": (
        "orders",
        [Filter("o_totalprice", "gt", 50000), Filter("o_orderstatus", "in", ["O", "P"]), Filter("o_orderdate", "lt", "2000-01-01")],
        "o_totalprice > 50000 AND o_orderstatus IN ('O', 'P') AND o_orderdate < timestamp '2000-01-01'",
    ),
}
for _name, (_source, _tests, _where) in _FILTERS.items():
    _plan(
        f"filter_{_name}",
        f"SELECT count(o_orderkey) AS count_o_orderkey, {_sum('o_totalprice')} AS sum_o_totalprice FROM orders WHERE {_where}",
        _source,
        QueryPlan("aggregate", [Metric("o_orderkey", "count"), Metric("o_totalprice")], filters=_tests),
    )

_DIRTY_FILTERS = {
    "ne_number_keeps_missing": ([Filter("quantity", "ne", 5)], "quantity <> 5 OR quantity IS NULL"),
    "ne_text_drops_missing": ([Filter("priority", "ne", "5-LOW")], "priority <> '5-LOW'"),
    "gt_text_number": ([Filter("revenue", "gt", 400000)], "amount > 400000"),
    "date_text": ([Filter("order_date", "lt", "1997-06-15")], "moment < timestamp '1997-06-15'"),
    "between_text_dates": ([Filter("order_date", "between", ["1997-01-01", "1997-03-31"])], "moment BETWEEN timestamp '1997-01-01' AND timestamp '1997-03-31'"),
    "contains_missing_is_false": ([Filter("priority", "contains", "high")], "regexp_matches(priority, '(?i)high')"),
    "in_float_as_text": ([Filter("quantity", "in", ["1.0", "2", "3.0"])], "quantity IN (1, 3)"),
    "contains_literal": ([Filter("revenue", "contains", "$1", True)], "contains(revenue, '$1')"),
}
for _name, (_tests, _where) in _DIRTY_FILTERS.items():
    _plan(
        f"filter_{_name}",
        f"WITH {PARSED_SQL} SELECT count(order_id) AS count_order_id, "
        f"round(cast(coalesce(sum(exact_amount), 0) AS double), 4) AS sum_revenue FROM parsed WHERE {_where}",
        "dirty",
        QueryPlan("aggregate", [Metric("order_id", "count"), Metric("revenue")], filters=_tests),
    )
_plan(
    "filter_rows_matching",
    "SELECT count(*) AS matching_rows FROM events WHERE event_type = 'click' AND value >= 50",
    "events",
    QueryPlan("filter_rows", filters=[Filter("event_type", "eq", "click"), Filter("value", "gte", 50)]),
    "summary",
)
_plan(
    "filter_rows_all",
    "SELECT * FROM customer WHERE regexp_matches(c_mktsegment, '(?i)^build')",
    "customer",
    QueryPlan("filter_rows", filters=[Filter("c_mktsegment", "contains", "^build")]),
)
_plan(
    "filter_rows_sample",
    "SELECT * FROM customer WHERE regexp_matches(c_mktsegment, '(?i)^build') ORDER BY c_custkey LIMIT 20",
    "customer",
    QueryPlan("filter_rows", filters=[Filter("c_mktsegment", "contains", "^build")], limit=20),
)

# --- Describe and correlate ----------------------------------------------------

_NONE = "cast(NULL AS double)"


def _described_number(source: str, name: str, c: str) -> str:
    return (
        f"SELECT '{name}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, "
        f"round(quantile_cont({c}, 0.5), 4) AS median, round(cast(min({c}) AS double), 4) AS min, "
        f"round(cast(max({c}) AS double), 4) AS max, cast(NULL AS bigint) AS \"unique\", cast(NULL AS varchar) AS top FROM {source}"
    )


def _described_text(source: str, name: str) -> str:
    return (
        f"SELECT '{name}', count({name}), {_NONE}, {_NONE}, {_NONE}, {_NONE}, count(DISTINCT {name}), "
        f"(SELECT {name} FROM {source} WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM {source}"
    )


_plan(
    "describe",
    " UNION ALL ".join(
        [
            *[_described_number("lineitem", c, c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey")],
            *[_described_text("lineitem", c) for c in ("l_returnflag", "l_linestatus")],
        ]
    ),
    "lineitem",
    QueryPlan("describe", columns=["l_quantity", "l_extendedprice", "l_discount", "l_orderkey", "l_returnflag", "l_linestatus"]),
)
_plan(
    "describe_text_numbers",
    f"WITH {PARSED_SQL} "
    + " UNION ALL ".join(
        [
            _described_number("parsed", "revenue", "amount"),
            _described_number("parsed", "quantity", "quantity"),
            _described_text("parsed", "priority"),
            _described_text("parsed", "fulfilled"),
        ]
    ),
    "dirty",
    QueryPlan("describe", columns=["revenue", "quantity", "priority", "fulfilled"]),
)
_plan(
    "correlate",
    "SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, round(corr(l_quantity, l_extendedprice), 4) AS pearson_r FROM lineitem",
    "lineitem",
    QueryPlan("correlate", columns=["l_quantity", "l_extendedprice"]),
)
_plan(
    "correlate_missing_pairs",
    f"WITH {PARSED_SQL} SELECT round(corr(amount, quantity), 4) AS pearson_r, count(*) AS n FROM parsed "
    "WHERE amount IS NOT NULL AND quantity IS NOT NULL",
    "dirty",
    QueryPlan("correlate", columns=["revenue", "quantity"]),
    "summary",
)

# --- Trend and period comparison -----------------------------------------------

ENDS = {
    "D": "cast({} AS date)",
    "W": "cast(date_trunc('week', {}) + interval 6 day AS date)",
    "ME": "last_day(cast({} AS date))",
}
SPINES = {
    "D": "SELECT cast(unnest(generate_series(min(period)::timestamp, max(period)::timestamp, interval 1 day)) AS date) AS period FROM s",
    "W": "SELECT cast(unnest(generate_series(min(period)::timestamp, max(period)::timestamp, interval 7 day)) AS date) AS period FROM s",
    "ME": "SELECT last_day(cast(unnest(generate_series(date_trunc('month', min(period)), date_trunc('month', max(period)), interval 1 month)) AS date)) AS period FROM s",
}


def trend_sql(source, moment, frequency, measure, name, zero, where="true"):
    filled = f"coalesce(s.{name}, 0)" if zero else f"s.{name}"
    return (
        f"WITH s AS (SELECT {ENDS[frequency].format(moment)} AS period, {measure} AS {name} FROM {source} WHERE {where} GROUP BY 1), "
        f"spine AS ({SPINES[frequency]}) "
        f"SELECT spine.period, {filled} AS {name} FROM spine LEFT JOIN s USING (period) ORDER BY 1"
    )


_plan("trend_day", trend_sql("events", "ts", "D", _sum("value"), "sum_value", True), "events",
      QueryPlan("trend", [Metric("value")], date_column="ts"))
_plan("trend_week", trend_sql("orders", "o_orderdate", "W", _sum("o_totalprice"), "sum_o_totalprice", True, "o_orderdate BETWEEN timestamp '1997-01-01' AND timestamp '1997-12-31'"), "orders",
      QueryPlan("trend", [Metric("o_totalprice")], date_column="o_orderdate", filters=[Filter("o_orderdate", "between", ["1997-01-01", "1997-12-31"])]))
_plan("trend_month", trend_sql("orders", "o_orderdate", "ME", _sum("o_totalprice"), "sum_o_totalprice", True), "orders",
      QueryPlan("trend", [Metric("o_totalprice")], date_column="o_orderdate"))
for _agg, _zero in (("sum", True), ("mean", False), ("median", False), ("min", False), ("max", False), ("count", True), ("nunique", True)):
    _c = "o_custkey" if _agg == "nunique" else "o_totalprice"
    _plan(
        f"trend_gaps_{_agg}",
        trend_sql("orders", "o_orderdate", "D", AGGREGATES[_agg](_c), f"{_agg}_{_c}", _zero),
        "orders",
        QueryPlan("trend", [Metric(_c, _agg)], date_column="o_orderdate", frequency="D"),
    )
_plan("trend_text_dates", f"WITH {PARSED_SQL}, " + trend_sql("parsed", "moment", "ME", "round(cast(sum(exact_amount) AS double), 4)", "sum_revenue", True, "moment IS NOT NULL").removeprefix("WITH "), "dirty",
      QueryPlan("trend", [Metric("revenue")], date_column="order_date"))

_A, _B = ["1996-01-01", "1996-12-31"], ["1997-01-01", "1997-12-31"]


def _periods_sql(measure, summary=False):
    def inside(first, last):
        return f"o_orderdate >= timestamp '{first}' AND o_orderdate < timestamp '{last}' + interval 1 day"

    a, b = (f"(SELECT coalesce(cast({measure} AS double), 0) FROM orders WHERE {inside(*p)})" for p in (_A, _B))
    if summary:
        return f"SELECT round(({b} - {a}) / abs({a}) * 100, 2) AS delta_pct"
    return a, b


for _agg in ("sum", "mean", "median", "count", "min", "max", "nunique"):
    _measure = {"sum": "sum(cast(o_totalprice AS decimal(18,2)))", "mean": "sum(cast(o_totalprice AS decimal(18,2)))::double / count(*)",
                "median": "quantile_cont(o_totalprice, 0.5)", "count": "count(*)", "min": "min(o_totalprice)", "max": "max(o_totalprice)",
                "nunique": "count(DISTINCT o_totalprice)"}[_agg]
    _a, _b = _periods_sql(_measure)
    _name = f"{_agg}_o_totalprice"
    _plan(
        f"compare_periods_{_agg}",
        f"SELECT '1996-01-01 → 1996-12-31' AS period, round({_a}, 2) AS {_name} UNION ALL SELECT '1997-01-01 → 1997-12-31', round({_b}, 2)",
        "orders",
        QueryPlan("compare_periods", [Metric("o_totalprice", _agg)], date_column="o_orderdate", period_a=_A, period_b=_B),
    )
_plan(
    "compare_periods_delta",
    _periods_sql("sum(cast(o_totalprice AS decimal(18,2)))", True),
    "orders",
    QueryPlan("compare_periods", [Metric("o_totalprice")], date_column="o_orderdate", period_a=_A, period_b=_B),
    "summary",
)
