"""Run a query plan as one lazy DataFrame."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.errors import PlanError
from quillgrid.functions.parsing import (
    column,
    label_of,
    moment_of,
    number_of,
    present,
    text_of,
)
from quillgrid.operators.moments import mean, pearson, steady_mean, steady_total, total
from quillgrid.operators.quantiles import column_quantiles, grouped_quantiles
from quillgrid.operators.small import half_up, small_frame
from quillgrid.operators.timeseries import (
    bucket_end,
    choose_frequency,
    compare_values,
    fill_gaps,
    in_period,
    period_values,
)
from quillgrid.plans.filters import apply_filters
from quillgrid.plans.model import MIN_PAIRS, TOP_ROWS, Metric, PlanResult, QueryPlan

# One expression per aggregate; the median has its own path.
AGGREGATE_FUNCTIONS = {
    "sum": total,
    "mean": mean,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
}
# Fixed-size sketches in place of the two aggregates that must see every value.
APPROXIMATE_FUNCTIONS = AGGREGATE_FUNCTIONS | {
    "nunique": F.approx_count_distinct,
    "median": lambda c: F.percentile_approx(c.cast("double"), 0.5),
}
# For doubles: the same sums on every run, however the rows are partitioned.
STEADY_FUNCTIONS = {"sum": steady_total, "mean": steady_mean}
_ON_STORED = ("count", "nunique")  # the others work on the parsed number


def _functions(dtype: T.DataType, approximate: bool = False) -> dict:
    functions = APPROXIMATE_FUNCTIONS if approximate else AGGREGATE_FUNCTIONS
    return functions | STEADY_FUNCTIONS if isinstance(dtype, (T.FloatType, T.DoubleType)) else functions


def _input(frame: DataFrame, m: Metric) -> Column:
    return present(frame, m.column) if m.agg in _ON_STORED else number_of(frame, m.column)


def _tidy(frame: DataFrame) -> DataFrame:
    """Result cells: doubles to four decimals, moments to dates."""
    cells = []
    for f in frame.schema.fields:
        c = column(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 4)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c, 4).cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date")
        cells.append(c.alias(f.name))
    return frame.select(*cells)


def run_plan(frame: DataFrame, plan: QueryPlan, approximate: bool = False) -> PlanResult:
    """Rows and summary of a plan. `approximate` trades exact medians and distinct
    counts of aggregates and trends for sketches of fixed size."""
    plan.check(frame.columns)
    rows = apply_filters(frame, plan.filters)
    runner = {
        "aggregate": _aggregate, "top_n": _aggregate, "trend": _trend,
        "compare_periods": _compare, "describe": _describe, "correlate": _correlate,
        "filter_rows": _filter_rows,
    }[plan.operation]
    if runner in (_aggregate, _trend):
        return runner(rows, plan, approximate)
    return runner(rows, plan)


def _metrics(frame: DataFrame, plan_metrics, keys: list[str], approximate: bool) -> DataFrame:
    """Metrics per group of `keys`; `frame` holds the keys and inputs v0, v1, ..."""
    functions = [_functions(frame.schema[f"v{i}"].dataType, approximate) for i in range(len(plan_metrics))]
    medians = [i for i, m in enumerate(plan_metrics) if m.agg not in functions[i]]
    plain = [functions[i][m.agg](F.col(f"v{i}")).alias(f"m{i}") for i, m in enumerate(plan_metrics) if i not in medians]
    result = frame.groupBy(*keys).agg(*(plain or [F.count("*").alias("_rows")]))
    for i in medians:
        if keys:
            part = grouped_quantiles(frame, keys, f"v{i}", [0.5]).select(
                *keys, F.col("quantiles")[0].alias(f"m{i}")
            )
            result = result.join(part, keys, "left")
        else:
            middle = column_quantiles(frame, {"v": F.col(f"v{i}")}, [0.5])["v"][0]
            result = result.withColumn(f"m{i}", F.lit(middle).cast("double"))
    return result.select(*keys, *[F.col(f"m{i}").alias(m.name) for i, m in enumerate(plan_metrics)])


def _aggregate(frame: DataFrame, plan: QueryPlan, approximate: bool) -> PlanResult:
    metrics = list(dict.fromkeys(plan.metrics))
    inputs = [_input(frame, m).alias(f"v{i}") for i, m in enumerate(metrics)]
    if not plan.group_by:
        return PlanResult(_tidy(_metrics(frame.select(*inputs), metrics, [], approximate)))
    keys = [f"k{i}" for i in range(len(plan.group_by))]
    labels = [label_of(frame, g).alias(k) for k, g in zip(keys, plan.group_by)]
    groups = _metrics(frame.select(*labels, *inputs), metrics, keys, approximate)
    first = column(metrics[0].name)
    order = first.desc_nulls_last() if plan.sort_desc else first.asc_nulls_last()
    limit = plan.limit or (TOP_ROWS if plan.operation == "top_n" else None)
    ordered = groups.orderBy(order, *keys)
    named = (ordered.limit(limit) if limit else ordered).withColumnsRenamed(dict(zip(keys, plan.group_by)))
    found = F.count("*")
    returned = F.least(found, F.lit(limit)) if limit else found
    counted = groups.agg(found.alias("groups"), returned.alias("rows_returned"))
    return PlanResult(_tidy(named), counted)


def _trend(frame: DataFrame, plan: QueryPlan, approximate: bool) -> PlanResult:
    m = plan.metrics[0]
    value = present(frame, m.column) if m.agg == "count" else number_of(frame, m.column)
    rows = frame.select(moment_of(frame, plan.date_column).alias("d"), value.alias("v0"))
    rows = rows.where("d is not null")
    found = choose_frequency(rows, "d")
    if found is None:
        raise PlanError("no usable dates for trend")
    frequency = plan.frequency or found
    bucketed = rows.select(bucket_end(F.col("d"), frequency).alias("period"), "v0")
    series = _metrics(bucketed, [m], ["period"], approximate)
    zero = [m.name] if m.agg in ("sum", "count", "nunique") else []
    filled = fill_gaps(series, frequency, zero=zero)
    summary = small_frame(frame.sparkSession, [(frequency,)], "frequency string")
    return PlanResult(_tidy(filled.orderBy("period")), summary, {"frequency": frequency})


def _compare(frame: DataFrame, plan: QueryPlan) -> PlanResult:
    m = plan.metrics[0]
    moment, value = moment_of(frame, plan.date_column), number_of(frame, m.column)
    periods = (plan.period_a, plan.period_b)
    if m.agg == "median":
        parts = frame.select(moment.alias("d"), value.alias("v"))
        middles = [
            column_quantiles(parts.where(in_period(F.col("d"), *p)), {"v": F.col("v")}, [0.5])["v"][0]
            for p in periods
        ]
        values = small_frame(frame.sparkSession, [[x or 0.0 for x in middles]], "a double, b double")
    else:
        aggregate = _functions(frame.select(value.alias("v")).schema["v"].dataType)[m.agg]
        values = period_values(frame, moment, aggregate, value, *periods, m.agg == "count")
    both = compare_values(values)
    names = [" → ".join(p) for p in periods]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("period"), F.col(v).alias(m.name))
            for n, v in zip(names, ("value_a", "value_b"))
        ]
    )
    return PlanResult(both.select(F.inline(cells)), both.select("delta_pct"))


def _describe(frame: DataFrame, plan: QueryPlan) -> PlanResult:
    names = list(dict.fromkeys(plan.columns or [m.column for m in plan.metrics]))
    numbers = {n: number_of(frame, n) for n in names}
    measures = []
    for n in names:
        c = numbers[n]
        measures += [F.count(c), mean(c), F.min(c).cast("double"), F.max(c).cast("double"), F.count(present(frame, n))]
    row = frame.agg(*measures).first()
    facts = {n: row[5 * k : 5 * k + 5] for k, n in enumerate(names)}
    numeric = [n for n in names if facts[n][0]]
    medians = column_quantiles(frame, {n: numbers[n] for n in numeric}, [0.5])
    texts = [n for n in names if n not in numeric]
    tops = _text_facts(frame, texts) if texts else {}
    rows = []
    for n in names:
        count, average, low, high, stored = facts[n]
        if n in medians:
            cells = [half_up(x, 4) for x in (average, medians[n][0], low, high)]
            rows.append((n, count, *cells, None, None))
        else:
            rows.append((n, stored, None, None, None, None, *tops.get(n, (0, None))))
    return PlanResult(
        small_frame(
            frame.sparkSession, rows,
            "`column` string, count bigint, mean double, median double, min double, max double, "
            "unique bigint, top string",
        )
    )


def _text_facts(frame: DataFrame, names: list[str]) -> dict[str, tuple[int, str]]:
    """How many different values each column has, and the most frequent one: one count of (column, value) for all."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), text_of(frame, n).alias("v")) for i, n in enumerate(names)])
    counted = frame.select(F.inline(cells)).where("v is not null").groupBy("c", "v").agg((-F.count("*")).alias("fewer"))
    found = counted.groupBy("c").agg(F.count("*").alias("distinct"), F.min(F.struct("fewer", "v")).alias("top")).collect()
    return {names[r["c"]]: (r["distinct"], r["top"]["v"]) for r in found}


def _correlate(frame: DataFrame, plan: QueryPlan) -> PlanResult:
    a, b = (number_of(frame, c) for c in plan.columns)
    both = frame.select(a.alias("a"), b.alias("b")).dropna()
    r, n = both.agg(pearson(F.col("a"), F.col("b")), F.count("*")).first()
    if n < MIN_PAIRS:
        raise PlanError("not enough overlapping numbers to correlate")
    r = half_up(r, 4)
    spark = frame.sparkSession
    return PlanResult(
        small_frame(spark, [(*plan.columns, r)], "column_a string, column_b string, pearson_r double"),
        small_frame(spark, [(r, n)], "pearson_r double, n bigint"),
    )


def _filter_rows(frame: DataFrame, plan: QueryPlan) -> PlanResult:
    """All matching rows, or the first ones in the order of the columns."""
    page = frame
    if plan.limit:
        unordered = (T.MapType, T.VariantType)
        order = [column(f.name) for f in frame.schema.fields if not isinstance(f.dataType, unordered)]
        page = frame.orderBy(*order).limit(plan.limit)
    return PlanResult(_tidy(page), frame.agg(F.count("*").alias("matching_rows")))
