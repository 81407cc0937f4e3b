"""Dashboard tables: one tidy table per kind of tile or chart."""

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.parsing import column, label_of, moment_of, number_of, text_of
from quillgrid.functions.render import compact_number
from quillgrid.operators.frequencies import most_frequent
from quillgrid.operators.profile import TableProfile
from quillgrid.operators.quantiles import grouped_quantiles
from quillgrid.operators.roles import pick_date_column, rank_dimensions, rank_metrics
from quillgrid.operators.small import half_up, small_frame
from quillgrid.operators.timeseries import (
    FREQUENCIES,
    bucket_end,
    choose_frequency,
    date_range,
    delta_spans,
    fill_gaps,
    recent_deltas,
)
from quillgrid.plans.filters import predicate
from quillgrid.plans.model import Filter
from quillgrid.sources.scratch import written

# --- Fixed values ------------------------------------------------------------
TOP_CATEGORIES, OPTION_VALUES = 10, 30
LINE_ROWS, HISTOGRAM_ROWS, BOX_ROWS = 3, 10, 5
BINS_MIN, BINS_MAX = 8, 30
# -----------------------------------------------------------------------------


@dataclass
class DashboardFilters:
    date_from: str | None = None
    date_to: str | None = None
    categories: Sequence[str] = ()


@dataclass
class Dashboard:
    kpis: DataFrame
    date_options: DataFrame | None = None
    category_options: DataFrame | None = None
    lines: DataFrame | None = None
    bars: DataFrame | None = None
    shares: DataFrame | None = None
    histograms: DataFrame | None = None
    boxes: DataFrame | None = None
    correlations: DataFrame | None = None
    roles: dict = field(default_factory=dict)


def filter_options(
    frame: DataFrame, date_column: str | None, dimension: str | None, top: int = OPTION_VALUES
) -> tuple[DataFrame | None, DataFrame | None]:
    """Date range, and the most frequent values of the first dimension."""
    dates = values = None
    if date_column:
        dates = date_range(frame.select(moment_of(frame, date_column).alias("d")), "d")
    if dimension:
        shown = frame.select(text_of(frame, dimension).alias("t"))
        values = most_frequent(shown, "t", top)
    return dates, values


def dashboard_rows(
    frame: DataFrame, date_column: str | None, dimension: str | None, filters: DashboardFilters | None
) -> DataFrame:
    """Rows inside the date range (end day included whole) and the chosen categories."""
    if filters is None:
        return frame
    if date_column and (filters.date_from or filters.date_to):
        moment = moment_of(frame, date_column)
        if filters.date_from:
            frame = frame.where(moment >= F.lit(filters.date_from).cast("timestamp_ntz"))
        if filters.date_to:
            stop = F.lit(filters.date_to).cast("timestamp_ntz") + F.expr("interval 1 day")
            frame = frame.where(moment < stop)
    if dimension and filters.categories:
        frame = frame.where(predicate(frame, Filter(dimension, "in", list(filters.categories))))
    return frame


def kpi_table(frame: DataFrame, metrics: Sequence[str], date_column: str | None) -> DataFrame:
    """Row count and metric totals, with the change against the previous window.

    Totals and covered spans come from one aggregation; the windows take a second one
    over the recent dates only.
    """
    metrics = list(metrics)
    moment = moment_of(frame, date_column) if date_column else F.lit(None).cast("timestamp_ntz")
    rows = frame.select(moment.alias("d"), *[number_of(frame, m).alias(f"v{i}") for i, m in enumerate(metrics)])
    measures = {m: F.col(f"v{i}") for i, m in enumerate(metrics)}
    sums = [F.round(F.sum(c), 2).cast("double") for c in measures.values()]
    records, *found = rows.agg(F.count("*"), *sums, *delta_spans("d", measures)).first()
    totals, spans = found[: len(metrics)], found[len(metrics) :]
    deltas = recent_deltas(rows, "d", measures, spans) if date_column else {}
    tiles = [(0, "Records", float(records), None)] + [
        (i, f"Total {m}", value, half_up(deltas.get(m), 1))
        for i, (m, value) in enumerate(zip(metrics, totals), 1)
        if value is not None
    ]
    table = small_frame(frame.sparkSession, tiles, "place int, label string, value double, delta_pct double")
    whole = F.when(F.col("place") == 0, F.format_number("value", 0))
    return table.withColumns(
        {"shown": whole.otherwise(compact_number(F.col("value"))), "delta_positive": F.col("delta_pct") >= 0}
    )


def metric_series(frame: DataFrame, metrics: Sequence[str], date_column: str) -> DataFrame:
    """Totals per metric and calendar bucket, gaps zero; short metrics left out."""
    metrics = list(metrics)
    rows = frame.select(
        moment_of(frame, date_column).alias("d"),
        *[number_of(frame, m).alias(f"v{i}") for i, m in enumerate(metrics)],
    ).where("d is not null")
    frequency = choose_frequency(rows, "d") or "D"
    sums = [F.sum(f"v{i}").alias(f"s{i}") for i in range(len(metrics))]
    sizes = [F.count(f"v{i}").alias(f"n{i}") for i in range(len(metrics))]
    wide = rows.groupBy(bucket_end(F.col("d"), frequency).alias("period")).agg(*sums, *sizes)
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(f"s{i}").alias("total"), F.col(f"n{i}").alias("n"))
        for i, m in enumerate(metrics)
    ]
    tall = wide.select("period", F.inline(F.array(*cells))).where("n > 0")
    enough = F.sum("n").over(Window.partitionBy("metric")) >= LINE_ROWS
    kept = tall.withColumn("_ok", enough).where("_ok").drop("_ok", "n")
    filled = fill_gaps(kept, frequency, ["metric"], ["total"])
    return filled.select(
        "metric", "period", F.round(F.col("total"), 2).cast("double").alias("total"),
        F.lit(FREQUENCIES[frequency]).alias("bucket"),
    )


def category_totals(frame: DataFrame, metric: str, dimensions: Sequence[str]) -> DataFrame:
    """Metric total per category, for several dimensions in one pass over the rows."""
    dims = list(dimensions)
    keys = [f"k{i}" for i in range(len(dims))]
    rows = frame.select(
        *[label_of(frame, d).alias(k) for d, k in zip(dims, keys)], number_of(frame, metric).alias("v")
    ).where("v is not null")
    if len(dims) == 1:
        grouped = rows.groupBy("k0").agg(F.sum("v").alias("total"))
    else:
        grouped = rows.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.sum("v").alias("total"))
    # Labels are never null, so the one key that is set names the dimension.
    dimension = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(d)) for d, k in zip(dims, keys)])
    return grouped.select(
        dimension.alias("dimension"), F.coalesce(*keys).alias("category"), F.lit(metric).alias("metric"), "total"
    )


def bar_table(frame: DataFrame, metric: str, dimensions: Sequence[str], top: int = TOP_CATEGORIES) -> DataFrame:
    """The largest categories of each dimension."""
    best = Window.partitionBy("dimension").orderBy(F.desc("total"), "category")
    return (
        category_totals(frame, metric, dimensions)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= top)
        .withColumn("total", F.round(F.col("total"), 2).cast("double"))
    )


def share_table(frame: DataFrame, metric: str, dimensions: Sequence[str]) -> DataFrame:
    """All categories of all dimensions with their share."""
    whole = Window.partitionBy("dimension")
    share = F.col("total").cast("double") / F.nullif(F.sum("total").over(whole).cast("double"), F.lit(0.0))
    return (
        category_totals(frame, metric, dimensions)
        .withColumn("share_pct", F.round(share * 100, 2))
        .withColumn("total", F.round(F.col("total"), 2).cast("double"))
    )


def bin_count(rows: int) -> int:
    return min(BINS_MAX, max(BINS_MIN, isqrt(rows)))


def histogram_table(frame: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Equal-width bins per metric, the last one closed, empty ones included."""
    spark = frame.sparkSession
    names = list(metrics)
    rows = frame.select(*[number_of(frame, m).cast("double").alias(f"v{i}") for i, m in enumerate(names)])
    measures = [f(f"v{i}") for i in range(len(names)) for f in (F.count, F.min, F.max)]
    found = rows.agg(*measures).first()
    cells, edges = [], []
    for i, m in enumerate(names):
        n, low, high = found[3 * i : 3 * i + 3]
        if n < HISTOGRAM_ROWS:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        bins = bin_count(n)
        width = (high - low) / bins
        v = F.col(f"v{i}")
        guess = F.least(F.floor((v - low) * (bins / (high - low))), F.lit(bins - 1)).cast("int")
        # Division may land a hair off an edge; the edge itself decides.
        place = (
            F.when(v.isNull(), F.lit(None))
            .when(v < F.lit(low) + guess * F.lit(width), guess - 1)
            .when((v >= F.lit(low) + (guess + 1) * F.lit(width)) & (guess < bins - 1), guess + 1)
            .otherwise(guess)
        )
        cells.append(F.struct(F.lit(m).alias("metric"), place.alias("bin")))
        edges += [(m, k, low + k * width, high if k == bins - 1 else low + (k + 1) * width) for k in range(bins)]
    spine = small_frame(spark, edges, "metric string, bin int, low_edge double, high_edge double")
    if not cells:
        return spine.withColumn("count", F.lit(0).cast("bigint"))
    counted = rows.select(F.inline(F.array(*cells))).where("bin is not null").groupBy("metric", "bin").count()
    return spine.join(counted, ["metric", "bin"], "left").select(
        "metric", "bin", F.round("low_edge", 2).alias("low_edge"), F.round("high_edge", 2).alias("high_edge"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def box_table(frame: DataFrame, metric: str, dimension: str) -> DataFrame:
    """Five-number summary per category of at least five rows."""
    rows = frame.select(label_of(frame, dimension).alias("category"), number_of(frame, metric).alias("v"))
    cuts = grouped_quantiles(rows, ["category"], "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["min", "q1", "median", "q3", "max"]
    return cuts.where(F.col("values") >= BOX_ROWS).select(
        "category", *[F.round(F.col("quantiles")[i], 2).alias(n) for i, n in enumerate(names)]
    )


def typed_rows(frame: DataFrame, date: str | None, metrics: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """The columns of a dashboard in their own types, parsed in one scan of the table and written for all that follows."""
    cells = {d: column(d) for d in dimensions} | {m: number_of(frame, m) for m in metrics}
    if date:
        cells[date] = moment_of(frame, date)
    return written(frame.select(*[cell.alias(n) for n, cell in cells.items()]), "dashboard")


def build_dashboard(
    frame: DataFrame, profile: TableProfile, filters: DashboardFilters | None = None, top: int = TOP_CATEGORIES, options: int = OPTION_VALUES
) -> Dashboard:
    """Every table the dashboard shows. Options and correlations ignore the filters."""
    spark = frame.sparkSession
    have = set(frame.columns)
    date = pick_date_column(profile)
    metrics = [m for m in rank_metrics(profile) if m in have]
    dimensions = [d for d in rank_dimensions(profile) if d in have]
    first = dimensions[0] if dimensions else None
    whole = typed_rows(frame, date, metrics, dimensions)
    rows = dashboard_rows(whole, date, first, filters)

    result = Dashboard(kpi_table(rows, metrics, date), *filter_options(whole, date, first, options))
    result.roles = {"date": date, "metrics": metrics, "dimensions": dimensions}
    if date and metrics:
        result.lines = metric_series(rows, metrics, date)
    if metrics and dimensions:
        result.bars = bar_table(rows, metrics[0], dimensions, top)
        result.shares = share_table(rows, metrics[0], dimensions)
        result.boxes = box_table(rows, metrics[0], dimensions[0])
    if metrics:
        result.histograms = histogram_table(rows, metrics)
    if profile.correlations:
        result.correlations = profile.correlations_frame(spark).where("method = 'pearson'")
    return result
