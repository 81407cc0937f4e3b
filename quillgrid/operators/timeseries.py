"""Regular calendar series: buckets, gap filling, growth, edges, period comparison."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.parsing import column

# --- Fixed values: span limits for the frequency, window and row gates --------
DAILY_UP_TO, WEEKLY_UP_TO = 62, 370  # days
DELTA_ROWS, GROWTH_BUCKETS, EDGE_BUCKETS = 10, 4, 3
DELTA_DAYS_MIN, DELTA_DAYS_MAX = 7, 90
FREQUENCIES = {"D": "day", "W": "week", "ME": "month"}
GAP_PIECE = 1_000  # empty buckets spelt out together
# -----------------------------------------------------------------------------


def frequency_for(days: int) -> str:
    if days <= DAILY_UP_TO:
        return "D"
    return "W" if days <= WEEKLY_UP_TO else "ME"


def whole_days(first: Column, last: Column) -> Column:
    """Completed days between two moments."""
    return F.floor(F.timestamp_diff("SECOND", first, last) / 86_400)


def choose_frequency(frame: DataFrame, moment: str) -> str | None:
    """Day, week or month by the span of a moment column; None without any date."""
    days = frame.agg(whole_days(F.min(moment), F.max(moment))).first()[0]
    return None if days is None else frequency_for(days)


def bucket_end(day: Column, frequency: str) -> Column:
    """Label of the bucket holding a date: the day, its Sunday, or its month end."""
    day = day.cast("date")
    if frequency == "D":
        return day
    if frequency == "W":
        return F.next_day(F.date_sub(day, 1), "Sunday")
    return F.last_day(day)


def bucket_start(end: Column, frequency: str) -> Column:
    if frequency == "D":
        return end
    return F.date_sub(end, 6) if frequency == "W" else F.trunc(end, "month")


def steps_between(end: Column, following: Column, frequency: str) -> Column:
    """How many buckets after a bucket another one comes."""
    if frequency == "ME":
        return (F.year(following) - F.year(end)) * 12 + F.month(following) - F.month(end)
    return F.floor(F.datediff(following, end) / (1 if frequency == "D" else 7)).cast("int")


def shift_bucket(end: Column, steps: Column, frequency: str) -> Column:
    """The label a number of buckets later."""
    if frequency == "ME":
        return F.last_day(F.add_months(end, steps))
    return F.date_add(end, (steps * (1 if frequency == "D" else 7)).cast("int"))


def fill_gaps(series: DataFrame, frequency: str, keys: Sequence[str] = (), zero: Sequence[str] = ()) -> DataFrame:
    """Add the missing buckets of each series; columns named in `zero` become 0 there.

    Each bucket brings along the empty ones up to the next as one row with their number,
    so the rows behind the series are aggregated once and nothing is joined. A long run is
    cut into pieces of GAP_PIECE buckets, which are dealt to different tasks before they
    are spelt out. The series holds one row per bucket, so ordering it per key is ordering
    a calendar.
    """
    keys = list(keys)
    following = F.lead("period").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("period"))
    steps = F.coalesce(steps_between(F.col("period"), following, frequency), F.lit(1))
    runs = series.where("period is not null").withColumn("_steps", steps)
    pieces = runs.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_steps") - 1, F.lit(GAP_PIECE))))
    # A given number of tasks: by their size before they are spelt out, all pieces would go to one.
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(tasks, *[column(k) for k in keys], "period", "_from")
    last = F.least(F.col("_from") + GAP_PIECE, F.col("_steps")) - 1
    spread = pieces.withColumn("_step", F.explode(F.sequence(F.col("_from"), last)))
    spread = spread.withColumn("_bucket", shift_bucket(F.col("period"), F.col("_step"), frequency))
    real = F.col("_step") == 0
    others = [c for c in series.columns if c not in {"period", *keys}]
    filled = {c: F.when(real, column(c)) for c in others}
    filled |= {c: F.coalesce(filled[c], F.lit(0)) for c in zero}
    return spread.select(
        *[column(k) for k in keys], F.col("_bucket").alias("period"), *[filled[c].alias(c) for c in others]
    )


def resample(
    frame: DataFrame,
    moment: str,
    frequency: str,
    measures: dict[str, Column],
    keys: Sequence[str] = (),
    zero: Sequence[str] | None = None,
) -> DataFrame:
    """Aggregate per bucket, with every bucket between the first and the last present."""
    rows = frame.where(F.col(moment).isNotNull())
    series = rows.groupBy(*keys, bucket_end(F.col(moment), frequency).alias("period")).agg(
        *[m.alias(n) for n, m in measures.items()]
    )
    return fill_gaps(series, frequency, keys, list(measures) if zero is None else zero)


def trim_edges(series: DataFrame, frequency: str, first: str, last: str, keys: Sequence[str] = ()) -> DataFrame:
    """Drop an unfinished first or last week or month.

    `first` and `last` are columns holding the first and last observed day of a series.
    A partial last bucket is dropped before the first one is looked at.
    """
    if frequency == "D":
        return series
    w = Window.partitionBy(*keys)
    kept = series.withColumns(
        {
            "_n": F.count("*").over(w),
            "_a": F.min("period").over(w),
            "_z": F.max("period").over(w),
        }
    )
    long_enough = F.col("_n") >= EDGE_BUCKETS
    open_last = long_enough & (F.col("period") == F.col("_z")) & (F.col(last) < F.col("_z"))
    starts_late = F.col(first) > bucket_start(F.col("_a"), frequency)
    open_first = long_enough & (F.col("period") == F.col("_a")) & starts_late
    return kept.where(~open_last & ~open_first).drop("_n", "_a", "_z")


def half_growth(series: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Second half against first half, best and worst bucket, per series.

    An odd middle bucket counts to the second half; the earliest bucket wins ties.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    placed = series.withColumns(
        {"_i": F.row_number().over(w.orderBy("period")), "_n": F.count("*").over(w)}
    )
    v = F.col(value).cast("double")
    in_first = F.col("_i") <= F.floor(F.col("_n") / 2)
    first, second = F.sum(F.when(in_first, F.col(value))), F.sum(F.when(~in_first, F.col(value)))
    first, second = first.cast("double"), second.cast("double")
    latest_last = F.datediff(F.lit("9999-12-31").cast("date"), F.col("period"))
    summary = placed.groupBy(*keys).agg(
        F.max("_n").alias("buckets"),
        F.round((second - first) / F.nullif(F.abs(first), F.lit(0.0)) * 100, 1).alias("growth_pct"),
        F.max_by("period", F.struct(v, latest_last)).alias("best_period"),
        F.round(F.max(v), 2).alias("best_value"),
        F.min_by("period", F.struct(v, F.col("period"))).alias("worst_period"),
        F.round(F.min(v), 2).alias("worst_value"),
    )
    return summary.where(F.col("buckets") >= GROWTH_BUCKETS)


def delta_spans(moment: str, measures: dict[str, Column]) -> list[Column]:
    """Per metric: how many dated values it has, the latest moment, and the days covered."""
    spans = []
    for c in measures.values():
        seen = F.when(c.isNotNull(), F.col(moment))
        spans += [F.count(seen), F.max(seen).cast("string"), whole_days(F.min(seen), F.max(seen))]
    return spans


def recent_deltas(
    frame: DataFrame, moment: str, measures: dict[str, Column], spans: Sequence | None = None
) -> dict[str, float | None]:
    """Percent change of each metric's total, latest window against the one before.

    The window is half the covered span, between 7 and 90 days, counted back from the
    latest moment; windows are open on the left and closed on the right. Pass the values
    of `delta_spans` when another aggregation has found them already.
    """
    if not measures:
        return {}
    spans = frame.agg(*delta_spans(moment, measures)).first() if spans is None else spans
    m = F.col(moment)
    sums, used, starts = [], [], []
    for k, (name, c) in enumerate(measures.items()):
        count, last, days = spans[3 * k : 3 * k + 3]
        if count < DELTA_ROWS:
            continue
        window = max(DELTA_DAYS_MIN, min(days // 2, DELTA_DAYS_MAX))
        end = F.lit(last).cast("timestamp_ntz")
        edge, start = (end - F.make_dt_interval(F.lit(window * k)) for k in (1, 2))
        used.append(name)
        starts.append(m > start)
        sums += [
            F.sum(F.when((m > edge) & (m <= end), c)).cast("double"),
            F.sum(F.when((m > start) & (m <= edge), c)).cast("double"),
        ]
    deltas: dict[str, float | None] = dict.fromkeys(measures)
    if sums:
        recent = reduce(lambda a, b: a | b, starts)  # earlier dates need not be read
        found = frame.where(recent).agg(*sums).first()
        for k, name in enumerate(used):
            now, before = found[2 * k] or 0.0, found[2 * k + 1] or 0.0
            deltas[name] = (now - before) / abs(before) * 100 if before else None
    return deltas


def in_period(moment: Column, first: str, last: str) -> Column:
    """Within two dates, both included whole: [first, last + 1 day)."""
    start, stop = F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")
    return (moment >= start) & (moment < stop + F.expr("interval 1 day"))


def period_values(
    frame: DataFrame,
    moment: Column,
    aggregate: Callable[[Column], Column],
    value: Column,
    period_a: Sequence[str],
    period_b: Sequence[str],
    counts_rows: bool = False,
) -> DataFrame:
    """One row (a, b): the aggregate over each of two date ranges, 0 when empty."""
    inside = [in_period(moment, *p) for p in (period_a, period_b)]
    found = [
        F.coalesce((F.count_if(i) if counts_rows else aggregate(F.when(i, value))).cast("double"), F.lit(0.0))
        for i in inside
    ]
    touched = frame.where(inside[0] | inside[1])  # the scan may skip all other dates
    return touched.agg(found[0].alias("a"), found[1].alias("b"))


def compare_values(values: DataFrame) -> DataFrame:
    """Rounded values and the percent change from a to b; null when a is zero."""
    a, b = F.col("a"), F.col("b")
    change = (b - a) / F.nullif(F.abs(a), F.lit(0.0)) * 100
    return values.select(
        F.round(a, 2).alias("value_a"), F.round(b, 2).alias("value_b"), F.round(change, 2).alias("delta_pct")
    )


def date_range(frame: DataFrame, moment: str) -> DataFrame:
    return frame.agg(
        F.min(moment).cast("date").alias("date_from"), F.max(moment).cast("date").alias("date_to")
    )

