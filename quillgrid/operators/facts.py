"""Facts worth telling: growth, segments, anomalies and data notes."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.parsing import moment_of, number_of
from quillgrid.operators.dashboard import category_totals
from quillgrid.operators.moments import mean, total
from quillgrid.operators.profile import TableProfile
from quillgrid.operators.roles import pick_date_column, rank_dimensions, rank_metrics
from quillgrid.operators.small import small_frame
from quillgrid.operators.timeseries import (
    bucket_end,
    date_range,
    fill_gaps,
    frequency_for,
    half_growth,
    whole_days,
)

# --- Fixed values ------------------------------------------------------------
GROWTH_ROWS, MISSING_NOTE_PCT = 10, 5
# -----------------------------------------------------------------------------

_NO_GROWTH = {
    "growth_pct": "double", "best_period": "date", "best_value": "double",
    "worst_period": "date", "worst_value": "double",
}


@dataclass
class Facts:
    overview: dict
    metrics: DataFrame | None
    segments: DataFrame | None
    anomalies: DataFrame
    notes: DataFrame
    dates: DataFrame | None


def metric_facts(frame: DataFrame, metrics: Sequence[str], date_column: str | None) -> DataFrame:
    """Total and mean per metric; growth and extreme buckets where dates allow.

    Each metric uses the bucket size of its own span. One aggregation finds totals and
    spans; metrics with the same bucket size share the aggregation to buckets.
    """
    names = list(metrics)
    moment = moment_of(frame, date_column) if date_column else F.lit(None).cast("timestamp_ntz")
    rows = frame.select(moment.alias("d"), *[number_of(frame, m).alias(f"v{i}") for i, m in enumerate(names)])
    measures = []
    for i in range(len(names)):
        v = F.col(f"v{i}")
        seen = F.when(v.isNotNull(), F.col("d"))
        measures += [
            F.round(total(v), 2).cast("double"),
            F.round(F.coalesce(mean(v), F.lit(0.0)), 2),
            F.count(seen),
            whole_days(F.min(seen), F.max(seen)),
        ]
    found = rows.agg(*measures).first()
    totals = small_frame(
        frame.sparkSession,
        [(m, *found[4 * i : 4 * i + 2]) for i, m in enumerate(names)],
        "metric string, total double, mean double",
    )
    by_frequency: dict[str, list[int]] = {}
    for i in range(len(names)):
        dated, days = found[4 * i + 2 : 4 * i + 4]
        if dated >= GROWTH_ROWS:
            by_frequency.setdefault(frequency_for(days), []).append(i)
    growth = None
    for frequency, places in by_frequency.items():
        wide = rows.where("d is not null").groupBy(bucket_end(F.col("d"), frequency).alias("period")).agg(
            *[F.sum(f"v{i}").alias(f"s{i}") for i in places]
        )
        cells = [F.struct(F.lit(names[i]).alias("metric"), F.col(f"s{i}").alias("value")) for i in places]
        tall = wide.select("period", F.inline(F.array(*cells))).where("value is not null")
        part = half_growth(fill_gaps(tall, frequency, ["metric"], ["value"]), "value", ["metric"])
        growth = part if growth is None else growth.unionByName(part)
    if growth is None:
        return totals.withColumns({n: F.lit(None).cast(t) for n, t in _NO_GROWTH.items()})
    return totals.join(growth.select("metric", *_NO_GROWTH), "metric", "left")


def segment_facts(frame: DataFrame, metric: str, dimensions: Sequence[str]) -> DataFrame:
    """Largest and smallest category of each dimension, and the largest one's share."""
    grouped = category_totals(frame, metric, dimensions)
    segment = F.struct("category", F.col("total").cast("double").alias("total"))
    place = F.struct(-F.col("total"), F.col("category"))  # largest first, then by name
    whole = F.nullif(F.sum("total").cast("double"), F.lit(0.0))
    ends = grouped.groupBy("dimension", "metric").agg(
        F.min_by(segment, place).alias("top"),
        F.max_by(segment, place).alias("bottom"),
        whole.alias("whole"),
        F.count("*").alias("segments_count"),
    )
    share = F.coalesce(F.col("top.total") / F.col("whole") * 100, F.lit(0.0))
    return ends.where("segments_count >= 2").select(
        "dimension",
        "metric",
        F.col("top.category").alias("top_name"),
        F.round("top.total", 2).alias("top_value"),
        F.round(share, 1).alias("top_share_pct"),
        F.col("bottom.category").alias("bottom_name"),
        F.round("bottom.total", 2).alias("bottom_value"),
        "segments_count",
    )


def anomaly_facts(frame: DataFrame, profile: TableProfile) -> DataFrame:
    """Outlier count and share per numeric column, with the extremes as examples."""
    rows = F.lit(float(max(profile.row_count, 1)))
    return (
        profile.columns_frame(frame.sparkSession)
        .where("semantic_type = 'numeric' and outlier_count_iqr > 0")
        .where(F.col("name").isin(*frame.columns))
        .select(
            F.col("name").alias("column"),
            F.col("outlier_count_iqr").alias("outlier_count"),
            F.round(F.col("outlier_count_iqr") / rows * 100, 2).alias("outlier_pct"),
            F.round("stats.max", 2).alias("example_high"),
            F.round("stats.min", 2).alias("example_low"),
        )
    )


def data_notes(frame: DataFrame, profile: TableProfile) -> DataFrame:
    """Columns with notable gaps, and repeated rows."""
    spark = frame.sparkSession
    gaps = profile.columns_frame(spark).where(F.col("missing_pct") > MISSING_NOTE_PCT)
    gap_notes = gaps.select(
        F.lit("missing").alias("note"), F.col("name").alias("column"), F.col("missing_count").alias("rows"),
        F.round("missing_pct", 1).alias("pct"),
    )
    copies = profile.duplicate_row_count
    copy_notes = spark.range(1).where(F.lit(copies > 0)).select(
        F.lit("duplicates").alias("note"), F.lit(None).cast("string").alias("column"),
        F.lit(copies).cast("bigint").alias("rows"), F.lit(None).cast("double").alias("pct"),
    )
    return gap_notes.unionByName(copy_notes)


def extract_facts(frame: DataFrame, profile: TableProfile) -> Facts:
    have = set(frame.columns)
    date = pick_date_column(profile)
    metrics = [m for m in rank_metrics(profile) if m in have]
    dimensions = [d for d in rank_dimensions(profile) if d in have]
    return Facts(
        overview={
            "row_count": profile.row_count, "column_count": profile.column_count,
            "date_column": date, "health_score": profile.health_score,
        },
        metrics=metric_facts(frame, metrics, date) if metrics else None,
        segments=segment_facts(frame, metrics[0], dimensions) if metrics and dimensions else None,
        anomalies=anomaly_facts(frame, profile),
        notes=data_notes(frame, profile),
        dates=date_range(frame.select(moment_of(frame, date).alias("d")), "d") if date else None,
    )
