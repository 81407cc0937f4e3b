"""Which columns act as metrics, dates and dimensions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators.profile import TableProfile

# --- Fixed values: business words by rank, dimension size limit ---------------
METRIC_WORDS = (
    r"revenue|sales|income|turnover",
    r"profit|margin|earnings",
    r"amount|total|value|price|cost|spend",
    r"quantity|count|units|orders|volume",
    r"rating|score",
)
MAX_DIMENSION_VALUES = 30
MIN_DATES = 3
# -----------------------------------------------------------------------------


def _column_table(profile: TableProfile) -> DataFrame:
    """The profile's table of columns, with each one's place."""
    names = [c.name for c in profile.columns]
    return profile.columns_frame(SparkSession.active()).withColumn("place", F.array_position(F.lit(names), F.col("name")))


def _names(columns: DataFrame) -> list[str]:
    return [r["name"] for r in columns.select("name").collect()]


def rank_metrics(profile: TableProfile) -> list[str]:
    """Numeric columns, best business name first, then widest spread."""
    named = [F.when(F.col("name").rlike(f"(?i){words}"), i) for i, words in enumerate(METRIC_WORDS)]
    spread = F.when(F.col("tier") == len(METRIC_WORDS), F.coalesce("stats.std", F.lit(0.0))).otherwise(0.0)
    numbers = _column_table(profile).where("semantic_type = 'numeric' and not is_constant")
    tiered = numbers.withColumn("tier", F.coalesce(*named, F.lit(len(METRIC_WORDS))))
    return _names(tiered.orderBy("tier", spread.desc(), "place"))


def pick_date_column(profile: TableProfile) -> str | None:
    """The date column covering the most time; the first one on a tie."""
    dates = _column_table(profile).where(F.col("semantic_type") == "datetime").where(F.col("valid_dates") >= MIN_DATES)
    first, last = (F.col(c).cast("timestamp_ntz") for c in ("min_date", "max_date"))
    longest = dates.withColumn("span", last - first).where(last > first).orderBy(F.desc("span"), "place").limit(1)
    return next(iter(_names(longest)), None)


def rank_dimensions(profile: TableProfile) -> list[str]:
    """Columns to group by, fewest values first, then in the order of the table."""
    groups = _column_table(profile).where(F.col("semantic_type").isin("categorical", "boolean"))
    return _names(groups.where(F.col("unique_count").between(2, MAX_DIMENSION_VALUES)).orderBy("unique_count", "place"))
