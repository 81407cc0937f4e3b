"""Cleaning steps worth reviewing, as selects over the column profile table."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators.cleaning import Step
from quillgrid.operators.profile import TableProfile

# --- Fixed values: default strategy first, then the alternatives --------------
NUMERIC_FILLS = ("median", "mean", "zero", "drop_rows")
LABEL_FILLS = ("unknown_label", "mode", "drop_rows")
OUTLIER_CHOICES = ("keep", "cap", "remove_rows")
FILLABLE = ("numeric", "categorical", "boolean", "text")
# -----------------------------------------------------------------------------


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def suggest_cleaning(spark: SparkSession, profile: TableProfile) -> DataFrame:
    """One row per suggestion, in rule order and then column order."""
    columns = profile.columns_frame(spark).withColumn("place", F.monotonically_increasing_id())
    rows = F.lit(profile.row_count)
    none = F.lit(None).cast("string")

    def suggest(
        source: DataFrame, step: int, rule: str, affected: Column,
        target: Column = none, strategy: Column = none, options: Column = _words(()), on: bool = True,
    ) -> DataFrame:
        name = F.col("name")
        return source.select(
            F.lit(step).alias("step"), "place",
            F.concat_ws(":", F.lit(rule), name).alias("id"),
            F.lit(rule).alias("rule"), name.alias("column"),
            target.alias("target"), strategy.alias("strategy"),
            affected.cast("bigint").alias("estimated_rows"),
            F.lit(on).alias("enabled_by_default"), options.alias("strategy_options"),
        )

    numeric = F.col("semantic_type") == "numeric"
    fills = F.when(numeric, _words(NUMERIC_FILLS)).otherwise(_words(LABEL_FILLS))
    copies = spark.range(1).where(F.lit(profile.duplicate_row_count > 0)).select(
        none.alias("name"), F.lit(0).cast("bigint").alias("place")
    )
    parts = [
        suggest(copies, 0, "deduplicate", F.lit(profile.duplicate_row_count)),
        suggest(
            columns.where("suggested_type is not null"), 1, "coerce_type",
            rows - F.col("missing_count"), target=F.col("suggested_type"),
        ),
        suggest(
            columns.where((F.col("missing_count") > 0) & F.col("semantic_type").isin(*FILLABLE)),
            2, "impute_missing", F.col("missing_count"), strategy=fills[0], options=fills,
        ),
        suggest(
            columns.where(numeric & (F.col("outlier_count_iqr") > 0)), 3, "handle_outliers",
            F.col("outlier_count_iqr"), strategy=F.lit(OUTLIER_CHOICES[0]),
            options=_words(OUTLIER_CHOICES), on=False,
        ),
        suggest(columns.where("is_constant"), 4, "drop_constant_column", rows, on=False),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("step", "place").drop("step", "place")


def accepted_steps(suggestions: DataFrame, everything: bool = False) -> list[Step]:
    """The default-on suggestions (or all of them) as a cleaning plan."""
    chosen = suggestions if everything else suggestions.where("enabled_by_default")
    steps = []
    for r in chosen.collect():  # a few rows per column of the table
        params = {k: r[k] for k in ("target", "strategy") if r[k] is not None}
        steps.append(Step(r["rule"], r["column"], params))
    return steps
