"""Health issues and the 0-100 score, as selects over the column profile table."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: penalty rates, per-issue limits and per-family caps -------
FAMILY_CAPS = {
    "missing_values": 30.0,
    "duplicate_rows": 15.0,
    "wrong_type": 15.0,
    "outliers": 10.0,
    "constant_column": 6.0,
    "invalid_records": 10.0,
}
MISSING_RATE, MISSING_LIMIT = 0.4, 12.0
DUPLICATE_RATE = 0.8
WRONG_TYPE_PENALTY = 5.0
INVALID_RATE, INVALID_LIMIT = 0.3, 5.0
OUTLIER_RATE, OUTLIER_LIMIT = 0.2, 4.0
CONSTANT_PENALTY = 2.0
MISSING_HIGH, MISSING_MEDIUM, DUPLICATE_HIGH = 20, 5, 5
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}
# -----------------------------------------------------------------------------


def health_issues(columns: DataFrame, rows: int, duplicates: int) -> DataFrame:
    """One row per issue: kind, severity, column, affected rows, penalty, description."""
    total = F.lit(float(max(rows, 1)))
    n = F.col("name")
    stored = F.lit(rows) - F.col("missing_count")
    unparsed = F.round((100 - F.col("parse_success_pct")) / 100 * stored).cast("bigint")

    def issue(
        source: DataFrame, kind: str, severity: Column, column: Column, affected: Column, penalty: Column, text: Column
    ) -> DataFrame:
        return source.select(
            F.lit(kind).alias("kind"), severity.alias("severity"), column.alias("column"),
            affected.cast("bigint").alias("affected_rows"),
            F.round(penalty, 2).alias("penalty"), text.alias("description"),
        )

    def tick(before: str, *parts: Column | str) -> Column:
        return F.concat(F.lit(before), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    pct = F.col("missing_pct")
    missing = issue(
        columns.where("missing_count > 0"), "missing_values",
        F.when(pct > MISSING_HIGH, "high").when(pct > MISSING_MEDIUM, "medium").otherwise("low"),
        n, F.col("missing_count"), F.least(pct * MISSING_RATE, F.lit(MISSING_LIMIT)),
        tick("", n, ": ", F.format_number("missing_count", 0), " values missing (", F.format_number(pct, 1), "%)"),
    )
    copies = F.lit(duplicates)
    copies_pct = copies / total * 100
    duplicate = issue(
        columns.sparkSession.range(1).where(copies > 0), "duplicate_rows",
        F.when(copies_pct > DUPLICATE_HIGH, "high").otherwise("medium"),
        F.lit(None).cast("string"), copies,
        F.least(copies_pct * DUPLICATE_RATE, F.lit(FAMILY_CAPS["duplicate_rows"])),
        tick("", F.format_number(copies, 0), " rows repeat another row (", F.format_number(copies_pct, 1), "%)"),
    )
    typed = columns.where("suggested_type is not null")
    wrong = issue(
        typed, "wrong_type", F.lit("medium"), n, stored, F.lit(WRONG_TYPE_PENALTY),
        tick("", n, ": text that reads as ", F.col("suggested_type"), " (", F.format_number("parse_success_pct", 0), "%)"),
    )
    invalid = issue(
        typed.where("parse_success_pct < 100").where(unparsed > 0), "invalid_records",
        F.lit("medium"), n, unparsed,
        F.least(unparsed / total * 100 * INVALID_RATE, F.lit(INVALID_LIMIT)),
        tick("", n, ": about ", F.format_number(unparsed, 0), " values do not read as ", F.col("suggested_type")),
    )
    out = F.col("outlier_count_iqr")
    outliers = issue(
        columns.where("semantic_type = 'numeric' and outlier_count_iqr > 0"), "outliers",
        F.lit("low"), n, out, F.least(out / total * 100 * OUTLIER_RATE, F.lit(OUTLIER_LIMIT)),
        tick("", n, ": ", F.format_number(out, 0), " values outside the quartile fences"),
    )
    constant = issue(
        columns.where("is_constant"), "constant_column", F.lit("low"), n, F.lit(rows),
        F.lit(CONSTANT_PENALTY), tick("", n, ": one value in every row"),
    )
    parts = [missing, duplicate, wrong, invalid, outliers, constant]
    issues = reduce(DataFrame.unionByName, parts)
    return issues if rows else issues.where(F.lit(False))


def health_score(issues: DataFrame, rows: int) -> DataFrame:
    """Family penalties, each capped, taken off 100. A table without rows scores 0."""
    if rows == 0:
        return issues.sparkSession.range(1).select(F.lit(0).alias("score"))
    caps = F.create_map(*[F.lit(x) for kind, cap in FAMILY_CAPS.items() for x in (kind, cap)])
    families = issues.groupBy("kind").agg(F.sum("penalty").alias("penalty"))
    lost = F.coalesce(F.sum(F.least(F.col("penalty"), caps[F.col("kind")])), F.lit(0.0))
    return families.agg(F.greatest(F.lit(0), F.round(100 - lost)).cast("int").alias("score"))


def by_severity(issues: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for s, r in SEVERITY_ORDER.items() for x in (s, r)])
    return issues.orderBy(rank[F.col("severity")], "kind", "column")


def by_missing(columns: DataFrame) -> DataFrame:
    """Columns with gaps, emptiest first."""
    return (
        columns.where("missing_count > 0")
        .select("name", "missing_count", "missing_pct")
        .orderBy(F.desc("missing_pct"), "name")
    )
