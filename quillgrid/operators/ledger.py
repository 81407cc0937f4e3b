"""Rollups over usage and storage records."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: USD per million tokens (input, output) ---------------------
PRICES = {
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1": (2.00, 8.00),
    "llama-3.3-70b-versatile": (0.59, 0.79),
    "llama-3.1-8b-instant": (0.05, 0.08),
}
FALLBACK_PRICE = (2.50, 10.00)
# -----------------------------------------------------------------------------


def price_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{m}', cast({i} as decimal(10,4)), cast({o} as decimal(10,4)))" for m, (i, o) in PRICES.items())
    return spark.sql(f"select * from values {rows} as t(model, input_price, output_price)")


def with_cost(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Cost per call; models without a price use the fallback rate.

    The default price table is a fixed handful of rows, so it is always broadcast. A
    caller's own table is joined by whatever strategy its size calls for.
    """
    table = F.broadcast(price_table(usage.sparkSession)) if prices is None else prices
    priced = usage.join(table, "model", "left")
    cost = F.lit(0)
    for tokens, rate, fallback in zip(
        ("prompt_tokens", "completion_tokens"), ("input_price", "output_price"), FALLBACK_PRICE
    ):
        price = F.coalesce(rate, F.lit(fallback).cast("decimal(10,4)"))
        cost = cost + F.col(tokens).cast("decimal(14,0)") * price
    usd = F.round(cost * F.lit("0.000001").cast("decimal(6,6)"), 6).cast("double")
    return priced.withColumn("cost_usd", usd).drop("input_price", "output_price")


def budget_rollup(costs: DataFrame, cap: float, key: str = "project_id") -> DataFrame:
    """Spend per project and whether it reached the cap; a cap of zero or less is none."""
    spent = F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,6)")), F.lit(0)).cast("double")
    exhausted: Column = F.col("spent_usd") >= F.lit(float(cap)) if cap > 0 else F.lit(False)
    return costs.groupBy(key).agg(F.count("*").alias("calls"), spent.alias("spent_usd")).withColumn(
        "budget_exhausted", exhausted
    )


def storage_rollup(versions: DataFrame, projects: DataFrame) -> DataFrame:
    """Bytes stored per owner, over projects that are not deleted."""
    live = projects.where("deleted_at is null").select("project_id", "owner_id")
    return (
        versions.select("project_id", "size_bytes")
        .join(live, "project_id")
        .groupBy("owner_id")
        .agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
    )


def newest_first(projects: DataFrame, owner) -> DataFrame:
    """An owner's live projects, latest first."""
    mine = projects.where((F.col("owner_id") == F.lit(owner)) & F.col("deleted_at").isNull())
    return mine.orderBy(F.desc("created_at"), "project_id")
