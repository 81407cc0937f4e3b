"""Named queries, each with the SQL that must give the same rows where SQL can."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The same text runs in Spark SQL and in the SQL oracle over a view named orders: text
# numbers, mixed date spellings, gaps, outliers, a constant column and repeated rows.
DIRTY = """
base AS (
  SELECT o_orderkey AS order_id,
    CASE WHEN o_orderkey % 50 = 7 THEN 'garbage'
         WHEN o_orderkey % 3 = 0 THEN concat(lpad(cast(month(o_orderdate) AS string), 2, '0'), '/',
              lpad(cast(day(o_orderdate) AS string), 2, '0'), '/', cast(year(o_orderdate) AS string))
         ELSE cast(cast(o_orderdate AS date) AS string) END AS order_date,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
    concat('$', cast(cast(floor(o_totalprice / 1000) AS int) AS string), ',',
           lpad(cast(cast(o_totalprice AS decimal(18,2)) % 1000 AS string), 6, '0')) AS revenue,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL
         WHEN o_orderkey % 997 = 3 THEN cast(5000 AS double)
         ELSE cast(o_custkey % 40 AS double) END AS quantity,
    CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS fulfilled,
    'USD' AS currency
  FROM {orders}),
dirty AS (
  SELECT * FROM base
  UNION ALL
  SELECT * FROM base WHERE order_id % 40 = 1)
"""
DIRTY_SQL = DIRTY.format(orders="orders")

# Parsed forms of the text columns, for the oracle.
PARSED_SQL = (
    DIRTY_SQL
    + """, parsed AS (
  SELECT *, try_cast(replace(replace(revenue, '$', ''), ',', '') AS double) AS amount,
    try_cast(replace(replace(revenue, '$', ''), ',', '') AS decimal(18,2)) AS exact_amount,
    CASE WHEN order_date LIKE '%/%' THEN try_strptime(order_date, '%m/%d/%Y')
         ELSE try_cast(order_date AS timestamp) END AS moment
  FROM dirty)
"""
)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "WITH " + DIRTY.format(orders="{orders}") + " SELECT * FROM dirty",
        orders=table(spark, sf_dir, "orders"),
    )
