"""Cleaning rules: whole cleaned tables, logs, suggestions and comparisons."""

from pyspark.sql import functions as F

from checks.profiles import PROFILE_SQL, SPELT_SQL, spelt
from checks.registry import DIRTY_SQL, PARSED_SQL, dirty, query
from quillgrid.operators.cleaning import Step, clean, clean_and_compare
from quillgrid.operators.profile import profile_table
from quillgrid.operators.suggest import accepted_steps, suggest_cleaning


def _cleaned(name, sql, *steps, columns=None):
    @query(name, sql)
    def run(spark, sf):
        frame = clean(dirty(spark, sf), list(steps)).frame
        return frame.select(*columns) if columns else frame

    return run


_cleaned("deduplicate", f"WITH {DIRTY_SQL} SELECT DISTINCT * FROM dirty", Step("deduplicate"))
_cleaned("coerce_numeric", f"WITH {PARSED_SQL} SELECT order_id, amount AS revenue FROM parsed",
         Step("coerce_type", "revenue", {"target": "numeric"}), columns=["order_id", "revenue"])
_cleaned("coerce_datetime", f"WITH {PARSED_SQL} SELECT order_id, cast(moment AS timestamp) AS order_date FROM parsed",
         Step("coerce_type", "order_date", {"target": "datetime"}), columns=["order_id", "order_date"])
_cleaned("coerce_boolean", f"WITH {DIRTY_SQL} SELECT order_id, fulfilled = 'Yes' AS fulfilled FROM dirty",
         Step("coerce_type", "fulfilled", {"target": "boolean"}), columns=["order_id", "fulfilled"])


@query("coerce_date_spellings", SPELT_SQL)
def coerce_date_spellings(spark, sf):
    return clean(spelt(spark, sf), [Step("coerce_type", "moment", {"target": "datetime"})]).frame


_FILLS = {
    "median": ("quantity", "(SELECT quantile_cont(quantity, 0.5) FROM dirty)"),
    "mean": ("quantity", "(SELECT sum(quantity) / count(quantity) FROM dirty)"),
    "zero": ("quantity", "0"),
    "mode": ("priority", "(SELECT priority FROM dirty WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
    "unknown_label": ("priority", "'Unknown'"),
}
for _strategy, (_column, _fill) in _FILLS.items():
    _cleaned(
        f"impute_{_strategy}",
        f"WITH {DIRTY_SQL} SELECT order_id, coalesce({_column}, {_fill}) AS {_column} FROM dirty",
        Step("impute_missing", _column, {"strategy": _strategy}),
        columns=["order_id", _column],
    )
_cleaned("impute_drop_rows", f"WITH {DIRTY_SQL} SELECT * FROM dirty WHERE priority IS NOT NULL",
         Step("impute_missing", "priority", {"strategy": "drop_rows"}))
_cleaned("impute_nothing_missing", f"WITH {DIRTY_SQL} SELECT * FROM dirty",
         Step("impute_missing", "fulfilled", {"strategy": "mode"}), Step("impute_missing", "order_id", {"strategy": "median"}))

_FENCES = (
    "f AS (SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3, "
    "quantile_cont(quantity, 0.01) AS p01, quantile_cont(quantity, 0.99) AS p99 FROM dirty)"
)
_cleaned("outliers_keep", f"WITH {DIRTY_SQL} SELECT * FROM dirty", Step("handle_outliers", "quantity", {"strategy": "keep"}))
_cleaned("outliers_cap", f"WITH {DIRTY_SQL}, {_FENCES} SELECT order_id, CASE WHEN quantity IS NOT NULL THEN least(greatest(quantity, p01), p99) END AS quantity FROM dirty, f",
         Step("handle_outliers", "quantity", {"strategy": "cap"}), columns=["order_id", "quantity"])
_cleaned("outliers_remove", f"WITH {DIRTY_SQL}, {_FENCES} SELECT order_id, quantity FROM dirty, f WHERE quantity IS NULL OR quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)",
         Step("handle_outliers", "quantity", {"strategy": "remove_rows"}), columns=["order_id", "quantity"])
_cleaned("drop_constant", f"WITH {DIRTY_SQL} SELECT * EXCLUDE (currency) FROM dirty", Step("drop_constant_column", "currency"))

# A plan in scrambled order: it must run as distinct, types, fills, outliers, drops.
FULL_PLAN = [
    Step("drop_constant_column", "currency"),
    Step("handle_outliers", "quantity", {"strategy": "cap"}),
    Step("impute_missing", "quantity", {"strategy": "median"}),
    Step("impute_missing", "priority", {"strategy": "mode"}),
    Step("impute_missing", "order_date", {"strategy": "drop_rows"}),
    Step("coerce_type", "order_date", {"target": "datetime"}),
    Step("coerce_type", "revenue", {"target": "numeric"}),
    Step("deduplicate"),
]
FULL_SQL = (
    f"WITH {PARSED_SQL}, d AS (SELECT DISTINCT order_id, cast(moment AS timestamp) AS order_date, priority, amount AS revenue, quantity, fulfilled FROM parsed), "
    "i AS (SELECT order_id, order_date, coalesce(priority, (SELECT priority FROM d WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority, "
    "revenue, coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM d)) AS quantity, fulfilled FROM d WHERE order_date IS NOT NULL), "
    "f AS (SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3, quantile_cont(quantity, 0.01) AS p01, quantile_cont(quantity, 0.99) AS p99 FROM i) "
)
_cleaned("cleaning_plan", FULL_SQL + "SELECT order_id, order_date, priority, revenue, least(greatest(quantity, p01), p99) AS quantity, fulfilled FROM i, f", *FULL_PLAN)


@query(
    "cleaning_log",
    FULL_SQL
    + ", s AS (SELECT (SELECT count(*) FROM dirty) AS a, (SELECT count(*) FROM d) AS n, (SELECT count(*) - count(order_date) FROM d) AS bad, "
    "(SELECT count(*) - count(quantity) FROM d) AS q, (SELECT count(*) - count(priority) FROM d) AS p, (SELECT count(*) FROM i) AS left_over, "
    "(SELECT count(*) FROM i, f WHERE quantity < q1 - 1.5 * (q3 - q1) OR quantity > q3 + 1.5 * (q3 - q1)) AS o) "
    "SELECT 1 AS step, 'deduplicate' AS rule, NULL AS \"column\", a - n AS rows_affected FROM s "
    "UNION ALL SELECT 2, 'coerce_type', 'order_date', n FROM s UNION ALL SELECT 3, 'coerce_type', 'revenue', n FROM s "
    "UNION ALL SELECT 4, 'impute_missing', 'quantity', q FROM s UNION ALL SELECT 5, 'impute_missing', 'priority', p FROM s "
    "UNION ALL SELECT 6, 'impute_missing', 'order_date', bad FROM s UNION ALL SELECT 7, 'handle_outliers', 'quantity', o FROM s "
    "UNION ALL SELECT 8, 'drop_constant_column', 'currency', left_over FROM s",
)
def cleaning_log(spark, sf):
    log = clean(dirty(spark, sf), FULL_PLAN).log_frame(spark)
    return log.select("step", "rule", "column", "rows_affected")


@query(
    "suggestions",
    PROFILE_SQL
    + ", options AS (SELECT 'deduplicate' AS id, 'deduplicate' AS rule, NULL AS \"column\", NULL AS target, NULL AS strategy, n AS estimated_rows, true AS enabled_by_default, '' AS choices FROM copies WHERE n > 0 "
    "UNION ALL SELECT 'coerce_type:' || name, 'coerce_type', name, suggested_type, NULL, present, true, '' FROM typed WHERE suggested_type IS NOT NULL "
    "UNION ALL SELECT 'impute_missing:' || name, 'impute_missing', name, NULL, CASE WHEN semantic_type = 'numeric' THEN 'median' ELSE 'unknown_label' END, total - present, true, "
    "CASE WHEN semantic_type = 'numeric' THEN 'median,mean,zero,drop_rows' ELSE 'unknown_label,mode,drop_rows' END FROM typed WHERE total > present AND semantic_type NOT IN ('datetime', 'id') "
    "UNION ALL SELECT 'handle_outliers:' || name, 'handle_outliers', name, NULL, 'keep', hits, false, 'keep,cap,remove_rows' FROM typed JOIN outliers USING (name) WHERE semantic_type = 'numeric' AND hits > 0 "
    "UNION ALL SELECT 'drop_constant_column:' || name, 'drop_constant_column', name, NULL, NULL, total, false, '' FROM typed WHERE uniq <= 1 AND present > 0) SELECT * FROM options",
)
def suggestions(spark, sf):
    found = suggest_cleaning(spark, profile_table(dirty(spark, sf)))
    return found.withColumn("choices", F.array_join("strategy_options", ",")).drop("strategy_options")


@query(
    "before_after",
    PROFILE_SQL
    + ", after_rows AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM dirty)), bad AS (SELECT count(*) AS n FROM (SELECT DISTINCT order_id FROM dirty WHERE order_date = 'garbage')) "
    "SELECT 'rows' AS measure, (SELECT max(total) FROM typed) AS before, after_rows.n AS after FROM after_rows "
    "UNION ALL SELECT 'missing_cells', (SELECT cast(sum(total - present) AS bigint) FROM typed), bad.n FROM bad "
    "UNION ALL SELECT 'duplicate_rows', copies.n, 0 FROM copies UNION ALL SELECT 'health', (SELECT cast(round(100 - sum(lost)) AS bigint) FROM capped), NULL",
)
def before_after(spark, sf):
    frame = dirty(spark, sf)
    before = profile_table(frame)
    steps = accepted_steps(suggest_cleaning(spark, before))
    _, _, comparison = clean_and_compare(frame, steps, before)
    return comparison.withColumn("after", F.when(F.col("measure") != "health", F.col("after")))
