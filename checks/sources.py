"""Files, stored versions, logs and arriving rows, built from the given tables."""

from pyspark.sql import functions as F

from checks.cleaning import FULL_PLAN
from checks.dashboards import _GROUPED
from checks.forecasts import HORIZON, KEY, SERIES_SQL
from checks.registry import DIRTY_SQL, dirty, query, table
from quillgrid.operators import facts
from quillgrid.operators.cleaning import Step, clean
from quillgrid.operators.forecast import prepare_series, run_forecast
from quillgrid.operators.profile import profile_table
from quillgrid.sources.delimited import (
    audit_files,
    file_manifest,
    missing_tokens,
    read_delimited,
    write_csv,
)
from quillgrid.sources.scratch import scratch_path
from quillgrid.sources.versions import VersionStore, preview
from quillgrid.streaming.arrivals import keep_table, running_totals

GLOB = "/*.csv"


@query("csv_round_trip", f"WITH {DIRTY_SQL} SELECT * FROM dirty")
def csv_round_trip(spark, sf):
    """Written with a header, read back without being told the layout or any type."""
    path = scratch_path(spark, "export")
    write_csv(dirty(spark, sf), path)
    return read_delimited(spark, path + GLOB)


def _ragged(spark, sf) -> str:
    """Comma-delimited lines: some with a field too many, some with one too few."""
    k = F.col("o_orderkey")
    line = F.concat_ws(",", k.cast("string"), "o_orderstatus", F.when(k % 19 != 0, F.col("o_totalprice").cast("string")), F.when(k % 17 == 0, F.lit("surplus,field")))
    path = scratch_path(spark, "ragged")
    lines = table(spark, sf, "orders").select(line.alias("id,status,price"))
    lines.write.options(header=True, quote="", sep="\x01").csv(path)
    return path + GLOB


@query(
    "csv_ragged_lines",
    "SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice END AS price FROM orders "
    "WHERE NOT (o_orderkey % 17 = 0)",
)
def csv_ragged_lines(spark, sf):
    """Lines that are too long are skipped; lines that are too short are padded.

    A line that is short one field and carries two surplus ones is too long as well.
    """
    return read_delimited(spark, _ragged(spark, sf))


@query(
    "csv_repaired_names",
    'SELECT o_orderkey AS id, o_custkey AS "value", o_orderstatus AS value_1, o_totalprice AS "Value_2", o_orderpriority AS column_5 FROM orders',
)
def csv_repaired_names(spark, sf):
    """A header with repeated, padded and blank names."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")])
    path = scratch_path(spark, "names")
    lines = table(spark, sf, "orders").select(line.alias("id,value,value, Value ,"))
    lines.write.options(header=True, quote="", sep="\x01").csv(path)
    return read_delimited(spark, path + GLOB)


def _export(spark, sf, label, mark="", **options) -> str:
    """Orders with an accented text column that holds delimiters, written in one layout."""
    k = F.col("o_orderkey")
    note = F.concat(F.lit("né, "), "o_orderpriority", F.when(k % 5 == 0, ' "x"; y|z\tw').otherwise(""))
    rows = table(spark, sf, "orders").select(k.alias(mark + "id"), F.col("o_totalprice").alias("price"), note.alias("note"), "o_orderstatus")
    path = scratch_path(spark, label)
    rows.write.options(header=True, escape='"', **options).csv(path)
    return path + GLOB


_EXPORTED_SQL = (
    "SELECT o_orderkey AS id, o_totalprice AS price, 'né, ' || o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN ' \"x\"; y|z' || chr(9) || 'w' ELSE '' END AS note, "
    "o_orderstatus FROM orders"
)


def _layout_query(name: str, mark: str = "", **options):
    @query(f"csv_{name}", _EXPORTED_SQL)
    def run(spark, sf):
        """Written in this layout, read back without being told."""
        return read_delimited(spark, _export(spark, sf, name, mark, **options))


_layout_query("semicolon", sep=";")
_layout_query("tab", sep="\t", ignoreTrailingWhiteSpace=False)
_layout_query("pipe", sep="|")
_layout_query("latin1", encoding="ISO-8859-1")
_layout_query("utf16", encoding="UTF-16LE")
_layout_query("bom", mark="\ufeff")


@query(
    "csv_empty_surplus",
    "SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 5 > 1",
)
def csv_empty_surplus(spark, sf):
    """Surplus fields make a line too long even where they are empty."""
    k = F.col("o_orderkey")
    price = F.when(k % 3 > 0, F.col("o_totalprice").cast("string")).otherwise("")
    surplus = F.when(k % 5 == 0, ",").when(k % 5 == 1, ",,x").otherwise("")
    line = F.concat_ws(",", k.cast("string"), "o_orderstatus", F.concat(price, surplus))
    path = scratch_path(spark, "surplus")
    table(spark, sf, "orders").select(line.alias("id,status,price")).write.options(header=True, quote="", sep="\x01").csv(path)
    return read_delimited(spark, path + GLOB)


@query(
    "csv_line_breaks",
    "SELECT o_orderkey AS id, 'first' || chr(10) || chr(10) || '\"' || o_orderstatus || '\", ' || o_orderpriority AS note, o_totalprice AS price FROM orders",
)
def csv_line_breaks(spark, sf):
    """Quoted fields with line breaks, doubled quotes and delimiters, in splits that records go over."""
    note = F.concat(F.lit('first\n\n"'), "o_orderstatus", F.lit('", '), "o_orderpriority")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), note.alias("note"), F.col("o_totalprice").alias("price"))
    path = scratch_path(spark, "breaks")
    write_csv(rows, path)
    return read_delimited(spark, path + GLOB)


@query(
    "file_layouts",
    "SELECT * FROM (VALUES ('UTF-8', ',', 'id,status,price'), ('UTF-8', ';', 'id,price,note,o_orderstatus'), ('UTF-16LE', ',', 'id,price,note,o_orderstatus'), "
    "('ISO-8859-1', ',', 'id,price,note,o_orderstatus')) t(encoding, delimiter, header), (SELECT true AS all_bytes_listed)",
)
def file_layouts(spark, sf):
    """Layouts of files written from the orders, by what their first bytes hold."""
    paths = [
        _ragged(spark, sf), _export(spark, sf, "layout", sep=";"), _export(spark, sf, "layout", encoding="UTF-16LE"),
        _export(spark, sf, "layout", encoding="ISO-8859-1"),
    ]
    manifest = file_manifest(audit_files(spark, paths))
    return manifest.groupBy("encoding", "delimiter", F.array_join("header", ",").alias("header")).agg(
        F.bool_and(F.col("length") > 0).alias("all_bytes_listed")
    )


@query(
    "file_audit",
    "WITH p AS (SELECT count(DISTINCT o_orderpriority) AS n FROM orders) SELECT 'large' AS kind, 'too large' AS reject_reason, n AS files FROM p "
    "UNION ALL SELECT 'small', NULL, n FROM p UNION ALL SELECT 'other', 'extension', n FROM p UNION ALL SELECT 'none', 'empty', 1",
)
def file_audit(spark, sf):
    """Orders as one file per priority: whole, one line of each, one line with another ending; and an empty file."""
    path = scratch_path(spark, "audit")
    lines = table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderstatus").alias("value"))
    first = lines.groupBy("o_orderpriority").agg(F.min("value").alias("value"))
    written_as = {"large": (lines, "text"), "small": (first, "text"), "other": (first, "csv")}
    for kind, (rows, form) in written_as.items():
        rows.repartition("o_orderpriority").write.partitionBy("o_orderpriority").format(form).save(f"{path}/{kind}")
    lines.limit(0).select("value").write.text(f"{path}/none")
    places = [f"{path}/{kind}/*/part-*" for kind in written_as] + [f"{path}/none/part-*"]
    audited = audit_files(spark, places, max_bytes=100, extensions=(".txt",))
    kind = F.regexp_extract("path", "/(large|small|other|none)/", 1).alias("kind")
    return audited.groupBy(kind, "reject_reason").agg(F.count("*").alias("files"))


@query(
    "missing_tokens",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN o_orderpriority WHEN o_orderkey % 4 = 2 THEN ' NA' END AS priority FROM orders",
)
def missing_token_cells(spark, sf):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "N/A").when(k == 1, "null").when(k == 2, " NA").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", missing_tokens(raw).alias("priority"))


@query("stored_versions", f"WITH {DIRTY_SQL} SELECT 'cleaned' AS kind, order_id, revenue FROM (SELECT DISTINCT * FROM dirty) UNION ALL SELECT 'raw', order_id, revenue FROM dirty")
def stored_versions(spark, sf):
    """The best version is the cleaned one once it exists; the raw one stays as it was."""
    store = VersionStore(spark, scratch_path(spark, "store"))
    store.write_raw("p1", dirty(spark, sf))
    raw = store.read("p1")
    store.write_cleaned("p1", clean(raw, [Step("deduplicate")]).frame)
    tagged = lambda kind, frame: frame.select(F.lit(kind).alias("kind"), "order_id", "revenue")
    return tagged(store.best_kind("p1"), store.read("p1")).unionByName(tagged("raw", store.read("p1", "raw")))


@query(
    "stored_profile",
    f"WITH {DIRTY_SQL} SELECT count(*) AS row_count, count(*) - count(priority) AS missing_priority, count(DISTINCT revenue) AS distinct_revenue FROM dirty",
)
def stored_profile(spark, sf):
    store = VersionStore(spark, scratch_path(spark, "store"))
    frame = dirty(spark, sf)
    store.write_profile("p1", "raw", profile_table(frame))
    p = store.read_profile("p1")
    return store.spark.range(1).select(
        F.lit(p.row_count).cast("bigint").alias("row_count"),
        F.lit(p.column("priority").missing_count).cast("bigint").alias("missing_priority"),
        F.lit(p.column("revenue").unique_count).cast("bigint").alias("distinct_revenue"),
    )


@query(
    "stored_cleaning_log",
    "SELECT 1 AS run, 1 AS step, 'deduplicate' AS rule UNION ALL SELECT 2, * FROM (VALUES (1, 'deduplicate'), (2, 'coerce_type'), (3, 'coerce_type'), "
    "(4, 'impute_missing'), (5, 'impute_missing'), (6, 'impute_missing'), (7, 'handle_outliers'), (8, 'drop_constant_column'))",
)
def stored_cleaning_log(spark, sf):
    store = VersionStore(spark, scratch_path(spark, "store"))
    frame = dirty(spark, sf)
    store.append_log("p1", 1, clean(frame, [Step("deduplicate")]))
    store.append_log("p1", 2, clean(frame, FULL_PLAN))
    return store.read_log("p1").select(F.col("run").cast("int").alias("run"), "step", "rule")


@query(
    "stored_facts",
    _GROUPED.rstrip() + ", r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, category) AS k FROM g) "
    "SELECT version, dimension, category AS top_name FROM r, (VALUES ('v1'), ('v2')) t(version) WHERE k = 1 AND (version = 'v2' OR dimension = 'priority')",
)
def stored_facts(spark, sf):
    """A second write for a version replaces its facts and leaves other versions alone."""
    store = VersionStore(spark, scratch_path(spark, "store"))
    found = facts.segment_facts(dirty(spark, sf), "revenue", ["fulfilled", "priority"])
    store.replace_facts("v1", "segments", found)
    store.replace_facts("v2", "segments", found)
    store.replace_facts("v1", "segments", found.where("dimension = 'priority'"))
    return store.read_facts("segments").select("version", "dimension", "top_name")


@query(
    "stored_forecasts",
    SERIES_SQL + f"SELECT project, 1 AS run, 'o_totalprice' AS metric, 'ME' AS frequency, {HORIZON} AS horizon, bands.* FROM bands, (VALUES ('p1'), ('p2')) t(project)",
)
def stored_forecasts(spark, sf):
    """Two projects with the same run number; a run that is written again replaces itself."""
    store = VersionStore(spark, scratch_path(spark, "store"))
    made = run_forecast(prepare_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", [KEY]), HORIZON, ["seasonal_naive"])
    for project in ("p1", "p2", "p1"):
        store.append_forecast(project, 1, "o_totalprice", made)
    found = store.read_forecasts().withColumn(KEY, F.col("series")[KEY]).drop("series")
    return found.withColumn("run", F.col("run").cast("int"))


@query("preview_rows", "SELECT * FROM lineitem ORDER BY ALL LIMIT 100")
def preview_rows(spark, sf):
    return preview(table(spark, sf, "lineitem"))


@query("streaming_daily_totals", "SELECT cast(ts AS date) AS period, count(*) AS rows, round(cast(sum(cast(value AS decimal(18,2))) AS double), 2) AS total FROM events GROUP BY 1")
def streaming_daily_totals(spark, sf):
    """The events table read as arriving files; daily totals stored after each batch."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = scratch_path(spark, "totals")
    totals = running_totals(stream, "ts", F.col("value"), "D")
    keep_table(totals, path, scratch_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(path).select("period", "rows", F.round("total", 2).alias("total"))
