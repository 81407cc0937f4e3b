"""Correlation matrices over numeric columns: Pearson, and Spearman by average ranks.

Ranks come from the distinct values of a column, not from ordering all rows: values
are counted once (map-side combining absorbs hot values), put into ranges that keep
their order, numbered within a range, and shifted by the rows in earlier ranges. Rows
where the partner column is missing are left out of the counts, so ranks are exact for
every pair.
"""

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators.moments import pearson
from quillgrid.operators.quantiles import first_bucket
from quillgrid.sources.scratch import scratch_path, written

PAIRS_PER_PASS = 120  # coefficients in one aggregation; more columns take more passes
SALTS = 64
RANGES_PER_POWER, RANGE_PARTS = 256, 16_384
HOT_SHARE = 128  # one in so many rows with one value is hot


def pearson_pairs(
    frame: DataFrame, columns: dict[str, Column], gaps: set[str] | None = None
) -> dict[tuple[str, str], float | None]:
    """All pairs, in blocks of one aggregation each. `gaps` names the columns with missing values."""
    gaps = set(columns) if gaps is None else gaps
    return by_blocks(
        frame, list(combinations(columns, 2)), lambda a, b: pearson(columns[a], columns[b], not gaps & {a, b})
    )


def by_blocks(frame: DataFrame, pairs: list[tuple], measure: Callable[..., Column]) -> dict[tuple, float | None]:
    """A measure of each pair, PAIRS_PER_PASS of them in a pass over the rows."""
    found = {}
    for k in range(0, len(pairs), PAIRS_PER_PASS):
        block = pairs[k : k + PAIRS_PER_PASS]
        found |= dict(zip(block, frame.agg(*[measure(*p) for p in block]).first()))
    return found


def rank_tables(rows: DataFrame, columns: list[str], gaps: list[str], spans: list[tuple[float, float]]) -> DataFrame:
    """Average rank of every distinct value: (c, v, n_all, r_all, and r_<g> per column with gaps).

    `r_<g>` ranks among the rows where g is present. All columns share one shuffle of
    (column, value) pairs. spans: least and greatest value of each column.
    """
    masks = ["all", *gaps]
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(v).alias("v")) for i, v in enumerate(columns)])
    counted = (
        rows.select(F.inline(pairs), *[F.col(g).isNotNull().alias(f"in_{g}") for g in gaps])
        .where("v is not null")
        .groupBy("c", "v")
        .agg(F.count("*").alias("n_all"), *[F.count_if(f"in_{g}").alias(f"n_{g}") for g in gaps])
    )
    counted = counted.withColumn("_range", _value_range(spans))
    ordered = Window.partitionBy("c", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("c").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per column and range; joined on the window's own partitioning.
    shifts = counted.groupBy("c", "_range").agg(*[F.sum(f"n_{m}").alias(f"s_{m}") for m in masks])
    shifts = shifts.select(
        "c", "_range", *[F.coalesce(F.sum(f"s_{m}").over(earlier), F.lit(0)).alias(f"s_{m}") for m in masks]
    )
    inside = counted.withColumns(
        {f"p_{m}": F.coalesce(F.sum(f"n_{m}").over(ordered), F.lit(0)) for m in masks}
    )
    return inside.join(shifts, ["c", "_range"]).select(
        "c",
        "v",
        "n_all",
        *[(F.col(f"s_{m}") + F.col(f"p_{m}") + (F.col(f"n_{m}") + 1) / 2).alias(f"r_{m}") for m in masks],
    )


def _value_range(spans: list[tuple[float, float]]) -> Column:
    """Ranges in the order of the values: by power of two, and by equal parts of the column's span. Between them they cut
    columns of any scale, so a range holds a small share of the distinct values however many there are."""
    v, part = F.col("v"), F.lit(0)
    for i, (low, high) in enumerate(spans):
        if low is not None and low < high and math.isfinite(high - low):
            part = F.when((F.col("c") == i) & v.between(low, high), F.floor((v - low) / (high - low) * RANGE_PARTS)).otherwise(part)
    return F.struct(first_bucket(v, RANGES_PER_POWER).alias("power"), part.cast("bigint").alias("part"))


def spearman_pairs(frame: DataFrame, columns: dict[str, Column], hot_share: int = HOT_SHARE) -> dict[tuple[str, str], float | None]:
    """All pairs: ranks are joined to the rows by value, then correlated in one pass.

    The rank tables are written first, so their sizes are known when the joins are
    planned: columns with few values are joined without moving the rows. The rows of a
    value that fills more than one in `hot_share` of them, and rows without a value, are
    salted over several join keys, and the few hot rank rows are repeated once per salt.
    """
    names = list(columns)
    if len(names) < 2:
        return {}
    ids = range(len(names))
    values = [f"v{i}" for i in ids]
    rows = frame.select(
        *[columns[n].cast("double").alias(v) for n, v in zip(names, values)],
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    total, *found = rows.agg(F.count("*"), *[f(v) for v in values for f in (F.count, F.min, F.max)]).first()
    gaps = [v for k, v in enumerate(values) if found[3 * k] < total]
    spans = [(found[3 * k + 1], found[3 * k + 2]) for k in ids]
    path = scratch_path(frame.sparkSession, "ranks")
    rank_tables(rows, values, gaps, spans).write.partitionBy("c").parquet(path)
    stored = frame.sparkSession.read.parquet(path)
    # Fewer than hot_share values of each column.
    hot_rows = stored.where(F.col("n_all") * hot_share > total).select("c", "v").collect()

    ranked = rows
    for i, v in zip(ids, values):
        table = stored.where(F.col("c") == i).select(
            F.col("v").alias(v), *[F.col(f"r_{m}").alias(f"{v}_{m}") for m in ["all", *gaps] if m != v]
        )
        hot = F.col(v).isin([r["v"] for r in hot_rows if r["c"] == i])
        on = [v]
        if v in gaps or any(r["c"] == i for r in hot_rows):
            salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            table = table.withColumn("_s", F.explode(salts))
            ranked = ranked.withColumn("_s", F.when(hot | F.col(v).isNull(), F.col("_salt")).otherwise(0))
            on = [v, "_s"]
        ranked = ranked.join(table, on, "left").drop("_s")

    def rank(v: str, partner: str) -> Column:
        return F.col(f"{v}_{partner}" if partner in gaps else f"{v}_all")

    def off_center(v: str) -> Column:
        return F.col(f"{v}_all") - F.lit((total + 1) / 2)  # average ranks of all rows have this mean

    def pair(a: str, b: str) -> Column:
        if a not in gaps and b not in gaps:
            x, y = off_center(a), off_center(b)
            return F.sum(x * y) / F.nullif(F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)), F.lit(0.0))
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return pearson(F.when(both, rank(a, b)), F.when(both, rank(b, a)))

    pairs = list(combinations(ids, 2))
    if len(pairs) > PAIRS_PER_PASS:  # joined once, read by every pass
        ranked = written(ranked, "ranked")
    found = by_blocks(ranked, pairs, lambda i, j: pair(values[i], values[j]))
    return {(names[i], names[j]): r for (i, j), r in found.items()}
