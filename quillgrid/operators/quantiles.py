"""Exact percentiles (linear interpolation) by selection over histograms, whatever the size.

Values are put into buckets that keep their order, counted per group with map-side
combining, and only the bucket that holds a wanted rank is looked at again:

* the first pass needs no bounds: 4,096 buckets for each power of two, by sign and logarithm;
* each further pass cuts the values between a bucket's least and greatest into 65,536
  equal parts, so the 52 bits of a fraction are settled after four passes at most, and a
  bucket of a single value (a third of all rows, say) is settled when it is counted.

Rows meet the open buckets by group and bucket, so a group with a third of all rows is
spread over as many tasks as it has buckets. What is ordered in one place is buckets of
one group, never rows. The driver sees whether buckets are open, and for whole columns the
percentiles themselves.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.sources.scratch import written

PER_POWER = 4_096  # buckets of the first pass for each power of two
PARTS = 65_536  # buckets of an open bucket in each further pass


def first_bucket(value: Column, per_power: int = PER_POWER) -> Column:
    """A number that never falls as the value grows; logarithms of doubles lie within 1,075 powers of two."""
    size = F.abs(value)
    mark = F.when(size == float("inf"), F.lit(2 * 1_100 * per_power)).otherwise(F.floor(F.log2(size) * per_power) + 1_100 * per_power)
    signed = F.when(value > 0, mark).otherwise(-mark)
    return F.when(F.isnan(value), F.lit(3 * 1_100 * per_power)).when(value == 0, F.lit(0)).otherwise(signed).cast("bigint")


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))


def _first_pass(rows: DataFrame, keys: list[str], fractions: Sequence[float], per_power: int) -> DataFrame:
    """Per group, fraction and neighbouring rank: the bucket that holds it, the rows before that, its least and greatest value."""
    counted = _counted(rows.withColumn("_b", first_bucket(F.col("_v"), per_power)), [*keys, "_b"])
    group = Window.partitionBy(*keys)
    spans = counted.withColumns({"_upto": F.sum("_n").over(group.orderBy("_b")), "_all": F.sum("_n").over(group)})
    positions = [F.struct(F.lit(k).alias("k"), ((F.col("_all") - 1) * F.lit(float(f))).alias("at")) for k, f in enumerate(fractions)]
    ranks = F.explode(F.array_distinct(F.array(F.floor("_p.at"), F.ceil("_p.at")))).alias("_r")
    before = F.col("_upto") - F.col("_n")
    wanted = spans.select("*", before.alias("_before"), F.explode(F.array(*positions)).alias("_p")).select("*", ranks)
    held = wanted.where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_upto")))
    return held.select(*keys, "_b", "_all", "_p", "_r", "_before", "_low", "_high")


def _next_pass(rows: DataFrame, open_ranks: DataFrame, keys: list[str], per_power: int, parts: int) -> DataFrame:
    """The open ranks with narrower buckets."""
    by = [*keys, "_b", "_before"]
    buckets = open_ranks.select(*by, F.col("_low").alias("_from"), F.col("_high").alias("_to")).distinct()
    near = rows.withColumn("_b", first_bucket(F.col("_v"), per_power)).join(buckets, [*keys, "_b"])
    near = near.where(F.col("_v").between(F.col("_from"), F.col("_to")))
    part = F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * parts).alias("_part")
    counted = _counted(near.select(*by, "_v", part), [*by, "_part"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by).orderBy("_part"))
    spans = counted.withColumn("_upto", upto).withColumn("_start", F.col("_upto") - F.col("_n"))
    held = open_ranks.drop("_low", "_high").join(spans, by).where((F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_upto")))
    return held.select(*keys, "_b", "_all", "_p", "_r", F.col("_start").alias("_before"), "_low", "_high")


def grouped_quantiles(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    into: str = "quantiles",
    size: str = "values",
    per_power: int = PER_POWER,
    parts: int = PARTS,
) -> DataFrame:
    """Per group, an array with one exact percentile per fraction, and how many values it has.

    Keys must not be null (label them first). Rows with a null value are ignored and
    groups without any value are absent. NaN counts as the greatest value.
    """
    keys = list(keys)
    rows = frame.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    held = written(_first_pass(rows, keys, fractions, per_power), "ranks")
    settled = held.where("_low = _high")
    while not (still_open := held.where("_low < _high")).isEmpty():
        held = written(_next_pass(rows, still_open, keys, per_power, parts), "ranks")
        settled = settled.unionByName(held.where("_low = _high"))
    low, high = F.min("_low"), F.max("_low")  # the two neighbours of one position
    weight = F.first("_p.at") - F.floor(F.first("_p.at"))
    between = F.when((weight == 0) | (low == high), low).otherwise(low + (high - low) * weight)
    found = settled.groupBy(*keys, F.col("_p.k").alias("_k")).agg(between.alias("_q"), F.first("_all").alias("_all"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_k", "_q"))), lambda s: s["_q"])
    return found.groupBy(*keys).agg(ordered.alias(into), F.first("_all").alias(size))


def column_quantiles(
    frame: DataFrame, columns: dict[str, Column], fractions: Sequence[float], per_power: int = PER_POWER, parts: int = PARTS
) -> dict[str, list[float | None]]:
    """Percentiles of whole columns, all in the same passes, as driver values: one short list per column.

    The buckets that hold a rank are few here, so they are literals of the next pass and nothing is joined.
    """
    if not columns:
        return {}
    values = [c.cast("double") for c in columns.values()]
    cells = F.array(*[F.struct(F.lit(i).alias("c"), v.alias("_v")) for i, v in enumerate(values)])
    rows = frame.select(F.inline(cells)).where("_v is not null")
    held = [r.asDict() | {"k": r["_p"]["k"], "at": r["_p"]["at"]} for r in _first_pass(rows, ["c"], fractions, per_power).collect()]
    while still_open := [r for r in held if r["_low"] < r["_high"]]:
        buckets = sorted({(r["c"], r["_before"], r["_low"], r["_high"]) for r in still_open})
        found = _narrower(frame, values, buckets, still_open, parts)
        for r in still_open:
            r |= found[(buckets.index((r["c"], r["_before"], r["_low"], r["_high"])), r["_r"])]
    lists: dict[str, list[float | None]] = {n: [None] * len(fractions) for n in columns}
    names = list(columns)
    for r in sorted(held, key=lambda r: r["_r"]):
        before = lists[names[r["c"]]][r["k"]]
        weight = r["at"] - math.floor(r["at"])
        together = r["_low"] if before is None or before == r["_low"] else before + (r["_low"] - before) * weight
        lists[names[r["c"]]][r["k"]] = together
    return lists


def _narrower(frame: DataFrame, values: list[Column], buckets: list[tuple], ranks: list[dict], parts: int) -> dict[tuple[int, int], dict]:
    """By number of bucket and rank: the part of the bucket that holds it."""
    inside = [F.when(values[c].between(low, high), values[c]) for c, _, low, high in buckets]
    cells = F.array(*[F.struct(F.lit(j).alias("_j"), v.alias("_v")) for j, v in enumerate(inside)])
    wanted = [[r["_r"] for r in ranks if (r["c"], r["_before"], r["_low"], r["_high"]) == b] for b in buckets]
    before, low, high = ([b[i] for b in buckets] for i in (1, 2, 3))

    def of(literals: list, kind: str) -> Column:
        return F.element_at(F.lit(literals).cast(f"array<{kind}>"), F.col("_j") + 1)

    rows = frame.select(F.inline(cells)).where("_v is not null")
    part = F.floor((F.col("_v") - of(low, "double")) / (of(high, "double") - of(low, "double")) * parts).alias("_part")
    counted = _counted(rows.select("_j", "_v", part), ["_j", "_part"])
    upto = of(before, "bigint") + F.sum("_n").over(Window.partitionBy("_j").orderBy("_part"))
    spans = counted.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    held = F.filter(of(wanted, "array<bigint>"), lambda r: (r >= F.col("_before")) & (r < F.col("_upto")))
    found = spans.select("_j", "_before", "_low", "_high", F.explode(F.array_distinct(held)).alias("_r")).collect()
    return {(r["_j"], r["_r"]): {k: r[k] for k in ("_before", "_low", "_high")} for r in found}
