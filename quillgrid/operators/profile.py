"""Full table profile in a fixed number of distributed passes.

1. facts          one aggregation over all columns (counts, whole numbers)
2. distinct       one (column, value) shuffle of texts, which are read there once each, and one
                  of the 64 bits of other values; samples. Columns of text that reads as
                  numbers or dates are then written as such, and later passes read those
3. moments        one aggregation over the numeric columns
4. percentiles    quartiles of the numeric columns
5. outliers       one aggregation against literal fences, with Pearson pairs and date ranges
6. ranks          Spearman pairs
7. duplicates     one grouping of whole rows
8. isolation      trees drawn from all complete rows, which are all scored

Only per-column results reach the driver.
"""

import json
from collections.abc import Callable
from dataclasses import asdict, astuple, dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.parsing import column, kind_of, moment_of, number_of, present
from quillgrid.operators import health
from quillgrid.operators.inference import ColumnFacts, Reading, column_facts, read_column, text_facts
from quillgrid.operators.isolation import isolation_outliers
from quillgrid.operators.moments import adjusted_skew, mean, pearson, sample_std
from quillgrid.operators.outliers import iqr_outlier, zscore_outlier
from quillgrid.operators.quantiles import column_quantiles
from quillgrid.operators.ranks import PAIRS_PER_PASS, by_blocks, spearman_pairs
from quillgrid.operators.small import half_up, small_frame
from quillgrid.sources.scratch import written

SAMPLES = 5  # fixed value
FIRST_ROWS = 10_000  # rows that bound the samples from above
SPREAD_BYTES = 256 * 1024 * 1024
SKETCH_BITS = 14  # about 1% error


#: Measures of a numeric column, by the name they have in every result: one aggregate each ...
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": mean,
    "std": sample_std,
    "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"),
    "skew": adjusted_skew,
}
#: ... or one percentile each.
PERCENTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
Measures = dict[str, float | None]


@dataclass
class ColumnProfile:
    """What was counted of a column, how it reads, and what followed from that reading."""

    facts: ColumnFacts
    reading: Reading
    rows: int = 0
    dtype: str = ""
    samples: list[str] = field(default_factory=list)
    measures: Measures | None = None
    #: Outliers by rule.
    outliers: dict[str, int] = field(default_factory=dict)
    #: How many dates, the first and the last.
    dates: tuple[int, str | None, str | None] = (0, None, None)

    name = property(lambda self: self.facts.name)
    semantic_type = property(lambda self: self.reading.semantic)
    unique_count = property(lambda self: self.facts.distinct)
    missing_count = property(lambda self: self.rows - self.facts.present)
    is_constant = property(lambda self: self.facts.present > 0 and self.facts.distinct <= 1)

    def cells(self) -> dict:
        """The row of this column in the table of columns."""
        missing = self.missing_count
        row = {"name": self.name, "stored_type": self.dtype, "sample_values": self.samples}
        row |= dict(zip(("semantic_type", "suggested_type", "parse_success_pct"), astuple(self.reading)))
        row |= {"missing_count": missing, "missing_pct": half_up(missing / self.rows * 100, 2) if self.rows else 0.0}
        row |= {"unique_count": self.unique_count, "is_constant": self.is_constant}
        row |= {f"outlier_count_{rule}": self.outliers.get(rule, 0) for rule in OUTLIER_RULES}
        row |= dict(zip(("valid_dates", "min_date", "max_date"), self.dates))
        return row | {m: (self.measures or {}).get(m) for m in (*AGGREGATES, *PERCENTILES)}


OUTLIER_RULES = ("iqr", "zscore")
_CELL_TYPES = {str: "string", int: "bigint", float: "double", bool: "boolean", list: "array<string>"}
#: Cells that may be null, whose type a row cannot tell.
_OPEN_CELLS = {"suggested_type": str, "parse_success_pct": float, "min_date": str, "max_date": str} | dict.fromkeys((*AGGREGATES, *PERCENTILES), float)


@dataclass
class TableProfile:
    row_count: int
    column_count: int
    file_bytes: int
    duplicate_row_count: int
    columns: list[ColumnProfile]
    # method, column, other column, coefficient
    correlations: list[tuple[str, str, str, float | None]]
    multivariate_outlier_count: int
    health_score: int = 0
    issues: list[dict] = field(default_factory=list)

    def column(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    def of_type(self, *semantic: str) -> list[ColumnProfile]:
        return [c for c in self.columns if c.semantic_type in semantic]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "TableProfile":
        raw = json.loads(text)
        for c in raw["columns"]:
            c |= {"facts": ColumnFacts(**c["facts"]), "reading": Reading(**c["reading"]), "dates": tuple(c["dates"])}
        raw["columns"] = [ColumnProfile(**c) for c in raw["columns"]]
        raw["correlations"] = [tuple(r) for r in raw["correlations"]]
        return cls(**raw)

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        """One row per column, its measures as one struct."""
        cells = ColumnProfile(ColumnFacts("", "text", 0), Reading("text")).cells()
        kinds = {n: _CELL_TYPES[_OPEN_CELLS.get(n, type(v))] for n, v in cells.items()}
        flat = small_frame(spark, [list(c.cells().values()) for c in self.columns], ", ".join(f"{n} {k}" for n, k in kinds.items()))
        measures = [*AGGREGATES, *PERCENTILES]
        return flat.withColumn("stats", F.struct(*measures)).drop(*measures)

    def issues_frame(self, spark: SparkSession) -> DataFrame:
        names = ["kind", "severity", "column", "affected_rows", "penalty", "description"]
        return small_frame(
            spark,
            [[i[n] for n in names] for i in self.issues],
            "kind string, severity string, `column` string, affected_rows bigint, "
            "penalty double, description string",
        )

    def correlations_frame(self, spark: SparkSession) -> DataFrame:
        return small_frame(
            spark, self.correlations, "method string, column_a string, column_b string, r double"
        )


def distinct_and_samples(frame: DataFrame, approximate: bool = False) -> tuple[dict, dict]:
    """Distinct counts, and the smallest few values, of every column of text values.

    Rows are turned into (column, value) pairs and de-duplicated in one shuffle, so a
    hot value collapses before it leaves its map task. The approximate form keeps only
    a fixed-size sketch per column and gives no samples.
    """
    names = frame.columns
    if not names:
        return {}, {}
    if approximate:
        sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(column(n), SKETCH_BITS)) for n in names]
        row = [found or 0 for found in frame.agg(*sketches).first()]
        return dict(zip(names, row)), {n: [] for n in names}
    pairs = frame.unpivot([], [column(n) for n in names], "c", "v").where("v is not null").distinct()
    counts = {r["c"]: r["n"] for r in pairs.groupBy("c").agg(F.count("*").alias("n")).collect()}
    return {n: counts.get(n, 0) for n in names}, smallest_texts(frame)


def smallest_texts(frame: DataFrame) -> dict[str, list[str]]:
    """The smallest few different values of every column of text values.

    Any few different values bound the smallest few from above. Those of the first rows keep
    most other values out of the shuffle and the ordering; all rows are compared.
    """
    names = frame.columns
    cells = [column(n).alias(f"c{i}") for i, n in enumerate(names)]
    first = frame.select(*cells).limit(FIRST_ROWS)
    nth = [F.get(F.sort_array(F.collect_set(f"c{i}")), F.lit(SAMPLES - 1)) for i in range(len(names))]
    bounds = first.agg(*nth).first()
    low = [c if b is None else F.when(F.col(f"c{i}") <= b, F.col(f"c{i}")).alias(f"c{i}") for i, (c, b) in enumerate(zip(map(F.col, first.columns), bounds))]
    pairs = frame.select(*cells).select(*low).unpivot([], first.columns, "c", "v").where("v is not null").distinct()
    order = Window.partitionBy("c").orderBy("v")
    kept = pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLES)
    found = kept.groupBy("c").agg(F.sort_array(F.collect_list("v")).alias("samples")).collect()
    return {n: [] for n in names} | {names[int(r["c"][1:])]: r["samples"] for r in found}


def duplicate_rows(frame: DataFrame) -> DataFrame:
    """Rows that repeat another row (missing values compare equal), as one count.

    Digests of 128 bits are counted first, which moves 16 bytes a row and one row per
    repeated digest and task; whole rows are compared only where a digest repeats.
    """
    rows = frame.select(*_groupable(frame))
    cells = [part for n in rows.columns for part in (F.col(n).isNull(), _one_zero(rows, n))]
    marked = rows.select("*", F.xxhash64(*cells).alias("_a"), F.xxhash64(F.lit(1), *cells).alias("_b"))
    again = marked.groupBy("_a", "_b").agg(F.count("*").alias("_n")).where("_n > 1").select("_a", "_b")
    copies = marked.join(again, ["_a", "_b"], "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def _one_zero(rows: DataFrame, name: str) -> Column:
    """The cell with one spelling of zero, as grouping compares it; cells that hash only as text go by it."""
    kind = rows.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.col(name) + F.lit(0.0).cast(kind)
    return F.col(name) if isinstance(kind, T.AtomicType) else F.to_json(F.struct(name))


def _groupable(frame: DataFrame):
    """Columns to group whole rows by; types that cannot be compared go by their text."""
    odd = (T.MapType, T.VariantType)
    return [
        (column(f.name).cast("string") if isinstance(f.dataType, odd) else column(f.name)).alias(f"g{i}")
        for i, f in enumerate(frame.schema.fields)
    ]


def file_bytes(frame: DataFrame) -> int:
    """Size of the files behind the frame; zero when it has none."""
    paths = frame.inputFiles()
    if not paths:
        return 0
    listed = frame.sparkSession.read.format("binaryFile").load(paths)
    return listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def typed_columns(frame: DataFrame, approximate: bool = False) -> tuple[int, list[ColumnFacts], list[Reading], dict]:
    """Passes 1 and 2: what every column is."""
    rows, facts = column_facts(frame, texts=approximate)
    as_text = [_plain_text(frame, f.name).alias(f"c{i}") for i, f in enumerate(facts)]
    if approximate:
        parsed = [
            (number_of(frame, f.name) + F.lit(0.0)).cast("string").alias(f"n{i}")
            for i, f in enumerate(facts)
            if f.numeric_text
        ]
        distinct, samples = distinct_and_samples(frame.select(*as_text, *parsed), approximate)
        for i, f in enumerate(facts):
            f.distinct = min(distinct[f"c{i}"], f.present)
            f.distinct_numbers = distinct.get(f"n{i}", 0)
    elif facts:
        bits = {i: b for i, f in enumerate(facts) if (b := _bits(frame, f.name)) is not None}
        texts = {i: c for i, c in enumerate(as_text) if i not in bits}
        if texts:
            text_facts(_pairs(frame, texts).groupBy("c", "v").agg(F.count("*").alias("n")), facts)
        if bits:
            for r in _pairs(frame, bits).distinct().groupBy("c").agg(F.count("*").alias("n")).collect():
                facts[r["c"]].distinct = r["n"]
        samples = smallest_texts(frame.select(*as_text))
    else:
        samples = {}
    return rows, facts, [read_column(f) for f in facts], {f.name: samples[f"c{i}"] for i, f in enumerate(facts)}


def _pairs(frame: DataFrame, cells: dict[int, Column]) -> DataFrame:
    """One row (c, v) per cell that is not missing; c is the key of the cell's column."""
    named = frame.select(*[c.alias(str(i)) for i, c in cells.items()])
    return named.unpivot([], [column(n) for n in named.columns], "c", "v").where("v is not null").withColumn("c", F.col("c").cast("int"))


def _bits(frame: DataFrame, name: str) -> Column | None:
    """A number of 64 bits for each value, different for different values; None for types that take more or compare by text.

    XXH64 of eight bytes is a one-to-one mapping of them: no two values share a number.
    """
    c, kind = present(frame, name), frame.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = c.cast("double") + F.lit(0.0)  # one spelling of zero
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c).cast("bigint")
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        c = c.cast("bigint")
    elif not isinstance(kind, T.TimestampNTZType):
        return None
    return F.when(c.isNotNull(), F.xxhash64(c))


def _plain_text(frame: DataFrame, name: str):
    c = present(frame, name)
    if isinstance(frame.schema[name].dataType, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(frame.schema[name].dataType)  # one spelling of zero
    return c.cast("string")


def numeric_summary(frame: DataFrame, columns: dict[str, Column]) -> dict[str, Measures]:
    """Passes 3 and 4: the measures of a set of numeric expressions; unrounded."""
    if not columns:
        return {}
    row = iter(frame.agg(*[measure(c) for c in columns.values() for measure in AGGREGATES.values()]).first())
    found = {n: {m: next(row) for m in AGGREGATES} for n in columns}
    for n, cuts in column_quantiles(frame, columns, list(PERCENTILES.values())).items():
        found[n] |= dict(zip(PERCENTILES, cuts))
    return found


def correlation_rows(names: list[str], stats: dict[str, Measures], pairs: dict[str, dict]) -> list:
    """Symmetric long matrix per method, three decimals, null where undefined."""
    rows = []
    for method, found in pairs.items():
        for a in names:
            for b in names:
                if a == b:
                    r = 1.0 if stats[a]["std"] else None
                else:
                    r = found[(a, b)] if (a, b) in found else found[(b, a)]
                rows.append((method, a, b, half_up(r, 3)))
    return rows


def spread_small(frame: DataFrame, size: int) -> DataFrame:
    """A small table as one file per core, so that every pass uses the whole machine.

    A file of a few megabytes is one unit of scan work however many cores there are.
    Tables beyond the size limit are read where they lie.
    """
    if not 0 < size <= SPREAD_BYTES:
        return frame
    return written(frame.repartition(frame.sparkSession.sparkContext.defaultParallelism), "spread")


def read_once(frame: DataFrame, numbers: list[str], moments: list[str]) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """The columns as numbers and as moments. If any of them is text they are written, so that it is read once, not in every pass."""
    cells = {f"n{i}": number_of(frame, n) for i, n in enumerate(numbers)} | {f"m{i}": moment_of(frame, n) for i, n in enumerate(moments)}
    read = frame.select(*[c.alias(n) for n, c in cells.items()])
    if any(kind_of(frame.schema[n].dataType) == "text" for n in [*numbers, *moments]):
        read = written(read, "readings")
    return read, {n: F.col(f"n{i}") for i, n in enumerate(numbers)}, {n: F.col(f"m{i}") for i, n in enumerate(moments)}


def profile_table(frame: DataFrame, approximate: bool = False) -> TableProfile:
    spark = frame.sparkSession
    size = file_bytes(frame)
    frame = spread_small(frame, size)
    rows, facts, readings, samples = typed_columns(frame, approximate)
    dates = [f.name for f, r in zip(facts, readings) if r.semantic == "datetime"]
    measured, numeric, moments = read_once(frame, [f.name for f, r in zip(facts, readings) if r.semantic == "numeric"], dates)
    usable = {
        f.name: f.numbers if f.kind == "text" else f.present for f in facts if f.name in numeric
    }
    stats = numeric_summary(measured, numeric)
    names = list(numeric)
    pairs = list(combinations(names, 2))
    full = {n for n in names if usable[n] == rows}
    tests, bounds = [], []
    for n in names:
        s, c = stats[n], numeric[n]
        rules = {"iqr": iqr_outlier(c, usable[n], s["q1"], s["q3"]), "zscore": zscore_outlier(c, usable[n], s["mean"], s["std"])}
        tests += [F.count_if(rules[r]) for r in OUTLIER_RULES]
    for d in dates:
        m = moments[d]
        bounds += [F.count(m), F.min(m).cast("string"), F.max(m).cast("string")]

    def related(a: str, b: str) -> Column:
        return pearson(numeric[a], numeric[b], full >= {a, b})

    together = [related(*p) for p in pairs[:PAIRS_PER_PASS]]
    found = list(measured.agg(F.count("*"), *tests, *bounds, *together).first())[1:]
    hits, found = found[: len(tests)], found[len(tests) :]
    outliers = {n: dict(zip(OUTLIER_RULES, hits[2 * k : 2 * k + 2])) for k, n in enumerate(names)}
    spans = {d: tuple(found[3 * k : 3 * k + 3]) for k, d in enumerate(dates)}
    pearson_found = dict(zip(pairs, found[len(bounds) :])) | by_blocks(measured, pairs[PAIRS_PER_PASS:], related)
    correlations = []
    if pairs:
        spearman_found = spearman_pairs(measured, numeric)
        correlations = correlation_rows(
            names, stats, {"pearson": pearson_found, "spearman": spearman_found}
        )

    columns = [
        ColumnProfile(
            f, r, rows, frame.schema[f.name].dataType.simpleString(), samples[f.name],
            {m: half_up(v, 4) for m, v in stats[f.name].items()} if f.name in stats else None,
            outliers.get(f.name, {}), spans.get(f.name, (0, None, None)),
        )
        for f, r in zip(facts, readings)
    ]
    result = TableProfile(
        row_count=rows,
        column_count=len(columns),
        file_bytes=size,
        duplicate_row_count=duplicate_rows(frame).first()[0],
        columns=columns,
        correlations=correlations,
        multivariate_outlier_count=isolation_outliers(measured, numeric),
    )
    issues = health.health_issues(result.columns_frame(spark), rows, result.duplicate_row_count)
    result.issues = [r.asDict() for r in issues.collect()]
    result.health_score = health.health_score(result.issues_frame(spark), rows).first()[0]
    return result
