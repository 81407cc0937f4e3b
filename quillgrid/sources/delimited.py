"""Delimited text files of unknown layout, read as one table.

The heads of all files are inspected in tasks; files that share a layout are then read
together by the built-in reader, as text, and typed from their whole content. All bytes
decide whether a file is UTF-8, not its head.
"""

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.errors import TableError
from quillgrid.functions.parsing import column
from quillgrid.sources.records import joined_records, lines_of, split_borders, split_starts
from quillgrid.sources.scratch import Scratch
from quillgrid.sources.sniff import SNIFF_BYTES, layout_of

# --- Fixed values ------------------------------------------------------------
EXTENSIONS = (".csv",)
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# -----------------------------------------------------------------------------

_RAW = "_quillgrid_raw"
_MANIFEST = "path string, length bigint, encoding string, delimiter string, line_end string, header array<string>"


def audit_files(
    spark: SparkSession, paths: str | Sequence[str], max_bytes: int | None = None, extensions: Sequence[str] = EXTENSIONS
) -> DataFrame:
    """Every file with the reason it would be refused, if any. Contents are not read."""
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")
    # The source reads no row from an empty file, but lists it.
    names = spark.createDataFrame([(_local_name(f), unquote(f)) for f in listed.inputFiles()], "name string, place string")
    local = F.regexp_replace(F.col("path"), "^file:/+", "/")
    listed = names.join(listed.withColumn("name", local), "name", "left")
    listed = listed.select(F.coalesce("path", "place").alias("path"), F.coalesce("length", F.lit(0)).alias("length"))
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    return listed.withColumn(
        "reject_reason",
        F.when(~extension.isin(*extensions), "extension")
        .when(F.col("length") > F.lit(max_bytes), "too large")
        .when(F.col("length") == 0, "empty"),
    )


def read_head(uri: str, size: int = SNIFF_BYTES) -> bytes:
    from pyarrow import fs

    if uri.startswith("file:"):
        files, path = fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    else:
        files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as stream:
        return stream.read(size)


def file_manifest(files: DataFrame) -> DataFrame:
    """Encoding, delimiter and header of each file, from at most 64 KiB of it."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [layout_of(read_head(p)) for p in batch["path"]]
            yield batch[["path", "length"]].assign(
                encoding=[f.encoding for f in found],
                delimiter=[f.delimiter for f in found],
                line_end=[f.line_end for f in found],
                header=[f.header for f in found],
            )

    return files.select("path", "length").mapInPandas(look, _MANIFEST)


def repair_names(names: Sequence[str]) -> list[str]:
    """Trimmed, never blank, and unique without regard to case."""
    taken: set[str] = set()
    repaired = []
    for place, raw in enumerate(names, start=1):
        base = name = (raw or "").strip() or f"column_{place}"
        copy = 0
        while name.lower() in taken:
            copy += 1
            name = f"{base}_{copy}"
        taken.add(name.lower())
        repaired.append(name)
    return repaired


def _local_name(path: str) -> str:
    """One spelling of a path: without the scheme of local files, escapes undone."""
    return re.sub(r"^file:/+", "/", unquote(path))


def field_count(record: Column, delimiter: str) -> Column:
    """How many fields a record has: its delimiters outside quoted fields, and one."""
    mark = re.escape(delimiter)
    bare = F.regexp_replace(F.replace(record, F.lit('""'), F.lit("")), f'(^|{mark})"[^"]*"', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def _exceptions(borders: DataFrame, starts: DataFrame) -> list[tuple[str, bool, bool]]:
    """Path, broken (some bytes are not UTF-8), crossing (a quoted field holds a line break) of the files where either holds."""
    files = borders.groupBy("path").agg(F.bool_or("broken").alias("broken"), F.bool_or("crosses").alias("crosses"))
    ends = starts.groupBy("path").agg(F.max_by("ends_inside", "block").alias("unclosed"))
    found = files.join(ends, "path").where("broken or crosses").collect()
    for row in found:
        if row["unclosed"]:
            raise TableError(f"{row['path']}: a quoted field is never closed")
    return [(_local_name(r["path"]), r["broken"], r["crosses"]) for r in found]


def read_group(
    spark: SparkSession, paths: list[str], encoding: str, delimiter: str, header: Sequence[str], line_end: str = "\n"
) -> DataFrame:
    """Files of one layout as text columns; rows with too many fields are left out, short rows are padded with nulls.

    One pass over all bytes finds the files that are not UTF-8 after all and those with
    line breaks inside quoted fields. Every file stays splittable.
    """
    with Scratch(spark, "borders") as scratch:
        borders = scratch.written(split_borders(lines_of(spark, paths, encoding, line_end), delimiter))
        starts = scratch.written(split_starts(borders))
        kinds = {path: (broken and encoding == "UTF-8", crosses) for path, broken, crosses in _exceptions(borders, starts)}
        parts: dict[tuple[bool, bool], list[str]] = {}
        for path in paths:
            parts.setdefault(kinds.get(_local_name(path), (False, False)), []).append(path)
        frames = []
        for (broken, crosses), some in sorted(parts.items()):
            used = "ISO-8859-1" if broken else encoding
            if crosses:
                frames.append(_read_records(spark, some, used, delimiter, header, line_end, starts))
            else:
                frames.append(_read_lines(spark, some, used, delimiter, header, line_end))
    return reduce(DataFrame.unionByName, frames)


def _schema(width: int) -> str:
    return ", ".join([*(f"c{i} string" for i in range(width)), f"{_RAW} string"])


def _options(delimiter: str) -> dict[str, str]:
    # A row whose field count is not the header's comes with its raw text.
    return {"sep": delimiter, "escape": '"', "columnNameOfCorruptRecord": _RAW, "mode": "PERMISSIVE"}


def _read_lines(
    spark: SparkSession, paths: list[str], encoding: str, delimiter: str, header: Sequence[str], line_end: str
) -> DataFrame:
    reader = spark.read.schema(_schema(len(header))).options(
        header=True, enforceSchema=True, encoding=encoding, columnPruning=False, **_options(delimiter)
    )
    wide = encoding.startswith("UTF-16")
    if wide or line_end != "\n":
        reader = reader.option("lineSep", line_end)  # keeps wide files splittable
    return _named(reader.csv(paths), delimiter, header, wide)


def _read_records(
    spark: SparkSession, paths: list[str], encoding: str, delimiter: str, header: Sequence[str], line_end: str, starts: DataFrame
) -> DataFrame:
    records = joined_records(lines_of(spark, paths, encoding, line_end), starts, delimiter)
    text = F.regexp_replace("record", "\r$", "")
    parsed = F.from_csv(text, F.lit(_schema(len(header))), _options(delimiter) | {"lineSep": "\n"})
    return _named(records.select(parsed.alias("row")).select("row.*"), delimiter, header, False)


def _named(rows: DataFrame, delimiter: str, header: Sequence[str], wide: bool) -> DataFrame:
    names = repair_names(header)
    kept = rows.where(F.col(_RAW).isNull() | (field_count(F.col(_RAW), delimiter) <= len(names)))
    if wide:
        last = f"c{len(names) - 1}"
        kept = kept.withColumn(last, F.regexp_replace(last, "\r$", ""))
    return kept.select(*[missing_tokens(F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])


def missing_tokens(text: Column) -> Column:
    return F.when(~text.isin(*NA_TOKENS), text)


def settle(frame: DataFrame) -> DataFrame:
    """Drop rows, then columns, without any value, and give each column its stored type.

    A text column becomes boolean, bigint or double when every value reads as one; all
    columns are judged in a single pass.
    """
    whole, real = r"^\s*[+-]?[0-9]{1,18}\s*$", r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    truth = r"^(True|TRUE|true|False|FALSE|false)$"
    rows = frame.dropna(how="all")
    checks = []
    for n in rows.columns:
        c = column(n)
        checks += [F.count(c), *[F.bool_and(c.rlike(p)) for p in (truth, whole, real)]]
    row = rows.agg(*checks).first()
    cells = []
    for i, n in enumerate(rows.columns):
        values, is_truth, is_whole, is_real = row[4 * i : 4 * i + 4]
        kind = "boolean" if is_truth else "bigint" if is_whole else "double" if is_real else "string"
        if values:
            cells.append(column(n).cast(kind).alias(n))
    if not cells:
        raise TableError("no data rows could be read")
    return rows.select(*cells)


def read_delimited(spark: SparkSession, paths: str | Sequence[str], max_bytes: int | None = None) -> DataFrame:
    """One typed table from delimited files; refuses what the audit refuses, files over max_bytes only if it is given."""
    audited = audit_files(spark, paths, max_bytes)
    refused = audited.where("reject_reason is not null").first()
    if refused is not None:
        raise TableError(f"{refused['path']}: {refused['reject_reason']}")
    layouts = (
        file_manifest(audited)
        .groupBy("encoding", "delimiter", "line_end", "header")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
        .orderBy("encoding", "delimiter")
        .collect()
    )
    if not any(g["header"] for g in layouts):
        raise TableError("no header line")
    groups = [
        read_group(spark, g["paths"], g["encoding"], g["delimiter"], g["header"], g["line_end"])
        for g in layouts
        if g["header"]
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    return settle(merged)


def write_csv(frame: DataFrame, path: str) -> None:
    """Header and UTF-8 part files, without a byte-order mark."""
    frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
