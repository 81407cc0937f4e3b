"""Where the records of delimited files begin and end, found without giving up their splits.

A line break may stand inside a quoted field, so whether a line starts a record depends on
all text before it. Each split of a file is read once, on its own, for both cases: starting
outside a quoted field and starting inside one. What comes out per split is how each case
ends. These pairs are combined along each file by running aggregates, which gives the case
that is true for every split. A second pass then joins lines to records, split by split; a
record that goes over the end of a split comes in fragments that are put together by key.

A quote opens a field only where the field starts; anywhere else in an unquoted field it is
a letter like any other.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.sources.scratch import written

_BORDERS = "path string, block bigint, after_outside boolean, after_inside boolean, rests boolean, crosses boolean, broken boolean"
_PIECES = "path string, opener bigint, block bigint, record string"
_MARK = "﻿"


def lines_of(spark: SparkSession, paths: list[str], encoding: str, line_end: str) -> DataFrame:
    """path, block (start of the split), value: each line. The text source splits bytes; decoding is left to us."""
    reader = spark.read.options(lineSep=line_end)
    if encoding.startswith("UTF-16"):
        reader = reader.option("encoding", encoding)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    return reader.text(paths).select(*place, value.alias("value"))


class Quotes:
    """Follows quoted fields through the lines of one delimiter."""

    def __init__(self, delimiter: str):
        self.opens = re.compile(re.escape(delimiter) + '"')
        self.closes = re.compile('"(?:"|(.?))', re.DOTALL)
        self.delimiter = delimiter

    def inside_after(self, line: str, inside: bool) -> bool:
        """Whether the line ends inside a quoted field, given whether it starts in one."""
        at = 0
        if not inside:
            if line.startswith('"'):
                at, inside = 1, True
            else:
                found = self.opens.search(line)
                at, inside = (found.end(), True) if found else (0, False)
        while inside:
            close = self.closes.search(line, at)
            if close is None:
                return True
            at = close.end()
            if close.group(1) is None:  # a doubled quote stands for itself
                continue
            # The rest of the field is plain text, up to a delimiter.
            opened = self.opens.search(line, close.start() + 1)
            at, inside = (opened.end(), True) if opened else (0, False)
        return False


def split_borders(lines: DataFrame, delimiter: str) -> DataFrame:
    """Per split: the case after its lines for either case before them; rests: a line break outside quotes is met even
    when it starts inside; crosses: a record goes over a line break when it starts outside; broken: some line is not UTF-8."""

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(delimiter)
        place: tuple[str, int] | None = None
        state = [False, True, False, False, False]

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([v]) for v in (*place, *state)], names=[c.split()[0] for c in _BORDERS.split(", ")])

        for batch in batches:
            paths, blocks, values, broken = (batch.column(i) for i in range(4))
            ends = pc.run_end_encode(pa.array(blocks)) if batch.num_rows else None
            start = 0
            for stop in _run_stops(paths, ends):
                here = paths[start].as_py(), blocks[start].as_py()
                if here != place:
                    if place is not None:
                        yield out()
                    place, state = here, [False, True, False, False, False]
                state[4] |= bool(pc.any(broken.slice(start, stop - start)).as_py())
                part = values.slice(start, stop - start)
                if part.null_count < len(part):  # a line without any quote changes nothing
                    for line in part.drop_null().to_pylist():
                        line = line.removeprefix(_MARK)
                        outside = quotes.inside_after(line, state[0])
                        state[1] = outside if state[0] == state[1] else quotes.inside_after(line, state[1])
                        state[0] = outside
                        state[2] |= not state[1]
                        state[3] |= outside
                start = stop
        if place is not None:
            yield out()

    quoted = F.when(F.contains("value", F.lit('"')), F.make_valid_utf8("value"))
    rows = lines.select("path", "block", quoted.alias("value"), (~F.is_valid_utf8("value")).alias("broken"))
    return rows.mapInArrow(followed, _BORDERS)


def _run_stops(paths: pa.Array, ends: pa.Array | None) -> list[int]:
    """Where runs of equal path and block end."""
    if ends is None:
        return []
    other = pc.run_end_encode(paths.cast(pa.string()))
    return sorted({*ends.run_ends.to_pylist(), *other.run_ends.to_pylist()})


def split_starts(borders: DataFrame) -> DataFrame:
    """path, block, inside (the split starts in a quoted field), opener (the split whose record it goes on with), and
    ends_inside. Splits that end the same way in both cases forget what came before; the others turn the case over
    or leave it as it is, so a running count of turns since the last such split decides."""
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    settled = F.col("after_outside") == F.col("after_inside")
    turns = (F.col("after_outside") & ~F.col("after_inside")).cast("int")
    counted = borders.withColumn("turns", F.sum(turns).over(order))
    known = F.when(settled, F.struct(F.col("after_outside").cast("int").alias("case"), "turns"))
    counted = counted.withColumn("known", F.last(known, ignorenulls=True).over(before))
    so_far = F.coalesce(F.last("turns").over(before), F.lit(0))
    case = F.coalesce("known.case", F.lit(0)) + so_far - F.coalesce("known.turns", F.lit(0))
    placed = counted.withColumn("inside", case % 2 == 1)
    ends = F.when(F.col("inside"), F.col("after_inside")).otherwise(F.col("after_outside"))
    placed = placed.withColumn("ends_inside", ends)
    opened = F.when(F.col("ends_inside") & (~F.col("inside") | F.col("rests")), F.col("block"))
    opener = F.when(F.col("inside"), F.last(opened, ignorenulls=True).over(before))
    return placed.select("path", "block", "inside", opener.alias("opener"), "ends_inside")


def joined_records(lines: DataFrame, starts: DataFrame, delimiter: str) -> DataFrame:
    """record: every record but each file's first, which is its header. Blank lines between records are left out."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(delimiter)
        place: tuple[str, int] | None = None
        inside = first = False
        opener: int | None = None
        held: list[str] = []
        out: list[tuple] = []

        def fragment() -> list[tuple]:
            # Without its own part, a header that goes over a split is known below.
            return [(place[0], opener, place[1], "\n".join(held))] if held and not first else []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in _PIECES.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for path, block, starts_inside, before, line in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (path, block) != place:
                    out += fragment()
                    held, place, inside, opener, first = [], (path, block), starts_inside, before, block == 0
                    line = line.removeprefix(_MARK) if first else line
                if not held and not inside:
                    opener = block
                    if not line.strip():
                        continue
                held.append(line)
                inside = quotes.inside_after(line, inside) if '"' in line else inside
                if not inside:
                    if opener != block:
                        out += fragment()
                    elif not first:
                        out.append((None, None, None, "\n".join(held)))
                    held, first = [], False
            yield batch_of(out)
            out = []
        out += fragment()
        yield batch_of(out)

    numbered = lines.withColumn("at", F.monotonically_increasing_id())
    placed = numbered.join(starts.select("path", "block", "inside", "opener"), ["path", "block"])
    placed = placed.sortWithinPartitions("path", "block", "at").select("path", "block", "inside", "opener", "value")
    pieces = written(placed.mapInArrow(joined, _PIECES), "records")
    fragments = F.array_sort(F.collect_list(F.struct("block", "record")))
    long = pieces.where("opener is not null").groupBy("path", "opener").agg(fragments.alias("parts"))
    long = long.where(F.col("parts")[0]["block"] == F.col("opener")).select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return pieces.where("opener is null").select("record").unionAll(long)
