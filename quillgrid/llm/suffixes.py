"""Passages of at least 50 words that stand in more than one place, from a sparse suffix array.

Of every 25 neighbouring places of a text, the one whose next 26 words have the least
hash (the first of equals) is kept, and has the windows of 50 words it was kept for.
Equal windows are kept for at equal places, so the suffixes at the kept places are sorted
over the whole cluster by those 26 words, and only places that share them with a
neighbour go on. Each of their windows says how far the match reaches left and right of
the shared words: one that equals another place's window repeats, and the one that stands
first, by id and place, is the original. Places with equal words lie next to each other,
so this is decided where they lie; only what meets the ends of a partition, or has more
places than one task should hold, is sorted once more by all 50 words.

So every repeated window is found, among edited variants of one text too. Words are cut
where they stand in a copy and in no original: each repeated window stays whole in the
place that keeps it. Where a copy lies between the originals of two other passages, its
words belong to those and stay as well.

Both sorts spread a passage that a third of all texts share over as many partitions as
it needs; the two ends of each partition of the second, and nothing else, are compared
across them on the driver. Windows are equal if two hashes of 64 bits are, of their 26
words and of all 50.

Defined results: null texts and texts under 50 words have no passages; words are what
white space separates, and A-Z count as a-z; a passage repeated within one text counts;
rows equal in id and text are one text standing twice, which keeps its words; rows that
share an id but not the text are texts of their own, told apart by 23 bits of a hash; a
row without an id has no passages; an empty table gives an empty result. Only the id and
the text column are read, and `without_copies` keeps the others.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tokens import SMALL_SLICE, U64, Words, mixed, slices, small_batches, text_bytes, words
from quillgrid.sources.scratch import Scratch, written

LEAST, ANCHOR = 50, 26
WINDOW = LEAST - ANCHOR + 1
BASE = 0x9E3779B97F4A7C15
SUFFIX_ORDER = ("anchor", "id", "place")
SUFFIX_SCHEMA = "anchor long, id long, place long, windows binary"
WINDOW_ORDER = ("anchor", "window", "id", "place")
#: Decided: repeats and copies are set bits for the windows from `place` on. Else an undecided window, which may be known to repeat.
DECIDED_SCHEMA = "anchor long, window long, id long, place long, repeats long, copies long"
MATCH_SCHEMA = "part long, edge string, anchor long, window long, id long, place long, repeats long, copies long"
RANGE_SCHEMA = "kind string, id long, mark long, first long, stop long"
NEVER = U64(2**64 - 1)
#: Rows of a batch, which has up to WINDOW windows for each; places of one anchor that are decided together.
ROWS, TOGETHER = 1 << 13, 1 << 14
#: Words of a text are counted below this; above it a place carries bits of the text's hash.
APART = 1 << 40
MARK = "shiftrightunsigned(xxhash64(text), 41)"


class Runs:
    """Hashes of any run of words, by differences of prefix sums."""

    def __init__(self, hashes: np.ndarray):
        powers = np.cumprod(np.concatenate([[U64(1)], np.full(len(hashes), U64(BASE))]))
        self.inverse = np.cumprod(np.concatenate([[U64(1)], np.full(len(hashes), U64(pow(BASE, -1, 2**64)))]))
        self.sums = np.concatenate([[U64(0)], np.cumsum(hashes * powers[:-1])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])


def sliding(values: np.ndarray, size: int, of, rest) -> np.ndarray:
    """of(values[i : i + size]) for each i; places beyond the end count as rest."""
    padded = np.concatenate([values, np.full(size, rest, values.dtype)])
    width, reach = 1, padded
    while 2 * width <= size:
        reach = of(reach[: len(reach) - width], reach[width:])
        width *= 2
    return of(reach[: len(values)], reach[size - width : size - width + len(values)])


def kept_places(found: Words, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of all texts start, the place that is kept for each, and the hash of the words from any place."""
    n = len(found.hashes)
    stop = np.repeat(found.bounds[1:], found.counts)
    at = np.arange(n)
    able = at + ANCHOR <= stop
    anchors = np.full(n + 1, NEVER)
    anchors[:-1][able] = runs.of(at[able], at[able] + ANCHOR)
    least = sliding(at, WINDOW, lambda a, b: np.where(anchors[a] <= anchors[b], a, b), n)
    starts = np.flatnonzero(at + LEAST <= stop)
    return starts, least[starts], anchors


def suffixes(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One row per kept place: its anchor, its id, the place of its first window (counted in words), the hash of each."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            ids, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, hi in slices(bounds, SMALL_SLICE):
                found = words(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                runs = Runs(found.hashes)
                starts, kept, anchors = kept_places(found, runs)
                # The first least place never moves back, so the windows of a place follow each other.
                opens = np.flatnonzero(np.diff(kept, prepend=-1))
                owner = np.searchsorted(found.bounds, kept[opens], "right") - 1
                hashes = pa.py_buffer(runs.of(starts, starts + LEAST))
                offsets = pa.py_buffer((np.append(opens, len(starts)) * 8).astype(np.int32))
                columns = [
                    pa.array(anchors[kept[opens]].view(np.int64)), pa.array(ids[lo:hi][owner]),
                    pa.array(marks[lo:hi][owner] * APART + starts[opens] - found.bounds[owner], pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(opens), [None, offsets, hashes]),
                ]
                whole = pa.record_batch(columns, names=[*SUFFIX_ORDER, "windows"])
                for i in range(0, whole.num_rows, ROWS):
                    yield whole.slice(i, ROWS)

    rows = documents.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.select("id", "text", F.coalesce(F.expr(MARK), F.lit(0)).alias("mark"))
    return rows.mapInArrow(sampled, SUFFIX_SCHEMA)


def record(columns: list[np.ndarray | None], schema: str, size: int) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    arrays = [pa.nulls(size, pa.int64()) if c is None else pa.array(c) for c in columns]
    return pa.record_batch(arrays, names=names)


def exploded(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: the row it belongs to, its number there, its hash."""
    windows = rows.column(3).to_pylist()
    counts = np.array([len(w) // 8 for w in windows], np.int64)
    after = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(np.arange(len(counts)), counts), after, np.frombuffer(b"".join(windows), np.int64)


def decided(rows: pa.RecordBatch, open_ends: bool = False) -> Iterator[pa.RecordBatch]:
    """Repeats and copies of runs of equal anchors, a bit for each window of a place.

    With open ends the runs go on elsewhere: of equal windows all but the first are copies
    for certain, and the first goes on as a window of its own, marked if it repeats here.
    """
    if not rows.num_rows:
        return
    row, after, hashes = exploded(rows)
    anchors, ids, places = (rows.column(c).to_numpy() for c in range(3))
    run = np.cumsum(np.diff(anchors, prepend=anchors[0]) != 0)
    # The rows are sorted by id and place within a run, and the sort is stable.
    order = np.lexsort((hashes, run[row]))
    same = (hashes[order][1:] == hashes[order][:-1]) & (run[row][order][1:] == run[row][order][:-1])
    copy = np.concatenate([[False], same])
    repeat = copy | np.concatenate([same, [False]])
    if open_ends:
        first = order[~copy]
        columns = [anchors[row[first]], hashes[first], ids[row[first]], places[row[first]] + after[first], repeat[~copy].astype(np.int64), None]
        yield record(columns, DECIDED_SCHEMA, len(first))
        repeat = copy
    bits = np.int64(1) << after[order]
    repeats, copies = (np.bincount(row[order][m], weights=bits[m], minlength=len(ids)).astype(np.int64) for m in (repeat, copy))
    at = np.flatnonzero(repeats)
    yield record([None, None, ids[at], places[at], repeats[at], copies[at]], DECIDED_SCHEMA, len(at))


def shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the sorted suffixes that share their anchor with a neighbour say of their windows.

    Runs of one anchor are decided here. The first and the last run of the partition, which
    may go on in another, and the parts of a run of more than TOGETHER places, pass on one
    row for each different window.
    """
    held: list[pa.RecordBatch] = []  # the run that may go on
    anchor, first, long = None, True, False

    def closed(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, first, long
        if held:
            run = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            open_ends = first or last or long
            if open_ends or run.num_rows > 1:
                yield from decided(run, open_ends)
        held, first, long = [], False, False

    for batch in batches:
        if not batch.num_rows:
            continue
        anchors = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1, [len(anchors)]])
        if anchor is not None and anchor != anchors[0]:
            yield from closed(False)
        held.append(batch.slice(0, int(cuts[1])))
        if len(cuts) > 2:
            yield from closed(False)
            inner = np.diff(cuts[1:-1])
            wanted = np.repeat(inner > 1, inner)
            yield from decided(batch.slice(int(cuts[1]), len(wanted)).filter(pa.array(wanted)))
            held.append(batch.slice(int(cuts[-2])))
        anchor = anchors[-1]
        if sum(part.num_rows for part in held) > TOGETHER:
            run = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield from decided(run, True)
            held, long = [], True
    yield from closed(True)


def equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows that equal a neighbour (repeat) or the one before (copy), and the two ends of the partition."""
    part, held = TaskContext.get().partitionId(), None
    start = True

    def out(rows: list, at: np.ndarray, repeat: np.ndarray, copy: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        columns = [
            pa.array(np.full(len(at), part)), pa.array(edges[at].tolist(), pa.string()), *(pa.array(c[at]) for c in rows[:4]),
            pa.array(repeat[at].astype(np.int64)), pa.array(copy[at].astype(np.int64)),
        ]
        return pa.record_batch(columns, names=[c.split()[0] for c in MATCH_SCHEMA.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(5)]
        if held is not None:
            rows = [np.concatenate([[h], c]) for h, c in zip(held[0], rows, strict=True)]
        same = (rows[0][:-1] == rows[0][1:]) & (rows[1][:-1] == rows[1][1:])
        copy = np.concatenate([[held is not None and held[1]], same])
        edges = np.full(len(same), None, object)
        repeat = copy[:-1] | same | (rows[4][:-1] > 0)
        wanted = repeat.copy()
        if start and len(same):
            wanted[0], edges[0], start = True, "first", False
        at = np.flatnonzero(wanted)
        if len(at):
            yield out(rows, at, repeat, copy, edges)
        held = [c[-1] for c in rows], bool(copy[-1])
    if held is not None:
        copy = np.array([held[1]])
        yield out([np.array([v]) for v in held[0]], np.array([0]), copy | (held[0][4] > 0), copy, np.array(["both" if start else "last"], object))


def across_partitions(edges: list) -> list[tuple]:
    """(id, place, repeats, copies) of the end rows that repeat, within their partition or across to the next.

    edges: two rows per partition at most, in order of partition.
    """
    repeat, copy = [r["repeats"] for r in edges], [r["copies"] for r in edges]
    for i, (before, after) in enumerate(zip(edges, edges[1:], strict=False)):
        if (before["anchor"], before["window"]) == (after["anchor"], after["window"]):
            repeat[i] = repeat[i + 1] = copy[i + 1] = 1
    return [(r["id"], r["place"], e, c) for r, e, c in zip(edges, repeat, copy, strict=True) if e]


def joined(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and stop of the ranges that windows at sorted places cover; touching ones are one."""
    apart = np.diff(at) > LEAST
    return at[np.append(len(at) > 0, apart)[: len(at)]], at[np.append(apart, len(at) > 0)[: len(at)]] + LEAST


def without(ranges: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What these ranges cover and the others do not."""
    edges = np.unique(np.concatenate([*ranges, *others]))

    def covered(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return np.searchsorted(first, edges[:-1], "right") > np.searchsorted(stop, edges[:-1], "right")

    inside = np.flatnonzero(covered(*ranges) & ~covered(*others)) if len(edges) else np.zeros(0, int)
    return edges[inside], edges[inside + 1]


def word_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of each id that repeat, and those to give up, from places sorted by id and place."""

    def ranges(ids: np.ndarray, places: np.ndarray, repeats: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
        bits = np.arange(WINDOW)
        row, bit = np.nonzero(repeats[:, None] >> bits & 1)
        copy = (copies[row] >> bit & 1).astype(bool)
        marks = places // APART
        heads = np.flatnonzero(np.append(True, (np.diff(ids) != 0) | (np.diff(marks) != 0)))
        number = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(ids)))
        at = number[row] * APART + (places % APART)[row] + bit
        order = np.argsort(at, kind="stable")
        at, copy = at[order], copy[order]
        found = {"repeat": joined(at), "copy": without(joined(at[copy]), joined(at[~copy]))}
        first, stop = (np.concatenate([r[i] for r in found.values()]) for i in range(2))
        text = first // APART
        kinds = np.repeat(list(found), [len(r[0]) for r in found.values()])
        columns = [
            pa.array(kinds.tolist(), pa.string()), pa.array(ids[heads[text]]), pa.array(marks[heads[text]]),
            pa.array(first - text * APART), pa.array(stop - text * APART),
        ]
        return pa.record_batch(columns, names=[c.split()[0] for c in RANGE_SCHEMA.split(", ")])

    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(4)]
        # The last id may go on in the next batch.
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last or (waiting and waiting[-1][0][-1] != rows[0][-1]):
            waiting.append([c[:last] for c in rows])
            yield ranges(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
            waiting = []
        waiting.append([c[last:] for c in rows])
    if waiting:
        yield ranges(*(np.concatenate(c) for c in zip(*waiting, strict=True)))


def repeated_ranges(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """kind, id, mark, first, stop (words): ranges that repeat elsewhere (repeat) and those to give up (copy)."""
    spark = documents.sparkSession
    small_batches(spark)
    with Scratch(spark, "suffixes") as scratch:
        ordered = suffixes(documents, key, text).repartitionByRange(*SUFFIX_ORDER).sortWithinPartitions(*SUFFIX_ORDER)
        windows = scratch.written(ordered.mapInArrow(shared_windows, DECIDED_SCHEMA))
        rest = windows.filter("window is not null").select(*WINDOW_ORDER, "repeats")
        ordered = rest.repartitionByRange(*WINDOW_ORDER).sortWithinPartitions(*WINDOW_ORDER)
        found = scratch.written(ordered.mapInArrow(equal_neighbours, MATCH_SCHEMA))
        # Two rows per partition at most.
        ends = found.filter("edge is not null").orderBy("part", F.col("edge") == "last").collect()
        columns = ["id", "place", "repeats", "copies"]
        places = windows.filter("window is null").select(*columns).unionByName(found.filter("edge is null").select(*columns))
        places = places.unionByName(spark.createDataFrame(across_partitions(ends), "id long, place long, repeats long, copies long"))
        places = places.repartition("id").sortWithinPartitions("id", "place")
        return written(places.mapInArrow(word_ranges, RANGE_SCHEMA), "repeated-ranges")


def repeated_passages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, first_word, stop_word, n_words: ranges that repeat elsewhere (repeat) and those to give up (copy)."""
    rows = repeated_ranges(documents, key, text)
    return rows.select(
        F.col("id").alias(key), "kind", F.col("first").alias("first_word"), F.col("stop").alias("stop_word"),
        (F.col("stop") - F.col("first")).alias("n_words"),
    )


def without_copies(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the words of copies cut out that stand in no original; one that was nothing but such words goes.

    A text is cut from the start of a copy's first word to the start of the word after it.
    """
    cuts = repeated_ranges(documents, key, text).filter("kind = 'copy'").groupBy("id", "mark")
    cuts = cuts.agg(F.sort_array(F.collect_list(F.struct("first", "stop"))).alias("cuts"))
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("document")
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), whole)
    # Rows without an id meet no cuts, and are spread by their text.
    mark = F.when(F.col("id").isNull(), -1 - F.expr(MARK)).otherwise(F.expr(MARK))
    rows = rows.withColumn("mark", mark).withColumn("id", F.coalesce("id", F.lit(0))).join(cuts, ["id", "mark"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, ranges in enumerate(batch.column(2).to_pylist()):
                if ranges and texts[i] is not None:
                    texts[i] = remainder(texts[i], [(r["first"], r["stop"]) for r in ranges])
            yield pa.record_batch([pa.array(texts, pa.string()), batch.column(1)], names=["text", "document"])

    kind = rows.schema["document"].dataType.simpleString()
    left = rows.select("text", "document", "cuts").mapInArrow(cut, f"text string, document {kind}")
    gone = (F.trim("text") == "") & (F.trim(F.col(f"document.`{text}`")) != "")
    left = left.filter(~F.coalesce(gone, F.lit(False)))
    return left.select(*(F.col("text" if c == text else f"document.`{c}`").alias(c) for c in documents.columns))


def remainder(text: str, ranges: list[tuple[int, int]]) -> str:
    data = text.encode()
    found = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    edges = [*found.starts.tolist(), len(data)]
    kept, at = [], 0
    for first, stop in ranges:
        # Should 23 bits of a hash not tell two texts of one id apart, the shorter is not overrun.
        kept.append(data[at : max(at, edges[min(first, len(edges) - 1)])])
        at = max(at, edges[min(stop, len(edges) - 1)])
    return b"".join([*kept, data[at:]]).decode()
