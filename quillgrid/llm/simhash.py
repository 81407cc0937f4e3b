"""SimHash near-duplicates: fingerprints of 64 bits, joined at the words of a covering code (anchor points).

A bit of a fingerprint is the majority of that bit over the XXH64 hashes of a text's
shingles of three words, repeats included. Fingerprints link at three or fewer differing
bits. Two such fingerprints have a half of 32 bits that differs in at most one bit, so
each half has anchors of its own for the threshold of one: 31 bits are a word of the
perfect Hamming code [31, 26] and the last bit is free, a code of covering radius one. A
fingerprint is at home at the anchor nearest to its half, and is copied to every anchor
within covering radius plus threshold, two: at most 17 a half. Of two fingerprints that
link, the copy of one meets the other at its home. (One code over all 64 bits with the
threshold of three would need thousands of copies: the words of a product of nine codes
[7, 4] within reach number some 3,500.)

Equal fingerprints are one class, found by an aggregate. Anchors where no home meets a
copy are dropped after a count. What stands at an anchor is compared in blocks of bounded
size, and each block gives a spanning forest of its links, not the links. Anchors of
several blocks whose members are then still in different components are split further, by
equal quarters of the other half (which differs in at most three bits), and the blocks of
these parts meet pairwise, comparing only members of different components. So a group of
any size is spread over tasks, no link between components is lost, and no group is spelt
out in pairs.

Defined results: null texts, empty texts and those of white space alone have the
fingerprint zero, which is linked like any other; fewer than three words are one shingle;
rows that repeat an id are one document with several fingerprints, which links those; a
row without an id keeps its fingerprint and has no component; an empty table gives an
empty result. Only the id and the text column are read.
"""

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.components import components
from quillgrid.sources.scratch import Scratch, written

SHINGLE, HASH_SEED = 3, 42
#: Fingerprints link at so many differing bits or fewer.
APART = 3
#: Shingles whose bits are counted at once.
PIECE = 1 << 14
ROWS_PER_BLOCK = 2048
#: The most copies of a fingerprint: 17 a half, the first of them its home.
COPIES = 34


def shingle_texts(words: list[bytes]) -> Iterator[bytes]:
    if len(words) < SHINGLE:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(islice(words, j, None) for j in range(SHINGLE)), strict=False))


def fingerprint(text: str | None) -> int:
    """Bytes lower-case and split at exactly A-Z and the six white-space characters of ASCII."""
    shingles = shingle_texts((text or "").encode().lower().split())
    counts, n = np.zeros(64, np.int64), 0
    while True:
        hashes = np.array([xxhash.xxh64_intdigest(s, HASH_SEED) for s in islice(shingles, PIECE)], ">u8")
        if not len(hashes):
            return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprints(documents: DataFrame, key: str, text: str) -> DataFrame:
    """id, print (64 bits as a signed number) of each row."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["id", "print"])

    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(printed, "id long, print long")


def syndromes(halves: np.ndarray) -> np.ndarray:
    """Exclusive or of the numbers, from 1, of the set bits among the low 31; zero for words of the code."""
    found = np.zeros(len(halves), np.int64)
    for bit in range(31):
        found ^= np.where(halves >> bit & 1, bit + 1, 0)
    return found


def code_steps() -> np.ndarray:
    """Per syndrome, what turns a word into the anchors within reach; the first is its home, -1 fills up."""
    steps = np.full((32, COPIES // 2), -1, np.int64)
    for syndrome in range(32):
        home = 1 << (syndrome - 1) if syndrome else 0
        pairs = [(a, a ^ syndrome) for a in range(1, 32) if a < a ^ syndrome] if syndrome else []
        twice = [1 << (a - 1) | 1 << (b - 1) for a, b in pairs]
        found = [home, home | 1 << 31, *twice]
        steps[syndrome, : len(found)] = found
    return steps


STEPS = code_steps()


def anchor_rows(classes: DataFrame) -> DataFrame:
    """anchor, print, id, home: each class at every anchor within reach of its two halves.

    Spark sizes these rows by the classes they are made from, of which each gives up to 34,
    and might broadcast them all; the hint has them joined by sorting.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for half in range(2):
                words = prints >> (32 * half) & 0xFFFFFFFF
                steps = STEPS[syndromes(words)]
                row, copy = np.nonzero(steps >= 0)
                anchors = (words[row] ^ steps[row, copy]) | half << 32
                columns = [pa.array(anchors), pa.array(prints[row]), pa.array(ids[row]), pa.array(copy == 0)]
                yield pa.record_batch(columns, names=["anchor", "print", "id", "home"])

    copies = classes.select("print", "id").mapInArrow(placed, "anchor long, print long, id long, home boolean")
    return copies.hint("merge")


def forest(prints: np.ndarray, groups: np.ndarray) -> list[tuple[int, int]]:
    """Places (a, b) of linked prints that span their components; members of one group count as linked already."""
    found, waiting = [], np.arange(len(prints))
    while len(waiting):
        reached, waiting = [int(waiting[0])], waiting[1:]
        while reached and len(waiting):
            at = reached.pop()
            near = np.bitwise_count(prints[waiting] ^ prints[at]) <= APART
            own = groups[waiting] == groups[at]
            hits = near | own
            found += [(at, int(j)) for j in waiting[near & ~own]]
            reached += waiting[hits].tolist()
            waiting = waiting[~hits]
    return found


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b within each run of rows of equal parts (rows: part, sub, component, print, id); a run has a bounded size."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
        cuts = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        prints, found = rows[3].view(np.uint64), []
        pairs = cuts[:-1][np.diff(cuts) == 2]
        near = (np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= APART) & (rows[2][pairs] != rows[2][pairs + 1])
        found += [(p, p + 1) for p in pairs[near].tolist()]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo > 2:
                found += [(lo + a, lo + b) for a, b in forest(prints[lo:hi], rows[2][lo:hi])]
        a, b = (rows[4][np.array([p[k] for p in found], np.int64)] for k in range(2))
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    waiting: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(5)]
        if waiting is not None:
            rows = [np.concatenate([w, r]) for w, r in zip(waiting, rows, strict=True)]
        # The last run may go on in the next batch.
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links([r[:cut] for r in rows])
        waiting = [r[cut:] for r in rows]
    if waiting is not None:
        yield links(waiting)


def links_within(rows: DataFrame) -> DataFrame:
    """a, b: links of the rows (part, sub, component, print, id) of equal part and sub."""
    ordered = rows.repartition("part", "sub").sortWithinPartitions("part", "sub", "print")
    return ordered.select("part", "sub", "component", "print", "id").mapInArrow(linked, "a long, b long")


def in_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys have a home and another row, and each one's block of at most about ROWS_PER_BLOCK."""
    known = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("home").alias("met")).filter("met and n > 1")
    blocks = known.select(*keys, F.ceil(F.col("n") / ROWS_PER_BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("print"), F.col("blocks"))
    return rows.join(blocks, keys).withColumn("block", block)


def crossing_links(placed: DataFrame, component: DataFrame) -> DataFrame:
    """a, b: links between components that anchors of several blocks hide, block against block."""
    large = placed.filter("blocks > 1").drop("blocks", "block")
    large = large.join(component, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    large = large.drop("node")
    mixed = large.groupBy("anchor").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    large = large.join(mixed.filter("low < high").select("anchor"), "anchor")
    # The other half differs in at most three bits: one of its quarters is equal.
    other = F.when(F.col("anchor") < 1 << 32, F.shiftrightunsigned("print", 32)).otherwise(F.col("print"))
    quarter = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("quarter")
    parts = large.select("*", other.alias("other"), quarter)
    value = F.expr("shiftrightunsigned(other, 8 * quarter) & 255 | quarter * 256")
    parts = in_blocks(parts.withColumn("quarter", value).drop("other"), ["anchor", "quarter"])
    opposite = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("opposite")
    parts = parts.select("*", opposite)
    low, high = F.least("block", "opposite"), F.greatest("block", "opposite")
    sub = F.struct("quarter", low, high)
    return links_within(parts.select(F.col("anchor").alias("part"), F.xxhash64(sub).alias("sub"), "component", "print", "id"))


def print_components(printed: DataFrame, scratch: Scratch) -> DataFrame:
    """print, component: the smallest id that links reach from each print of the rows (id, print)."""
    keyed = printed.filter("id is not null")
    classes = scratch.written(keyed.groupBy("print").agg(F.min("id").alias("id")))
    of_class = keyed.join(classes.select("print", F.col("id").alias("class")), "print")
    same_id = of_class.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("a")).filter("a <> b")
    same_id = of_class.join(same_id.select("id", "b"), "id").select(F.col("class").alias("a"), "b")
    placed = scratch.written(in_blocks(anchor_rows(classes), ["anchor"]))
    # Nobody is in a component yet: the class ids tell all of them apart.
    first = placed.select(F.col("anchor").alias("part"), F.col("block").alias("sub"), F.col("id").alias("component"), "print", "id")
    links = scratch.written(links_within(first).distinct())
    more = crossing_links(placed, components(links, scratch))
    found = components(links.unionByName(more).unionByName(same_id), scratch)
    of_print = classes.join(found, F.col("id") == F.col("node"), "left")
    return of_print.select("print", F.coalesce("component", "id").alias("component"))


def simhash_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable over links)."""
    with Scratch(documents.sparkSession, "simhash") as scratch:
        printed = scratch.written(fingerprints(documents, key, text))
        rows = printed.join(print_components(printed, scratch), "print", "left")
        component = F.when(F.col("id").isNotNull(), F.col("component"))
        digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
        return written(rows.select(F.col("id").alias(key), digits.alias("fingerprint"), component.alias("component_id")), "simhash-result")
