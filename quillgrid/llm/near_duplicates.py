"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full sets.

A document's set holds its distinct shingles of five words. Its signature has 64 slots,
each the low 16 bits of the least hash of the set under one of 64 functions; slots of
two sets differ with the probability 1 - similarity. The slots are split into 16 chunks
of four. Two signatures that differ in at most 31 slots have a chunk that differs in at
most one (31 < 16 * 2), so the keys of every chunk with each of its slots left out in
turn (the allowed chunk errors, enumerated) put all such pairs together. Sets of
similarity 0.75 differ in 16 slots on average and in more than 31 once in 100,000 pairs.

Documents with equal sets are one class, found by an aggregate, and only classes are
joined. A shingle that no other class with a shared key has can be in no intersection
with one, so the count of such lone shingles bounds every similarity of a class from
above, exactly: classes with too many have no links, and the class with the smallest
share of them stands in the middle of its group. Each class is first compared with the
middle of a key it shares; what that leaves in different components is then compared
pair by pair, in blocks of bounded size, by signature distance, by that bound and by
bitmaps: each shingle sets one of 4,096 bits, and a bit that only one of two sets has
stands for at least one shingle that the other lacks, so those bits bound the similarity
from above, exactly, whatever the sizes. The pairs left are confirmed like all links: on
the full sets of whole texts. No link between components is lost, and no group is spelt
out in pairs.

Defined results: texts without words have empty sets and are linked with nothing; fewer
than five words are one shingle; rows that repeat an id are one document with several
sets, which links those; a row without an id is returned unlinked and kept; an empty
table gives an empty result. Only the id and the text column are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.components import components
from quillgrid.llm.tokens import SMALL_SLICE, U64, binary_rows, mixed, random_words, shingles, slices, small_batches, text_bytes, words
from quillgrid.sources.scratch import Scratch, written

SHINGLE = 5
#: Links are sets with LIKE[1] * intersection >= LIKE[0] * union.
LIKE = (75, 100)
SLOTS, CHUNK, BITS = 64, 4, 16
CHUNKS = SLOTS // CHUNK
#: One error allowed in each chunk: more than this many, and every chunk may have two.
FARTHEST = 2 * CHUNKS - 1
PAIRS_PER_GROUP, ROWS_PER_BLOCK = 256, 1024
#: 64-bit words of a set's bitmap.
BIT_WORDS = 64

FACTORS = random_words(SLOTS, 101) | U64(1)
SHIFTS = random_words(SLOTS, 202)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and each text's bounds in them."""
    found, cuts = shingles(words(data, bounds), SHINGLE)
    sets = [np.unique(s) for s in np.split(found, cuts[1:-1])]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of slots per set; a row of zeros for an empty set."""
    full = np.flatnonzero(np.diff(bounds))
    rows = np.zeros((len(bounds) - 1, SLOTS), np.uint16)
    if len(full):
        for slot in range(SLOTS):
            values = ((sets * FACTORS[slot] + SHIFTS[slot]) >> U64(32)).astype(np.uint32)
            rows[full, slot] = np.minimum.reduceat(values, bounds[full])  # the low BITS bits
    return rows


def digests(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits that tell sets apart: two sums of differently mixed members."""
    rows = np.zeros((len(bounds) - 1, 2), U64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        rows[full, 0] = np.add.reduceat(sets, bounds[full])
        rows[full, 1] = np.add.reduceat(mixed(sets ^ U64(0xA5A5A5A5DEADBEEF)), bounds[full])
    return rows


def bitmaps(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of BIT_WORDS words per set; each member sets the bit that its hash names."""
    rows = np.zeros((len(bounds) - 1, BIT_WORDS), U64)
    places = (mixed(sets ^ U64(0x5BD1E995C2B2AE35)) & U64(64 * BIT_WORDS - 1)).astype(np.int64)
    owners = np.repeat(np.arange(len(rows)), np.diff(bounds))
    np.bitwise_or.at(rows, (owners, places >> 6), U64(1) << (places & 63).astype(U64))
    return rows


def signed_documents(documents: DataFrame, key: str, text: str) -> DataFrame:
    """id, n_shingles, digest, signature, bits of each row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for lo, hi in slices(bounds, SMALL_SLICE):
                sets, cuts = shingle_sets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(cuts), pa.int64()),
                    binary_rows(digests(sets, cuts)),
                    binary_rows(signatures(sets, cuts)),
                    binary_rows(bitmaps(sets, cuts)),
                ]
                yield pa.record_batch(columns, names=["id", "n_shingles", "digest", "signature", "bits"])

    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(signed, "id long, n_shingles long, digest binary, signature binary, bits binary")


def slot_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SLOTS)


def bit_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(-1, BIT_WORDS)


def most_common(own: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The most members that a set can share with each of others, by the bits that only one of the two has."""
    lacking = np.bitwise_count(own & ~others).sum(axis=1, dtype=np.int64)
    extra = np.bitwise_count(others & ~own).sum(axis=1, dtype=np.int64)
    return np.minimum(size - lacking, sizes - extra)


def able(most: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with at most so many members in common may be linked."""
    return LIKE[1] * most >= LIKE[0] * (size + sizes - most)


def chunk_keys(classes: DataFrame) -> DataFrame:
    """key, id: for each chunk and each slot of it left out, a hash of the other slots; the last bits number the key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = random_words(CHUNK, 303) | U64(1)
        marks = random_words(CHUNKS * CHUNK, 404)
        for batch in batches:
            slots = slot_rows(batch.column(1)).astype(U64)
            ids = batch.column(0).to_numpy()
            for chunk in range(CHUNKS if len(ids) else 0):
                terms = (slots[:, chunk * CHUNK : (chunk + 1) * CHUNK] + U64(1)) * factors
                for left_out in range(CHUNK):
                    number = chunk * CHUNK + left_out
                    key = mixed((terms.sum(axis=1) - terms[:, left_out]) ^ marks[number])
                    key = (key & ~U64(SLOTS - 1)) | U64(number)
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(ids)], names=["key", "id"])

    return classes.select("id", "signature").mapInArrow(keyed, "key long, id long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """key, id: rows whose key other ids have too. Runs of a key are streamed, with one row held back."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)  # the last row, whose successor is not known yet
        before = None  # the key of the row before it
        for batch in batches:
            rows = np.concatenate([held, [batch.column(0).to_numpy(), batch.column(1).to_numpy()]], axis=1)
            if not rows.shape[1]:
                continue
            as_before = np.concatenate([[rows[0, 0] == before], rows[0, 1:] == rows[0, :-1]])
            kept = np.flatnonzero(as_before[:-1] | as_before[1:])
            yield pa.record_batch([pa.array(rows[0, kept]), pa.array(rows[1, kept])], names=["key", "id"])
            if rows.shape[1] > 1:
                before = rows[0, -2]
            held = rows[:, -1:]
        if held.shape[1] and held[0, 0] == before:
            yield pa.record_batch([pa.array(held[0]), pa.array(held[1])], names=["key", "id"])

    ordered = keys.repartition("key").sortWithinPartitions("key", "id")
    return ordered.mapInArrow(shared, "key long, id long")


def packed_texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """id, packed: compressed texts, which is what the joins move."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = pa.array([squeeze((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.record_batch([batch.column(0), texts], names=["id", "packed"])

    rows = documents.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(packed, "id long, packed binary")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike. A b with many partners is split over groups."""

    def alike(rows: pa.Table) -> pa.Table:
        restore = zstandard.ZstdDecompressor().decompress
        rows = rows.sort_by("id")
        ids = rows.column("id").to_numpy()
        data, bounds = text_bytes(pa.array([restore(p) for p in rows.column("packed").to_pylist()], pa.binary()).cast(pa.string()))
        sets: dict[int, list[np.ndarray]] = {}
        for lo, hi in slices(bounds, SMALL_SLICE):
            members, cuts = shingle_sets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            for i, own in zip(ids[lo:hi].tolist(), np.split(members, cuts[1:-1]), strict=True):
                sets.setdefault(i, []).append(own)
        b = rows.column("b")[0].as_py()
        linked = [a for a in sets if a != b and any(similar(x, y) for x in sets[a] for y in sets.get(b, []))]
        return pa.table({"a": pa.array(linked, pa.int64()), "b": pa.array([b] * len(linked), pa.int64())})

    partners = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_PER_GROUP).alias("groups"))
    placed = pairs.join(partners, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("groups")))
    members = placed.select("b", "part", F.col("a").alias("id"))
    members = members.unionByName(placed.select("b", "part", F.col("b").alias("id")).distinct())
    grouped = members.join(texts, "id").groupBy("b", "part")
    return grouped.applyInArrow(alike, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return either > 0 and LIKE[1] * both >= LIKE[0] * either


def lone_shingles(texts: DataFrame) -> DataFrame:
    """id, lone: how many shingles of each text no other of the texts has."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = batch.column(0).to_numpy()
            plain = pa.array([restore(p) for p in batch.column(1).to_pylist()], pa.binary())
            data, bounds = text_bytes(plain.cast(pa.string()))
            for lo, hi in slices(bounds, SMALL_SLICE):
                sets, cuts = shingle_sets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                owners = np.repeat(ids[lo:hi], np.diff(cuts))
                yield pa.record_batch([pa.array(sets.view(np.int64)), pa.array(owners)], names=["shingle", "id"])

    rows = texts.select("id", "packed").mapInArrow(spread, "shingle long, id long")
    alone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    return alone.groupBy("id").agg(F.count("*").alias("lone"))


def hopeful(shared: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """key, id, size, lone: without the classes whose lone shingles rule out every link."""
    sizes = classes.groupBy("id").agg(F.max("n_shingles").alias("size"), F.count("*").alias("sets"))
    known = sizes.join(lone_shingles(texts), "id", "left")
    # The bound is of one set; an id with several goes without.
    lone = F.when(F.col("sets") == 1, F.coalesce("lone", F.lit(0))).otherwise(F.lit(0))
    known = known.select("id", "size", lone.alias("lone"))
    return shared.join(known.filter(LIKE[1] * (F.col("size") - F.col("lone")) >= LIKE[0] * F.col("size")), "id")


def first_pairs(shared: DataFrame) -> DataFrame:
    """a, b: each class with the middle of its keys that it shares most keys with."""
    middle = F.min(F.struct((F.col("lone") / F.col("size")).alias("share"), "id")).alias("middle")
    led = shared.select("key", "id").join(shared.groupBy("key").agg(middle), "key")
    times = led.filter(F.col("id") != F.col("middle.id")).groupBy("id", "middle").agg((-F.count("*")).alias("fewer"))
    best = F.min(F.struct("fewer", "middle")).alias("best")
    return times.groupBy("id").agg(best).select(F.col("id").alias("a"), F.col("best.middle.id").alias("b"))


def first_shared(differ: np.ndarray) -> np.ndarray:
    """The lowest number among the keys that two signatures share, given where they differ: one key speaks for a pair."""
    in_chunk = differ.reshape(-1, CHUNKS, CHUNK)
    chunk = (in_chunk.sum(axis=2) <= 1).argmax(axis=1)
    return chunk * CHUNK + in_chunk[np.arange(len(differ)), chunk].argmax(axis=1)


def crossing_pairs(shared: DataFrame, component: DataFrame, classes: DataFrame) -> DataFrame:
    """a > b: classes that share a key, lie in different components and may be alike by signature and by bound."""

    def close(rows: pa.Table) -> pa.Table:
        ids, inside = rows.column("id").to_numpy(), rows.column("component").to_numpy()
        sizes = rows.column("size").to_numpy()
        common = sizes - rows.column("lone").to_numpy()
        side, slots = rows.column("block").to_numpy(), slot_rows(rows.column("signature"))
        bits = bit_rows(rows.column("bits"))
        low, high = int(rows.column("low")[0].as_py()), int(rows.column("high")[0].as_py())
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        number = rows.column("key")[0].as_py() % SLOTS
        found = []
        for i in left.tolist():
            hope = able(np.minimum(common[right], common[i]), sizes[i], sizes[right])
            near = right[hope & (inside[right] != inside[i]) & ((ids[right] > ids[i]) | (low != high))]
            differ = slots[near] != slots[i]
            near = near[(differ.sum(axis=1) <= FARTHEST) & (first_shared(differ) == number)]
            near = near[able(most_common(bits[i], sizes[i], bits[near], sizes[near]), sizes[i], sizes[near])]
            found += [(max(ids[i], j), min(ids[i], j)) for j in ids[near]]
        a, b = (pa.array([p[k] for p in found], pa.int64()) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    placed = shared.join(component, F.col("id") == F.col("node"), "left")
    placed = placed.withColumn("component", F.coalesce("component", "id")).drop("node")
    crossing = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    # Each set of an id comes with its own size; no lone shingles are counted for an id with several.
    own = classes.select("id", "signature", "bits", F.col("n_shingles").alias("size"))
    rows = placed.drop("size").join(crossing.select("key"), "key", "left_semi").join(own, "id")
    rows = rows.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("key").orderBy("id")) - 1) / ROWS_PER_BLOCK))
    sizes = rows.groupBy("key").agg(F.max("block").alias("last"))
    # A key's rows meet block by block; nearly every key has one block.
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    rows = rows.join(sizes, "key").select(*rows.columns, other)
    rows = rows.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return rows.groupBy("key", "low", "high").applyInArrow(close, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest id reachable over links), kept (it is that one)."""
    small_batches(documents.sparkSession)
    with Scratch(documents.sparkSession, "near-duplicates") as scratch:
        signed = scratch.written(signed_documents(documents, key, text))
        linkable = signed.filter("id is not null and n_shingles > 0")
        classes = linkable.groupBy("digest", "n_shingles").agg(F.min("id").alias("id"), F.first(F.struct("signature", "bits")).alias("of"))
        classes = classes.select("id", "digest", "n_shingles", "of.signature", "of.bits")
        classes = scratch.written(classes)
        # The sets of an id that is repeated are linked by it, though their texts may differ.
        of_class = linkable.select("id", "digest", "n_shingles").join(
            classes.select(F.col("id").alias("class"), "digest", "n_shingles"), ["digest", "n_shingles"]
        )
        same_id = of_class.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("a"))
        same_id = of_class.join(same_id.filter("a <> b").select("id", "b"), "id").select(F.col("class").alias("a"), "b")

        shared = scratch.written(shared_keys(chunk_keys(classes)))
        wanted = shared.select("id").distinct()
        texts = scratch.written(packed_texts(documents, key, text).join(wanted, "id", "left_semi"))
        shared = scratch.written(hopeful(shared, classes, texts))
        links = scratch.written(confirmed(first_pairs(shared), texts))
        crossing = scratch.written(crossing_pairs(shared, components(links, scratch), classes))
        more = confirmed(crossing, texts)
        found = components(links.unionByName(more).unionByName(same_id), scratch)
        of_set = classes.join(found, F.col("id") == F.col("node"), "left")
        of_set = of_set.select("digest", "n_shingles", F.coalesce("component", "id").alias("component"))
        placed = signed.select("id", "n_shingles", "digest").join(of_set, ["digest", "n_shingles"], "left")
        component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
        placed = placed.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"))
        return written(
            placed.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))), "near-duplicates"
        )


def without_near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest key; rows without a key stay.

    Rows are judged one by one, whether they share a key or not: a row goes by a hash of
    64 bits of its key and text. Of rows that share the smallest key the smaller hash
    stays, of rows equal in both the first in the order of their columns' JSON.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("document")
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), whole)
    rows = rows.withColumn("row", F.when(F.col("key").isNotNull(), F.xxhash64("key", "text")))
    with Scratch(documents.sparkSession, "near-duplicate-rows") as scratch:
        keyed = rows.filter("row is not null").select("row", "key", "text")
        judged = near_duplicates(keyed, "row", "text").select("row", "component_id")
        members = judged.groupBy("row").agg(F.max("component_id").alias("component_id"), F.count("*").alias("times"))
        members = scratch.written(members.join(keyed.groupBy("row").agg(F.min("key").alias("key")), "row"))
        first = members.groupBy("component_id").agg(F.min(F.struct("key", "row")).alias("first"))
        marked = members.join(first, "component_id").select("row", "times", (F.col("row") == F.col("first.row")).alias("stays"))
        marked = written(marked.filter("not stays or times > 1").select("row", "stays"), "near-duplicate-marks")
    lone = rows.join(marked.select("row"), "row", "left_anti").select("document")
    repeated = rows.join(marked.filter("stays").select("row"), "row").groupBy("row")
    repeated = repeated.agg(F.min_by("document", F.to_json("document")).alias("document")).select("document")
    return lone.unionByName(repeated).select("document.*")
