"""Hard negatives: exact top lists of inner products by LEMP's length buckets and sorted coordinate lists.

Rows lie in bands of like length, a band in buckets of bounded size. A bucket holds one
sorted list per coordinate of its unit vectors. A search seeks the largest products within
a window [low, high] of an anchor. A product of at least `low` with a row of the bucket
needs an angle of at most arccos(low / (length of the anchor * longest row)), and so each
coordinate of the row must lie between the cosines of the angle to that axis plus and
minus this one. These feasible ranges are cut out of the lists of the anchor's focus
coordinates (its largest), the rows that stand in all of them are the candidates, and
their products are computed exactly, in whole numbers. A bucket whose longest row cannot
reach `low` is not visited at all.

The first bucket (of the longest rows) is searched first: the k-th best product found
there raises `low` for the search of all buckets. Positives are the first search (the
label of the anchor, no limits), negatives the second (other labels, one window for each
positive). The anchors are a stated query set; they meet all rows in blocks, never in one
task, and each block returns k rows at most per window.

Defined results: rows without id, label or vector, and rows with a null or non-finite
component, take no part; rows equal in id, label and vector count once; other rows of one
id are rows of their own, but never partners of each other; of vectors of different length
the shorter counts as filled up with zeros; a vector of zeros takes part, with products of
zero; ties go to the smaller id; products beyond 64 bits count as the nearest number of 64
bits; an empty table gives an empty result. Columns but id, label and vector are not read.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.sources.scratch import Scratch, written

ROWS_PER_BUCKET, ANCHORS_PER_BLOCK = 8192, 1024
#: Coordinates of an anchor whose lists are used.
FOCUS = 6
#: Room for rounding in bounds of cosines.
SLACK = 1e-6
LEAST, MOST = -(2**63), 2**63 - 1
#: Bands of length are powers of the square root of two; lengths are below 2 ** 80.
NO_LENGTH, BANDS = -1, 160


def whole_vectors(rows: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """id, label, ints, length, band: of the rows that take part, each once."""
    entries = F.col("vector")
    sound = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    finite = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = sound.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & entries.isNotNull()).filter(finite)
    ints = F.transform(entries, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    sound = sound.select("id", "label", ints.alias("ints")).distinct()
    square = F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = sound.withColumn("length", F.sqrt(square))
    band = F.when(F.col("length") > 0, F.least(F.floor(2 * F.log2("length")), F.lit(BANDS))).otherwise(NO_LENGTH)
    return sound.withColumn("band", band.cast("int")).withColumn("row", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Buckets:
    """How many there are, from the longest band down, and the longest row of each."""

    count: int
    longest: Column


def with_buckets(vectors: DataFrame) -> tuple[DataFrame, Buckets]:
    """The rows with the number of their bucket."""
    bands = vectors.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()  # BANDS + 2 rows at most
    count, number, longest = 0, F.lit(None), F.lit(None)
    for band in sorted(bands, key=lambda r: -r["band"]):
        parts = -(-band["n"] // ROWS_PER_BUCKET)
        number = F.when(F.col("band") == band["band"], F.pmod(F.xxhash64("row"), F.lit(parts)) + count).otherwise(number)
        longest = F.when(F.col("bucket") >= count, band["longest"]).otherwise(longest) if count else F.lit(band["longest"])
        count += parts
    return vectors.withColumn("bucket", number.cast("int")), Buckets(count, longest.cast("double"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """One row per vector, filled up with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    rows = np.zeros((len(lists), width), np.int64)
    rows[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return rows


def widest(*columns: pa.ChunkedArray) -> int:
    return max((int(c.combine_chunks().value_lengths().to_numpy().max()) for c in columns if len(c)), default=0)


class Bucket:
    """Rows and, for each coordinate of their unit vectors, the sorted values with the rows they belong to."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, exact: np.ndarray):
        self.ids, self.labels, self.rows, self.exact = ids, labels, rows, exact
        lengths = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
        self.longest = float(lengths.max()) if len(ids) else 0.0
        unit = (rows / np.where(lengths > 0, lengths, 1.0)[:, None]).T
        self.order = np.argsort(unit, axis=1)
        self.values = np.take_along_axis(unit, self.order, axis=1)

    def only(self, label: int) -> "Bucket":
        own = self.labels == label
        return Bucket(self.ids[own], self.labels[own], self.rows[own], self.exact[own])

    def candidates(self, anchor: np.ndarray, low: int) -> np.ndarray | None:
        """Rows whose product with the anchor may reach `low`; None for all of them."""
        if low <= 0:
            return None
        length = math.sqrt(float((anchor.astype(float) ** 2).sum()))
        cosine = low / (length * self.longest) if length * self.longest > 0 else math.inf
        if cosine > 1 + SLACK:
            return np.zeros(0, np.int64)
        reach = math.acos(min(1.0, cosine - SLACK))
        unit = anchor.astype(float) / length
        counts, lists = np.zeros(len(self.ids), np.uint8), 0
        for focus in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            axis = math.acos(max(-1.0, min(1.0, float(unit[focus]))))
            first = np.searchsorted(self.values[focus], math.cos(min(math.pi, axis + reach)) - SLACK, "left")
            stop = np.searchsorted(self.values[focus], math.cos(max(0.0, axis - reach)) + SLACK, "right")
            if stop - first < len(counts):
                counts[self.order[focus, first:stop]] += 1
                lists += 1
        return np.flatnonzero(counts == lists) if lists else None

    def products(self, anchor: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the candidates and their exact products."""
        at = self.candidates(anchor, low)
        if at is None or 2 * len(at) > len(self.ids):
            at = np.arange(len(self.ids))
            return at, whole(self.exact @ anchor)
        return at, whole(self.exact[at] @ anchor)


def whole(products: np.ndarray) -> np.ndarray:
    if products.dtype == object:
        return np.array([max(LEAST, min(MOST, int(p))) for p in products], np.int64)
    return products.astype(np.int64)


def exact_types(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles where every sum of products is below 2 ** 53 and so exact, whole numbers of any size elsewhere."""
    most = [float(np.abs(m.astype(float)).max()) if m.size else 0.0 for m in (rows, anchors)]
    kind = float if most[0] * most[1] * max(1, rows.shape[1]) < 2**53 else object
    return rows.astype(kind), anchors.astype(kind)


def block_search(same_label: bool, k: int):
    """The k best products of each window of each anchor within a bucket."""

    def search(vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []
        if vectors.num_rows and anchors.num_rows:
            width = widest(vectors["ints"], anchors["ints"])
            rows, asked = matrix(vectors["ints"], width), matrix(anchors["ints"], width)
            exact, exact_asked = exact_types(rows, asked)
            whole_bucket = Bucket(vectors["id"].to_numpy(), vectors["label"].to_numpy(), rows, exact)
            of_label: dict[int, Bucket] = {}
            columns = (anchors[c].to_pylist() for c in ("row", "id", "label", "windows"))
            for i, (row, own_id, label, windows) in enumerate(zip(*columns, strict=True)):
                bucket = whole_bucket
                if same_label:
                    bucket = of_label.get(label) or of_label.setdefault(label, whole_bucket.only(label))
                low = min(w["low"] for w in windows)
                at, products = bucket.products(exact_asked[i], low)
                allowed = bucket.ids[at] != own_id
                if not same_label:
                    allowed &= bucket.labels[at] != label
                at, products = at[allowed], products[allowed]
                for window in windows:
                    inside = np.flatnonzero((products >= window["low"]) & (products <= window["high"]))
                    ids, scores = bucket.ids[at[inside]], products[inside]
                    if len(inside) > k:
                        wanted = scores >= np.partition(scores, -k)[-k]
                        ids, scores = ids[wanted], scores[wanted]
                    best = np.lexsort((ids, ~scores))[:k]
                    found.append([np.full(len(best), row), np.full(len(best), window["number"]), ids[best], scores[best]])
        parts = zip(*found, strict=True) if found else [[np.zeros(0)]] * 4
        names = ["row", "number", "id", "score"]
        return pa.table({n: pa.array(np.concatenate(p).astype(np.int64)) for n, p in zip(names, parts, strict=True)})

    return search


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "number").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searched(vectors: DataFrame, buckets: Buckets, queries: DataFrame, same_label: bool, k: int, scratch: Scratch) -> DataFrame:
    """row, number, id, score, rank: the k best rows of each window of each query (row, id, label, ints, length, windows)."""
    queries = scratch.written(queries)
    blocks = -(-queries.count() // ANCHORS_PER_BLOCK) or 1
    search = block_search(same_label, k)
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")

    def over(count: int, asked: DataFrame) -> DataFrame:
        # A bucket is visited if its longest row can reach the lowest window.
        low = F.array_min(F.transform("windows", lambda w: w["low"])).cast("double")
        bound = (F.col("length") * buckets.longest) * (1 + SLACK)
        right = asked.select("row", "id", "label", "ints", "length", "windows", block, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bucket"))
        right = right.filter((low <= 0) | (low <= bound)).drop("length")
        left = vectors.filter(F.col("bucket") < count).select("id", "label", "ints", "bucket", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"))
        pairs = left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block"))
        return ranked(pairs.applyInArrow(search, "row long, number long, id long, score long"), k)

    if not buckets.count:
        return over(1, queries.limit(0))
    # What the first bucket holds raises the lower limits.
    first = over(1, queries).filter(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("reached"))
    raised = F.transform(
        "windows",
        lambda w: F.struct(
            w["number"].alias("number"),
            F.greatest(w["low"], F.element_at("reached", w["number"])).alias("low"),
            w["high"].alias("high"),
        ),
    )
    asked = scratch.written(queries.join(first, "row", "left").withColumn("windows", raised).drop("reached"))
    return scratch.written(over(buckets.count, asked))


def hard_negatives(
    rows: DataFrame, chosen: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    key: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that fulfil `chosen` (of column id).

    Of each anchor's first `positives` rows of its label: the first `negatives` rows of other
    labels whose score is low to high per cent of the positive's. Components are scaled and rounded down.
    """
    with Scratch(rows.sparkSession, "hard-negatives") as scratch:
        vectors = scratch.written(whole_vectors(rows, key, label, vector, scale))
        vectors, buckets = with_buckets(vectors)
        anchors = vectors.filter(chosen).select("row", "id", "label", "ints", "length")
        limits = F.struct(F.lit(0).cast("long").alias("number"), F.lit(LEAST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high"))
        best = searched(vectors, buckets, anchors.withColumn("windows", F.array(limits)), True, positives, scratch)
        best = best.select("row", F.col("rank").cast("long").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        # low * p <= 100 * n <= high * p in whole numbers; no score lies between the parts of a negative one.
        exact = F.col("positive_score").cast("decimal(20,0)")
        window = F.struct(
            "number", F.ceil(exact * low / 100).cast("long").alias("low"), F.floor(exact * high / 100).cast("long").alias("high")
        )
        windows = best.filter("positive_score >= 0").groupBy("row").agg(F.collect_list(window).alias("windows"))
        found = searched(vectors, buckets, anchors.join(windows, "row"), False, negatives, scratch)
        found = found.select("row", "number", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        mined = found.join(best, ["row", "number"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        return written(mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives-result")
