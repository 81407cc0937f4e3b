"""Nearest vectors by largest inner product, from randomly rotated one-bit codes.

A vector is its distance from the mean times a unit vector; the unit vector is rotated
and only its signs are kept, with one scalar: how well the signs align with it. From the
packed signs alone an inner product is estimated, with an error that is bounded with
overwhelming probability. Exact products are taken of the best estimates first, and then
of every vector whose upper bound still reaches the k-th best of those.

Every row is indexed; only the mean is a statistic, over all rows. Queries and vectors
meet in blocks of bounded size, and each block returns its k best per query, so no task
holds all of either side.

Defined results: vectors that are null, of another length than most, zero, or hold a
null or non-finite component take no part, and neither do rows without an id; rows that
repeat an id count once, with the smallest vector; ties go to the smaller id; with fewer
candidates than k, all are returned; an empty table gives an empty result. Only the id
and the vector column are read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INDEX_SCHEMA = "id long, vector array<double>, code binary, radius double, align double"
FOUND_SCHEMA = "query_id long, vec_id long, score double"
#: Standard deviations of the estimate's error within which an inner product is expected.
ERROR_BOUND = 3.0
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 8192, 2048
SIGNS = 1.0 - 2.0 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random rotation into the next multiple of eight dimensions."""
    padded = -(-dims // 8) * 8
    turned, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((padded, padded)))
    return turned[:dims]


def sound_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vector: one row per id, all of the commonest length."""
    entries = F.col("vector")
    finite = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = sound.filter(F.col("id").isNotNull() & entries.isNotNull() & finite & F.exists(entries, lambda x: x != 0))
    lengths = sound.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    sound = sound.filter(F.size("vector") == (lengths["n"] if lengths else 0))
    return sound.groupBy("id").agg(F.min("vector").alias("vector"))


def mean_vector(sound: DataFrame) -> np.ndarray:
    first = sound.select(F.size("vector").alias("n")).first()
    if first is None:
        return np.zeros(0)
    return np.array(sound.agg(*(F.avg(F.col("vector")[i]) for i in range(first["n"]))).first())


def one_bit_index(sound: DataFrame, mean: np.ndarray, seed: int) -> DataFrame:
    """Per vector: packed signs, distance from the mean, alignment."""
    turn = rotation(len(mean), seed)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            apart = np.stack(batch["vector"]) - mean
            radius = np.linalg.norm(apart, axis=1)
            turned = apart @ turn / np.maximum(radius, 1e-300)[:, None]
            align = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
            codes = np.packbits(turned < 0, axis=1, bitorder="little")
            yield batch.assign(code=[c.tobytes() for c in codes], radius=radius, align=align)

    return sound.mapInPandas(coded, INDEX_SCHEMA)


def block_search(mean: np.ndarray, seed: int, k: int):
    """The k best exact products of each query within a block of indexed vectors."""
    turn = rotation(len(mean), seed)

    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, exact = vectors["id"].to_numpy(), np.stack(vectors["vector"])
        codes = np.frombuffer(b"".join(vectors["code"]), np.uint8).reshape(len(ids), -1).T.copy()
        radius, align = vectors["radius"].to_numpy(), np.maximum(vectors["align"].to_numpy(), 1e-300)
        dims = turn.shape[1]
        spread = radius * np.sqrt(np.maximum(1 / align**2 - 1, 0) / max(dims - 1, 1)) * ERROR_BOUND
        found = []
        for query_id, query in zip(queries["id"], queries["vector"], strict=True):
            turned = query @ turn
            tables = SIGNS @ turned.reshape(-1, 8).T / np.sqrt(dims)
            signs = sum(tables[c, j] for j, c in enumerate(codes))
            estimate = mean @ query + radius * signs / align
            upper = estimate + spread * np.linalg.norm(query)
            estimate[ids == query_id] = upper[ids == query_id] = -np.inf
            pool = min(4 * k, len(ids))
            first = np.argpartition(-estimate, pool - 1)[:pool]
            first = first[ids[first] != query_id]
            scores = (exact[first] * query).sum(axis=1)
            reach = np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf
            again = np.flatnonzero((upper >= reach) & (ids != query_id))
            scores = (exact[again] * query).sum(axis=1)
            best = np.lexsort((ids[again], -scores))[:k]
            found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[again][best], "score": scores[best]}))
        return pd.concat(found)

    return search


def search_blocks(index: DataFrame, queries: DataFrame, mean: np.ndarray, seed: int, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k best of each block of vectors."""
    lanes = -(-index.count() // VECTORS_PER_BLOCK) or 1
    groups = -(-queries.count() // QUERIES_PER_BLOCK) or 1

    def copied(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    lane, group = F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"), F.pmod(F.hash("id"), F.lit(groups))
    left = index.select("*", lane.alias("lane"), copied("part", groups))
    right = queries.select("id", "vector", group.alias("part"), copied("lane", lanes))
    pairs = left.groupBy("lane", "part").cogroup(right.groupBy("lane", "part"))
    return pairs.applyInPandas(block_search(mean, seed, k), FOUND_SCHEMA)


def nearest(
    rows: DataFrame, chosen: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", seed: int = 5
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose id fulfils `chosen` (of column id)."""
    sound = sound_vectors(rows, key, vector)
    mean = mean_vector(sound)
    index = one_bit_index(sound, mean, seed)
    found = search_blocks(index, sound.filter(chosen), mean, seed, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
