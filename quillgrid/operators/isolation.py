"""Multivariate outliers by isolation forest.

Each tree is trained on the rows with its smallest random marks among all complete rows,
one grouped-map task per tree; the finished forest (a fixed number of nodes) is broadcast
and every complete row is scored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators.moments import total

# --- Fixed values ------------------------------------------------------------
MIN_ROWS = 50
SEED = 42
TREES = 100
TREE_ROWS = 256
CUT = 0.5  # scores above are outliers
SPREAD_ROWS = 5_000_000
# -----------------------------------------------------------------------------

_NODE = "tree int, node int, feature int, cut double, size int, depth int"


def _expected_depth(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    deep = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def grow_tree(tree: int, points: np.ndarray) -> pd.DataFrame:
    """Random axis cuts down to the depth limit; node k has children 2k+1 and 2k+2."""
    rng = np.random.default_rng(SEED + tree)
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes, open_nodes = [], [(0, 0, points)]
    while open_nodes:
        node, depth, part = open_nodes.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        choices = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(choices) == 0:
            nodes.append((tree, node, -1, 0.0, len(part), depth))
            continue
        feature = int(rng.choice(choices))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = part[:, feature] <= cut
        nodes.append((tree, node, feature, cut, len(part), depth))
        open_nodes += [(2 * node + 1, depth + 1, part[left]), (2 * node + 2, depth + 1, part[~left])]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "size", "depth"])


def packed(forest: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays by node number; a leaf points back at itself."""
    trees = []
    for _, nodes in forest.groupby("tree"):
        slots = int(nodes["node"].max()) + 1
        feature, cut = np.zeros(slots, dtype=np.int64), np.full(slots, np.inf)
        below, reach = np.arange(slots, dtype=np.int64), np.zeros(slots)
        at, inner = nodes["node"].to_numpy(), (nodes["feature"] >= 0).to_numpy()
        reach[at] = nodes["depth"] + _expected_depth(nodes["size"])
        feature[at[inner]], cut[at[inner]] = nodes["feature"][inner], nodes["cut"][inner]
        below[at[inner]] = 2 * at[inner] + 1
        trees.append((feature, cut, below, reach, int(nodes["depth"].max())))
    return trees


def forest_scores(points: np.ndarray, trees: list[tuple[np.ndarray, ...]], sample_size: int) -> np.ndarray:
    """Anomaly score per point: near 1 isolates early, below 0.5 is ordinary."""
    flat = np.ascontiguousarray(points).ravel()
    row = np.arange(len(points)) * points.shape[1]
    depth = np.zeros(len(points))
    for feature, cut, below, reach, levels in trees:
        here = np.zeros(len(points), dtype=np.int64)
        for _ in range(levels):
            here = below.take(here) + (flat.take(row + feature.take(here)) > cut.take(here))
        depth += reach.take(here)
    return 2.0 ** (-(depth / len(trees)) / float(_expected_depth(sample_size)))


def tree_rows(points: DataFrame, rows: int) -> DataFrame:
    """The training rows of each tree: the TREE_ROWS smallest marks of (row, tree) among all rows.

    Trees come in groups, and a row draws one tree of each group, so a mark is one hash per
    group, not per tree; there are as many groups as keep half as many rows again as each
    tree needs. Only rows whose mark is under the threshold that follows go on to the ordering.
    """
    wanted = 1.5 * TREE_ROWS
    groups = min(TREES, math.ceil(wanted * TREES / rows))
    size = -(-TREES // groups)
    reach = int((1 << 30) * min(1.0, wanted * size / rows))
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)),
        lambda g: F.struct(
            (g * size + F.pmod(F.xxhash64("_u", g), F.lit(size))).cast("int").alias("tree"),
            F.pmod(F.xxhash64(g, "_u"), F.lit(1 << 30)).alias("mark"),
        ),
    )
    near = F.filter(drawn, lambda d: (d["mark"] < reach) & (d["tree"] < TREES))
    marked = points.withColumn("_u", F.rand(SEED)).withColumn("_d", F.explode(near))
    order = Window.partitionBy("tree").orderBy("_m", "_u")
    marked = marked.select("*", F.col("_d.tree").alias("tree"), F.col("_d.mark").alias("_m")).drop("_d")
    return marked.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= TREE_ROWS)


def isolation_scores(frame: DataFrame, columns: dict[str, Column]) -> DataFrame | None:
    """Score of every row that is complete in the columns; None when not applicable."""
    if len(columns) < 2:
        return None
    names = [f"x{i}" for i in range(len(columns))]
    points = frame.select(*[c.cast("double").alias(n) for n, c in zip(names, columns.values())])
    points = points.dropna()
    rows = points.count()
    if rows < MIN_ROWS:
        return None
    per_tree = tree_rows(points, rows)

    def train(group: pd.DataFrame) -> pd.DataFrame:
        return grow_tree(int(group["tree"].iloc[0]), group.sort_values("_k")[names].to_numpy())

    forest = packed(per_tree.groupBy("tree").applyInPandas(train, _NODE).toPandas())
    shared = frame.sparkSession.sparkContext.broadcast(forest)
    used = min(TREE_ROWS, rows)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = forest_scores(batch[names].to_numpy(), shared.value, used)
            yield batch.assign(score=values)

    schema = ", ".join(f"{n} double" for n in names) + ", score double"
    if rows <= SPREAD_ROWS:  # few files, costly scoring: use every core
        points = points.repartition(frame.sparkSession.sparkContext.defaultParallelism)
    scored = points.mapInPandas(score, schema)
    return scored.withColumnsRenamed(dict(zip(names, columns)))


def isolation_outliers(frame: DataFrame, columns: dict[str, Column]) -> int:
    scored = isolation_scores(frame, columns)
    if scored is None:
        return 0
    return scored.agg(total((F.col("score") > CUT).cast("int"))).first()[0]
