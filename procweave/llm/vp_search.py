"""Nearest neighbours by vantage-point trees, one for each shard.

1. A bounded number of pivots, vectors themselves, cut the space into cells: every vector falls to its nearest pivot. A
   cell is dealt to as many shards as its size needs, so a vector that a third of all rows repeat fills many shards,
   not one. Of every shard the nearest and the farthest distance to its pivot are known.
2. Each shard grows one tree, once, and the trees are written as a table.
3. Each query visits one shard of its own cell; its k-th best distance there bounds what may still matter. Then it visits
   those other shards that the triangle inequality cannot rule out, whole shards first by their pivot's ring, subtrees
   inside by their shells: what lies farther off than ``factor`` times the k-th best distance is skipped. Factor 1
   restores exact search; smaller factors skip more. Visits go by block: one tree and a bounded number of queries.
4. Spark ranks the few rows that every visit returns by query.

All distances, in the trees as in the result, are summed component after component in double precision on the original
vectors, so ties and near ties are decided by exactly the reported score.

Defined results: vectors that are null, zero, of another dimension than most, or hold null or non-finite components
take no part, nor do rows with a null vec_id. A query is never its own answer: rows with its vec_id are left out. Queries
that repeat a vec_id count once (by the smallest vector); repeated candidate rows stay separate candidates. Ties go to
the smaller vec_id. Extra columns are not carried. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.shared import materialize

#: Vectors of a shard, bytes of a shard's vectors, queries of a block, vectors of a leaf, the most pivots.
SHARD_ROWS, SHARD_BYTES, BLOCK_ROWS, LEAF_ROWS, PIVOTS = 8192, 32_000_000, 16_384, 64, 256

FOUND = "query_id long, vec_id long, score double"
TREE = "shard int, cell int, low double, high double, ids binary, points binary, nodes binary"
NO_ID = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of all rows of left to all rows of right, squares added in the order of the components."""
    total = np.zeros((len(left), len(right)))
    for a, b in zip(left.T, right.T, strict=True):
        step = np.subtract.outer(a, b)
        total += step * step
    return np.sqrt(total)


class VpTree:
    """A vantage-point tree over rows of a matrix: the rows in the order of the leaves, and nodes.

    A node is (start, stop, vantage row, left, low, high, right, low, high); a leaf has no vantage row (-1). The bounds
    are the distances of each side's nearest and farthest row to the vantage row.
    """

    def __init__(self, points: np.ndarray, nodes: np.ndarray | None = None, seed: int = 7):
        """Grow a tree, or take over the points, in the order of the leaves, and the nodes of one."""
        # Rounding in a distance is relative to the distance, not to the difference of two.
        self.slack = 4 * max(1, points.shape[1]) * np.finfo(float).eps
        self.order = np.arange(len(points))
        self.nodes = self.grow(points, np.random.default_rng(seed)) if nodes is None else nodes
        self.points = points[self.order]

    def grow(self, points: np.ndarray, random: np.random.Generator) -> np.ndarray:
        """Split at the median distance to a random row until leaves are small; equal distances may fall on both sides."""
        order, nodes = self.order, []

        def split(start: int, stop: int) -> int:
            at = len(nodes)
            nodes.append([start, stop, -1, -1, 0, 0, -1, 0, 0])
            if stop - start > LEAF_ROWS:
                rows = order[start:stop]
                vantage = int(rows[random.integers(len(rows))])
                d = distances(points[rows], points[[vantage]])[:, 0]
                half = len(rows) // 2
                cut = np.argpartition(d, half)
                order[start:stop], d = rows[cut], d[cut]
                left, right = split(start, start + half), split(start + half, stop)
                nodes[at] = [start, stop, vantage, left, d[:half].min(), d[:half].max(), right, d[half:].min(), d[half:].max()]
            return at

        split(0, len(points))
        table = np.array(nodes, dtype=np.float64)
        inner = table[:, 2] >= 0
        table[inner, 2] = np.argsort(order)[table[inner, 2].astype(np.int64)]
        return table

    def gap(self, d: np.ndarray, low: float, high: float) -> np.ndarray:
        """By how much everything between low and high must be farther off, as seen from a distance d, at least."""
        return np.maximum(low - d, d - high) - self.slack * (d + high)

    def search(self, queries, query_ids, ids, k: int, factor: float, bound=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest rows of each query within its bound (NO_ID, infinite where there are fewer).

        ids are those of the rows that the tree was made from, in their order.
        """
        ids, bound = ids[self.order], np.full(len(queries), np.inf) if bound is None else bound
        best, found = np.full((len(queries), k), np.inf), np.full((len(queries), k), NO_ID)
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            at, live, gap = stack.pop()
            # Gaps were set when the subtree was found; the k-th best may have come closer since.
            keep = gap <= factor * np.minimum(best[live, -1], bound[live])
            live, gap = live[keep], gap[keep]
            if not live.size:
                continue
            start, stop, vantage, left, low, high, right, out_low, out_high = self.nodes[at]
            if vantage < 0:
                self.visit(np.arange(int(start), int(stop)), live, queries, query_ids, ids, bound, best, found)
                continue
            d = distances(queries[live], self.points[[int(vantage)]])[:, 0]
            inner, outer = np.maximum(gap, self.gap(d, low, high)), np.maximum(gap, self.gap(d, out_low, out_high))
            sides = [(int(left), live, inner), (int(right), live, outer)]
            # The side that most queries are closer to is searched first.
            stack += sides[::-1] if (inner <= outer).mean() >= 0.5 else sides
        return found, best

    def visit(self, leaf, live, queries, query_ids, ids, bound, best, found) -> None:
        d, ids = distances(queries[live], self.points[leaf]), ids[leaf]
        out = (query_ids[live][:, None] == ids[None, :]) | (d > np.minimum(best[live, -1], bound[live])[:, None])
        some = np.flatnonzero(~out.all(axis=1))
        live, d, out = live[some], d[some], out[some]
        both_d = np.concatenate([best[live], np.where(out, np.inf, d)], axis=1)
        both_id = np.concatenate([found[live], np.where(out, NO_ID, ids[None, :])], axis=1)
        order = np.lexsort((both_id, both_d), axis=1)[:, : best.shape[1]]
        best[live], found[live] = np.take_along_axis(both_d, order, axis=1), np.take_along_axis(both_id, order, axis=1)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def with_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot (``cell``) and the distance to it (``far``) to rows with a vector v."""

    @F.pandas_udf("cell int, far double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            d = distances(matrix(v), pivots) if len(v) else np.zeros((0, len(pivots)))
            cell = d.argmin(axis=1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "far": d[np.arange(len(d)), cell]})

    return rows.withColumn("place", nearest("v")).select(*rows.columns, "place.cell", "place.far")


def grow_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's tree as a row. The rows are put in order first, so the tree does not depend on how they arrive."""
    points, ids = matrix(rows["v"]), rows["vec_id"].to_numpy(dtype=np.int64)
    order = np.lexsort((*points.T[::-1], ids))
    tree = VpTree(points[order])
    row = {"shard": rows["shard"].iloc[0], "cell": rows["cell"].iloc[0], "low": rows["far"].min(), "high": rows["far"].max()}
    return pd.DataFrame([row | {"ids": ids[order][tree.order].tobytes(), "points": tree.points.tobytes(), "nodes": tree.nodes.tobytes()}])


def visit_shards(visits: DataFrame, trees: DataFrame, blocks: int, k: int, factor: float) -> DataFrame:
    """Let each query of visits (shard, query_id, v, bound) search its shard's tree; a tree is sent once for each block of queries."""
    asked = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    sent = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    def visit(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if own.empty or asking.empty:
            return none
        row, queries = own.iloc[0], matrix(asking["v"])
        ids = np.frombuffer(row["ids"], dtype=np.int64)
        points = np.frombuffer(row["points"], dtype=np.float64).reshape(len(ids), -1)
        tree = VpTree(points, np.frombuffer(row["nodes"], dtype=np.float64).reshape(-1, 9))
        query_ids = asking["query_id"].to_numpy()
        found, best = tree.search(queries, query_ids, ids, k, factor, asking["bound"].to_numpy())
        asker, place = np.nonzero(found != NO_ID)
        return pd.DataFrame({"query_id": query_ids[asker], "vec_id": found[asker, place], "score": best[asker, place]})

    return sent.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(visit, FOUND)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    most_pivots: int = PIVOTS,
) -> DataFrame:
    """The k nearest vectors of each query: query_id, rank from 1, vec_id, score (Euclidean distance)."""
    made = lambda df, name: df.select(F.col(id_col).cast("long").alias(name), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col(name).isNotNull() & usable(F.col("v")))
    base, asked = made(vectors, "vec_id"), made(queries, "query_id")
    sizes = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]
    base, asked = base.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    asked = asked.groupBy("query_id").agg(F.min("v").alias("v"))
    shard_rows, block_rows = (max(1, min(rows, SHARD_BYTES // (8 * dim))) for rows in (shard_rows, block_rows))
    if n <= shard_rows:
        # One shard holds everything: no pivots, and nothing to skip.
        trees = base.withColumns({"shard": F.lit(0), "cell": F.lit(0), "far": F.lit(0.0)}).groupBy("shard").applyInPandas(grow_shard, TREE)
        visits = asked.withColumns({"shard": F.lit(0), "bound": F.lit(float("inf"))})
        near = visit_shards(visits, trees, max(1, -(-asked.count() // block_rows)), k, factor)
    else:
        near = search_shards(base, asked, dim, n, k, factor, shard_rows, block_rows, most_pivots)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_shards(base: DataFrame, asked: DataFrame, dim: int, n: int, k: int, factor: float, shard_rows: int, block_rows: int, most_pivots: int) -> DataFrame:
    """What every query finds in the shards that it must visit: query_id, vec_id, score."""
    drawn = base.select("v").orderBy(F.xxhash64("vec_id"), "v").limit(min(most_pivots, -(-n // shard_rows))).collect()
    pivots = np.unique(np.array([r["v"] for r in drawn], dtype=np.float64).reshape(len(drawn), dim), axis=0)
    placed = with_cells(base, pivots)
    cells = {r["cell"]: -(-r["count"] // shard_rows) for r in placed.groupBy("cell").count().collect()}
    # Shards are numbered through; those of a cell follow one another. There are at most ``most_pivots`` cells.
    first = dict(zip(sorted(cells), np.cumsum([0, *(cells[c] for c in sorted(cells))]).tolist(), strict=False))
    number = lambda held: F.get(F.array(*[F.lit(held.get(c, 0)) for c in range(len(pivots))]), F.col("cell"))
    # Rows are dealt by a running number, not by a key that may repeat.
    deal = (number(first) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), number(cells))).cast("int")
    trees = materialize(placed.withColumn("shard", deal).groupBy("shard").applyInPandas(grow_shard, TREE), "trees")

    home = (number(first) + F.pmod(F.xxhash64("query_id"), F.greatest(number(cells), F.lit(1)))).cast("int")
    asked = materialize(with_cells(asked, pivots).withColumn("home", home), "queries")
    blocks = max(1, -(-asked.count() // block_rows))
    at_home = asked.select(F.col("home").alias("shard"), "query_id", "v", F.lit(float("inf")).alias("bound"))
    near = materialize(visit_shards(at_home, trees, blocks, k, factor), "near")
    bounds = near.groupBy(F.col("query_id").alias("b_id")).agg(F.when(F.count("*") >= k, F.max("score")).alias("bound"))
    bounded = asked.join(bounds, F.col("query_id") == F.col("b_id"), "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return near.unionByName(visit_shards(visits_of(bounded, trees, pivots, factor), trees, blocks, k, factor))


def visits_of(bounded: DataFrame, trees: DataFrame, pivots: np.ndarray, factor: float) -> DataFrame:
    """The shards besides its home that each query must visit, by their rings around their pivots.

    Cells are looked at first (as many as there are pivots, so their rings travel with the plan), their shards then.
    """
    rings = trees.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    cell, low, high = (np.array([r[c] for r in rings]) for c in ("cell", "low", "high"))
    slack = 4 * pivots.shape[1] * np.finfo(float).eps

    @F.pandas_udf("array<struct<cell: int, d: double>>")
    def reach(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, bound in batches:
            d = distances(matrix(v), pivots[cell]) if len(v) else np.zeros((0, len(cell)))
            live = np.maximum(low - d, d - high) - slack * (d + high) <= factor * bound.to_numpy()[:, None]
            yield pd.Series([[{"cell": int(cell[c]), "d": float(d[i, c])} for c in np.flatnonzero(live[i])] for i in range(len(v))], dtype=object)

    seen = bounded.select("query_id", "home", "v", "bound", F.explode(reach("v", "bound")).alias("to")).select("query_id", "home", "v", "bound", "to.cell", "to.d")
    shards = trees.select(F.col("shard").alias("to_shard"), F.col("cell").alias("of_cell"), "low", "high")
    gap = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high")) - slack * (F.col("d") + F.col("high"))
    met = seen.join(shards, F.col("cell") == F.col("of_cell")).filter((F.col("to_shard") != F.col("home")) & (gap <= factor * F.col("bound")))
    return met.select(F.col("to_shard").alias("shard"), "query_id", "v", "bound")


def op3_vp_tree_search(spark, sf_dir):
    """The ten nearest vectors of every hundredth vector, exactly (factor 1)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM near)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
