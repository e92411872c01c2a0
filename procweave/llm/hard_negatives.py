"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

1. Components become integers; rows are dealt by a running number to shards of a bounded number of rows. A shard holds, for
   every dimension, its rows sorted by that component. Shards are written once and read by both passes.
2. An anchor reads a shard's lists side by side, from the top where its own component is positive and from the bottom where
   it is negative. Every row that comes up is scored at once from its whole vector. What has not come up can score no more
   than the threshold, the anchor's product with the components at which the lists stand.
3. First pass: the best rows of the anchor's own label; the anchor has read enough when the threshold is strictly below the
   k-th best, so rows that tie for it have all come up. Spark ranks what the shards return: the anchor's positives.
4. Second pass: each positive's score opens a window of scores. An anchor has read enough when for each window the threshold
   is strictly below its k-th best row, or below the window itself. Spark ranks what the shards return for each window.

Anchors meet shards in blocks of bounded size, in both passes every block every shard: that is the stated query set against
all rows. Scores are exact: products are sums of doubles below 2**53, and of Python integers where they might be larger.

Defined results: rows with a null id, label or vector, an empty vector, a null or non-finite component, or another dimension
than most take no part. Rows that repeat an id count once, by the smallest (label, vector). Ties go to the smaller id.
Scores beyond a long are cut to its limits. Extra columns are not carried. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.shared import materialize

#: Rows of a shard, bytes of a shard's components, anchors of a block, and rows that the first round reads from each list.
SHARD_ROWS, SHARD_BYTES, BLOCK_ROWS, FIRST_ROWS = 8192, 32_000_000, 4096, 32

#: Components become floor(SCALE * x).
SCALE = 256

#: Of a positive's score, in hundredths: the least and the most that a negative's score may be.
LEAST, MOST = 30, 90

SHARDS = "shard int, ids binary, labels binary, points binary, lists binary"
POSITIVE = "anchor_id long, positive_id long, positive_score long"
NEGATIVE = POSITIVE + ", negative_id long, negative_score long"

LONG = np.iinfo(np.int64)


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


class Lists:
    """Rows of a shard and, for each dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, lists: np.ndarray | None = None):
        self.ids, self.labels, self.points = ids, labels, points
        self.lists = np.argsort(points.T, axis=1, kind="stable").astype(np.int32) if lists is None else lists
        self.largest = np.abs(points).max() if points.size else 0.0

    def best(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores (low, high): ids and scores of its k best allowed rows, ties to the smaller id.

        A window is two comparisons of whole scores: low(score) and high(score) say whether a score is not below and not
        above it.
        """
        points, exact = self.points, self.largest * np.abs(anchor).max() * anchor.size * 100 < 2.0**53
        if not exact:
            anchor, points = np.array([int(x) for x in anchor], dtype=object), None
        live = np.flatnonzero(anchor != 0)
        live = live if live.size else np.array([0])
        up, down = live[anchor[live] > 0], live[anchor[live] <= 0]
        many, seen = len(self.ids), ~allowed
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float64 if exact else object)
        start, stop = 0, min(many, FIRST_ROWS)
        while start < many:
            fresh = np.zeros(many, dtype=bool)
            fresh[self.lists[down, start:stop]] = True
            fresh[self.lists[up, many - stop : many - start]] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            found = points[new] @ anchor if exact else self.whole(new) @ anchor
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, found])
            # The components at which the lists stand.
            edge = np.concatenate([self.points[self.lists[down, stop - 1], down], self.points[self.lists[up, many - stop], up]])
            weight = np.concatenate([anchor[down], anchor[up]])
            threshold = edge @ weight if exact else sum((int(e) * w for e, w in zip(edge, weight, strict=True)), 0)
            if all(self.enough(scores, threshold, window, k) for window in windows):
                break
            start, stop = stop, min(many, stop + 2 * (stop - start))
        return [self.ranked(rows, scores, window, k) for window in windows]

    def whole(self, rows: np.ndarray) -> np.ndarray:
        return np.array([[int(x) for x in row] for row in self.points[rows]], dtype=object).reshape(len(rows), -1)

    @staticmethod
    def enough(scores, threshold, window, k: int) -> bool:
        low, high = window
        if not low(np.array([threshold], dtype=scores.dtype))[0]:
            return True
        within = scores[low(scores) & high(scores)]
        return len(within) >= k and threshold < np.sort(within)[-k]

    def ranked(self, rows, scores, window, k: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = window
        within = np.flatnonzero(low(scores) & high(scores))
        ids, scores = self.ids[rows[within]], scores[within]
        order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
        return ids[order], scores[order]


def anything(scores: np.ndarray) -> np.ndarray:
    return np.ones(len(scores), dtype=bool)


def window_of(positive, least: int = LEAST, most: int = MOST) -> tuple:
    """The window of a positive's score: least * positive <= 100 * score <= most * positive."""
    compare = lambda scores, kept: np.asarray(kept, dtype=bool) if len(scores) else np.zeros(0, dtype=bool)
    return lambda s: compare(s, 100 * s >= least * positive), lambda s: compare(s, 100 * s <= most * positive)


def long(score) -> int:
    return min(max(int(score), LONG.min), LONG.max)


def shard_up(rows: DataFrame, shards: int) -> DataFrame:
    """Shards as rows of bytes. Rows are dealt by a running number, not by a key that may repeat."""

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id", kind="stable")
        points = np.stack(own["v"].to_numpy()).astype(np.float64)
        lists = Lists(own["id"].to_numpy(), own["label"].to_numpy(), points)
        packed = {"ids": lists.ids.astype(np.int64), "labels": lists.labels.astype(np.int64), "points": points, "lists": lists.lists}
        return pd.DataFrame([{"shard": own["shard"].iloc[0]} | {name: value.tobytes() for name, value in packed.items()}])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("shard").applyInPandas(pack, SHARDS), "shards")


def unpack(row: pd.Series) -> Lists:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    points, lists = np.frombuffer(row["points"], dtype=np.float64), np.frombuffer(row["lists"], dtype=np.int32)
    return Lists(ids, np.frombuffer(row["labels"], dtype=np.int64), points.reshape(len(ids), -1), lists.reshape(-1, len(ids)))


def visit(shards: DataFrame, anchors: DataFrame, shard_count: int, blocks: int, search, schema: str) -> DataFrame:
    """Every block of anchors against every shard: search(lists, anchors) gives the rows."""
    sent = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = anchors.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shard_count - 1)))})
    names = [part.split()[0] for part in schema.split(", ")]

    def meet(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = search(unpack(own.iloc[0]), asked) if len(own) and len(asked) else []
        return pd.DataFrame(rows, columns=names).astype(np.int64)

    return sent.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInPandas(meet, schema)


def first(rows: DataFrame, keys: list[str], score: str, ident: str, k: int, rank: str = "rank") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    id_col: str = "vec_id",
    label: Column | None = None,
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor's hard negatives.

    is_anchor is a condition on the columns of vectors; label is an integer column, `label` if none is given.
    """
    label = F.col("label") if label is None else label
    made = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    made = made.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    sizes = made.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    made = made.filter(F.size("v") == dim).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"), F.max("asks").alias("asks"))
    made = made.select("id", "row.label", F.transform("row.v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)).alias("v"), "asks")
    base = materialize(made, "components")
    anchors = base.filter("asks").drop("asks")
    n, asked = base.count(), anchors.count()
    shards = max(1, -(-n // max(1, min(shard_rows, SHARD_BYTES // (8 * dim)))))
    blocks = max(1, -(-asked // block_rows))
    lists = shard_up(base.drop("asks"), shards)

    def alike(own: Lists, asking: pd.DataFrame) -> list[tuple]:
        out = []
        for anchor, label, v in zip(asking["id"], asking["label"], asking["v"], strict=True):
            [(ids, scores)] = own.best(v, (own.labels == label) & (own.ids != anchor), [(anything, anything)], positives)
            out += [(anchor, i, long(s)) for i, s in zip(ids, scores, strict=True)]
        return out

    near = first(visit(lists, anchors, shards, blocks, alike, POSITIVE), ["anchor_id"], "positive_score", "positive_id", positives)
    own = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("pairs"))
    # At most ``positives`` pairs an anchor.
    paired = materialize(anchors.join(own, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "pairs.positive_id", "pairs.positive_score"), "positives")

    def unlike(own: Lists, asking: pd.DataFrame) -> list[tuple]:
        out = []
        for anchor, label, v, ids, scores in zip(asking["id"], asking["label"], asking["v"], asking["positive_id"], asking["positive_score"], strict=True):
            found = own.best(v, own.labels != label, [window_of(int(p)) for p in scores], negatives)
            out += [(anchor, i, p, j, long(s)) for i, p, (js, ss) in zip(ids, scores, found, strict=True) for j, s in zip(js, ss, strict=True)]
        return out

    hard = first(visit(lists, paired, shards, blocks, unlike, NEGATIVE), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector; every seventh vector's label is moved by one first."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % 100 == 0, label=moved)


ORACLE = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
hard AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND own <> label
  WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 10
"""
