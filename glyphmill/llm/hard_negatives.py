"""Hard negatives by branch and bound in ball trees.

Every block of rows has a tree of balls. For a vector q and a ball of centre c and radius r every product lies
between q.c - |q| r and q.c + |q| r; a ball is left out for a query where that range misses the query's score
window, or where its upper end is strictly below the query's current kth score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.blocks import BLOCK, build_blocks, opened, scaled, usable
from glyphmill.llm.shared import map_batches, store

#: Anchors of a round, rows of a leaf.
ANCHORS, LEAF = 2048, 64
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, ...]:
    """order of the rows, and of each node its first and last row in it, parent (before its children), centre, radius, whether it is a leaf.

    A ball is halved across the line between a row far from the centre and the row farthest from that one.
    """
    order, nodes = np.arange(len(x)), []
    todo = [(0, len(x), -1)]
    while todo:
        first, end, parent = todo.pop()
        points = x[order[first:end]]
        centre = points.mean(axis=0)
        away = np.sqrt(np.einsum("ij,ij->i", points - centre, points - centre))
        radius = float(away.max(initial=0))
        is_leaf = end - first <= leaf
        nodes.append((first, end, parent, centre, radius * (1 + 1e-9) + 1e-9, is_leaf))
        if not is_leaf:
            a = points[away.argmax()]
            line = points[np.einsum("ij,ij->i", points - a, points - a).argmax()] - a
            order[first:end] = order[first:end][np.argsort(points @ line, kind="stable")]
            half, at = (first + end) // 2, len(nodes) - 1
            todo += [(half, end, at), (first, half, at)]
    first, end, parent, centre, radius, is_leaf = zip(*nodes)
    return order, np.array(first), np.array(end), np.array(parent), np.array(centre), np.array(radius), np.array(is_leaf)


class Search:
    """The k best rows of each query within its window so far.

    A query belongs to an anchor: `of` is its place in `vectors`. It wants rows of the anchor's label (`same`) or of others,
    never rows with the anchor's id, with low <= score <= high; higher scores first, ties by smaller id.
    """

    def __init__(self, vectors: np.ndarray, anchor_ids: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.vectors, self.anchor_ids, self.labels, self.of, self.high, self.k, self.same = vectors, anchor_ids, labels, of, high, k, same
        self.score, self.id = np.full((len(of), k), -np.inf), np.full((len(of), k), np.iinfo(np.int64).max)
        self.least = low.astype(np.float64)  # the window's lower end, later the kth score
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))

    def block(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, tree: tuple) -> None:
        first, end, parent, centre, radius, is_leaf = tree
        middle, reach = centre @ self.vectors.T, np.outer(radius, self.norm)
        slack = 1e-6 * (1 + np.abs(middle) + reach)
        upper, lower = middle + reach + slack, middle - reach - slack
        open_ = np.empty((len(first), len(self.of)), bool)
        for i, p in enumerate(parent):
            fits = (upper[i, self.of] >= self.least) & (lower[i, self.of] <= self.high)
            open_[i] = fits if p < 0 else fits & open_[p]
        leaves = np.flatnonzero(is_leaf & open_.any(axis=1))
        for i in leaves[np.argsort(-upper[leaves].max(axis=1), kind="stable")]:
            mine = np.flatnonzero(open_[i] & (upper[i, self.of] >= self.least))
            if len(mine):
                self.leaf(mine, ids[first[i] : end[i]], labels[first[i] : end[i]], x[first[i] : end[i]])

    def leaf(self, mine: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        anchors, back = np.unique(self.of[mine], return_inverse=True)
        s = self.vectors[anchors] @ x.T
        s[((labels[None, :] == self.labels[anchors][:, None]) != self.same) | (ids[None, :] == self.anchor_ids[anchors][:, None])] = -np.inf
        s = s[back]
        s[(s < self.least[mine][:, None]) | (s > self.high[mine][:, None])] = -np.inf
        hit = np.flatnonzero((s > -np.inf).any(axis=1))
        if not len(hit):
            return
        mine, s = mine[hit], s[hit]
        scores = np.concatenate([self.score[mine], s], axis=1)
        all_ids = np.concatenate([self.id[mine], np.broadcast_to(ids, s.shape)], axis=1)
        best = np.lexsort((all_ids, -scores), axis=1)[:, : self.k]
        self.score[mine], self.id[mine] = np.take_along_axis(scores, best, 1), np.take_along_axis(all_ids, best, 1)
        self.least[mine] = np.maximum(self.least[mine], self.score[mine, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all that is kept."""
        got = self.score > -np.inf
        return np.repeat(np.arange(len(self.of)), got.sum(axis=1)), self.id[got], self.score[got].astype(np.int64)


def _best(blocks: DataFrame, query: tuple, k: int, same: bool) -> DataFrame:
    """query, id, score, rank: the k best rows of each query in all blocks. A task's blocks share what was found."""
    sent = blocks.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value, k, same)
        for b in batches:
            for ids, labels, x, tree in opened(b):
                search.block(ids, labels, x, tree)
        yield pa.record_batch([pa.array(c) for c in search.found()], ["query", "id", "score"])

    order = W.partitionBy("query").orderBy(F.col("score").desc(), "id")
    found = map_batches(blocks, run, "query long, id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are products of floor(scale * vector). An anchor's positives are its first `positives` other rows of its label,
    higher scores first, ties by smaller id. For each of them: the first `negatives` rows of other labels of which
    the score is `low` to `high` per cent of the positive's (fewer if there are fewer, no row if there are none; of
    negative positive scores there is no such range).

    Rows without id or label, and vectors that are null, empty or hold null or non-finite components take no part; vectors of
    another length are not comparable. An id that is stored repeatedly is one anchor (its smallest vector, then label)
    and as many rows of others' results; rows with the anchor's id are never its own results. No anchors: no rows.

    Blocks are stored once with their trees. Anchors are searched in rounds of about `anchors`: their vectors and positives
    are what the driver and each task hold.
    """
    rows = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.size(vector).alias("dim"), is_anchor.alias("asked"))
    asked = store(rows.filter("asked").groupBy("vec_id", "dim").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "dim", "r.*"), "anchors")
    parts = []
    for dim, n in sorted((r["dim"], r["n"]) for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        blocks = build_blocks(rows.filter(F.col("dim") == dim).drop("dim", "asked"), ball_tree, scale, block)
        rounds = -(-n // anchors)
        for r in range(rounds):
            some = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r))
            found = _round(blocks, some, positives, negatives, low, high, scale)
            parts.append(found if rounds == 1 else store(found, "round"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], RESULT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _round(blocks: DataFrame, asked: DataFrame, positives: int, negatives: int, low: int, high: int, scale: float) -> DataFrame:
    spark = blocks.sparkSession
    got = asked.select("vec_id", "label", "v").toArrow()
    if not got.num_rows:
        return spark.createDataFrame([], RESULT)
    ids, labels, q = got.column(0).to_numpy(), got.column(1).to_numpy(), scaled(got.column(2).combine_chunks(), scale)
    every = np.arange(len(ids))
    pairs = _best(blocks, (q, ids, labels, every, np.full(len(ids), -np.inf), np.full(len(ids), np.inf)), positives, True)
    pairs = pairs.select("query", "rank", "id", "score").toArrow().sort_by([("query", "ascending"), ("rank", "ascending")])
    of, pos, score = (pairs.column(c).to_numpy() for c in ("query", "id", "score"))
    least, most = -(-low * score // 100), high * score // 100
    live = least <= most
    of, pos, score, least, most = (c[live] for c in (of, pos, score, least, most))
    if not len(of):
        return spark.createDataFrame([], RESULT)
    found = _best(blocks, (q, ids, labels, of, least, most), negatives, False)
    known = spark.createDataFrame(pa.table({"query": np.arange(len(of)), "anchor_id": ids[of], "positive_id": pos, "positive_score": score}))
    out = found.join(F.broadcast(known), "query")  # a round's pairs
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
