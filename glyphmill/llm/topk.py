"""Exact top-k search by inner product with two cover trees.

Candidates are dealt into blocks of near vectors, each stored once with its tree; a round of queries is indexed too. Pairs of
nodes are visited best bound first, and a pair is dropped when even the largest product that its
covering radii allow is below the worst kth score of the query group:
q.x <= Q.C + |Q| rC + |C| rQ + rQ rC for q within rQ of Q and x within rC of C.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.blocks import BLOCK, build_blocks, opened, scaled, usable
from glyphmill.llm.shared import map_batches, store

#: Rows of a round's queries and of a leaf; radius of a node over its children's.
QUERIES, LEAF, BASE = 8192, 64, 1.5
FOUND = "query_id long, vec_id long, score long"


@dataclass
class Node:
    center: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray  # of the whole subtree
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF, base: float = BASE) -> Node:
    """Cover tree of the rows of `x`: children's centers are points, chosen farthest first until they
    cover the node at its radius over `base`. Where nearly every point would be a child there is no
    structure at that scale: the first few centers then get the points nearest to them as leaves."""
    rows = np.arange(len(x)) if rows is None else rows
    points = x[rows]
    norms = np.einsum("ij,ij->i", points, points)

    def away(i: int) -> np.ndarray:
        return np.sqrt(np.maximum(norms + norms[i] - 2 * (points @ points[i]), 0))

    near, owner = away(0), np.zeros(len(rows), np.int64)
    node = Node(points[0], float(np.sqrt(norms[0])), float(near.max()), rows)
    if len(rows) <= leaf:
        return node
    centers, most, few = [0], max(8, len(rows) // 8), -(-len(rows) // leaf)
    nearest = owner, near  # what the first few centers would have
    while near.max() > node.radius / base and len(centers) < most:
        i = int(near.argmax())
        d = away(i)
        closer = d < near
        near, owner = np.where(closer, d, near), np.where(closer, len(centers), owner)
        centers.append(i)
        if len(centers) <= few:
            nearest = owner, near
    if near.max() > node.radius / base or node.radius == 0:
        owner, near = nearest
        order = np.lexsort((near, owner))
        ends = np.flatnonzero(np.r_[owner[order][1:] != owner[order][:-1], True]) + 1
        for first, end in zip(np.r_[0, ends[:-1]], ends):
            for at in range(first, end, leaf):
                part, c = order[at : min(at + leaf, end)], order[first]
                node.children.append(Node(points[c], float(np.sqrt(norms[c])), float(away(c)[part].max()), rows[part]))
        return node
    for k, c in enumerate(centers):
        mine = np.flatnonzero(owner == k)
        mine = np.concatenate([[c], mine[mine != c]])  # a child's center is its first row
        node.children.append(cover_tree(x, rows[mine], leaf, base))
    return node


def flat_tree(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """The cover tree of `x` as arrays: order of the rows, and of each node its parent (before it), centre, norm, radius, and the end of its rows; rows of leaves alone."""
    todo, nodes, rows = [(cover_tree(x), -1)], [], []
    while todo:
        node, parent = todo.pop()
        own = node.rows if not node.children else node.rows[:0]
        rows.append(own)
        nodes.append((parent, node.center, node.norm, node.radius, len(own)))
        todo += [(c, len(nodes) - 1) for c in reversed(node.children)]
    parent, center, norm, radius, size = zip(*nodes)
    return np.concatenate(rows), np.array(parent), np.array(center), np.array(norm), np.array(radius), np.cumsum(size)


def grown_tree(parent: np.ndarray, center: np.ndarray, norm: np.ndarray, radius: np.ndarray, end: np.ndarray) -> Node:
    """The tree that `flat_tree` stored, over rows in its order."""
    first = np.r_[0, end[:-1]]
    nodes = [Node(center[i], float(norm[i]), float(radius[i]), np.arange(first[i], end[i])) for i in range(len(parent))]
    for node, p in zip(nodes[1:], parent[1:]):
        nodes[p].children.append(node)
    return nodes[0]


def bound(q: Node, r: Node) -> float:
    """No product of a point below `q` with one below `r` is larger."""
    top = q.center @ r.center + q.norm * r.radius + r.norm * q.radius + q.radius * r.radius
    return top + 1e-6 * (1 + abs(top))


class Best:
    """The k best rows (score, id) of each query so far, and the score that a row needs to be among them.

    `floor`: a score that each query is known to reach k times elsewhere; nothing below it is kept. Ties go to
    the smaller id.
    """

    def __init__(self, floor: np.ndarray, k: int):
        self.score, self.id = np.full((len(floor), k), -np.inf), np.full((len(floor), k), np.iinfo(np.int64).max)
        self.kth = floor.copy()

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        take = np.flatnonzero((scores >= self.kth[query]) & (scores > -np.inf))
        s, i = np.concatenate([self.score[query], scores[take]]), np.concatenate([self.id[query], ids[take]])
        first = np.lexsort((i, -s))[: self.score.shape[1]]
        self.score[query], self.id[query] = s[first], i[first]
        self.kth[query] = max(self.kth[query], self.score[query, -1])

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of all that is kept."""
        got = self.score > -np.inf
        return np.repeat(query_ids, got.sum(1)), self.id[got], self.score[got].astype(np.int64)


def dual_search(queries: np.ndarray, query_ids: np.ndarray, best: Best, x: np.ndarray, ids: np.ndarray, trees: tuple[Node, Node] | None = None) -> None:
    """Add to `best` what it lacks of the rows of `x`; rows with a query's own id are left out.

    Pairs of nodes are taken best bound first; the wider node of a pair is opened, pairs below the
    worst kth score of the query node's rows are dropped, pairs of leaves are multiplied out. Scores kept
    from earlier blocks prune like those found here. All values are integers in float64, so products are exact below 2**53.
    """
    top_q, top_r = trees or (cover_tree(queries), cover_tree(x))
    stack = [(bound(top_q, top_r), top_q, top_r)]
    while stack:
        top, q, r = stack.pop()
        if top < best.kth[q.rows].min():
            continue
        if q.children and (q.radius >= r.radius or not r.children):
            stack += sorted(((bound(c, r), c, r) for c in q.children), key=lambda b: b[0])
        elif r.children:
            stack += sorted(((bound(q, c), q, c) for c in r.children), key=lambda b: b[0])
        else:
            s = queries[q.rows] @ x[r.rows].T
            s[query_ids[q.rows][:, None] == ids[r.rows][None, :]] = -np.inf
            for i in np.flatnonzero((s >= best.kth[q.rows][:, None]).any(1)):
                best.add(q.rows[i], s[i], ids[r.rows])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by the product of floor(scale * vector).

    Every row is a candidate except rows with the query's own id. Rows without id and vectors that are
    null, empty or hold null or non-finite components take no part; vectors of another length are not
    comparable. Fewer candidates than k: all of them. An id that is stored repeatedly is one query
    (its smallest vector) and as many candidates. No queries: no rows.

    Candidates are read, dealt and indexed once. Queries are searched in rounds of about `queries` rows over the stored blocks; one
    round's queries are what the driver and each executor hold, and a block whose root no query can need is passed over.
    """
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.size(vector).alias("dim"), is_query.alias("is_query"))
    asked = rows.filter("is_query").groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    asked = store(asked, "queries")
    parts = []
    for dim, n in sorted((r["dim"], r["n"]) for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        rounds = -(-n // queries)
        blocks = build_blocks(rows.filter(F.col("dim") == dim).select("vec_id", F.lit(0).cast("long").alias("label"), "v"), flat_tree, scale, block)
        for r in range(rounds):
            mine = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r))
            found = _round(blocks, mine, k, scale)
            parts.append(found if rounds == 1 else store(found, "round"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _round(blocks: DataFrame, asked: DataFrame, k: int, scale: float) -> DataFrame:
    """The k best of every task's candidates for one round of queries: blocks of a task share what was found."""
    spark = blocks.sparkSession
    got = asked.select("vec_id", "v").toArrow()
    ids = got.column(0).to_numpy()
    if not len(ids):
        return spark.createDataFrame([], FOUND)
    q = scaled(got.column(1).combine_chunks(), scale)
    floor = np.full(len(ids), -np.inf)  # what queries reach among themselves
    for i in range(0, len(ids), 512):
        s = q[i : i + 512] @ q.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        if len(ids) > k:
            floor[i : i + 512] = np.partition(s, -k, axis=1)[:, -k]
    sent = spark.sparkContext.broadcast((ids, q, floor))  # at most a round's queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, floor = sent.value
        tree, best = cover_tree(q), Best(floor, k)
        for b in batches:
            for own, _, x, flat in opened(b):
                dual_search(q, ids, best, x, own, (tree, grown_tree(*flat)))
        yield pa.record_batch([pa.array(c) for c in best.rows(ids)], ["query_id", "vec_id", "score"])

    return map_batches(blocks, run, FOUND)
