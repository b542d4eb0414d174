"""Hard negatives by ball trees against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import blocks, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, query int, n int, cell string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, 2, "x", 3) for i, v, c in rows], SCHEMA)


def brute(rows, positives, negatives, low, high):
    ok = [(i, np.floor(256 * np.array(v, float)), c) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, v, c in sorted(((i, list(v), c) for i, v, c in ok if i % 10 == 0), reverse=True):
        anchors[i, len(v)] = np.array(v), c
    out = []
    for (a, d), (q, mine) in anchors.items():
        scored = sorted((-int(q @ v), i, c) for i, v, c in ok if i != a and len(v) == d)
        for s, p, _ in [r for r in scored if r[2] == mine][:positives]:
            fit = [(i, -t) for t, i, c in scored if c != mine and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fit)]
    return sorted(out)


def clustered(n, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, 6))
    return [(i, (centres[i % 7] + 0.4 * r.normal(size=6)).tolist(), int(r.integers(4))) for i in range(n)]


ODD = [(None, [1.0] * 6, 1), (600, None, 1), (610, [], 1), (620, [None] * 6, 1), (630, [float("nan")] * 6, 1), (640, [float("inf")] * 6, 2), (650, [1.0] * 6, None), (660, [0.5, 0.5], 1), (661, [0.5, 0.4], 1), (662, [0.4, 0.1], 2)]


@pytest.mark.parametrize("block, per_round", [(4096, 2048), (90, 7)])
def test_against_brute_force(spark, block, per_round):
    rows = clustered(420)
    rows += [(700 + i, rows[10][1], i % 3) for i in range(40)] + [(20, rows[21][1], 1), (20, rows[20][1], 0), (33, *rows[33][1:])] + ODD  # ties, repeated ids
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, block=block, anchors=per_round).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 10, 30, 90)


def test_other_windows_and_no_anchors(spark):
    rows = clustered(200, 8) + ODD
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=2, negatives=3, low=-50, high=100, block=64).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 3, -50, 100)
    assert hard_negatives.mine(frame(spark, rows), F.lit(False)).count() == 0
    assert hard_negatives.mine(frame(spark, []), F.lit(True)).count() == 0
    assert hard_negatives.mine(frame(spark, [(10, [1.0, 2.0], 1)]), F.lit(True)).count() == 0


def test_tree_covers_its_rows_and_prunes():
    r = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([c + 0.01 * r.normal(size=(500, 8)) for c in r.normal(size=(6, 8))]))
    order, first, end, parent, centre, radius, is_leaf = hard_negatives.ball_tree(x)
    for i in range(len(first)):
        assert np.sqrt(((x[order[first[i] : end[i]]] - centre[i]) ** 2).sum(axis=1)).max() <= radius[i]
    assert sorted(order) == list(range(len(x))) and sum((end - first)[is_leaf]) == len(x)
    same = hard_negatives.ball_tree(np.ones((1000, 4)))
    assert len(same[1]) == 31  # equal rows are halved too
    search = hard_negatives.Search(x[:5], np.arange(5), np.zeros(5, int), np.arange(5), np.full(5, -np.inf), np.full(5, np.inf), 5, True)
    seen = []
    leaf = search.leaf
    search.leaf = lambda mine, ids, *rest: (seen.append(len(ids)), leaf(mine, ids, *rest))
    search.block(np.arange(len(x))[order], np.zeros(len(x), int), x[order], (first, end, parent, centre, radius, is_leaf))
    assert sum(seen) < len(x) / 2


def test_blocks_hold_every_row_once(spark):
    rows = [(i, v, c or 0) for i, v, c in clustered(500)] + [(1000 + i, [1.0] * 6, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label long").repartition(3)
    stored = blocks.build_blocks(df, lambda x: (np.arange(len(x)),), 256.0, block=64, centres=5)
    sizes, ids = [], []
    for batch in stored.toArrow().to_batches():
        for own, labels, x, _ in blocks.opened(batch):
            sizes.append(len(own))
            ids += list(own)
            assert x.shape == (len(own), 6) and len(labels) == len(own)
    assert sorted(ids) == sorted(r[0] for r in rows) and max(sizes) <= 64


def test_stored_cover_trees():
    """A tree that was stored and grown again has the same nodes over the same rows."""
    from glyphmill.llm import topk

    r = np.random.default_rng(2)
    x = np.floor(256 * r.normal(size=(700, 5)))
    order, *flat = topk.flat_tree(x)
    assert sorted(order) == list(range(700))

    def walk(node, rows):
        below = [walk(c, rows) for c in node.children]
        return (tuple(node.center), node.radius, sorted(rows[node.rows].tolist()) if not below else [], below)

    assert walk(topk.grown_tree(*flat), order) == walk(topk.cover_tree(x), np.arange(700))
