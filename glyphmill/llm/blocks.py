"""Blocks of near vectors, each stored once with its search tree.

Rows are dealt by the nearest of some sampled centres, so that a block covers little space; a centre with
many rows is dealt over as many parts as it fills blocks. Vectors are scaled to whole numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import map_batches, store

#: Rows of a block; centres at most, and rows that their shares are judged by.
BLOCK, CENTRES, DRAWN = 4096, 256, 4096
#: A block: its rows' ids, labels (0 where there are none), vectors (`kind`: float32 if exact) and its pickled tree.
SCHEMA = "n int, kind string, ids binary, labels binary, x binary, tree binary"


def usable(vector: Column) -> Column:
    """True for vectors with components, all of them finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def scaled(column: pa.Array, scale: float) -> np.ndarray:
    """Matrix of floor(scale * component), components as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def build_blocks(rows: DataFrame, tree: Callable[[np.ndarray], tuple], scale: float, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """Stored table of blocks of `rows` (vec_id long, label long, v array, all of one length and none of them null).

    `tree` makes of a block's matrix a tuple of arrays, first of all an order of its rows, in which the block is kept. The driver holds
    DRAWN rows at most, by which centres are chosen and their shares of the rows judged; every row is in one block.
    """
    n = rows.count()
    drawn = rows.select("v") if n <= DRAWN else rows.select("v").sample(DRAWN / n, 7)
    some = scaled(drawn.toArrow().column(0).combine_chunks(), scale)
    middle = some[: min(centres, -(-n // block))]
    near = _nearest(some, middle)
    parts = np.maximum(1, np.ceil(np.bincount(near, minlength=len(middle)) / max(1, len(some)) * n / block)).astype(np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((middle, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, parts = sent.value
        seen = 0
        for b in batches:
            cell = _nearest(scaled(b.column("v"), scale), middle)
            part = (np.arange(seen, seen + len(cell)) * 2654435761 % (1 << 31)) % parts[cell]
            seen += len(cell)
            yield pa.record_batch([*b.columns, pa.array(cell), pa.array(part)], [*b.schema.names, "cell", "part"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            at = 0
            while at < b.num_rows:
                take = block - sum(h.num_rows for h in held)
                held.append(b.slice(at, take))
                at += take
                if at <= b.num_rows:
                    yield whole(held)
                    held = []
        if held:
            yield whole(held)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        x = scaled(t.column("v").combine_chunks(), scale)
        made = tree(x)
        order = made[0]
        x = x[order]
        kind = "float32" if np.abs(x).max(initial=0) < 1 << 24 else "float64"
        numbers = [t.column(c).to_numpy()[order].astype(np.int64).tobytes() for c in ("vec_id", "label")]
        values = [[len(x)], [kind], [numbers[0]], [numbers[1]], [x.astype(kind).tobytes()], [pickle.dumps(made[1:])]]
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    kinds = dict(rows.dtypes)
    dealt = map_batches(rows.select("vec_id", "label", "v"), deal, f"vec_id long, label long, v {kinds['v']}, cell long, part long")
    dealt = store(dealt, "dealt")  # the same parts again, should rows be dealt once more
    return store(map_batches(dealt.repartition("cell", "part").sortWithinPartitions("cell", "part"), cut, SCHEMA), "blocks")


def _nearest(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    if len(middle) < 2:
        return np.zeros(len(x), np.int64)
    return np.argmin(np.einsum("ij,ij->i", middle, middle) - 2 * (x @ middle.T), axis=1)


def opened(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """(ids, labels, vectors in float64, tree) of each block of a batch."""
    for r in batch.to_pylist():
        ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
        yield ids, labels, np.frombuffer(r["x"], r["kind"]).astype(np.float64).reshape(r["n"], -1), pickle.loads(r["tree"])
