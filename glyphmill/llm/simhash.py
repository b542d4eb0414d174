"""SimHash near-duplicates over an inverted index of byte positions.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most three bits differ in
at most three bytes, so they share at least five: the guaranteed minimum. Lists of single bytes would
hold a 256th of all fingerprints each, so the index posts groups of four positions: the 14 blocks of the
Steiner system S(3, 4, 8) leave, for any three positions, a block without them. Pairs that meet in a
list have their shared positional bytes tallied, those below the minimum are dropped, the rest verified.
A list hands on a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.components import connected_components
from glyphmill.llm.shared import fresh, map_batches, small, store

SEED, SHINGLE, BITS = 42, 3, 3
#: Longer lists are split into blocks of about this size, and the pairs of blocks into tasks.
LIST = 4096


def blocks(bits: int = BITS) -> list[tuple[int, ...]]:
    """The 14 quadruples of positions 0 to 7 whose exclusive or is zero; two halves where one position at most may differ."""
    if bits < 2:
        return [(0, 1, 2, 3), (4, 5, 6, 7)]
    return [q for q in combinations(range(8), 4) if not q[0] ^ q[1] ^ q[2] ^ q[3]]


def mask(positions: tuple[int, ...]) -> int:
    """Signed 64-bit mask of these bytes."""
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles, repeats included; bit set if set in over half the hashes.

    Words are split at ASCII white space, A-Z lower-cased; fewer words than a shingle are one shingle;
    none (or null) give 0.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64)
    return int(majority(h[None])[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """SimHash of each row of 64-bit hashes: a bit is set if over half of them have it."""
    rows, n = hashes.shape
    ones = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(rows, n, 8), axis=2, bitorder="little").sum(1, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored table doc_id, fp (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return store(map_batches(rows, run, "doc_id long, fp long"), "fingerprints")


def linked(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """True where two fingerprints share enough positional bytes and then differ in at most `bits` bits."""
    x = np.bitwise_xor(a, b)
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1, dtype=np.uint8)
    out = tally >= 8 - bits
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def forest(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between distinct fingerprints: breadth first, every
    fingerprint compared once with those not yet reached."""
    rest, a, b = fps, [], []
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            reached = np.zeros(len(rest), bool)
            for f in frontier:
                open_ = np.flatnonzero(~reached)
                hit = open_[linked(rest[open_], np.broadcast_to(f, len(open_)), bits)]
                reached[hit] = True
                a.append(np.full(len(hit), f))
                b.append(rest[hit])
            frontier, rest = rest[reached], rest[~reached]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def links(fps: DataFrame, bits: int = BITS, longest: int = LIST) -> DataFrame:
    """a, b: links between different fingerprints (column fp, distinct) that connect the same groups as all links.

    `bits` of at most 3 is what the index guarantees.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the index of four shared bytes covers up to 3 differing bits")
    lists = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(mask(q))).alias("part")) for i, q in enumerate(blocks(bits))])
    index = fps.select("fp", F.explode(lists).alias("k")).select("fp", "k.block", "k.part")
    sizes = index.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = store(sizes.select("block", "part", F.ceil(F.col("n") / longest).cast("int").alias("cuts")), "lists")
    index = index.join(small(sizes), ["block", "part"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    index = index.select("block", "part", "fp", "own", other.alias("other")).select("block", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    keys = ["block", "part", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)

        def search(rows: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(1)]) if len(rows) else np.zeros(0, int)
            size, fp = np.diff(np.r_[at, len(rows)]), rows[:, 4].view(np.uint64) if len(rows) else rows[:, 4]
            two = at[size == 2]
            ok = two[linked(fp[two], fp[two + 1], bits)] if len(two) else two
            found = [(fp[ok], fp[ok + 1])] + [forest(fp[s : s + n], bits) for s, n in zip(at[size > 2], size[size > 2])]
            a, b = (np.concatenate([f[i] for f in found]).astype(np.uint64).view(np.int64) for i in (0, 1))
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*keys, "fp")], 1)
            rows = np.concatenate([held, rows])
            same = (rows[:, :4] == rows[-1, :4]).all(1) if len(rows) else np.zeros(0, bool)
            held = np.ascontiguousarray(rows[same])
            if (~same).any():
                yield search(np.ascontiguousarray(rows[~same].T).T.copy())
        if len(held):
            yield search(held)

    return map_batches(index.repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id: the smallest doc_id that links reach, the row's own included. Null and wordless texts
    have fingerprint 0, which links like any other. Rows without id get the component of their
    fingerprint, null if no id is in it. Equal fingerprints meet in one row before anything is
    compared; the join back to the rows is split by adaptive execution where one is very frequent.
    """
    fps = fingerprints(docs, key, text)
    distinct = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    comp = connected_components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    comp = store(comp.join(distinct, "fp"), "members")
    lowest = comp.groupBy("component").agg(F.min("first").alias("low"))
    low = comp.join(lowest, "component").select("fp", "low")
    groups = store(distinct.join(low, "fp", "left").select("fp", F.least("first", "low").alias("component_id")), "groups")
    out = fps.join(groups, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """`docs` with the smallest id of each near-duplicate group only; rows without id stay.

    Rows that repeat a kept id all stay: ids are what the operator tells apart.
    """
    found = near_duplicates(docs, key, text, bits)
    (name,) = fresh(docs, "_gone")
    gone = store(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(small(gone), docs[key].cast("long") == gone[name], "left_anti")
