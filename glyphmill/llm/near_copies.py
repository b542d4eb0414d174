"""Near copies by the true similarity of their word shingles, found by SimHash over op2's index of byte positions.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at least
4/5. Every text has a SimHash fingerprint of its whole set, which links at three or fewer differing bits, as in
`simhash`. At that similarity it often differs in over ten bits, so a text has 20 more fingerprints: each
the SimHash of a sample of four shingles, those with the least products with four multipliers, which two texts share
with a probability of their similarity each. All go through the same index of positional bytes, with its count of
shared bytes and its verification of bits (one differing bit in samples). Texts that meet in a fingerprint have 80 bytes of their
samples tallied, those below a threshold are dropped; what is linked then is verified on the whole sets. A pair of
similarity 4/5 meets in no sample's fingerprint with probability 2.5e-5 and is below the threshold with
probability 1.1e-6; more similar pairs are missed less. Lists and groups hand on spanning forests, never their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.components import connected_components
from glyphmill.llm.shared import fresh, map_batches, small, store
from glyphmill.llm.simhash import links as fingerprint_links
from glyphmill.llm.simhash import majority

SEED, SHINGLE = 42, 5
#: Samples of four shingles that have a fingerprint each, bits in which theirs may differ, bytes that two sketches have to share.
SAMPLES, BITS, SHARED = 20, 1, 46
#: Longer lists, and groups of more shingles, are split into blocks of about this size, and the pairs of blocks into tasks.
LIST, SHINGLES = 4096, 1_000_000
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, 4 * SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSES = np.array([pow(int(m), -1, 1 << 64) for m in _MULTIPLIERS], np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted 64-bit hashes of the set of word shingles. Words are those of `simhash.fingerprint`; fewer
    words than a shingle are one shingle; none (or null) give none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64))


def sample(found: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """The least product of a set's hashes with each multiplier."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max)
    for i in range(0, len(found), at_once):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * found[None, i : i + at_once]).min(1))
    return least


def positional(least: np.ndarray) -> np.ndarray:
    """A middle byte of each least product."""
    return (least >> np.uint64(24)).astype(np.uint8)


def sketch(found: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Positional bytes of a set."""
    return positional(sample(found, at_once))


def fingerprints(least: np.ndarray) -> np.ndarray:
    """SimHashes of the samples of each row of least products; numbers of their own tell the samples apart."""
    hashes = (least * _INVERSES).reshape(-1, 4)  # of the shingles that have the least products
    return majority(hashes).reshape(-1, SAMPLES) ^ _MULTIPLIERS[::4]


def sketches(docs: DataFrame) -> DataFrame:
    """Stored table of every row: doc_id, mark (hash of the text), node (digest of the shingle set), sketch (four bytes a
    number), whole (SimHash of the set), fps (SimHashes of the samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, whole, least = [], np.zeros(b.num_rows, np.uint64), np.zeros((b.num_rows, 4 * SAMPLES), np.uint64)
            for i, x in enumerate(b.column(2)):
                found = shingles(x.as_py())
                least[i] = sample(found)
                whole[i] = majority(found[None])[0]
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest())
            lists = lambda values: pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * SAMPLES, values.ravel())
            parts, fps = lists(positional(least).view("<i4")), lists(fingerprints(least).view(np.int64))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(nodes, pa.string()), parts, pa.array(whole.view(np.int64)), fps], ["doc_id", "mark", "node", "sketch", "whole", "fps"])

    return store(map_batches(docs.select("doc_id", "mark", "text"), run, "doc_id long, mark long, node string, sketch array<int>, whole long, fps array<long>"), "sketches")


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links between 0 to n - 1: breadth first. `near` tells which of
    some numbers are linked to one."""
    rest, a, b = np.arange(n), [], []
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            reached = []
            for f in frontier:
                if not len(rest):
                    break
                hit = near(f, rest)
                a.extend([int(f)] * int(hit.sum()))
                b.extend(rest[hit].tolist())
                reached.append(rest[hit])
                rest = rest[~hit]
            frontier = np.concatenate(reached)
    return a, b


def alike(rows: np.ndarray, shared: int = SHARED) -> tuple[list[int], list[int]]:
    """Forest of the sketches (rows of bytes) that share enough positional bytes."""
    return forest(len(rows), lambda f, rest: (rows[rest] == rows[f]).sum(1) >= shared)


def similar(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Forest of the sets whose Jaccard similarity is at least 4/5; empty sets are equal to each other."""
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    end = np.cumsum(size)
    own, held = [code[e - n : e] for e, n in zip(end, size)], np.zeros(len(code), bool)

    def near(f: int, rest: np.ndarray) -> np.ndarray:
        out = (5 * size[rest] >= 4 * size[f]) & (5 * size[f] >= 4 * size[rest])
        if size[f] and out.any():
            held[own[f]] = True
            picked = rest[out]
            both = np.add.reduceat(held[np.concatenate([own[i] for i in picked])].astype(np.int64), np.cumsum(size[picked]) - size[picked])
            out[out] = 9 * both >= 4 * (size[f] + size[picked])  # both / (a + b - both) >= 4 / 5
            held[own[f]] = False
        return out

    return forest(len(sets), near)


def _search(rows: DataFrame, keys: list[str], value: str, find: Callable[[pa.Array], tuple[list[int], list[int]]]) -> DataFrame:
    """a, b: forests that `find` sees in the values of the rows (keys, cuts, node, value) of each key.

    Keys of `cuts` > 1 are split into as many blocks; each pair of blocks is searched by itself.
    """
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    rows = rows.select(*keys, "node", value, "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    rows = rows.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", value)
    by = [*keys, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nodes, values = None, [], []

        def search() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                a, b = find(pa.array(values, values[0].type))
                yield pa.record_batch([pa.array([nodes[i] for i in side], pa.string()) for side in (a, b)], ["a", "b"])

        for batch in batches:
            for key, node, v in zip(zip(*(batch.column(c).to_pylist() for c in by)), batch.column("node").to_pylist(), batch.column(value)):
                if key != current:
                    yield from search()
                    current, nodes, values = key, [], []
                nodes.append(node)
                values.append(v)
        yield from search()

    return map_batches(rows.repartition(*by).sortWithinPartitions(*by), run, "a string, b string")


def links(distinct: DataFrame, longest: int = LIST) -> DataFrame:
    """a, b: links between sketches (node, sketch, whole, fps; nodes distinct) that connect the same groups as all links the index finds.

    Fingerprints that `fingerprint_links` connects are one class; the texts of a class are the ones that meet.
    """
    near = fingerprint_links(distinct.select(F.col("whole").alias("fp")).distinct())
    near = near.unionAll(fingerprint_links(distinct.select(F.explode("fps").alias("fp")).distinct(), BITS))
    classes = store(connected_components(near), "classes")
    fps = distinct.select("node", F.explode(F.array_append("fps", F.col("whole"))).alias("fp"))
    index = fps.join(small(classes), F.col("fp") == classes["node"], "left").select(fps["node"], F.coalesce("component", "fp").alias("class"))
    sizes = index.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = store(sizes.select("class", F.ceil(F.col("n") / longest).cast("int").alias("cuts")), "lists")
    blobs = index.join(small(sizes), "class").join(distinct.select("node", "sketch"), "node")
    return _search(blobs, ["class"], "sketch", lambda v: alike(v.flatten().to_numpy().astype("<i4").view(np.uint8).reshape(len(v), -1)))


def verified(docs: DataFrame, members: DataFrame, block: int = SHINGLES) -> DataFrame:
    """a, b: links of similarity 4/5 or more that connect the same groups as all such links within a component.

    `members`: component, node and the first row (doc_id, mark) of each node; `docs`: doc_id, mark, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py()) for x in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.record_batch(cols, ["component", "node", "n", "shingles"])

    first = small(members.select("component", "node", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")))
    texts = docs.join(first, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["mark"] == F.col("_mark"))).select("component", "node", "text")
    sets = store(map_batches(texts, run, "component string, node string, n long, shingles binary"), "sets")
    sizes = sets.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / block)).cast("int").alias("cuts"))
    return _search(sets.join(sizes, "component"), ["component"], "shingles", lambda v: similar([np.frombuffer(x.as_py(), np.uint64) for x in v]))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark, first (doc_id and mark of the first row of its group) of every row of `docs`.

    A group is what links of similarity 4/5 or more reach; its first row has the smallest id, then the
    smallest mark; rows without id come last. Null and wordless texts are copies of each other.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    rows = sketches(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    distinct = store(rows.groupBy("node").agg(least, *[F.first(c).alias(c) for c in ("sketch", "whole", "fps")]), "distinct")
    members = store(connected_components(links(distinct)).join(distinct.select("node", "first"), "node"), "members")
    comp = connected_components(verified(docs, members))
    found = store(comp.join(distinct.select("node", "first"), "node"), "found")
    lowest = found.groupBy("component").agg(F.min("first").alias("low"))
    low = found.join(lowest, "component").select("node", "low")
    first = store(distinct.join(low, "node", "left").select("node", F.coalesce("low", "first").alias("first")), "groups")
    return rows.join(first, "node").select("doc_id", "mark", F.struct("first.doc_id", "first.mark").alias("first"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with exactly one row of each group of near copies: its first one.

    Of rows with the first's id and text the least by all columns stays; maps, which have no order, count by their JSON text.
    """
    rows = groups(docs, key, text)
    id_, mark, n = fresh(docs, "_gone", "_mark", "_n")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    many = rows.groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).agg(F.count(F.lit(1)).alias(n), F.min(first).alias("first"))
    many = store(many.filter(f"NOT first OR {n} > 1"), "gone")  # a row's id and text settle its group
    same = docs[key].cast("long").eqNullSafe(many[id_]) & (F.xxhash64(docs[text]) == many[mark])
    out = docs.join(small(many), same, "left_anti")
    again = small(store(many.filter("first"), "again"))
    if not again.head(1):
        return out
    row = F.struct(*[docs[c] for c in docs.columns])
    order = F.struct(*[F.to_json(F.struct(docs[f.name].alias("v"))) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema.fields])
    again = docs.join(again, docs[key].cast("long").eqNullSafe(again[id_]) & (F.xxhash64(docs[text]) == again[mark]))
    return out.unionByName(again.groupBy(id_, mark).agg(F.min_by(row, order).alias(n)).select(f"{n}.*").select(*docs.columns))
