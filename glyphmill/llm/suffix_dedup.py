"""Removal of repeated byte strings across documents, by column-wise suffix sorting of what can repeat.

Sorting all suffixes of a corpus would move every byte many times, so two exact steps prune the input:
1. Documents equal to one with a smaller id are settled by a hash of the whole text.
2. Every string of the asked length holds a winnowed seed (its least k-gram). Seeds that only one
   document has cannot belong to a repeat; seeds are compared in packed lists dealt by hash.
Each other seed hands on its surroundings, which hold all strings around it. Surroundings of a seed go
into one collection, whose transform and common prefixes are built column by column; strings of the asked
length that share a common prefix that long are compared by document, and nothing else decides a removal.
A task first builds the collections of seeds that its own lot has often, so that only strings of the lot's
smallest document travel; the rest meets dealt by seed. Collections are bounded, and their files of the
transform and prefixes are arrays in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.bwt import collection_suffixes
from glyphmill.llm.shared import drop_stored, fresh, map_batches, release, small, store

#: Length of a repeat and of a seed, both in bytes.
LENGTH, SEED = 50, 16
#: Seeds that a packed list is meant to hold, texts' seeds of one packing.
LIST_SEEDS, PACKED = 400_000, 300_000
#: Surroundings of a collection (more only where one seed has more), of a lot, bytes of texts of a lot.
SORTED, LOT, LOT_BYTES = 4_000, 30_000, 16 << 20
#: Surroundings of a seed in a lot from which on the lot settles them before it hands them on; single strings of a hot seed that are packed in one go.
OFTEN, SLICE = 4, 50_000
#: Seeds of more documents than this (or than a millionth of all) hand on each of their strings by itself.
HOT = 32_000
#: Tables of spans or seeds of more bytes than this are never broadcast.
BROADCAST_BYTES = 32 << 20
_CHUNK = 1 << 19


def seeds(text: np.ndarray, length: int = LENGTH, k: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of each winnowed seed and of the strings of `length` bytes whose leftmost least
    k-gram it is: those that start at `first` to `last`.

    Every string has one seed, which depends on the string alone: equal strings have equal seeds in
    equal places.
    """
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, n, power = text.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while n < k:
        h = h[:-n] * np.uint64(power) + h[n:]
        n, power = 2 * n, power * power % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    window, found = length - k + 1, []
    low = np.uint64((1 << 20) - 1)
    for first in range(0, len(h) - window + 1, _CHUNK):
        part = h[first : first + _CHUNK + window - 1]
        least, n = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * n <= window:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        if n < window:
            least = np.minimum(least[: n - window], least[window - n :])
        found.append(first + (least & low).astype(np.int64))
    at = np.concatenate(found) if len(found) > 1 else found[0]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[first]], first, np.r_[first[1:], len(at)] - 1


def _bytes(x: pa.Scalar) -> bytes:
    t = x.as_py()
    return t.encode("utf-8", "surrogatepass") if t else b""


def _pack(values: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(np.diff(values, prepend=0).astype("<i8").tobytes(), asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(blob, 8 * n, asbytes=True), "<i8"))


def _ties(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number in that order) of rows with equal keys; the last key only orders."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys[:-1]:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.cumsum(new)


def shared_seeds(docs: DataFrame, lists: int, hot: int, length: int, k: int) -> DataFrame:
    """doc_id, variant, seed: seeds of each row of `docs` (doc_id, variant, text) that other documents also
    have (never too few; now and then one too many, where 32-bit hashes in a list collide). Without
    doc_id: seeds of over `hot` documents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            many = [len(h) for _, _, h in held]
            doc, variant = (np.repeat(np.array([r[i] for r in held], np.int64), many) for i in (0, 1))
            seed = _seed(np.concatenate([h for _, _, h in held]), lists)
            order, group = _ties(seed, doc)
            seed, doc, variant = seed[order], doc[order], variant[order]
            first = np.r_[True, group[1:] != group[:-1]]
            several = np.maximum.reduceat(doc, np.flatnonzero(first)) != doc[first]
            inside = several[group]  # known to be shared without asking other packings
            rows = [(lists + int(seed[0] % lists), *row(seed[inside], doc[inside], variant[inside], None))] if inside.any() else []
            again = first | (variant != np.r_[0, variant[:-1]])  # a packing's first row of a seed stands for its document, rows of other texts of its id for themselves
            count = np.zeros(len(seed), np.int64)
            count[first] = np.diff(np.r_[np.flatnonzero(first), len(seed)])  # rows are distinct (seed, document) pairs, but for repeats in a document
            pick = first | (again & ~inside)
            seed, doc, variant, count = seed[pick], doc[pick], variant[pick], count[pick]
            number = seed >> 32
            cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(seed)]):
                rows.append((int(number[a]), *row(seed[a:b], doc[a:b], variant[a:b], count[a:b])))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["list", "n", "seeds", "docs", "variants", "many"])

        def row(seed: np.ndarray, doc: np.ndarray, variant: np.ndarray, many: np.ndarray | None) -> tuple[int, bytes, bytes, bytes, bytes | None]:
            by_doc = np.lexsort((variant, doc))
            seed, doc, variant = seed[by_doc], _pack(doc[by_doc]), _pack(variant[by_doc])
            if many is None:
                return len(seed), seed.astype("<i8").tobytes(), doc, variant, None
            return len(seed), (seed & 0xFFFFFFFF).astype("<u4").tobytes(), doc, variant, _pack(many[by_doc])

        size = 0
        for b in batches:
            for doc, variant, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h, _, _ = seeds(np.frombuffer(_bytes(x), np.uint8), length, k)
                if len(h):
                    held.append((doc, variant, h))
                    size += len(h)
                if size >= PACKED:
                    yield flush()
                    held, size = [], 0
                    release()
        if held:
            yield flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = None, []

        def shared() -> Iterator[pa.RecordBatch]:
            seed, doc, variant, many = (np.concatenate(c) for c in zip(*parts))
            if number < lists:
                order, group = _ties(seed, doc)
                seed, doc, variant = seed[order], doc[order], variant[order]
                first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                often = seed[first[np.add.reduceat(many[order], first) > hot]]
                none = pa.nulls(len(often), pa.int64())
                yield pa.record_batch([none, none, pa.array(often)], ["doc_id", "variant", "seed"])
                keep = (np.maximum.reduceat(doc, first) != doc[first])[group]
                seed, doc, variant = seed[keep], doc[keep], variant[keep]
            for i in range(0, len(seed), 100_000):
                yield pa.record_batch([pa.array(c[i : i + 100_000]) for c in (doc, variant, seed)], ["doc_id", "variant", "seed"])

        for b in batches:
            for i, n in enumerate(b.column(1).to_pylist()):
                row = {c: b.column(c)[i].as_py() for c in ("list", "seeds", "docs", "variants", "many")}
                if parts and row["list"] != number:
                    yield from shared()
                    parts = []
                    release()
                number = row["list"]
                # lists from `lists` on hold whole seeds that are known to be shared, the others 32 bits each
                seed = np.frombuffer(row["seeds"], "<i8") if number >= lists else np.frombuffer(row["seeds"], "<u4").astype(np.int64) | number << 32
                many = _unpack(row["many"], n) if number < lists else np.zeros(n, np.int64)
                parts.append((seed, _unpack(row["docs"], n), _unpack(row["variants"], n), many))
        if parts:
            yield from shared()

    packed = map_batches(docs.select("doc_id", "variant", "text"), pack, "list long, n int, seeds binary, docs binary, variants binary, many binary")
    return map_batches(packed.repartition("list").sortWithinPartitions("list"), compare, "doc_id long, variant long, seed long")


def _matrix(text: np.ndarray, start: np.ndarray, size: np.ndarray, widest: int) -> np.ndarray:
    """Rows of `text` from each start, zero behind each size (`text` has to go on for `widest` bytes)."""
    out = np.lib.stride_tricks.sliding_window_view(text, widest)[start]
    out[np.arange(widest) >= size[:, None]] = 0
    return out


def _joined(texts: list[bytes], widest: int) -> np.ndarray:
    return np.frombuffer(b"".join(texts) + bytes(widest), np.uint8)


def repeats(matrix: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the strings of `length` bytes that a row of a smaller document also has."""
    row, offset, run = collection_suffixes(matrix, size, length, leave=True)
    if not len(row):
        return row, offset
    owner = doc[row]
    least = np.minimum.reduceat(owner, np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))
    hit = owner > least[run - run[0]]
    return row[hit], offset[hit]


def _parts(key: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Places of a sorted key between which parts of about `most` rows end, keys whole."""
    at = 0
    while at < len(key):
        end = min(at + most, len(key))
        end = int(np.searchsorted(key, key[end - 1], "right"))
        yield at, end
        at = end


def _several(key: np.ndarray, doc: np.ndarray, rows: int = 2) -> np.ndarray:
    """Which rows of a sorted key belong to keys of several documents and of so many rows."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.diff(np.r_[first, len(key)])
    ok = (np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)) & (many >= rows)
    return np.repeat(ok, many)


def candidates(docs: DataFrame, hot: np.ndarray, length: int, k: int, lists: int) -> DataFrame:
    """bucket, n, settled, packed of `docs` (doc_id, variant, text, seeds: the shared ones).

    Each row packs key, document, start, size and bytes of the surroundings of a bucket's seeds: the
    strings of a shared seed, keyed by the seed; strings of a hot seed come one by one, keyed by a
    hash of the string. Settled rows pack spans that a smaller document of the same lot has too; those
    strings travel no further.
    """
    widest, sent = 2 * length - k, docs.sparkSession.sparkContext.broadcast(hot)  # at most a million seeds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bytes]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            many = [len(r[2]) for r in held]
            doc, variant, base = (np.repeat(np.array(c, np.int64), many) for c in ([r[0] for r in held], [r[1] for r in held], np.cumsum([0, *(len(r[5]) for r in held[:-1])])))
            seed, start, last = (np.concatenate([r[i] for r in held]) for i in (2, 3, 4))
            text = _joined([r[5] for r in held], widest)
            order = np.argsort(seed, kind="stable")
            seed, doc, variant, base, start, size = seed[order], doc[order], variant[order], base[order], start[order], (last - start)[order] + length
            low, high = np.zeros(len(seed), np.int64), size - length  # what still has to meet other lots
            rest, own = np.ones(len(seed), bool), np.flatnonzero(_several(seed, doc, OFTEN))
            for a, b in _parts(seed[own], SORTED):
                i = own[a:b]
                hit = repeats(_matrix(text, base[i] + start[i], size[i], widest), size[i], doc[i], length)
                open_ = np.arange(widest - length + 1) <= high[i][:, None]
                open_[hit] = False
                rest[i], low[i], high[i] = open_.any(1), open_.argmax(1), open_.shape[1] - 1 - open_[:, ::-1].argmax(1)
                if len(hit[0]):
                    yield pack_settled(*_merge(doc[i][hit[0]], variant[i][hit[0]], start[i][hit[0]] + hit[1], np.full(len(hit[0]), length)))
            seed, doc, variant, base, start, size = seed[rest], doc[rest], variant[rest], base[rest], (start + low)[rest], (high - low)[rest] + length
            warm = np.isin(seed, sent.value)
            yield from pack_open(seed[~warm], doc[~warm], variant[~warm], start[~warm], base[~warm], size[~warm], text)
            warm = np.flatnonzero(warm)
            strings = np.cumsum(size[warm] - length + 1)
            at = 0
            while at < len(warm):
                end = max(at + 1, int(np.searchsorted(strings, (strings[at - 1] if at else 0) + SLICE)))
                i = np.repeat(warm[at:end], (size - length + 1)[warm[at:end]])
                step = np.arange(len(i)) - np.repeat(np.flatnonzero(np.r_[True, i[1:] != i[:-1]]), (size - length + 1)[warm[at:end]])
                key = -1 - (_hash(_matrix(text, base[i] + start[i] + step, np.full(len(i), length), length)) >> np.uint64(1)).astype(np.int64)
                yield from pack_open(key, doc[i], variant[i], start[i] + step, base[i], np.full(len(i), length), text)
                at = end

        def pack_settled(doc: np.ndarray, variant: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            return batch([(int(doc[0]) % (2 * lists), len(doc), True, _pack_rows(doc, doc, variant, start, size, b""))])

        def pack_open(key: np.ndarray, doc: np.ndarray, variant: np.ndarray, start: np.ndarray, base: np.ndarray, size: np.ndarray, text: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = _bucket(key, 2 * lists)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(bucket) else []
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                i = order[a:b]
                around = _matrix(text, base[i] + start[i], size[i], widest)[np.arange(widest) < size[i][:, None]].tobytes()
                rows.append((int(bucket[i[0]]), len(i), False, _pack_rows(key[i], doc[i], variant[i], start[i], size[i], around)))
            if rows:
                yield batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "n", "settled", "packed"])

        n = bytes_ = 0
        for b in batches:
            for doc, variant, x, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                text = _bytes(x)
                h, first, last = seeds(np.frombuffer(text, np.uint8), length, k)
                seed = _seed(h, lists)
                mine = np.isin(seed, known.values.to_numpy())
                if mine.any():
                    held.append((doc, variant, seed[mine], first[mine], last[mine], text))
                    n, bytes_ = n + int(mine.sum()), bytes_ + len(text)
                if n >= LOT or bytes_ >= LOT_BYTES:
                    yield from flush()
                    held, n, bytes_ = [], 0, 0
                    release()
        if held:
            yield from flush()

    return map_batches(docs, run, "bucket long, n int, settled boolean, packed binary")


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _pack_rows(key: np.ndarray, doc: np.ndarray, variant: np.ndarray, start: np.ndarray, size: np.ndarray, around: bytes) -> bytes:
    """Rows in columns, compressed, behind the plain size (8 bytes)."""
    plain = b"".join(c.astype(t).tobytes() for c, t in ((key, "<i8"), (np.diff(doc, prepend=0), "<i8"), (variant, "<i8"), (start, "<i4"), (size, "<i4"))) + around
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(plain, asbytes=True)


def _unpack_rows(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    plain = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    key, doc, variant = (np.frombuffer(plain, "<i8", n, at * n) for at in (0, 8, 16))
    start, size = (np.frombuffer(plain, "<i4", n, at * n).astype(np.int64) for at in (24, 28))
    return key, np.cumsum(doc), variant, start, size, plain[32 * n :]


def _seed(h: np.ndarray, lists: int) -> np.ndarray:
    """Number of the list (high half) and 32 bits of the hash."""
    return ((h >> np.uint64(32)) % np.uint64(lists)).astype(np.int64) << 32 | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _hash(matrix: np.ndarray) -> np.ndarray:
    """Hash of every row of bytes, eight at a time."""
    words = np.pad(matrix, ((0, 0), (0, -matrix.shape[1] % 8))).view("<u8")
    h = np.zeros(len(matrix), np.uint64)
    for column in words.T:
        h = (h ^ (h >> np.uint64(31)) ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(32)


def _merge(doc: np.ndarray, variant: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch or overlap as one."""
    if not len(doc):
        return doc, variant, start, size
    order = np.lexsort((start, variant, doc))
    doc, variant, start, end = doc[order], variant[order], start[order], (start + size)[order]
    other = np.r_[False, (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])]
    far = np.cumsum(other) << 32
    reach = np.maximum.accumulate(end + far)  # of the spans of the same text
    at = np.flatnonzero(np.r_[True, (start + far)[1:] > reach[:-1]] | other)
    return doc[at], variant[at], start[at], np.maximum.reduceat(end, at) - start[at]


def spans(found: DataFrame, length: int) -> DataFrame:
    """doc_id, variant, start, size of removed spans, from `candidates`. A task holds one bucket at a time."""
    widest = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def out(doc: np.ndarray, variant: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(doc), pa.array(variant), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["doc_id", "variant", "start", "size"])

        def search() -> Iterator[pa.RecordBatch]:
            key, doc, variant, start, size = (np.concatenate(c) for c in list(zip(*held))[:5])
            text, place = _joined([h[5] for h in held], widest), np.cumsum(size) - size
            held.clear()
            order = np.argsort(key, kind="stable")
            order = order[_several(key[order], doc[order])]
            for a, b in _parts(key[order], SORTED):
                i = order[a:b]
                row, offset = repeats(_matrix(text, place[i], size[i], int(size[i].max())), size[i], doc[i], length)
                if len(row):
                    i = i[row]
                    yield out(*_merge(doc[i], variant[i], start[i] + offset, np.full(len(row), length)))

        for b in batches:
            for i, (bucket, n, settled) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                rows = _unpack_rows(b.column(3)[i].as_py(), n)
                if settled:
                    yield out(*rows[1:5])
                    continue
                if held and bucket != current:
                    yield from search()
                    release()
                current = bucket
                held.append(rows)
        if held:
            yield from search()

    return map_batches(found.repartition("bucket").sortWithinPartitions("bucket"), run, "doc_id long, variant long, start int, size int")


def merged_spans(every: DataFrame) -> DataFrame:
    """Stored table doc_id, variant, spans: array of struct(start, size), in order and apart, from doc_id, variant, start, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int32()), ("size", pa.int32())])
        for b in batches:
            lists = b.column(2)
            start, size = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            row, _, start, size = _merge(row, np.zeros(len(row), np.int64), start, size)
            merged = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], fields=list(kind))
            ends = np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, merged)], ["doc_id", "variant", "spans"])

    lists = every.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("start", "size")).alias("spans"))  # bounded by the text
    return store(map_batches(lists, run, "doc_id long, variant long, spans array<struct<start:int,size:int>>"), "spans")


def _mark(text: Column) -> Column:
    """What tells different texts of one id apart."""
    return F.xxhash64(F.lit(LENGTH), text)


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Stored tables doc_id, variant, spans (array of struct(start, size) of bytes to remove, in order and
    apart) and doc_id: the ids of different texts.

    `docs`: doc_id, text. Only texts with spans have a row. variant: 0, but `_mark` of the text where an
    id has different texts. Rows without id take no part.
    """
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = F.octet_length("text").cast("long")
    whole = store(docs.select("doc_id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha"), size.alias("size"), _mark(F.col("text")).alias("mark")), "whole")
    mixed = store(whole.groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).filter("a <> b").select("doc_id"), "mixed")
    least = store(whole.filter(F.col("size") >= length).groupBy("sha").agg(F.min("doc_id").alias("least")), "least")
    copies = _variants(whole.join(least, "sha").filter("doc_id > least"), mixed, F.col("mark"))
    copies = store(copies.select("doc_id", "variant", F.col("size").cast("int").alias("size")).distinct(), "copies")
    total = whole.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    lists, expected = 64, 2 * total // (length - k + 2)
    while lists * LIST_SEEDS < expected:
        lists *= 2
    docs = _variants(docs.filter(size >= length), mixed, _mark(F.col("text"))).select("doc_id", "variant", "text")
    single = docs.join(small(copies.select("doc_id", "variant")), ["doc_id", "variant"], "left_anti")
    shared = store(shared_seeds(single, lists, max(HOT, expected // 1_000_000), length, k), "shared")
    hot = np.sort(shared.filter(F.col("doc_id").isNull()).select("seed").toArrow().column(0).to_numpy())
    known = shared.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "variant").agg(F.collect_set("seed").alias("seeds"))
    found = candidates(docs.join(known, ["doc_id", "variant"]).select("doc_id", "variant", "text", "seeds"), hot, length, k, lists)
    merged = merged_spans(spans(found, length).unionAll(copies.select("doc_id", "variant", F.lit(0).alias("start"), "size")))
    for table in (whole, least, copies, shared):
        drop_stored(table)
    return merged, mixed


def _variants(rows: DataFrame, mixed: DataFrame, mark: Column) -> DataFrame:
    """`rows` and their variant: `mark` where an id has different texts, else 0."""
    if not mixed.head(1):
        return rows.withColumn("variant", F.lit(0).cast("long"))
    flagged = rows.withColumn("variant", mark).join(small(mixed.withColumn("_mixed", F.lit(True))), "doc_id", "left")
    return flagged.withColumn("variant", F.when(F.col("_mixed"), F.col("variant")).otherwise(F.lit(0))).drop("_mixed")


def _with_spans(docs: DataFrame, length: int, k: int) -> DataFrame:
    """`docs` (doc_id, text and more) and a last column of spans, null where nothing is removed."""
    found, mixed = repeated_spans(docs.select("doc_id", "text"), length, k)
    n = found.agg(F.coalesce(F.sum(24 + 8 * F.size("spans")), F.lit(0)).alias("b")).first()["b"]
    doc, variant, got, odd = fresh(docs, "_doc", "_variant", "_spans", "_odd")
    found = found.select(F.col("doc_id").alias(doc), F.col("variant").alias(variant), F.col("spans").alias(got))
    found = F.broadcast(found) if n <= BROADCAST_BYTES else found
    if not mixed.head(1):
        return docs.join(found, docs["doc_id"] == found[doc], "left").drop(doc, variant)
    mixed = small(mixed.select(F.col("doc_id").alias(odd)))
    flagged = docs.join(mixed, docs["doc_id"] == mixed[odd], "left")
    same = (flagged["doc_id"] == found[doc]) & (F.when(flagged[odd].isNull(), F.lit(0)).otherwise(_mark(flagged["text"])) == found[variant])
    return flagged.join(found, same, "left").drop(doc, variant, odd)


def cut(text: bytes, spans: pa.Scalar) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    if not spans.is_valid or not len(spans):
        return text, 0, 0
    start, size = (spans.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
    edge = [0, *np.stack([start, start + size], 1).ravel().tolist(), len(text)]
    return b"".join(text[i:j] for i, j in zip(edge[::2], edge[1::2])), int(size.sum()), len(start)


def deduplicate(docs: DataFrame, length: int = LENGTH, k: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs`.

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller id;
    overlaps count, and strings are judged on the input. Null text counts as empty. Ids tell documents
    apart: repeated rows are cut alike, different texts of an id are cut each by itself, and neither
    repeat each other; rows without id are never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for x, spans in zip(b.column(1), b.column(2)):
                text = _bytes(x)
                kept, removed, runs = cut(text, spans)
                for column, v in zip(out, (len(text), removed, runs, hashlib.sha256(kept).hexdigest())):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, k)
    return map_batches(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = SEED) -> DataFrame:
    """`docs` with what `deduplicate` leaves of each text (and n_chars, if there, counted anew).

    Characters that a cut splits go. Rows of which nothing is left go; rows that had no text stay.
    """
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x, spans in zip(b.column(place), b.column(len(names))):
                texts.append(cut(_bytes(x), spans)[0].decode("utf-8", "ignore") if spans.is_valid else x.as_py())
            gone = pa.array([bool(s.is_valid) and not t for s, t in zip(b.column(len(names)), texts)], pa.bool_())
            cols = [pa.array(texts, pa.string()) if i == place else b.column(i) for i in range(len(names))]
            yield pa.record_batch(cols, names).filter(pa.compute.invert(gone))

    out = map_batches(_with_spans(docs, length, k), run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
