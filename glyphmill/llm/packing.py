"""Best-fit packing planned on the histogram of lengths.

Documents are cut into pieces of at most one sequence. Best fit then runs over the counts of the
pieces' lengths, longest first, not over pieces: the plan says which ranks of each length go to which
run of sequences at which offset. Pieces take their planned slots by their rank within their length.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.shared import BROADCAST_ROWS, map_batches, store
from glyphmill.llm.token_count import byte_alphabet

CAPACITY = 2048
#: Pieces of one length are numbered in so many buckets apart at least, and in more where buckets would get
#: more than so many pieces, so that no task holds a whole length.
RANK_BUCKETS, BUCKET_PIECES = 64, 500_000
#: Chunks that one generation of a worker's memory holds, and the longest that it keeps.
MEMORY, LONGEST_KEPT = 250_000, 64
#: Pre-tokens of the vocabulary's format (a fixed value), for lower-cased printable Latin-1 without white space.
LATIN_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"
#: A lone mark between a word and white space is a pre-token of its own, so it may as well be a chunk.
WORD_END = r"(?<=[a-z0-9ß-öø-ÿ])[.,](?=\s)"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder(dict):
    """Text -> little-endian unsigned 32-bit ids, through a memory of chunks; a dict of that memory.

    Gives what the library's encode (no added special tokens) gives. The vocabulary drops white space
    and never looks across it, so a text's ids are those of its chunks between white space, and the
    merges run only for what is not remembered: printable chunks of Latin-1 characters are cut here and
    merged by pre-token, others go through the library's encode. Two generations of memory keep what comes
    up again. Texts of Latin-1 characters, whose lower case is beyond doubt, are lowered whole, and marks
    behind words are parted from them, which leaves fewer chunks to know. Special
    strings are cut out of the raw text first; texts with U+001C to U+001F, which Python alone takes for
    white space, go to the library whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = {t.content: np.uint32(i).tobytes() for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.pieces, self.old = re.compile(LATIN_PRE_TOKEN).findall, {}
        self.part, self.memory, self.merged = re.compile(WORD_END).sub, memory, Merged(self.tok.model.tokenize, memory // 2)

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.old.get(chunk)) is None:
            if chunk.isprintable() and (chunk.isascii() or _is_latin(chunk)):
                ids = b"".join([self.merged[p] for p in self.pieces(chunk.lower())])
            else:
                ids = _packed(self.tok.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) > self.memory:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return b"".join(self.special.get(p) or self.encode(p) for p in self.cut(text))
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text.isascii() or _is_latin(text):
            text = self.part(r" \g<0>", text.lower())
        return b"".join(map(self.__getitem__, text.split()))


class Merged(dict):
    """Pre-token -> ids; a memory of merges that starts again when full."""

    def __init__(self, merge, memory: int):
        super().__init__()
        self.merge, self.memory, self.letter = merge, memory, [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]

    def __missing__(self, piece: str) -> bytes:
        ids = _packed([t.id for t in self.merge(piece if piece.isascii() else "".join([self.letter[b] for b in piece.encode()]))])
        if len(piece) <= LONGEST_KEPT:
            if len(self) > self.memory:
                self.clear()
            self[piece] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", memory: int = MEMORY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and `end_id`, cut only where longer than a sequence.

    Null text counts as empty: its one piece holds the end id alone. Texts stay where they were read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path, memory), np.uint32(end_id).tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.encode(x.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, PIECES)


@dataclass
class Plan:
    """Runs sorted by (length, rank): ranks from `rank` on go to sequences from `sequence` on, at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks."""
        span = int(max(self.rank.max(initial=0), rank.max(initial=0))) + 1
        at = np.searchsorted(self.length * span + self.rank, length * span + rank, "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit over counts, longest first: every piece goes where the least room stays, else opens a sequence.

    Sequences with equal room are kept as runs of neighbouring numbers, so the work depends on the
    number of lengths and runs, not on the number of pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room -> runs (first, how many)
    opened, out = 0, []
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a sequence of {capacity}")
        left, rank, free = counts[length], 0, length
        while left:
            while free <= capacity and not room[free]:
                free += 1
            if free <= capacity:
                first, n = room[free].pop()
                if n > left:
                    room[free].append((first + left, n - left))
                take, gap = min(n, left), free
            else:
                fit = capacity // length
                take, gap, first = -(-left // fit), capacity, opened  # as many sequences as all of them need
                opened += take
            out.append((length, rank, first, capacity - gap))
            room[gap - length].append((first, take))
            rank, left = rank + take, left - take
            if gap - length >= length:  # the sequences just used are now the tightest fit
                free = min(free, gap - length)
    cols = np.array(sorted(out), dtype=np.int64).reshape(-1, 4)
    return Plan(*cols.T, opened)


def rank_within(df: DataFrame, counts: DataFrame, order: list[str], least: int = RANK_BUCKETS, most: int = BUCKET_PIECES) -> DataFrame:
    """`df` with _rank: gapless from 0 within `length`, numbered in hashed buckets that are laid end to end.

    `counts`: stored table length, n, a sequence's lengths at most. Buckets per length follow from n.
    """
    counts = counts.select(F.col("length").alias("_l"), F.greatest(F.lit(least), F.ceil(F.col("n") / most)).cast("int").alias("_many"))
    starts = counts.agg(F.coalesce(F.sum("_many"), F.lit(0))).first()[0]
    df = df.join(F.broadcast(counts), F.col("length") == F.col("_l")).withColumn("_b", F.pmod(F.xxhash64(*order), F.col("_many")).cast("int")).drop("_l", "_many")
    sizes = df.groupBy(F.col("length").alias("_g"), F.col("_b").alias("_gb")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_g").orderBy("_gb").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_g", "_gb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    df = df.withColumn("_r", F.row_number().over(W.partitionBy("length", "_b").orderBy(*order)) - 1)
    sizes = F.broadcast(sizes) if starts <= BROADCAST_ROWS else sizes  # three numbers a row
    out = df.join(sizes, (F.col("length") == F.col("_g")) & (F.col("_b") == F.col("_gb")))
    return out.withColumn("_rank", F.col("_from") + F.col("_r")).drop("_b", "_g", "_gb", "_from", "_r")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", memory: int = MEMORY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece in its sequence.

    `memory`: chunks in a generation of a worker's memory; results do not depend on it. The driver
    sees the histogram of lengths (at most `capacity` rows). Repeated rows are packed as
    often as they occur; an empty table gives no rows. Texts are read once and never shuffled.
    """
    spark = docs.sparkSession
    cut = store(pieces(docs, path, capacity, end_id, key, text, memory), "pieces")
    counts = store(cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    plan = plan_best_fit({r["length"]: r["n"] for r in counts.collect()}, capacity)
    sent = spark.sparkContext.broadcast((plan.length, plan.rank, plan.sequence, plan.offset, plan.sequences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(*sent.value)
        for b in batches:
            sequence, offset = plan.place(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = rank_within(cut, counts, ["doc_id", "piece", "ids_crc32"])
    return map_batches(ranked, run, f"{PIECES}, sequence_id long, offset long")
