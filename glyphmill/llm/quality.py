"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once and stored. Trees are grown on histograms of binned
statistics of a bounded sample of labelled rows, flattened into arrays (a complete tree per row of the
arrays), and all rows are scored by walking the arrays level by level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import held_out, map_batches, store

#: Expected labelled rows that are learned from, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH, LEAST = 150, 4, 64, 0.08, 5.0, 20
THRESHOLD = 0.7
FEATURES = (
    "bytes", "words", "letters", "digits", "spaces", "upper", "stops", "marks", "other_marks", "non_ascii", "entropy", "word_length",
    "distinct_words", "top_word", "repeats", "long_words", "short_words", "odd_ends", "lines", "line_length", "distinct_lines", "top_line", "repeated_trigrams",
)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def statistics(text: str) -> list[float]:
    """The FEATURES of a whole text; an empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    n, count = max(len(raw), 1), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = count[count > 0] / n
    stops, marks = count[[0x2E, 0x2C, 0x21, 0x3F, 0x3A, 0x3B]].sum(), count[0x21:0x30].sum() + count[0x3A:0x41].sum() + count[0x5B:0x61].sum() + count[0x7B:0x7F].sum()
    words, lines = text.split(), [x for x in text.split("\n") if x]
    m, k = max(len(words), 1), max(len(lines), 1)
    tally, line_tally = Counter(words), Counter(lines)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    triples = set(zip(words, words[1:], words[2:]))
    return [
        float(len(raw)), float(len(words)), (count[0x41:0x5B].sum() + count[0x61:0x7B].sum()) / n, count[0x30:0x3A].sum() / n, count[[9, 10, 13, 32]].sum() / n,
        count[0x41:0x5B].sum() / n, stops / n, marks / n, (marks - stops) / n, count[0x80:].sum() / n, float(-(p * np.log2(p)).sum()), lengths.sum() / m,
        len(tally) / m, max(tally.values(), default=0) / m, sum(map(eq, words, words[1:])) / m, float((lengths > 12).sum()) / m, float((lengths < 3).sum()) / m,
        sum(c for w, c in tally.items() if not w[-1].isalnum() and w[-1] not in ".,!?:;") / m,
        float(len(lines)), sum(map(len, lines)) / k, len(line_tally) / k, max(line_tally.values(), default=0) / k, 1 - len(triples) / max(len(words) - 2, 1) if len(words) > 2 else 0.0,
    ]


@dataclass
class Forest:
    """Complete binary trees as arrays: node i has the children 2i + 1 and 2i + 2; leaves hold values."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        inner, depth = self.feature.shape[1] if len(self.feature) else 0, int(np.log2(self.value.shape[1])) if len(self.value) else 0
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, smooth: float = SMOOTH, least: int = LEAST) -> Forest:
    """Boosted trees for log loss. A node that no split improves passes all rows to the left."""
    n, width = x.shape
    inner = 2**depth - 1
    if not n:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1)
    flat, total = code + np.arange(width) * bins, np.full(n, base)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, at = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * (width * bins) + flat).ravel()
            size = nodes * width * bins
            hist = [np.bincount(slot, np.repeat(w, width), size).reshape(nodes, width, bins).cumsum(2) for w in (g, h, np.ones(n))]
            (gl, hl, nl), (gs, hs, ns) = hist, (z[:, :, -1:] for z in hist)
            gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
            gain[(nl < least) | (ns - nl < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                j, cut = divmod(int(best[k]), bins)
                if gain[k, j, cut] > 1e-9 and cut < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][cut]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + smooth)
        total += value[t][leaf]
    return Forest(feature, threshold, value, base)


def statistics_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored table doc_id, held_out, x (binary: FEATURES as doubles) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(statistics(t.as_py() or ""), np.float64).tobytes() for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(x, pa.binary())], ["doc_id", "held_out", "x"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return store(map_batches(rows, run, "doc_id long, held_out boolean, x binary"), "statistics")


def fit(table: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Forest:
    """Trees from the labelled rows of a statistics table that are not held out.

    At most `train_rows` rows reach the driver, those with the smallest hashes of id and label. Null labels and labels of
    unknown documents are left out; a document counts once for each different label it has, a repeated
    document id for each of its rows.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).distinct()
    share = min(1.0, 1.2 * train_rows / max(known.count(), 1))
    u = F.pmod(F.xxhash64("doc_id", "y"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.withColumn("u", u).filter(F.col("u") < share)  # so that the last step sorts little
    some = table.join(picked, "doc_id").orderBy("u", "doc_id", "y", "x").limit(train_rows)
    got = sorted((r["doc_id"], r["y"], bytes(r["x"])) for r in some.select("doc_id", "y", "x").collect())
    x = np.frombuffer(b"".join(r[2] for r in got)).reshape(-1, len(FEATURES))
    return grow(x, np.array([r[1] for r in got]))


def score(table: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of a statistics table."""
    sent = table.sparkSession.sparkContext.broadcast((forest.feature, forest.threshold, forest.value, forest.base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(*sent.value)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(-1, len(FEATURES))
            s = forest.score(x)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(table.select("doc_id", "held_out", "x"), run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`: statistics, fit and score in one call."""
    table = statistics_table(docs)
    return score(table, fit(table, labels))
