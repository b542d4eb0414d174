"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (lengths 1 to 3, blended, hashed) that both hold,
over the geometric mean of the numbers each holds. Nyström landmarks stand for the training rows, and
one ridge regression per language is solved in their span. At scoring time the landmark matrix and the
regressions are one matrix, so a batch of presence rows is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphmill.llm.shared import held_out, map_batches

#: Training rows and landmarks of each language at most; ridge; presence bits of each n-gram length.
TRAIN_ROWS, LANDMARKS, RIDGE = 400, 96, 1e-4
BITS = (256, 1 << 12, 1 << 14)
BATCH = 128
UNKNOWN = "und"
#: Documents of the training languages score more, even of one word (0.2 and more); other scripts score under 0.1.
LEAST_SCORE = 0.15
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def ngram_slots(text: str) -> np.ndarray:
    """Slots of the text's n-grams, repeats included: bytes as they are, pairs and triples hashed."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - 12)
    three = (b[:-2] * np.uint32(0xC2B2AE3D) + b[1:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0x165667B1)) >> np.uint32(32 - 14)
    return np.concatenate([b, BITS[0] + two, BITS[0] + BITS[1] + three])


def presence(texts: list[str]) -> np.ndarray:
    """One row of 0/1 per text, divided by the root of its ones (all zero for an empty text)."""
    out = np.zeros((len(texts), sum(BITS)), np.float32)
    for row, t in zip(out, texts):
        row[ngram_slots(t)] = 1
    return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # presence slots x languages

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best language and its regression value, held in [0, 1]; ties go to the first name."""
        scores = np.clip(presence(texts) @ self.weights, 0, 1)
        return [self.langs[i] for i in scores.argmax(1)], scores.max(1)


def solve(rows: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fit from packed presence bits (one row per text) and the texts' languages."""
    names = sorted(set(langs))
    y = np.array([[x == n for n in names] for x in langs], np.float64).reshape(len(langs), len(names))
    picked = np.concatenate([np.flatnonzero(y[:, j])[:landmarks] for j in range(len(names))]) if names else np.zeros(0, int)

    def unpack(part: np.ndarray) -> np.ndarray:
        x = np.unpackbits(part, axis=1)[:, : sum(BITS)].astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    marks = unpack(rows[picked]) if len(picked) else np.zeros((0, sum(BITS)), np.float32)
    knm = np.concatenate([np.zeros((0, len(picked))), *[(unpack(rows[i : i + BATCH]) @ marks.T).astype(np.float64) for i in range(0, len(rows), BATCH)]])
    kmm = (marks @ marks.T).astype(np.float64)
    left = knm.T @ knm + ridge * len(rows) * kmm + 1e-8 * np.eye(len(picked))
    alpha = np.linalg.solve(left, knm.T @ y) if len(picked) else np.zeros((0, len(names)))
    return LanguageModel(names, (marks.T @ alpha.astype(np.float32)))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Learn from rows (doc_id, text, lang) that have text, a language and an id that is not held out.

    Each language gives `train_rows` rows at most (bounded sample: hash of id and text below the
    language's share, the least of those if they are more). Only their packed presence bits reach the driver.
    """
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((sum(BITS), 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_rows / n))])
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.select("doc_id", "lang", "text", u.alias("u")).filter(F.col("u") < F.element_at(share, F.col("lang")))
    place = F.row_number().over(W.partitionBy("lang").orderBy("u", "doc_id", "text"))
    sample = sample.withColumn("place", place).filter(F.col("place") <= train_rows).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for x in b.column(2):
                row = np.zeros(sum(BITS), bool)
                row[ngram_slots(x.as_py())] = True
                bits.append(np.packbits(row).tobytes())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["doc_id", "lang", "bits"])

    got = sorted(map_batches(sample, run, "doc_id long, lang string, bits binary").collect(), key=lambda r: (r["lang"], str(r["doc_id"]), r["bits"]))
    packed = np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), -1)
    return solve(packed, [r["lang"] for r in got], landmarks, ridge)


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of Unicode's letter categories (numerals such as ½ or Ⅷ are none)."""
    return any(map(str.isalpha, text or ""))


def _predict(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray]:
    langs, scores = [UNKNOWN] * len(column), np.zeros(len(column))
    for at in range(0, len(column), BATCH):
        texts = [(at + i, t) for i, x in enumerate(column.slice(at, BATCH)) if has_letter(t := x.as_py())]
        if texts and model.langs:
            found, best = model.predict([t for _, t in texts])
            for (i, _), name, s in zip(texts, found, best):
                langs[i], scores[i] = name, s
    return langs, scores


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    `und` with score 0 where the text is null or holds no letter, or nothing was learned. Whole texts
    are read; repeated rows get equal answers; nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights))  # bounded: slots x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*sent.value)
        for b in batches:
            langs, scores = _predict(model, b.column(2))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return map_batches(rows, run, SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = LEAST_SCORE, languages: Sequence[str] | None = None) -> DataFrame:
    """The rows of `docs` whose text has a language: its best score is `least` or more, and it is one of `languages` if they are named.

    Null, empty and letterless texts go; texts in scripts or languages that no training text is in have scores near 0. Repeated rows
    are judged alike. All columns stay. Where nothing was learned there is nothing to judge by, and every text with a letter stays.
    """
    sent, place = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights)), docs.columns.index(text)
    wanted = None if languages is None else set(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*sent.value)
        for b in batches:
            column = b.column(place)
            if model.langs:
                keep = [x != UNKNOWN and s >= least and (wanted is None or x in wanted) for x, s in zip(*_predict(model, column))]
            else:
                keep = [has_letter(x.as_py()) for x in column]
            yield b.filter(pa.array(np.array(keep, bool)))

    return map_batches(docs, run, docs.schema)
