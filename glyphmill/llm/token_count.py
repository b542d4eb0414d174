"""Exact token counts of a byte-level BPE vocabulary.

The vocabulary strings that encode alone as one token are proved once, before the data is read. A
pre-token found among them counts one; only the rest goes through the merges. Counts of space-led chunks of
pre-tokens are remembered in two generations of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import map_batches

#: Chunks that one generation of a worker's memory holds, and the longest that it keeps.
MEMORY, LONGEST_KEPT = 400_000, 64
#: Pre-token pattern of the vocabulary (a fixed value of its format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary files -> byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(odd)}


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings whose text is one pre-token and encodes alone as exactly that one token."""
    from tokenizers import Tokenizer

    tok, back, pattern = Tokenizer.from_file(path), byte_alphabet(), regex.compile(PRE_TOKEN)
    special = set(tok.get_added_tokens_decoder())
    texts, ids = [], []
    for piece, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a whole pre-token
        if i not in special and pattern.fullmatch(text) and len(pattern.findall(text)) == 1:
            texts.append(text)
            ids.append(i)
    found = tok.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, i, e in zip(texts, ids, found) if e.ids == [i])


class Chunks(dict):
    """Chunk that follows a single space -> number of tokens of " " + chunk; fills itself.

    The pre-token pattern takes a single space together with what follows it, so text in which every
    space stands alone between other characters falls apart there. Within a chunk, pre-tokens that are
    whole tokens count one, the rest is merged by the library.
    """

    def __init__(self, tok, whole: frozenset[str]):
        super().__init__()
        self.merge, self.whole, self.pieces, self.old = tok.model.tokenize, whole, regex.compile(PRE_TOKEN).findall, {}
        self.letter = [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]

    def count(self, text: str) -> int:
        found = self.pieces(text)
        rest = [p for p in found if p not in self.whole]
        return len(found) - len(rest) + sum(len(self.merge("".join([self.letter[b] for b in p.encode("utf-8")]))) for p in rest)

    def __missing__(self, chunk: str) -> int:
        if (n := self.old.get(chunk)) is None:
            n = self.count(f" {chunk}")
        if len(chunk) <= LONGEST_KEPT:
            if len(self) > MEMORY:
                self.old = dict(self)
                self.clear()
            self[chunk] = n
        return n


def counter(path: str, whole: frozenset[str]) -> Callable[[str], int]:
    """Function text -> number of tokens, as the library's encode without added special tokens gives it."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split
    chunks = Chunks(tok, whole)
    crowded = re.compile(r" \s|\s ").search

    def part(text: str) -> int:
        if text[:1].isspace() or text[-1:].isspace() or crowded(text):
            return chunks.count(text)
        first, *rest = text.split(" ")
        return chunks.count(first) + sum(map(chunks.__getitem__, rest))

    def count(text: str) -> int:
        parts = cut(text) if any(s in text for s in special) else [text]
        return sum(map(part, parts)) + len(parts) - 1

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null text counts as empty (no bytes, no tokens). Nothing is cut, padded or shuffled; repeated rows
    are counted alike; other columns are not read. `path` has to exist on every executor.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, whole.value)
        for b in batches:
            texts = b.column(1)
            n_bytes, n_tokens = [], []
            for x in texts:
                t = x.as_py() or ""
                n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
                n_tokens.append(count(t))
            yield pa.record_batch([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
