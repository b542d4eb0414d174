"""Sharding by weighted rendezvous hashing. DataFrame functions only.

Every shard scores every key with its own hash; the key goes to the best score. A shard that is added
only takes the keys it now wins, a shard that is removed only frees its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import fresh
from glyphmill.operators.ranking import bucketed_rank

#: Rows in a hash bucket that is numbered at once, over all shards.
SLOT_ROWS = 20_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the winning shard. Score: -weight / ln(u), u the hash of (key, shard) in (0, 1).

    With equal weights the largest u wins, so the logarithm is left out. Null keys count as one key.
    Shards of weight 0 or less get nothing. Ties (equal scores) go to the smaller number.
    """
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    even = len({w for _, w in live}) == 1
    scores = []
    for i, w in live:
        h = F.xxhash64(text, F.lit(i))
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
        scores.append(F.struct((h if even else -w / F.log(u)).alias("score"), F.lit(-i).alias("shard")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def slots(df: DataFrame, shard: str, key: Sequence[str], out: str = "slot", buckets: int | None = None) -> DataFrame:
    """Gapless numbers from 0 in each shard: rows are numbered in buckets by a hash of `key`, each of which starts where the one before it ends.

    Without `buckets` their number follows from the rows, SLOT_ROWS in each, so no task holds a whole shard. Repeated
    rows get numbers of their own.
    """
    if buckets is None:
        buckets = max(1, -(-df.count() // SLOT_ROWS))
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")
    (rank,) = fresh(df, "rank")
    ranked = bucketed_rank(df, [shard], [F.col(k) for k in key], bucket, rank)
    return ranked.withColumn(out, F.col(rank) - 1).drop(rank)


def shard_documents(docs: DataFrame, shards: int | Sequence[float], key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    `shards`: a count, or the shards' weights. grown_shard: the shard with one more shard (of mean
    weight). size: bytes of the text plus 16; null text: no bytes, crc32 0. A null key is a key like
    any other; repeated rows go to the same shard and get slots of their own. Only the digest columns
    are shuffled, never texts.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    grown = [*weights, sum(weights) / len(weights)]
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t) + 16).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
    out = slots(base, "shard", ["doc_id", "text_crc32", "size"], buckets=buckets)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
