"""Samples, top rows, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.operators.ranking import hash_order, ranged_rank, shuffled_rank


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows in order with their rank (the sampling of a report, so a limit is meant)."""
    head = df.orderBy(*order).limit(k)
    return head.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def top_k_per_group(df: DataFrame, by: Sequence[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def quantile_picks(df: DataFrame, by: Sequence[str], order: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Rows at the places floor(n * share) of each group, with share."""
    ranked = ranged_rank(df, by, [F.col(c) for c in order], rank="_at", total="_n")
    out = ranked.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return out.filter(F.col("_at") - 1 == F.floor(F.col("_n") * F.col("share"))).drop("_at", "_n")


def sample_exact(df: DataFrame, n: int, key: str, seed: str = "42") -> DataFrame:
    """Exactly n rows (all, if fewer), the first in seeded hash order."""
    return df.orderBy(hash_order(F.col(key), seed=seed), F.col(key)).limit(n)


def replay_buffer(df: DataFrame, by: Sequence[str], key: str, share: float = 0.15) -> DataFrame:
    """max(1, floor(n * share)) rows of each group, in seeded hash order."""
    out = shuffled_rank(df, by, key, rank="_rn", total="_n")
    return out.filter(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))).drop("_rn", "_n")


def mixed_batches(first: DataFrame, second: DataFrame, key: str, size: int, ratio: float) -> DataFrame:
    """batch_no, pool, key: batches of floor(size * ratio) (at least 1) rows of the first pool, the rest of the second.

    As many batches as the first pool fills; a second pool that is too small starts over.
    """
    n1 = max(1, int(size * ratio))
    n2 = size - n1
    a = shuffled_rank(first.select(key), [], key, rank="_rn", total="_n").withColumn("batch_no", F.floor((F.col("_rn") - 1) / n1))
    a = a.filter(F.col("batch_no") < F.floor(F.col("_n") / n1))
    batches = a.groupBy("batch_no").agg(F.lit(1).alias("_one"))
    b = shuffled_rank(second.select(key), [], key, rank="_rn", total="_n")
    turns = F.greatest(F.lit(1), F.floor(F.col("_n") / n2)) if n2 else F.lit(1)
    b = b.withColumn("_turn", F.floor((F.col("_rn") - 1) / max(n2, 1))).filter(F.col("_turn") < turns)
    rounds = b.agg(F.max("_turn").alias("_m")).scalar()
    need = batches.withColumn("_turn", F.pmod(F.col("batch_no"), rounds + 1))
    b = need.join(b, "_turn").select("batch_no", F.lit("second").alias("pool"), key)
    return a.select("batch_no", F.lit("first").alias("pool"), key).unionAll(b)


def pseudo_lines(df: DataFrame, by: Sequence[str], key: str, label: str, word_share: float, least: int, most: int, seed: int = 42) -> DataFrame:
    """Labels of pseudo-lines in each batch: a sample stays alone with probability `word_share`, else it takes
    the next `least` to `most` samples (itself included, fewer at the end). Draws are hashes of the key."""
    text = F.col(key).cast("string")
    draw = lambda what: F.conv(F.substring(F.md5(F.concat(text, F.lit(f"{what}{seed}"))), 1, 12), 16, 10).cast("double") / float(16**12)
    takes = F.when(draw("alone") < word_share, 1).otherwise(least + F.floor(draw("count") * (most - least + 1))).cast("int")
    sample = F.struct(F.md5(F.concat(text, F.lit(str(seed)))).alias("h"), text.alias("k"), takes.alias("takes"), F.coalesce(F.col(label), F.lit("")).alias("label"))
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(sample)).alias("rows"))  # a batch

    def line(words: Column, label: Column) -> Column:
        return F.struct(words.cast("int").alias("words"), label.alias("label"))

    def state(left: Column, open_: Column, done: Column) -> Column:
        return F.struct(left.cast("int").alias("left"), open_.alias("open"), done.alias("done"))

    def add(acc: Column, x: Column) -> Column:
        first = acc["left"] == 0
        grown = F.when(first, line(F.lit(1), x["label"])).otherwise(line(acc["open"]["words"] + 1, F.concat_ws(" ", acc["open"]["label"], x["label"])))
        done = F.when(first & (acc["open"]["words"] > 0), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return state(F.when(first, x["takes"]).otherwise(acc["left"]) - 1, grown, done)

    lines = F.array().cast("array<struct<words:int,label:string>>")
    folded = F.aggregate("rows", state(F.lit(0), line(F.lit(0), F.lit("")), lines), add, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return rows.select(*by, F.posexplode(folded).alias("line_no", "l")).select(*by, "line_no", "l.words", "l.label")
