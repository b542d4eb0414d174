"""Exact ranks without one task per group.

Rows are numbered inside order-preserving buckets, and each bucket starts where the buckets before it
end. The starts, one row per group and bucket, travel as marks among the rows: no join, no broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Buckets of a range, and rows looked at for each of them, unless the caller names others.
RANGES, SAMPLE = 256, 40


def hash_order(*keys: Column, seed: str = "42") -> Column:
    """Order that stands for a seeded shuffle: md5 of the keys' text and the seed."""
    return F.md5(F.concat(*[k.cast("string") for k in keys], F.lit(seed)))


def _free(df: DataFrame, *names: str) -> list[str]:
    """`names`, lengthened where a column of `df` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def bucketed_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Column, rank: str = "rn", total: str | None = None) -> DataFrame:
    """`df` with the 1-based rank of each row within `by` (and the size of the group).

    `bucket` has to be monotone in `order`: rows of a lower bucket come before those of a higher one. Groups
    are compared null-safely. One shuffle of the rows, by group and bucket; the counts that the
    starts are made of come from another reading of `by` and `order` alone, combined before their shuffle.
    """
    part, size, start, whole, mark = _free(df, "_bucket", "_size", "_start", "_whole", "_mark")
    df = df.withColumn(part, bucket)
    sizes = df.groupBy(*by, part).agg(F.count(F.lit(1)).alias(size))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum(size).over(group.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a group's buckets
    marks = sizes.select(*by, part, before.alias(start), F.sum(size).over(group).alias(whole), F.lit(True).alias(mark))
    rows = df.withColumn(mark, F.lit(False)).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy(*by, part).orderBy(F.col(mark).desc(), *order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn(rank, F.sum(F.when(F.col(mark), F.col(start)).otherwise(1)).over(w))
    if total:
        out = out.withColumn(total, F.first(whole, True).over(w))
    return out.filter(~F.col(mark)).drop(part, start, whole, mark)


def range_bucket(df: DataFrame, keys: Sequence[Column], buckets: int = RANGES, sample: int = SAMPLE) -> Column:
    """Bucket of a row, monotone in `keys` taken together (ascending, nulls first): the number of bounds up to it.

    Bounds are quantiles of about `sample` x `buckets` rows drawn at random, so that values count as often as
    they occur; one task sorts the draw and the bounds alone reach the driver. They are looked up by halving. Only rows
    that are equal in all keys have to share a bucket: end `keys` with what tells rows apart.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names)])
    n, wanted = rows.count(), sample * buckets
    some = rows if n <= wanted else rows.sample(wanted / n, 42)
    sorted_ = some.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("all"))  # one task, the draw alone
    step = F.greatest(F.lit(1), F.ceil(F.size("all") / buckets)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), F.floor((F.size("all") - 1) / step).cast("int")), lambda i: F.get("all", i * step))
    picks = sorted_.select(F.when(F.size("all") > step, F.array_distinct(picked)).alias("p")).select(F.to_json("p"), F.size("p"))
    bounds, many = picks.first()
    if not bounds:
        return F.lit(0)
    listed = F.from_json(F.lit(bounds), ArrayType(rows.schema))  # a constant to the optimiser
    own = F.struct(*[k.alias(n) for k, n in zip(keys, names)])
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(many.bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(listed, at + half - 1) <= own, at + half).otherwise(at))


def ranged_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rn", total: str | None = None, buckets: int = RANGES) -> DataFrame:
    """`bucketed_rank` in ascending `order` (nulls first) over ranges of group and order together.

    No task holds many more than 1 / `buckets` of all rows, whether groups are few and large or many and small,
    and whatever share of the rows has one first key; equal rows in all of `order` stay together.
    """
    keys = [*[F.col(c) for c in by], *order]
    return bucketed_rank(df, by, order, range_bucket(df, keys, buckets), rank, total)


def shuffled_rank(df: DataFrame, by: Sequence[str], key: str, seed: str = "42", rank: str = "rn", total: str | None = "n", digits: int = 3) -> DataFrame:
    """Ranks in seeded hash order; buckets are the first `digits` hex digits of the hash."""
    (h,) = _free(df, "_h")
    df = df.withColumn(h, hash_order(F.col(key), seed=seed))
    return bucketed_rank(df, by, [F.col(h), F.col(key)], F.substring(h, 1, digits), rank, total).drop(h)
