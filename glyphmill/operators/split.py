"""Train, validation and test assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.ranking import shuffled_rank

#: Writers of the official training pool that are held out for validation.
VAL_WRITERS = (230, 249)


def determined_split(pre_split: Column, writer: Column) -> Column:
    """Splits that the source fixes: author splits as they are, the training pool by writer number."""
    number = writer.try_cast("int")
    pool = F.when(number.between(*VAL_WRITERS), "val").otherwise("train")
    return F.when(pre_split.isin("train", "val", "test"), pre_split).when(pre_split == "train_pool", pool).otherwise("unresolved")


def ranked_split(rank: Column, total: Column, holdout: float) -> Column:
    """By rank: all but ceil(holdout * n) rows train, the last half (rounded up) of the rest test, between them val."""
    held = F.ceil(total * F.lit(holdout))
    test = F.ceil(held * F.lit(0.5))
    return F.when(rank <= total - held, "train").when(rank <= total - test, "val").otherwise("test")


def split_rows(df: DataFrame, key: str, by: Sequence[str] = (), holdout: float = 0.2) -> DataFrame:
    """Exact-proportion split of rows within each pool `by`, in seeded hash order: final_split."""
    out = shuffled_rank(df, list(by), key, rank="_rn", total="_total")
    return out.withColumn("final_split", ranked_split(F.col("_rn"), F.col("_total"), holdout)).drop("_rn", "_total")


def split_groups(df: DataFrame, group: str, holdout: float = 0.2) -> DataFrame:
    """Split of whole groups, so that no group is on two sides; the groups' splits are joined back."""
    groups = split_rows(df.select(group).distinct(), group, (), holdout)
    return df.join(groups, group)
