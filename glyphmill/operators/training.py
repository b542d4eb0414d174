"""Schedules and parameter statistics of training, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def learning_rate(step: Column, total: int, warmup: int) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    cosine = F.greatest(F.lit(0.0), F.lit(0.5) * (1 + F.cos(F.pi() * progress)))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(cosine)


def curriculum_phase(epoch: Column, phases: list[tuple[str, int, int]]) -> Column:
    """Name of the phase with start <= epoch < end; the last one beyond all. The list is part of the plan."""
    out = F.lit(phases[-1][0])
    for name, start, end in reversed(phases):
        out = F.when((epoch >= start) & (epoch < end), name).otherwise(out)
    return out


def layer_group(name: Column, layer: Column, split: int, rate: float) -> Column:
    """struct(part, rate) of a parameter: low encoder layers at a tenth, cross-attention at half, the rest full."""
    return (
        F.when(name.contains("crossattention"), F.struct(F.lit("cross_attention").alias("part"), F.lit(rate * 0.5).alias("rate")))
        .when(name.startswith("decoder"), F.struct(F.lit("decoder").alias("part"), F.lit(rate).alias("rate")))
        .when(layer < split, F.struct(F.lit("encoder_low").alias("part"), F.lit(rate * 0.1).alias("rate")))
        .otherwise(F.struct(F.lit("encoder_top").alias("part"), F.lit(rate).alias("rate")))
    )


def fisher_diagonal(gradients: DataFrame, name: str, vector: str) -> DataFrame:
    """name, pos, fisher: mean of squared gradients per position; vectors with a non-finite value are skipped."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    long = gradients.filter(finite).select(name, F.posexplode(vector).alias("pos", "_g"))
    g = F.col("_g").cast("double")
    return long.groupBy(name, "pos").agg(F.avg(g * g).alias("fisher"))


def ewc_penalty(fisher: DataFrame, anchor: DataFrame, current: DataFrame, strength: float, name: str) -> DataFrame:
    """name, penalty: strength / 2 times the sum of fisher * (current - anchor)^2 (tables name, pos, value)."""
    both = fisher.join(anchor.withColumnRenamed("value", "_a"), [name, "pos"]).join(current.withColumnRenamed("value", "_c"), [name, "pos"])
    d = F.col("_c") - F.col("_a")
    return both.groupBy(name).agg((F.lit(strength / 2) * F.sum(F.col("fisher") * d * d)).alias("penalty"))


def keep_last(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n checkpoints of each stage."""
    from pyspark.sql import Window as W

    return df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.col(order).desc()))).filter(F.col("_r") <= n).drop("_r")
