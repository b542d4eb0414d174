"""Gates and counters that a running job keeps itself: observed metrics, checks that stop a plan.

Nothing here is a second job: counts are taken by the tasks that do the work, as rows pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A table did not pass its gate."""


class Counters:
    """Counters of the stages of one flow, filled by whatever job runs the flow first.

    Each `stage` counts the rows that pass it: `rows`, and further aggregates by name. `values` waits for that job. A
    table that several jobs read is counted by the first of them; a limit above a stage can end it early.
    """

    def __init__(self) -> None:
        self._observed: dict[str, Observation] = {}

    def stage(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """`df`, counted as stage `name`; what is counted must be an aggregate, without distinct."""
        if name in self._observed:
            raise ValueError(f"stage {name} is counted already")
        self._observed[name] = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        return df.observe(self._observed[name], F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()])

    def values(self) -> dict[str, dict[str, int]]:
        """Counts of every stage, by its name."""
        return {name: dict(o.get) for name, o in self._observed.items()}


def stop_at(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """`df`, of which any job fails at the first row that is `bad` (null counts as good), with the message."""
    return df.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def gated(df: DataFrame, bad: Column, most: float, message: str = "too many bad rows") -> DataFrame:
    """`df`, of which any job fails before a row is handed out if over `most` of all rows are `bad`.

    The share is a scalar subquery over the columns that `bad` needs; no rows pass. For a gate on a write without
    another scan see `write_gated`.
    """
    share = df.agg(F.coalesce(F.avg(F.coalesce(bad, F.lit(False)).cast("double")), F.lit(0.0)).alias("share")).scalar()
    over = F.when(share > most, F.raise_error(F.concat(F.lit(f"{message}: "), share.cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return df.filter(over)


def write_gated(df: DataFrame, path: str, checks: Mapping[str, tuple[Column, float]]) -> dict[str, float]:
    """Write `df` as Parquet to `path`, which appears only if every check holds; the shares of bad rows.

    checks: name to (bad, most): the share of rows that are `bad` (null counts as good) may be `most`. Shares are observed
    while the rows are written beside the path; then the folder takes its name, or is deleted and
    GateError raised. An existing path is refused. No rows pass every check.
    """
    spark = df.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = files(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(target):
        raise ValueError(f"{path} exists")
    waiting = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}.waiting"
    counters = Counters()
    try:
        counters.stage(df, "write", **{name: F.count_if(F.coalesce(bad, F.lit(False))) for name, (bad, _) in checks.items()}).write.parquet(waiting)
        seen = counters.values()["write"]
        shares = {name: seen[name] / seen["rows"] if seen["rows"] else 0.0 for name in checks}
        over = {name: share for name, share in shares.items() if share > checks[name][1]}
        if over:
            raise GateError(f"{path} is not written: " + ", ".join(f"{name} {share:.4f} of at most {checks[name][1]}" for name, share in over.items()))
        if not store.rename(files(waiting), target):
            raise OSError(f"{waiting} can't take the name {path}")
    except BaseException:
        store.delete(files(waiting), True)
        raise
    return shares
