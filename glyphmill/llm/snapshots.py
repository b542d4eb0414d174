"""Difference of two snapshots whose keys may have been renamed. No join: tagged rows are united and grouped.

Rows of both snapshots are united under a tag, and one grouping by key puts the earlier and the later row of a
key side by side in conditional aggregates. What stays alone is ranked by key within (content, side) and
grouped by (content, rank): the i-th earlier row of a content meets the i-th later one. Contents are compared
by fingerprints, which is all of a row that is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from glyphmill.llm.shared import store
from glyphmill.operators.ranking import ranged_rank

EARLIER, LATER = 0, 1


def fingerprint(df: DataFrame, column: str) -> Column:
    """A short value that is equal where values of the column are, null for null.

    Texts and byte strings of fewer than 32 bytes stand for themselves, longer ones are SHA-256; nested values are
    compared as JSON; all others are the values themselves.
    """
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (ArrayType, MapType, StructType, VariantType)):
        value = F.encode(F.to_json(F.struct(value.alias("v"))), "UTF-8")
    elif kind.simpleString() not in ("string", "binary"):
        return value
    else:
        value = value.cast("binary")
    own = F.col(f"`{column}`")
    return F.when(own.isNull(), None).when(F.octet_length(value) < 32, value).otherwise(F.unhex(F.sha2(value, 256)))


def snapshot_difference(earlier: DataFrame, later: DataFrame, key: str, columns: Sequence[str], carry: Sequence[str] = (), buckets: int = 512) -> DataFrame:
    """key, old_key, op, changed, and the `carry` columns of the later row: one row per pair and per unpaired row.

    Rows with equal keys pair: `same`, or `update` with the names of the `columns` that differ in `changed`. Then
    unpaired rows that are equal in all `columns` pair, the i-th smallest earlier key with the i-th smallest
    later key: `rekey`. The rest: `insert` and `delete`. key: the later row's, else the earlier's; old_key: the
    earlier row's, else null. changed: null where nothing is paired. Nulls equal only nulls.

    A null key is no key: such rows pair by content alone, before all that have one. Of a key that a snapshot holds
    repeatedly the i-th rows pair, in order of contents; repeated rows are rows of their own. Two
    empty snapshots have no difference. `buckets`: ranges into which ranking cuts the rows, so that no content, key or
    side is one task's work. Only fingerprints, keys and carried columns are written and shuffled.
    """
    marks = [f"c{i}" for i in range(len(columns))]
    carried = [f"v{i}" for i in range(len(carry))]

    def side(df: DataFrame, tag: int) -> DataFrame:
        own = [fingerprint(df, c).alias(m) for c, m in zip(columns, marks)]
        extra = [F.col(f"`{c}`") if tag == LATER else F.lit(None).cast(later.schema[c].dataType) for c in carry]
        return df.select(F.lit(tag).alias("side"), F.col(f"`{key}`").alias("key"), *own, *[e.alias(c) for e, c in zip(extra, carried)])

    rows = side(earlier, EARLIER).unionByName(side(later, LATER)).withColumn("row", F.monotonically_increasing_id())
    rows = store(rows, "snapshots")  # row numbers hold from here on

    keyed = rows.filter("key IS NOT NULL")
    if keyed.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        keyed = keyed.withColumn("turn", F.lit(1).cast("long"))
    else:
        keyed = ranged_rank(keyed, ["side", "key"], [*map(F.col, marks), F.col("row")], "turn", buckets=buckets)
    of = lambda tag, fields: F.first(F.when(F.col("side") == tag, F.struct(*fields)), ignorenulls=True)
    met = keyed.groupBy("key", "turn").agg(of(EARLIER, [*marks, "row"]).alias("old"), of(LATER, [*marks, "row", *carried]).alias("new"))
    met = store(met, "keys")

    differs = [F.when(~F.col(f"old.{m}").eqNullSafe(F.col(f"new.{m}")), c) for c, m in zip(columns, marks)]
    changed = F.filter(F.array(*differs), lambda c: c.isNotNull()) if differs else F.array().cast("array<string>")
    values = [F.col(f"new.{v}").alias(v) for v in carried]
    pairs = met.filter("old IS NOT NULL AND new IS NOT NULL").withColumn("changed", changed)
    pairs = pairs.select("key", F.col("key").alias("old_key"), F.when(F.size("changed") == 0, "same").otherwise("update").alias("op"), "changed", *values)

    one = F.coalesce(*[F.when(F.col(s).isNotNull(), F.struct(F.lit(t).alias("side"), *[F.col(f"{s}.{m}").alias(m) for m in [*marks, "row"]], *[(F.col(f"new.{v}") if s == "new" else F.lit(None).cast(rows.schema[v].dataType)).alias(v) for v in carried])) for s, t in (("old", EARLIER), ("new", LATER))])
    alone = met.filter("old IS NULL OR new IS NULL").select("key", one.alias("r")).select("key", "r.*")
    alone = store(alone.unionByName(rows.filter("key IS NULL")), "alone")
    ranked = ranged_rank(alone, ["side", *marks], [F.col("key"), F.col("row")], "turn", buckets=buckets)
    rest = ranked.groupBy(*marks, "turn").agg(of(EARLIER, ["key"]).alias("old"), of(LATER, ["key", *carried]).alias("new"))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("rekey")
    named = F.when(op == "rekey", F.array().cast("array<string>"))
    rest = rest.select(F.when(F.col("new").isNotNull(), F.col("new.key")).otherwise(F.col("old.key")).alias("key"), F.col("old.key").alias("old_key"), op.alias("op"), named.alias("changed"), *values)
    return pairs.unionByName(rest).withColumnsRenamed(dict(zip(carried, carry)))
