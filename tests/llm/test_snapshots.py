"""Snapshot difference against brute force on odd rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import snapshots

SCHEMA = "key long, a string, b string, side int, c0 string, turn long, old string"


def brute(earlier, later):
    """Multiset of (key, old_key, op, changed) by the docstring's rules; contents are (a, b)."""
    out, alone = [], ([], [])
    groups = defaultdict(lambda: ([], []))
    for side, rows in enumerate((earlier, later)):
        for k, *c in rows:
            (alone[side].append((k, tuple(c))) if k is None else groups[k][side].append(tuple(c)))
    place = lambda c: [(x is not None, (x or "").encode()) for x in c]
    for k, sides in groups.items():
        old, new = (sorted(s, key=place) for s in sides)
        for o, n in zip(old, new):
            names = [x for x, y, z in zip("ab", o, n) if y != z]
            out.append((k, k, "update" if names else "same", tuple(names)))
        alone[0].extend((k, c) for c in old[len(new) :])
        alone[1].extend((k, c) for c in new[len(old) :])
    content = defaultdict(lambda: ([], []))
    for side, rows in enumerate(alone):
        for k, c in rows:
            content[c][side].append(k)
    for sides in content.values():
        old, new = (sorted(s, key=lambda k: (k is not None, k or 0)) for s in sides)
        out += [(n, o, "rekey", ()) for o, n in zip(old, new)]
        out += [(o, o, "delete", None) for o in old[len(new) :]] + [(n, None, "insert", None) for n in new[len(old) :]]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(k, a, b, 1, "x", 2, "y") for k, a, b in rows], SCHEMA)


def run(spark, earlier, later, **how):
    out = snapshots.snapshot_difference(frame(spark, earlier), frame(spark, later), "key", ["a", "b"], carry=["old", "c0"], **how)
    assert out.columns == ["key", "old_key", "op", "changed", "old", "c0"]
    return out.collect()


def compared(rows):
    return sorted(((r[0], r[1], r[2], None if r[3] is None else tuple(r[3])) for r in rows), key=repr)


def test_odd_rows(spark):
    r = random.Random(5)
    text = lambda: r.choice([None, "", "a", "~", "ab" * 300, "é" * 16])
    earlier = [(k, text(), text()) for k in range(150)] + [(None, "a", None)] * 3 + [(7, "a", "a"), (7, "a", "a"), (7, "", None)]
    later = [(k if r.random() < 0.6 else -1 - k, a if r.random() < 0.8 else text(), b) for k, a, b in earlier[:150] if r.random() < 0.9]
    later += [(None, "a", None)] * 5 + [(1000, "a", "b"), (7, "a", "a"), (7, "zz", "a")]
    for buckets in (512, 3):
        rows = run(spark, earlier, later, buckets=buckets)
        assert compared(rows) == brute(earlier, later)
    assert all((x["old"], x["c0"]) == ((None, None) if x["op"] == "delete" else ("y", "x")) for x in rows)


def test_hot_content_key_and_copies(spark):
    """A third of the rows with one content, one key or no key at all is ranked in many ranges."""
    earlier = [(k, "hot", "x") for k in range(300)] + [(900, f"t{i}", None) for i in range(300)] + [(None, "n", "n")] * 300
    later = [(-1 - k, "hot", "x") for k in range(200)] + [(900, f"t{i}", None) for i in range(100, 500)] + [(None, "n", "n")] * 100
    assert compared(run(spark, earlier, later, buckets=16)) == brute(earlier, later)


@pytest.mark.parametrize("earlier, later", [([], []), ([(1, "a", None)], []), ([], [(1, None, None), (1, None, None)])])
def test_empty_snapshots(spark, earlier, later):
    assert compared(run(spark, earlier, later)) == brute(earlier, later)


def test_no_joins_and_other_types(spark):
    df = spark.range(20).select("id", F.array("id").alias("list"), (F.col("id") / 3).alias("share"), F.to_timestamp(F.lit("2024-01-01")).alias("at"))
    new = df.withColumn("list", F.when(F.col("id") == 3, F.array()).otherwise(F.col("list"))).withColumn("share", F.when(F.col("id") == 4, None).otherwise(F.col("share")))
    out = snapshots.snapshot_difference(df, new, "id", ["list", "share", "at"])
    assert {r["key"]: r["changed"] for r in out.collect() if r["op"] != "same"} == {3: ["list"], 4: ["share"]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and "Cartesian" not in plan
