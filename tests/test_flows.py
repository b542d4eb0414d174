"""Gates, counters, the cache, streams of logs, interval joins and the model hook."""

import os
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import corrector
from glyphmill.operators import gates
from glyphmill.operators.intervals import interval_join
from glyphmill.sources import cache, readers
from glyphmill.streaming import logs
from glyphmill.streaming import quality as St


def test_gate_stops_a_plan(spark):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id")))
    assert gates.stop_at(df, F.col("v") < 0, "negative").count() == 1000
    assert gates.gated(df, F.col("v") < 50, 0.05).count() == 1000 and gates.gated(df.limit(0), F.lit(True), 0.0).count() == 0
    with pytest.raises(Exception, match="over 990"):
        gates.stop_at(df, F.col("v") > 990, "over 990").write.format("noop").mode("overwrite").save()
    with pytest.raises(Exception, match="too many bad rows: 0.09"):
        gates.gated(df, F.col("v") < 100, 0.05).collect()


def test_gate_costs_no_second_job(spark, tmp_path):
    """Counts come from the tasks that write; nothing stands at the path where a check fails."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(500).mapInArrow(look, "id long")
    ok = gates.write_gated(df, f"{tmp_path}/good", {"small": (F.col("id") < 20, 0.05), "null": (F.col("id").isNull(), 0.0)})
    assert ok == {"small": 0.04, "null": 0.0} and seen.value == 500 and spark.read.parquet(f"{tmp_path}/good").count() == 500
    with pytest.raises(gates.GateError, match="small 0.0600 of at most 0.05"):
        gates.write_gated(df, f"{tmp_path}/bad", {"small": (F.col("id") < 30, 0.05)})
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        gates.write_gated(df.select(F.expr("1 / (id - 7)")), f"{tmp_path}/bad", {})
    with pytest.raises(ValueError):
        gates.write_gated(df, f"{tmp_path}/good", {})
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["good"]


def test_counters_of_a_write(spark, tmp_path):
    """The counters of a flow of three stages equal separate counts, and no job but the write is run."""
    rows = spark.range(2000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id"))).alias("label"), (F.col("id") % 5).alias("g"))
    c = gates.Counters()
    read = c.stage(rows, "read", without_label=F.count_if(F.col("label").isNull()))
    kept = c.stage(read.filter("label IS NOT NULL"), "labelled", longest=F.max(F.length("label")))
    good = c.stage(kept.filter("g <> 3").repartition(3), "kept")
    good.write.parquet(f"{tmp_path}/t")
    labelled = rows.filter("label IS NOT NULL")
    assert c.values() == {"read": {"rows": 2000, "without_label": rows.filter("label IS NULL").count()}, "labelled": {"rows": labelled.count(), "longest": 5}, "kept": {"rows": labelled.filter("g <> 3").count()}}
    with pytest.raises(ValueError):
        c.stage(rows, "kept")


def test_read_through_cache(spark, tmp_path):
    path, asked = f"{tmp_path}/cache", spark.sparkContext.accumulator(0)

    def fetch(keys):
        def ask(batches):
            for b in batches:
                asked.add(len(b))
                yield b[b.k < 900].assign(v=b.k.astype(str))

        return keys.mapInPandas(ask, "k long, v string")

    def broken(keys):
        return fetch(keys).withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("no answer"))).otherwise(F.col("v")))

    wanted = spark.createDataFrame([(i,) for i in [1, 2, 2, 3, None, 950]], "k long")
    get = lambda w, f=fetch: sorted(map(tuple, cache.read_through(w, path, f, "k", "k long, v string").collect()), key=repr)
    assert get(wanted.limit(0)) == [] and asked.value == 0
    assert get(wanted) == [(1, "1"), (2, "2"), (3, "3")] and asked.value == 4
    assert get(wanted.filter("k < 10")) == [(1, "1"), (2, "2"), (3, "3")] and asked.value == 4
    more = spark.range(1, 40).withColumnRenamed("id", "k").repartition(6)
    with pytest.raises(Exception, match="no answer"):
        get(more, broken)
    assert spark.read.parquet(path).count() == 3  # a failed run leaves nothing
    assert len(get(more)) == 39 and len(get(more, broken)) == 39
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("k").distinct().count() == 39


def test_log_stream_in_five_batches(spark, tmp_path):
    """The stream's last rows are those of the whole logs, however they are cut."""
    r = random.Random(3)
    lines = []
    for log in ("a", "b"):
        for n in range(400):
            what, e = r.random(), r.randrange(12)
            stamp = f"2024-03-0{r.randint(1, 9)} 10:{r.randint(10, 59)}:00,1 " if r.random() < 0.6 else ""
            text = "nothing to tell"
            if what < 0.1:
                text = f"starting phase_1{r.choice('abc')}"
            elif what < 0.3:
                text = f"[Stage1] Epoch {e} done | avg_loss={r.random():.4f} | time={r.randint(1, 900)}s" + (" Phase-1B" if r.random() < 0.2 else "")
            elif what < 0.5:
                text = f"{stamp}[Stage2a] Epoch {e} | avg_CE={r.random():.4f}" + (" printed CER=0.5 WER=0.25" if r.random() < 0.3 else "")
            elif what < 0.6:
                text = f"{stamp}[Stage2b] Epoch {e} | avg_CE=1.2.3"
            elif what < 0.8:
                text = f"{r.choice(['Printed', 'hw'])} eval CER=0.{n} WER={r.choice(['0.5', '1.1.1'])}"
            lines.append((f"{log}.log", n, text))
    df = spark.createDataFrame(lines, "path string, line_no long, value string")
    cuts = [0, 90, 91, 200, 333, 400]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        df.filter((F.col("line_no") >= a) & (F.col("line_no") < b)).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    from pathlib import Path

    (tmp_path / "all").mkdir()
    for i in range(5):
        (part,) = Path(f"{tmp_path}/in{i}").glob("*.parquet")
        target = tmp_path / "all" / f"{i}.parquet"
        part.rename(target)
        os.utime(target, (1_000_000 + i, 1_000_000 + i))
    for _ in range(2):  # the second run has nothing new to read
        stream = logs.log_epochs(St.read_arrivals(spark, f"{tmp_path}/all", df.schema, 1))
        St.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    out = spark.read.parquet(f"{tmp_path}/out")
    whole = readers.parse_log(df)
    mine = logs.latest(out).select(*whole.columns)
    assert sorted(map(str, mine.collect())) == sorted(map(str, whole.collect())) and whole.count() > 30
    assert out.count() > whole.count() and len(os.listdir(f"{tmp_path}/checkpoint/commits")) >= 5


def test_interval_join(spark):
    r = random.Random(6)
    points = [(i, r.choice([r.uniform(-50, 50), float(r.randint(-50, 50)), None]), r.choice("xyz")) for i in range(500)]
    bands = []
    for i in range(300):
        low = r.choice([r.uniform(-60, 60), float(r.randint(-60, 60))])
        bands.append((i, low, low + r.choice([0.0, 1e-9, 0.25, 1.0, 3.7, 64.0, 1000.0]), r.choice("xyz")))
    bands += [(900, None, 1.0, "x"), (901, 1.0, None, "x"), (902, 5.0, 4.0, "x")]
    p, b = spark.createDataFrame(points, "i int, v double, g string"), spark.createDataFrame(bands, "j int, low double, high double, g string")
    out = interval_join(p, b, "v", "low", "high", ["g"])
    want = sorted((i, j) for i, v, g in points for j, low, high, h in bands if g == h and None not in (v, low, high) and low <= v < high)
    assert sorted((x["i"], x["j"]) for x in out.collect()) == want and len(want) > 1000
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    free = interval_join(p.drop("g"), b.drop("g"), "v", "low", "high")
    assert free.count() == sum(low <= v < high for _, v, _ in points for _, low, high, _ in bands if None not in (v, low, high))
    assert interval_join(p, b.limit(0), "v", "low", "high", ["g"]).count() == 0


def test_model_hook(spark):
    """One load a worker, exact batches across Arrow's, a rule on top of the model's answers."""
    loads, sizes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def model(part):
            assert len(part) and list(part.index) == list(range(len(part)))
            sizes.add(1)
            return part.assign(candidate=part.token.str.replace("0", "o"), probability=0.9 - 0.2 * (part.id % 2), size=len(part))

        return model

    df = spark.range(1030, numPartitions=3).select("id", F.concat(F.lit("w0rd"), F.col("id") % 3).alias("token"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = corrector.predict(df, "id long, token string, candidate string, probability double, size long", load, batch=50)
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [x["id"] for x in rows] == list(range(1030)) and sizes.value == sum(-(-n // 50) for n in (343, 343, 344))
    assert {x["size"] for x in rows} == {50, 43, 44} and 1 <= loads.value <= 3
    before = loads.value
    again = corrector.predict(df.coalesce(1), out.schema, load, batch=50, token="kept")
    assert again.count() == again.count() == 1030 and loads.value - before <= 8
    picked = out.select("id", corrector.choose_candidate(F.col("token"), F.col("candidate"), F.col("probability"), F.lit(3)).alias("t")).collect()
    assert all(x["t"].startswith("word" if x["id"] % 2 == 0 else "w0rd") for x in picked)


def test_listings_are_runs_of_files(spark, tmp_path):
    """A group's listing is cut into files in order; no file, and so no task, has more than its share."""
    from pathlib import Path

    from glyphmill.operators.reports import listing
    from glyphmill.sources.writers import write_listings

    df = spark.range(5000).select(F.when(F.col("id") < 4500, "big").otherwise("small").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id")
    out = listing(df, ["g"], [F.col("v"), F.col("id")], F.concat_ws(" ", "v", "id"))
    write_listings(out, f"{tmp_path}/l", ["g"], per_file=600)
    want = {g: [f"{r['v']} {r['id']}" for r in df.filter(F.col("g") == g).orderBy("v", "id").collect()] for g in ("big", "small")}
    for g, n in (("big", 8), ("small", 1)):
        parts = sorted(Path(f"{tmp_path}/l/g={g}").iterdir(), key=lambda p: int(p.name.split("=")[1]))
        lines = [[x for f in p.glob("*.txt") for x in f.read_text().splitlines()] for p in parts]
        assert len(parts) == n and all(len(list(p.glob("*.txt"))) == 1 for p in parts) and max(map(len, lines)) <= 600
        assert sum(lines, []) == want[g]
