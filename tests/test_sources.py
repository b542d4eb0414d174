import json
import random
import struct
import zlib

from pyspark.sql import functions as F

from glyphmill.sources import readers as R
from glyphmill.sources import writers as Wr
from glyphmill.streaming import quality as St


def png(path, width, height):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IEND", b""))


def test_label_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a.png\tone\nskipped\n b.png \t two\tmore \na.png\tlast\n", encoding="utf-8")
    got = {r["filename"]: r["label"] for r in R.read_label_lines(spark, str(tmp_path / "l.txt")).collect()}
    assert got == {"a.png": "last", "b.png": "two\tmore"}
    assert R.read_label_lines(spark, str(tmp_path / "l.txt"), last_wins=False).count() == 3


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Files are read by many tasks; numbers are those of the whole file, whatever ends its lines."""
    r = random.Random(1)
    lines = {name: [f"f{r.randrange(60)}.png\t{name}{i}" if r.random() < 0.9 else r.choice(["", "é" * 40, "no tab"]) for i in range(n)] for name, n in (("a", 700), ("b", 333), ("c", 0), ("d", 1))}
    for name, end in zip(lines, ("\n", "\r\n", "\n", "\n")):
        (tmp_path / f"{name}.txt").write_bytes("".join(x + end for x in lines[name]).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        df = R.numbered_lines(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = df.withColumn("task", F.spark_partition_id()).collect()
        named = R.read_label_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({x["task"] for x in got}) > 20 and "value" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    found = {name: sorted((x["line_no"], x["value"]) for x in got if x["path"].endswith(f"/{name}.txt")) for name in lines}
    assert found == {name: list(enumerate(rows)) for name, rows in lines.items()}
    last = {}
    for name in sorted(lines):
        last |= dict(x.split("\t") for x in lines[name] if "\t" in x)
    assert {x["filename"]: x["label"] for x in named} == last


def test_log_over_many_splits(spark, tmp_path):
    """The epoch table of a log does not depend on how its file is cut."""
    out = []
    for i in range(120):
        out += [f"2024-01-01 00:{i // 60:02d}:{i % 60:02d},1 [Stage2a] Epoch {i % 40} | avg_CE=0.{i:03d}", "noise " * (i % 7), f"printed CER=0.{i:03d} WER=0.5"]
    (tmp_path / "log.txt").write_text("\n".join(out))
    whole = sorted(map(str, R.read_log(spark, str(tmp_path / "log.txt")).collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert sorted(map(str, R.read_log(spark, str(tmp_path / "log.txt")).collect())) == whole and len(whole) == 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_label_map_and_fallback(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps({"x.png": "Đường", "y.png": ""}, ensure_ascii=False), encoding="utf-8")
    df = R.read_label_map(spark, [str(tmp_path / "label.json"), str(tmp_path / "labels.json")])
    assert {tuple(r) for r in df.collect()} == {("x.png", "Đường"), ("y.png", "")}
    assert R.read_label_map(spark, [str(tmp_path / "none.json")]).count() == 0


def test_manifest_round_trip(spark, tmp_path):
    rows = [("a.png", 'say "hi",\nnow', "s", "word", "printed", "", "train"), ("b.png", "ộ", "s", "word", "printed", "7", "val")]
    df = spark.createDataFrame(rows, R.MANIFEST)
    Wr.write_manifest(df.withColumn("more", F.lit(1)), str(tmp_path / "m"))
    back = R.read_first(spark, [str(tmp_path / "none"), str(tmp_path / "m")])
    assert sorted(tuple(v or "" for v in r) for r in back.collect()) == sorted(rows)
    assert R.read_manifest(spark, str(tmp_path / "none")).columns == R.MANIFEST


def test_images_and_dataset(spark, tmp_path):
    (tmp_path / "230").mkdir()
    png(tmp_path / "230" / "a.png", 300, 40)
    (tmp_path / "230" / "bad.png").write_bytes(b"no image")
    images = R.read_images(spark, str(tmp_path), "*.png")
    got = {r["filename"]: (r["width"], r["height"]) for r in images.collect()}
    assert got == {"a.png": (300, 40), "bad.png": (None, None)}
    assert images.select(R.writer_of(F.col("path"))).first()[0] == "230"
    labels = spark.createDataFrame([("a.png", " x  y "), ("bad.png", " "), ("gone.png", "z")], "filename string, label string")
    rows = R.union_datasets([R.Dataset("uit", labels, images, "word", "handwritten", "train_pool", "uit_")]).collect()
    assert [(r["filename"], r["label"], r["pre_split"]) for r in rows] == [("uit_a.png", "x y", "train_pool")]


def test_pages_and_sentences(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"query": {"pages": {"1": {"title": "T", "extract": "text"}, "-1": {"title": "no"}}}}))
    assert [tuple(r) for r in R.read_pages(spark, str(tmp_path / "p.json")).collect()] == [("T", "text")]
    (tmp_path / "s.txt").write_text("\n a \n \nb\n", encoding="utf-8")
    assert sorted(r[0] for r in R.read_sentences(spark, str(tmp_path / "s.txt")).collect()) == ["a", "b"]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(f"{i:03}.png", b"x" if i % 5 else None, str(i), "word", "printed", "train" if i % 2 else "val") for i in range(50)], "filename string, image binary, label string, level string, data_type string, split string")
    Wr.export_samples(df, str(tmp_path / "e"))
    back = R.read_samples(spark, str(tmp_path / "e"))
    for split, part in back.toPandas().groupby("split"):
        assert list(part.sort_values("idx").label) == sorted(part.label, key=int) and list(part.sort_values("idx").idx) == list(range(1, len(part) + 1))
    assert {r["num_samples"] for r in Wr.sample_counts(back).collect()} == {20}
    assert R.read_samples(spark, str(tmp_path / "e"), 1).count() == 2


def test_vocabulary_and_lines(spark, tmp_path):
    Wr.write_vocabulary(spark.createDataFrame([("ba",), ("ộ",), (None,)], "label string"), str(tmp_path / "v"))
    assert "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "v").glob("part*"))).split() == ["a", "b", "ộ"]
    df = spark.createDataFrame([("b", 0.125), ("a", 1.0)], "f string, cer double")
    Wr.write_lines(df, str(tmp_path / "t"), F.concat_ws("\t", "f", F.col("cer").cast("string")), F.col("f"))
    assert next((tmp_path / "t").glob("part*")).read_text().startswith("a\t1.0\nb")
    Wr.write_predictions(df, str(tmp_path / "c"), ["cer"])
    assert "1.0000" in "".join(p.read_text() for p in (tmp_path / "c").glob("part*"))


def test_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("\n".join([
        "x printed CER=0.9 WER=0.9 before any epoch", "2025-01-01 10:00:00,1 INFO phase_1B starts", "2025-01-01 11:00:00,1 [Stage1] Epoch 0 done | avg_loss=2.5 | time=60s",
        "x printed: CER=0.5 WER=0.6 hw: CER=0.7 WER=0.8", "[Stage1] Epoch 1 | avg_loss=9", "2025-01-01 12:00:00,1 [Stage2a] Epoch 0 | avg_loss=1.5", "printed CER=0.3 WER=0.4 ",
        "2025-01-01 13:00:00,1 [STAGE2A]Epoch 0|avg_CE=1.25", "handwritten CER=0.1 WER=0.2", "printed CER=0.1", "[Stage2b] Epoch 3 | avg_CE=0.5945 | avg_EWC=0.0", "[Stage2b] Epoch 3 | avg_CE=0.5 | avg_EWC=0.0",
    ]))
    rows = {(r["stage"], r["phase"], r["epoch"]): r for r in R.read_log(spark, str(tmp_path / "log.txt")).collect()}
    names = ("loss", "runtime", "printed_cer", "printed_wer", "hw_cer", "hw_wer", "restarted")
    assert {k: tuple(r[n] for n in names) for k, r in rows.items()} == {
        ("stage1", "1b", 0): (2.5, 60, 0.5, 0.6, 0.7, 0.8, False),
        ("stage2a", "2a", 0): (1.25, None, None, None, 0.1, 0.2, True),  # run again: evaluations of the first run are dropped
        ("stage2b", "2b", 3): (0.5, None, None, None, None, None, False),  # only stage 2a is marked
    }
    assert rows[("stage2a", "2a", 0)]["ts"].hour == 13 and rows[("stage1", "1b", 0)]["ts"] is None


def test_metrics_and_small_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"cer": 0.25, "note": "x", "by": {"hw": {"a": 1}, "printed": 2}}')
    assert {(r["name"], r["value"]) for r in R.read_metrics(spark, str(tmp_path / "m.json")).collect()} == {("cer", 0.25), ("by.printed", 2.0)}
    assert R.try_table(spark, str(tmp_path / "none")) is None
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert R.try_table(spark, str(tmp_path / "t")).count() == 3
    files = spark.createDataFrame([("a", 5), ("a", 6), ("b", 1)], "kind string, bytes long")
    assert {tuple(r) for r in Wr.disk_usage(files, "kind").collect()} == {("a", 11, 2), ("b", 1, 1)}
    Wr.write_summary(spark.createDataFrame([("ộ", (1, 2.5))], "k string, v struct<n:int,cer:double>"), str(tmp_path / "s"))
    assert json.loads("".join(p.read_text(encoding="utf-8") for p in (tmp_path / "s").glob("part*"))) == {"k": "ộ", "v": {"n": 1, "cer": 2.5}}


def test_streaming_counts_equal_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "in"
    batch.repartition(3).write.parquet(str(src))
    stream = St.read_arrivals(spark, str(src), batch.schema, 1)
    got = St.run_to_table(St.windowed_counts(stream, "ts", "event_type"), "counts", str(tmp_path / "cp"))
    want = batch.groupBy("event_type").count().collect()
    assert {r["event_type"]: r["count"] for r in want} == {r["event_type"]: r["n"] for r in got.groupBy("event_type").agg(F.sum("n").alias("n")).collect()}
    St.append_to(St.read_arrivals(spark, str(src), batch.schema), str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_fonts_in_order(spark, tmp_path):
    for name in ("b.ttf", "a.ttf", "c.otf"):
        (tmp_path / name).write_bytes(b"x")
    assert [(r["font_no"], r["name"]) for r in R.read_fonts(spark, str(tmp_path)).orderBy("font_no").collect()] == [(0, "a.ttf"), (1, "b.ttf")]
    assert R.read_fonts(spark, str(tmp_path / "none")).count() == 0


def test_heavy_texts_are_dealt_by_rows(spark, tmp_path):
    """Tasks do not grow with the table, in as many splits as there are cores or in one."""
    import re

    from glyphmill import registry

    for files in (1, 8):
        path = f"{tmp_path}/{files}"
        spark.range(90_000).selectExpr("id AS doc_id", "concat('Wort ', id, ' und noch eins.') AS text").repartition(files).write.parquet(f"{path}/documents.parquet")
        for name in ("pack_segments", "sanitize_text"):
            df = registry.queries()[name](spark, path)
            dealt = [int(n) for n in re.findall(r"RoundRobinPartitioning\((\d+)\)", df._jdf.queryExecution().toString())]
            assert dealt and max(dealt) == 22 and df.count() == 90_000
