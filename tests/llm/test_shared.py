"""What operators leave alone: session settings, clashing names; bounds that hold."""

import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.llm import language, near_copies, quality, shared, sharding


def test_no_setting_changes(spark, sf):
    """Tables are stored under bounds of their own; the caller's session keeps its settings."""
    from glyphmill.llm import queries

    before = spark.conf.getAll
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("op3_columnwise_suffixes", "op9_kernel_language", "op10_whole_tokens", "op11_capture_merge"):
        queries.queries()[name](spark, sf).count()
    language.keep_identified(docs, language.fit(docs)).count()
    assert spark.conf.getAll == before
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
    own = shared.apart(spark.range(3)).sparkSession
    assert own.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "512" and own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("glyphmill_")]


def test_stored_tables_are_written_in_bounded_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    df = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    got = [r[0] for r in shared.store(df.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert len(got) >= 4 and max(got) <= 10 << 20


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 1)] * 3000 + [(7, 0)] * 3000 + [(None, 1), (9, None)], "doc_id long, quality int")
    seen = []
    grow = quality.grow
    quality.grow = lambda x, y, *a, **k: (seen.append(len(y)), grow(x, y, *a, **k))[1]
    try:
        for rows in (docs, docs.unionAll(docs.filter("doc_id = 7").withColumn("doc_id", F.explode(F.array_repeat(F.lit(7).cast("long"), 3000))))):
            table = quality.statistics_table(rows)
            quality.fit(table, labels, train_rows=100)
            quality.fit(table, labels)
    finally:
        quality.grow = grow
    assert seen[0] <= 100 and seen[2] <= 100 and 140 <= seen[1] <= 160 and seen[3] <= quality.TRAIN_ROWS


def test_slots_keep_the_callers_columns(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"), F.lit("a").alias("_n"), F.lit(1).alias("_b"), F.lit(2).alias("rank"), F.lit(3).alias("_start"), F.lit(4).alias("_mark"))
    for buckets in (None, 7):
        out = sharding.slots(df, "s", ["k"], buckets=buckets)
        assert out.columns == [*df.columns, "slot"]
        rows = out.toPandas()
        assert all(sorted(part.slot) == list(range(len(part))) for _, part in rows.groupby("s")) and set(rows._n) == {"a"} and set(rows["rank"]) == {2}
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_score_rejects(spark):
    docs = spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat and that was that", "en"), ("le chat est sur la table et la chaise", "fr")] * 40)]
        + [(100, "Привет, как дела?", None), (101, "漢字かな交じり文", None), (102, "the mat", None), (103, "sur la table", None), (104, None, None), (105, "½ 12", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    kept = lambda **how: {r["doc_id"] for r in language.keep_identified(docs, model, **how).collect() if r["doc_id"] >= 100}
    assert kept() == {102, 103} and kept(least=0.0) == {100, 101, 102, 103} and kept(languages=["fr"]) == {103} and kept(least=1.01) == set()


def test_maps_in_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, {"b": 1}), (1, text, {"a": 1}), (1, text, {"a": 1}), (2, text + " z", None), (3, "other", {})], "doc_id long, text string, m map<string,int>")
    assert sorted((r["doc_id"], tuple(r["m"].items())) for r in near_copies.drop_near_copies(df).collect()) == [(1, (("a", 1),)), (3, ())]
