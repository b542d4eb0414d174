"""Queries on splits, size filters and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import quality as Q
from glyphmill.operators.ranking import bucketed_rank
from glyphmill.operators.split import determined_split, split_groups, split_rows
from glyphmill.plans.common import table

_RANKED = "row_number() OVER ({p} ORDER BY md5({k} || '42'), {k}) AS rn, count(*) OVER ({p}) AS n"
_SPLIT = "CASE WHEN rn <= n - ceil(n * {h}::DOUBLE) THEN 'train' WHEN rn <= n - ceil(ceil(n * {h}::DOUBLE) * 0.5) THEN 'val' ELSE 'test' END"


def split_determined(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    pre = F.when(F.col("c_mktsegment") == "BUILDING", "train").when(F.col("c_mktsegment") == "MACHINERY", "test").when(F.col("c_mktsegment") == "FURNITURE", "other").otherwise("train_pool")
    writer = F.when(F.col("c_custkey") % 5 == 0, "abc").otherwise((F.col("c_custkey") % 300).cast("string"))
    return c.select("c_custkey", determined_split(pre, writer).alias("final_split"))


SPLIT_DETERMINED = """
WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'train' WHEN 'MACHINERY' THEN 'test' WHEN 'FURNITURE' THEN 'other' ELSE 'train_pool' END AS pre,
  CASE WHEN c_custkey % 5 = 0 THEN 'abc' ELSE (c_custkey % 300)::VARCHAR END AS writer FROM customer)
SELECT c_custkey, CASE WHEN pre IN ('train', 'val', 'test') THEN pre WHEN pre = 'train_pool' THEN CASE WHEN try_cast(writer AS INT) BETWEEN 230 AND 249 THEN 'val' ELSE 'train' END ELSE 'unresolved' END AS final_split FROM c"""


def split_random_80_10_10(spark, sf_dir):
    return split_rows(table(spark, sf_dir, "documents", "doc_id"), "doc_id")


SPLIT_RANDOM = f"SELECT doc_id, {_SPLIT.format(h=0.2)} AS final_split FROM (SELECT doc_id, {_RANKED.format(p='', k='doc_id')} FROM documents)"


def split_group_80_10_10(spark, sf_dir):
    return split_groups(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_custkey")


SPLIT_GROUP = f"""
WITH g AS (SELECT o_custkey, {_SPLIT.format(h=0.2)} AS final_split FROM (SELECT o_custkey, {_RANKED.format(p='', k='o_custkey')} FROM (SELECT DISTINCT o_custkey FROM orders)))
SELECT o_orderkey, o_custkey, final_split FROM orders JOIN g USING (o_custkey)"""


def split_90_5_5(spark, sf_dir):
    return split_rows(table(spark, sf_dir, "part", "p_partkey"), "p_partkey", holdout=0.1).groupBy("final_split").agg(F.count(F.lit(1)).alias("rows"), F.sum("p_partkey").alias("key_sum"))


SPLIT_90 = f"SELECT final_split, count(*) AS \"rows\", sum(p_partkey)::BIGINT AS key_sum FROM (SELECT p_partkey, {_SPLIT.format(h=0.1)} AS final_split FROM (SELECT p_partkey, {_RANKED.format(p='', k='p_partkey')} FROM part)) GROUP BY final_split"


def split_leakage_check(spark, sf_dir):
    """Customers on more than one side, of a split of customers (none may be) and of one of their orders alone."""
    grouped = split_group_80_10_10(spark, sf_dir).select(F.lit("by_group").alias("kind"), "o_custkey", "final_split")
    rows = split_rows(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey").select(F.lit("by_row").alias("kind"), "o_custkey", "final_split")
    sides = grouped.unionAll(rows).distinct().groupBy("kind", "o_custkey").agg(F.count(F.lit(1)).alias("sides"))
    return sides.groupBy("kind").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("sides") > 1).alias("leaking"))


SPLIT_LEAKAGE = f"""
WITH s AS (
  SELECT 'by_group' AS kind, o_custkey, final_split FROM ({SPLIT_GROUP})
  UNION ALL SELECT 'by_row', o_custkey, {_SPLIT.format(h=0.2)} FROM (SELECT o_custkey, {_RANKED.format(p='', k='o_orderkey')} FROM orders))
SELECT kind, count(*) AS groups, count(*) FILTER (sides > 1) AS leaking FROM (SELECT kind, o_custkey, count(DISTINCT final_split) AS sides FROM s GROUP BY ALL) GROUP BY kind"""


def split_by_source(spark, sf_dir):
    docs = split_rows(table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id", ["source"])
    return docs.groupBy("source").pivot("final_split", ["train", "val", "test"]).count().fillna(0)


SPLIT_BY_SOURCE = f"""
SELECT source, count(*) FILTER (s = 'train') AS train, count(*) FILTER (s = 'val') AS val, count(*) FILTER (s = 'test') AS test
FROM (SELECT source, {_SPLIT.format(h=0.2)} AS s FROM (SELECT doc_id, source, {_RANKED.format(p='PARTITION BY source', k='doc_id')} FROM documents)) GROUP BY source"""


def split_dispatch(spark, sf_dir):
    """All four split rules by pool, one pass each over the rows they are for."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    pool = F.when(F.col("o_orderpriority").startswith("1"), "train_pool").when(F.col("o_orderpriority").startswith("2"), "unassigned").when(F.col("o_orderpriority").startswith("3"), "group_pool").otherwise("synthetic_pool")
    o = o.withColumn("pool", pool)
    of = lambda p: o.filter(F.col("pool") == p)
    fixed = of("train_pool").withColumn("final_split", determined_split(F.col("pool"), F.col("o_custkey").cast("string")))
    rows = lambda p: of(p).select("pool", "o_orderkey")
    parts = [split_rows(rows("unassigned"), "o_orderkey"), split_groups(of("group_pool"), "o_custkey"), split_rows(rows("synthetic_pool"), "o_orderkey", holdout=0.1)]
    out = fixed.select("pool", "o_orderkey", "final_split")
    for p in parts:
        out = out.unionByName(p.select("pool", "o_orderkey", "final_split"))
    return out.groupBy("pool", "final_split").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("key_sum"))


SPLIT_DISPATCH = f"""
WITH o AS (SELECT o_orderkey, o_custkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'train_pool' WHEN '2' THEN 'unassigned' WHEN '3' THEN 'group_pool' ELSE 'synthetic_pool' END AS pool FROM orders),
g AS (SELECT o_custkey, {_SPLIT.format(h=0.2)} AS final_split FROM (SELECT o_custkey, {_RANKED.format(p='', k='o_custkey')} FROM (SELECT DISTINCT o_custkey FROM o WHERE pool = 'group_pool'))),
a AS (
  SELECT pool, o_orderkey, CASE WHEN o_custkey BETWEEN 230 AND 249 THEN 'val' ELSE 'train' END AS final_split FROM o WHERE pool = 'train_pool'
  UNION ALL SELECT pool, o_orderkey, {_SPLIT.format(h=0.2)} FROM (SELECT *, {_RANKED.format(p='', k='o_orderkey')} FROM o WHERE pool = 'unassigned')
  UNION ALL SELECT pool, o_orderkey, final_split FROM o JOIN g USING (o_custkey) WHERE pool = 'group_pool'
  UNION ALL SELECT pool, o_orderkey, {_SPLIT.format(h=0.1)} FROM (SELECT *, {_RANKED.format(p='', k='o_orderkey')} FROM o WHERE pool = 'synthetic_pool'))
SELECT pool, final_split, count(*) AS "rows", sum(o_orderkey)::BIGINT AS key_sum FROM a GROUP BY ALL"""


def _sizes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount")
    return li.withColumns({"w": (F.col("l_quantity") * F.col("l_linenumber")).cast("int"), "h": (F.lit(5) + F.col("l_orderkey") % 300).cast("int")})


_SIZES = "SELECT *, (l_quantity * l_linenumber)::INT AS w, (5 + l_orderkey % 300)::INT AS h FROM lineitem"
_ASPECT = "(CASE WHEN h > 0 THEN w::DOUBLE / h ELSE 0 END)"


def dimension_filter_reasons(spark, sf_dir):
    s = _sizes(spark, sf_dir)
    word = s.select("l_returnflag", F.lit("word").alias("level"), Q.size_reason(F.col("w"), F.col("h"), Q.WORD_LIMITS).alias("reason"))
    line = s.select("l_returnflag", F.lit("line").alias("level"), Q.size_reason(F.col("w"), F.col("h"), Q.LINE_LIMITS).alias("reason"))
    return word.unionByName(line).groupBy("l_returnflag", "level", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


DIMENSION_FILTER_REASONS = f"""
WITH s AS ({_SIZES}), r AS (
  SELECT l_returnflag, 'word' AS level, CASE WHEN w < 10 THEN 'width_small' WHEN h < 10 THEN 'height_small' WHEN h > 300 THEN 'height_large' WHEN {_ASPECT} < 0.3 THEN 'aspect_low' WHEN {_ASPECT} > 25 THEN 'aspect_high' ELSE 'kept' END AS reason FROM s
  UNION ALL SELECT l_returnflag, 'line', CASE WHEN w < 32 THEN 'width_small' WHEN h < 16 THEN 'height_small' WHEN h > 384 THEN 'height_large' WHEN w > 3000 THEN 'width_large' WHEN {_ASPECT} < 1 THEN 'aspect_low' ELSE 'kept' END FROM s)
SELECT l_returnflag, level, reason, count(*) AS "rows" FROM r GROUP BY ALL"""


def drop_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars").join(table(spark, sf_dir, "labels", "doc_id", "quality").dropDuplicates(["doc_id"]), "doc_id", "left")
    width = F.when(F.col("n_chars") % 17 == 0, -1).otherwise(F.col("n_chars") % 500)
    reason = Q.drop_reason(F.col("text"), F.col("quality").isNotNull(), width, F.lit(40), Q.WORD_LIMITS, [(0x09, 0x0A), (0x20, 0x7E), (0xA0, 0xF5)])
    return docs.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


DROP_REASONS = r"""
WITH d AS (SELECT text, quality, CASE WHEN n_chars % 17 = 0 THEN -1 ELSE n_chars % 500 END AS w FROM documents LEFT JOIN (SELECT DISTINCT ON (doc_id) doc_id, quality FROM labels) USING (doc_id)),
r AS (SELECT CASE WHEN regexp_matches(text, '[^\t\n -~\x{00A0}-\x{00F5}]') THEN 'language' WHEN quality IS NULL THEN 'missing_file' WHEN w < 0 THEN 'corrupt' WHEN w < 10 THEN 'width_small' WHEN w / 40.0 < 0.3 THEN 'aspect_low' WHEN w / 40.0 > 25 THEN 'aspect_high' ELSE 'kept' END AS reason FROM d)
SELECT reason, count(*) AS "rows" FROM r GROUP BY reason"""


def size_histogram_by_source(spark, sf_dir):
    from glyphmill.operators.reports import bin_label

    s = _sizes(spark, sf_dir).select("l_returnflag", bin_label(F.col("w"), [0, 10, 32, 64, 128, 256, 512, 1024]).alias("bin"))
    counts = s.groupBy("l_returnflag", "bin").agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy("l_returnflag").agg(F.sum("rows").alias("total"))
    return counts.join(totals, "l_returnflag").select("l_returnflag", "bin", "rows", F.round(100 * F.col("rows") / F.col("total"), 4).alias("percent"))


SIZE_HISTOGRAM = f"""
WITH s AS ({_SIZES}), b AS (SELECT l_returnflag, CASE WHEN w < 10 THEN '[0,10)' WHEN w < 32 THEN '[10,32)' WHEN w < 64 THEN '[32,64)' WHEN w < 128 THEN '[64,128)' WHEN w < 256 THEN '[128,256)' WHEN w < 512 THEN '[256,512)' WHEN w < 1024 THEN '[512,1024)' ELSE '>=1024' END AS bin FROM s)
SELECT l_returnflag, bin, n AS "rows", round(100 * n::DOUBLE / sum(n) OVER (PARTITION BY l_returnflag), 4) AS percent FROM (SELECT l_returnflag, bin, count(*) AS n FROM b GROUP BY l_returnflag, bin)"""


def size_range_join(spark, sf_dir):
    """Bins as a table: a range join against a handful of literal rows."""
    bins = spark.sql("SELECT * FROM VALUES ('tiny', 0, 20), ('small', 20, 80), ('medium', 80, 200), ('large', 200, 1000000) AS b(name, low, high)")
    s = _sizes(spark, sf_dir)
    return s.join(F.broadcast(bins), (F.col("h") >= F.col("low")) & (F.col("h") < F.col("high"))).groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.avg("h").alias("a")).select("name", "rows", F.round("a", 4).alias("mean_height"))


SIZE_RANGE_JOIN = f"""
SELECT name, count(*) AS "rows", round(avg(h), 4) AS mean_height FROM ({_SIZES}) s JOIN (VALUES ('tiny', 0, 20), ('small', 20, 80), ('medium', 80, 200), ('large', 200, 1000000)) b(name, low, high) ON h >= low AND h < high GROUP BY name"""


def outlier_classes(spark, sf_dir):
    s = _sizes(spark, sf_dir).withColumn("outlier", Q.outlier_class(F.col("w"), F.col("h"))).filter("outlier IS NOT NULL")
    return s.groupBy("l_returnflag", "outlier").agg(F.count(F.lit(1)).alias("rows"), F.min("w").alias("narrowest"), F.max("h").alias("tallest"))


OUTLIER_CLASSES = f"""
SELECT l_returnflag, outlier, count(*) AS "rows", min(w) AS narrowest, max(h) AS tallest
FROM (SELECT *, CASE WHEN w < 10 OR h < 10 THEN 'too_small' WHEN h > 200 THEN 'too_tall' WHEN {_ASPECT} < 0.5 THEN 'narrow' END AS outlier FROM ({_SIZES})) WHERE outlier IS NOT NULL GROUP BY l_returnflag, outlier"""


def export_index(spark, sf_dir):
    """Dense 0-based index of each partition's samples, in key order."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    out = bucketed_rank(o, ["o_orderstatus", "o_orderpriority"], [F.col("o_orderkey")], F.floor(F.col("o_orderkey") / 4096), rank="idx")
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority", "idx")


EXPORT_INDEX = "SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS idx FROM orders"


def export_partition_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("num_samples"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))


EXPORT_PARTITION_COUNTS = "SELECT l_returnflag, l_linestatus, count(*) AS num_samples, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY ALL"


def quality_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return Q.quality_gate(o, F.col("o_totalprice") < 10000, [F.col("o_orderkey")]).select("checked", F.round("bad_share", 6).alias("bad_share"), "passed")


QUALITY_GATE = """
SELECT count(*) AS checked, round(avg((o_totalprice < 10000)::INT), 6) AS bad_share, avg((o_totalprice < 10000)::INT) <= 0.05 AS passed FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)"""


QUERIES = {
    "split_determined": (split_determined, SPLIT_DETERMINED),
    "split_random_80_10_10": (split_random_80_10_10, SPLIT_RANDOM),
    "split_group_80_10_10": (split_group_80_10_10, SPLIT_GROUP),
    "split_90_5_5": (split_90_5_5, SPLIT_90),
    "split_leakage_check": (split_leakage_check, SPLIT_LEAKAGE),
    "split_by_source": (split_by_source, SPLIT_BY_SOURCE),
    "split_dispatch": (split_dispatch, SPLIT_DISPATCH),
    "dimension_filter_reasons": (dimension_filter_reasons, DIMENSION_FILTER_REASONS),
    "drop_reasons": (drop_reasons, DROP_REASONS),
    "size_histogram_by_source": (size_histogram_by_source, SIZE_HISTOGRAM),
    "size_range_join": (size_range_join, SIZE_RANGE_JOIN),
    "outlier_classes": (outlier_classes, OUTLIER_CLASSES),
    "export_index": (export_index, EXPORT_INDEX),
    "export_partition_counts": (export_partition_counts, EXPORT_PARTITION_COUNTS),
    "quality_gate": (quality_gate, QUALITY_GATE),
}
