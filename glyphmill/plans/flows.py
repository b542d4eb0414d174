"""Queries on gates, observed counters, interval joins and the model hook."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions.corrector import predict
from glyphmill.functions.text import source_tag, utf8
from glyphmill.operators.gates import Counters, gated
from glyphmill.operators.intervals import interval_join
from glyphmill.operators.reports import bar
from glyphmill.plans.common import table


def gated_orders(spark, sf_dir):
    """Orders a status, of a plan that fails if over 5 % of all orders had no positive price."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    good = gated(o, ~(F.col("o_totalprice") > 0), 0.05, "orders without a price")
    return good.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))


GATED_ORDERS = "SELECT o_orderstatus, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY o_orderstatus"


def observed_counters(spark, sf_dir):
    """stage, counter, n: what the stages of a running flow over the documents counted themselves."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    c = Counters()
    read = c.stage(docs, "read", without_text=F.count_if(F.col("text").isNull()))
    long_ = c.stage(read.filter(F.length("text") >= 200), "long", longest=F.max(F.length("text")))
    known = table(spark, sf_dir, "labels", "doc_id", "quality").dropDuplicates(["doc_id"])
    c.stage(long_.join(known, "doc_id"), "labelled", good=F.count_if(F.col("quality") == 1)).write.format("noop").mode("overwrite").save()
    rows = [(stage, counter, int(n or 0)) for stage, counts in c.values().items() for counter, n in counts.items()]
    return spark.createDataFrame(rows, "stage string, counter string, n long")


OBSERVED_COUNTERS = """
WITH long AS (SELECT * FROM documents WHERE length(text) >= 200),
labelled AS (SELECT doc_id, quality FROM long JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))
SELECT 'read' AS stage, 'rows' AS counter, count(*) AS n FROM documents UNION ALL SELECT 'read', 'without_text', count(*) FILTER (text IS NULL) FROM documents
UNION ALL SELECT 'long', 'rows', count(*) FROM long UNION ALL SELECT 'long', 'longest', coalesce(max(length(text)), 0) FROM long
UNION ALL SELECT 'labelled', 'rows', count(*) FROM labelled UNION ALL SELECT 'labelled', 'good', count(*) FILTER (quality = 1) FROM labelled"""


def balance_bands(spark, sf_dir):
    """Customers of each supplier's nation whose balance is at most 50 above the supplier's."""
    bands = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    return interval_join(c, bands, "c_acctbal", "low", "high", ["nation"]).select("s_suppkey", "c_custkey")


BALANCE_BANDS = "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 50"


def model_candidates(spark, sf_dir):
    """Brand names through a stand-in for a model: the hook's batches and its model per worker, with an answer that SQL has too."""

    def load():
        return lambda part: part.assign(candidate=part.p_brand.str[::-1].str.upper())

    parts = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    return predict(parts, "p_partkey long, p_brand string, candidate string", load, batch=64).select("p_partkey", "candidate")


MODEL_CANDIDATES = "SELECT p_partkey, upper(reverse(p_brand)) AS candidate FROM part"


def source_bars(spark, sf_dir):
    """Documents a source: count, share as text, and a bar of it."""
    d = table(spark, sf_dir, "documents", "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))  # a row a source
    return d.select(source_tag(F.concat(F.lit("UIT_HWDB_"), "source")).alias("tag"), "n", bar(share).alias("bar"))


SOURCE_BARS = "SELECT 'uit_' || source AS tag, n, repeat('█', floor(n / sum(n) OVER () * 50)::INT) AS bar FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)"


def stored_labels(spark, sf_dir):
    """Labels as bytes of a sample store, and whether they come back as they were."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.octet_length(utf8(F.col("text"))).alias("bytes"), F.md5(utf8(F.col("text"))).alias("digest"), (F.decode(utf8(F.col("text")), "UTF-8") == F.col("text")).alias("same"))


STORED_LABELS = "SELECT doc_id, octet_length(encode(text)) AS bytes, md5(text) AS digest, decode(encode(text)) = text AS same FROM documents"

QUERIES = {
    "source_bars": (source_bars, SOURCE_BARS),
    "stored_labels": (stored_labels, STORED_LABELS),
    "gated_orders": (gated_orders, GATED_ORDERS),
    "observed_counters": (observed_counters, OBSERVED_COUNTERS),
    "balance_bands": (balance_bands, BALANCE_BANDS),
    "model_candidates": (model_candidates, MODEL_CANDIDATES),
}
