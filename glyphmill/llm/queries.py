"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import language, quality
from glyphmill.llm.decontaminate import contamination
from glyphmill.llm.hard_negatives import mine
from glyphmill.llm.packing import pack
from glyphmill.llm.shared import shared_root, store
from glyphmill.llm.sharding import shard_documents
from glyphmill.llm.simhash import near_duplicates
from glyphmill.llm.snapshots import snapshot_difference
from glyphmill.llm.suffix_dedup import deduplicate
from glyphmill.llm.token_count import count_tokens
from glyphmill.llm.topk import top_k
from glyphmill.llm.url_filter import judge_urls
from glyphmill.llm.warc import capture_index, read_archives, write_archives
from glyphmill.sources.readers import spread

#: Rules of the page filter: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def op1_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of the embeddings for every fiftieth id."""
    return top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op2_byte_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_columnwise_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once 50-byte strings of earlier documents are cut out."""
    return deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from its labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of benchmark items in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by rule or by its host's reputation."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)


def op9_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs.select("doc_id", "text"), language.fit(docs.select("doc_id", "text", "lang")))


def op10_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    return count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_capture_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back, and indexed by URL and time; pages have no time, so captures follow their ids, a second each."""
    second = F.make_dt_interval(secs=F.pmod(F.col("page_id"), F.lit(30 * 86400)).cast("decimal(18,6)"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html", (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + second).alias("captured"))
    folder = f"{shared_root(spark)}/archives-{uuid.uuid4().hex[:8]}"
    write_archives(pages, folder, captured="captured")
    index = capture_index(store(read_archives(spark, folder), "captures"))
    return index.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "place", "file", "offset", "length")


def op12_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose id is divisible by 100, labels of every seventh id being wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return mine(rows, F.col("vec_id") % 100 == 0)


def op13_snapshot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against a later snapshot of them, in which crc32 of the id changes rows, moves them to other keys, copies or drops them."""
    old = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    case = F.crc32(F.col("doc_id").cast("string")) % 10
    moved = -1 - F.col("doc_id")
    keys = F.when(case.isin(3, 4), F.array(moved)).when(case == 5, F.array("doc_id", moved)).otherwise(F.array("doc_id"))
    new = old.filter(F.coalesce(case != 0, F.lit(True))).select(
        keys.alias("keys"),
        F.when(case == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(case == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(case == 2, F.col("lang")).when(case == 4, None).otherwise(F.col("source")).alias("source"),
    )
    line = F.concat_ws("\n", *[F.coalesce(c, F.lit("~")) for c in ("text", "lang", "source")])
    new = new.withColumn("row_sha256", F.sha2(line, 256)).withColumn("doc_id", F.explode("keys"))
    out = snapshot_difference(old, new, "doc_id", ["text", "lang", "source"], carry=["row_sha256"])
    return out.select("key", "old_key", "op", F.array_join(F.coalesce("changed", F.array()), ",").alias("changed"), "row_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


OP7_SQL = r"""
WITH base AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
fit AS (
  SELECT b.page_id, b.host, b.path, arg_max(r.rhost || r.rpath, len(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, len(r.rhost || r.rpath)) AS rv
  FROM base b LEFT JOIN rules r ON (b.host = r.rhost OR ends_with(b.host, '.' || r.rhost)) AND starts_with(b.path, r.rpath)
  GROUP BY ALL),
hosts AS (
  SELECT host, CASE WHEN below THEN regexp_extract(host, '([^.]*\.)?[^.]*\.[^.]*\z') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
    CASE WHEN below THEN regexp_extract(host, '[^.]*\.[^.]*\z') ELSE string_split(host, '.')[-1] END AS suffix,
    count(rv)::DOUBLE AS n, count(*) FILTER (rv = 'block')::DOUBLE AS k
  FROM (SELECT *, regexp_matches(host, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z][a-z]\z') AS below FROM fit) GROUP BY host, below),
doms AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM hosts) AS m FROM doms GROUP BY suffix),
s1 AS (SELECT CASE WHEN sum(n*(n-1)*m*(1-m)) > 0 THEN 1 / greatest(0.001, least(0.999, sum((k-n*m)*(k-n*m) - n*m*(1-m)) / sum(n*(n-1)*m*(1-m)))) - 1 ELSE 1 END AS st FROM s0),
s2 AS (SELECT suffix, (k + st*m) / (n + st) AS m FROM s0, s1),
d0 AS (SELECT doms.*, s2.m FROM doms JOIN s2 USING (suffix)),
d1 AS (SELECT CASE WHEN sum(n*(n-1)*m*(1-m)) > 0 THEN 1 / greatest(0.001, least(0.999, sum((k-n*m)*(k-n*m) - n*m*(1-m)) / sum(n*(n-1)*m*(1-m)))) - 1 ELSE 1 END AS st FROM d0),
d2 AS (SELECT domain, (k + st*m) / (n + st) AS m FROM d0, d1),
h0 AS (SELECT hosts.*, d2.m FROM hosts JOIN d2 USING (domain)),
h1 AS (SELECT CASE WHEN sum(n*(n-1)*m*(1-m)) > 0 THEN 1 / greatest(0.001, least(0.999, sum((k-n*m)*(k-n*m) - n*m*(1-m)) / sum(n*(n-1)*m*(1-m)))) - 1 ELSE 1 END AS st FROM h0),
h2 AS (SELECT host, n + st AS size, (k + st*m) / (n + st) AS p FROM h0, h1)
SELECT page_id, fit.host, path, rule,
  coalesce(rv, CASE WHEN p - 1.0 * sqrt(p*(1-p) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM fit JOIN h2 USING (host)
"""


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s+n-1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM sized)),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT k, n, s, array_to_string(w[s:s+n-1], ' ') AS win FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lens WHERE len(w) >= n)),
found AS (SELECT k, spots.n, s, item_id FROM spots JOIN wins ON spots.win = wins.win AND spots.n = wins.n),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM found) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, item_id FROM found) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP13_SQL = r"""
WITH tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(i))),
old AS (
  SELECT doc_id AS key, text, lang, source,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10 AS d
  FROM documents, tbl),
later AS (
  SELECT CASE WHEN d IN (3, 4) THEN -1 - key ELSE key END AS key, CASE WHEN d = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
    CASE WHEN d = 2 THEN source ELSE lang END AS lang, CASE WHEN d = 2 THEN lang WHEN d = 4 THEN NULL ELSE source END AS source
  FROM old WHERE d <> 0
  UNION ALL SELECT -1 - key, text, lang, source FROM old WHERE d = 5),
sha AS (SELECT *, sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) AS row_sha256 FROM later),
met AS (
  SELECT coalesce(n.key, o.key) AS key, o.key AS old_key, n.key AS new_key, row_sha256,
    concat_ws(',', CASE WHEN o.text IS DISTINCT FROM n.text THEN 'text' END, CASE WHEN o.lang IS DISTINCT FROM n.lang THEN 'lang' END, CASE WHEN o.source IS DISTINCT FROM n.source THEN 'source' END) AS changed,
    coalesce(n.text, o.text) AS text, CASE WHEN n.key IS NULL THEN o.lang ELSE n.lang END AS lang, CASE WHEN n.key IS NULL THEN o.source ELSE n.source END AS source
  FROM old o FULL JOIN sha n ON o.key = n.key),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source, new_key IS NULL ORDER BY key) AS i FROM met WHERE old_key IS NULL OR new_key IS NULL),
rest AS (
  SELECT max(new_key) AS new_key, max(old_key) AS old_key, max(row_sha256) AS row_sha256 FROM ranked GROUP BY text, lang, source, i)
SELECT key, old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, row_sha256 FROM met WHERE old_key IS NOT NULL AND new_key IS NOT NULL
UNION ALL
SELECT coalesce(new_key, old_key), old_key, CASE WHEN old_key IS NULL THEN 'insert' WHEN new_key IS NULL THEN 'delete' ELSE 'rekey' END, '', row_sha256 FROM rest
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_dual_tree_topk": OP1_SQL, "op5_positional_index": OP5_SQL, "op7_url_reputation": OP7_SQL, "op12_ball_tree_negatives": OP12_SQL, "op13_snapshot_groups": OP13_SQL}
