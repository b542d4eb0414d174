"""Queries on labels: normalisation, characters, duplicates, missing files."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators.quality import RENDER_LIMITS, size_reason
from glyphmill.operators.ranking import bucketed_rank
from glyphmill.operators.sequence import first_seen, last_write
from glyphmill.operators.split import split_rows
from glyphmill.plans.common import HEAVY, LABEL, SPACES, hallucinated, table

ASCII = [(0x09, 0x0A), (0x20, 0x7E)]
FRENCH = [(0x09, 0x0A), (0x20, 0x7E), (0xE9, 0xE9)]


def _labels(spark, sf_dir, *more):
    return T.with_label(table(spark, sf_dir, "documents", "doc_id", "text", *more))


def corpus_split_summary(spark, sf_dir):
    docs = _labels(spark, sf_dir, "source").filter(F.col("label").isNotNull() & (F.length("label") >= 5) & T.is_allowed(F.col("label")))
    split = split_rows(docs.select("doc_id", "source", F.length("label").alias("chars")), "doc_id", ["source"])
    return split.groupBy("source", "final_split").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"))


CORPUS_SPLIT_SUMMARY = rf"""
WITH l AS (SELECT doc_id, source, {LABEL} AS label FROM documents),
k AS (SELECT doc_id, source, length(label) AS chars FROM l WHERE length(label) >= 5 AND NOT regexp_matches(label, '[^\t\n -~\x{{00A0}}-\x{{024F}}\x{{0300}}-\x{{036F}}\x{{1E00}}-\x{{1EFF}}\x{{2000}}-\x{{20CF}}]')),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '42'), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM k),
s AS (SELECT source, chars, CASE WHEN rn <= n - ceil(n * 0.2::DOUBLE) THEN 'train' WHEN rn <= n - ceil(ceil(n * 0.2::DOUBLE) * 0.5) THEN 'val' ELSE 'test' END AS final_split FROM r)
SELECT source, final_split, count(*) AS "rows", sum(chars)::BIGINT AS chars FROM s GROUP BY ALL"""


def normalize_label(spark, sf_dir):
    both = _labels(spark, sf_dir).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "label")
    items = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), T.normalize_label(F.col("text")).alias("label"))
    return both.unionByName(items).select("origin", "id", F.md5("label").alias("digest"), F.length("label").alias("chars"))


NORMALIZE_LABEL = rf"""
SELECT 'documents' AS origin, doc_id AS id, md5(nullif({LABEL}, '')) AS digest, length(nullif({LABEL}, ''))::INT AS chars FROM documents
UNION ALL SELECT 'benchmark', item_id, md5(nullif({LABEL}, '')), length(nullif({LABEL}, ''))::INT FROM benchmark"""


def label_lengths(spark, sf_dir):
    label = _labels(spark, sf_dir).filter(F.col("label").isNotNull()).withColumn("n", F.length("label"))
    bins = F.when(F.col("n") <= 20, "0-20").when(F.col("n") <= 40, "21-40").when(F.col("n") <= 60, "41-60").otherwise("61+")
    out = label.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg("n").alias("a"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.avg(F.size(F.split("label", " "))).alias("w"))
    total = out.agg(F.sum("rows")).scalar()
    return out.select("bin", "rows", F.round(100 * F.col("rows") / total, 4).alias("percent"), F.round("a", 4).alias("mean_chars"), "shortest", "longest", F.round("w", 4).alias("mean_words"))


LABEL_LENGTHS = rf"""
WITH l AS (SELECT {LABEL} AS label FROM documents), n AS (SELECT label, length(label) AS n FROM l WHERE label <> ''),
b AS (SELECT CASE WHEN n <= 20 THEN '0-20' WHEN n <= 40 THEN '21-40' WHEN n <= 60 THEN '41-60' ELSE '61+' END AS bin, * FROM n)
SELECT bin, count(*) AS "rows", round(100 * count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS percent, round(avg(n), 4) AS mean_chars, min(n)::INT AS shortest, max(n)::INT AS longest,
  round(avg(len(string_split(label, ' '))), 4) AS mean_words FROM b GROUP BY bin"""


def charset_reasons(spark, sf_dir):
    bad = _labels(spark, sf_dir).filter(F.col("label").isNotNull()).select("doc_id", T.foreign_chars(F.col("label"), ASCII).alias("bad"))
    return bad.select("doc_id", F.when(F.size("bad") > 0, "language").alias("reason"), F.size("bad").alias("bad_chars"), F.array_join(F.array_sort(F.array_distinct("bad")), "").alias("distinct_bad"))


CHARSET_REASONS = rf"""
WITH l AS (SELECT doc_id, {LABEL} AS label FROM documents), b AS (SELECT doc_id, regexp_extract_all(label, '[^\t\n -~]') AS bad FROM l WHERE label <> '')
SELECT doc_id, CASE WHEN len(bad) > 0 THEN 'language' END AS reason, len(bad)::INT AS bad_chars, array_to_string(list_sort(list_distinct(bad)), '') AS distinct_bad FROM b"""


def script_families(spark, sf_dir):
    bad = _labels(spark, sf_dir).select(T.foreign_chars(F.col("label"), FRENCH).alias("bad")).filter(F.size("bad") > 0)
    return bad.groupBy(T.script_families(F.col("bad")).alias("families")).agg(F.count(F.lit(1)).alias("rows"))


SCRIPT_FAMILIES = rf"""
WITH l AS (SELECT regexp_extract_all({LABEL}, '[^\t\n -~\x{{00E9}}]') AS bad FROM documents),
f AS (SELECT array_to_string(list_sort(list_distinct(list_transform(bad, lambda c: 'U+' || lpad(upper(to_hex(unicode(c))), 4, '0')))), '+') AS families FROM l WHERE len(bad) > 0)
SELECT families, count(*) AS "rows" FROM f GROUP BY families"""


def vocabulary(spark, sf_dir):
    chars = _labels(spark, sf_dir).select(F.explode(F.split("label", "")).alias("char")).filter("char <> ''")
    return chars.groupBy("char").agg(F.count(F.lit(1)).alias("uses")).select("char", F.ascii("char").alias("code"), "uses").orderBy("code")


VOCABULARY = rf"""
SELECT char, unicode(char) AS code, count(*) AS uses FROM (SELECT unnest(string_split({LABEL}, '')) AS char FROM documents) WHERE char <> '' GROUP BY ALL"""


def dedup_ordered(spark, sf_dir):
    labels = _labels(spark, sf_dir).filter(F.length("label") >= 5)
    return first_seen(labels, "label", "doc_id").select("doc_id", F.md5("label").alias("digest"))


DEDUP_ORDERED = rf"""
SELECT min(doc_id) AS doc_id, md5(label) AS digest FROM (SELECT doc_id, {LABEL} AS label FROM documents) WHERE length(label) >= 5 GROUP BY label"""


def dedup_last_wins(spark, sf_dir):
    return last_write(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id")


DEDUP_LAST_WINS = """
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, min(event_id) AS first_order FROM events GROUP BY user_id, event_type"""


def label_repetition(spark, sf_dir):
    labels = _labels(spark, sf_dir, "lang").filter(F.col("label").isNotNull())
    out = labels.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("label").alias("distinct_labels"))
    return out.withColumn("repetition", F.round(F.col("rows") / F.col("distinct_labels"), 4))


LABEL_REPETITION = rf"""
SELECT lang, count(*) AS "rows", count(DISTINCT label) AS distinct_labels, round(count(*)::DOUBLE / count(DISTINCT label), 4) AS repetition
FROM (SELECT lang, {LABEL} AS label FROM documents) WHERE label <> '' GROUP BY lang"""


def stage_counters(spark, sf_dir):
    docs = _labels(spark, sf_dir).join(table(spark, sf_dir, "labels", "doc_id", "quality").dropDuplicates(["doc_id"]), "doc_id", "left")
    return docs.agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("label").isNull()).alias("skipped_label"), F.count_if(F.col("quality").isNull()).alias("skipped_image"),
        F.count_if(F.col("label").isNotNull() & F.col("quality").isNotNull()).alias("ok"),
    )


STAGE_COUNTERS = rf"""
WITH d AS (SELECT doc_id, nullif({LABEL}, '') AS label, quality FROM documents LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))
SELECT count(*) AS seen, count(*) FILTER (label IS NULL) AS skipped_label, count(*) FILTER (quality IS NULL) AS skipped_image, count(*) FILTER (label IS NOT NULL AND quality IS NOT NULL) AS ok FROM d"""


def semi_labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi")


SEMI_LABELLED = "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


def anti_unlabelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    gone = docs.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_anti")
    return gone.groupBy("source").agg(F.count(F.lit(1)).alias("missing"), F.sum("n_chars").alias("chars"))


ANTI_UNLABELLED = "SELECT source, count(*) AS missing, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source"


def outer_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    out = docs.join(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), "doc_id", "left")
    return out.select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


OUTER_LABELS = "SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)"


def sanitize_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", rows=HEAVY)
    return docs.select("doc_id", F.md5(T.sanitize(F.col("text"))).alias("digest"), F.length(T.sanitize(F.col("text"))).alias("chars"))


def hallucination_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", T.has_hallucination(F.col("text")).alias("hallucinated"))


HALLUCINATION_FLAGS = hallucinated("doc_id", "text", "documents")


def collapse_spaces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.md5(T.collapse_spaces(F.col("text"))).alias("digest"))


COLLAPSE_SPACES = rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{SPACES}', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents"


def safe_labels(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.safe_label(F.col("text")).alias("safe"))


SAFE_LABELS = r"SELECT item_id, regexp_replace(substring(text, 1, 10), '[^\p{L}\p{N}]', '_', 'g') AS safe FROM benchmark"


def document_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").withColumn("stem", F.concat("s_name", F.lit("_crop_"), F.col("s_suppkey") % 7))
    return s.select(
        "s_suppkey", T.document_id(F.col("stem")).alias("document"), T.crop_document_id(F.col("stem")).alias("crop_document"),
        T.image_name(F.concat("stem", F.lit(".jpeg")), "uit_").alias("file"),
    )


DOCUMENT_NAMES = """
SELECT s_suppkey, s_name || '_crop' AS document, s_name AS crop_document, 'uit_' || s_name || '_crop_' || (s_suppkey % 7) || '.png' AS file FROM supplier"""


def token_skips(spark, sf_dir):
    tokens = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"(?U)\s+")).alias("token")).filter("token <> ''")
    return tokens.groupBy(T.skip_token(F.col("token")).alias("skipped")).agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("token").alias("kinds"))


TOKEN_SKIPS = r"""
WITH t AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM benchmark), c AS (SELECT token, replace(token, '_', '') AS c, regexp_replace(replace(token, '_', ''), '[^\p{L}]', '', 'g') AS l FROM t WHERE token <> '')
SELECT length(c) <= 1 OR NOT regexp_matches(c, '[\p{L}\p{N}]') OR regexp_matches(c, '^[\p{Nd}.,\-/]+$') OR (length(l) BETWEEN 1 AND 5 AND regexp_matches(l, '^\p{Lu}+$')) AS skipped,
  count(*) AS tokens, count(DISTINCT token) AS kinds FROM c GROUP BY 1"""


def render_width(spark, sf_dir):
    """Texts that are too wide to be rendered at their size."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    return p.select("p_partkey", size_reason(F.length("p_name") * F.col("p_size") * 2, F.col("p_size"), RENDER_LIMITS).alias("reason"))


RENDER_WIDTH = "SELECT p_partkey, CASE WHEN length(p_name) * p_size * 2 < 1 THEN 'width_small' WHEN p_size < 1 THEN 'height_small' WHEN length(p_name) * p_size * 2 > 2400 THEN 'width_large' END AS reason FROM part"


def writer_order(spark, sf_dir):
    """Places of ids that are text, in the order of their numbers; text that is no number has none."""
    s = table(spark, sf_dir, "supplier", "s_suppkey").select((F.col("s_suppkey") * 7 % 1000).cast("string").alias("writer"), "s_suppkey")
    s = s.withColumn("number", F.col("writer").try_cast("long")).filter("number IS NOT NULL")
    return bucketed_rank(s, [], [F.col("number"), F.col("s_suppkey")], F.floor(F.col("number") / 64), rank="place").select("s_suppkey", "writer", "place")


WRITER_ORDER = "SELECT s_suppkey, (s_suppkey * 7 % 1000)::VARCHAR AS writer, row_number() OVER (ORDER BY s_suppkey * 7 % 1000, s_suppkey) AS place FROM supplier"


QUERIES = {
    "render_width": (render_width, RENDER_WIDTH),
    "writer_order": (writer_order, WRITER_ORDER),
    "corpus_split_summary": (corpus_split_summary, CORPUS_SPLIT_SUMMARY),
    "normalize_label": (normalize_label, NORMALIZE_LABEL),
    "label_lengths": (label_lengths, LABEL_LENGTHS),
    "charset_reasons": (charset_reasons, CHARSET_REASONS),
    "script_families": (script_families, SCRIPT_FAMILIES),
    "vocabulary": (vocabulary, VOCABULARY),
    "dedup_ordered": (dedup_ordered, DEDUP_ORDERED),
    "dedup_last_wins": (dedup_last_wins, DEDUP_LAST_WINS),
    "label_repetition": (label_repetition, LABEL_REPETITION),
    "stage_counters": (stage_counters, STAGE_COUNTERS),
    "semi_labelled": (semi_labelled, SEMI_LABELLED),
    "anti_unlabelled": (anti_unlabelled, ANTI_UNLABELLED),
    "outer_labels": (outer_labels, OUTER_LABELS),
    "sanitize_text": (sanitize_text, None),
    "hallucination_flags": (hallucination_flags, HALLUCINATION_FLAGS),
    "collapse_spaces": (collapse_spaces, COLLAPSE_SPACES),
    "safe_labels": (safe_labels, SAFE_LABELS),
    "document_names": (document_names, DOCUMENT_NAMES),
    "token_skips": (token_skips, TOKEN_SKIPS),
}
