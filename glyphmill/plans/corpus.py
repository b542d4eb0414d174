"""Queries on sentences, place names, batches and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import corpus as C
from glyphmill.operators import gazetteer as G
from glyphmill.operators import sampling as S
from glyphmill.operators import training as T
from glyphmill.operators.ranking import bucketed_rank
from glyphmill.plans.common import HEAVY, SPACES, table
from glyphmill.sources.readers import spread

#: Addresses of a task.
ADDRESSES = 1 << 16


def sentence_extract(spark, sf_dir):
    out = C.raw_sentences(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").filter("sentence <> ''")
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("chars"), F.max(F.length("sentence")).alias("longest"))


#: Break points behind . ! ? are marked first, for engines without look-behind.
_RAW = rf"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(part, '\[[0-9]+\]', '', 'g'), '{SPACES}', ' ', 'g'), '^ | $', '', 'g') AS sentence FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(line, '([.!?]){SPACES}', '\1' || chr(1), 'g'), chr(1))) AS part FROM (
    SELECT doc_id, regexp_replace(regexp_replace(l, '^{SPACES}', ''), '{SPACES}$', '') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))
  WHERE line <> '' AND NOT regexp_matches(line, '^(==|\{{\{{|\|)'))"""
SENTENCE_EXTRACT = f"SELECT doc_id, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars, max(length(sentence))::INT AS longest FROM ({_RAW}) WHERE sentence <> '' GROUP BY doc_id"


def sentence_quality(spark, sf_dir):
    out = C.extract_sentences(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("good"), F.sum(F.length("sentence")).alias("chars"), F.min(F.md5("sentence")).alias("least_digest"))


_GOOD = "length(s) BETWEEN 8 AND 200 AND length(regexp_replace(s, '[\\x00-\\x7F]', '', 'g')) >= 2"
_SENTENCES = rf"""r AS ({_RAW}), p AS (
  SELECT doc_id, sentence AS s FROM r WHERE length(sentence) <= 200 AND length(regexp_replace(sentence, '[^\p{{L}}]', '', 'g')) >= length(sentence) * 0.3
    AND length(sentence) - length(replace(sentence, '(', '')) <= 3 AND length(sentence) - length(replace(sentence, ')', '')) <= 3
  UNION ALL SELECT doc_id, regexp_replace(x, '^ +| +$', '', 'g') FROM (SELECT doc_id, unnest(string_split(regexp_replace(sentence, ', +', chr(1), 'g'), chr(1))) AS x FROM r WHERE length(sentence) > 200))"""
SENTENCE_QUALITY = rf"""
WITH {_SENTENCES}
SELECT doc_id, count(*) AS good, sum(length(s))::BIGINT AS chars, min(md5(s)) AS least_digest FROM p WHERE {_GOOD} GROUP BY doc_id"""


def pack_segments(spark, sf_dir):
    s = C.raw_sentences(table(spark, sf_dir, "documents", "doc_id", "text", rows=HEAVY), "doc_id", "text").filter(F.length("sentence") >= 8)
    seg = s.select("doc_id", F.explode(C.pack_segments(F.col("sentence"), 60)).alias("segment"))
    return seg.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.max(F.length("segment")).alias("longest"))


def _segments(t: str, longest: int) -> str:
    """SQL of the list of segments of a text whose white space is single spaces."""

    def joined(parts: str, joiner: str) -> str:
        fits = f"acc[-1] <> '' AND length(acc[-1]) + {len(joiner)} + length(x[1]) <= {longest}"
        fold = f"list_reduce(list_transform({parts}, lambda p: [p]), lambda acc, x: CASE WHEN {fits} THEN list_concat(acc[:-2], [acc[-1] || '{joiner}' || x[1]]) ELSE list_concat(acc, x) END)"
        return f"list_filter({fold}, lambda s: length(s) >= {C.SHORTEST})"

    def between(pattern: str) -> str:
        pieces = f"list_transform(regexp_split_to_array({t}, '{pattern}'), lambda p: trim(p))"
        found = joined(f"list_concat(({pieces})[:1], list_filter(({pieces})[2:], lambda p: p <> ''))", ", ")
        return f"CASE WHEN regexp_matches({t}, '{pattern}') THEN list_filter([{found}], lambda f: len(f) > 0 AND list_max(list_transform(f, lambda s: length(s))) <= {longest})[1] END"

    words = joined(f"string_split({t}, ' ')", " ")
    return f"CASE WHEN length({t}) <= {longest} THEN [{t}] ELSE coalesce({', '.join(map(between, C.BREAKS))}, list_filter([{words}], lambda f: len(f) > 0)[1], [substring({t}, 1, {longest})]) END"


PACK_SEGMENTS = f"""
WITH s AS (SELECT doc_id, unnest({_segments('sentence', 60)}) AS segment FROM ({_RAW}) WHERE length(sentence) >= 8)
SELECT doc_id, count(*) AS segments, max(length(segment))::INT AS longest FROM s GROUP BY doc_id"""


def clean_corpus(spark, sf_dir):
    s = C.extract_sentences(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return C.clean_corpus(s.select("sentence", "doc_id"), "sentence", "doc_id", 100).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))


CLEAN_CORPUS = rf"""
WITH {_SENTENCES}, g AS (SELECT nfc_normalize(s) AS s, min(doc_id) AS doc_id FROM p WHERE {_GOOD} GROUP BY 1),
c AS (SELECT doc_id, trim(unnest({_segments('s', 100)})) AS segment FROM g WHERE length(s) >= 5),
f AS (SELECT segment, min(doc_id) AS doc_id FROM c WHERE length(segment) BETWEEN 5 AND 100 GROUP BY segment)
SELECT doc_id, count(*) AS sentences FROM f GROUP BY doc_id"""

_TEMPLATES = ["{num} {street}, {ward}", "{street} {num}/{sub}, {ward}, {city}", "{ward}, {city}"]
_STREETS, _WARDS, _CITIES = ["Alpha Street", "Beta Road", "Gamma Lane", "Delta Way"], ["Ward 1", "Ward 2", "Ward 3"], ["North City", "South City"]


def template_addresses(spark, sf_dir):
    n = table(spark, sf_dir, "customer", "c_custkey")
    key = lambda what: (F.col("c_custkey"), F.lit(what))
    values = {
        "num": C.hash_number(999, *key("num")) + 1, "sub": C.hash_number(50, *key("sub")) + 1, "street": C.choice(_STREETS, *key("street")),
        "ward": C.choice(_WARDS, *key("ward")), "city": C.choice(_CITIES, *key("city")),
    }
    return n.select("c_custkey", C.fill_template(C.choice(_TEMPLATES, *key("template")), values).alias("address"))


def _pick(n: int, what: str, key: str = "c_custkey") -> str:
    return f"(('0x' || substring(md5({key} || '{what}'), 1, 15))::BIGINT % {n})"


def _from(values: list[str], what: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{_pick(len(values), what)} + 1]"


TEMPLATE_ADDRESSES = f"""
SELECT c_custkey, replace(replace(replace(replace(replace({_from(_TEMPLATES, 'template')}, '{{num}}', ({_pick(999, 'num')} + 1)::VARCHAR), '{{sub}}', ({_pick(50, 'sub')} + 1)::VARCHAR), '{{street}}', {_from(_STREETS, 'street')}),
  '{{ward}}', {_from(_WARDS, 'ward')}), '{{city}}', {_from(_CITIES, 'city')}) AS address FROM customer"""


def cycle_corpus(spark, sf_dir):
    """Task i renders corpus line i modulo the number of lines."""
    items = bucketed_rank(table(spark, sf_dir, "benchmark", "item_id"), [], [F.col("item_id")], F.floor(F.col("item_id") / 1024), rank="rn", total="n")
    n = items.agg(F.max("n")).scalar()
    tasks = table(spark, sf_dir, "part", "p_partkey").withColumn("rn", F.pmod("p_partkey", n) + 1)
    return tasks.join(items.select("rn", "item_id"), "rn").select("p_partkey", "item_id")


CYCLE_CORPUS = """
WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn, count(*) OVER () AS n FROM benchmark) SELECT p_partkey, item_id FROM part JOIN i ON p_partkey % n + 1 = rn"""


def render_params(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey")
    k = lambda what: (F.col("p_partkey"), F.lit(what))
    return p.select(
        "p_partkey", (C.hash_number(21, *k("size")) + 28).alias("font_size"), (C.hash_number(31, *k("bg")) + 225).alias("background"), C.hash_number(61, *k("fg")).alias("foreground"),
        (C.hash_number(100, *k("blur")) < 15).alias("blur"), (C.hash_number(100, *k("noise")) < 12).alias("noise"), (C.hash_number(100, *k("turn")) < 20).alias("rotate"),
    )


RENDER_PARAMS = f"""
SELECT p_partkey, {_pick(21, 'size', 'p_partkey')} + 28 AS font_size, {_pick(31, 'bg', 'p_partkey')} + 225 AS background, {_pick(61, 'fg', 'p_partkey')} AS foreground,
  {_pick(100, 'blur', 'p_partkey')} < 15 AS blur, {_pick(100, 'noise', 'p_partkey')} < 12 AS noise, {_pick(100, 'turn', 'p_partkey')} < 20 AS rotate FROM part"""


def _misspelled(spark, sf_dir):
    """A misspelled nation name for every customer, and the region of the customer's own nation."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    bad = F.translate(F.concat(F.lit("NATIOM_"), F.col("c_custkey") % 30), "9", "g")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", bad.alias("entity"), F.col("n_regionkey").alias("region"))


_MISSPELLED = "SELECT c_custkey, translate('NATIOM_' || (c_custkey % 30), '9', 'g') AS entity, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey"


def fuzzy_best_match(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    return G.fuzzy_match(_misspelled(spark, sf_dir).select("c_custkey", "entity"), names, "c_custkey", "entity", "name")


_BEST = "row_number() OVER (PARTITION BY c_custkey ORDER BY levenshtein(entity, n_name), n_nationkey)"
FUZZY_BEST = f"""
SELECT c_custkey, n_name AS best, d::INT AS dist FROM (SELECT c_custkey, n_name, levenshtein(entity, n_name) AS d, {_BEST} AS r FROM ({_MISSPELLED}) m JOIN nation ON levenshtein(entity, n_name)::DOUBLE / greatest(length(entity), length(n_name)) <= 0.35) WHERE r = 1"""


def scoped_fuzzy_match(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.col("n_regionkey").alias("region"))
    return G.fuzzy_match(_misspelled(spark, sf_dir), names, "c_custkey", "entity", "name", scope="region")


SCOPED_FUZZY = f"""
SELECT c_custkey, n_name AS best, d::INT AS dist FROM (SELECT c_custkey, n_name, levenshtein(entity, n_name) AS d, {_BEST} AS r FROM ({_MISSPELLED}) m JOIN nation ON n_regionkey = region AND levenshtein(entity, n_name)::DOUBLE / greatest(length(entity), length(n_name)) <= 0.35) WHERE r = 1"""


def exact_name_skip(spark, sf_dir):
    """Names that are valid already, and those that need matching."""
    e = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_custkey") % 40).alias("entity"))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"))
    known = e.join(names, "entity", "left_semi").select("c_custkey", F.lit(True).alias("valid"))
    return known.unionByName(e.join(names, "entity", "left_anti").select("c_custkey", F.lit(False).alias("valid")))


EXACT_NAME_SKIP = "SELECT c_custkey, ('NATION_' || (c_custkey % 40)) IN (SELECT n_name FROM nation) AS valid FROM customer"


def trailing_province(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey")
    c = c.select("c_custkey", F.concat(F.lit("12 Street, Ward, NATIOM_"), F.col("c_custkey") % 30).alias("address"))
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("norm"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    return G.correct_trailing(c, names, "address").select("c_custkey", "corrected")


TRAILING_PROVINCE = """
WITH m AS (SELECT c_custkey, '12 Street, Ward, NATIOM_' || (c_custkey % 30) AS address, lower('NATIOM_' || (c_custkey % 30)) AS t FROM customer),
b AS (SELECT c_custkey, n_name, row_number() OVER (PARTITION BY c_custkey ORDER BY levenshtein(t, lower(n_name)), n_nationkey) AS r FROM m JOIN nation ON levenshtein(t, lower(n_name))::DOUBLE / greatest(length(t), length(n_name)) <= 0.35)
SELECT m.c_custkey, CASE WHEN n_name IS NULL THEN address ELSE '12 Street, Ward, ' || n_name END AS corrected FROM m LEFT JOIN b ON m.c_custkey = b.c_custkey AND r = 1"""


def address_correction(spark, sf_dir):
    """The whole rewriting, over a gazetteer that is made of the dimension names: regions, nations, and the
    supplier with the smallest key of each nation as its ward.

    A third of the addresses names a district alone; the others misspell a ward, a district and a province.
    """
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("ord"))
    nations = table(spark, sf_dir, "nation").join(regions.select(F.col("name").alias("province"), F.col("ord").alias("n_regionkey")), "n_regionkey")
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min_by("s_name", "s_suppkey").alias("name"))
    wards = nations.join(suppliers, "n_nationkey").select("name", "province", F.col("n_nationkey").alias("ord"))
    nations = nations.select(F.col("n_name").alias("name"), "province", F.col("n_nationkey").alias("ord"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])  # some dozens of names
    large, small = regions.agg(listed).scalar(), wards.agg(listed).scalar()
    c = spread(table(spark, sf_dir, "customer", "c_custkey"), ADDRESSES).select("c_custkey", large.alias("large"), small.alias("small"))
    pick = lambda names: F.element_at(names, (F.floor(F.col("c_custkey") / 3) % F.size(names) + 1).cast("int"))
    district = F.concat(F.lit("NATIOM_"), F.col("c_custkey") % 30)
    small, large = F.regexp_replace(pick(F.col("small")), "pp", "p"), F.translate(pick(F.col("large")), "IO", "LQ")
    kind = F.col("c_custkey") % 3
    address = F.when(kind == 0, F.concat(F.lit("Quận "), district, F.lit(", REGION")))
    address = address.when(kind == 1, F.concat(F.lit("Phường "), small, F.lit(", Huyện "), district, F.lit(", Tỉnh "), large))
    address = address.otherwise(F.concat(F.lit("12 Street, Xã "), small, F.lit(", Thị xã "), district, F.lit(", Thành phố "), large))
    c = c.select("c_custkey", address.alias("address"))
    out = G.correct_addresses(c, G.gazetteer(regions, nations, wards), "address")
    return out.select("c_custkey", "corrected", G.is_address_like(F.col("address")).alias("address_like"))


def _closest(entity: str, pool: str, ratio: float, scope: str) -> str:
    """SQL of the closest name of a pool inside `scope` (or of the whole pool), null if none is close."""
    near = f"levenshtein(lower({entity}), lower(name)) <= {ratio} * greatest(length({entity}), length(name))"
    return f"(SELECT arg_min(name, levenshtein(lower({entity}), lower(name)) * 1000 + ord) FROM {pool} WHERE {near} AND ({scope}))"


ADDRESS_CORRECTION = f"""
WITH p AS (SELECT r_name AS name, r_regionkey AS ord FROM region),
d AS (SELECT n_name AS name, r_name AS province, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT arg_min(s_name, s_suppkey) AS name, any_value(province) AS province, s_nationkey AS ord FROM supplier JOIN d ON d.ord = s_nationkey GROUP BY s_nationkey),
lists AS (SELECT (SELECT list(name ORDER BY ord) FROM p) AS ps, (SELECT list(name ORDER BY ord) FROM w) AS ws),
c AS (SELECT c_custkey, c_custkey % 3 AS kind, 'NATIOM_' || (c_custkey % 30) AS district, replace(ws[c_custkey // 3 % len(ws) + 1], 'pp', 'p') AS small, translate(ps[c_custkey // 3 % len(ps) + 1], 'IO', 'LQ') AS large FROM customer, lists),
k AS (SELECT DISTINCT kind, district, small, large, CASE WHEN kind = 0 THEN 'REGION' ELSE large END AS tail FROM c),
o AS (SELECT *, coalesce((SELECT min(name) FROM p WHERE lower(name) = lower(tail)), {_closest('tail', 'p', 0.3, 'true')}) AS province FROM k),
n AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.name = district) THEN district ELSE coalesce({_closest('district', 'd', 0.35, 'd.province = o.province OR o.province IS NULL')}, district) END AS d1,
  CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.name = small) THEN small ELSE coalesce({_closest('small', 'w', 0.35, 'w.province = o.province OR o.province IS NULL OR NOT EXISTS (SELECT 1 FROM w v WHERE v.province = o.province)')}, small) END AS w1,
  coalesce((SELECT min(name) FROM p WHERE name = large), {_closest('large', 'p', 0.35, 'true')}, large) AS p1 FROM o)
SELECT c_custkey, CASE kind WHEN 0 THEN 'Quận ' || d1 || ', REGION' WHEN 1 THEN 'Phường ' || w1 || ', Huyện ' || d1 || ', Tỉnh ' || p1 ELSE '12 Street, Xã ' || w1 || ', Thị xã ' || d1 || ', Thành phố ' || p1 END AS corrected, true AS address_like
FROM c JOIN n USING (kind, district, small, large)"""


def mixed_batches(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "event_type")
    return S.mixed_batches(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "event_id", 8, 0.7)


MIXED_BATCHES = """
WITH a AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id || '42'), event_id) AS rn, count(*) OVER () AS n FROM events WHERE event_type = 'click'),
f AS (SELECT (rn - 1) // 5 AS batch_no, event_id FROM a WHERE (rn - 1) // 5 < n // 5),
b AS (SELECT event_id, (row_number() OVER (ORDER BY md5(event_id || '42'), event_id) - 1) // 3 AS turn, count(*) OVER () // 3 AS turns FROM events WHERE event_type = 'view')
SELECT batch_no, 'first' AS pool, event_id FROM f UNION ALL
SELECT batch_no, 'second', event_id FROM (SELECT DISTINCT batch_no FROM f) x JOIN b ON turn = batch_no % turns AND turn < turns"""


def replay_buffer(spark, sf_dir):
    return S.replay_buffer(table(spark, sf_dir, "documents", "doc_id", "lang"), ["lang"], "doc_id")


REPLAY_BUFFER = """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '42'), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE rn <= greatest(1, floor(n * 0.15::DOUBLE))"""


def pseudo_line_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("batch_no", F.floor(F.col("p_partkey") / 64))
    return S.pseudo_lines(p, ["batch_no"], "p_partkey", "p_name", 0.5, 2, 4)


PSEUDO_LINES = """
WITH RECURSIVE r AS (
  SELECT p_partkey // 64 AS batch_no, p_name, row_number() OVER (PARTITION BY p_partkey // 64 ORDER BY md5(p_partkey || '42'), p_partkey::VARCHAR) AS i,
    CASE WHEN ('0x' || substring(md5(p_partkey || 'alone42'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < 0.5 THEN 1 ELSE 2 + trunc(('0x' || substring(md5(p_partkey || 'count42'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * 3)::BIGINT END AS n FROM part),
l AS (SELECT batch_no, 0 AS line_no, i, n FROM r WHERE i = 1 UNION ALL SELECT r.batch_no, line_no + 1, r.i, r.n FROM l JOIN r ON r.batch_no = l.batch_no AND r.i = l.i + l.n)
SELECT l.batch_no, line_no, count(*)::INT AS words, string_agg(p_name, ' ' ORDER BY r.i) AS label FROM l JOIN r ON r.batch_no = l.batch_no AND r.i >= l.i AND r.i < l.i + l.n GROUP BY ALL"""

PHASES = [("1A", 0, 5), ("1B", 5, 15), ("1C", 15, 20)]


def curriculum_phase(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "value").withColumn("epoch", F.col("event_id") % 25)
    return e.groupBy(T.curriculum_phase(F.col("epoch"), PHASES).alias("phase")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("value"), 6).alias("mean_loss"))


CURRICULUM_PHASE = """
SELECT CASE WHEN event_id % 25 < 5 THEN '1A' WHEN event_id % 25 < 15 THEN '1B' ELSE '1C' END AS phase, count(*) AS "rows", round(avg("value"), 6) AS mean_loss FROM events GROUP BY 1"""


def lr_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id")
    return e.select("event_id", F.round(T.learning_rate(F.col("event_id"), 8000, 500), 9).alias("rate"))


LR_SCHEDULE = """
SELECT event_id, round(CASE WHEN event_id < 500 THEN event_id / 500.0::DOUBLE ELSE greatest(0, 0.5 * (1 + cos(pi() * ((event_id - 500) / 7500.0::DOUBLE)))) END, 9) AS rate FROM events"""


def layer_rates(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    name = F.when(F.col("p_partkey") % 3 == 0, "decoder.layers.crossattention").when(F.col("p_partkey") % 3 == 1, "decoder.layers.self").otherwise("encoder.layer")
    g = T.layer_group(name, F.col("p_size") % 12, 6, 5e-5)
    return p.select(g.alias("g")).groupBy("g.part").agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("g.rate"), 9).alias("rate"))


LAYER_RATES = """
SELECT part, count(*) AS "rows", round(max(rate), 9) AS rate FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'cross_attention' WHEN p_partkey % 3 = 1 THEN 'decoder' WHEN p_size % 12 < 6 THEN 'encoder_low' ELSE 'encoder_top' END AS part,
  CASE WHEN p_partkey % 3 = 0 THEN 2.5e-5 WHEN p_partkey % 3 = 1 THEN 5e-5 WHEN p_size % 12 < 6 THEN 5e-6 ELSE 5e-5 END AS rate FROM part) GROUP BY part"""


def fisher_diag(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "label", "embedding")
    return T.fisher_diagonal(e, "label", "embedding").select("label", "pos", F.round("fisher", 6).alias("fisher"))


_FISHER = "SELECT label, pos::INT - 1 AS pos, avg(g::DOUBLE * g::DOUBLE) AS fisher FROM (SELECT label, unnest(embedding) AS g, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL"
FISHER_DIAG = f"SELECT label, pos, round(fisher, 6) AS fisher FROM ({_FISHER})"


def ewc_penalty(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    long = lambda rows: rows.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("value"))
    fisher = T.fisher_diagonal(e, "label", "embedding")
    out = T.ewc_penalty(fisher, long(e.filter("vec_id % 2 = 0")), long(e.filter("vec_id % 2 = 1")), 1000.0, "label")
    return out.select("label", F.round("penalty", 6).alias("penalty"))


EWC_PENALTY = f"""
WITH f AS ({_FISHER}), l AS (SELECT label, vec_id, unnest(embedding) AS g, generate_subscripts(embedding, 1)::INT - 1 AS pos FROM embeddings),
m AS (SELECT label, pos, avg(g::DOUBLE) FILTER (vec_id % 2 = 0) AS a, avg(g::DOUBLE) FILTER (vec_id % 2 = 1) AS c FROM l GROUP BY ALL)
SELECT label, round(500 * sum(fisher * (c - a) * (c - a)), 6) AS penalty FROM f JOIN m USING (label, pos) WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY label"""


def keep_last_checkpoints(spark, sf_dir):
    return T.keep_last(table(spark, sf_dir, "orders", "o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", 3)


KEEP_LAST = "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3"


def token_decode(spark, sf_dir):
    from glyphmill.functions.text import decode_tokens

    vocab = F.array(*[F.lit(x) for x in ["<s>", "</s>", "Ġthe", "Ġcat", "s", "Ċ", "on"]])
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    ids = F.array(F.lit(0), (F.col("p_size") % 5 + 2).cast("int"), (F.col("p_partkey") % 5 + 2).cast("int"), F.lit(4), F.lit(1))
    return p.select("p_partkey", decode_tokens(ids, vocab, [0, 1]).alias("decoded"))


TOKEN_DECODE = r"""
SELECT p_partkey, regexp_replace(replace(replace(['Ġthe', 'Ġcat', 's', 'Ċ', 'on'][p_size % 5 + 1] || ['Ġthe', 'Ġcat', 's', 'Ċ', 'on'][p_partkey % 5 + 1] || 's', 'Ġ', ' '), 'Ċ', chr(10)), '^\s+|\s+$', '', 'g') AS decoded FROM part"""

QUERIES = {
    "sentence_extract": (sentence_extract, SENTENCE_EXTRACT),
    "sentence_quality": (sentence_quality, SENTENCE_QUALITY),
    "pack_segments": (pack_segments, PACK_SEGMENTS),
    "clean_corpus": (clean_corpus, CLEAN_CORPUS),
    "template_addresses": (template_addresses, TEMPLATE_ADDRESSES),
    "cycle_corpus": (cycle_corpus, CYCLE_CORPUS),
    "render_params": (render_params, RENDER_PARAMS),
    "fuzzy_best_match": (fuzzy_best_match, FUZZY_BEST),
    "scoped_fuzzy_match": (scoped_fuzzy_match, SCOPED_FUZZY),
    "exact_name_skip": (exact_name_skip, EXACT_NAME_SKIP),
    "trailing_province": (trailing_province, TRAILING_PROVINCE),
    "address_correction": (address_correction, ADDRESS_CORRECTION),
    "mixed_batches": (mixed_batches, MIXED_BATCHES),
    "replay_buffer": (replay_buffer, REPLAY_BUFFER),
    "pseudo_line_labels": (pseudo_line_labels, PSEUDO_LINES),
    "curriculum_phase": (curriculum_phase, CURRICULUM_PHASE),
    "lr_schedule": (lr_schedule, LR_SCHEDULE),
    "layer_rates": (layer_rates, LAYER_RATES),
    "fisher_diag": (fisher_diag, FISHER_DIAG),
    "ewc_penalty": (ewc_penalty, EWC_PENALTY),
    "keep_last_checkpoints": (keep_last_checkpoints, KEEP_LAST),
    "token_decode": (token_decode, TOKEN_DECODE),
}
