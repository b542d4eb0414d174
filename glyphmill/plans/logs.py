"""Queries on ordered tables: training logs and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import layout as L
from glyphmill.operators import sequence as S
from glyphmill.plans.common import table
from glyphmill.sources import readers as R


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


def log_forward_fill(spark, sf_dir):
    phase = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    return S.forward_fill(_events(spark, sf_dir), phase, ["user_id"], ["event_id"], "phase").select("event_id", "phase")


LOG_FORWARD_FILL = """
SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phase FROM events"""


def rolling_mean(spark, sf_dir):
    e = _events(spark, sf_dir)
    two = S.rolling_mean(F.col("value"), ["user_id"], ["event_id"], 2)
    three = S.rolling_mean(F.when(F.col("event_type") != "error", F.col("value")), ["user_id"], ["event_id"], 3)
    return e.select("event_id", F.round(two, 6).alias("mean_2"), F.round(three, 6).alias("mean_3"))


ROLLING_MEAN = """
SELECT event_id, round(avg("value") OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS mean_2,
  round(avg(CASE WHEN event_type <> 'error' THEN "value" END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_3 FROM events"""


def running_best(spark, sf_dir):
    return S.running_best(_events(spark, sf_dir), "value", F.col("event_type") != "error", ["user_id"], ["event_id"]).select("event_id", "best_before", "is_best")


RUNNING_BEST = """
WITH b AS (SELECT *, min(CASE WHEN event_type <> 'error' THEN "value" END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events)
SELECT event_id, best_before, event_type <> 'error' AND (best_before IS NULL OR "value" < best_before) AS is_best FROM b"""


def early_stop(spark, sf_dir):
    return S.early_stop(_events(spark, sf_dir), F.col("value") > 100, ["user_id"], ["event_id"]).select("event_id", "user_id", "stopped")


EARLY_STOP = """
SELECT event_id, user_id, "value" > 100 AS stopped FROM (SELECT *, coalesce(max(("value" > 100)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM events) WHERE past = 0"""


def asof_attach(spark, sf_dir):
    e = _events(spark, sf_dir)
    out = S.asof_backward(e, F.col("event_type") == "purchase", F.col("event_type") == "view", ["event_id", "value"], ["user_id"], ["event_id"])
    return out.select("event_id", "asof_event_id", "asof_value")


ASOF_ATTACH = """
SELECT l.event_id, r.event_id AS asof_event_id, r."value" AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.event_id > r.event_id"""


def _epochs(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("epoch", F.floor(F.col("event_id") / 500).cast("int"))
    n = e.groupBy("user_id", "epoch").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    return n.withColumn("restarted", F.col("n") > 6)


def epoch_runtime(spark, sf_dir):
    return S.epoch_runtime(_epochs(spark, sf_dir), "ts", "epoch", "restarted", ["user_id"], 48 * 3600).select("user_id", "epoch", "restarted", "runtime")


EPOCH_RUNTIME = """
WITH e AS (SELECT user_id, (event_id // 500)::INT AS epoch, min(ts) AS ts, count(*) > 6 AS restarted FROM events GROUP BY ALL),
w AS (SELECT *, lag(ts) OVER o AS pts, lag(epoch) OVER o AS pe, lag(restarted) OVER o AS pr FROM e WINDOW o AS (PARTITION BY user_id ORDER BY epoch)),
g AS (SELECT *, trunc((epoch_us(ts) - epoch_us(pts)) / 1000000.0)::BIGINT AS gap FROM w)
SELECT user_id, epoch, restarted, CASE WHEN pe = epoch - 1 AND NOT pr AND gap > 0 AND gap < 48 * 3600 THEN gap END AS runtime FROM g"""


def restarted_epochs(spark, sf_dir):
    return _epochs(spark, sf_dir).filter("restarted").groupBy("epoch").agg(F.count(F.lit(1)).alias("users"))


RESTARTED = "SELECT epoch, count(*) AS users FROM (SELECT user_id, (event_id // 500)::INT AS epoch FROM events GROUP BY ALL HAVING count(*) > 6) GROUP BY epoch"


def change_points(spark, sf_dir):
    return S.change_points(_events(spark, sf_dir), "event_type", ["user_id"], ["event_id"]).select("event_id", "user_id", "previous", "event_type")


CHANGE_POINTS = """
SELECT event_id, user_id, previous, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous <> event_type"""


def global_epoch(spark, sf_dir):
    order = F.element_at(F.create_map(*[F.lit(x) for p in (("signup", 0), ("view", 1), ("click", 2), ("purchase", 3), ("error", 4)) for x in p]), F.col("event_type"))
    from pyspark.sql import Window as W

    e = _events(spark, sf_dir).withColumn("phase_order", order)
    return e.select("event_id", "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("phase_order", "event_id")).alias("global_epoch"))


GLOBAL_EPOCH = """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, event_id)::INT AS global_epoch FROM events"""


def best_marker(spark, sf_dir):
    e = _events(spark, sf_dir)
    best = e.groupBy("event_type").agg(F.min_by(F.struct("event_id", "value"), F.struct("value", "event_id")).alias("b"), F.max("value").alias("worst"))
    return best.select("event_type", F.col("b.event_id").alias("event_id"), F.col("b.value").alias("best"), "worst")


BEST_MARKER = """
SELECT event_type, event_id, "value" AS best, worst FROM (SELECT *, max("value") OVER (PARTITION BY event_type) AS worst, row_number() OVER (PARTITION BY event_type ORDER BY "value", event_id) AS r FROM events) WHERE r = 1"""


def phase_spans(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy("event_type").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.round(F.avg("value"), 6).alias("mean_loss"))


PHASE_SPANS = 'SELECT event_type, min(event_id) AS first_event, max(event_id) AS last_event, round(avg("value"), 6) AS mean_loss FROM events GROUP BY event_type'


def parse_props(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "ts", "value", "props")
    loss = F.concat(F.floor("value").cast("string"), F.lit("."), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 [Stage2a] Epoch "), F.get_json_object("props", "$.k"), F.lit(" | avg_loss="), loss)
    e = e.select("event_id", line.alias("line"))
    return e.select(
        "event_id", F.regexp_extract("line", r"\[Stage2a\] Epoch (\d+)", 1).cast("int").alias("epoch"), F.regexp_extract("line", r"avg_loss=([0-9.]+)", 1).cast("double").alias("loss"),
        F.unix_timestamp(F.regexp_extract("line", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1), "yyyy-MM-dd HH:mm:ss").alias("seconds"),
    )


PARSE_PROPS = """
SELECT event_id, (props->>'$.k')::INT AS epoch, (floor("value")::BIGINT || '.' || lpad((event_id % 10000)::VARCHAR, 4, '0'))::DOUBLE AS loss, floor(epoch_us(ts) / 1000000)::BIGINT AS seconds FROM events"""


def _log_lines(spark, sf_dir):
    """Twenty logs made of the events: phases, epoch lines of three stages in their spellings, evaluations."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    i, text = F.col("event_id"), lambda c: c.cast("string")
    stamp = F.when(i % 5 == 0, "").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 INFO ")))
    loss, epoch = F.concat(text(F.floor("value")), F.lit("."), text(i % 100)), text(i % 40)
    rate = F.concat(F.lit("CER=0."), text(i % 89), F.lit(" x WER=0."), text(i % 97))
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("start Phase"), F.element_at(F.array(*map(F.lit, "-_ ")), (i % 3 + 1).cast("int")), F.lit("1"), F.element_at(F.array(*map(F.lit, "aBc")), (i % 3 + 1).cast("int"))))
    line = line.when(F.col("event_type") == "view", F.concat(stamp, F.lit("[Stage1] Epoch "), epoch, F.lit(" done | avg_loss="), loss, F.lit(" | time="), text(i % 997), F.lit("s")))
    line = line.when(F.col("event_type") == "click", F.concat(stamp, F.lit("[stage2a] epoch "), epoch, F.when(i % 2 == 0, " | avg_loss=").otherwise(" | avg_CE="), loss))
    line = line.when(F.col("event_type") == "purchase", F.concat(stamp, F.lit("[Stage2b] Epoch "), epoch, F.lit("|avg_CE="), loss, F.lit(" | avg_EWC=0.0000"), F.when(i % 3 == 0, F.concat(F.lit(" printed "), rate)).otherwise("")))
    line = line.otherwise(F.concat(F.when(i % 3 == 0, "printed: ").when(i % 3 == 1, "HW ").otherwise("printed CER=0.5 handwritten: "), rate))
    return e.select(F.concat(F.lit("log"), text(F.col("user_id") % 20)).alias("path"), i.alias("line_no"), line.alias("value"))


_LOG_LINES = """
SELECT 'log' || (user_id % 20) AS path, event_id AS line_no, CASE event_type
  WHEN 'signup' THEN 'start Phase' || substring('-_ ', (event_id % 3 + 1)::INT, 1) || '1' || substring('aBc', (event_id % 3 + 1)::INT, 1)
  WHEN 'view' THEN stamp || '[Stage1] Epoch ' || epoch || ' done | avg_loss=' || loss || ' | time=' || (event_id % 997) || 's'
  WHEN 'click' THEN stamp || '[stage2a] epoch ' || epoch || CASE WHEN event_id % 2 = 0 THEN ' | avg_loss=' ELSE ' | avg_CE=' END || loss
  WHEN 'purchase' THEN stamp || '[Stage2b] Epoch ' || epoch || '|avg_CE=' || loss || ' | avg_EWC=0.0000' || CASE WHEN event_id % 3 = 0 THEN ' printed ' || rate ELSE '' END
  ELSE CASE event_id % 3 WHEN 0 THEN 'printed: ' WHEN 1 THEN 'HW ' ELSE 'printed CER=0.5 handwritten: ' END || rate END AS value
FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ',123 INFO ' END AS stamp, floor("value")::BIGINT || '.' || (event_id % 100) AS loss, event_id % 40 AS epoch,
  'CER=0.' || (event_id % 89) || ' x WER=0.' || (event_id % 97) AS rate FROM events)"""


def training_log(spark, sf_dir):
    out = R.parse_log(_log_lines(spark, sf_dir))
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _extract(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(value, '{pattern}', {group}), '')"


TRAINING_LOG = rf"""
WITH l AS ({_LOG_LINES}),
p AS (SELECT path, line_no, lower({_extract(R.PHASE, 1)}) AS mark,
  CASE WHEN regexp_matches(value, '{R.STAGE_2B}') THEN 'stage2b' WHEN regexp_matches(value, '{R.STAGE_2A}') THEN 'stage2a' WHEN regexp_matches(value, '{R.STAGE_1}') THEN 'stage1' END AS stage,
  coalesce({_extract(R.STAGE_2B, 1)}, {_extract(R.STAGE_2A, 1)}, {_extract(R.STAGE_1, 1)})::INT AS epoch, coalesce({_extract(R.STAGE_2B, 2)}, {_extract(R.STAGE_2A, 2)}, {_extract(R.STAGE_1, 2)})::DOUBLE AS loss,
  {_extract(R.STAGE_1, 3)}::INT AS runtime, {_extract(R.STAMP, 1)} AS stamp,
  {_extract(R.PRINTED, 1)}::DOUBLE AS pc, {_extract(R.PRINTED, 2)}::DOUBLE AS pw, {_extract(R.HANDWRITTEN, 1)}::DOUBLE AS hc, {_extract(R.HANDWRITTEN, 2)}::DOUBLE AS hw FROM l),
f AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS filled, count(stage) OVER w AS run FROM p WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT path, run, max(stage) AS stage, max(CASE stage WHEN 'stage1' THEN filled WHEN 'stage2a' THEN '2a' WHEN 'stage2b' THEN '2b' END) AS phase, max(epoch) AS epoch, max(loss) AS loss, max(runtime) AS runtime,
  max(CASE WHEN stage <> 'stage1' THEN stamp END) AS ts, min(line_no) AS line_no, arg_max(pc, line_no) FILTER (pc IS NOT NULL) AS pc, arg_max(pw, line_no) FILTER (pw IS NOT NULL) AS pw,
  arg_max(hc, line_no) FILTER (hc IS NOT NULL) AS hc, arg_max(hw, line_no) FILTER (hw IS NOT NULL) AS hw FROM f WHERE run > 0 GROUP BY path, run),
n AS (SELECT *, max(run) OVER k AS newest, min(line_no) OVER k AS first_line, min(CASE WHEN ts IS NOT NULL THEN run END) OVER k AS stamped, arg_max(ts, CASE WHEN ts IS NOT NULL THEN run END) OVER k AS last_ts
  FROM r WINDOW k AS (PARTITION BY path, stage, phase, epoch))
SELECT path, stage, phase, epoch, loss, runtime, last_ts AS ts, pc AS printed_cer, pw AS printed_wer, hc AS hw_cer, hw AS hw_wer, coalesce(stage = 'stage2a' AND newest > stamped, false) AS restarted, first_line FROM n WHERE run = newest"""


def metric_rows(spark, sf_dir):
    """Epochs with any metric at all."""
    out = R.parse_log(_log_lines(spark, sf_dir)).withColumn("loss", F.when(F.col("epoch") % 4 != 0, F.col("loss")))
    return S.any_present(out, ["loss", "printed_cer", "hw_cer"]).groupBy("stage").agg(F.count(F.lit(1)).alias("rows"))


METRIC_ROWS = f"SELECT stage, count(*) AS \"rows\" FROM ({TRAINING_LOG}) WHERE epoch % 4 <> 0 OR printed_cer IS NOT NULL OR hw_cer IS NOT NULL GROUP BY stage"


def _boxes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount").filter("l_discount >= 0.03")
    y1 = (F.col("l_linenumber") * 9 + F.col("l_partkey") % 13).cast("int")
    x1 = (F.col("l_suppkey") * 7 % 500).cast("int")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x1.alias("x1"), y1.alias("y1"), (x1 + 20).alias("x2"), (y1 + F.col("l_quantity").cast("int")).alias("y2"))


_BOXES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_suppkey * 7 % 500)::INT AS x1, (l_linenumber * 9 + l_partkey % 13)::INT AS y1, (l_suppkey * 7 % 500)::INT + 20 AS x2,
  (l_linenumber * 9 + l_partkey % 13)::INT + l_quantity::INT AS y2 FROM lineitem WHERE l_discount >= 0.03"""
_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "y2"]
_KEYS = ", ".join(_KEY)
_CLUSTERS = f"""
WITH b AS ({_BOXES}), y AS (SELECT *, (y1 + y2) / 2.0 AS y FROM b), e AS (SELECT l_orderkey, greatest(median(y2 - y1), 10.0) * 0.5 AS eps FROM b GROUP BY l_orderkey),
g AS (SELECT y.*, eps, coalesce((y - lag(y) OVER o > eps)::INT, 0) AS new FROM y JOIN e USING (l_orderkey) WINDOW o AS (PARTITION BY l_orderkey ORDER BY y, {_KEYS})),
c AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY y, {_KEYS} ROWS UNBOUNDED PRECEDING)::INT AS cluster FROM g)"""


def line_clusters(spark, sf_dir):
    out = L.line_clusters(_boxes(spark, sf_dir), ["l_orderkey"], key=_KEY)
    return out.groupBy("l_orderkey", "cluster").agg(F.count(F.lit(1)).alias("boxes"), F.round(F.avg("_y"), 6).alias("mean_y"))


LINE_CLUSTERS = f"{_CLUSTERS} SELECT l_orderkey, cluster, count(*) AS boxes, round(avg(y), 6) AS mean_y FROM c GROUP BY ALL"


def reading_order(spark, sf_dir):
    out = L.reading_order(L.line_clusters(_boxes(spark, sf_dir), ["l_orderkey"], key=_KEY), ["l_orderkey"], key=_KEY)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y2", "line_no", "box_no")


READING_ORDER = f"""{_CLUSTERS}, m AS (SELECT *, avg(y) OVER (PARTITION BY l_orderkey, cluster) AS my FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y2, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY my, cluster)::INT AS line_no,
  row_number() OVER (PARTITION BY l_orderkey, cluster ORDER BY x1, {_KEYS})::INT AS box_no FROM m"""


def bbox_merge(spark, sf_dir):
    return L.line_boxes(L.reading_order(L.line_clusters(_boxes(spark, sf_dir), ["l_orderkey"], key=_KEY), ["l_orderkey"], key=_KEY), ["l_orderkey"])


BBOX_MERGE = f"""{_CLUSTERS}, m AS (SELECT *, avg(y) OVER (PARTITION BY l_orderkey, cluster) AS my FROM c), r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY my, cluster)::INT AS line_no FROM m)
SELECT l_orderkey, line_no, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS boxes FROM r GROUP BY ALL"""


def crop_boxes(spark, sf_dir):
    out = L.crop_boxes(_boxes(spark, sf_dir), F.lit(480), F.lit(60))
    return out.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("kept"), F.sum("x1").alias("left_sum"), F.sum("y2").alias("bottom_sum"))


CROP_BOXES = f"""
WITH b AS ({_BOXES}), c AS (SELECT l_linenumber, greatest(0, x1 - 4) AS x1, greatest(0, y1 - 4) AS y1, least(480, x2 + 4) AS x2, least(60, y2 + 4) AS y2 FROM b)
SELECT l_linenumber, count(*) AS kept, sum(x1)::BIGINT AS left_sum, sum(y2)::BIGINT AS bottom_sum FROM c WHERE x2 - x1 >= 8 AND y2 - y1 >= 8 GROUP BY l_linenumber"""


def detection_boxes(spark, sf_dir):
    """Relative polygons to pixel boxes, fit into a recogniser's frame."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    share = F.col("p_size") / 60.0
    x, y = L.to_pixels(share, F.lit(640)), L.to_pixels(1 - share, F.lit(480))
    box = L.polygon_box(F.array(x, y, x + 30, y, x + 30, y + 12, x, y + 12))
    fit = L.fit_inside(F.col("p_size") * 40, F.lit(90), 1536, 128)
    return p.select("p_partkey", box.alias("b"), fit.alias("f")).select("p_partkey", "b.x1", "b.y1", "b.x2", "b.y2", F.col("f.width").alias("width"), F.col("f.height").alias("height"))


DETECTION_BOXES = """
SELECT p_partkey, trunc(p_size / 60.0::DOUBLE * 640)::INT AS x1, trunc((1 - p_size / 60.0::DOUBLE) * 480)::INT AS y1, trunc(p_size / 60.0::DOUBLE * 640)::INT + 30 AS x2, trunc((1 - p_size / 60.0::DOUBLE) * 480)::INT + 12 AS y2,
  greatest(1, trunc(p_size * 40 * least(128::DOUBLE / 90, 1536::DOUBLE / (p_size * 40)))::INT) AS width, greatest(1, trunc(90 * least(128::DOUBLE / 90, 1536::DOUBLE / (p_size * 40)))::INT) AS height FROM part"""


def skew_angles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_tax", "l_discount")
    seg = li.select("l_orderkey", F.col("l_quantity").alias("dx"), ((F.col("l_tax") - F.col("l_discount")) * 100).alias("dy"))
    out = L.skew_angle(seg, ["l_orderkey"])
    return out.select("l_orderkey", F.round("angle", 6).alias("angle"))


SKEW_ANGLES = """
WITH a AS (SELECT l_orderkey, degrees(atan2((l_tax - l_discount) * 100, l_quantity)) AS a FROM lineitem), m AS (SELECT l_orderkey, median(a) AS a FROM a WHERE abs(a) < 15 GROUP BY l_orderkey)
SELECT l_orderkey, round(CASE WHEN abs(a) < 0.5 THEN 0.0 ELSE a END, 6) AS angle FROM m"""


def page_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumnRenamed("turn", "line_no")
    return L.page_text(c, ["conv_id"], "text")


PAGE_TEXT = "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS page_text FROM conversations GROUP BY conv_id"


def confident_boxes(spark, sf_dir):
    """Boxes of a confidence of 0.5 or more."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount").withColumn("conf", F.col("l_discount") * 10)
    return L.confident(li, 0.5).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("boxes"))


CONFIDENT_BOXES = "SELECT l_orderkey, count(*) AS boxes FROM lineitem WHERE l_discount * 10 >= 0.5 GROUP BY l_orderkey"

QUERIES = {
    "log_forward_fill": (log_forward_fill, LOG_FORWARD_FILL),
    "rolling_mean": (rolling_mean, ROLLING_MEAN),
    "running_best": (running_best, RUNNING_BEST),
    "early_stop": (early_stop, EARLY_STOP),
    "asof_attach": (asof_attach, ASOF_ATTACH),
    "epoch_runtime": (epoch_runtime, EPOCH_RUNTIME),
    "restarted_epochs": (restarted_epochs, RESTARTED),
    "change_points": (change_points, CHANGE_POINTS),
    "global_epoch": (global_epoch, GLOBAL_EPOCH),
    "best_marker": (best_marker, BEST_MARKER),
    "phase_spans": (phase_spans, PHASE_SPANS),
    "parse_props": (parse_props, PARSE_PROPS),
    "training_log": (training_log, TRAINING_LOG),
    "metric_rows": (metric_rows, METRIC_ROWS),
    "confident_boxes": (confident_boxes, CONFIDENT_BOXES),
    "line_clusters": (line_clusters, LINE_CLUSTERS),
    "reading_order": (reading_order, READING_ORDER),
    "bbox_merge": (bbox_merge, BBOX_MERGE),
    "crop_boxes": (crop_boxes, CROP_BOXES),
    "detection_boxes": (detection_boxes, DETECTION_BOXES),
    "skew_angles": (skew_angles, SKEW_ANGLES),
    "page_text": (page_text, PAGE_TEXT),
}
