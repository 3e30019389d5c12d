"""History, log, function and sink-shape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import jobs
from tesserae.plans.metrics import _P, predictions
from tesserae.plans.proxies import table
from tesserae.plans.registry import query

_HISTORY = """WITH h AS (SELECT event_type AS run, epoch_ms(min(date_trunc('hour', ts))) AS t0, date_trunc('hour', ts) AS hour, round(avg(value), 0) AS loss FROM events GROUP BY event_type, date_trunc('hour', ts)),
e AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY hour)::INT AS epoch, loss FROM h),
b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
i AS (SELECT *, before IS NULL OR loss <= before AS improved, least(loss, coalesce(before, loss)) AS best FROM b),
w AS (SELECT *, epoch - max(epoch) FILTER (improved) OVER (PARTITION BY run ORDER BY epoch) AS waited FROM i),
s AS (SELECT *, waited >= 20 AND epoch > 50 AS stop FROM w)"""


def _history(spark, sf_dir):
    from pyspark.sql import Window

    hourly = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg("value"), 0).alias("loss"))
    return hourly.select("run", F.row_number().over(Window.partitionBy("run").orderBy("hour")).alias("epoch"), "loss")


@query("win_03_early_stopping", f"{_HISTORY} SELECT run, epoch, loss, best, improved, waited::INT AS waited, stop, (min(epoch) FILTER (stop) OVER (PARTITION BY run))::INT AS stopped_at FROM s")
def early_stopping(spark, sf_dir):
    return jobs.early_stopping(_history(spark, sf_dir), "run", "epoch", "loss")


@query("src_27_latest_status", "SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_status(spark, sf_dir):
    return jobs.latest(table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"), "value"), "user_id", "event_id", "status", "value")


@query("agg_24_stage_means", "SELECT event_type AS stage, round(sum(CASE WHEN value > 300 THEN 0 ELSE value END) / count(*), 6) AS mean_seconds FROM events GROUP BY event_type")
def stage_means(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.when(F.col("value") > 300, -1.0).otherwise(F.col("value")).alias("seconds"))
    return jobs.stage_means(log, "stage", "seconds").withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("agg_25_parameter_counts", "SELECT label, sum(len(embedding))::BIGINT AS total, sum(CASE WHEN vec_id % 2 = 0 THEN len(embedding) ELSE 0 END)::BIGINT AS trainable FROM embeddings GROUP BY label")
def parameter_counts(spark, sf_dir):
    """Vectors as layers: every other one is trainable."""
    size = F.size("embedding").cast("long")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sum(size).alias("total"), F.sum(F.when(F.col("vec_id") % 2 == 0, size).otherwise(0)).alias("trainable"))


@query("agg_27_fold_summary", f"{_P} SELECT (best.vec_id % 5)::INT AS folds, round(avg((label = predicted)::INT), 9) AS test_acc, count(*) AS n FROM best GROUP BY best.vec_id % 5")
def fold_summary(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy((F.col("vec_id") % 5).cast("int").alias("folds")).agg(F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 9).alias("test_acc"), F.count(F.lit(1)).alias("n"))


@query("job_07_fold_range", f"{_P} SELECT vec_id, (vec_id % 5)::INT AS fold FROM best WHERE vec_id % 5 BETWEEN 1 AND 3")
def fold_range(spark, sf_dir):
    """A range of folds, folds being a column."""
    return predictions(spark, sf_dir).select("vec_id", (F.col("vec_id") % 5).cast("int").alias("fold")).where(F.col("fold").between(1, 3))


_MARKERS = {"signup": "thumbnail", "click": "preprocessing", "purchase": "inference"}
_STEPS = ["thumbnail", "preprocessing", "inference"]


@query(
    "job_09_step_states",
    """WITH m AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS lvl, event_type = 'error' AS failed FROM events WHERE value > 200),
s AS (SELECT user_id, max(lvl) AS lvl, bool_or(failed) AS failed FROM m GROUP BY user_id)
SELECT user_id, step, CASE WHEN k < lvl THEN 'done' WHEN k = lvl THEN CASE WHEN failed THEN 'error' ELSE 'running' END ELSE 'pending' END AS state
FROM s, (VALUES (0, 'thumbnail'), (1, 'preprocessing'), (2, 'inference')) t(k, step)""",
)
def step_states(spark, sf_dir):
    """FN-02 and FN-17: slow events stand for the lines of a job's log."""
    log = table(spark, sf_dir, "events").where("value > 200").select("user_id", "event_id", F.concat(F.lit("Starting "), F.initcap("event_type")).alias("line"))
    return jobs.step_states(log, "user_id", "event_id", "line", _MARKERS, _STEPS)


@query("fn_01_sha1_prefix", "SELECT page_id, substr(sha1(url), 1, 8) AS hash FROM pages")
def sha1_prefix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sha1_prefix(F.col("url"), 8).alias("hash"))


@query("src_03_path_keys", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, split_part(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/', 1) AS first, substr(sha1(regexp_replace(url, '^[a-z]+://[^/]*/', '')), 1, 8) AS hash FROM pages")
def path_keys(spark, sf_dir):
    rel = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.split_part(rel, F.lit("/"), F.lit(1)).alias("first"), text.sha1_prefix(rel, 8).alias("hash"))


@query("src_12_safe_casts", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT > 50 THEN json_extract_string(props, '$.k')::INT - 50 ELSE 800 END AS size FROM events")
def safe_casts(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int") - 50
    return table(spark, sf_dir, "events").select("event_id", text.positive_or(k.cast("string"), 800).alias("size"))


@query("src_15_backend", "SELECT p_partkey AS slide_id, CASE p_partkey % 3 WHEN 0 THEN 'pyramid' ELSE 'tiff' END AS backend FROM part")
def backend(spark, sf_dir):
    names = F.array(*map(F.lit, ("a/b.SVS", "a.b.tif", "c.BTF")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), text.backend(F.get(names, (F.col("p_partkey") % 3).cast("int"))).alias("backend"))


@query("fn_04_formats", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(l_discount * 100, 0)::INT || '.00%' AS share, s // 3600 || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT *, floor(l_extendedprice)::BIGINT AS s FROM lineitem)")
def formats(spark, sf_dir):
    """FN-05 as well."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", text.percent(F.col("l_discount")).alias("share"), text.clock(F.col("l_extendedprice")).alias("clock"))


@query("fn_06_stamps", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM orders")
def stamps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("stamp"))


@query(
    "fn_07_numbers",
    """SELECT c_custkey, round_even(c_acctbal / 2, 0)::BIGINT AS even, trunc(c_acctbal / 3)::BIGINT AS cut, floor(c_acctbal / 7)::BIGINT AS floor_div, ceil(c_acctbal * 0.3::DOUBLE)::BIGINT AS up,
  least(greatest(c_acctbal, 0), 5000) AS clipped FROM customer""",
)
def numbers(spark, sf_dir):
    """FN-07 to FN-09 and FN-18."""
    v = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.bround(v / 2).cast("long").alias("even"), (v / 3).cast("long").alias("cut"), text.floor_div(v, F.lit(7)).alias("floor_div"), F.ceil(v * 0.3).alias("up"),
        F.least(F.greatest(v, F.lit(0.0)), F.lit(5000.0)).alias("clipped"),
    )


@query("fn_10_json", """SELECT event_id, '{"type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS line, json_extract_string(props, '$.k')::INT AS k FROM events""")
def json_lines(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("line"), k.alias("k"))


@query("fn_11_arrays", "SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS at, len(list_filter(embedding, lambda x: x > 0)) AS n_positive FROM embeddings")
def arrays(spark, sf_dir):
    at = (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", at.alias("at"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("n_positive"))


@query("fn_12_names", "SELECT vec_id, CASE label WHEN 0 THEN 'Adrenal' WHEN 1 THEN 'Bladder' WHEN 2 THEN 'Breast' ELSE 'class_' || label END AS name FROM embeddings")
def names(spark, sf_dir):
    known = F.create_map(*(x for k, v in enumerate(("Adrenal", "Bladder", "Breast")) for x in (F.lit(k), F.lit(v))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(F.try_element_at(known, F.col("label")), F.concat(F.lit("class_"), F.col("label").cast("string"))).alias("name"))


@query("fn_13_normalised", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE)), 6) AS total FROM embeddings")
def normalised(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: (x.cast("double") / 255.0 - 0.485) / 0.229)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("fn_22_collated_bags", "SELECT label, count(*) AS n_tiles, sum(len(embedding))::BIGINT AS n_values, string_agg(vec_id, ',' ORDER BY vec_id) AS tiles FROM embeddings GROUP BY label")
def collated_bags(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").groupBy("label")
    return rows.agg(F.count(F.lit(1)).alias("n_tiles"), F.sum(F.size("embedding").cast("long")).alias("n_values"), F.array_join(F.sort_array(F.collect_list("vec_id")), ",").alias("tiles"))


@query("src_25_metadata_json", """SELECT p_partkey AS slide_id, '{"slide":"' || p_name || '","mpp_x":' || CASE WHEN p_size % 7 = 0 THEN 'null' ELSE '0.25' END || ',"levels":' || p_size || '}' AS json FROM part""")
def metadata_json(spark, sf_dir):
    fields = F.struct(F.col("p_name").alias("slide"), F.when(F.col("p_size") % 7 != 0, 0.25).alias("mpp_x"), F.col("p_size").alias("levels"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


@query("src_30_summary_names", "SELECT c_custkey, CASE WHEN 5 + c_nationkey <> 10 THEN 'summary_partial_' || 0 || '_' || (5 + c_nationkey) || '.csv' ELSE 'summary.csv' END AS name FROM customer")
def summary_names(spark, sf_dir):
    last = F.col("c_nationkey") + 5
    return table(spark, sf_dir, "customer").select("c_custkey", text.summary_name(F.lit(0), last, F.lit(10)).alias("name"))


@query("src_32_scalar_log", "SELECT 'run-1' AS run, event_type AS tag, round(avg(value), 6) AS value, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts))::INT AS step FROM events GROUP BY event_type, date_trunc('day', ts)")
def scalar_log(spark, sf_dir):
    step = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").groupBy(F.lit("run-1").alias("run"), F.col("event_type").alias("tag"), step.alias("step")).agg(F.round(F.avg("value"), 6).alias("value"))


@query("src_33_inference_payload", f"{_P} SELECT vec_id, any_value(best.predicted) AS pred_index, round(max(p), 6) AS top FROM p JOIN best USING (vec_id) GROUP BY vec_id")
def inference_payload(spark, sf_dir):
    """What a reader gets back out of the JSON payload."""
    payload = F.to_json(F.struct(F.col("predicted").alias("pred_index"), F.col("probs")))
    back = F.from_json(payload, "pred_index int, probs array<double>")
    return predictions(spark, sf_dir).select("vec_id", back.alias("b")).select("vec_id", "b.pred_index", F.round(F.array_max("b.probs"), 6).alias("top"))


@query("src_35_last_json_line", """SELECT user_id, json_extract_string(arg_max(props, event_id), '$.k')::INT AS k FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def last_json_line(spark, sf_dir):
    """The last line of a log that looks like a JSON object; errors are plain text."""
    line = F.when(F.col("event_type") == "error", F.lit("failed: {")).otherwise(F.col("props"))
    found = table(spark, sf_dir, "events").withColumn("line", text.json_object(line)).where("line IS NOT NULL")
    return found.groupBy("user_id").agg(F.max_by("line", "event_id").alias("line")).select("user_id", F.from_json("line", "k int")["k"].alias("k"))


@query("src_37_width_check", "SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64")
def width_check(spark, sf_dir):
    """Fails when it runs if a vector has another width."""
    checked = F.when(F.size("embedding") == 64, 1).otherwise(F.raise_error(F.lit("a vector has another width")).cast("int"))
    return table(spark, sf_dir, "embeddings").agg(F.sum(checked).cast("long").alias("n"))
