"""Metric queries: classes are scored by the softmax of the first ten dimensions of a vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import metrics
from tesserae.plans.proxies import table
from tesserae.plans.registry import query

N = 10
_P = f"""WITH z AS (SELECT vec_id, label, unnest(range(0, {N}))::INT AS class, unnest(embedding[1:{N}])::DOUBLE AS z FROM embeddings),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
p AS (SELECT vec_id, label, class, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM e),
best AS (SELECT vec_id, any_value(label) AS label, arg_min(class, struct_pack(a := -p, b := class)) AS predicted FROM p GROUP BY vec_id)"""


def predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, N), lambda x: x.cast("double"))
    probs = F.transform(metrics.softmax(logits), lambda p: F.round(p, 9))
    return rows.select("vec_id", "label", probs.alias("probs")).withColumn("predicted", metrics.argmax(F.col("probs")))


def _auc_sql(rows: str, groups: str) -> str:
    by = f"PARTITION BY {groups} " if groups else ""
    over, lead = (f"PARTITION BY {groups}" if groups else ""), (f"{groups}, " if groups else "")
    return f"""{_P}, rows AS ({rows}), r AS (
  SELECT *, rank() OVER ({by}ORDER BY p) + (count(*) OVER (PARTITION BY {lead}p) - 1) / 2.0::DOUBLE AS r FROM rows
), a AS (SELECT {lead}sum(r) FILTER (pos) AS s, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM r {f"GROUP BY {groups}" if groups else ""})"""


_BY_CLASS = _auc_sql("SELECT class, p, label = class AS pos FROM p", "class")
_VALUE = "CASE WHEN np > 0 AND nn > 0 THEN (s - np * (np + 1) / 2.0::DOUBLE) / (np * nn) END"


@query("top_07_argmax", f"{_P} SELECT vec_id, label, predicted FROM best")
def predicted(spark, sf_dir):
    return predictions(spark, sf_dir).select("vec_id", "label", "predicted")


@query("win_09_softmax", f"{_P} SELECT vec_id, class, round(p, 6) AS p FROM p")
def softmax(spark, sf_dir):
    return predictions(spark, sf_dir).select("vec_id", F.posexplode("probs").alias("class", "p")).withColumn("p", F.round("p", 6))


@query("agg_12_error", f"{_P} SELECT round(1 - avg((label = predicted)::INT), 9) AS error FROM best")
def error(spark, sf_dir):
    return metrics.error_rate(predictions(spark, sf_dir), "label", "predicted").select(F.round("error", 9).alias("error"))


@query("agg_13_class_accuracy", f"{_P} SELECT label, count(*) AS n, count(*) FILTER (label = predicted) AS correct, round(avg((label = predicted)::INT), 9) AS accuracy FROM best GROUP BY label")
def class_accuracy(spark, sf_dir):
    return metrics.class_accuracy(predictions(spark, sf_dir), "label", "predicted").withColumn("accuracy", F.round("accuracy", 9))


@query("agg_14_auc_ovr", f"{_BY_CLASS} SELECT class, round({_VALUE}, 9) AS auc FROM a")
def auc_ovr(spark, sf_dir):
    return metrics.class_auc(predictions(spark, sf_dir), "probs", "label").withColumn("auc", F.round("auc", 9))


@query("agg_14b_auc_macro", f"{_BY_CLASS} SELECT round(avg({_VALUE}), 9) AS auc FROM a")
def auc_macro(spark, sf_dir):
    return metrics.macro_auc(predictions(spark, sf_dir), "probs", "label").select(F.round("auc", 9).alias("auc"))


@query("agg_15_auc_binary", _auc_sql("SELECT value AS p, event_type = 'error' AS pos FROM events", "") + f" SELECT round({_VALUE}, 9) AS auc FROM a")
def auc_binary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return metrics.auc(events.select(F.col("value").alias("score"), (F.col("event_type") == "error").alias("positive")), []).select(F.round("auc", 9).alias("auc"))


@query("agg_16_auc_micro", _auc_sql("SELECT p, label = class AS pos FROM p WHERE class IN (SELECT label FROM embeddings)", "") + f" SELECT round({_VALUE}, 9) AS auc FROM a")
def auc_micro(spark, sf_dir):
    return metrics.micro_auc(predictions(spark, sf_dir), "probs", "label").select(F.round("auc", 9).alias("auc"))


@query("agg_17_auc_strict", f"{_BY_CLASS} SELECT round(avg({_VALUE}), 9) AS auc FROM a")
def auc_strict(spark, sf_dir):
    return metrics.macro_auc(predictions(spark, sf_dir), "probs", "label", strict=True).select(F.round("auc", 9).alias("auc"))


@query("agg_18_auc_single_class", "SELECT -1.0::DOUBLE AS auc")
def auc_single(spark, sf_dir):
    """All rows under one label: the sentinel."""
    return metrics.macro_auc(predictions(spark, sf_dir).withColumn("label", F.lit(3)), "probs", "label")


@query(
    "agg_19_topk_accuracy",
    f"""{_P}, k AS (SELECT vec_id, label, class, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS k FROM p), h AS (SELECT k FROM k WHERE label = class)
SELECT round(avg((k <= 1)::INT), 9) AS top1, round(avg((k <= 3)::INT), 9) AS top3, round(avg((k <= 5)::INT), 9) AS top5 FROM h""",
)
def topk(spark, sf_dir):
    found = metrics.topk_accuracy(predictions(spark, sf_dir), "probs", "label")
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query("ml_12_cross_entropy", f"{_P} SELECT vec_id, round(-ln(p), 6) AS loss FROM p WHERE label = class")
def cross_entropy(spark, sf_dir):
    return predictions(spark, sf_dir).select("vec_id", F.round(metrics.cross_entropy(F.col("probs"), F.col("label")), 6).alias("loss"))


@query("agg_20_mean_loss", f"{_P} SELECT label, round(avg(-ln(p)), 6) AS loss FROM p WHERE label = class GROUP BY label")
def mean_loss(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("label", metrics.cross_entropy(F.col("probs"), F.col("label")).alias("loss"))
    return rows.groupBy("label").agg(F.round(F.avg("loss"), 6).alias("loss"))


@query("top_08_sorted_probabilities", f"{_P} SELECT vec_id, string_agg(class, ',' ORDER BY p DESC, class) AS classes FROM p GROUP BY vec_id")
def sorted_probabilities(spark, sf_dir):
    pairs = F.sort_array(F.transform("probs", lambda p, k: F.struct((-p).alias("a"), k.alias("k"))))
    return predictions(spark, sf_dir).select("vec_id", F.array_join(F.transform(pairs, lambda x: x["k"]), ",").alias("classes"))


@query(
    "win_01_percentile_rank",
    """SELECT event_id, user_id, round((rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE)
  / count(*) OVER (PARTITION BY user_id) * 100, 6) AS percentile FROM events""",
)
def percentile_rank(spark, sf_dir):
    found = metrics.percentile_rank(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "value")
    return found.select("event_id", "user_id", F.round("percentile", 6).alias("percentile"))


@query(
    "win_02_percentile_against",
    """WITH q AS (SELECT DISTINCT value FROM events WHERE event_type = 'click'), c AS (
  SELECT value, (SELECT count(*) FROM events r WHERE r.event_type = 'view' AND r.value < q.value) AS lt, (SELECT count(*) FROM events r WHERE r.event_type = 'view' AND r.value <= q.value) AS le FROM q
) SELECT value, round((lt + le + (lt < le)::INT) * 50.0::DOUBLE / (SELECT count(*) FROM events WHERE event_type = 'view'), 6) AS percentile FROM c""",
)
def percentile_against(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = metrics.percentile_against(events.where("event_type = 'click'"), events.where("event_type = 'view'"), "value")
    return found.select("value", F.round("percentile", 6).alias("percentile"))
