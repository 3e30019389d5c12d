"""Bag queries: a bag is the vectors of one label, the model's weights are fixed small numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import bags
from tesserae.plans.metrics import _P, predictions
from tesserae.plans.proxies import table
from tesserae.plans.registry import query

WIDTH, H1, H2, HIDDEN, CLASSES = 64, 6, 4, 3, 5


def _matrix(rows: int, columns: int, k: int) -> list[list[float]]:
    return [[((i * 7 + j * 3 + k * 5) % 11 - 5) / 10 for j in range(columns)] for i in range(rows)]


MODEL = {"fc1": _matrix(H1, WIDTH, 1), "fc2": _matrix(H2, H1, 2), "a": _matrix(HIDDEN, H2, 3), "b": _matrix(HIDDEN, H2, 4), "c": _matrix(2, HIDDEN, 5), "out": _matrix(CLASSES, H2 + 1, 6)}


def _sql_dense(x: str, name: str) -> str:
    rows = ", ".join("list_dot_product(%s, [%s]::DOUBLE[])" % (x, ", ".join(map(str, r))) for r in MODEL[name])
    return f"[{rows}]"


def _relu(x: str) -> str:
    return f"list_transform({x}, lambda v: greatest(v, 0.0::DOUBLE))"


_H = f"""WITH h1 AS (SELECT vec_id, label, {_relu(_sql_dense("embedding::DOUBLE[]", "fc1"))} AS h FROM embeddings),
h AS (SELECT vec_id, label, {_relu(_sql_dense("h", "fc2"))} AS h FROM h1),
g AS (SELECT *, {_sql_dense("h", "a")} AS ta, {_sql_dense("h", "b")} AS sb FROM h),
g2 AS (SELECT *, list_transform(range(1, {HIDDEN} + 1), lambda i: tanh(ta[i]) / (1 + exp(-sb[i]))) AS g, list_transform(ta, lambda v: tanh(v)) AS t FROM g),
s AS (SELECT vec_id, label, h, {_sql_dense("g", "c")} AS a, {_sql_dense("t", "c")} AS plain FROM g2)"""
_POOL = f"""{_H}, pooled AS (SELECT label, list_transform(range(1, {H2} + 1), lambda i: 0.0::DOUBLE) AS none, [{", ".join(f"sum(exp(a[1]) * h[{k}]) / sum(exp(a[1]))" for k in range(1, H2 + 1))}] AS m FROM s GROUP BY label),
x AS (SELECT label, list_append(m, (label % 2)::DOUBLE) AS x FROM pooled), z AS (SELECT label, {_sql_dense("x", "out")} AS z FROM x)"""


def encoded(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    h = bags.relu(bags.dense(bags.relu(bags.dense(F.transform("embedding", lambda v: v.cast("double")), MODEL["fc1"])), MODEL["fc2"]))
    return rows.select("vec_id", "label", h.alias("h"))


def _heads(frame, column):
    return frame.select("vec_id", *(F.round(F.get(column, F.lit(k)), 6).alias(f"a{k}") for k in range(2)))


@query("ml_03_gated_attention", f"{_H} SELECT vec_id, round(a[1], 6) AS a0, round(a[2], 6) AS a1 FROM s")
def gated(spark, sf_dir):
    return _heads(encoded(spark, sf_dir).withColumn("a", bags.gated_attention(F.col("h"), MODEL["a"], MODEL["b"], MODEL["c"])), "a")


@query("ml_03b_gated_attention_arrow", f"{_H} SELECT vec_id, round(a[1], 6) AS a0, round(a[2], 6) AS a1 FROM s")
def gated_arrow(spark, sf_dir):
    return _heads(encoded(spark, sf_dir).withColumn("a", bags.attention_by_arrow(F.col("h"), MODEL["a"], MODEL["b"], MODEL["c"])), "a")


@query("ml_04_plain_attention", f"{_H} SELECT vec_id, round(plain[1], 6) AS a0, round(plain[2], 6) AS a1 FROM s")
def plain(spark, sf_dir):
    return _heads(encoded(spark, sf_dir).withColumn("a", bags.plain_attention(F.col("h"), MODEL["a"], MODEL["c"])), "a")


@query(
    "ml_05_mil_forward",
    f"""{_POOL} SELECT label, list_position(z, list_max(z))::INT - 1 AS predicted, {", ".join(f"round(z[{k + 1}], 6) AS z{k}" for k in range(CLASSES))},
  {", ".join(f"round(exp(z[{k + 1}] - list_max(z)) / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))), 6) AS p{k}" for k in range(CLASSES))} FROM z""",
)
def mil_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    extra = rows.select("label").distinct().withColumn("extra", F.col("label") % 2)
    found = bags.mil_forward(rows, "label", "embedding", extra, MODEL)
    return found.select("label", "predicted", *(F.round(F.get("logits", F.lit(k)), 6).alias(f"z{k}") for k in range(CLASSES)), *(F.round(F.get("probs", F.lit(k)), 6).alias(f"p{k}") for k in range(CLASSES)))


@query("ml_07_attention_weights", f"{_H} SELECT vec_id, label, round(exp(a[1]) / sum(exp(a[1])) OVER (PARTITION BY label), 9) AS weight FROM s")
def attention_weights(spark, sf_dir):
    scored = encoded(spark, sf_dir).withColumn("a", F.get(bags.gated_attention(F.col("h"), MODEL["a"], MODEL["b"], MODEL["c"]), F.lit(0)))
    return bags.weights_in_bag(scored, "label", "a").select("vec_id", "label", F.round("weight", 9).alias("weight"))


@query("ml_09_multi_branch", f"""{_H} SELECT label, k AS branch, round(sum(exp(a[k + 1]) * h[1]) / sum(exp(a[k + 1])), 6) AS m0, round(sum(exp(a[k + 1]) * h[2]) / sum(exp(a[k + 1])), 6) AS m1
FROM s, (VALUES (0), (1)) b(k) GROUP BY label, k""")
def multi_branch(spark, sf_dir):
    """An attention of its own for every branch."""
    scored = encoded(spark, sf_dir).withColumn("a", bags.gated_attention(F.col("h"), MODEL["a"], MODEL["b"], MODEL["c"]))
    pooled = [bags.pool(scored, "label", "h", F.get("a", F.lit(k)), 2).withColumn("branch", F.lit(k)) for k in range(2)]
    return pooled[0].unionByName(pooled[1]).select("label", "branch", *(F.round(F.get("pooled", F.lit(k)), 6).alias(f"m{k}") for k in range(2)))


_TOP = """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS lo FROM events)
SELECT user_id, event_id, value, hi::INT AS k, 1 AS sign FROM r WHERE hi <= 8 UNION ALL SELECT user_id, event_id, value, lo::INT, 0 FROM r WHERE lo <= 8"""


@query("top_06_top_instances", _TOP)
def top_instances(spark, sf_dir):
    return bags.top_instances(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id", 8)


@query("ml_10_instance_loss", f"""WITH t AS ({_TOP}), l AS (SELECT user_id, sign, 1 / (1 + exp(-(value - 50) / 50)) AS p FROM t)
SELECT user_id, round(avg(-ln(CASE sign WHEN 1 THEN p ELSE 1 - p END)), 6) AS loss FROM l GROUP BY user_id""")
def instance_loss(spark, sf_dir):
    """The ends of each bag as pseudo-labels, scored by a logistic instance classifier."""
    p = bags.sigmoid((F.col("value") - 50) / 50)
    rows = top_instances(spark, sf_dir).select("user_id", F.when(F.col("sign") == 1, p).otherwise(1 - p).alias("p"))
    return rows.groupBy("user_id").agg(F.round(F.avg(-F.log("p")), 6).alias("loss"))


@query("ml_11_max_pool", f"{_P}, v AS (SELECT vec_id, label, max(p) AS v FROM p GROUP BY ALL) SELECT label, arg_max(vec_id, struct_pack(a := v, b := -vec_id)) AS vec_id, round(max(v), 6) AS value FROM v GROUP BY label")
def max_pool(spark, sf_dir):
    found = bags.best_instance(predictions(spark, sf_dir), "label", "probs", "vec_id")
    return found.select("label", "vec_id", F.round("value", 6).alias("value"))


@query("ml_11b_max_pool_binary", f"{_P} SELECT label, arg_max(vec_id, struct_pack(a := p, b := -vec_id)) AS vec_id, round(max(p), 6) AS value FROM p WHERE class = 1 GROUP BY label")
def max_pool_binary(spark, sf_dir):
    found = bags.best_instance(predictions(spark, sf_dir), "label", "probs", "vec_id", 1)
    return found.select("label", "vec_id", F.round("value", 6).alias("value"))


@query("ml_13_weighted_loss", f"{_P} SELECT label, round(0.7::DOUBLE * avg(-ln(p)) + 0.3::DOUBLE * avg(1 - p), 6) AS loss FROM p WHERE label = class GROUP BY label")
def weighted_loss(spark, sf_dir):
    own = F.get("probs", F.col("label"))
    rows = predictions(spark, sf_dir).groupBy("label").agg(F.avg(-F.log(own)).alias("bag"), F.avg(1 - own).alias("instance"))
    return rows.select("label", F.round(bags.bag_loss(F.col("bag"), F.col("instance"), 0.7), 6).alias("loss"))
