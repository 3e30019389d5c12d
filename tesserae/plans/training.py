"""Training queries: bags are the vectors of one label or of a share of the ids, with the fixed model of the bag queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import training
from tesserae.plans.bags import _POOL, CLASSES, MODEL
from tesserae.plans.proxies import table
from tesserae.plans.registry import query

#: Probabilities of each bag (a label of the table) and the class that it counts as.
_BAGS = f"""{_POOL}, e AS (SELECT label AS bag, label % {CLASSES} AS y, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z),
b AS (SELECT bag, y::INT AS label, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e),
j AS (SELECT *, -ln(p[label + 1]) AS loss, list_position(p, list_max(p))::INT - 1 AS predicted FROM b)"""


def weights() -> training.Weights:
    """The fixed model, its first attention head, without biases."""
    found = {k: np.array(v[:1] if k == "c" else v, float) for k, v in MODEL.items()}
    return found | {f"{k}_bias": np.zeros(len(v)) for k, v in found.items()}


def tiles(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("bag"), F.col("embedding").alias("vector"))


def bags(spark, sf_dir):
    return tiles(spark, sf_dir).select("bag").distinct().select("bag", (F.col("bag") % CLASSES).alias("label"), (F.col("bag") % 2).alias("extra"), F.when(F.col("bag") % 2 == 0, "val").otherwise("test").alias("split"))


@query("ml_15_train_history")
def train_history(spark, sf_dir):
    """(epoch, loss, val_loss, val_error) of a fold of 24 bags, three epochs."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 24).alias("bag"), F.col("embedding").alias("vector"))
    known = spark.range(24).select(F.col("id").alias("bag"), (F.col("id") % 3).alias("label"), (F.col("id") % 2).alias("extra"), F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"))
    found = training.train_fold(rows, known, training.new_model(64, 6, 4, 3, 3), epochs=3, per_step=9, optimiser=training.Optimiser(rate=0.01))
    return spark.createDataFrame([(e, *(round(float(x), 6) for x in r)) for e, *r in found.history], "epoch int, loss double, val_loss double, val_error double")


@query("ml_16_step_gradient", f"""{_BAGS} SELECT k::INT AS class, round(avg(p[k + 1] - (label = k)::INT), 6) AS gradient FROM j, range({CLASSES}) r(k) GROUP BY k""")
def step_gradient(spark, sf_dir):
    """What a step over all bags changes in the classifier's biases."""
    found, _ = training.gradients(tiles(spark, sf_dir), bags(spark, sf_dir), weights())
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(found["out_bias"])], "class int, gradient double")


@query("ml_17_validate", f"""{_BAGS}, k AS (SELECT k, label = k AS pos, p[k + 1] AS s FROM j, range({CLASSES}) r(k)),
a AS (SELECT k, sum(CASE WHEN x.s > y.s THEN 1.0 WHEN x.s = y.s THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) AS auc FROM k x JOIN k y USING (k) WHERE x.pos AND NOT y.pos GROUP BY k)
SELECT count(*) AS n, round(avg(loss), 6) AS loss, round(1 - avg((predicted = label)::INT), 6) AS error, (SELECT round(avg(auc), 6) FROM a) AS auc FROM j""")
def validate(spark, sf_dir):
    found = training.validate(training.predict(tiles(spark, sf_dir), bags(spark, sf_dir), weights()))
    return found.select("n", *(F.round(x, 6).alias(x) for x in ("loss", "error", "auc")))


@query("ml_18_summary", f"""{_BAGS} SELECT CASE bag % 2 WHEN 0 THEN 'val' ELSE 'test' END AS split, count(*) AS n, round(avg(loss), 6) AS loss, round(1 - avg((predicted = label)::INT), 6) AS error FROM j GROUP BY 1""")
def summary(spark, sf_dir):
    return training.summary(tiles(spark, sf_dir), bags(spark, sf_dir), weights())[1].select("split", "n", F.round("loss", 6).alias("loss"), F.round("error", 6).alias("error"))


@query("ml_20_infer", f"""{_BAGS} SELECT bag, 'class ' || predicted AS predicted, round(list_max(p), 6) AS best, round(list_min(p), 6) AS least FROM j""")
def infer(spark, sf_dir):
    """The payload of every bag, read back."""
    found = training.infer(tiles(spark, sf_dir), bags(spark, sf_dir), weights(), [f"class {k}" for k in range(CLASSES)])
    read = found.select("bag", F.from_json("payload", "predicted string, ranked array<struct<class int, name string, probability double>>").alias("p"))
    last = F.size("p.ranked") - 1
    return read.select("bag", "p.predicted", F.round(F.get("p.ranked", F.lit(0))["probability"], 6).alias("best"), F.round(F.get("p.ranked", last)["probability"], 6).alias("least"))


@query("job_06_folds")
def folds(spark, sf_dir):
    """(fold, split, n, loss, error): splits drawn, models trained and judged, two folds."""
    from tesserae.operators.splits import stratified_split

    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("bag"), F.col("embedding").alias("vector"))
    slides = spark.range(40).select(F.col("id").alias("bag"), (F.col("id") % 2).alias("label"), F.lit(0.0).alias("extra"))
    split = stratified_split(slides.select(F.col("bag").alias("case_id"), "label"), 2, 1).select("fold", F.col("case_id").alias("bag"), "split")
    found = training.run_folds(rows, slides, split, 2, (6, 4, 3), 2, epochs=1, per_step=40)
    return found.select("fold", "split", "n", F.round("loss", 6).alias("loss"), F.round("error", 6).alias("error"))
