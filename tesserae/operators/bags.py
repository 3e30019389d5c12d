"""Models over bags of tile vectors: dense layers, attention, pooling, instance losses.

Small layers are array expressions; wide ones go through one Arrow function per tile. Pooling is
always a sum per bag, combined before the shuffle, so a bag of any size needs no task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

Matrix = list[list[float]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _row(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dense(x: Column, weights: Matrix, bias: list[float] | None = None) -> Column:
    """One output per row of ``weights``."""
    bias = bias or [0.0] * len(weights)
    return F.array(*(dot(x, _row(w)) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gated_attention(h: Column, a: Matrix, b: Matrix, c: Matrix) -> Column:
    """A score per head: c (tanh(a h) * sigmoid(b h))."""
    gate = F.zip_with(F.transform(dense(h, a), lambda v: F.tanh(v)), F.transform(dense(h, b), sigmoid), lambda x, y: x * y)
    return dense(gate, c)


def plain_attention(h: Column, a: Matrix, c: Matrix) -> Column:
    return dense(F.transform(dense(h, a), lambda v: F.tanh(v)), c)


def attention_by_arrow(h: Column, a: Matrix, b: Matrix, c: Matrix) -> Column:
    """``gated_attention`` for wide layers, a batch at a time."""
    wa, wb, wc = (np.array(m) for m in (a, b, c))

    @arrow_udf("array<double>")
    def scores(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.float64()))
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
        found = (np.tanh(x @ wa.T) / (1 + np.exp(-(x @ wb.T)))) @ wc.T
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))

    return scores(h)


def pool(tiles: DataFrame, bag: str, h: str, score: Column, width: int) -> DataFrame:
    """(bag, pooled): the softmax-weighted mean of ``h``, weights by ``score`` within the bag.

    Attention scores are sums of bounded terms, so exp is taken as it is; all sums of a bag are
    combined before the shuffle."""
    rows = tiles.select(F.col(bag), F.col(h).alias("h"), F.exp(score).alias("e"))
    sums = rows.groupBy(bag).agg(F.sum("e").alias("total"), *(F.sum(F.col("e") * F.get("h", F.lit(k))).alias(f"s{k}") for k in range(width)))
    return sums.select(bag, F.array(*(F.col(f"s{k}") / F.col("total") for k in range(width))).alias("pooled"))


def weights_in_bag(tiles: DataFrame, bag: str, score: str, out: str = "weight") -> DataFrame:
    """``tiles`` with the softmax of ``score`` within the bag."""
    most = tiles.groupBy(bag).agg(F.max(score).alias("most"))
    raised = tiles.join(most, bag).withColumn("e", F.exp(F.col(score) - F.col("most")))
    total = raised.groupBy(bag).agg(F.sum("e").alias("total"))
    return raised.join(total, bag).withColumn(out, F.col("e") / F.col("total")).drop("most", "e", "total")


def mil_forward(tiles: DataFrame, bag: str, vector: str, extra: DataFrame, model: dict, by_arrow: bool = False) -> DataFrame:
    """(bag, logits, probs, predicted): two rectified layers, gated attention of two heads, the first
    head's pooled vector and the bag's extra number through a linear classifier."""
    from tesserae.operators.metrics import argmax, softmax

    h = relu(dense(relu(dense(F.transform(vector, lambda v: v.cast("double")), model["fc1"])), model["fc2"]))
    encoded = tiles.select(F.col(bag), h.alias("h"))
    scorer = attention_by_arrow if by_arrow else gated_attention
    scored = encoded.withColumn("a", scorer(F.col("h"), model["a"], model["b"], model["c"]))
    pooled = pool(scored, bag, "h", F.get("a", F.lit(0)), len(model["fc2"])).join(extra, bag)
    logits = dense(F.concat("pooled", F.array(F.col("extra").cast("double"))), model["out"])
    return pooled.select(bag, logits.alias("logits")).withColumn("probs", softmax(F.col("logits"))).withColumn("predicted", argmax(F.col("logits")))


def second_head(tiles: DataFrame, bag: str, vector: str, model: dict, out: Matrix) -> DataFrame:
    """(bag, logits): the second head's pooled vector through a classifier of its own, for a second task."""
    h = relu(dense(relu(dense(F.transform(vector, lambda v: v.cast("double")), model["fc1"])), model["fc2"]))
    scored = tiles.select(F.col(bag), h.alias("h")).withColumn("a", gated_attention(F.col("h"), model["a"], model["b"], model["c"]))
    return pool(scored, bag, "h", F.get("a", F.lit(1)), len(model["fc2"])).select(bag, dense(F.col("pooled"), out).alias("logits"))


def top_instances(tiles: DataFrame, bag: str, score: str, tie: str, k: int) -> DataFrame:
    """The k highest (sign 1) and k lowest (sign 0) of each bag. A bag's rows are first cut to
    those of their slice of the bag, so none is sorted whole in one task."""
    sliced = tiles.withColumn("slice", F.pmod(F.xxhash64(tie), F.lit(64)))

    def ends(descending: bool) -> DataFrame:
        order = [F.col(score).desc() if descending else F.col(score), F.col(tie)]
        first = sliced.withColumn("k", F.row_number().over(Window.partitionBy(bag, "slice").orderBy(*order))).where(F.col("k") <= k)
        return first.withColumn("k", F.row_number().over(Window.partitionBy(bag).orderBy(*order))).where(F.col("k") <= k).drop("slice").withColumn("sign", F.lit(int(descending)))

    return ends(True).unionByName(ends(False))


def best_instance(tiles: DataFrame, bag: str, probs: str, tie: str, column: int | None = None) -> DataFrame:
    """Max pooling: per bag the tile with the highest probability of ``column``, or of any class."""
    value = F.get(probs, F.lit(column)) if column is not None else F.array_max(probs)
    rows = tiles.select(F.col(bag), F.col(tie), F.col(probs).alias("probs"), value.alias("value"))
    return rows.groupBy(bag).agg(F.max(F.struct("value", (-F.col(tie)).alias("minus"), "probs")).alias("best")).select(bag, (-F.col("best.minus")).alias(tie), F.col("best.value").alias("value"), F.col("best.probs").alias("probs"))


def bag_loss(bag: Column, instance: Column, share: float) -> Column:
    """The bag's and the instances' losses, weighted."""
    return share * bag + (1 - share) * instance


def xavier(rows: int, columns: int, seed: int) -> np.ndarray:
    """Normal weights of variance 2 / (rows + columns)."""
    return np.random.default_rng(seed).normal(0, np.sqrt(2 / (rows + columns)), (rows, columns))
