"""Metrics of predictions: AUC, top-k accuracy, per-class accuracy, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.numbering import running


def softmax(logits: Column) -> Column:
    """Probabilities of an array of scores."""
    most = F.array_max(logits)
    raised = F.transform(logits, lambda z: F.exp(z - most))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda s, x: s + x))


def argmax(values: Column) -> Column:
    """Index of the largest; the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rank_of(values: Column, index: Column) -> Column:
    """How many classes come before ``index`` by value, the lower index first of equals."""
    own = F.get(values, index)
    ahead = F.transform(values, lambda v, k: ((v > own) | ((v == own) & (k < index))).cast("int"))
    return F.aggregate(ahead, F.lit(0), lambda s, x: s + x)


def auc(scores: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, auc) of (groups, score, positive): the share of pairs of a positive and a negative
    in which the positive scores higher, half for ties; null where one kind is absent.

    Equal scores are counted first, so the running sum goes over distinct scores."""
    pos = F.col("positive").cast("long")
    counted = scores.groupBy(*groups, "score").agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    summed = running(counted, groups, "score", {"upto": "n"})
    # A positive beats the negatives below its score and half of those at it.
    won = F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2))
    total = F.sum("p") * F.sum("n")
    found = summed.groupBy(*groups) if groups else summed.groupBy()
    return found.agg(F.when(total > 0, won / total).alias("auc"))


def by_class(predictions: DataFrame, probs: str, label: str) -> DataFrame:
    """(class, score, positive) of every row and class."""
    return predictions.select(F.col(label).alias("label"), F.posexplode(probs).alias("class", "score")).select("class", "score", (F.col("label") == F.col("class")).alias("positive"))


def class_auc(predictions: DataFrame, probs: str, label: str) -> DataFrame:
    return auc(by_class(predictions, probs, label), ["class"])


def macro_auc(predictions: DataFrame, probs: str, label: str, strict: bool = False) -> DataFrame:
    """One row: the mean over classes that have an AUC; ``strict`` fails if one has none. With a
    single label in all rows the value is -1."""
    each = class_auc(predictions, probs, label)
    mean = F.avg("auc")
    if strict:
        mean = F.when(F.count("auc") < F.count(F.lit(1)), F.raise_error(F.lit("a class has no rows")).cast("double")).otherwise(mean)
    kinds = predictions.agg(F.count_distinct(label)).scalar()
    return each.agg(mean.alias("auc")).select(F.when(kinds == 1, F.lit(-1.0)).otherwise(F.col("auc")).alias("auc"))


def micro_auc(predictions: DataFrame, probs: str, label: str, keep_absent: bool = False) -> DataFrame:
    """One row: all (row, class) pairs at once; classes without positives go unless ``keep_absent``."""
    rows = by_class(predictions, probs, label)
    if not keep_absent:
        present = predictions.select(F.col(label).alias("class")).distinct()
        rows = rows.join(present, "class", "left_semi")
    return auc(rows, [])


def topk_accuracy(predictions: DataFrame, probs: str, label: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row with ``top1``, ...: no shuffle but the final sum."""
    place = rank_of(F.col(probs), F.col(label))
    return predictions.select(place.alias("place")).agg(*(F.avg((F.col("place") < k).cast("int")).alias(f"top{k}") for k in ks))


def class_accuracy(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, n, correct, accuracy)."""
    correct = F.sum((F.col(label) == F.col(predicted)).cast("long"))
    return predictions.groupBy(label).agg(F.count(F.lit(1)).alias("n"), correct.alias("correct"), F.try_divide(correct, F.count(F.lit(1))).alias("accuracy"))


def error_rate(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    return predictions.agg((1 - F.avg((F.col(label) == F.col(predicted)).cast("int"))).alias("error"))


def cross_entropy(probs: Column, label: Column) -> Column:
    return -F.log(F.get(probs, label))


def percentile_rank(frame: DataFrame, groups: list[str], score: str, out: str = "percentile") -> DataFrame:
    """``frame`` with the mean rank among equals over the group's size, times 100. Null groups are a
    group; a null score has no rank and counts in no group's size."""
    counted = frame.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count(F.lit(1)).alias("_ties"))
    summed = running(counted, groups, score, {"_upto": "_ties"})
    keys = {x: f"_key{i}" for i, x in enumerate([*groups, score])}

    def same(names: list[str]) -> Column:
        met = F.lit(True)
        for x in names:
            met &= F.col(x).eqNullSafe(F.col(keys[x]))
        return met

    sizes = counted.groupBy(*groups).agg(F.sum("_ties").alias("_size")).select(*(F.col(x).alias(keys[x]) for x in groups), "_size")
    ranked = summed.join(sizes, same(groups)) if groups else summed.join(F.broadcast(sizes))
    value = (F.col("_upto") - (F.col("_ties") - 1) / 2) / F.col("_size") * 100
    ranked = ranked.select(*(F.col(x).alias(keys[x] + "_") for x in [*groups, score]), value.alias("_value"))
    ranked = ranked.select(*(F.col(keys[x] + "_").alias(keys[x]) for x in keys), "_value")
    return frame.join(ranked, same([*groups, score]), "left").select(*frame.columns, F.col("_value").alias(out))


def percentile_against(frame: DataFrame, reference: DataFrame, score: str, out: str = "percentile") -> DataFrame:
    """(score, out) for each distinct score: its percentile in ``reference``'s scores, the mean of the
    shares below and up to it (with one more if there are equals). One merged run, no cross join."""
    ref = reference.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n")).withColumn("asked", F.lit(0))
    ask = frame.select(F.col(score).alias("s")).distinct().select("s", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked"))
    merged = ref.unionByName(ask).groupBy("s").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    summed = running(merged, [], "s", {"upto": "n"})
    below, upto = F.col("upto") - F.col("n"), F.col("upto")
    value = (below + upto + (F.col("n") > 0).cast("int")) * 50.0 / reference.agg(F.count(F.lit(1))).scalar()
    return summed.where("asked = 1").select(F.col("s").alias(score), value.alias(out))
