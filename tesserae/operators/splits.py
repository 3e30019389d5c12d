"""Patient votes, stratified splits, quotas, leakage checks and split tables.

A split is drawn over patients, never over slides, so no patient can leak. The order in which
patients are drawn is that of ``md5(seed|fold|patient)``: the same on any engine and cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.numbering import placed

VAL_SHARE, TEST_SHARE = 0.1, 0.2


def dictionary(frame: DataFrame, column: str, ids: dict[str, int], out: str, strict: bool = False) -> DataFrame:
    """Map names to ids; a name that's missing gives null, or raises if ``strict``."""
    found = F.lit(None).cast("int")
    for name, number in ids.items():
        found = F.when(F.col(column) == name, F.lit(number)).otherwise(found)
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(column), F.lit("null")))).cast("int"))
    return frame.withColumn(out, found)


def vote_max(slides: DataFrame, label: str) -> DataFrame:
    """A patient's label: the largest id among its slides."""
    return slides.groupBy("case_id").agg(F.max(label).alias("label"))


def vote_majority(slides: DataFrame, label: str, missing: int | None = None) -> DataFrame:
    """A patient's label: the most frequent id, the smallest of equals; ``missing`` if there's none."""
    counted = slides.groupBy("case_id", label).agg(F.sum(F.when(F.col(label).isNotNull(), 1).otherwise(0)).alias("n"))
    found = counted.groupBy("case_id").agg(F.min_by(label, F.when(F.col(label).isNotNull(), F.struct(-F.col("n"), F.col(label)))).alias("label"))
    return found.withColumn("label", F.coalesce("label", F.lit(missing).cast("int")))


def draw_order(seed: int, fold: Column | int, key: Column) -> Column:
    fold = fold if isinstance(fold, Column) else F.lit(fold)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), fold.cast("string"), key.cast("string")))


def quotas(patients: DataFrame, val_share: float = VAL_SHARE, test_share: float = TEST_SHARE) -> DataFrame:
    """Per class: patients, and how many of them validate and test."""
    n = F.count(F.lit(1))
    return patients.groupBy("label").agg(n.alias("n"), F.floor(n * F.lit(val_share)).alias("val"), F.floor(n * F.lit(test_share)).alias("test"))


def _sizes(patients: DataFrame) -> DataFrame:
    """(of, n, ...): patients per class, as a side to join by class."""
    return patients.groupBy(F.col("label").alias("of")).agg(F.count(F.lit(1)).alias("n"))


def _drawn(patients: DataFrame, folds: int, seed: int, groups: list[str]) -> DataFrame:
    """Every patient once a fold, with ``r``, its place by draw order in its fold and ``groups``. Buckets of that
    order are summed up, so no class is sorted in one task."""
    every = patients.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("drawn", draw_order(seed, F.col("fold"), F.col("case_id")))
    # The first 48 bits of the digest sort as the digest does.
    dealt = every.withColumn("first", F.conv(F.substring("drawn", 1, 12), 16, 10).cast("long"))
    return placed(dealt, ["fold", *groups], ["first", "drawn", "case_id"], "r").drop("first", "drawn")


def stratified_split(patients: DataFrame, folds: int, seed: int, val_share: float = VAL_SHARE, test_share: float = TEST_SHARE, label_share: float = 1.0) -> DataFrame:
    """(fold, case_id, label, split): per fold and class the first by draw order validate, the
    next test, the rest train. Folds are repeated draws, not a partition. With ``label_share``
    below 1 only the first of the sorted rest train, the others are left out."""
    sized = _sizes(patients)
    ranked = _drawn(patients.select("case_id", "label"), folds, seed, ["label"]).join(sized, F.col("label").eqNullSafe(F.col("of")))
    val, test = F.floor(F.col("n") * F.lit(val_share)), F.floor(F.col("n") * F.lit(test_share))
    split = F.when(F.col("r") <= val, "val").when(F.col("r") <= val + test, "test").otherwise("train")
    named = ranked.select("fold", "case_id", "label", split.alias("split"), (F.col("n") - val - test).alias("size"))
    if label_share < 1:
        train = placed(named.where("split = 'train'"), ["fold", "label"], ["case_id"], "place")
        named = named.where("split <> 'train'").unionByName(train.where(F.col("place") <= F.ceil(F.col("size") * F.lit(label_share))).drop("place"))
    return named.drop("size")


def forced_split(patients: DataFrame, forced: DataFrame, folds: int, seed: int, legacy: bool = False) -> DataFrame:
    """As ``stratified_split`` with ``forced`` patients in test and each class's test quota less by
    them, down to nothing. ``legacy``: no further test patients are drawn at all."""
    marked = patients.join(forced.select("case_id").distinct().withColumn("forced", F.lit(True)), "case_id", "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    sized = marked.groupBy(F.col("label").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("forced").cast("int")).alias("n_forced"))
    drawn = _drawn(marked, folds, seed, ["label", "forced"]).join(sized, F.col("label").eqNullSafe(F.col("of")))
    val = F.floor(F.col("n") * F.lit(VAL_SHARE))
    test = F.lit(0) if legacy else F.greatest(F.floor(F.col("n") * F.lit(TEST_SHARE)) - F.col("n_forced"), F.lit(0))
    split = F.when(F.col("forced"), "test").when(F.col("r") <= val, "val").when(F.col("r") <= val + test, "test").otherwise("train")
    return drawn.select("fold", "case_id", "label", "forced", split.alias("split"))


def to_slides(split: DataFrame, slides: DataFrame) -> DataFrame:
    """(fold, split, slide_id, case_id, label): every slide of the split's patients."""
    return split.join(slides.select("slide_id", "case_id"), "case_id").select("fold", "split", "slide_id", "case_id", "label")


def leakage(split: DataFrame, key: str) -> DataFrame:
    """(fold, one, other, n): keys in two splits of a fold, a row per pair of splits."""
    parts = split.groupBy("fold", key).agg(F.sort_array(F.collect_set("split")).alias("in"))
    pairs = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in (("test", "train"), ("test", "val"), ("train", "val"))))
    each = parts.select("fold", "in", F.explode(pairs).alias("pair"))
    both = F.array_contains("in", F.col("pair")[0]) & F.array_contains("in", F.col("pair")[1])
    return each.groupBy("fold", F.col("pair")[0].alias("one"), F.col("pair")[1].alias("other")).agg(F.sum(both.cast("long")).alias("n"))


def assert_no_leakage(split: DataFrame, key: str) -> DataFrame:
    """``split``, which fails when it runs if a key is in two splits of a fold."""
    counts = split.groupBy("fold", key).agg(F.count_distinct("split").alias("n"))
    checked = counts.withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.lit("a patient is in two splits")).cast("long")).otherwise(F.col("n")))
    return split.join(checked.where("n = 1").select("fold", key), ["fold", key], "left_semi")


def descriptor(split_slides: DataFrame, classes: dict[str, int], folds: int) -> DataFrame:
    """(fold, class_name, split, n_patients, n_slides) for every class and split, zero-filled."""
    counted = split_slides.groupBy("fold", "label", "split").agg(F.count_distinct("case_id").alias("n_patients"), F.count(F.lit(1)).alias("n_slides"))
    spark = split_slides.sparkSession
    every = spark.createDataFrame([(f, c, s) for f in range(folds) for c in classes for s in ("train", "val", "test")], "fold int, label string, split string")
    filled = F.broadcast(every).join(counted, ["fold", "label", "split"], "left")
    return filled.select("fold", F.col("label").alias("class_name"), "split", F.coalesce("n_patients", F.lit(0)).alias("n_patients"), F.coalesce("n_slides", F.lit(0)).alias("n_slides"))


def ragged(split: DataFrame, key: str) -> DataFrame:
    """(fold, row, train, val, test): the splits side by side, padded with nulls."""
    numbered = placed(split, ["fold", "split"], [key], "row")
    return numbered.groupBy("fold", "row").agg(*(F.max(F.when(F.col("split") == s, F.col(key))).alias(s) for s in ("train", "val", "test")))


def one_hot(split: DataFrame, key: str) -> DataFrame:
    return split.select("fold", key, *((F.col("split") == s).alias(s) for s in ("train", "val", "test")))


def balanced_weights(frame: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / n per class, without gathering rows."""
    counted = frame.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("weight", F.sum("n").over(Window.partitionBy()) / F.col("n"))
