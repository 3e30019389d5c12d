"""Sampling, top-k and ordering; draws are by hash of a seed and the key, so they can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.numbering import numbered, placed, running


def drawn(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def first_k(frame: DataFrame, score: str, tie: str, k: int, descending: bool = True) -> DataFrame:
    """The k highest (or lowest) rows: a top-k in every task, then of those."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    return frame.orderBy(order, F.col(tie)).limit(k)


def sample(frame: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement."""
    return frame.withColumn("draw", drawn(seed, F.col(key))).orderBy("draw", key).limit(k).drop("draw")


def range_sample(frame: DataFrame, score: str, key: str, least: float, most: float, k: int, seed: int) -> DataFrame:
    """k rows of those with a score between two bounds; none if there are none."""
    return sample(frame.where(F.col(score).between(least, most)), key, k, seed)


def weighted_with_replacement(frame: DataFrame, key: str, weight: str, seed: int) -> DataFrame:
    """(draw, key): as many draws as rows, each row by its whole-number weight.

    Rows take intervals of a running sum of weights, draws are numbers below the total; both are
    merged by value and a running count of intervals says which one a draw falls in: no cross
    join and no range join."""
    edges = running(numbered(frame.select(key, weight), key, "place"), [], "place", {"upto": weight}).select("place", key, (F.col("upto") - F.col(weight)).alias("from"), F.col("upto").alias("to"))
    edges = edges.where("to > from")
    number = F.conv(F.substring(drawn(seed, F.col("drawer")), 1, 12), 16, 10).cast("long") % edges.agg(F.max("to")).scalar()
    points = frame.select(F.col(key).alias("drawer")).select("drawer", number.alias("at"))
    merged = edges.select(F.col("from").alias("at"), F.lit(1).alias("opens"), F.lit(None).cast("long").alias("drawer")).unionByName(points.select("at", F.lit(0).alias("opens"), F.col("drawer").cast("long").alias("drawer")))
    placed = running(merged, [], "at", {"interval": "opens"}).where("drawer IS NOT NULL")
    opened = numbered(edges, "from", "interval").withColumn("interval", F.col("interval") + 1)
    return placed.join(opened, "interval").select(F.col("drawer").alias("draw"), key)


def grid_cells(frame: DataFrame, key: str, columns: int = 10) -> DataFrame:
    """(key, column, row): places in a grid, filled row by row in key order."""
    return numbered(frame, key, "place").select(key, F.pmod("place", F.lit(columns)).alias("column"), F.floor(F.col("place") / columns).alias("row"))


def last_n(frame: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group (a ring buffer), cut per slice of the group first."""
    newest = F.col(order).desc()
    sliced = frame.withColumn("slice", F.pmod(F.xxhash64(order), F.lit(64)))
    short = sliced.withColumn("k", F.row_number().over(Window.partitionBy(group, "slice").orderBy(newest))).where(F.col("k") <= n)
    return short.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(newest))).where(F.col("k") <= n).drop("k", "slice")


def shuffled(frame: DataFrame, key: str, seed: int) -> DataFrame:
    """``frame`` with ``place`` 1, 2, ... in a random order that a seed fixes."""
    dealt = frame.withColumn("_draw", drawn(seed, F.col(key))).withColumn("_first", F.conv(F.substring("_draw", 1, 12), 16, 10).cast("long"))
    return placed(dealt, [], ["_first", "_draw", key], "place").drop("_draw", "_first")
