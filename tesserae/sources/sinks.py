"""Sinks: partitioned tables, wide and one-hot CSV, JSON rows, append-only logs, checkpoints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import splits


def append_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles or features into a folder per slide. Rows of a slide are spread over several files if it
    is large: they are dealt by slide and a slice of their tiles."""
    dealt = tiles.repartition("slide_id", F.pmod(F.xxhash64(*[c for c in ("x", "y") if c in tiles.columns] or ["slide_id"]), F.lit(8)))
    dealt.write.mode("append").partitionBy("slide_id").parquet(path)


def bags(features: DataFrame, path: str) -> None:
    """A row per slide with its matrix of vectors in tile order: bags as files want them."""
    rows = features.groupBy("slide_id").agg(F.sort_array(F.collect_list(F.struct("tile_idx", "feature"))).alias("t"))
    rows.select("slide_id", F.transform("t", lambda x: x["feature"]).alias("features")).write.mode("overwrite").parquet(path)


def wide_splits(split: DataFrame, path: str, key: str = "slide_id") -> None:
    """A CSV per fold: train, val and test side by side."""
    splits.ragged(split, key).orderBy("fold", "row").drop("row").write.mode("overwrite").partitionBy("fold").option("header", True).csv(path)


def boolean_splits(split: DataFrame, path: str, key: str = "slide_id") -> None:
    splits.one_hot(split, key).write.mode("overwrite").partitionBy("fold").option("header", True).csv(path)


def json_rows(frame: DataFrame, path: str) -> None:
    """A JSON object per row, nulls written out."""
    frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def append_log(frame: DataFrame, path: str) -> None:
    """Status or metric rows; readers take the latest of each key."""
    frame.write.mode("append").parquet(path)


def save_weights(spark: SparkSession, layers: dict[str, np.ndarray], path: str) -> None:
    """A model as a table (layer, out, in, w)."""
    rows = [(name, int(i), int(j), float(m[i, j])) for name, m in layers.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
    spark.createDataFrame(rows, "layer string, out int, `in` int, w double").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, np.ndarray]:
    """The layers that the table has, of ``names`` if given; others are ignored."""
    rows = spark.read.parquet(path)
    if names:
        rows = rows.where(F.col("layer").isin(names))
    found: dict[str, list] = {}
    for r in rows.collect():
        found.setdefault(r["layer"], []).append((r["out"], r["in"], r["w"]))
    layers = {}
    for name, cells in found.items():
        matrix = np.zeros((max(c[0] for c in cells) + 1, max(c[1] for c in cells) + 1))
        for i, j, w in cells:
            matrix[i, j] = w
        layers[name] = matrix
    return layers
