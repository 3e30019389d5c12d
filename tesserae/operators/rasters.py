"""Rasters as tables of pixels, patches and canvases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation of 8-bit colours, 0 to 255."""
    most, fewest = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(most > 0, F.bround((most - fewest) * 255.0 / most)).otherwise(0.0)


def patch_flags(pixels: DataFrame, patch: str, black: float = 40, white: float = 5) -> DataFrame:
    """(patch, mean_r, mean_g, mean_b, is_black, is_white): black if every channel's mean is low,
    white if the mean saturation is."""
    means = pixels.groupBy(patch).agg(*(F.avg(c).alias(f"mean_{c}") for c in RGB), F.avg(saturation(*map(F.col, RGB))).alias("sat"))
    dark = reduce(lambda a, b: a & b, (F.col(f"mean_{c}") < black for c in RGB))
    return means.select(patch, *(f"mean_{c}" for c in RGB), dark.alias("is_black"), (F.col("sat") < white).alias("is_white"))


def share_flags(pixels: DataFrame, patch: str, low: int = 20, low_share: float = 0.05, high: int = 220, high_share: float = 0.2) -> DataFrame:
    """Black and white by the share of pixels that are dark or bright in all channels."""
    dark = reduce(lambda a, b: a & b, (F.col(c) < low for c in RGB)).cast("int")
    bright = reduce(lambda a, b: a & b, (F.col(c) > high for c in RGB)).cast("int")
    return pixels.groupBy(patch).agg((F.avg(dark) > low_share).alias("is_black"), (F.avg(bright) > high_share).alias("is_white"))


def overlay(tiles: DataFrame, canvas: str, x: str, y: str, size: int, score: str) -> DataFrame:
    """(canvas, px, py, n, mean): every pixel that tiles cover, with how many and their mean score."""
    columns = tiles.select(canvas, y, score, F.explode(F.sequence(F.col(x), F.col(x) + size - 1)).alias("px"))
    pixels = columns.select(canvas, "px", F.explode(F.sequence(F.col(y), F.col(y) + size - 1)).alias("py"), score)
    return pixels.groupBy(canvas, "px", "py").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))


def painted(tiles: DataFrame, canvas: str, x: str, y: str, order: str, value: str) -> DataFrame:
    """(canvas, x, y, value): the last tile painted at a place stays."""
    return tiles.groupBy(canvas, x, y).agg(F.max_by(value, order).alias(value))


def binarize(score: Column, threshold: float, classes: int = 2) -> Column:
    """0 below the threshold and 1 above; a negative threshold means one over the classes."""
    return F.when(score < (1 / classes if threshold < 0 else threshold), 0.0).otherwise(1.0)


def blend(top: Column, under: Column, alpha: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), top * alpha + under * (1 - alpha)))


def stitched(x: Column, y: Column, size: int, down: Column, width: Column, height: Column) -> Column:
    """Where a tile lies on a downsampled canvas: x1, y1, x2, y2, cut to it."""
    x1, y1, side = F.floor(x / down), F.floor(y / down), F.ceil(size / down)
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.least(x1 + side, width).alias("x2"), F.least(y1 + side, height).alias("y2"))


def canvas_downsample(width: Column, height: Column, down: Column, most: int) -> Column:
    """The downsample, raised with some slack if the canvas would have too many pixels."""
    over = (F.ceil(width / down) * F.ceil(height / down)) / most
    return F.when(over > 1, down * F.sqrt(over) * 1.15).otherwise(down)


def colour(score: Column) -> Column:
    """Blue to red by score (a linear map), as r, g, b."""
    level = F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 255)
    return F.struct(level.alias("r"), F.lit(0).cast("long").alias("g"), (255 - level).alias("b"))


def crops(pixels: DataFrame, patch: str, x: int, y: int, size: int) -> DataFrame:
    """(patch, x, y, r, g, b): the square of ``size`` around a centre, places counted from its corner; what lies outside is black.
    Pixels are never sent to all executors: Spark takes rows exploded from one for a single row's bytes."""
    spots = pixels.select(patch).distinct().select(patch, F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("i")).select(patch, (F.col("i") % size).alias("cx"), F.floor(F.col("i") / size).cast("int").alias("cy"))
    near = pixels.select(patch, (F.col("x") - (x - size // 2)).alias("cx"), (F.col("y") - (y - size // 2)).alias("cy"), *RGB)
    near = near.where(F.col("cx").between(0, size - 1) & F.col("cy").between(0, size - 1))
    return spots.join(near.hint("merge"), [patch, "cx", "cy"], "left").select(patch, F.col("cx").alias("x"), F.col("cy").alias("y"), *(F.coalesce(c, F.lit(0)).alias(c) for c in RGB))


def channel_means(pixels: DataFrame, patch: str) -> DataFrame:
    return pixels.groupBy(patch).agg(*(F.avg(c).alias(f"mean_{c}") for c in RGB))


def heatmap(tiles: DataFrame, canvas: str, x: str, y: str, size: int, score: str) -> DataFrame:
    """(canvas, px, py, r, g, b): every covered pixel in the colour of its mean score."""
    return overlay(tiles, canvas, x, y, size, score).withColumn("c", colour(F.col("mean"))).select(canvas, "px", "py", "c.r", "c.g", "c.b")
