"""Resolution planning: scale factors, segmentation and view levels, patch sizes, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_MPP, DESIRED = 0.25, 32.0
MOST_PIXELS = 300_000_000
#: Units of physical sizes as microns.
UNITS = {"µm": 1.0, "um": 1.0, "micrometer": 1.0, "micrometre": 1.0, "nm": 0.001, "mm": 1000.0}


def microns(value: Column, unit: Column) -> Column:
    """A physical size in microns; a missing unit is microns, an unknown one leaves the value."""
    name = F.lower(F.trim(unit))
    factor = F.lit(1.0)
    for key, number in UNITS.items():
        factor = F.when(name == key, F.lit(number)).otherwise(factor)
    return value * F.coalesce(factor, F.lit(1.0))


def missing(mpp: Column) -> Column:
    return F.coalesce(mpp, F.lit(0.0)) <= 0


def level_downsamples(levels: Column) -> Column:
    """Per level its own downsample, or what its size says against level 0."""
    base = F.get(levels, F.lit(0))
    return F.transform(
        levels, lambda x: F.struct(F.coalesce(x["dsx"], base["w"] / x["w"]).alias("dsx"), F.coalesce(x["dsy"], base["h"] / x["h"]).alias("dsy"), x["w"].alias("w"), x["h"].alias("h"))
    )


def nearest_level(levels: Column, desired: float, skip_first: bool, larger_first: bool) -> Column:
    """The level nearest the desired downsample; of equally near the larger, or else the first."""
    ranked = F.transform(
        levels,
        lambda x, k: F.struct(
            F.abs((x["dsx"] if larger_first else (x["dsx"] + x["dsy"]) / 2) - desired).alias("far"), (-x["dsx"] if larger_first else k.cast("double")).alias("then"), k.alias("level")
        ),
    )
    chosen = F.slice(ranked, 2, F.greatest(F.size(ranked) - 1, F.lit(0))) if skip_first else ranked
    return F.array_min(chosen)["level"]


def plan(slides: DataFrame, target_mpp: float = TARGET_MPP, desired: float = DESIRED) -> DataFrame:
    """``slides`` (mpp_x, mpp_y, levels) with dx, dy, seg_level, seg_virtual, seg_down, view_level, status.

    Without a resolution a slide is skipped: no scale, no level, downsample 1. A single level
    is segmented on a virtual one of the desired downsample.
    """
    levels, single = F.col("levels"), F.size("levels") == 1
    skip = missing(F.col("mpp_x")) | missing(F.col("mpp_y"))
    seg = nearest_level(levels, desired, skip_first=True, larger_first=True)
    return slides.select(
        "*",
        F.when(~skip, F.lit(target_mpp) / F.col("mpp_x")).alias("dx"),
        F.when(~skip, F.lit(target_mpp) / F.col("mpp_y")).alias("dy"),
        F.when(~skip, F.when(single, F.lit(0)).otherwise(seg)).alias("seg_level"),
        F.when(~skip, single).alias("seg_virtual"),
        F.when(skip, F.lit(1.0)).when(single, F.lit(max(1.0, desired))).otherwise(F.get(levels, seg)["dsx"]).alias("seg_down"),
        nearest_level(levels, desired, skip_first=False, larger_first=False).alias("view_level"),
        F.when(skip, F.lit("skipped_missing_mpp")).otherwise(F.lit("tbp")).alias("status"),
    )


def native_patch(size: int, dx: Column, dy: Column, square: str = "max") -> Column:
    """The native size that a patch of ``size`` has at the target scale, as one number."""
    w, h = F.greatest(F.lit(1), F.bround(size * dx)).cast("int"), F.greatest(F.lit(1), F.bround(size * dy)).cast("int")
    return {"max": F.greatest(w, h), "min": F.least(w, h), "mean": F.bround((w + h) / 2).cast("int"), "geom": F.bround(F.sqrt(w.cast("double") * h)).cast("int")}[square]


def canvas_status(width: Column, height: Column, status: Column, most: int = MOST_PIXELS) -> Column:
    """``failed_seg`` where the segmentation canvas would be too large."""
    return F.when(width.cast("long") * height > most, F.lit("failed_seg")).otherwise(status)


def scale_bar(microns_wide: Column) -> Column:
    """The largest 1, 2, 5 or 10 times a power of ten within a quarter of a width."""
    fifth = microns_wide / 4
    power = F.pow(F.lit(10.0), F.floor(F.log10(fifth)))
    share = fifth / power
    return power * F.when(share >= 5, 5.0).when(share >= 2, 2.0).otherwise(1.0)
