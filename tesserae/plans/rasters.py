"""Pixel queries: every part has a patch of four by four pixels; events paint a canvas per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import geometry, rasters
from tesserae.plans import tiling
from tesserae.plans.proxies import table
from tesserae.plans.registry import query

_PX = """WITH px AS (SELECT p_partkey AS patch, i % 4 AS x, i // 4 AS y, (p_size * 5 + i * 3) % 256 AS r, (p_size * 5 + i * (p_partkey % 3)) % 256 AS g, (p_size * 5 + p_partkey % 7) % 256 AS b
  FROM part, (SELECT unnest(range(0, 16)) AS i))"""


def pixels(spark, sf_dir):
    base, i = F.col("p_size") * 5, F.col("i")
    each = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("patch"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    key = F.col("patch")
    return each.select("patch", (i % 4).alias("x"), F.floor(i / 4).alias("y"), ((base + i * 3) % 256).alias("r"), ((base + i * (key % 3)) % 256).alias("g"), ((base + key % 7) % 256).alias("b"))


_S = "CASE WHEN greatest(r, g, b) > 0 THEN round_even((greatest(r, g, b) - least(r, g, b)) * 255.0::DOUBLE / greatest(r, g, b), 0) ELSE 0 END"


@query("prj_16_patch_flags", f"{_PX} SELECT patch, round(avg(r), 6) AS mean_r, round(avg(g), 6) AS mean_g, round(avg(b), 6) AS mean_b, avg(r) < 40 AND avg(g) < 40 AND avg(b) < 40 AS is_black, avg({_S}) < 15 AS is_white FROM px GROUP BY patch")
def patch_flags(spark, sf_dir):
    """PRJ-16, PRJ-17 and AGG-22."""
    found = rasters.patch_flags(pixels(spark, sf_dir), "patch", 40, 15)
    return found.select("patch", *(F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in "rgb"), "is_black", "is_white")


@query("prj_18_share_flags", f"{_PX} SELECT patch, avg((r < 20 AND g < 20 AND b < 20)::INT) > 0.05 AS is_black, avg((r > 220 AND g > 220 AND b > 220)::INT) > 0.2 AS is_white FROM px GROUP BY patch")
def share_flags(spark, sf_dir):
    return rasters.share_flags(pixels(spark, sf_dir), "patch")


@query("har_07_first_coloured_patch", f"{_PX}, f AS (SELECT patch, avg(r) < 50 AND avg(g) < 50 AND avg(b) < 50 OR avg({_S}) < 15 AS bad FROM px GROUP BY patch) SELECT p_brand AS slide, min(patch) FILTER (NOT bad) AS patch FROM f JOIN part ON patch = p_partkey GROUP BY p_brand")
def first_coloured_patch(spark, sf_dir):
    """The first patch of each slide that is neither black nor white; null if none is."""
    flags = rasters.patch_flags(pixels(spark, sf_dir), "patch", 50, 15)
    joined = flags.join(table(spark, sf_dir, "part"), F.col("patch") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("slide")).agg(F.min(F.when(~F.col("is_black") & ~F.col("is_white"), F.col("patch"))).alias("patch"))


@query("har_09_mse_similarity", f"""{_PX} SELECT patch, round(greatest(0, least(1, 1 - avg((r - g) * (r - g)) / 65025.0::DOUBLE)), 6) AS similarity FROM px GROUP BY patch""")
def mse_similarity(spark, sf_dir):
    found = pixels(spark, sf_dir).groupBy("patch").agg((1 - F.avg((F.col("r") - F.col("g")) * (F.col("r") - F.col("g"))) / 65025.0).alias("s"))
    return found.select("patch", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s"))), 6).alias("similarity"))


_TILES = "t AS (SELECT user_id, (event_id % 9)::INT * 2 AS x, (event_id % 7)::INT * 2 AS y, event_id, value FROM events)"


def _tiles(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", ((F.col("event_id") % 9) * 2).cast("int").alias("x"), ((F.col("event_id") % 7) * 2).cast("int").alias("y"), "event_id", "value")


@query("agg_23_overlap_mean", f"WITH {_TILES}, c AS (SELECT user_id, y, value, unnest(range(x, x + 3))::INT AS px FROM t), p AS (SELECT user_id, px, unnest(range(y, y + 3))::INT AS py, value FROM c) SELECT user_id, px, py, count(*) AS n, round(avg(value), 6) AS mean FROM p GROUP BY ALL")
def overlap_mean(spark, sf_dir):
    return rasters.overlay(_tiles(spark, sf_dir), "user_id", "x", "y", 3, "value").withColumn("mean", F.round("mean", 6))


@query("win_06_painted", f"WITH {_TILES} SELECT user_id, x, y, arg_max(value, event_id) AS value FROM t GROUP BY user_id, x, y")
def painted(spark, sf_dir):
    return rasters.painted(_tiles(spark, sf_dir), "user_id", "x", "y", "event_id", "value")


@query("fn_14_heat_values", "SELECT event_id, round(greatest(0, least(255, value * 0.4::DOUBLE + 255 * 0.6::DOUBLE)), 6) AS blended, CASE WHEN value / 500 < 0.2 THEN 0 ELSE 1 END::DOUBLE AS binary, floor(least(greatest(value / 500, 0), 1) * 255)::BIGINT AS red FROM events")
def heat_values(spark, sf_dir):
    """FN-14, FN-15 and FN-19."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(rasters.blend(v, F.lit(255.0), 0.4), 6).alias("blended"), rasters.binarize(v / 500, -1, 5).alias("binary"), rasters.colour(v / 500)["r"].alias("red"))


@query("fn_20_stitched", f"WITH {_TILES} SELECT event_id, floor(x / 3.0)::BIGINT AS x1, floor(y / 3.0)::BIGINT AS y1, least(floor(x / 3.0) + 3, 7)::BIGINT AS x2, least(floor(y / 3.0) + 3, 6)::BIGINT AS y2 FROM t")
def stitched(spark, sf_dir):
    place = rasters.stitched(F.col("x"), F.col("y"), 8, F.lit(3.0), F.lit(7), F.lit(6))
    return _tiles(spark, sf_dir).select("event_id", place.alias("p")).select("event_id", *(F.col(f"p.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("fn_20b_canvas_downsample", "WITH d AS (SELECT p_partkey, p_size, ceil(p_size * 400 / 8.0) * ceil(p_size * 300 / 8.0) / 1000000.0::DOUBLE AS over FROM part) SELECT p_partkey AS slide_id, round(CASE WHEN over > 1 THEN 8 * sqrt(over) * 1.15::DOUBLE ELSE 8 END, 6) AS down FROM d")
def canvas_downsample(spark, sf_dir):
    down = rasters.canvas_downsample(F.col("p_size") * 400, F.col("p_size") * 300, F.lit(8.0), 1_000_000)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), F.round(down, 6).alias("down"))


@query("geo_21_mask_pixels", f"{tiling._E}, g AS (SELECT slide_id, s, 0 AS cont_idx, (i % 11) * s AS px, (i // 11) * s AS py FROM part_s, (SELECT unnest(range(0, 121)) AS i)) SELECT slide_id, count(*) FILTER ({tiling._side('oe', 'px', 'py')} >= 0) AS n FROM g GROUP BY slide_id")
def mask_pixels(spark, sf_dir):
    """How many points of a lattice a contour's mask covers."""
    outer = tiling.contours(spark, sf_dir).where("cont_idx = 0").withColumn("scale", (F.get("points", F.lit(1))["x"] / 10).cast("int"))
    lattice = outer.select("slide_id", "points", "scale", F.explode(F.sequence(F.lit(0), F.lit(120))).alias("i"))
    on = geometry.side(F.col("points"), (F.col("i") % 11) * F.col("scale"), F.floor(F.col("i") / 11) * F.col("scale")) >= 0
    return lattice.groupBy("slide_id").agg(F.sum(on.cast("long")).alias("n"))
