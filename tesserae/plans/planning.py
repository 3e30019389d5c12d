"""Planning queries: parts stand for slides, of four resolutions' kinds and three pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import planning
from tesserae.plans.proxies import table
from tesserae.plans.registry import query

#: Downsamples per pyramid: a single level, a tie at 16 and 48, and four levels.
_PYRAMIDS = ([1.0], [1.0, 16.0, 48.0], [1.0, 4.0, 20.0, 64.0])


def slides(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mpp = F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 11 == 0, 0.0).otherwise(0.25 + F.col("p_size") / 100)
    width, height = (F.col("p_size") * 4000).cast("long"), (F.col("p_size") * 3000).cast("long")

    def level(ds: float):
        return F.struct(F.lit(ds).alias("dsx"), F.lit(ds).alias("dsy"), F.floor(width / ds).alias("w"), F.floor(height / ds).alias("h"))

    pyramids = [F.array(*(level(d) for d in p)) for p in _PYRAMIDS]
    levels = F.when(F.col("p_partkey") % 3 == 0, pyramids[0]).when(F.col("p_partkey") % 3 == 1, pyramids[1]).otherwise(pyramids[2])
    return part.select(F.col("p_partkey").alias("slide_id"), mpp.alias("mpp_x"), (mpp * 1.25).alias("mpp_y"), levels.alias("levels"), F.col("p_size").alias("size"))


_S = f"""WITH s AS (
  SELECT p_partkey AS slide_id, p_size AS size, p_partkey % 3 AS kind, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE + p_size / 100.0::DOUBLE END AS mpp_x FROM part
), s2 AS (SELECT *, mpp_x * 1.25::DOUBLE AS mpp_y, coalesce(mpp_x, 0) <= 0 AS skip FROM s),
l(kind, level, ds) AS (VALUES {", ".join(f"({k}, {i}, {d}::DOUBLE)" for k, p in enumerate(_PYRAMIDS) for i, d in enumerate(p))}),
seg AS (SELECT kind, arg_min(level, struct_pack(a := abs(ds - 32), b := -ds)) AS level FROM l WHERE level > 0 GROUP BY kind),
view AS (SELECT kind, arg_min(level, struct_pack(a := abs(ds - 32), b := level)) AS level FROM l GROUP BY kind)"""


@query(
    "har_01_plan",
    f"""{_S} SELECT slide_id, CASE WHEN NOT skip THEN round(0.25::DOUBLE / mpp_x, 9) END AS dx, CASE WHEN NOT skip THEN round(0.25::DOUBLE / mpp_y, 9) END AS dy,
  CASE WHEN NOT skip THEN CASE WHEN s2.kind = 0 THEN 0 ELSE seg.level END END AS seg_level, CASE WHEN NOT skip THEN s2.kind = 0 END AS seg_virtual,
  CASE WHEN skip THEN 1 WHEN s2.kind = 0 THEN 32 ELSE l.ds END::DOUBLE AS seg_down, view.level AS view_level, CASE WHEN skip THEN 'skipped_missing_mpp' ELSE 'tbp' END AS status
FROM s2 LEFT JOIN seg ON seg.kind = s2.kind LEFT JOIN l ON l.kind = s2.kind AND l.level = seg.level JOIN view ON view.kind = s2.kind""",
)
def plan(spark, sf_dir):
    """HAR-01 to HAR-04 and PRJ-14 in one pass over the slides."""
    found = planning.plan(slides(spark, sf_dir))
    return found.select("slide_id", F.round("dx", 9).alias("dx"), F.round("dy", 9).alias("dy"), "seg_level", "seg_virtual", "seg_down", "view_level", "status")


@query("har_02_seg_level", f"{_S} SELECT slide_id, seg.level AS seg_level FROM s2 LEFT JOIN seg ON seg.kind = s2.kind")
def seg_level(spark, sf_dir):
    return slides(spark, sf_dir).select("slide_id", planning.nearest_level(F.col("levels"), 32.0, True, True).alias("seg_level"))


@query("har_04_view_level", f"{_S} SELECT slide_id, view.level AS view_level FROM s2 JOIN view ON view.kind = s2.kind")
def view_level(spark, sf_dir):
    return slides(spark, sf_dir).select("slide_id", planning.nearest_level(F.col("levels"), 32.0, False, False).alias("view_level"))


_WH = "greatest(1, round_even(448 * (0.25::DOUBLE / mpp_x), 0))::INT AS w, greatest(1, round_even(448 * (0.25::DOUBLE / mpp_y), 0))::INT AS h"


@query(
    "har_05_native_patch",
    f"""{_S}, p AS (SELECT slide_id, {_WH} FROM s2 WHERE NOT skip)
SELECT slide_id, greatest(w, h) AS most, least(w, h) AS fewest, round_even((w + h) / 2.0::DOUBLE, 0)::INT AS mean, round_even(sqrt(w::DOUBLE * h), 0)::INT AS geom FROM p""",
)
def native_patch(spark, sf_dir):
    planned = planning.plan(slides(spark, sf_dir)).where("status = 'tbp'")
    each = {"most": "max", "fewest": "min", "mean": "mean", "geom": "geom"}
    return planned.select("slide_id", *(planning.native_patch(448, F.col("dx"), F.col("dy"), how).alias(name) for name, how in each.items()))


@query(
    "har_06_level_downsamples",
    f"""{_S} SELECT slide_id, level, round(floor(size * 4000) / floor(size * 4000 / ds), 9) AS dsx, round(floor(size * 3000) / floor(size * 3000 / ds), 9) AS dsy FROM s JOIN l USING (kind)""",
)
def level_downsamples(spark, sf_dir):
    bare = slides(spark, sf_dir).withColumn("levels", F.transform("levels", lambda x: F.struct(F.lit(None).cast("double").alias("dsx"), F.lit(None).cast("double").alias("dsy"), x["w"].alias("w"), x["h"].alias("h"))))
    found = bare.select("slide_id", F.posexplode(planning.level_downsamples(F.col("levels"))).alias("level", "x"))
    return found.select("slide_id", "level", F.round("x.dsx", 9).alias("dsx"), F.round("x.dsy", 9).alias("dsy"))


@query("har_10_scale_bar", """WITH w AS (SELECT p_partkey AS slide_id, p_size * 4000 * 0.25::DOUBLE AS w FROM part), f AS (SELECT slide_id, pow(10, floor(log10(w / 4))) AS p, w / 4 AS q FROM w)
SELECT slide_id, round(p * CASE WHEN q / p >= 5 THEN 5 WHEN q / p >= 2 THEN 2 ELSE 1 END, 6) AS bar FROM f""")
def scale_bar(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("slide_id"), F.round(planning.scale_bar(F.col("p_size") * 4000 * F.lit(0.25)), 6).alias("bar"))


@query("prj_15_canvas_guard", "SELECT p_partkey AS slide_id, CASE WHEN p_size::BIGINT * 4000 * p_size * 3000 > 300000000 THEN 'failed_seg' ELSE 'tbp' END AS status FROM part")
def canvas_guard(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("slide_id"), planning.canvas_status(F.col("p_size") * 4000, F.col("p_size") * 3000, F.lit("tbp")).alias("status"))


@query("src_11_unit_microns", """SELECT p_partkey AS slide_id, round(p_size * CASE p_partkey % 6 WHEN 0 THEN 0.001::DOUBLE WHEN 1 THEN 1000 ELSE 1 END, 9) AS microns FROM part""")
def unit_microns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    units = F.array(*(F.lit(u) for u in (" NM ", "mm", "µm", "Micrometer", "parsec"))) 
    unit = F.get(units, (F.col("p_partkey") % 6).cast("int"))  # the sixth is missing
    return part.select(F.col("p_partkey").alias("slide_id"), F.round(planning.microns(F.col("p_size").cast("double"), unit), 9).alias("microns"))
