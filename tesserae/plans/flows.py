"""Flows of several operators, and grids without contours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import bags as models
from tesserae.operators import geometry, planning
from tesserae.plans import bags, tiling
from tesserae.plans import planning as plans
from tesserae.plans.proxies import table
from tesserae.plans.registry import query


@query(
    "job_01_slide_flow",
    f"""WITH t AS ({tiling._tiles(tiling._RULES["center"])}), n AS (SELECT slide_id, count(*) AS n FROM t GROUP BY slide_id),
s AS (SELECT p_partkey AS slide_id, p_size % 7 = 0 OR p_size % 11 = 0 AS skip, p_size::BIGINT * 1000 * p_size * 750 > 300000000 AS large FROM part)
SELECT s.slide_id, CASE WHEN skip THEN 'skipped_missing_mpp' WHEN large THEN 'failed_seg' WHEN n.n IS NULL THEN 'empty' ELSE 'processed' END AS status,
       CASE WHEN skip OR large THEN 0 ELSE coalesce(n.n, 0) END AS n_tiles FROM s LEFT JOIN n USING (slide_id)""",
)
def slide_flow(spark, sf_dir):
    """Plan, guards, contours, tiles and the status of each slide: failures are values, not errors."""
    planned = planning.plan(plans.slides(spark, sf_dir))
    status = planning.canvas_status(F.col("size") * 1000, F.col("size") * 750, F.col("status"))
    guarded = planned.select("slide_id", F.when(F.col("status") == "tbp", status).otherwise(F.col("status")).alias("status"))
    able = tiling.contours(spark, sf_dir).join(guarded.where("status = 'tbp'").select("slide_id"), "slide_id", "left_semi")
    counted = geometry.tiles(able, tiling.SIZE, tiling.STEP, "center").groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))
    done = guarded.join(counted, "slide_id", "left")
    final = F.when(F.col("status") != "tbp", F.col("status")).when(F.col("n").isNull(), "empty").otherwise("processed")
    return done.select("slide_id", final.alias("status"), F.coalesce("n", F.lit(0)).alias("n_tiles"))


@query("geo_17_checked_level", "SELECT p_partkey AS slide_id, (p_size % 3)::INT AS level FROM part")
def checked_level(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), geometry.checked_level(F.col("p_size") % 3, F.lit(3)).alias("level"))


@query(
    "geo_18_image_grid",
    """WITH s AS (SELECT p_partkey AS slide_id, p_size * 38 AS w, p_size * 18 AS h FROM part), r AS (SELECT *, unnest(range(0, h - 64, 96)) AS y FROM s), c AS (SELECT *, unnest(range(0, w - 64, 96)) AS x FROM r)
SELECT slide_id, (row_number() OVER (PARTITION BY slide_id ORDER BY y, x) - 1)::INT AS place, (x // 2)::INT AS x, (y // 2)::INT AS y FROM c""",
)
def image_grid(spark, sf_dir):
    """Rows first, coordinates halved, no tile beyond the image."""
    sized = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), (F.col("p_size") * 38).alias("w"), (F.col("p_size") * 18).alias("h"))
    return geometry.coordinates(sized, "w", "h", 64, 96, shrink=2).select("slide_id", "place", "x", "y")


@query(
    "geo_19_coordinate_grid",
    """WITH s AS (SELECT p_partkey AS slide_id, p_size * 38 AS w, p_size * 18 AS h FROM part), c AS (SELECT *, unnest(range(0, w - 64, 96)) AS x FROM s), r AS (SELECT *, unnest(range(0, h - 64, 96)) AS y FROM c)
SELECT slide_id, (row_number() OVER (PARTITION BY slide_id ORDER BY x, y) - 1)::INT AS place, x::INT AS x, y::INT AS y FROM r""",
)
def coordinate_grid(spark, sf_dir):
    sized = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), (F.col("p_size") * 38).alias("w"), (F.col("p_size") * 18).alias("h"))
    return geometry.coordinates(sized, "w", "h", 64, 96, y_first=False).select("slide_id", "place", "x", "y")


_NEAR = [("(px + 20)", "(py + 20)"), ("(px + 44)", "(py + 44)"), ("(px + 44)", "(py + 20)"), ("(px + 20)", "(py + 44)")]


@query("geo_20_region_tiles", tiling._tiles(" AND ".join(f"{tiling._side('oe', a, b)} >= 0" for a, b in _NEAR), step=60))
def region_tiles(spark, sf_dir):
    """All four points, shifted by how much neighbouring tiles overlap."""
    return geometry.tiles(tiling.contours(spark, sf_dir), 64, 60, "four_pt_hard", shift=geometry.region_shift(64, 60))


_SITE = bags._matrix(2, bags.H2, 9)


@query(
    "ml_06_second_head",
    f"""{bags._H}, p AS (SELECT label, [{", ".join(f"sum(exp(a[2]) * h[{k}]) / sum(exp(a[2]))" for k in range(1, bags.H2 + 1))}] AS m FROM s GROUP BY label)
SELECT label, {", ".join(f"round(list_dot_product(m, {r}::DOUBLE[]), 6) AS z{k}" for k, r in enumerate(_SITE))} FROM p""",
)
def second_head(spark, sf_dir):
    found = models.second_head(table(spark, sf_dir, "embeddings"), "label", "embedding", bags.MODEL, _SITE)
    return found.select("label", *(F.round(F.get("logits", F.lit(k)), 6).alias(f"z{k}") for k in range(2)))


@query("src_18_tiles_with_plan", f"""WITH t AS ({tiling._tiles(tiling._RULES["center"])}) SELECT slide_id, cont_idx, x, y, p_size AS size FROM t JOIN part ON slide_id = p_partkey""")
def tiles_with_plan(spark, sf_dir):
    """Tiles meet the parameters of their slide by key."""
    params = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), F.col("p_size").alias("size"))
    return geometry.tiles(tiling.contours(spark, sf_dir), tiling.SIZE, tiling.STEP, "center").join(params, "slide_id").select("slide_id", "cont_idx", "x", "y", "size")
