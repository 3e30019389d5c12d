"""Geometry queries: every part is a slide with two contours, scaled by its size."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import geometry
from tesserae.plans.proxies import table
from tesserae.plans.registry import query

#: A concave contour with two holes and a triangle, in units of two pixels times the part's size.
_OUTER = {0: [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)], 1: [(12, 0), (20, 0), (16, 9)]}
_HOLES = {0: [[(3, 2), (5, 2), (5, 4), (3, 4)], [(7, 1), (8, 1), (8, 2)]], 1: []}
SIZE, STEP = 64, 96
_PROBES = ((2, 2), (5, 8), (0, 5), (10, 10), (11, 5), (5, 5), (2, 8))


def _points(points, scale):
    return F.array(*(F.struct((F.lit(x) * scale).cast("int").alias("x"), (F.lit(y) * scale).cast("int").alias("y")) for x, y in points))


def contours(spark, sf_dir):
    scale = F.col("p_size") * 2
    none = F.array().cast("array<array<struct<x:int,y:int>>>")
    rows = [F.struct(F.lit(k).alias("cont_idx"), _points(o, scale).alias("points"), (F.array(*(_points(h, scale) for h in _HOLES[k])) if _HOLES[k] else none).alias("holes")) for k, o in _OUTER.items()]
    part = table(spark, sf_dir, "part")
    each = part.select(F.col("p_partkey").alias("slide_id"), (F.col("p_size") * 38).alias("width"), (F.col("p_size") * 18).alias("height"), F.explode(F.array(*rows)).alias("c"))
    return each.select("slide_id", "width", "height", "c.cont_idx", "c.points", "c.holes")


def _edge_rows(which: dict) -> str:
    out = []
    for k, loops in which.items():
        for h, pts in enumerate(loops):
            out += [f"({k}, {h}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(pts, pts[1:] + pts[:1], strict=True)]
    return ", ".join(out)


_E = f"""WITH part_s AS (SELECT p_partkey AS slide_id, p_size * 2 AS s, p_size * 38 AS width, p_size * 18 AS height FROM part),
oe(cont_idx, hole, x1, y1, x2, y2) AS (VALUES {_edge_rows({k: [v] for k, v in _OUTER.items()})}),
he(cont_idx, hole, x1, y1, x2, y2) AS (VALUES {_edge_rows(_HOLES)})"""
_BOX = f"""{_E}, b AS (SELECT slide_id, cont_idx, width, height, s, (min(x1) * s)::INT AS x, (min(y1) * s)::INT AS y, ((max(x1) - min(x1)) * s + 1)::INT AS w, ((max(y1) - min(y1)) * s + 1)::INT AS h
  FROM part_s, oe GROUP BY slide_id, cont_idx, width, height, s)"""


def _side(edges: str, px: str, py: str, extra: str = "") -> str:
    """1, 0 or -1 of a point against the edges (scaled by s) of a contour."""
    turn = f"((x2 - x1) * s * ({py} - y1 * s) - ({px} - x1 * s) * (y2 - y1) * s)"
    return f"""(SELECT CASE WHEN bool_or({turn} = 0 AND {px} BETWEEN least(x1, x2) * s AND greatest(x1, x2) * s AND {py} BETWEEN least(y1, y2) * s AND greatest(y1, y2) * s) THEN 0
      WHEN count(*) FILTER ((y1 * s > {py}) <> (y2 * s > {py}) AND ({turn} > 0) = (y2 > y1)) % 2 = 1 THEN 1 ELSE -1 END FROM {edges} e WHERE e.cont_idx = g.cont_idx {extra})"""


def _tiles(test: str, x2: str = "x + w", y2: str = "y + h", step: int = 64, x1: str = "x", y1: str = "y") -> str:
    return f"""{_BOX}, r AS (SELECT *, {x1} AS gx1, {y1} AS gy1, {x2} AS gx2, {y2} AS gy2 FROM b),
c AS (SELECT slide_id, cont_idx, s, gy1, gy2, unnest(range(gx1, gx2, {step}))::INT AS px FROM r WHERE gx2 > gx1 AND gy2 > gy1),
g AS (SELECT slide_id, cont_idx, s, px, unnest(range(gy1, gy2, {step}))::INT AS py FROM c)
SELECT slide_id, cont_idx, px AS x, py AS y FROM g WHERE ({test})
  AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT cont_idx, hole FROM he) q WHERE q.cont_idx = g.cont_idx AND {_side("he", "(px + 32.0)", "(py + 32.0)", "AND e.hole = q.hole")} = 1)"""


_FOUR = [("(px + 16)", "(py + 16)"), ("(px + 48)", "(py + 48)"), ("(px + 48)", "(py + 16)"), ("(px + 16)", "(py + 48)")]
_RULES = {
    "basic": f"{_side('oe', 'px', 'py')} >= 0",
    "center": f"{_side('oe', '(px + 32)', '(py + 32)')} >= 0",
    "four_pt": " OR ".join(f"{_side('oe', a, b)} >= 0" for a, b in _FOUR),
    "four_pt_hard": " AND ".join(f"{_side('oe', a, b)} >= 0" for a, b in _FOUR),
}
for _name, _rule in (("geo_07_tiles_basic", "basic"), ("geo_08_tiles_center", "center"), ("geo_09_tiles_four_pt", "four_pt"), ("geo_10_tiles_four_pt_hard", "four_pt_hard")):
    # The step is larger than the tile, so it is clamped to the tile's size (GEO-15); holes are rejected (GEO-11).
    query(_name, _tiles(_RULES[_rule]))(lambda spark, sf_dir, rule=_rule: geometry.tiles(contours(spark, sf_dir), SIZE, STEP, rule))


@query("geo_13_tiles_unpadded", _tiles(_RULES["center"], "least(x + w, width - 64 + 1)", "least(y + h, height - 64 + 1)"))
def tiles_unpadded(spark, sf_dir):
    return geometry.tiles(contours(spark, sf_dir), SIZE, STEP, "center", padding=False)


@query("geo_14_tiles_in_region", _tiles(_RULES["center"], "least(x + w, 450)", "least(y + h, 350)", x1="greatest(x, 50)", y1="greatest(y, 30)"))
def tiles_in_region(spark, sf_dir):
    return geometry.tiles(contours(spark, sf_dir), SIZE, STEP, "center", region=(50, 30, 450, 350))


@query(
    "geo_05_point_sides",
    f"""{_E}, g AS (SELECT slide_id, s, 0 AS cont_idx, k, px * s AS px, py * s AS py FROM part_s, (VALUES {", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(_PROBES))}) t(k, px, py))
SELECT slide_id, k AS probe, {_side("oe", "px", "py")}::INT AS side FROM g""",
)
def point_sides(spark, sf_dir):
    outer = contours(spark, sf_dir).where("cont_idx = 0")
    probes = F.array(*(F.struct(F.lit(k).alias("probe"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(_PROBES)))
    scale = F.get("points", F.lit(1))["x"] / 10
    each = outer.withColumn("scale", scale.cast("int")).select("slide_id", "points", "scale", F.explode(probes).alias("p"))
    return each.select("slide_id", "p.probe", geometry.side(F.col("points"), F.col("p.x") * F.col("scale"), F.col("p.y") * F.col("scale")).alias("side"))


@query("geo_06_boxes", f"{_BOX} SELECT slide_id, cont_idx, x, y, w, h FROM b")
def boxes(spark, sf_dir):
    return contours(spark, sf_dir).select("slide_id", "cont_idx", geometry.box(F.col("points")).alias("b")).select("slide_id", "cont_idx", "b.x", "b.y", "b.w", "b.h")


_AREAS = f"""{_E}, oa AS (SELECT cont_idx, abs(sum(x1 * y2 - x2 * y1)) / 2.0::DOUBLE AS a FROM oe GROUP BY cont_idx),
ha AS (SELECT cont_idx, hole, abs(sum(x1 * y2 - x2 * y1)) / 2.0::DOUBLE AS a FROM he GROUP BY ALL)"""


@query("geo_03_large_contours", f"""{_AREAS}, n AS (SELECT slide_id, cont_idx, (oa.a - coalesce((SELECT sum(a) FROM ha WHERE ha.cont_idx = oa.cont_idx), 0)) * s * s AS net_area FROM part_s, oa)
SELECT slide_id, cont_idx, net_area FROM n WHERE net_area > 0 AND net_area > 0.1 * 65536""")
def large_contours(spark, sf_dir):
    return geometry.keep_large(contours(spark, sf_dir), 0.1, 2.0, 2.0).select("slide_id", "cont_idx", "net_area")


@query("geo_04_kept_holes", f"""{_AREAS}, r AS (SELECT cont_idx, a, row_number() OVER (PARTITION BY cont_idx ORDER BY a DESC, hole) AS k FROM ha)
SELECT slide_id, c.cont_idx, count(r.a) FILTER (r.a * s * s > 0.05 * 65536) AS n_holes FROM part_s, (SELECT DISTINCT cont_idx FROM oe) c LEFT JOIN r ON r.cont_idx = c.cont_idx AND k <= 1 GROUP BY ALL""")
def kept_holes(spark, sf_dir):
    """The largest hole of each contour, if it is large enough."""
    return geometry.keep_holes(contours(spark, sf_dir), 1, 0.05, 2.0, 2.0).select("slide_id", "cont_idx", F.size("holes").cast("long").alias("n_holes"))


@query("geo_05_scaled_contours", f"{_E} SELECT slide_id, cont_idx, sum(trunc(x1 * s * 0.37::DOUBLE))::BIGINT AS sx, sum(trunc(y1 * s * 0.61::DOUBLE))::BIGINT AS sy FROM part_s, oe GROUP BY ALL")
def scaled_contours(spark, sf_dir):
    points = geometry.scaled(F.col("points"), F.lit(0.37), F.lit(0.61))

    def total(axis):
        return F.aggregate(points, F.lit(0).cast("long"), lambda s, p: s + p[axis])

    return contours(spark, sf_dir).select("slide_id", "cont_idx", total("x").alias("sx"), total("y").alias("sy"))


@query("geo_22_centroids", f"""{_E}, m AS (SELECT cont_idx, sum(x1 * y2 - x2 * y1) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM oe GROUP BY cont_idx)
SELECT slide_id, cont_idx, round(mx / (3.0::DOUBLE * a) * s, 6) AS x, round(my / (3.0::DOUBLE * a) * s, 6) AS y FROM part_s, m""")
def centroids(spark, sf_dir):
    found = contours(spark, sf_dir).select("slide_id", "cont_idx", geometry.centroid(F.col("points")).alias("c"))
    return found.select("slide_id", "cont_idx", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query("geo_16_tiles_per_slide", f"SELECT slide_id, count(*) AS n FROM ({_tiles(_RULES['center'])}) GROUP BY slide_id")
def tiles_per_slide(spark, sf_dir):
    """All contours' tiles together, doubles kept."""
    return geometry.tiles(contours(spark, sf_dir), SIZE, STEP, "center").groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))


@query("top_01_contours_by_area", f"{_AREAS} SELECT slide_id, string_agg(cont_idx, ',' ORDER BY a DESC, cont_idx) AS contours FROM part_s, oa GROUP BY slide_id")
def contours_by_area(spark, sf_dir):
    each = contours(spark, sf_dir).groupBy("slide_id").agg(F.sort_array(F.collect_list(F.struct((-geometry.area(F.col("points"))).alias("a"), "cont_idx"))).alias("c"))
    return each.select("slide_id", F.array_join(F.transform("c", lambda x: x["cont_idx"]), ",").alias("contours"))
