"""Contours and tiles: areas, boxes, point tests, grids, hole rejection.

A contour is an array of (x, y) points, its holes an array of such arrays; both stay in the row
of their contour, so a tile meets only the contour that made it and no join is a cross product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(points: Column) -> Column:
    """Each point with the next, the last with the first."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.zip_with(points, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _twice_area(points: Column) -> Column:
    return F.aggregate(edges(points), F.lit(0.0), lambda s, e: s + e["x1"].cast("double") * e["y2"] - e["x2"].cast("double") * e["y1"])


def area(points: Column) -> Column:
    """The area that a contour encloses (shoelace)."""
    return F.abs(_twice_area(points)) / 2


def centroid(points: Column) -> Column:
    """Centre of mass of the enclosed area; null for none."""

    def moment(axis: str) -> Column:
        cross = lambda e: e["x1"].cast("double") * e["y2"] - e["x2"].cast("double") * e["y1"]
        return F.aggregate(edges(points), F.lit(0.0), lambda s, e: s + (e[f"{axis}1"] + e[f"{axis}2"]) * cross(e))

    whole = 3 * _twice_area(points)
    return F.when(whole != 0, F.struct((moment("x") / whole).alias("x"), (moment("y") / whole).alias("y")))


def net_area(points: Column, holes: Column) -> Column:
    return area(points) - F.aggregate(holes, F.lit(0.0), lambda s, h: s + area(h))


def scaled(points: Column, sx: Column, sy: Column) -> Column:
    """Points times a scale, cut to whole numbers."""
    return F.transform(points, lambda p: F.struct((p["x"] * sx).cast("int").alias("x"), (p["y"] * sy).cast("int").alias("y")))


def box(points: Column) -> Column:
    """x, y, w, h of whole pixels: both ends count."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs) + 1).alias("w"), (F.array_max(ys) - F.array_min(ys) + 1).alias("h"))


def side(points: Column, x: Column, y: Column) -> Column:
    """1 inside, 0 on the line, -1 outside; even-odd rule, without division."""
    return side_of(edges(points), x, y)


def side_of(line: Column, x: Column, y: Column) -> Column:
    """``side`` of a contour whose edges are already made."""
    x, y = x.cast("double"), y.cast("double")

    def turn(e: Column) -> Column:
        return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])

    touches = F.exists(line, lambda e: (turn(e) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
    crossed = F.filter(line, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & ((turn(e) > 0) == (e["y2"] > e["y1"])))
    return F.when(touches, 0).when(F.size(crossed) % 2 == 1, 1).otherwise(-1)


def corners(x: Column, y: Column, size: int, shift: float = 0.5) -> list[tuple[Column, Column]]:
    """Four points around a tile's centre; the centre alone if the shift is nothing."""
    cx, cy, off = x + size // 2, y + size // 2, int(size // 2 * shift)
    return [(cx - off, cy - off), (cx + off, cy + off), (cx + off, cy - off), (cx - off, cy + off)] if off else [(cx, cy)]


def holds(line: Column, x: Column, y: Column, size: int, rule: str, shift: float = 0.5) -> Column:
    """Whether a contour (its edges) holds a tile: ``basic`` by its corner, ``center``, ``four_pt`` by any and
    ``four_pt_hard`` by all of four points. ``four_pt_easy`` is another name of ``four_pt``."""
    if rule == "basic":
        return side_of(line, x, y) >= 0
    if rule == "center":
        return side_of(line, x + size // 2, y + size // 2) >= 0
    tests = [side_of(line, a, b) >= 0 for a, b in corners(x, y, size, shift)]
    found = tests[0]
    for test in tests[1:]:
        if rule in ("four_pt", "four_pt_easy"):
            found = found | test
        elif rule == "four_pt_hard":
            found = found & test
        else:
            raise ValueError(f"unknown rule {rule}")
    return found


def in_hole(holes: Column, x: Column, y: Column, size: int) -> Column:
    """Whether a tile's exact centre is strictly inside any hole (an array of their edges)."""
    return F.exists(holes, lambda h: side_of(h, x + size / 2, y + size / 2) > 0)


def keep_large(contours: DataFrame, least: float, sx: float = 1.0, sy: float = 1.0, unit: int = 512) -> DataFrame:
    """Contours whose net area is more than ``least`` unit squares at their scale; empty ones go."""
    ref = int(unit * unit / (sx * sy))
    net = net_area(F.col("points"), F.col("holes"))
    return contours.withColumn("net_area", net).where((F.col("net_area") > 0) & (F.col("net_area") > least * ref))


def keep_holes(contours: DataFrame, most: int, least: float, sx: float = 1.0, sy: float = 1.0, unit: int = 512) -> DataFrame:
    """Of each contour the ``most`` largest holes, and of those the ones above ``least`` unit squares."""
    ref = int(unit * unit / (sx * sy))
    ranked = F.sort_array(F.transform("holes", lambda h, k: F.struct((-area(h)).alias("minus"), k.alias("k"))))
    first = F.filter(F.slice(ranked, 1, most), lambda x: -x["minus"] > least * ref)
    return contours.withColumn("holes", F.transform(first, lambda x: F.get("holes", x["k"])))


def tiles(
    contours: DataFrame, size: int, step: int, rule: str = "four_pt", padding: bool = True, region: tuple[int, int, int, int] | None = None, reject_holes: bool = True, shift: float = 0.5, down: float = 1.0
) -> DataFrame:
    """(slide_id, cont_idx, x, y): the grid over each contour's box, kept where the contour holds
    the tile. Contours may give the same tile twice. Without padding a tile ends inside the
    image (``width``, ``height`` columns). ``region``: x1, y1, x2, y2 that grids are cut to.
    ``down``: the downsample of the level that size and step are given in; places are those of level 0."""
    size, step = int(size * down), int(min(step, size) * down)
    b = F.col("box")
    x1, y1, x2, y2 = b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]
    if not padding:
        x2, y2 = F.least(x2, F.col("width") - size + 1), F.least(y2, F.col("height") - size + 1)
    if region:
        x1, y1, x2, y2 = F.greatest(x1, F.lit(region[0])), F.greatest(y1, F.lit(region[1])), F.least(x2, F.lit(region[2])), F.least(y2, F.lit(region[3]))
    # A contour is a small row that gives many tiles: contours are dealt out first, and their edges made once.
    context = contours.sparkSession
    parts = max(int(context.conf.get("spark.sql.shuffle.partitions")), context.sparkContext.defaultParallelism)
    boxed = contours.withColumn("box", box(F.col("points"))).select(
        "slide_id", "cont_idx", edges(F.col("points")).alias("line"), F.transform("holes", edges).alias("gaps"), *(c.cast("int").alias(n) for n, c in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2)))
    )
    dealt = boxed.where("x2 > x1 AND y2 > y1").repartition(parts, "slide_id", "cont_idx")
    columns = dealt.select("slide_id", "cont_idx", "line", "gaps", "y1", "y2", F.explode(F.sequence(F.col("x1"), F.col("x2") - 1, F.lit(step))).alias("x"))
    cells = columns.select("slide_id", "cont_idx", "line", "gaps", "x", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1, F.lit(step))).alias("y"))
    kept = cells.where(holds(F.col("line"), F.col("x"), F.col("y"), size, rule, shift))
    if reject_holes:
        kept = kept.where(~in_hole(F.col("gaps"), F.col("x"), F.col("y"), size))
    return kept.select("slide_id", "cont_idx", "x", "y")


def region_shift(size: int, step: int) -> float:
    """The shift of the four points by how much neighbouring tiles overlap."""
    overlap = 1 - step / size
    return 0.375 if overlap < 0.25 else 0.5 if overlap < 0.95 else 0.625


def checked_level(level: Column, levels: Column) -> Column:
    """The level, which fails when it runs if the pyramid doesn't have it."""
    return F.when((level >= 0) & (level < levels), level).otherwise(F.raise_error(F.lit("no such level")).cast("int"))


def coordinates(frame: DataFrame, width: str, height: str, size: int, step: int, shrink: int = 1, y_first: bool = True) -> DataFrame:
    """``frame`` by (place, x, y): a plain grid over an image, its last start before the last whole
    tile, in the order of rows or of columns, coordinates divided by ``shrink``."""
    xs = F.when(F.col(width) > size, F.sequence(F.lit(0), F.col(width) - size - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    ys = F.when(F.col(height) > size, F.sequence(F.lit(0), F.col(height) - size - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    outer, inner = (ys, xs) if y_first else (xs, ys)
    each = frame.withColumn("outer", outer).withColumn("inner", inner).select("*", F.posexplode("outer").alias("a", "first")).select("*", F.posexplode("inner").alias("b", "second"))
    x, y = ("second", "first") if y_first else ("first", "second")
    return each.select(*frame.columns, (F.col("a") * F.size("inner") + F.col("b")).alias("place"), F.floor(F.col(x) / shrink).cast("int").alias("x"), F.floor(F.col(y) / shrink).cast("int").alias("y"))
