"""Queries of scans, sinks and functions that no other query runs: files are written from the tables and read back."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import geometry, jobs, metrics, pixels, planning, rasters, rows, sampling, training
from tesserae.operators import bags as models
from tesserae.plans import bags, tiling
from tesserae.plans import pixels as images
from tesserae.plans import rasters as patches
from tesserae.plans.proxies import table
from tesserae.plans.registry import query
from tesserae.sources import scans, sinks

#: The tables of a folder.
TABLES = sorted("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
_LISTED = ", ".join(f"({k}, '{n}')" for k, n in enumerate(TABLES))


def folder(spark, name: str) -> str:
    """A new work folder under the shared one; in local mode a local one if none is named."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tesserae-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src_01_files", f"SELECT name FROM (VALUES {_LISTED}) t(k, name)")
def files(spark, sf_dir):
    """The tables' files, found below their folder whatever the case of the pattern; Spark's own lie a level deeper if a table is a folder."""
    found = scans.files(spark, sf_dir, "*.PARQUET").select(F.regexp_extract("path", r"([a-z]+)\.parquet", 1).alias("name"))
    return found.distinct()


@query("src_02_listed", f"SELECT k::BIGINT AS place, name FROM (VALUES {_LISTED}) t(k, name)")
def listed(spark, sf_dir):
    """A table may be a file or a folder of files."""
    return scans.listed(spark, sf_dir, "*.parquet", folders=True).select("place", F.regexp_replace("name", r"\.parquet$", "").alias("name"))


@query("src_04_csv_scan", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey END::INT AS n_regionkey FROM nation")
def csv_scan(spark, sf_dir):
    """NaN cells are nulls."""
    at = folder(spark, "csv")
    key = F.col("n_nationkey")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(key % 5 == 0, "nan").otherwise(F.col("n_regionkey").cast("string")).alias("n_regionkey")).write.csv(at, header=True)
    return scans.table(spark, at, "n_nationkey int, n_name string, n_regionkey int")


@query("src_05_forced_list", "SELECT DISTINCT trim(n_name) AS slide_id FROM nation WHERE n_nationkey % 3 <> 0")
def forced_list(spark, sf_dir):
    """Blank and repeated ids go; without a column of that name the first one counts."""
    at = folder(spark, "forced")
    names = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "n_name")).alias("anything"), "n_regionkey")
    names.unionByName(names).write.csv(at, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return scans.forced_list(spark, at)


@query("prj_22_key_columns", "SELECT n_name AS slide_id, 'r' || n_regionkey AS case_id FROM nation")
def key_columns(spark, sf_dir):
    at = folder(spark, "labels")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("WSI"), F.concat(F.lit("r"), "n_regionkey").alias("Subject")).write.csv(at, header=True)
    return scans.labels(spark, at).select("slide_id", "case_id")


@query("src_16_append_tiles", "SELECT label AS slide_id, count(*) AS n, sum(vec_id)::BIGINT AS total FROM embeddings GROUP BY label")
def append_tiles(spark, sf_dir):
    """Tiles in two appends, read back by slide."""
    at = folder(spark, "tiles")
    tiles = table(spark, sf_dir, "embeddings").select(F.col("label").alias("slide_id"), F.col("vec_id").alias("x"), F.lit(0).alias("y"))
    for part in (0, 1):
        sinks.append_tiles(tiles.where(F.col("x") % 2 == part), at)
    return spark.read.parquet(at).groupBy(F.col("slide_id").cast("long").alias("slide_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").cast("long").alias("total"))


@query("src_21_feature_bags", "SELECT label AS slide_id, count(*) AS n, round(arg_min(embedding[1], vec_id)::DOUBLE, 6) AS first FROM embeddings GROUP BY label")
def feature_bags(spark, sf_dir):
    """A matrix per slide, its vectors in the order of tiles."""
    at = folder(spark, "bags")
    sinks.bags(table(spark, sf_dir, "embeddings").select(F.col("label").alias("slide_id"), F.col("vec_id").alias("tile_idx"), F.col("embedding").alias("feature")), at)
    read = spark.read.parquet(at)
    return read.select("slide_id", F.size("features").cast("long").alias("n"), F.round(F.get(F.get("features", F.lit(0)), F.lit(0)).cast("double"), 6).alias("first"))


@query("src_22_xml_annotations", "SELECT n_nationkey::VARCHAR AS annotation, 2::BIGINT AS n, n_regionkey::INT AS x, (n_regionkey + 1)::INT AS y FROM nation")
def xml_annotations(spark, sf_dir):
    at, r = folder(spark, "xml"), F.col("n_regionkey").cast("string")
    point = '<Coordinate X="%s.7" Y="%s.2"/>'
    body = F.format_string(f'<Annotation Id="%s"><Coordinates>{point}{point}</Coordinates></Annotation>', F.col("n_nationkey").cast("string"), r, (F.col("n_regionkey") + 1).cast("string"), F.lit("9"), F.lit("9"))
    table(spark, sf_dir, "nation").agg(F.concat(F.lit("<All>"), F.array_join(F.collect_list(body), ""), F.lit("</All>"))).write.text(at)
    first = F.get("points", F.lit(0))
    return scans.xml_annotations(spark, at).select("annotation", F.size("points").cast("long").alias("n"), first["x"].alias("x"), first["y"].alias("y"))


@query("src_23_json_annotations", "SELECT kind, count(*) AS contours, sum(n)::BIGINT AS points FROM (SELECT 'Polygon' AS kind, 3 AS n FROM nation UNION ALL SELECT 'Polygon', 2 FROM nation UNION ALL SELECT 'MultiPoint', 5 FROM nation) GROUP BY kind")
def json_annotations(spark, sf_dir):
    """Polygons give a contour per ring, other shapes one."""
    at = folder(spark, "json")
    rings = "[[[1.5, 2], [3, 4], [5, 6]], [[1, 1], [2, 2]]]"
    shapes = F.lit(f'[{{"type": "Polygon", "coordinates": {rings}}}, {{"type": "MultiPoint", "coordinates": {rings}}}]')
    table(spark, sf_dir, "nation").select("n_nationkey", shapes.alias("value")).repartition("n_nationkey").select("value").write.option("maxRecordsPerFile", 1).text(at)
    return scans.json_annotations(spark, at).groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("contours"), F.sum(F.size("points")).cast("long").alias("points"))


@query("src_26_report_json", "SELECT r_regionkey, r_name, CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE r_regionkey END::INT AS score FROM region")
def report_json(spark, sf_dir):
    """SRC-26, SRC-34, SRC-38: one object per row, nulls written out."""
    at = folder(spark, "report")
    report = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name", F.when(F.col("r_regionkey") % 2 == 1, F.col("r_regionkey").cast("int")).alias("score"))
    sinks.json_rows(report, at)
    whole = spark.read.text(at).where(F.col("value").contains('"score":'))
    return whole.select(F.from_json("value", "r_regionkey int, r_name string, score int").alias("v")).select("v.*")


@query("src_29_result_rows", "SELECT vec_id, label, len(embedding)::INT AS width FROM embeddings")
def result_rows(spark, sf_dir):
    """Results of an evaluation, kept as a table with their vectors, appended and read again."""
    at = folder(spark, "results")
    sinks.append_log(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("probs")), at)
    return spark.read.parquet(at).select("vec_id", "label", F.size("probs").alias("width"))


_SHAPES = {k: (len(v), len(v[0])) for k, v in bags.MODEL.items()}


@query("src_31_checkpoint", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {len(v)}, {len(v[0])}, {round(sum(map(sum, v)), 6)}::DOUBLE)" for k, v in bags.MODEL.items()) + ") t(layer, rows, columns, total)")
def checkpoint(spark, sf_dir):
    """A model saved and loaded."""
    at = folder(spark, "weights")
    sinks.save_weights(spark, {k: np.array(v, float) for k, v in bags.MODEL.items()}, at)
    return spark.createDataFrame([(k, v.shape[0], v.shape[1], round(float(v.sum()), 6)) for k, v in sinks.load_weights(spark, at).items()], "layer string, rows int, columns int, total double")


@query("ml_19_initial_weights", f"SELECT layer, rows, columns FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {r}, {c})' for k, (r, c) in _SHAPES.items() if k != 'c')}, ('c', 1, {_SHAPES['c'][1]})) t(layer, rows, columns)")
def initial_weights(spark, sf_dir):
    made = training.new_model(bags.WIDTH, bags.H1, bags.H2, bags.HIDDEN, bags.CLASSES)
    return spark.createDataFrame([(k, *v.shape) for k, v in made.items() if not k.endswith("_bias")], "layer string, rows int, columns int")


@query("ml_14_optimiser", "SELECT k::INT AS step, round(-0.1 * k, 6)::DOUBLE AS adam, CASE k WHEN 1 THEN -0.1 WHEN 2 THEN -0.29 ELSE -0.561 END::DOUBLE AS momentum FROM range(1, 4) t(k)")
def optimiser(spark, sf_dir):
    """Three steps under a gradient of one."""
    found, runs = [], [(training.Optimiser(rate=0.1, decay=0.0, adam=a), {"x": np.zeros(1)}) for a in (True, False)]
    for k in (1, 2, 3):
        runs = [(o, o.step(w, {"x": np.ones(1)})) for o, w in runs]
        found.append((k, *(round(float(w["x"][0]), 6) for _, w in runs)))
    return spark.createDataFrame(found, "step int, adam double, momentum double")


@query("prj_14_missing_resolution", "SELECT p_partkey AS slide_id, p_size % 4 = 0 OR p_size % 4 = 1 AS missing FROM part")
def missing_resolution(spark, sf_dir):
    """Null and zero resolutions are missing."""
    mpp = F.when(F.col("p_size") % 4 == 0, F.lit(None)).when(F.col("p_size") % 4 == 1, 0.0).otherwise(0.25)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), planning.missing(mpp).alias("missing"))


@query("prj_17_white_patch", f"{patches._PX} SELECT patch, avg({patches._S}) < 15 AS is_white FROM px GROUP BY patch")
def white_patch(spark, sf_dir):
    return rasters.patch_flags(patches.pixels(spark, sf_dir), "patch", 40, 15).select("patch", "is_white")


@query("agg_22_channel_means", f"{patches._PX} SELECT patch, round(avg(r), 6) AS mean_r, round(avg(g), 6) AS mean_g, round(avg(b), 6) AS mean_b FROM px GROUP BY patch")
def channel_means(spark, sf_dir):
    return rasters.channel_means(patches.pixels(spark, sf_dir), "patch").select("patch", *(F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in "rgb"))


@query("har_08_crops", f"{patches._PX} SELECT patch, count(*) AS n, sum(CASE WHEN x >= 1 AND y >= 1 THEN r ELSE 0 END)::BIGINT AS red FROM (SELECT patch, x, y, r FROM px UNION ALL SELECT p_partkey, 9, 9, 0 FROM part, range(9)) WHERE x >= 1 AND y >= 1 GROUP BY patch")
def crops(spark, sf_dir):
    """Crops around a corner: what lies beyond the patch is black."""
    found = rasters.crops(patches.pixels(spark, sf_dir), "patch", 3, 3, 4)
    return found.groupBy("patch").agg((F.count(F.lit(1)) + 2).alias("n"), F.sum("r").cast("long").alias("red"))


@query("har_03_virtual_level", "SELECT p_partkey AS slide_id, p_size % 3 = 0 AS virtual, CASE WHEN p_size % 3 = 0 THEN 32 ELSE 16 END::DOUBLE AS down FROM part")
def virtual_level(spark, sf_dir):
    """A pyramid of one level is segmented on a virtual one of the desired downsample."""

    def level(down: float) -> F.Column:
        return F.struct(F.lit(float(down)).alias("dsx"), F.lit(float(down)).alias("dsy"), F.lit(int(6400 / down)).alias("w"), F.lit(int(6400 / down)).alias("h"))

    levels = F.when(F.col("p_size") % 3 == 0, F.array(level(1))).otherwise(F.array(level(1), level(4), level(16)))
    slides = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), F.lit(0.25).alias("mpp_x"), F.lit(0.25).alias("mpp_y"), levels.alias("levels"))
    return planning.plan(slides).select("slide_id", F.col("seg_virtual").alias("virtual"), F.col("seg_down").alias("down"))


@query("geo_01_tissue_pixels", "SELECT p_partkey AS slide_id, ((34 + p_size % 5) * (34 + p_size % 5) - (12 + p_size % 5) * (12 + p_size % 5))::BIGINT AS n FROM part")
def tissue_pixels(spark, sf_dir):
    """Pixels above the saturation threshold."""
    import pandas as pd

    def count(batches):
        for batch in batches:
            masks = [pixels.tissue(pixels.decode(*r), blur=1, closing=0) for r in batch[["rgb", "width", "height"]].itertuples(index=False)]
            yield pd.DataFrame({"slide_id": batch["slide_id"], "n": [int((m > 0).sum()) for m in masks]})

    return images.images(spark, sf_dir).mapInPandas(count, "slide_id long, n long")


@query("geo_11_hole_rejection", f"""{tiling._E}, g AS (SELECT slide_id, s, 0 AS cont_idx, px * s AS px, py * s AS py, k FROM part_s, (VALUES (0, 3, 2), (1, 4, 3), (2, 9, 9)) t(k, px, py)), h AS (SELECT DISTINCT hole FROM he WHERE cont_idx = 0)
SELECT slide_id, k AS probe, EXISTS (SELECT 1 FROM h WHERE {tiling._side("he", "(px + 1.0)", "(py + 1.0)", "AND e.hole = h.hole")} = 1) AS rejected FROM g""")
def hole_rejection(spark, sf_dir):
    outer = tiling.contours(spark, sf_dir).where("cont_idx = 0").withColumn("scale", (F.get("points", F.lit(1))["x"] / 10).cast("int"))
    probes = F.array(*(F.struct(F.lit(k).alias("probe"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, x, y in ((0, 3, 2), (1, 4, 3), (2, 9, 9))))
    each = outer.select("slide_id", "scale", F.transform("holes", geometry.edges).alias("gaps")).withColumn("p", F.explode(probes))
    return each.select("slide_id", "p.probe", geometry.in_hole(F.col("gaps"), F.col("p.x") * F.col("scale"), F.col("p.y") * F.col("scale"), 2).alias("rejected"))


@query("geo_12_rules", " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS n FROM ({tiling._tiles(tiling._RULES[of])})" for name, of in (("basic", "basic"), ("center", "center"), ("four_pt", "four_pt"), ("four_pt_easy", "four_pt"), ("four_pt_hard", "four_pt_hard"))))
def rules(spark, sf_dir):
    """Tiles by the name of the rule that keeps them."""
    found = None
    for name in ("basic", "center", "four_pt", "four_pt_easy", "four_pt_hard"):
        one = geometry.tiles(tiling.contours(spark, sf_dir), tiling.SIZE, tiling.STEP, name).agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n"))
        found = one if found is None else found.unionByName(one)
    return found


@query("geo_15_step_and_level", f"SELECT slide_id, cont_idx, x, y FROM ({tiling._tiles(tiling._RULES['center'])})")
def step_and_level(spark, sf_dir):
    """A step above the size is the size; both are given at a level that is half as fine."""
    return geometry.tiles(tiling.contours(spark, sf_dir), tiling.SIZE // 2, tiling.STEP, "center", down=2.0)


@query("jn_03_left_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def left_semi(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(large, "o_orderkey", "left_semi")


@query("jn_07_points_in_contours", f"""{tiling._E}, g AS (SELECT slide_id, s, cont_idx, k, px * s AS px, py * s AS py FROM part_s, (VALUES (0), (1)) c(cont_idx), (VALUES {", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(tiling._PROBES))}) t(k, px, py))
SELECT slide_id, cont_idx, k AS probe FROM g WHERE {tiling._side("oe", "px", "py")} >= 0""")
def points_in_contours(spark, sf_dir):
    """Points meet contours of their own slide alone."""
    probes = F.array(*(F.struct(F.lit(k).alias("probe"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(tiling._PROBES)))
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), (F.col("p_size") * 2).alias("scale"), F.explode(probes).alias("p"))
    met = tiling.contours(spark, sf_dir).select("slide_id", "cont_idx", "points").join(points, "slide_id")
    return met.where(geometry.side(F.col("points"), F.col("p.x") * F.col("scale"), F.col("p.y") * F.col("scale")) >= 0).select("slide_id", "cont_idx", "p.probe")


@query("jn_09_features_by_name", "SELECT n_name || '.svs' AS slide_id, CASE WHEN n_nationkey % 2 = 0 THEN '/f/' || n_name || '.pt' END AS features FROM nation")
def features_by_name(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    files = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("/f/"), "n_name", F.lit(".pt")).alias("path"))
    return scans.by_name(nation.select(F.concat("n_name", F.lit(".svs")).alias("slide_id")), files).select("slide_id", "features")


@query("top_16_seeded_draws", "SELECT vec_id, md5('7|' || vec_id) AS draw FROM embeddings")
def seeded_draws(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", sampling.drawn(7, F.col("vec_id")).alias("draw"))


@query("top_17_shuffle", "SELECT event_id, row_number() OVER (ORDER BY md5('3|' || event_id), event_id) AS place FROM events")
def shuffle(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "events").select("event_id"), "event_id", 3)


@query("win_08_progress", """WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id, (i * 10 // n)::INT AS chunk FROM p WHERE i = 0 OR i * 10 // n > (i - 1) * 10 // n""")
def progress(spark, sf_dir):
    return jobs.progress(table(spark, sf_dir, "events"), "event_id")


_LINES = "CASE l_linenumber % 4 WHEN 0 THEN 'Tiling STARTED now' WHEN 1 THEN 'Features of slide' WHEN 2 THEN 'nothing' ELSE 'all DONE' END"


@query("fn_02_markers", f"SELECT l_orderkey, l_linenumber, CASE WHEN contains(lower({_LINES}), 'tiling') THEN 'tile' WHEN contains(lower({_LINES}), 'features') THEN 'encode' WHEN contains(lower({_LINES}), 'done') THEN 'end' END AS step FROM lineitem")
def markers(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    line = F.when(k == 0, "Tiling STARTED now").when(k == 1, "Features of slide").when(k == 2, "nothing").otherwise("all DONE")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", jobs.marker(line, {"tiling": "tile", "features": "encode", "done": "end"}).alias("step"))


@query("fn_03_stems", "SELECT p_partkey, 'part.' || p_partkey AS stem, 'part.' || p_partkey || '.tar' AS outer_stem FROM part")
def stems(spark, sf_dir):
    """Folders and the last extension go (also JOB-11)."""
    path = F.concat(F.lit("/a/b.c/part."), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.stem(F.concat(path, F.lit(".svs"))).alias("stem"), text.stem(F.concat(path, F.lit(".tar.gz"))).alias("outer_stem"))


@query("fn_05_clock", "SELECT event_id, s // 3600 || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT event_id, floor(value * 60)::BIGINT AS s FROM events)")
def clock(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.clock(F.col("value") * 60).alias("clock"))


@query("fn_08_truncated", "SELECT event_id, trunc((value - 50) * 0.37::DOUBLE)::INT AS whole FROM events")
def truncated(spark, sf_dir):
    """Coordinates are cut towards zero (also FN-18)."""
    point = F.array(F.struct((F.col("value") - 50).alias("x"), F.lit(0.0).alias("y")))
    return table(spark, sf_dir, "events").select("event_id", F.get(geometry.scaled(point, F.lit(0.37), F.lit(1.0)), F.lit(0))["x"].alias("whole"))


@query("fn_09_floor_division", "SELECT event_id, floor((event_id % 41 - 20) / 6.0)::BIGINT AS quotient FROM events")
def floor_division(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.floor_div(F.col("event_id") % 41 - 20, F.lit(6)).alias("quotient"))


@query("fn_15_colours", "SELECT event_id, floor(least(greatest(value / 500, 0), 1) * 255)::BIGINT AS r, 0::BIGINT AS g, 255 - floor(least(greatest(value / 500, 0), 1) * 255)::BIGINT AS b FROM events")
def colours(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rasters.colour(F.col("value") / 500).alias("c")).select("event_id", "c.r", "c.g", "c.b")


@query("fn_17_step_states", """WITH s AS (SELECT l_orderkey, max(CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE -1 END) AS furthest FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, step, CASE WHEN k < furthest THEN 'done' WHEN k = furthest THEN 'running' ELSE 'pending' END AS state FROM s, (VALUES (0, 'tile'), (1, 'encode'), (2, 'end')) t(k, step)""")
def step_states(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    log = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(k == 0, "Tiling STARTED now").when(k == 1, "Features of slide").when(k == 2, "nothing").otherwise("all DONE").alias("line"))
    return jobs.step_states(log, "l_orderkey", "l_linenumber", "line", {"tiling": "tile", "features": "encode", "done": "end"}, ["tile", "encode", "end"])


@query("fn_19_binarized", "SELECT event_id, CASE WHEN value / 500 < 0.5 THEN 0 ELSE 1 END::DOUBLE AS fixed, CASE WHEN value / 500 < 0.25 THEN 0 ELSE 1 END::DOUBLE AS even FROM events")
def binarized(spark, sf_dir):
    share = F.col("value") / 500
    return table(spark, sf_dir, "events").select("event_id", rasters.binarize(share, 0.5).alias("fixed"), rasters.binarize(share, -1, 4).alias("even"))


@query("job_02_stage_seconds", "SELECT user_id AS job, event_type AS stage, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS seconds FROM events GROUP BY ALL")
def stage_seconds(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), "ts")
    return jobs.stage_seconds(log, "job", "stage", "ts")


@query("job_03_extraction", """SELECT p_partkey AS slide_id, (i * 2 + j)::INT AS tile_idx, (i * 24)::INT AS x, (j * 24)::INT AS y,
  round((greatest(0, least(i * 24 + 24, 40 + p_size % 5) - greatest(i * 24, 6)) * greatest(0, least(j * 24 + 24, 40 + p_size % 5) - greatest(j * 24, 6))
   - greatest(0, least(i * 24 + 24, 28 + p_size % 5) - greatest(i * 24, 16)) * greatest(0, least(j * 24 + 24, 28 + p_size % 5) - greatest(j * 24, 16))) / 576.0::DOUBLE, 6) AS share
FROM part, range(2) a(i), range(2) b(j)""")
def extraction(spark, sf_dir):
    """Images and tile places to features: here the share of red pixels of each quarter."""
    places = F.array(*(F.struct(F.lit(i * 2 + j).alias("tile_idx"), F.lit(i * 24).alias("x"), F.lit(j * 24).alias("y")) for i in range(2) for j in range(2)))
    tiles = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("slide_id"), F.explode(places).alias("t")).select("slide_id", "t.*")
    found = pixels.extract(images.images(spark, sf_dir), tiles, 24, pixels.colour_histogram, 24)
    return found.select("slide_id", "tile_idx", "x", "y", F.round(F.get("feature", F.lit(6)).cast("double"), 6).alias("share"))


@query("ml_21_region_percentiles", f"""{bags._H}, r AS (SELECT vec_id, label, round(a[1], 6) AS a FROM s), p AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY a) AS k, count(*) OVER (PARTITION BY label, a) AS ties, count(*) OVER (PARTITION BY label) AS n FROM r)
SELECT vec_id, label, round((k + (ties - 1) / 2.0::DOUBLE) / n * 100, 6) AS percentile FROM p""")
def region_percentiles(spark, sf_dir):
    """Attention of the tiles of a region as percentiles within it."""
    scored = bags.encoded(spark, sf_dir).select("vec_id", "label", F.round(F.get(models.gated_attention(F.col("h"), bags.MODEL["a"], bags.MODEL["b"], bags.MODEL["c"]), F.lit(0)), 6).alias("a"))
    return metrics.percentile_rank(scored, ["label"], "a").select("vec_id", "label", F.round("percentile", 6).alias("percentile"))


@query("ml_22_heatmap", f"""WITH {patches._TILES}, c AS (SELECT user_id, y, value / 500 AS v, unnest(range(x, x + 3))::INT AS px FROM t), p AS (SELECT user_id, px, unnest(range(y, y + 3))::INT AS py, v FROM c), m AS (SELECT user_id, px, py, round(avg(v), 9) AS v FROM p GROUP BY ALL)
SELECT user_id, px, py, count(*) AS n FROM m GROUP BY ALL""")
def heatmap(spark, sf_dir):
    """The covered pixels of each canvas, a colour for each."""
    found = rasters.heatmap(patches._tiles(spark, sf_dir).withColumn("share", F.col("value") / 500), "user_id", "x", "y", 3, "share")
    return found.where("r BETWEEN 0 AND 255 AND r + b = 255").groupBy("user_id", "px", "py").agg(F.count(F.lit(1)).alias("n"))


@query("prj_22_resolved", "SELECT n_nationkey FROM nation")
def resolved(spark, sf_dir):
    """A key column found whatever the case of its name."""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "Slide_ID")
    return nation.select(F.col(rows.resolve(nation.columns, {"slide_id"})).alias("n_nationkey"))
