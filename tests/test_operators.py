"""Golden values, properties and edge cases of the library's own operators."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import bags, geometry, jobs, metrics, pixels, rasters, rows, sampling, splits
from tesserae.operators.numbering import numbered, placed, running
from tesserae.sources import scans, sinks, tiff
from tesserae.streaming import arrivals

CONCAVE = [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]


def polygon(spark, points, holes=()):
    array = [{"x": x, "y": y} for x, y in points]
    return spark.createDataFrame([(1, 0, array, [[{"x": x, "y": y} for x, y in h] for h in holes])], "slide_id long, cont_idx int, points array<struct<x:int,y:int>>, holes array<array<struct<x:int,y:int>>>")


def test_point_sides(spark):
    golden = {(2, 2): 1, (5, 8): -1, (0, 5): 0, (10, 10): 0, (11, 5): -1, (5, 5): 0, (2, 8): 0}
    row = polygon(spark, CONCAVE).select(*(geometry.side(F.col("points"), F.lit(x), F.lit(y)).alias(f"s{k}") for k, (x, y) in enumerate(golden))).first()
    assert list(row) == list(golden.values())


def test_hard_tiles_are_among_easy_ones(spark):
    contour = polygon(spark, [(x * 40, y * 40) for x, y in CONCAVE], [[(80, 80), (200, 80), (200, 160), (80, 160)]])
    easy, hard, center = ({(r.x, r.y) for r in geometry.tiles(contour, 32, 64, rule).collect()} for rule in ("four_pt", "four_pt_hard", "center"))
    assert hard <= center <= easy and hard < easy
    assert not any(80 < x + 16 < 200 and 80 < y + 16 < 160 for x, y in easy)
    assert geometry.tiles(contour, 32, 64, "center", region=(500, 500, 600, 600)).count() == 0
    with pytest.raises(ValueError):
        geometry.tiles(contour, 32, 64, "other")


def test_areas_and_shift(spark):
    row = polygon(spark, CONCAVE).select(geometry.area(F.col("points")).alias("a"), geometry.centroid(F.col("points")).alias("c")).first()
    assert row.a == 75 and row.c.x == pytest.approx(5)
    assert [geometry.region_shift(100, s) for s in (100, 50, 25, 4)] == [0.375, 0.5, 0.5, 0.625]


def test_split_is_whole_disjoint_and_exact(spark):
    patients = spark.range(97).select(F.col("id").alias("case_id"), F.when(F.col("id") < 40, "a").otherwise("b").alias("label"))
    split = splits.stratified_split(patients, 2, 5)
    assert split.count() == 194 and split.select("fold", "case_id").distinct().count() == 194
    assert {(r.label, r.split): r["count"] for r in split.where("fold = 0").groupBy("label", "split").count().collect()} == {("a", "val"): 4, ("a", "test"): 8, ("a", "train"): 28, ("b", "val"): 5, ("b", "test"): 11, ("b", "train"): 41}
    assert splits.assert_no_leakage(split, "case_id").count() == 194
    with pytest.raises(Exception, match="two splits"):
        splits.assert_no_leakage(split.withColumn("k", F.lit(1)), "k").count()


def test_strict_dictionary_fails(spark):
    frame = spark.createDataFrame([("x",)], "label string")
    with pytest.raises(Exception, match="unknown label"):
        splits.dictionary(frame, "label", {"y": 1}, "id", strict=True).collect()
    assert splits.dictionary(frame, "label", {"y": 1}, "id").first().id is None


def test_auc_flips_with_labels_and_needs_both_kinds(spark):
    rng = np.random.default_rng(0)
    data = [(float(s), bool(p)) for s, p in zip(rng.integers(0, 20, 300), rng.integers(0, 2, 300), strict=True)]
    frame = spark.createDataFrame(data, "score double, positive boolean")
    one, two = (metrics.auc(f, []).first().auc for f in (frame, frame.withColumn("positive", ~F.col("positive"))))
    assert one + two == pytest.approx(1)
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a, p in data if p for b, q in data if not q]
    assert one == pytest.approx(np.mean(wins))
    assert metrics.auc(frame.where("positive"), []).first().auc is None


def test_running_and_numbered_equal_plain_windows(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    assert [r.n for r in numbered(frame.select("k"), "k", "n").orderBy("k").collect()] == list(range(1000))
    total = {r.k: r.t for r in running(frame, ["g"], "k", {"t": "k"}).collect()}
    seen = {}
    for k, g in sorted((r.k, r.g) for r in frame.collect()):
        seen[g] = seen.get(g, 0) + k
        assert total[k] == seen[g]


def test_early_stopping_waits_and_accepts_equal_losses(spark):
    losses = [(1, e, 1.0 if e <= 30 else 2.0) for e in range(1, 60)]
    rows_ = jobs.early_stopping(spark.createDataFrame(losses, "run int, epoch int, loss double"), "run", "epoch", "loss").orderBy("epoch").collect()
    assert all(r.improved for r in rows_[:30]) and not rows_[30].improved
    assert rows_[0].stopped_at == 51


def test_weighted_sample_follows_weights(spark):
    frame = spark.range(400).select("id", F.when(F.col("id") == 7, 1000).otherwise(1).cast("long").alias("w"))
    drawn = sampling.weighted_with_replacement(frame, "id", "w", 3)
    assert drawn.count() == 400 and drawn.where("id = 7").count() > 200


def test_rows_helpers(spark):
    frame = spark.createDataFrame([(1, None, None), (2, "x", None)], "a int, b string, c string")
    kept, _ = rows.complete_rows(frame, "c")
    assert [r.a for r in kept.collect()] == [2] and kept.columns == ["a", "b"]
    assert rows.resolve(["X", "Slide_ID"], {"slide_id"}) == "Slide_ID"


def test_small_and_wide_attention_agree(spark):
    frame = spark.createDataFrame([([0.1 * k, -0.2, 0.3],) for k in range(5)], "h array<double>")
    a, b, c = [[0.5, -1.0, 2.0], [1.0, 0.0, 0.3]], [[0.2, 0.1, 0.0], [-1.0, 2.0, 0.5]], [[1.0, -1.0]]
    row = frame.select(bags.gated_attention(F.col("h"), a, b, c).alias("x"), bags.attention_by_arrow(F.col("h"), a, b, c).alias("y")).collect()
    assert all(r.x == pytest.approx(r.y) for r in row)


def test_pixel_kernels():
    image = np.full((40, 40, 3), 240, np.uint8)
    image[5:30, 5:30] = (200, 60, 120)
    image[12:20, 12:20] = 240
    mask = pixels.tissue(image, blur=1, closing=0)
    found = pixels.contours(mask)
    assert len(found) == 2 and found[0][1] is None and found[1][1] == 0
    assert (min(found[0][0]), max(found[0][0])) == ((5, 5), (29, 29))
    assert pixels.contours(np.zeros((5, 5), np.uint8)) == []
    lone = np.zeros((5, 5), np.uint8)
    lone[2, 3] = 255
    assert pixels.contours(lone) == [([(3, 2)], None)]
    assert 0 <= pixels.otsu(pixels.saturation(image)) < 200
    assert pixels.ssim(image[..., 0], image[..., 0]) == pytest.approx(1)
    assert pixels.ssim(image[..., 0], 255 - image[..., 0]) < 0.5
    assert pixels.resize(image, 20, 10).shape == (10, 20, 3)
    assert (pixels.resize(np.full((6, 6, 3), 9, np.uint8), 3, 4, cubic=True) == 9).all()
    assert pixels.region(image, -2, -2, 4, 4)[0, 0].sum() == 0
    closed = pixels.close(np.array([[0, 0, 0, 0, 0], [0, 255, 0, 255, 0], [0, 0, 0, 0, 0]], np.uint8), 3)
    assert closed[1, 2] == 255


def write_tiff(path, pages):
    """A small little-endian TIFF: pages of (width, height, tiled, description)."""
    body, offsets = b"", []
    blocks = []
    for w, h, tiled, text in pages:
        tags = [(256, 4, 1, w), (257, 4, 1, h)]
        raw = text.encode() + b"\0"
        tags.append((270, 2, len(raw), raw))
        if tiled:
            tags.append((322, 4, 1, 256))
        blocks.append(tags)
    at = 8
    for k, tags in enumerate(blocks):
        size = 2 + 12 * len(tags) + 4
        extra, entries = b"", b""
        for tag, kind, count, value in tags:
            if isinstance(value, bytes):
                if count > 4:
                    entries += struct.pack("<HHII", tag, kind, count, at + size + len(extra))
                    extra += value
                else:
                    entries += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
            else:
                entries += struct.pack("<HHII", tag, kind, count, value)
        offsets.append(at)
        following = at + size + len(extra) if k + 1 < len(blocks) else 0
        body += struct.pack("<H", len(tags)) + entries + struct.pack("<I", following) + extra
        at += size + len(extra)
    path.write_bytes(b"II*\0" + struct.pack("<I", 8) + body)


def test_slide_metadata_source(spark, tmp_path):
    write_tiff(tmp_path / "a.svs", [(1000, 800, True, "x|AppMag = 20|MPP = 0.5"), (100, 80, False, ""), (250, 200, True, "")])
    write_tiff(tmp_path / "b.TIF", [(500, 400, False, '<OME xmlns="u"><Image><Pixels SizeX="500" SizeY="400" PhysicalSizeX="250" PhysicalSizeXUnit="nm"/></Image></OME>')])
    (tmp_path / "c.btf").write_bytes(b"junk")
    spark.dataSource.register(tiff.SlideMetadata)
    found = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("slide_metadata").load(str(tmp_path)).collect()}
    assert found["a.svs"].mpp_x == 0.5 and found["a.svs"].objective == 20 and [lv.dsx for lv in found["a.svs"].levels] == [1, 4]
    assert found["b.TIF"].kind == "single" and found["b.TIF"].mpp_x == 0.25
    assert found["c.btf"].error


def test_ome_falls_back_and_survives_bad_text():
    two = '<OME><Image><Pixels SizeX="9" SizeY="9" PhysicalSizeX="2"/></Image><Image><Pixels SizeX="5" SizeY="5" PhysicalSizeX="1"/></Image></OME>'
    assert tiff.ome(two, 3)["mpp_x"] == 1
    assert tiff.ome(two.replace("PhysicalSizeX", "Other"), None)["width"] == 9
    assert tiff.ome(two[:30], None)["mpp_x"] is None
    assert tiff.ome("\x01" + two, None)["mpp_x"] == 1


def test_scans_and_sinks(spark, tmp_path):
    for name in ("x/a.SVS", "x/y/b.svs", "x/y/z/c.svs", "d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    assert scans.files(spark, str(tmp_path)).count() == 3
    assert scans.files(spark, str(tmp_path), depth=3).count() == 2
    (tmp_path / "f.csv").write_text("name,x\n a ,1\nb,2\nb,3\n")
    assert {r.slide_id for r in scans.forced_list(spark, str(tmp_path / "f.csv")).collect()} == {"a", "b"}
    (tmp_path / "j.json").write_text('[{"type": "Polygon", "coordinates": [[[1, 2], [3, 4]], [[5, 6]]]}, {"type": "Multi", "coordinates": [[[1, 1]], [[2, 2]]]}]')
    shapes = scans.json_annotations(spark, str(tmp_path / "j.json")).collect()
    assert sorted((r.type, r.ring, len(r.points)) for r in shapes) == [("Multi", 0, 2), ("Polygon", 0, 2), ("Polygon", 1, 1)]
    (tmp_path / "x.xml").write_text('<As><Annotation Id="1"><Coordinates><Coordinate X="1.5" Y="2"/><Coordinate X="3" Y="4"/></Coordinates></Annotation></As>')
    assert [p.x for p in scans.xml_annotations(spark, str(tmp_path / "x.xml")).first().points] == [1, 3]
    layers = {"fc": np.arange(6.0).reshape(2, 3)}
    sinks.save_weights(spark, layers, str(tmp_path / "w"))
    assert (sinks.load_weights(spark, str(tmp_path / "w"))["fc"] == layers["fc"]).all()
    tiles = spark.createDataFrame([("s", 0, 1, 2, [0.5])], "slide_id string, tile_idx int, x int, y int, feature array<float>")
    sinks.append_tiles(tiles, str(tmp_path / "t"))
    sinks.append_tiles(tiles.withColumn("tile_idx", F.lit(1)), str(tmp_path / "t"))
    again = spark.read.parquet(str(tmp_path / "t"))
    assert again.count() == 2
    sinks.bags(again, str(tmp_path / "b"))
    assert len(spark.read.parquet(str(tmp_path / "b")).first().features) == 2


def test_listed_takes_tables_of_several_files_and_other_paths(spark, tmp_path):
    top = tmp_path / "a+b"
    for name in ("b.parquet", "c.PARQUET/part-0", "c.PARQUET/part-1", "a.txt", "d/e.parquet"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("x")
    for at in (str(top), f"{top}/", f"file://{top}"):
        assert [tuple(r)[:2] for r in scans.listed(spark, at, "*.parquet", folders=True).orderBy("place").collect()] == [(0, "b.parquet"), (1, "c.PARQUET")]
        assert [r["name"] for r in scans.listed(spark, at).orderBy("place").collect()] == ["a.txt", "b.parquet"]


def test_arrivals_are_worked_on_once(spark, tmp_path):
    new, done, checkpoint = (str(tmp_path / x) for x in ("new", "done", "checkpoint"))
    spark.range(5).select(F.col("id").alias("slide_id")).write.parquet(new)
    work = lambda rows_: rows_.withColumn("status", F.lit("processed"))
    arrivals.work_off(spark, new, "slide_id long", done, checkpoint, work)
    spark.range(3, 8).select(F.col("id").alias("slide_id")).write.mode("append").parquet(new)
    arrivals.work_off(spark, new, "slide_id long", done, checkpoint, work)
    assert sorted(r.slide_id for r in spark.read.parquet(done).collect()) == list(range(8))


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_plans_push_filters_and_make_no_cross_products(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    from tesserae.plans import registry

    queries = registry.queries()
    active = plan_of(queries["prj_06_active_rows"](spark, sf))
    assert "EqualTo(l_linestatus,O)" in active and "l_comment" not in active
    for name in ("agg_10_split_descriptor", "agg_14_auc_ovr", "geo_09_tiles_four_pt", "ml_05_mil_forward", "top_12_weighted_sample"):
        plan = plan_of(queries[name](spark, sf))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "Python" not in plan and "InPandas" not in plan, name


def test_images_are_not_sent_to_all_executors(spark):
    slides = spark.range(3).withColumnsRenamed({"id": "slide_id"})
    made = slides.select("slide_id", F.lit(2).alias("width"), F.lit(2).alias("height"), F.lit(bytes(range(12))).alias("rgb"))
    tiles = slides.crossJoin(spark.range(4).select(F.col("id").cast("int").alias("tile_idx"), (F.col("id") % 2).cast("int").alias("x"), F.floor(F.col("id") / 2).cast("int").alias("y")))
    found = pixels.extract(made, tiles, 1, lambda images: [i[0, 0] for i in images], 3)
    assert "SortMergeJoin" in plan_of(found) and "BroadcastHashJoin" not in plan_of(found)
    assert sorted((r["slide_id"], r["tile_idx"], *r["feature"]) for r in found.collect()) == [(s, t, 3.0 * t, 3.0 * t + 1, 3.0 * t + 2) for s in range(3) for t in range(4)]


def test_pixels_of_crops_are_not_sent_to_all_executors(spark):
    each = spark.range(18).select(F.floor(F.col("id") / 9).alias("patch"), (F.col("id") % 3).alias("x"), F.floor(F.col("id") % 9 / 3).alias("y"), *(F.col("id").alias(c) for c in "rgb"))
    found = rasters.crops(each, "patch", 2, 2, 2)
    assert "SortMergeJoin" in plan_of(found) and "BroadcastHashJoin" not in plan_of(found)
    assert sorted(tuple(r) for r in found.collect()) == [(p, x, y, *(9 * p + 3 * (y + 1) + x + 1,) * 3) for p in range(2) for x in range(2) for y in range(2)]
    beyond = rasters.crops(each, "patch", 3, 3, 2)
    assert sorted((r["patch"], r["x"], r["y"], r["r"]) for r in beyond.collect()) == [(p, x, y, 9 * p + 8 if x == y == 0 else 0) for p in range(2) for x in range(2) for y in range(2)]


def test_running_and_ranks_keep_null_groups_and_scores(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), (None, 2.0), ("b", 3.0)], "g string, s double")
    found = running(frame.selectExpr("*", "1 AS n"), ["g"], "s", {"upto": "n"}).collect()
    assert sorted((r.g or "", r.s or 0.0, r.upto) for r in found) == [("", 2.0, 2), ("", 2.0, 2), ("a", 0.0, 1), ("a", 1.0, 2), ("b", 3.0, 1)]
    ranked = metrics.percentile_rank(frame, ["g"], "s").collect()
    assert sorted((r.g or "", r.s or 0.0, r.percentile) for r in ranked if r.s) == [("", 2.0, 75.0), ("", 2.0, 75.0), ("a", 1.0, 100.0), ("b", 3.0, 100.0)]
    assert [r.percentile for r in ranked if r.s is None] == [None]


@pytest.mark.parametrize("buckets", [2, 70, 5000])
def test_places_do_not_depend_on_buckets(spark, buckets):
    rows = [(k % 3 if k % 7 else None, f"k{k * 7919 % 1000:04d}", k * 7919 % 1000) for k in range(1000)]
    frame = spark.createDataFrame(rows, "g int, name string, number int")
    for order in ("name", "number"):
        found = {(r[order], r.place) for r in placed(frame, ["g"], [order], "place", buckets).collect()}
        want = set()
        for g in (None, 0, 1, 2):
            want |= {(x, k + 1) for k, x in enumerate(sorted(r[1] if order == "name" else r[2] for r in rows if r[0] == g))}
        assert found == want


def test_stratified_split_equals_plain_windows(spark):
    patients = spark.createDataFrame([(k, f"c{k % 3}" if k % 11 else None) for k in range(300)], "case_id long, label string")
    found = {(r.fold, r.case_id): r.split for r in splits.stratified_split(patients, 2, 5, label_share=0.5).collect()}
    for fold in range(2):
        for label in {None, "c0", "c1", "c2"}:
            own = [k for k in range(300) if (f"c{k % 3}" if k % 11 else None) == label]
            drawn = sorted(own, key=lambda k: (hashlib.md5(f"5|{fold}|{k}".encode()).hexdigest(), k))
            val, test = int(len(own) * 0.1), int(len(own) * 0.2)
            train = sorted(drawn[val + test :])
            want = dict.fromkeys(drawn[:val], "val") | dict.fromkeys(drawn[val : val + test], "test") | dict.fromkeys(train[: -(-len(train) // 2)], "train")
            assert {k: found.get((fold, k)) for k in own if (fold, k) in found} == want


def test_median_in_strips_and_regions_by_boxes(monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, (23, 31), dtype=np.uint8)
    padded = np.pad(image, 2, mode="edge")
    want = np.array([[np.median(padded[y : y + 5, x : x + 5]) for x in range(31)] for y in range(23)])
    monkeypatch.setattr(pixels, "_AT_ONCE", 31 * 25 * 4)
    assert (pixels.median(image, 5) == want).all()
    mask = np.zeros((20, 30), np.uint8)
    mask[2:10, 3:12], mask[4:8, 5:9], mask[12:18, 15:28], mask[14:16, 18:20] = 255, 0, 255, 0
    found = pixels.contours(mask)
    boxes = [(min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p), parent) for p, parent in found]
    assert boxes == [(3, 2, 11, 9, None), (15, 12, 27, 17, None), (4, 3, 9, 8, 0), (17, 13, 20, 16, 1)]
