"""Catalogue queries: slide files' pages and descriptions, listings, event-time rates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tesserae.plans.proxies import table
from tesserae.plans.rasters import _PX, pixels
from tesserae.plans.registry import query
from tesserae.session import ship
from tesserae.streaming.arrivals import windowed_rates


@query("src_08_main_page", "SELECT l_orderkey AS file, arg_max(l_linenumber, struct_pack(a := l_returnflag = 'R', b := l_quantity * l_tax, c := -l_linenumber, d := l_partkey)) AS main FROM lineitem GROUP BY l_orderkey")
def main_page(spark, sf_dir):
    """Lines as the pages of a file: tiled first, then the largest, the first of equals."""
    pages = table(spark, sf_dir, "lineitem")
    rank = F.struct((F.col("l_returnflag") == "R").alias("a"), (F.col("l_quantity") * F.col("l_tax")).alias("b"), (-F.col("l_linenumber")).alias("c"), F.col("l_partkey").alias("d"))
    return pages.groupBy(F.col("l_orderkey").alias("file")).agg(F.max_by("l_linenumber", rank).alias("main"))


@query("src_09_first_description", "SELECT c_nationkey AS file, min(c_custkey) FILTER (c_name LIKE '%7%') AS page FROM customer GROUP BY c_nationkey")
def first_description(spark, sf_dir):
    """The first page whose description has a marker."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("file")).agg(F.min(F.when(F.col("c_name").contains("7"), F.col("c_custkey"))).alias("page"))


_OME = (
    '<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Instrument><Objective NominalMagnification="20"/></Instrument>'
    '<Image><Pixels SizeX="%d" SizeY="100" PhysicalSizeX="%d" PhysicalSizeXUnit="nm"><TiffData IFD="%d"/></Pixels></Image>'
    '<Image><Pixels SizeX="50" SizeY="50" PhysicalSizeX="0.25" PhysicalSizeXUnit="µm"><TiffData IFD="9"/></Pixels></Image></OME>'
)


@arrow_udf(T.StructType().add("mpp_x", "double").add("objective", "double").add("width", "integer"))
def _described(texts: pa.Array, mains: pa.Array) -> pa.Array:
    from tesserae.sources.tiff import ome

    found = [ome(t, m) for t, m in zip(texts.to_pylist(), mains.to_pylist(), strict=True)]
    return pa.array([{k: f[k] for k in ("mpp_x", "objective", "width")} for f in found], pa.struct([("mpp_x", pa.float64()), ("objective", pa.float64()), ("width", pa.int32())]))


@query(
    "src_10_ome_choice",
    """SELECT p_partkey AS slide_id, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_partkey % 3 = 2 OR p_size <= 25 THEN round(p_size * 10 / 1000.0::DOUBLE, 9) ELSE 0.25 END AS mpp_x,
  CASE WHEN p_size % 4 <> 3 THEN 20 END::DOUBLE AS objective, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_partkey % 3 = 2 OR p_size <= 25 THEN p_size ELSE 50 END::INT AS width FROM part""",
)
def ome_choice(spark, sf_dir):
    """By directory, else by the smallest physical size; a cut-off text gives nothing."""
    ship(spark)
    part = table(spark, sf_dir, "part")
    whole = F.format_string(_OME, "p_size", F.col("p_size") * 10, (F.col("p_partkey") % 3).cast("int"))
    text = F.when(F.col("p_size") % 4 == 3, F.substring(whole, 1, 80)).otherwise(whole)
    found = part.select(F.col("p_partkey").alias("slide_id"), _described(text, F.lit(2)).alias("d"))
    return found.select("slide_id", F.round("d.mpp_x", 9).alias("mpp_x"), "d.objective", "d.width")


@query("src_14_strided", f"{_PX} SELECT patch, count(*) AS n, sum(r)::BIGINT AS r FROM px WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY patch")
def strided(spark, sf_dir):
    """Every other pixel of every other row."""
    kept = pixels(spark, sf_dir).where("x % 2 = 0 AND y % 2 = 0")
    return kept.groupBy("patch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r").cast("long")).alias("r"))


@query("src_20_features_of_sources", "SELECT source, label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) AS first FROM (SELECT 'a' AS source, * FROM embeddings WHERE label < 5 UNION ALL SELECT 'b', * FROM embeddings WHERE label >= 5) GROUP BY source, label")
def features_of_sources(spark, sf_dir):
    """Bags of two directories under one source column."""
    rows = table(spark, sf_dir, "embeddings")
    both = rows.where("label < 5").withColumn("source", F.lit("a")).unionByName(rows.where("label >= 5").withColumn("source", F.lit("b")))
    return both.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 6).alias("first"))


@query("str_01_hourly_rates", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_rates(spark, sf_dir):
    """The streaming window aggregate run over the whole table."""
    return windowed_rates(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))
