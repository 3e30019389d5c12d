"""Sampling and ranking queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import metrics, sampling
from tesserae.plans.proxies import table
from tesserae.plans.registry import query


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")


@query("top_03_highest", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def highest(spark, sf_dir):
    return sampling.first_k(events(spark, sf_dir), "value", "event_id", 25).select("event_id", "value")


@query("top_03b_lowest", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 25")
def lowest(spark, sf_dir):
    return sampling.first_k(events(spark, sf_dir), "value", "event_id", 25, descending=False).select("event_id", "value")


@query("top_05_range_sample", "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 20 ORDER BY md5('7|' || event_id), event_id LIMIT 40")
def range_sample(spark, sf_dir):
    return sampling.range_sample(events(spark, sf_dir), "value", "event_id", 10, 20, 40, 7).select("event_id", "value")


@query(
    "top_04_roi_sampler",
    """WITH p AS (SELECT event_id, user_id, (rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY user_id) * 100 AS pct FROM events)
SELECT event_id, round(pct, 6) AS percentile FROM p WHERE user_id BETWEEN 10 AND 60 ORDER BY round(pct, 6) DESC, event_id LIMIT 30""",
)
def roi_sampler(spark, sf_dir):
    """Percentile, screen by region, top k."""
    ranked = metrics.percentile_rank(events(spark, sf_dir), ["user_id"], "value").withColumn("percentile", F.round("percentile", 6))
    return sampling.first_k(ranked.where(F.col("user_id").between(10, 60)), "percentile", "event_id", 30).select("event_id", "percentile")


@query("top_13_sampled_order", "SELECT event_id, row_number() OVER (ORDER BY md5('3|' || event_id), event_id) AS place FROM events")
def sampled_order(spark, sf_dir):
    """TOP-17 too: a shuffle is the order of the draws."""
    from tesserae.operators.numbering import numbered

    number = F.conv(F.substring(sampling.drawn(3, F.col("event_id")), 1, 12), 16, 10).cast("long")
    placed = numbered(events(spark, sf_dir).select("event_id", number.alias("draw")), "draw", "place")
    return placed.select("event_id", (F.col("place") + 1).alias("place"))


@query("top_14_patch_sample", "SELECT event_id FROM events ORDER BY md5('5|' || event_id), event_id LIMIT 100")
def patch_sample(spark, sf_dir):
    return sampling.sample(events(spark, sf_dir), "event_id", 100, 5).select("event_id")


@query(
    "top_12_weighted_sample",
    """WITH w AS (SELECT p_partkey, p_size AS weight FROM part), e AS (SELECT p_partkey, sum(weight) OVER (ORDER BY p_partkey) - weight AS lo, sum(weight) OVER (ORDER BY p_partkey) AS hi FROM w),
d AS (SELECT p_partkey AS draw, ('0x' || substr(md5('9|' || p_partkey), 1, 12))::BIGINT % (SELECT sum(weight) FROM w) AS at FROM w)
SELECT d.draw, e.p_partkey FROM d JOIN e ON d.at >= e.lo AND d.at < e.hi""",
)
def weighted_sample(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("weight"))
    return sampling.weighted_with_replacement(part, "p_partkey", "weight", 9)


@query("win_05_grid_cells", "SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) % 10 AS column, (row_number() OVER (ORDER BY vec_id) - 1) // 10 AS row FROM embeddings")
def grid_cells(spark, sf_dir):
    return sampling.grid_cells(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


@query("win_07_ring_buffer", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def ring_buffer(spark, sf_dir):
    return sampling.last_n(events(spark, sf_dir).select("user_id", "event_id"), "user_id", "event_id", 20)


@query("top_02_sorted_ids", "SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM (SELECT * FROM events WHERE event_type = 'signup') GROUP BY user_id")
def sorted_ids(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'signup'").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_id")), ",").alias("ids"))
