"""Projection and join queries over order, part and line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import rows, splits
from tesserae.plans.proxies import CLASSES, CLASSES_SQL, SLIDES_SQL, VOTES, VOTES_SQL, slides, table
from tesserae.plans.registry import query

_N = f"WITH {SLIDES_SQL}, {CLASSES_SQL}, {VOTES_SQL}"


@query("prj_01_strict_labels", f"{_N} SELECT slide_id, label_id::INT AS label_id FROM slides JOIN classes USING (label)")
def strict_labels(spark, sf_dir):
    return splits.dictionary(slides(spark, sf_dir), "label", CLASSES, "label_id", strict=True).select("slide_id", "label_id")


@query("prj_02_lenient_labels", f"{_N} SELECT slide_id, vote_id::INT AS vote_id FROM slides LEFT JOIN votes USING (vote)")
def lenient_labels(spark, sf_dir):
    return splits.dictionary(slides(spark, sf_dir), "vote", VOTES, "vote_id").select("slide_id", "vote_id")


@query("prj_03_alias", f"{_N} SELECT slide_id, label AS first_label, label FROM slides")
def alias(spark, sf_dir):
    return slides(spark, sf_dir).select("slide_id", F.col("label").alias("first_label"), "label")


@query("prj_04_keep_in", f"{_N} SELECT slide_id FROM slides WHERE label IN ('BUILDING', 'MACHINERY') AND status IN ('F', 'O')")
def keep_in(spark, sf_dir):
    return rows.keep_in(slides(spark, sf_dir), {"label": ["BUILDING", "MACHINERY"], "status": ["F", "O"]}).select("slide_id")


@query("prj_05_drop_in", f"{_N} SELECT slide_id FROM slides WHERE label NOT IN ('BUILDING')")
def drop_in(spark, sf_dir):
    return rows.drop_in(slides(spark, sf_dir), "label", ["BUILDING"]).select("slide_id")


@query("prj_06_active_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_linestatus = 'O'")
def active_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("prj_07_complete_rows", f"{_N} SELECT slide_id, vote_id::INT AS vote_id FROM slides JOIN votes USING (vote)")
def complete_rows(spark, sf_dir):
    labelled = splits.dictionary(slides(spark, sf_dir), "vote", VOTES, "vote_id").select("slide_id", "vote_id", F.lit(None).cast("string").alias("site"))
    return rows.complete_rows(labelled, "site")[0]


@query("prj_07b_rows_dropped", f"{_N} SELECT count(*) AS n FROM slides WHERE vote NOT IN (SELECT vote FROM votes)")
def rows_dropped(spark, sf_dir):
    labelled = splits.dictionary(slides(spark, sf_dir), "vote", VOTES, "vote_id").select("slide_id", "vote_id")
    return labelled.agg(rows.complete_rows(labelled, "site")[1].alias("n"))


@query("prj_08_semi_by_list", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_by_list(spark, sf_dir):
    """JN-03 as well."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("jn_04_anti_by_list", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_by_list(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_DEFAULTS = {"seg_level": -1, "sthresh": 8, "mthresh": 7, "use_otsu": False, "contour_fn": "four_pt"}


@query(
    "prj_09_defaults",
    "SELECT p_partkey AS slide_id, coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size END, 8)::INT AS sthresh, CASE WHEN p_size % 3 = 0 THEN 'center' ELSE 'four_pt' END AS contour_fn, -1 AS seg_level, 7 AS mthresh, false AS use_otsu FROM part",
)
def defaults(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    given = part.select(F.col("p_partkey").alias("slide_id"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("sthresh"), F.when(F.col("p_size") % 3 == 0, "center").alias("contour_fn"))
    return rows.with_defaults(given, _DEFAULTS)


@query("prj_10_legacy_area", "SELECT p_partkey AS slide_id, -1 AS seg_level, trunc(p_retailprice * 16 * 16.5::DOUBLE / 262144)::INT AS a_t FROM part")
def legacy_area(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("slide_id"), F.lit(-1).alias("seg_level"), rows.legacy_area(F.col("p_retailprice"), F.lit(16), F.lit(16.5)).alias("a_t"))


@query("prj_11_preset", "SELECT p_partkey AS slide_id, 4 AS size, p_brand AS brand FROM part")
def preset(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return rows.override(part, {"size": 4, "unknown": 1})


_IDS = "CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE concat(p_size, ', ', p_partkey % 7) END"
_IDS_SQL = "CASE WHEN p_size % 3 = 2 THEN [p_size, (p_partkey % 7)::INT] ELSE []::INT[] END"


@query("prj_12_id_list", f"SELECT p_partkey AS slide_id, array_to_string({_IDS_SQL}, ',') AS ids FROM part")
def id_list(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("slide_id"), F.array_join(rows.id_list(F.expr(_IDS)), ",").alias("ids"))


@query(
    "prj_13_keep_ids",
    f"""WITH k AS (SELECT p_partkey, {_IDS_SQL} AS k FROM part)
SELECT p_partkey AS slide_id, coalesce(array_to_string(list_filter(range(0, 7), lambda i: (len(k) = 0 OR list_contains(k, i)) AND i <> 3), ','), '') AS ids FROM k""",
)
def keep_ids(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = rows.keep_ids(F.sequence(F.lit(0), F.lit(6)), rows.id_list(F.expr(_IDS)), F.array(F.lit(3)))
    return part.select(F.col("p_partkey").alias("slide_id"), F.array_join(F.sort_array(found), ",").alias("ids"))


@query("prj_19_in_region", "SELECT event_id, value FROM events WHERE value BETWEEN 20 AND 40 AND user_id BETWEEN 10 AND 90")
def in_region(spark, sf_dir):
    """Both ends count."""
    return table(spark, sf_dir, "events").where(F.col("value").between(20, 40) & F.col("user_id").between(10, 90)).select("event_id", "value")


@query("prj_20_not_done", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def not_done(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return rows.not_done(table(spark, sf_dir, "part").select("p_partkey"), done, "p_partkey")


@query("prj_21_strip_extension", r"SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '') AS stem FROM pages")
def strip_extension(spark, sf_dir):
    name = F.regexp_extract("url", "[^/]*$", 0)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))


@query("prj_23_fraction", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END, 6) AS share FROM lineitem")
def fraction(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(rows.fraction(F.col("l_quantity")), 6).alias("share"))


@query("prj_24_validation", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_nationkey > 20 THEN 'site' END) AS errors FROM customer WHERE c_acctbal < 0 OR c_nationkey > 20")
def validation(spark, sf_dir):
    _, bad = rows.validated(table(spark, sf_dir, "customer"), {"balance": F.col("c_acctbal") >= 0, "site": F.col("c_nationkey") <= 20})
    return bad.select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query("jn_01_slide_patient", f"{_N} SELECT slide_id, case_id, n_name AS site FROM slides JOIN nation ON site = n_nationkey")
def slide_patient(spark, sf_dir):
    return slides(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("site") == F.col("n_nationkey")).select("slide_id", "case_id", F.col("n_name").alias("site"))


@query("jn_05_keyed_bags", "SELECT e.vec_id, d.label, d.n FROM embeddings e JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) d USING (label)")
def keyed_bags(spark, sf_dir):
    """Bags meet their labels by key, not by position."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label").join(vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")


@query("jn_06_tile_params", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_size, p_type FROM lineitem JOIN part ON l_partkey = p_partkey")
def tile_params(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "p_size", "p_type")


@query("jn_08_parent_child", "SELECT n.n_nationkey AS child, r.r_regionkey AS parent, r.r_name AS parent_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def parent_child(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").alias("child"), F.col("r_regionkey").alias("parent"), F.col("r_name").alias("parent_name"))


@query("jn_10_by_source", "SELECT 'customer' AS source, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier', count(*), round(sum(s_acctbal), 2) FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def by_source(spark, sf_dir):
    """Bags of several directories: a union with the source as a column, joined by source and key."""
    one = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    two = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    joined = one.unionByName(two).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), "k")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))
