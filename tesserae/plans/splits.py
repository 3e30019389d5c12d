"""Split queries over patients and slides."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import splits
from tesserae.plans.proxies import CLASSES, CLASSES_SQL, SLIDES_SQL, VOTES, VOTES_SQL, slides, table
from tesserae.plans.registry import query

FOLDS, SEED = 3, 1
_NAMED = f"WITH {SLIDES_SQL}, {CLASSES_SQL}, {VOTES_SQL}"
_PATIENTS = "patients AS (SELECT case_id, max(label) AS label FROM slides GROUP BY case_id)"
_SPLIT = f"""{_NAMED}, {_PATIENTS}, folds AS (SELECT unnest(range(0, {FOLDS}))::INT AS fold),
ranked AS (
  SELECT fold, case_id, label, count(*) OVER (PARTITION BY fold, label) AS n,
         row_number() OVER (PARTITION BY fold, label ORDER BY md5('{SEED}|' || fold || '|' || case_id), case_id) AS r
  FROM patients, folds
), split AS (
  SELECT fold, case_id, label, CASE WHEN r <= floor(n * 0.1::DOUBLE) THEN 'val' WHEN r <= floor(n * 0.1::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split
  FROM ranked
), split_slides AS (SELECT fold, split, slide_id, case_id, split.label FROM split JOIN slides USING (case_id))"""


def _patients(spark, sf_dir):
    return splits.vote_max(slides(spark, sf_dir), "label")


def _split(spark, sf_dir):
    return splits.stratified_split(_patients(spark, sf_dir), FOLDS, SEED)


def _voted(spark, sf_dir):
    return splits.dictionary(slides(spark, sf_dir), "vote", VOTES, "vote_id")


def _forced(spark, sf_dir):
    """The forced list: patients with an urgent order that is still open, of the highest site."""
    s = slides(spark, sf_dir)
    return s.where("vote = '1-URGENT' AND status = 'P' AND site = 24").select("case_id").distinct()


_FORCED = "forced AS (SELECT DISTINCT case_id FROM slides WHERE vote = '1-URGENT' AND status = 'P' AND site = 24)"


@query("agg_01_vote_max", f"{_NAMED} SELECT case_id, max(vote_id) AS label FROM slides LEFT JOIN votes USING (vote) GROUP BY case_id")
def vote_max(spark, sf_dir):
    return splits.vote_max(_voted(spark, sf_dir), "vote_id")


_MODE = f"""{_NAMED}, c AS (SELECT case_id, vote_id, count(vote_id) AS n FROM slides LEFT JOIN votes USING (vote) GROUP BY ALL),
r AS (SELECT case_id, vote_id, row_number() OVER (PARTITION BY case_id ORDER BY vote_id IS NULL, n DESC, vote_id) AS k FROM c)"""


@query("agg_02_vote_majority", f"{_MODE} SELECT case_id, vote_id AS label FROM r WHERE k = 1")
def vote_majority(spark, sf_dir):
    return splits.vote_majority(_voted(spark, sf_dir), "vote_id")


@query("agg_03_class_mode", f"{_MODE} SELECT case_id, coalesce(vote_id, -1) AS label FROM r WHERE k = 1")
def class_mode(spark, sf_dir):
    return splits.vote_majority(_voted(spark, sf_dir), "vote_id", -1)


@query("agg_04_slides_of_patient", f"{_NAMED} SELECT case_id, count(*) AS n, string_agg(slide_id, ',' ORDER BY slide_id) AS slides FROM slides GROUP BY case_id")
def slides_of_patient(spark, sf_dir):
    found = slides(spark, sf_dir).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("slide_id")).alias("slides"))
    return found.withColumn("slides", F.array_join("slides", ","))


@query(
    "agg_05_class_ids",
    f"""{_NAMED}, p AS (SELECT case_id, max(vote_id) AS vote_id FROM slides LEFT JOIN votes USING (vote) GROUP BY case_id), d AS (SELECT unnest(range(0, 6)) AS k)
SELECT k::INT AS class_id, (SELECT count(*) FROM p WHERE vote_id = k) AS n_patients,
       (SELECT count(*) FROM slides JOIN votes USING (vote) WHERE vote_id = k) AS n_slides FROM d""",
)
def class_ids(spark, sf_dir):
    """Every class, empty ones too."""
    voted = _voted(spark, sf_dir)
    patients = splits.vote_max(voted, "vote_id").groupBy(F.col("label").alias("class_id")).agg(F.count(F.lit(1)).alias("n_patients"))
    counted = voted.groupBy(F.col("vote_id").alias("class_id")).agg(F.count(F.lit(1)).alias("n_slides"))
    every = spark.range(6).select(F.col("id").cast("int").alias("class_id"))
    return every.join(patients, "class_id", "left").join(counted, "class_id", "left").select("class_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_patients", "n_slides")))


@query("agg_06_value_counts", f"{_NAMED} SELECT vote_id, count(*) AS n FROM slides JOIN votes USING (vote) GROUP BY vote_id")
def value_counts(spark, sf_dir):
    return _voted(spark, sf_dir).where("vote_id IS NOT NULL").groupBy("vote_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg_07_quotas", f"{_NAMED}, {_PATIENTS} SELECT label, count(*) AS n, floor(count(*) * 0.1::DOUBLE)::BIGINT AS val, floor(count(*) * 0.2::DOUBLE)::BIGINT AS test FROM patients GROUP BY label")
def quotas(spark, sf_dir):
    return splits.quotas(_patients(spark, sf_dir))


@query(
    "agg_08_forced_quotas",
    f"""{_NAMED}, {_PATIENTS}, {_FORCED}
SELECT label, count(*) AS n, count(f.case_id) AS n_forced, count(*) - count(f.case_id) AS remaining,
       greatest(floor(count(*) * 0.2::DOUBLE)::BIGINT - count(f.case_id), 0) AS test FROM patients p LEFT JOIN forced f USING (case_id) GROUP BY label""",
)
def forced_quotas(spark, sf_dir):
    marked = _patients(spark, sf_dir).join(_forced(spark, sf_dir).withColumn("f", F.lit(1)), "case_id", "left")
    n, forced = F.count(F.lit(1)), F.count("f")
    return marked.groupBy("label").agg(n.alias("n"), forced.alias("n_forced"), (n - forced).alias("remaining"), F.greatest(F.floor(n * F.lit(0.2)) - forced, F.lit(0)).alias("test"))


_FORCED_SPLIT = f"""{_NAMED}, {_PATIENTS}, {_FORCED}, folds AS (SELECT unnest(range(0, {FOLDS}))::INT AS fold),
m AS (SELECT p.case_id, p.label, f.case_id IS NOT NULL AS forced FROM patients p LEFT JOIN forced f USING (case_id)),
s AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, sum(forced::INT) OVER (PARTITION BY label) AS n_forced FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY fold, label, forced ORDER BY md5('{SEED}|' || fold || '|' || case_id), case_id) AS r FROM s, folds)
SELECT fold, case_id, label, forced, CASE WHEN forced THEN 'test' WHEN r <= floor(n * 0.1::DOUBLE) THEN 'val'
  WHEN r <= floor(n * 0.1::DOUBLE) + #more THEN 'test' ELSE 'train' END AS split FROM r"""


@query("agg_08b_forced_split", _FORCED_SPLIT.replace("#more", "greatest(floor(n * 0.2::DOUBLE) - n_forced, 0)"))
def forced_split(spark, sf_dir):
    return splits.forced_split(_patients(spark, sf_dir), _forced(spark, sf_dir), FOLDS, SEED)


@query("agg_08c_forced_split_legacy", _FORCED_SPLIT.replace("#more", "0"))
def forced_split_legacy(spark, sf_dir):
    return splits.forced_split(_patients(spark, sf_dir), _forced(spark, sf_dir), FOLDS, SEED, legacy=True)


@query(
    "agg_09_split_table",
    f"""{_SPLIT} SELECT fold, coalesce(label, 'total') AS label, count(DISTINCT case_id) FILTER (split = 'train') AS train, count(DISTINCT case_id) FILTER (split = 'val') AS val,
  count(DISTINCT case_id) FILTER (split = 'test') AS test, count(DISTINCT case_id) AS n_patients, count(*) AS n_slides
FROM split_slides GROUP BY GROUPING SETS ((fold, label), (fold))""",
)
def split_table(spark, sf_dir):
    """Patients per class and split with totals: slides are counted per patient first, so that a
    patient is a row and the totals are plain sums."""
    n = slides(spark, sf_dir).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_slides"))
    rows = _split(spark, sf_dir).join(n, "case_id")
    counts = [F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "val", "test")]
    totals = rows.rollup("fold", "label").agg(*counts, F.count(F.lit(1)).alias("n_patients"), F.sum("n_slides").alias("n_slides"))
    return totals.where("fold IS NOT NULL").withColumn("label", F.coalesce("label", F.lit("total")))


@query(
    "agg_10_split_descriptor",
    f"""{_SPLIT}, e AS (SELECT fold, classes.label, s.split FROM folds, classes, (VALUES ('train'), ('val'), ('test')) s(split))
SELECT e.fold, e.label AS class_name, e.split, count(DISTINCT case_id) AS n_patients, count(slide_id) AS n_slides FROM e LEFT JOIN split_slides USING (fold, label, split) GROUP BY ALL""",
)
def split_descriptor(spark, sf_dir):
    s = slides(spark, sf_dir)
    named = splits.to_slides(splits.assert_no_leakage(_split(spark, sf_dir), "case_id"), s)
    return splits.descriptor(named, CLASSES, FOLDS)


@query("agg_11_distinct_counts", f"{_NAMED} SELECT count(*) AS n, count(DISTINCT slide_id) AS n_slides, count(DISTINCT case_id) AS n_patients FROM slides")
def distinct_counts(spark, sf_dir):
    """Sums over patients, so that no count of distinct values expands the rows."""
    by_patient = slides(spark, sf_dir).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slide_id").alias("s"))
    return by_patient.agg(F.sum("n").alias("n"), F.sum("s").alias("n_slides"), F.count(F.lit(1)).alias("n_patients"))


@query("top_09_stratified_split", f"{_SPLIT} SELECT fold, case_id, label, split FROM split")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query(
    "top_10_prefix_fraction",
    f"""{_SPLIT}, p AS (SELECT *, row_number() OVER (PARTITION BY fold, label, split ORDER BY case_id) AS k, count(*) OVER (PARTITION BY fold, label, split) AS m FROM split)
SELECT fold, case_id, label, split FROM p WHERE split <> 'train' OR k <= ceil(m * 0.25::DOUBLE)""",
)
def prefix_fraction(spark, sf_dir):
    return splits.stratified_split(_patients(spark, sf_dir), FOLDS, SEED, label_share=0.25)


@query("top_11_held_out", f"{_SPLIT} SELECT case_id, label FROM split WHERE fold = 0 AND split = 'test'")
def held_out(spark, sf_dir):
    return splits.stratified_split(_patients(spark, sf_dir), 1, SEED).where("split = 'test'").select("case_id", "label")


@query("top_15_nth_split", f"{_SPLIT} SELECT case_id, label, split FROM split WHERE fold = 2")
def nth_split(spark, sf_dir):
    return _split(spark, sf_dir).where("fold = 2").select("case_id", "label", "split")


@query("jn_02_split_slides", f"{_SPLIT} SELECT * FROM split_slides")
def split_slides(spark, sf_dir):
    return splits.to_slides(_split(spark, sf_dir), slides(spark, sf_dir))


@query(
    "set_02_leakage",
    f"""{_SPLIT}, i AS (SELECT DISTINCT fold, slide_id % 1000 AS key, split FROM split_slides)
SELECT f.fold, a AS one, b AS other, (SELECT count(*) FROM i x JOIN i y USING (fold, key) WHERE x.fold = f.fold AND x.split = a AND y.split = b) AS n
FROM folds f, (VALUES ('test', 'train'), ('test', 'val'), ('train', 'val')) p(a, b)""",
)
def leakage(spark, sf_dir):
    """By a key that does leak: batches of slides that cut across patients."""
    named = splits.to_slides(_split(spark, sf_dir), slides(spark, sf_dir)).withColumn("key", F.col("slide_id") % 1000)
    return splits.leakage(named, "key")


@query("set_07_patient_leakage", f"{_SPLIT} SELECT fold, a AS one, b AS other, 0::BIGINT AS n FROM folds, (VALUES ('test', 'train'), ('test', 'val'), ('train', 'val')) p(a, b)")
def patient_leakage(spark, sf_dir):
    return splits.leakage(splits.to_slides(_split(spark, sf_dir), slides(spark, sf_dir)), "case_id")


@query("set_01_unique_cases", f"{_NAMED} SELECT DISTINCT case_id FROM slides")
def unique_cases(spark, sf_dir):
    return slides(spark, sf_dir).select("case_id").distinct()


@query("set_03_remaining", f"{_SPLIT} SELECT case_id FROM patients EXCEPT SELECT case_id FROM split WHERE fold = 0 AND split IN ('val', 'test')")
def remaining(spark, sf_dir):
    drawn = _split(spark, sf_dir).where("fold = 0 AND split IN ('val', 'test')").select("case_id")
    return _patients(spark, sf_dir).select("case_id").subtract(drawn)


@query("set_04_merged_splits", f"{_SPLIT} SELECT fold, case_id FROM split WHERE split = 'train' UNION ALL SELECT fold, case_id FROM split WHERE split = 'val'")
def merged_splits(spark, sf_dir):
    s = _split(spark, sf_dir)
    return s.where("split = 'train'").select("fold", "case_id").unionByName(s.where("split = 'val'").select("fold", "case_id"))


@query(
    "set_05_ragged_splits",
    f"""{_SPLIT}, p AS (SELECT fold, split, case_id, row_number() OVER (PARTITION BY fold, split ORDER BY case_id)::INT AS row FROM split)
SELECT fold, row, max(case_id) FILTER (split = 'train') AS train, max(case_id) FILTER (split = 'val') AS val, max(case_id) FILTER (split = 'test') AS test FROM p GROUP BY fold, row""",
)
def ragged_splits(spark, sf_dir):
    return splits.ragged(_split(spark, sf_dir), "case_id")


@query("set_06_one_hot", f"{_SPLIT} SELECT fold, slide_id, split = 'train' AS train, split = 'val' AS val, split = 'test' AS test FROM split_slides")
def one_hot(spark, sf_dir):
    return splits.one_hot(splits.to_slides(_split(spark, sf_dir), slides(spark, sf_dir)), "slide_id")


@query("agg_21_class_weights", f"{_NAMED}, c AS (SELECT label, count(*) AS n FROM slides GROUP BY label) SELECT label, n, sum(n) OVER () / n::DOUBLE AS weight FROM c")
def class_weights(spark, sf_dir):
    return splits.balanced_weights(slides(spark, sf_dir), "label")


@query("prj_25_split_view", f"{_SPLIT} SELECT label, count(*) AS n_slides, count(DISTINCT case_id) AS n_patients FROM split_slides WHERE fold = 1 AND split = 'val' GROUP BY label")
def split_view(spark, sf_dir):
    view = splits.to_slides(_split(spark, sf_dir), slides(spark, sf_dir)).where("fold = 1 AND split = 'val'")
    return view.groupBy("label").agg(F.count(F.lit(1)).alias("n_slides"), F.count_distinct("case_id").alias("n_patients"))


@query("src_28_split_lists", f"{_SPLIT} SELECT fold, split, string_agg(case_id, ',' ORDER BY case_id) AS patients FROM split GROUP BY fold, split")
def split_lists(spark, sf_dir):
    lists = _split(spark, sf_dir).groupBy("fold", "split").agg(F.sort_array(F.collect_list("case_id")).alias("patients"))
    return lists.withColumn("patients", F.array_join("patients", ","))


@query("win_04_dense_position", f"{_NAMED} SELECT slide_id, dense_rank() OVER (ORDER BY case_id) - 1 AS patient_index FROM slides")
def dense_position(spark, sf_dir):
    """Numbers are given to the sorted patients (a distinct list) and joined back to their slides."""
    from tesserae.operators.numbering import numbered

    s = slides(spark, sf_dir)
    places = numbered(s.select("case_id").distinct(), "case_id", "patient_index")
    return s.join(places, "case_id").select("slide_id", "patient_index")
