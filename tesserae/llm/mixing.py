"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document's expected number of copies is its source's
target over the source's size. Its whole part is certain: so many copies of every document.
The rest is the inclusion probability p of one more copy, drawn without replacement: with a
uniform u from a hash of seed and id, documents rank by the odds u/(1-u) over the odds p/(1-p),
and a source takes them in that order up to the size that its target still lacks. The last
document is taken if that brings the source nearer its target.

Inclusion probabilities differ between sources and are equal within one: the target is a source's,
and a document of it has no other claim to be drawn. ``weight_col`` gives documents one: expected
copies are then in proportion to that weight within the source, none above ``most``, and
probabilities differ from document to document.

The rank cut needs no sort of a whole source. u falls into bins by rank; the words of each
(source, bin) are summed before the shuffle, a running sum over the bins finds the bin in which
the cut falls, and only that bin's documents are ranked one by one. Bins are so many that the
cut bin holds about 1/65536 of a source, whatever the source's share of the rows.

Weights and targets are settled on the table of sources alone (a row each). Sources are the
components of a mix and are ranked against each other, so that table is small by nature.

Defined results: null text and text without words have size 0 and are never taken; a null
source is a source of its own, last in order; documents with equal u rank by id, repeated ids by
their text's hash; an empty table gives an empty mix; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORDS, boxed, cut, text_of, unboxed

#: Fixed values of the contract: weights by source order, total share, most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BINS = 1 << 16
SEED = "mix-1"


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """In (0, 1), from 48 bits of a hash of seed and key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources share ``share`` of all sizes by weight, none above ``most`` times its size; what a
    capped source leaves goes to the others by weight. That settles at target = least(cap,
    weight * level): sources are capped in the order of cap over weight, so running sums over
    that order find the level.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    capped = sizes.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), turn)).withColumn("cap", F.col("source_size") * most)
    whole = Window.partitionBy()
    fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = (
        capped.withColumn("total", F.sum("source_size").over(whole) * share)
        .withColumn("level", level)
        # The first source in fill order that the level doesn't reach sets the level of all that follow.
        .withColumn("open", F.col("weight") * F.col("level") < F.col("cap"))
        .withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return filled.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    bins: int = BINS,
    weight_col: str | None = None,
) -> DataFrame:
    """(id, source, tie, size, source_size, target, copies) for every row of ``docs``."""
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(text_col).alias("tie"),
        words_in(text_of(text_col)).alias("size"),
        (F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)).alias("weight"),
    ).withColumn("u", uniform(F.col("id"), seed))
    share_of = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    if weight_col:
        plan, rate = _weighted(sized, share_of, most), F.least(F.col("level") * F.col("weight"), F.lit(most))
    else:
        plan, rate = share_of.withColumn("level", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), F.col("level")
        plan = plan.withColumn("lacks", F.col("target") - F.floor("level") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "of")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = (
        sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("whole", F.floor(rate))
        .withColumn("p", rate - F.col("whole"))
        .withColumn("rank", F.when(F.col("p") > 0, odds))
        # Any rising function of the rank will do for a bin.
        .withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * bins).cast("int"))
    )
    by_bin = ranked.where("rank IS NOT NULL").groupBy("of", "bin").agg(F.sum("size").alias("words"), F.first("lacks").alias("lacks"))
    rising = Window.partitionBy("of").orderBy("bin")
    cuts = (
        by_bin.withColumn("upto", F.sum("words").over(rising))
        .where(F.col("upto") >= F.col("lacks"))
        .groupBy("of")
        .agg(F.min_by("bin", "bin").alias("cut"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before"))
    )
    cuts = cuts.withColumnRenamed("of", "cut_of")
    placed = ranked.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left")
    at_cut = placed.where("bin = cut").select("of", "id", "tie", "size", "rank", "lacks", "before")
    one_by_one = Window.partitionBy("of").orderBy("rank", "id", "tie")
    cut_rank = (
        at_cut.withColumn("below", F.col("before") + F.sum("size").over(one_by_one.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        # Taken while the middle of the document is below what the source lacks.
        .where(2 * F.col("below") + F.col("size") <= 2 * F.col("lacks"))
        .groupBy("of")
        .agg(F.max(F.struct("rank", "id", "tie")).alias("last"))
        .withColumnRenamed("of", "last_of")
    )
    done = placed.join(cut_rank, F.col("of").eqNullSafe(F.col("last_of")), "left")
    extra = (
        F.when(F.col("rank").isNull(), False)
        .when(F.col("cut").isNull() | (F.col("bin") < F.col("cut")), True)
        .when(F.col("bin") > F.col("cut"), False)
        .otherwise(F.coalesce(F.struct("rank", "id", "tie") <= F.col("last"), F.lit(False)))
    )
    return done.select("id", "source", "tie", "size", "source_size", "target", (F.col("whole") + extra.cast("long")).alias("copies"))


def _weighted(sized: DataFrame, share_of: DataFrame, most: float) -> DataFrame:
    """``share_of`` with the level that times a document's weight is its expected copies, and the words that whole copies lack.

    Documents that the level takes above ``most`` copies are held there, which raises the level for the others;
    every turn holds more of them, until none is left to hold.
    """

    def of(level: Column, value: Column) -> Column:
        return F.sum(F.when(level * F.col("weight") >= most, 0.0).otherwise(value))

    level, before = F.lit(0.0), None
    plan = share_of.withColumn("level", F.lit(0.0))
    while True:
        level = F.col("level")
        joined = sized.join(plan.select(F.col("source").alias("of"), "level"), F.col("source").eqNullSafe(F.col("of")))
        sums = joined.groupBy("of").agg(of(level, F.col("weight") * F.col("size")).alias("open"), F.sum(F.when(level * F.col("weight") >= most, F.col("size")).otherwise(0)).alias("held"))
        raised = F.when(F.col("open") > 0, (F.col("target") - most * F.col("held")) / F.col("open")).otherwise(F.col("level"))
        plan = cut(share_of.join(plan.select(F.col("source").alias("was"), "level"), F.col("source").eqNullSafe(F.col("was"))).join(sums, F.col("source").eqNullSafe(F.col("of"))).select("source", "source_size", "target", raised.alias("level"), "held"))
        now = tuple(plan.agg(F.sum("held"), F.count(F.lit(1))).first())
        if now == before:
            break
        before = now
    joined = sized.join(plan.select(F.col("source").alias("of"), "level"), F.col("source").eqNullSafe(F.col("of")))
    whole = joined.groupBy("of").agg(F.sum(F.floor(F.least(F.col("level") * F.col("weight"), F.lit(most))) * F.col("size")).alias("whole_words"))
    found = plan.join(whole, F.col("source").eqNullSafe(F.col("of")))
    return found.select("source", "source_size", "target", "level", (F.col("target") - F.col("whole_words")).alias("lacks"))


def repeat(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; size 0 is never taken."""
    copies = mixed.where("size > 0 AND copies > 0").groupBy(F.col("id").alias("of"), F.col("tie").alias("of_tie")).agg(F.max("copies").alias("copies"))
    given = boxed(docs).select("doc", F.col(f"doc.`{id_col}`").alias("id"), F.xxhash64(f"doc.`{text_col}`").alias("tie"))
    taken = given.join(copies, F.col("id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("of_tie")))
    return unboxed(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs.columns)
