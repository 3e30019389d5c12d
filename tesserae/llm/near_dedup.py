"""MinHash near-dedup with tensored banding.

Two small collections of minhash groups (halves) are drawn per set of word shingles: ``SIDE``
halves of ``DEPTH`` minhashes each. A table's key combines a half of the first collection with
a half of the second, so SIDE * SIDE tables of 2 * DEPTH minhashes each need only
2 * SIDE * DEPTH minhash functions, about the square root of what separate tables would need.
Two sets with Jaccard similarity s meet in some table with probability
(1 - (1 - s**DEPTH)**SIDE)**2: 0.9996 at s = 0.8.

1. Each text becomes its set's size, identity and halves. Equal sets form a class, represented
   by its smallest id, before anything is compared.
2. Every class is compared with a centre first: the smallest class of most of its halves among
   those that share a half of either collection with it, and so a table.
3. Only halves whose classes are in several components by now are combined to keys, so the large
   groups of copies, joined to their centre, make no table entries at all. The next round compares
   all centres of an entry that still holds several components. The last one takes the pairs across
   components that are left: the classes outside an entry's largest component, dealt by entry and
   band of sizes, against those of other components in these bands, each pair only from the first
   table in which it meets, unless distances to a shared centre (Jaccard distance obeys the
   triangle inequality) or bitmaps rule the similarity out: where two bitmaps of sets differ the
   sets do, so counting those bits bounds the overlap from above. None of these loses a link.
4. Every candidate is confirmed on the full sets (64-bit shingle hashes). Confirmed links join
   components by alternating large and small stars, in tables, until nothing changes.

Similarities are compared as ``100 * intersection >= percent * union`` in whole numbers.

Defined results: null text and text without words have the empty set and are linked with
nothing; text with fewer words than a shingle is one shingle; rows that repeat an id are one
document with the links of all its texts; rows without an id are linked with nothing; ids are
whole numbers or text that is one (other ids are an error); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import boxed, cut, discard, in_arrow, saved, unboxed

WORDS_PER_SHINGLE, PERCENT = 5, 80
SIDE, DEPTH = 16, 4
#: 64-bit numbers in the bitmap of a set.
BITMAP = 8
#: Ids up to which a filter by id is sent to all executors instead of dealing the texts by id.
BROADCAST_ROWS = 500_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the minhash functions."""
    n = 2 * SIDE * DEPTH
    drawn = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _STEP)
    return (drawn[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The set of each text as sorted 64-bit hashes."""
    split = [(t or "").encode().lower().split() for t in texts]
    coded = pa.array([w for x in split for w in x], pa.binary()).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    every = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.array([], np.uint64)
    at = 0
    for found in split:
        n, own = len(found), every[at : at + len(found)]
        at += n
        if not n:
            yield own
            continue
        size = min(words, n)
        rolled = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            rolled = rolled * _STEP + own[k : n - size + 1 + k]
        yield np.unique(_mixed(rolled))


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit set for every shingle, by its lowest bits."""
    found = np.zeros(BITMAP, np.uint64)
    np.bitwise_or.at(found, (shingles >> np.uint64(6) & np.uint64(BITMAP - 1)).astype(int), np.uint64(1) << (shingles & np.uint64(63)))
    return found


def _halves(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """2 * SIDE hashes of DEPTH minhashes each."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        np.minimum(least, (factors[:, None] * low[None, k : k + 4096] + offsets[:, None]).min(axis=1), out=least)
    grouped = least.reshape(2 * SIDE, DEPTH).astype(np.uint64)
    half = np.arange(2 * SIDE, dtype=np.uint64)
    for k in range(DEPTH):
        half = _mixed(half * _STEP + grouped[:, k])
    return half


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    factors, offsets = _functions()
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            sizes, sums, others, halves, bits = [], [], [], [], []
            for s in shingle_sets(part.column(1).to_pylist(), words):
                sizes.append(len(s))
                sums.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                others.append(int(np.bitwise_xor.reduce(_mixed(s + _STEP)).astype(np.int64)) if len(s) else 0)
                halves.append((_halves(s, factors, offsets) if len(s) else s).view(np.int64))
                bits.append(_bitmap(s).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(others, pa.int64()), pa.array(halves, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["id", "n", "k1", "k2", "halves", "bits"],
            )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist(), words)]
            sums = [int(s.view(np.uint64).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "k1", "shingles"])


def _bounded(keys: DataFrame) -> DataFrame:
    """Sent to all executors if it has ``BROADCAST_ROWS`` rows at most, else dealt."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable, for every node with a link.

    Alternating large and small stars. Each turn hangs neighbours on the smallest one, so paths
    shrink by powers; a node of many links is only ever a key of a sum and of a join that Spark splits.
    Shuffle files go turn by turn: with many partitions even those of few links fill disks.
    """
    spark = edges.sparkSession
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("w"), "u", "m")
        edges = small.select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(edges)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == before:
            break
        before = now
        discard(spark)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS_PER_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = saved(in_arrow(given, lambda b: _signatures(b, words), "id long, n long, k1 long, k2 long, halves array<long>, bits array<long>"), "near-signatures")
    able = signed.where("n > 0 AND id IS NOT NULL")
    classes = able.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"))
    members = able.select("id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"]).select("id", "rep")
    # An id with several texts is one document: its classes are linked through it.
    several = cut(members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("id", "a"))
    links = members.join(_bounded(several), "id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    reps = saved(
        able.join(classes.select(F.col("rep").alias("id"), "n", "k1", "k2"), ["id", "n", "k1", "k2"])
        .dropDuplicates(["id", "n", "k1", "k2"])
        .select(F.col("id").alias("rep"), "n", "halves", "bits"),
        "near-classes",
    )
    discard(docs.sparkSession)
    halves = saved(_shared_halves(reps), "near-halves")
    parts = components(links) if not several.isEmpty() else None
    tested = cut(_centres(halves))
    discard(docs.sparkSession)
    compared = cut(_compared(tested, _sets_of(given, tested, words), percent))
    discard(docs.sparkSession)
    reps = reps.join(compared.select(F.col("b").alias("rep"), F.col("a").alias("centre"), (1 - F.col("common") / F.col("either")).alias("away")), "rep", "left")
    parts = _joined(parts, compared, percent)
    live = saved(_table_entries(halves, parts), "near-entries")
    discard(docs.sparkSession, halves)
    for last in (False, True):
        live, pairs = _candidates(live, reps, parts, tested, last, percent)
        if not pairs.isEmpty():
            tested = cut(tested.unionByName(pairs))
            parts = _joined(parts, cut(_compared(pairs, _sets_of(given, pairs, words), percent)), percent)
        discard(docs.sparkSession)
    discard(docs.sparkSession, live)
    if parts is None:
        linked = members.select("id", F.col("rep").alias("component_id"))
    else:
        linked = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    linked = linked.groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("id", F.col("n").alias("n_shingles")).join(linked, "id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _sets_of(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(id, k1, n, shingles): the full sets of the documents of ``pairs``."""
    wanted = _bounded(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    sets = in_arrow(docs.join(wanted, "id", "left_semi"), lambda b: _sets(b, words), "id long, k1 long, shingles array<long>").dropDuplicates(["id", "k1"])
    return saved(sets.select("id", "k1", F.size("shingles").cast("long").alias("n"), "shingles"), "near-sets")


def _joined(parts: DataFrame | None, compared: DataFrame, percent: int) -> DataFrame | None:
    """Components with what the comparison confirms."""
    confirmed = compared.where(100 * F.col("common") >= percent * F.col("either")).select("a", "b")
    if confirmed.isEmpty():
        return parts
    return components(confirmed if parts is None else confirmed.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _part_of(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their ``rep``."""
    if parts is None:
        return rows.withColumn("part", F.col("rep"))
    known = _bounded(parts.select(F.col("node").alias("rep"), "component"))
    return rows.join(known, "rep", "left").select(*rows.columns, F.coalesce("component", "rep").alias("part"))


def _shared_halves(reps: DataFrame) -> DataFrame:
    """(slot, half, rep, lo): the halves that several classes have, lo the smallest of these."""
    halves = reps.select("rep", F.posexplode("halves").alias("slot", "half"))
    shared = halves.groupBy("slot", "half").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").drop("hi")
    return halves.join(shared, ["slot", "half"])


def _centres(halves: DataFrame) -> DataFrame:
    """(a, b): every class b that meets the smallest class a of its halves in a table, by the a of most halves."""
    met = halves.where("rep <> lo").groupBy("rep", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("one"), F.max("slot").alias("two"))
    met = met.where((F.col("one") < SIDE) & (F.col("two") >= SIDE))
    return met.groupBy(F.col("rep").alias("b")).agg(F.max_by("lo", F.struct("n", -F.col("lo"))).alias("a")).select("a", "b")


def _table_entries(halves: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(key, table, rep): the entries of all tables, by halves that hold several components."""
    placed = _part_of(halves.select("slot", "half", "rep"), parts)
    mixed = placed.groupBy("slot", "half").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("slot", "half")
    own = placed.join(mixed, ["slot", "half"]).groupBy("rep").agg(F.collect_set(F.struct("slot", "half")).alias("own"))
    first, second = (F.filter("own", lambda x: (x["slot"] < SIDE) if side == 0 else (x["slot"] >= SIDE)) for side in (0, 1))

    def combined(a: Column, b: Column) -> Column:
        return F.struct((a["slot"] * 2 * SIDE + b["slot"]).alias("table"), F.xxhash64(a["slot"], a["half"], b["slot"], b["half"]).alias("key"))

    return own.select("rep", F.inline(F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: combined(a, b))))))


def _first_table(a: str, b: str) -> Column:
    """The first table in which two classes with these halves meet. Written out half by half, so
    that the join evaluates it in compiled code."""

    def first(slots: range) -> Column:
        slot = F.lit(None).cast("int")
        for k in reversed(slots):
            slot = F.when(F.get(a, F.lit(k)) == F.get(b, F.lit(k)), F.lit(k)).otherwise(slot)
        return slot

    return first(range(SIDE)) * 2 * SIDE + first(range(SIDE, 2 * SIDE))


def _differing(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(BITMAP)))


def _band(size: Column) -> Column:
    """Bands of set sizes, each half as long again as the last or somewhat more."""
    return F.floor(F.log(size) / F.log(F.lit(1.5625))).cast("int")


def _candidates(entries: DataFrame, reps: DataFrame, parts: DataFrame | None, tested: DataFrame, last: bool, percent: int) -> tuple[DataFrame, DataFrame]:
    """The entries that still hold several components, and this round's new pairs (a < b)."""
    of = _part_of(entries.select("key", "table", "rep"), parts)
    if not last:
        state = of.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("rep").alias("centre"), F.min_by("part", "rep").alias("home"))
        entries = saved(of.join(state.where("lo <> hi").select("key", "centre", "home"), "key"), "near-live")
        pairs = entries.where("part <> home").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b"))
    else:
        # Classes outside the largest component of an entry, each against the classes of other components.
        largest = of.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count(F.lit(1)).alias("parts"))
        brief = reps.withColumn("halves", F.transform("halves", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))
        held = of.join(largest.where("parts > 1").drop("parts"), "key").join(brief, "rep")
        one = held.where("part <> largest").select("key", "table", F.col("bits").alias("ba"), F.col("rep").alias("a"), "part", F.col("n").alias("na"), F.col("halves").alias("ha"), F.col("centre").alias("ca"), F.col("away").alias("da"))
        one = one.withColumn("bands", F.explode(F.sequence(_band(F.ceil(percent * F.col("na") / 100)), _band(F.floor(100 * F.col("na") / percent)))))
        two = held.select(F.col("key").alias("with"), F.col("bits").alias("bb"), F.col("rep").alias("b"), F.col("part").alias("other"), F.col("n").alias("nb"), F.col("halves").alias("hb"), F.col("centre").alias("cb"), F.col("away").alias("db"), _band(F.col("n")).alias("band"))
        apart = (F.col("part") != F.col("other")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        apart &= F.coalesce((F.col("ca") != F.col("cb")) | (F.abs(F.col("da") - F.col("db")) <= 1 - percent / 100 + 1e-9), F.lit(True))
        both = F.col("na") + F.col("nb")
        # Sets that overlap enough differ in no more elements than this, and so in no more bits.
        apart &= _differing("ba", "bb") <= both - 2 * F.ceil(percent * both / (100 + percent))
        apart &= F.col("table") == _first_table("ha", "hb")
        pairs = one.join(two, (F.col("key") == F.col("with")) & (F.col("bands") == F.col("band")) & apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return entries, cut(pairs.distinct().join(tested, ["a", "b"], "left_anti").select("a", "b"))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, either): sizes of intersection and union of the full sets; pairs whose sizes
    rule the similarity out are left out. An id with several texts counts with each of them."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    counted = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"), (F.size("sa") + F.size("sb")).alias("sum"))
    best = counted.groupBy("a", "b").agg(F.max(F.struct((F.col("common") / (F.col("sum") - F.col("common"))).alias("s"), "common", (F.col("sum") - F.col("common")).alias("either"))).alias("best"))
    return best.select("a", "b", "best.common", "best.either")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS_PER_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id, and one of rows alike in id and text."""
    gone = near_dedup(docs, id_col, text_col, words, percent).where(~F.col("kept")).select(F.col("id").alias("of")).distinct()
    given = boxed(docs).withColumn("id", F.col(f"doc.`{id_col}`").cast("long"))
    left = given.join(_bounded(gone), F.col("id") == F.col("of"), "left_anti")
    # Rows alike in id and text: only rows whose id repeats are compared.
    repeated = _bounded(cut(docs.groupBy(F.col(id_col).cast("long").alias("of")).count().where("of IS NOT NULL AND count > 1").select("of")))
    once = left.join(repeated, F.col("id") == F.col("of"), "left_anti").select("doc")
    several = left.join(repeated, F.col("id") == F.col("of")).groupBy("id", F.col(f"doc.`{text_col}`").alias("text")).agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc")
    return unboxed(once.unionByName(several), docs.columns)
