"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct shingles of ``WORDS`` words (a shorter line is one shingle).
Two lines match if the Jaccard similarity of their tokens is ``PERCENT`` / 100 or more; a
line that matches an earlier one (by document id, then line number) is removed.

1. Words are counted over the whole corpus into ``BUCKETS`` hash buckets, a sketch of fixed
   size that never counts a word too low. Tokens are ordered by the rarity of the word they
   begin with (the place of its bucket among all buckets), ties by hash: one order for the corpus.
2. Lines of equal words form a class, represented by its earliest line.
3. Two sets that match share their first common token among the first floor((1 - s) n) + 1 of the
   larger and the first floor((1 - s) / (1 + s) m) + 1 of the smaller, so only these prefixes are
   joined, by token. Rarest words are found before any token is made, and tokens of a line's
   prefix only where these begin. Tokens of a single class go before anything is joined.
4. Both sides are dealt by token and band of sizes, as sets whose sizes differ more can't match.
   Part of the join are the sizes, the positions (the tokens left from the shared one on must
   allow the overlap), bitmaps of the full sets (where they differ the sets do, which bounds the
   overlap from above), and that the token is the first that the pair shares: each pair comes once.
5. The pairs are verified on the full token sets, made for classes with a shared prefix token only.

Tokens are compared by 49 bits of a hash beside their rarity, so two different shingles of one
pair of lines are taken for one about once in 10**11 pairs. Classes are told apart by 128 bits.

Defined results: null text is one empty line; lines without words match nothing and stay; the
earliest of equal lines stays, by line number within a document; rows that repeat an id are
ordered by a hash of their text, and of rows alike in both each keeps the lines that come first;
lines of rows without an id match as others do and come last; an empty table gives an empty
result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import boxed, cut, discard, saved, text_of, unboxed

PERCENT, WORDS = 80, 5
BUCKETS = 1 << 14
BITMAP = 16
_HASH_BITS = 49
_MASK = (1 << _HASH_BITS) - 1
#: Rows up to which keys are sent to all executors instead of dealing what they select from.
BROADCAST_ROWS = 1_000_000

_PLACE = ("id", "tie", "line_no")
_OTHER_SPACES = "\t\x0b\x0c\r"


def _spaced(text: Column) -> Column:
    """ASCII white space but line ends as spaces; most texts hold none but spaces and are left alone."""
    odd = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in _OTHER_SPACES))
    return F.when(odd, F.translate(text, _OTHER_SPACES, " " * len(_OTHER_SPACES))).otherwise(text)


def _untidy(line: Column) -> Column:
    """Whether spaces are anywhere but one between two words."""
    return F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def _bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(BUCKETS - 1))


def _rank(ranks: Column, word: Column) -> Column:
    # Never null, and told so: Spark sorts arrays without nulls as plain numbers.
    return F.coalesce(ranks[_bucket(word)], F.lit(0))


def rarity_ranks(docs: DataFrame, text_col: str = "text") -> Column:
    """A constant array with the place of every bucket, the rarest first.

    It has ``BUCKETS`` numbers whatever the corpus, so it goes through the driver into the plan.
    """
    spaced = F.replace(_spaced(text_of(text_col)), F.lit("\n"), F.lit(" "))
    # Spaces in a row count as empty words, which moves one bucket and saves a look at every word.
    words = docs.select(F.explode(F.split(spaced, " ")).alias("word"))
    counts = words.groupBy(_bucket(F.col("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    seen = dict(counts.select("bucket", "n").collect())
    ranks = {bucket: rank for rank, bucket in enumerate(sorted(range(BUCKETS), key=lambda b: (seen.get(b, 0), b)))}
    return F.split(F.lit(",".join(str(ranks[b]) for b in range(BUCKETS))), ",").cast("array<int>")


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, line_no, line) of every line that has words, white space in it as spaces."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), _spaced(text_of(text_col)).alias("text"))
    lines = keyed.select("id", "tie", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where((F.col("line") != "") & (~F.startswith("line", F.lit(" ")) | (F.trim("line") != "")))


def _token(rank: Column, at: Column, words: int) -> Column:
    """The shingle of ``words`` that begins at a place: the rank of its first word, then its hash."""
    # Word by word: a slice copies the whole array first.
    shingle = (F.get("words", at + k if k else at) for k in range(words))
    return F.shiftleft(rank.cast("long"), _HASH_BITS) + F.xxhash64(*shingle).bitwiseAND(F.lit(_MASK))


def _sorted_set(tokens: Column) -> Column:
    return F.sort_array(F.array_distinct(tokens))


def _worded(lines: DataFrame, ranks: Column, words: int) -> DataFrame:
    """``lines`` with their words, the words' ranks, and in how many places a shingle begins."""
    split = F.split("line", " ")
    listed = lines.withColumn("words", F.when(_untidy(F.col("line")), F.array_remove(split, "")).otherwise(split))
    ranked = listed.withColumn("ranked", F.transform("words", lambda w: _rank(ranks, w)))
    return ranked.withColumn("places", _places(words))


def _places(words: int) -> Column:
    return F.greatest(F.size("words") - (words - 1), F.lit(1))


def _all_tokens(words: int) -> Column:
    return _sorted_set(F.transform(F.slice("ranked", F.lit(1), F.col("places")), lambda rank, k: _token(rank, k, words)))


def _full_sets(lines: DataFrame, ranks: Column, words: int) -> DataFrame:
    """(c, n, tokens): the sorted set of all shingles of each class's line. Rows of tokens are made in compiled code, arrays are not."""
    split = F.split("line", " ")
    listed = lines.select("c", F.when(_untidy(F.col("line")), F.array_remove(split, "")).otherwise(split).alias("words")).withColumn("places", _places(words))
    # Outer, as else the optimizer splits each line once more to see that it has words.
    rows = listed.select("c", "words", "places", F.posexplode_outer("words").alias("k", "word")).where("k < places")
    tokens = rows.select("c", _token(_rank(ranks, F.col("word")), F.col("k"), words).alias("token"))
    return tokens.groupBy("c").agg(F.sort_array(F.collect_set("token")).alias("tokens")).select("c", F.size("tokens").alias("n"), "tokens")


def _prefixes(worded: DataFrame, percent: int, words: int) -> DataFrame:
    """``prefix``: the first tokens in order, at least as many as a match must share one of; none of a line that is one shingle.

    Tokens are made only where one of the rarest words stands. Where that gives too few, as a shingle repeats, all are made.
    """
    counted = worded.withColumn("enough", _rest(F.col("places"), 100 - percent, 100) + 1)
    limited = counted.withColumn("last", F.sort_array(F.slice("ranked", F.lit(1), F.col("places")))[F.col("enough") - 1])
    at = F.filter(F.sequence(F.lit(0), F.col("places") - 1), lambda k: F.col("ranked")[k] <= F.col("last"))
    some = limited.withColumn("some", _sorted_set(F.transform(at, lambda k: _token(F.coalesce(F.col("ranked")[k], F.lit(0)), k, words))))
    prefix = F.slice(F.when(F.size("some") >= F.col("enough"), F.col("some")).otherwise(_all_tokens(words)), F.lit(1), F.col("enough"))
    # A second use of "last" keeps the optimizer from moving the sort into the loop over places; one that it can't take for true.
    return some.withColumn("prefix", F.when((F.size("words") >= words) & (F.col("last") >= 0), prefix))


def _rest(size: Column, part: int, whole: int) -> Column:
    """Whole tokens in this part of a set."""
    return F.floor(size * part / whole).cast("int")


def _class_hash(words: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), words)


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("void"), *_PLACE)


def _classes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines, and their classes (c, first, copies), by the 128 bits of ``c`` and ``twin``."""

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy("c").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("twin").alias("lo"), F.max("twin").alias("hi"))

    classes = saved(grouped(lines), "line-classes")
    mixed = classes.where("lo <> hi").select("c", "lo")
    if not mixed.isEmpty():  # two classes under one hash: all but one get another
        apart = F.when(F.col("lo").isNull() | (F.col("lo") == F.col("twin")), F.col("c")).otherwise(F.xxhash64("c", "twin"))
        lines = saved(lines.join(mixed, "c", "left").withColumn("c", apart).drop("lo"), "line-prefixes")
        classes = saved(grouped(lines), "line-classes")
    return lines.drop("twin"), classes.drop("lo", "hi")


def _band(size: Column) -> Column:
    """Bands of set sizes, the longest of each half as long again as its shortest or somewhat more."""
    return F.coalesce(F.floor(F.log(size) / F.log(F.lit(1.5625))).cast("int"), F.lit(0))


def _bits(full: DataFrame) -> DataFrame:
    """(c, bits0 ...): a bit set for every token, by its lowest bits. Summed up in compiled code, not by array functions."""
    tokens = full.select("c", F.explode("tokens").alias("token"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("token").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright("token", 6).bitwiseAND(F.lit(BITMAP - 1))
    return tokens.groupBy("c").agg(*(F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}") for k in range(BITMAP)))


def line_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines (id, tie, line_no, c), classes (c, first, copies) and links (a, b) between classes."""
    ranks = rarity_ranks(docs, text_col)
    worded = _worded(split_lines(docs, id_col, text_col), ranks, words)
    tidy = F.when(_untidy(F.col("line")), F.array_join("words", " ")).otherwise(F.col("line"))
    hashed = _prefixes(worded, percent, words).withColumn("tidy", tidy).withColumn("c", _class_hash(F.col("tidy"), 0)).withColumn("twin", _class_hash(F.col("tidy"), 1))
    near = _rest(F.col("places"), 100 - percent, 100 + percent).alias("near")
    lines, classes = _classes(saved(hashed.select(*_PLACE, "c", "twin", near, "prefix"), "line-prefixes"))
    posts = lines.select("c", "near", F.posexplode("prefix").alias("pos", "token")).select("token", "c", (F.col("pos") <= F.col("near")).cast("int").alias("short"))
    shared = cut(posts.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("short").alias("short")).where("lo <> hi AND short = 1").select("token"))
    kept = saved(posts.select("token", "c").join(_bounded(shared), "token").distinct(), "line-posts")
    discard(docs.sparkSession)
    firsts = _bounded(classes.join(kept.select("c").distinct(), "c").select("c", *(F.col(f"first.{x}").alias(f"at_{x}") for x in _PLACE)))
    # Null-safe: a class's first line may stand in a row without an id.
    there = reduce(lambda x, y: x & y, (F.col(x).eqNullSafe(F.col(f"at_{x}")) for x in _PLACE))
    chosen = split_lines(docs, id_col, text_col).join(firsts, there).dropDuplicates(["c"])
    full = saved(_full_sets(chosen.select("c", "line"), ranks, words), "line-sets")
    discard(docs.sparkSession)
    pairs = cut(_candidates(kept, full, percent))
    discard(docs.sparkSession, kept)
    met = _bounded(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct())
    some = full.join(met, "c").select("c", "tokens")
    both = pairs.join(some.select(F.col("c").alias("a"), F.col("tokens").alias("ta")), "a").join(some.select(F.col("c").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    links = cut(both.where(100 * common >= percent * (F.size("ta") + F.size("tb") - common)).select("a", "b"))
    discard(docs.sparkSession, full)
    return lines.drop("prefix", "near"), classes, links


def _candidates(kept: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes, a the smaller set, that share a prefix token and that no bound rules out."""
    # Of a set only the tokens of its prefix that other classes have go along.
    heads = full.select("c", "n", F.slice("tokens", F.lit(1), _rest(F.col("n"), 100 - percent, 100) + 1).alias("head"))
    met = kept.groupBy("c").agg(F.collect_set("token").alias("met"))
    own = heads.join(met, "c").select("c", "n", "head", F.array_intersect("head", "met").alias("own")).join(_bits(full), "c")
    bits = [f"bits{k}" for k in range(BITMAP)]
    placed = own.select("c", "n", "head", "own", *bits, F.posexplode("own").alias("k", "token"))
    placed = placed.withColumn("pos", (F.array_position("head", F.col("token")) - 1).cast("int"))
    # None of these is null. Told so, the join's code is short enough for the JVM to compile.
    known = (F.coalesce(x, F.lit(0).cast(kind)).alias(x) for x, kind in (("token", "long"), ("c", "long"), ("n", "int"), ("pos", "int"), *((b, "long") for b in bits)))
    posts = placed.select(*known, F.slice("own", F.lit(1), F.col("k")).alias("before"))
    small = posts.where(F.col("pos") <= _rest(F.col("n"), 100 - percent, 100 + percent))
    small = small.withColumn("band", F.explode(F.sequence(_band(F.col("n")), _band(F.floor(100 * F.col("n") / percent)))))
    large = posts.withColumn("band", _band(F.col("n")))
    one = small.select(*(F.col(x).alias(f"{x}_a") for x in small.columns))
    two = large.select(*(F.col(x).alias(f"{x}_b") for x in large.columns))
    na, nb = F.col("n_a"), F.col("n_b")
    met = (F.col("token_a") == F.col("token_b")) & (F.col("band_a") == F.col("band_b"))
    sizes = ((na < nb) | ((na == nb) & (F.col("c_a") < F.col("c_b")))) & (100 * na >= percent * nb)
    needed = F.ceil(percent * (na + nb) / (100 + percent))
    left = F.least(na - F.col("pos_a"), nb - F.col("pos_b")) >= needed
    # Sets that overlap enough differ in no more tokens than this, and so in no more bits; most pairs differ in more by a few words of the bitmap.
    differing = [F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in bits]
    few, all_of = (reduce(lambda x, y: x + y, part) for part in (differing[: BITMAP // 4], differing[BITMAP // 4 :]))
    alike = (few <= na + nb - 2 * needed) & (few + all_of <= na + nb - 2 * needed)
    first = ~F.arrays_overlap("before_a", "before_b")
    return one.join(two, met & sizes & left & alike & first).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Every line with words: id, tie, line_no, first_id and first_line of its class, n_links (other
    lines that match) and removed."""
    lines, classes, links = line_matches(docs, id_col, text_col, percent, words)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(classes.select(F.col("c").alias("b"), F.col("first").alias("other"), F.col("copies").alias("more")), "b")
    met = met.groupBy(F.col("a").alias("c")).agg(F.min("other").alias("earliest"), F.sum("more").alias("more"))
    known = classes.join(met, "c", "left").select("c", "first", "copies", "earliest", F.coalesce("more", F.lit(0)).alias("more"))
    # A class's first line is removed only if a line of another class came before it.
    late = (_place() > F.col("first")) | F.coalesce(F.col("earliest") < _place(), F.lit(False))
    return lines.join(known, "c").select(
        *_PLACE, F.col("first.id").alias("first_id"), F.col("first.line_no").alias("first_line"), (F.col("copies") - 1 + F.col("more")).alias("n_links"), late.alias("removed")
    )


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with the removed lines taken out of their texts; every row and column stays."""
    given = boxed(docs).select("doc", F.col(f"doc.`{id_col}`").alias("id"), F.xxhash64(f"doc.`{text_col}`").alias("tie"))
    found = cut(line_dedup(docs, id_col, text_col, percent, words).where("removed").groupBy("id", "tie").agg(F.collect_set("line_no").alias("gone")))
    discard(docs.sparkSession)
    total = found.agg(F.sum(F.size("gone"))).first()[0] or 0
    found = F.broadcast(found) if total <= BROADCAST_ROWS else found
    joined = given.join(found.select(F.col("id").alias("of"), F.col("tie").alias("of_tie"), "gone"), F.col("id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("of_tie")), "left")
    text = F.col(f"doc.`{text_col}`")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    left = joined.withColumn("lines", lines).withColumn("stay", stay)
    return unboxed(left, docs.columns, **{text_col: F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform("stay", lambda k: F.get("lines", k)), "\n"))})
