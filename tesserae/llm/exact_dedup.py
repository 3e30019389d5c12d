"""Exact dedup as a stateful stream.

The table is read as a file stream. The keyed state (RocksDB on disk, never expired) holds
for each content digest the smallest stable identifier, its content locator (file and row)
and the number of rows seen. State is committed to the shared checkpoint folder, so the
stream resumes after lost executors or a restart and a later run only adds what is new.

A digest that was seen more than once is a hit. Every row of a hit is compared byte by byte
with the text that the locator names; rows whose bytes differ (a digest collision) are
grouped again by their full text, so that the result never rests on the digest alone. Only the
texts of hits are dealt anew; where hits are too many to be sent to all executors, all rows are.

Defined results: null text is empty text; empty texts are equal to one another; of equal
texts the smallest id stays, null ids after all others, and of repeated ids the first locator;
extra columns are ignored; an empty table gives an empty result. With the state of earlier runs
the row that stays may be one of theirs: its bytes are read where its locator says, and a file that
is gone is an error. Rows whose digest collides are grouped within the table at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import cut, one_spaced, saved, shared_dir, text_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings while the stream runs. Many small stores must not each reserve disk in advance, and a store is closed
#: with its task: else every executor keeps the stores of all its partitions, and of runs before, in memory outside of its heap.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


#: Digests up to which hits are sent to all executors instead of dealing the rows by digest.
BROADCAST_ROWS = 500_000


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _addressed(table: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    return table.select(
        F.col(id_col).alias("id"),
        one_spaced(text_of(text_col)).alias("norm"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ).withColumn("digest", digest(F.col("norm")))


def update_state(
    spark: SparkSession,
    path: str,
    state_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_of,
    files_per_batch: int | None = None,
) -> None:
    """Stream the files under ``path`` that ``state_dir`` hasn't seen into the keyed state."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A pattern that only the path itself matches: the stream then takes a single file as well as a folder.
    path = path.rstrip("/")
    rows = _addressed(reader.parquet(f"{path[:-1]}[{path[-1]}]"), id_col, text_col, digest)
    keyed = rows.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("void"), "id", "file", "row")).alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        query = (
            keyed.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", state_dir)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """(digest, keep_id, keep_file, keep_row, n) as last committed."""
    state = spark.read.format("statestore").load(state_dir)
    first, n = state.schema["value"].dataType.names[:2]
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.`{first}`.id").alias("keep_id"),
        F.col(f"value.`{first}`.file").alias("keep_file"),
        F.col(f"value.`{first}`.row").alias("keep_row"),
        F.col(f"value.`{n}`").alias("n"),
    )


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_of,
    state_dir: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """One row per row of the table at ``path``: id, keep_id, group_size, kept, digest."""
    state_dir = state_dir or shared_dir(spark, "exact-dedup")
    update_state(spark, path, state_dir, id_col, text_col, digest, files_per_batch)
    table = spark.read.parquet(path)
    rows = _addressed(table, id_col, text_col, digest)
    if table.limit(1).isEmpty():
        return rows.select("id", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    # The state is read once: every read opens the store of each partition again.
    hits = saved(read_state(spark, state_dir).where("n > 1"), "exact-hits")
    # Texts go on for hits only. A digest that was seen once is its row's own.
    marked = rows.join(_bounded(hits.select("digest", F.lit(True).alias("hit"))), "digest", "left")
    seen = saved(marked.select("id", "digest", "file", "row", "hit", F.when(F.col("hit"), F.col("norm")).alias("norm")), "exact-rows")
    single = seen.where("hit IS NULL").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    again = seen.where("hit").join(hits, "digest")
    if again.isEmpty():
        return single
    own = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    keepers = again.where(own).select("digest", F.col("norm").alias("keep_norm"))
    # Keepers of an earlier run may lie in files that aren't part of this table.
    away = hits.select("digest", "keep_file", "keep_row").join(again.select("digest").distinct(), "digest", "left_semi").join(keepers.select("digest"), "digest", "left_anti")
    files = [r["keep_file"] for r in away.select("keep_file").distinct().collect()]
    if files:
        there = _addressed(spark.read.schema(table.schema).parquet(*files), id_col, text_col, digest)
        met = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        keepers = keepers.unionByName(there.select("file", "row", F.col("norm").alias("keep_norm")).join(away, met).select("digest", "keep_norm"))
    # Both sides are dealt by digest, so that Spark splits the partition of a hot group. A keeper that can't be read proves nothing.
    same = F.coalesce(F.col("norm") == F.col("keep_norm"), F.lit(False))
    proven = cut(again.join(keepers, "digest", "left").select("id", "digest", "keep_id", "n", own.alias("kept"), "file", "row", same.alias("same"), F.when(~same, F.col("norm")).alias("other")))
    # Rows that share a digest but not the bytes: none, unless the digest collides.
    odd = proven.where(~F.col("same"))
    if odd.isEmpty():
        return single.unionByName(proven.select("id", "keep_id", F.col("n").alias("group_size"), "kept", "digest"))
    groups = odd.groupBy("digest", "other").agg(
        F.min(F.struct(F.col("id").isNull().alias("void"), "id", "file", "row")).alias("first"),
        F.count(F.lit(1)).alias("size"),
    )
    apart = odd.join(groups, ["digest", "other"]).select(
        "id",
        F.col("first.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"),
        "digest",
    )
    less = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    rest = proven.where("same").join(less, "digest", "left").select(
        "id", "keep_id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("group_size"), "kept", "digest"
    )
    return single.unionByName(rest).unionByName(apart)
