"""What several corpus operators share: word and space patterns, and the shared work folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import ship

#: The six ASCII white-space characters; every other character belongs to a word.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share (``spark.checkpoint.dir``).

    Where none is named one is set in local mode only, as in tests: there driver and executors are one machine.
    """
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    top = spark.conf.get("spark.checkpoint.dir", None) or (kept.get() if kept.isDefined() else None)
    if not top:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tesserae-")
    if not kept.isDefined():
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage; survives lost executors."""
    shared_dir(frame.sparkSession, "checkpoint")
    return frame.checkpoint()


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read again (compressed, column-pruned)."""
    path = shared_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    found = frame.sparkSession.read.schema(frame.schema).parquet(path)
    found.saved_at = path
    return found


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what ``saved`` wrote for frames that nothing reads any more, and let go of the shuffle
    files of queries that are over: Spark deletes these once the driver has collected its garbage."""
    for frame in frames:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def one_spaced(text: Column) -> Column:
    """Every run of ASCII white space as one space."""
    return F.regexp_replace(text, SPACES, " ")


def boxed(docs: DataFrame) -> DataFrame:
    """Rows as one struct ``doc``, so that no name of theirs meets one that an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("doc"))


def unboxed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``doc`` again, with those that changed."""
    return rows.select(*(changed.get(x, F.col(f"doc.`{x}`")).alias(x) for x in columns))


#: Rows of text that go to Python at a time, where the session names no other number: long documents make large batches.
BATCH = 1000


def for_python(spark: SparkSession) -> None:
    """This package on the executors, and small batches to them."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def in_arrow(frame: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    for_python(frame.sparkSession)
    return frame.mapInArrow(function, schema)
