"""Training history, status logs and job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.numbering import numbered

#: Patience, and the epoch up to which training never stops.
PATIENCE, STOP_AFTER = 20, 50


def early_stopping(history: DataFrame, run: str, epoch: str, loss: str, patience: int = PATIENCE, stop_after: int = STOP_AFTER) -> DataFrame:
    """``history`` with best, improved, waited, stop and the epoch that stops the run. An equal loss
    improves. A run's epochs are few, so a window per run is small by nature."""
    order = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("best", F.least(F.col(loss), F.coalesce(before, F.col(loss)))).withColumn("improved", before.isNull() | (F.col(loss) <= before))
    last = F.max(F.when(F.col("improved"), F.col(epoch))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = marked.withColumn("waited", F.col(epoch) - last).withColumn("stop", (F.col("waited") >= patience) & (F.col(epoch) > stop_after))
    return counted.withColumn("stopped_at", F.min(F.when(F.col("stop"), F.col(epoch))).over(Window.partitionBy(run)))


def latest(log: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The last value of each key in an append-only log."""
    last = F.max_by(F.struct(*values), F.col(order))
    return log.groupBy(key).agg(last.alias("last")).select(key, *(F.col(f"last.{v}").alias(v) for v in values))


def stage_means(log: DataFrame, stage: str, seconds: str) -> DataFrame:
    """(stage, mean seconds): failed stages, noted as -1, count as no time."""
    return log.groupBy(stage).agg((F.sum(F.greatest(F.col(seconds), F.lit(0.0))) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_seconds"))


def marker(line: Column, markers: dict[str, str]) -> Column:
    """The step that a log line announces, by the first marker it contains; else null."""
    found = F.lit(None).cast("string")
    for text, step in reversed(markers.items()):
        found = F.when(F.lower(line).contains(text), F.lit(step)).otherwise(found)
    return found


def step_states(log: DataFrame, job: str, order: str, line: str, markers: dict[str, str], steps: list[str]) -> DataFrame:
    """(job, step, state): a step is ``done`` once a later one began, ``running`` if it is the
    furthest, else ``pending``; an ``error`` line turns the running one to ``error``."""
    furthest = F.lit(-1)
    for k, name in enumerate(steps):
        furthest = F.when(F.col("step") == name, F.lit(k)).otherwise(furthest)
    marked = log.withColumn("step", marker(F.col(line), markers | {"error": "error"}))
    state = marked.groupBy(job).agg(F.max(furthest).alias("at"), F.max((F.col("step") == "error").cast("int")).alias("failed"))
    each = state.select(job, "at", "failed", F.posexplode(F.array(*map(F.lit, steps))).alias("k", "step"))
    running = F.when(F.col("failed") == 1, "error").otherwise("running")
    return each.select(job, "step", F.when(F.col("k") < F.col("at"), "done").when(F.col("k") == F.col("at"), running).otherwise("pending").alias("state"))


def progress(frame: DataFrame, key: str, chunks: int = 10) -> DataFrame:
    """(key, chunk): the rows at which a new chunk of the work, in key order, begins."""
    total = frame.count()
    placed = numbered(frame.select(key), key, "place").withColumn("chunk", F.floor(F.col("place") * chunks / max(1, total)).cast("int"))
    begins = (F.col("place") == 0) | (F.col("chunk") > F.floor((F.col("place") - 1) * chunks / max(1, total)))
    return placed.where(begins).select(key, "chunk")


def stage_seconds(log: DataFrame, job: str, stage: str, at: str) -> DataFrame:
    """(job, stage, seconds): from the first to the last line of each stage."""
    first, last = (F.unix_micros(f(F.col(at).cast("timestamp"))) for f in (F.min, F.max))
    seconds = last - first
    return log.groupBy(job, stage).agg((seconds / 1e6).alias("seconds"))
