"""Running sums and consecutive numbers over whole tables without sorting them in one task.

Values are dealt into buckets by quantiles of the order column (found in one pass; as many as the
table's size asks for), summed per bucket, and only those sums, a row per group and bucket, are
summed up in order; inside a bucket a window runs as usual. Null groups are a group of their own,
a null order comes first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds about, and the fewest and most buckets. Each edge is a number in the plan.
ROWS, LEAST, MOST = 250_000, 64, 4096
#: Values that the edges of columns without quantiles (text) are taken from, per bucket. Edges even out tasks, they change no result.
SAMPLED = 64
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")


def bucket_of(frame: DataFrame, order: str, buckets: int | None = None) -> Column:
    """A bucket number that rises with ``order``; nulls come first. ``buckets``: by the number of rows if none is given."""
    rows = None
    if buckets is None:
        rows = frame.count()
        buckets = min(MOST, max(LEAST, rows // ROWS))
    kind = dict(frame.dtypes)[order]
    if kind.startswith(_NUMBERS):
        shares = [k / buckets for k in range(1, buckets)]
        found = frame.agg(F.percentile_approx(order, shares, max(10_000, 20 * buckets)).alias("at")).first()["at"] or []
    else:
        share = min(1.0, SAMPLED * buckets / max(1, rows if rows is not None else frame.count()))
        some = sorted(r[0] for r in frame.select(order).where(F.col(order).isNotNull()).sample(share, 7).collect())
        found = [some[len(some) * k // buckets] for k in range(1, buckets)] if some else []
    return _above(F.col(order), sorted(set(found)), kind)


def _above(value: Column, edges: list, kind: str) -> Column:
    """How many of the sorted ``edges`` are below ``value``, 64 of them at a time; 0 for null."""
    if len(edges) <= 64:
        found = F.lit(0)
        for x in edges:
            found += (value > F.lit(x).cast(kind)).cast("int")
        return F.coalesce(found, F.lit(0))
    found = _above(value, edges[:64], kind)
    for k in range(64, len(edges), 64):
        found = F.when(value > F.lit(edges[k - 1]).cast(kind), _above(value, edges[k : k + 64], kind) + k).otherwise(found)
    return found


def running(frame: DataFrame, groups: list[str], order: str, values: dict[str, str], buckets: int | None = None) -> DataFrame:
    """``frame`` with, per group, the running sum of each value up to and with the row (new names as
    the keys of ``values``). Rows of equal order share their sum."""
    own = f"_{uuid.uuid4().hex[:8]}"
    bucket = f"{own}_bucket"
    dealt = frame.withColumn(bucket, bucket_of(frame, order, buckets))
    sums = dealt.groupBy(*groups, bucket).agg(*(F.sum(v).alias(f"{own}_of_{k}") for k, v in values.items()))
    above = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    keys = {x: f"{own}_{i}" for i, x in enumerate([*groups, bucket])}
    before = sums.select(*(F.col(x).alias(to) for x, to in keys.items()), *(F.coalesce(F.sum(f"{own}_of_{k}").over(above), F.lit(0)).alias(f"{own}_before_{k}") for k in values))
    inside = Window.partitionBy(*groups, bucket).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.select("*", *(F.sum(v).over(inside).alias(f"{own}_in_{k}") for k, v in values.items()))
    met = F.lit(True)
    for x, to in keys.items():
        met &= F.col(x).eqNullSafe(F.col(to))
    joined = summed.join(before, met)
    return joined.select(*frame.columns, *((F.col(f"{own}_in_{k}") + F.col(f"{own}_before_{k}")).alias(k) for k in values))


def placed(frame: DataFrame, groups: list[str], orders: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """``frame`` with 1, 2, ... within each group by ``orders``."""
    own = f"_{uuid.uuid4().hex[:8]}"
    bucket, before, keys = f"{own}_bucket", f"{own}_before", {x: f"{own}_{i}" for i, x in enumerate(groups)}
    dealt = frame.withColumn(bucket, bucket_of(frame, orders[0], buckets))
    sums = dealt.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(x).alias(to) for x, to in keys.items()), F.col(bucket).alias(f"{own}_at"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias(before))
    met = F.col(bucket) == F.col(f"{own}_at")
    for x, to in keys.items():
        met &= F.col(x).eqNullSafe(F.col(to))
    inside = F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*orders))
    return dealt.withColumn(f"{own}_in", inside).join(sums, met).select(*frame.columns, (F.col(f"{own}_in") + F.col(before)).alias(out))


def numbered(frame: DataFrame, order: str, out: str) -> DataFrame:
    """``frame`` with 0, 1, ... by ``order``, whose values are unique."""
    return placed(frame, [], [order], out).withColumn(out, F.col(out) - 1)
