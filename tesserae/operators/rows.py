"""Projections and filters of work tables and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(columns: list[str], candidates: set[str]) -> str | None:
    """The first column whose lower-case name is a candidate."""
    return next((c for c in columns if c.lower().strip() in candidates), None)


def keep_in(frame: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """Rows that match every column's list."""
    for column, values in allowed.items():
        frame = frame.where(F.col(column).isin(values))
    return frame


def drop_in(frame: DataFrame, column: str, ignored: list) -> DataFrame:
    return frame.where(~F.col(column).isin(ignored))


def complete_rows(frame: DataFrame, optional: str) -> tuple[DataFrame, Column]:
    """Drop ``optional`` if it is null in all rows, then every row with a null; also the expression
    that counts what goes."""
    if optional in frame.columns and frame.where(F.col(optional).isNotNull()).limit(1).isEmpty():
        frame = frame.drop(optional)
    whole = F.lit(True)
    for c in frame.columns:
        whole = whole & F.col(c).isNotNull()
    return frame.where(whole), F.sum((~whole).cast("long"))


def with_defaults(frame: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Null cells and absent columns get their defaults."""
    return frame.select(
        *(c for c in frame.columns if c not in defaults),
        *((F.coalesce(F.col(c), F.lit(v)) if c in frame.columns else F.lit(v)).alias(c) for c, v in defaults.items()),
    )


def override(frame: DataFrame, preset: dict[str, object]) -> DataFrame:
    """A preset's values replace the columns they name."""
    return frame.select(*((F.lit(preset[c]) if c in preset else F.col(c)).alias(c) for c in frame.columns))


def id_list(text: Column) -> Column:
    """``'none'`` or empty: no ids; else whole numbers between commas."""
    none = text.isNull() | (F.trim(text) == "") | (F.lower(F.trim(text)) == "none")
    return F.when(none, F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ","), lambda v: F.trim(v).cast("int")))


def keep_ids(every: Column, keep: Column, exclude: Column) -> Column:
    """``keep`` if it names any, else all; less ``exclude``."""
    return F.array_except(F.when(F.size(keep) > 0, F.array_intersect(every, keep)).otherwise(every), exclude)


def legacy_area(a: Column, sx: Column, sy: Column, unit: int = 512) -> Column:
    """An old area parameter in units of the reference patch, cut to a whole number."""
    return (a * sx * sy / (unit * unit)).cast("int")


def fraction(value: Column) -> Column:
    """Percentages above 1 as shares."""
    return F.when(value > 1, value / 100).otherwise(value)


def validated(frame: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all rules, and the others with the names of the rules they fail."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    judged = frame.withColumn("errors", failed)
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0)


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key has no result yet."""
    return work.join(done.select(key), key, "left_anti")
