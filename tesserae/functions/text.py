"""Scalar functions over paths, times, numbers and JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {"svs": "pyramid", "btf": "tiff", "tif": "tiff", "tiff": "tiff"}


def sha1_prefix(text: Column, n: int) -> Column:
    return F.substring(F.sha1(text), 1, n)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.[^.]*$", "")


def backend(path: Column) -> Column:
    """Which reader a file needs; an unknown extension raises."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    found = F.lit(None).cast("string")
    for name, kind in EXTENSIONS.items():
        found = F.when(extension == name, F.lit(kind)).otherwise(found)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unsupported file: "), path)).cast("string"))


def clock(seconds: Column) -> Column:
    """h:mm:ss."""
    whole = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)))


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def floor_div(a: Column, b: Column) -> Column:
    """Division that rounds down for negatives too."""
    return F.floor(a / b)


def positive_or(text: Column, default: int) -> Column:
    """A whole number above 0, or the default."""
    value = text.try_cast("int")
    return F.when(value > 0, value).otherwise(F.lit(default))


def summary_name(first: Column, last: Column, folds: Column) -> Column:
    """The summary file's name; with the range in it if not all folds ran."""
    part = F.format_string("summary_partial_%d_%d.csv", first, last)
    return F.when(last - first != folds, part).otherwise(F.lit("summary.csv"))


def json_object(line: Column) -> Column:
    """The line if it looks like one JSON object, else null."""
    return F.when(F.trim(line).rlike(r"^\{.*\}$"), F.trim(line))
