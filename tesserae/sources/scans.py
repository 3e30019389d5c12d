"""Scans: directories, tables of labels and lists, annotations, features of several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.functions.text import stem
from tesserae.operators.numbering import numbered
from tesserae.operators.rows import resolve

LABELS = "slide_id string, case_id string, label string, site string, sex string, source string"
#: Usual names of the key columns.
SLIDE_NAMES, CASE_NAMES = {"slide_id", "slide", "wsi", "filename", "file_id"}, {"patient", "patient_id", "case_id", "case", "subject"}


def _loose(pattern: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)


def _qualified(spark: SparkSession, top: str) -> str:
    """``top`` as the paths of its files begin, with scheme and without a slash at the end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString().rstrip("/")


def files(spark: SparkSession, top: str, pattern: str = "*.svs", depth: int | None = None) -> DataFrame:
    """(path, length): files under ``top`` by pattern, whatever its case; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _loose(pattern)).load(top).select("path", "length")
    if depth is not None:
        # Parts below the folder: the path after its own name.
        below = F.substr("path", F.lit(len(_qualified(spark, top)) + 2))
        found = found.where(F.size(F.split(below, "/")) <= depth)
    return found


def listed(spark: SparkSession, top: str, pattern: str = "*", folders: bool = False) -> DataFrame:
    """(place, name, path): the files of one folder, numbered by name. With ``folders`` a folder in it that has
    the pattern's name counts as well, as a table of several files does, whatever its files are called."""
    if folders:
        at, named = _qualified(spark, top), spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(_loose(pattern)).compiled().pattern()
        name = F.regexp_extract(F.substr("path", F.lit(len(at) + 2)), "^[^/]*", 0)
        flat = files(spark, top, "*").select(name.alias("name")).where(F.col("name").rlike(f"(?s)^(?:{named})$")).distinct()
        flat = flat.withColumn("path", F.concat(F.lit(f"{at}/"), "name"))
    else:
        flat = files(spark, top, pattern, depth=1).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "path")
    return numbered(flat, "name", "place").select("place", "name", "path")


def by_name(slides: DataFrame, features: DataFrame, path: str = "path") -> DataFrame:
    """Slides with the feature file of their name, whatever folder and extension it has; null for none.
    Of several files of a name the first by path."""
    named = features.groupBy(stem(F.col(path)).alias("_stem")).agg(F.min(path).alias("features"))
    return slides.join(named, stem(F.col("slide_id")) == F.col("_stem"), "left").drop("_stem")


def table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV file with a header under an explicit schema; NaN texts are nulls."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="nan", enforceSchema=False)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """A label table whose key columns are found by any of their usual names."""
    raw = spark.read.csv(path, header=True)
    slide, case = resolve(raw.columns, SLIDE_NAMES), resolve(raw.columns, CASE_NAMES)
    if slide is None or case is None:
        raise ValueError(f"no slide or case column among {raw.columns}")
    return raw.withColumnsRenamed({slide: "slide_id", case: "case_id"})


def forced_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of the ``slide_id`` column, or of the first one."""
    raw = spark.read.csv(path, header=True)
    column = resolve(raw.columns, {"slide_id"}) or raw.columns[0]
    return raw.select(F.trim(F.col(column).cast("string")).alias("slide_id")).where("slide_id IS NOT NULL AND slide_id <> ''").distinct()


def xml_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(annotation, points): vertices cut to whole numbers, one row per annotation."""
    schema = "_Id string, Coordinates struct<Coordinate: array<struct<_X: double, _Y: double>>>"
    raw = spark.read.format("xml").option("rowTag", "Annotation").schema(schema).load(path)
    points = F.transform("Coordinates.Coordinate", lambda p: F.struct(p["_X"].cast("int").alias("x"), p["_Y"].cast("int").alias("y")))
    return raw.select(F.col("_Id").alias("annotation"), points.alias("points"))


def json_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(type, ring, points): a polygon gives a contour per ring, other shapes one joined contour.
    The text is parsed as JSON and never evaluated."""
    rings = "array<array<array<double>>>"
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.explode(F.from_json("value", f"array<struct<type: string, coordinates: {rings}>>")).alias("a")).select("a.type", "a.coordinates")
    shaped = F.when(F.col("type") == "Polygon", F.col("coordinates")).otherwise(F.array(F.flatten("coordinates")))
    points = F.transform("contour", lambda p: F.struct(p[0].cast("int").alias("x"), p[1].cast("int").alias("y")))
    return each.select("type", F.posexplode(shaped).alias("ring", "contour")).select("type", "ring", points.alias("points"))


def features(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The feature tables of several sources under one ``source`` column."""
    found = None
    for source, path in paths.items():
        one = spark.read.parquet(path).withColumn("source", F.lit(source))
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    return found
