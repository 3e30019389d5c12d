"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its text). The ledger, a Parquet
folder, holds the blobs and rule versions that were ever scanned, with the spans found (a version
is its name and a digest of the rules, so that other rules never get these findings);
a scan reads only the texts of blobs that the ledger doesn't hold for its rule version, each
once, however many paths share it, and appends them. Findings then go back to all paths by a
join on the blob. Re-running after a failure scans what the last run didn't commit.

SQL functions return matches but not where they are. Splitting a text by the same pattern
gives the gaps between the matches, so the running sum of gap and match lengths gives each
start; lengths count code points.

Defined results: null text is empty text and has no spans; equal texts are scanned once and
all their paths get the spans; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import shared_dir, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: The base kinds, in the order that spans at one start take.
BASE = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
#: Kinds that the method adds: issuer prefixes, signed web tokens, private key headers.
ADDED = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE + ADDED
RULE_VERSION = "1"
LEDGER = "blob string, spans array<struct<start:int,kind:int,end:int>>, rule_version string"


def _spans(text: str, matches: str, rule: Rule, number: int) -> Column:
    """The kept matches of one rule as (start, kind, end), in text order."""
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(matches, F.length).alias("long"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else F.col(matches), F.length).alias("value"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(seen: Column, part: Column) -> Column:
        start = seen["at"] + part["gap"]
        end = start + F.coalesce(part["long"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(part["value"] >= rule.least, F.concat(seen["found"], one)).otherwise(seen["found"]).alias("found"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda seen: seen["found"])
    return F.when(F.size(matches) > 0, walked).otherwise(none)


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) to (blob, spans): all spans of all rules by start, then by rule order."""
    matched = blobs.select(
        "blob", "text", *(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias(f"m{k}") for k, r in enumerate(rules))
    )
    found = (_spans("text", f"m{k}", r, k) for k, r in enumerate(rules))
    return matched.select("blob", F.sort_array(reduce(lambda a, b: F.concat(a, b), found)).alias("spans"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger so far; empty where nothing was scanned yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(LEDGER).parquet(ledger)
    return spark.createDataFrame([], LEDGER)


def version_of(rules: tuple[Rule, ...], rule_version: str = RULE_VERSION) -> str:
    """What the ledger keeps findings under: the version's name and a digest of the rules themselves."""
    told = "\x00".join(f"{r.kind}\x01{r.pattern}\x01{r.group}\x01{r.least}" for r in rules)
    return f"{rule_version}/{hashlib.sha256(told.encode()).hexdigest()[:16]}"


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text_col: str = "text") -> None:
    """Scan the blobs of ``versions`` that the ledger lacks for this rule version, and append them."""
    spark = versions.sparkSession
    version = version_of(rules, rule_version)
    known = read_ledger(spark, ledger).where(F.col("rule_version") == version).select("blob")
    text = text_of(text_col)
    addressed = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    # One text per blob; copies are combined before the shuffle, so a hot blob stays small.
    unseen = addressed.dropDuplicates(["blob"]).join(known, "blob", "left_anti")
    find_spans(unseen, rules).withColumn("rule_version", F.lit(version)).write.mode("append").parquet(ledger)


def scan(
    versions: DataFrame, ledger: str | None = None, keys: tuple[str, ...] = ("path", "version"), rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text_col: str = "text"
) -> DataFrame:
    """All paths and versions with the spans of their blobs: keys, blob, spans."""
    spark = versions.sparkSession
    ledger = ledger or shared_dir(spark, "blob-ledger")
    update_ledger(versions, ledger, rules, rule_version, text_col)
    # Two scans at once may both have added a blob, with the same spans.
    found = read_ledger(spark, ledger).where(F.col("rule_version") == version_of(rules, rule_version)).groupBy("blob").agg(F.first("spans").alias("spans"))
    paths = versions.select(*keys, F.sha2(text_of(text_col), 256).alias("blob"))
    return paths.join(found, "blob", "left").select(*keys, "blob", "spans")


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
